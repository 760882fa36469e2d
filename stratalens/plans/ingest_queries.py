"""Result documents, markers, metric JSON and text records, derived from orders and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import revisions as R
from ..functions import scores as S
from ..functions import text as X
from ..operators import metric_tables as M
from ..operators.score_search import search_scores
from ..session import durable, shared_folder
from ..sources import results as P
from ..sources import sinks as K
from ..sources import tables as T
from . import views as V
from .registry import query, rounded
from .registry import sql_round as r
from .views import with_views

# A decimal that never ends in zero, so both engines print it alike.
_NUM = (
    "concat('0.', cast(1 + o_orderkey % 9 AS string), "
    "lpad(cast(cast(round(o_totalprice * 100) AS bigint) % 10000 AS string), 4, '0'), '5')"
)
_NUM2 = "concat('0.', cast(1 + o_custkey % 9 AS string), '25')"


def _document(kind: str) -> str:
    """JSON text of eight shapes, some without a usable score, one malformed."""

    def scores(body: str) -> str:
        return f"""concat('{{"scores":{{{body}}}}}')"""

    def put(template: str) -> str:
        return template.replace("$2", f"', {_NUM2}, '").replace("$1", f"', {_NUM}, '")

    full = (
        """concat('{"task_name":"T","mteb_version":"1.14.19","evaluation_time":"12.5",'"""
        """, '"scores":{"test":[{"accuracy":$2,"empty":null,"flag":true,"hits":[1,2,"x",$2],"""
        """"main_score":$1,"note":"n"}]}}')"""
    )
    shapes = [
        full,
        scores('"validation":[{"main_score":$1}]'),
        scores('"aux":[],"extra":[{"f1":$2,"main_score":$1}]'),
        scores('"test":[{"main_score":"0.7"}],"dev":[{"main_score":$1}]'),
        scores('"test":[{"main_score":true}]'),
        scores('"test":[{"ap":[$1,$2],"main_score":null}],"default":[{"main_score":$1}]'),
        """concat('{"scores":{"test":[{"main_score":$1}')""",
        """concat('{"task_results":[{"scores":{"validation":[{"main_score":$1,"recall":$2}]}}]}')""",
    ]
    cases = " ".join(f"WHEN {i} THEN {put(shape)}" for i, shape in enumerate(shapes))
    return f"CASE {kind} {cases} END"


_CONTENT = _document("o_orderkey % 8")
_DOCS = f"docs AS (SELECT o_orderkey AS doc_id, {_CONTENT} AS content FROM orders)"
_NUMBER = (
    "CASE WHEN json_type({x}) IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') "
    "THEN cast({x} AS double) WHEN json_type({x}) = 'BOOLEAN' "
    "THEN cast(cast({x} AS boolean) AS int) * 1.0::DOUBLE END"
)


def _num(expression: str) -> str:
    return _NUMBER.format(x=f"({expression})")


def _head(key: str) -> str:
    return f"""json_extract(sc, concat('$."', {key}, '"[0].main_score'))"""


def _main(preferred) -> str:
    named = [_num(_head(f"'{name}'")) for name in preferred]
    rest = (
        f"list_filter(list_transform(json_keys(sc), lambda k: {_num(_head('k'))}), "
        "lambda x: x IS NOT NULL)[1]"
    )
    return f"coalesce({', '.join([*named, rest])})"


_PARSED = f"""{_DOCS}, parsed AS (SELECT doc_id, content, coalesce(json_extract(j, '$.scores'),
    json_extract(j, '$.task_results[0].scores')) AS sc, j
  FROM (SELECT *, CASE WHEN json_valid(content) THEN cast(content AS json) END AS j FROM docs))"""


def _orders(spark, folder) -> DataFrame:
    columns = V.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return V.spread(columns)


def _docs(spark, folder) -> DataFrame:
    orders = _orders(spark, folder)
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.expr(_CONTENT).alias("content"))


def _register_score_extract(name: str, preferred) -> None:
    sql = f"WITH {_PARSED} SELECT doc_id, {_main(preferred)} AS main_score FROM parsed"

    @query(name, sql)
    def run(spark, folder):
        score = S.main_score(F.col("content"), preferred)
        return _docs(spark, folder).select("doc_id", score.alias("main_score"))


_register_score_extract("score_extract", S.DEFAULT_SPLITS)
_register_score_extract("score_extract_average", S.AVERAGE_SPLITS)
_register_score_extract("score_extract_first", S.DOCUMENT_ORDER)

_ENTRIES = """list_filter(json_keys(sc), lambda k:
    json_type(json_extract(sc, concat('$."', k, '"[0]'))) = 'OBJECT')"""
_ALL = f"""CASE WHEN len({_ENTRIES}) > 0 THEN concat('{{', array_to_string(list_transform({_ENTRIES},
    lambda k: concat('"', k, '":', json_extract(sc, concat('$."', k, '"[0]')))), ','), '}}') END"""


@query("all_scores", f"WITH {_PARSED} SELECT doc_id, {_ALL} AS all_scores FROM parsed")
def all_scores(spark, folder):
    return _docs(spark, folder).select("doc_id", S.all_scores(F.col("content")).alias("all_scores"))


# The preferred split's metrics: test if it is there, else the first split.
_MAP = f"""{_PARSED}, maps AS (SELECT doc_id, CASE WHEN list_contains({_ENTRIES}, 'test')
    THEN json_extract(sc, '$.test[0]')
    ELSE json_extract(sc, concat('$."', ({_ENTRIES})[1], '"[0]')) END AS m FROM parsed),
  entries AS (SELECT doc_id, k, json_extract(m, concat('$."', k, '"')) AS v
    FROM (SELECT doc_id, m, unnest(json_keys(m)) AS k FROM maps))"""
_LIST_MEAN = f"""list_avg(list_filter(list_transform(cast(v AS json[]),
    lambda x: {_num('x')}), lambda x: x IS NOT NULL))"""
_LONG = f"""{_MAP}, long AS (SELECT doc_id,
    concat(k, CASE WHEN json_type(v) = 'ARRAY' THEN '_mean' ELSE '' END) AS metric_name,
    CASE WHEN json_type(v) = 'ARRAY' THEN {_LIST_MEAN} ELSE {_num('v')} END AS metric_value
  FROM entries)"""


def _wide_scores(spark, folder) -> DataFrame:
    docs = _orders(spark, folder).select(
        F.col("o_orderkey").alias("doc_id"),
        F.get(F.lit(V.TASKS), (F.col("o_custkey") % 32).cast("int")).alias("task"),
        F.expr(_CONTENT).alias("content"),
    )
    return docs.withColumn("all_scores", S.all_scores(F.col("content"))).drop("content")


@query("metric_map", f"WITH {_MAP} SELECT doc_id, k AS name, json_type(v) = 'NULL' AS is_null FROM entries")
def metric_map(spark, folder):
    entries = M.metric_entries(_wide_scores(spark, folder), ["doc_id"])
    is_null = F.schema_of_variant("value") == "VOID"
    return entries.select("doc_id", "name", is_null.alias("is_null"))


@query("metrics_long", f"""WITH {_LONG} SELECT doc_id, metric_name,
  {r('metric_value')} AS metric_value FROM long WHERE metric_value IS NOT NULL""")  # fmt: skip
def metrics_long(spark, folder):
    return rounded(M.metrics_long(_wide_scores(spark, folder), ["doc_id"]), "metric_value")


_WIDE = ["accuracy", "ap_mean", "empty", "f1", "flag", "hits_mean", "main_score", "recall"]
_WIDE_SQL = ", ".join(
    f"{r(f'max(metric_value) FILTER (metric_name = {chr(39)}{n}{chr(39)})')} AS score_{n}" for n in _WIDE
)


@query("metrics_wide", f"""WITH {_LONG} SELECT doc_id, {_WIDE_SQL}
  FROM docs LEFT JOIN long USING (doc_id) GROUP BY doc_id""")  # fmt: skip
def metrics_wide(spark, folder):
    wide = M.metrics_wide(_wide_scores(spark, folder)).drop("task", "all_scores")
    return rounded(wide, *[c for c in wide.columns if c != "doc_id"])


@query("t10_availability", f"""WITH {_LONG}, tasks AS (SELECT o_orderkey AS doc_id,
    {V.TASK_LIST}[o_custkey % 32 + 1] AS task FROM orders)
  SELECT task, count(DISTINCT metric_name) AS n_metrics,
    coalesce(string_agg(DISTINCT metric_name, ', ' ORDER BY metric_name), '') AS available_metrics
  FROM tasks LEFT JOIN (SELECT * FROM long WHERE metric_value IS NOT NULL) USING (doc_id)
  GROUP BY task""")  # fmt: skip
def t10_availability(spark, folder):
    scores = _wide_scores(spark, folder)
    return M.metric_availability(scores, M.metrics_long(scores, ["task"]))


_LEGACY = f"""CASE o_orderkey % 7
  WHEN 0 THEN concat('{{"main_score":', {_NUM}, '}}')
  WHEN 1 THEN concat('{{"a":{{"score":', {_NUM}, '}},"b":{{"main_score":', {_NUM2}, '}}}}')
  WHEN 2 THEN concat('[{{"note":"n"}},{{"cos_sim":{{"spearman":', {_NUM}, '}}}}]')
  WHEN 3 THEN concat('{{"x":[[{{"accuracy":', {_NUM}, '}}]],"score":"0.5"}}')
  WHEN 4 THEN concat('{{"k":{{"l":{{"m":{{"n":{{"main_score":', {_NUM}, '}}}}}}}}}}')
  WHEN 5 THEN concat('{{"none":"text","t":{{"accuracy":true,"score":', {_NUM}, '}}}}')
  ELSE '{{"none":["text", 3]}}' END"""
_RANK = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(S.SCORE_KEYS))


@query("score_search", f"""WITH docs AS (SELECT o_orderkey AS doc_id, {_LEGACY} AS content FROM orders),
  nodes AS (SELECT doc_id, t.parent AS parent, t.key AS k, t.type AS type, t.value AS v
    FROM docs, json_tree(docs.content) t WHERE t.key IN {S.SCORE_KEYS}),
  found AS (SELECT doc_id, arg_min({_num('v')}, (parent, CASE k {_RANK} END)) AS score
    FROM nodes WHERE type IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'BOOLEAN') GROUP BY doc_id)
  SELECT doc_id, score FROM docs LEFT JOIN found USING (doc_id)""")  # fmt: skip
def score_search(spark, folder):
    orders = _orders(spark, folder)
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.expr(_LEGACY).alias("content"))
    return docs.select("doc_id").join(search_scores(docs, "doc_id"), "doc_id", "left")


# Result files of one run: every order writes a document to one of four places of a unit.
_SIZE = "CASE WHEN (o_custkey // 256) % 2 = 0 THEN '410m' ELSE '70m' END"
_UNIT_SQL = f"""SELECT o_orderkey, {_SIZE} AS model_size, {V.revision_sql("(o_custkey // 32)")} AS revision,
    cast((o_orderkey // 8) % 24 AS int) AS layer, {V.TASK_LIST}[o_custkey % 32 + 1] AS task,
    (o_orderkey // 192) % 4 AS place, {_CONTENT} AS content FROM orders"""
_RUN = f"""units AS ({_UNIT_SQL}),
  files AS (SELECT model_size, revision, layer, task, place, arg_max(content, o_orderkey) AS content
    FROM units GROUP BY ALL),
  f AS (SELECT *, {_main(S.DEFAULT_SPLITS)} AS score, {_ALL} AS all_scores FROM (SELECT *,
    coalesce(json_extract(j, '$.scores'), json_extract(j, '$.task_results[0].scores')) AS sc
    FROM (SELECT *, CASE WHEN json_valid(content) THEN cast(content AS json) END AS j FROM files)))"""
_DIR_SQL = """concat('/runs/r1/outputs/mteb/Pythia/', model_size, '/', revision, '/layer_',
    lpad(cast(layer AS string), 3, '0'), '/', task)"""


def _run_files(spark, folder) -> DataFrame:
    """Documents and markers of the run as ``(path, content)``."""
    custkey, orderkey = F.col("o_custkey"), F.col("o_orderkey")
    size = F.when(F.floor(custkey / 256) % 2 == 0, "410m").otherwise("70m")
    units = _orders(spark, folder).select(
        "o_orderkey",
        size.alias("model_size"),
        V._revision(F.floor(custkey / 32)).alias("revision"),
        (F.floor(orderkey / 8) % 24).cast("int").alias("layer"),
        F.get(F.lit(V.TASKS), (custkey % 32).cast("int")).alias("task"),
        (F.floor(orderkey / 192) % 4).alias("place"),
        F.expr(_CONTENT).alias("content"),
    )
    home = F.expr(_DIR_SQL)
    model = R.escaped(R.model_id(F.col("model_size")))
    name = F.concat("task", F.lit(".json"))
    where = (
        F.when(F.col("place") == 0, F.concat_ws("/", home, F.lit("results"), model, "revision", name))
        .when(F.col("place") == 1, F.concat_ws("/", home, name))
        .when(F.col("place") == 2, F.concat_ws("/", home, F.lit(P.CACHE_FOLDER), name))
        .otherwise(F.concat_ws("/", home, F.lit(P.LEGACY_FILE)))
    )
    files = units.groupBy(where.alias("path")).agg(F.max_by("content", "o_orderkey").alias("content"))
    done = units.select(
        F.concat(home, F.lit("/done.json")).alias("path"),
        F.to_json(F.struct(F.lit("ok").alias("status"), "task")).alias("content"),
    )
    return durable(files.unionByName(done.distinct()))


@query("result_files", f"""WITH {_RUN} SELECT concat({_DIR_SQL}, '/results/EleutherAI__pythia-', model_size,
    '/', revision, '/', task, '.json') AS path, 'Pythia' AS model_family, model_size, revision, layer,
    task FROM files WHERE place = 0""")  # fmt: skip
def result_files(spark, folder):
    return P.result_files(_run_files(spark, folder)).select("path", *P.UNIT)


@query("collect_results", f"""WITH {_RUN} SELECT 'Pythia' AS model_family, model_size, revision, layer, task,
    {_DIR_SQL} AS output_dir, arg_min(score, CASE place WHEN 2 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 4 END)
      FILTER (score IS NOT NULL) AS score
  FROM f GROUP BY model_size, revision, layer, task""")  # fmt: skip
def collect_results(spark, folder):
    return P.collect_results(_run_files(spark, folder))


@query("extract_scores", f"""WITH {_RUN}, ranked AS (SELECT *, row_number() OVER
    (PARTITION BY model_size, revision, layer, task
     ORDER BY CASE place WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS n
    FROM f WHERE place = 0 OR (place IN (1, 2) AND j IS NOT NULL))
  SELECT 'Pythia' AS model_family, model_size, revision, layer, task, score AS main_score, all_scores,
    coalesce(json_extract_string(j, '$.task_name'), task) AS task_name,
    coalesce(json_extract_string(j, '$.mteb_version'), '') AS mteb_version,
    coalesce(json_extract_string(j, '$.evaluation_time'), '') AS evaluation_time, place
  FROM ranked WHERE n = 1 AND j IS NOT NULL""")  # fmt: skip
def extract_scores(spark, folder):
    found = P.extract_scores(_run_files(spark, folder))
    path = F.col("result_file")
    place = F.when(path.contains("/results/"), 0).when(path.contains(P.CACHE_FOLDER), 2).otherwise(1)
    return found.withColumn("place", place.cast("long")).drop("output_dir", "result_file")


_MARKERS = f"""SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN concat('/runs/r', o_orderkey, '/flat/done.json')
    ELSE concat('/runs/r', o_orderkey, '/outputs/mteb/Pythia/410m/', revision, '/layer_',
      lpad(cast(layer AS string), 3, '0'), '/', task, '/done.json') END AS path,
    CASE WHEN o_orderkey % 10 = 0 THEN '{{"status"' ELSE concat('{{"status":"ok","model_size":"14m",',
      '"revision":"', revision, '","layer":', layer, ',"task":"', task, '"}}') END AS content
  FROM (SELECT o_orderkey, {V.revision_sql("o_custkey")} AS revision,
    cast(o_orderkey % 24 AS int) AS layer, concat('task_', cast(o_custkey % 32 AS string)) AS task FROM orders)"""
_BROKEN = "o_orderkey % 10 = 0"


@query("parse_paths", f"""WITH m AS ({_MARKERS}) SELECT regexp_replace(path, '/done.json$', '') AS output_dir,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Pythia' END AS model_family,
  CASE WHEN {_BROKEN} THEN '' WHEN o_orderkey % 5 = 0 THEN '14m' ELSE '410m' END AS model_size,
  CASE WHEN {_BROKEN} THEN '' ELSE revision END AS revision,
  CASE WHEN {_BROKEN} THEN cast(-1 AS int) ELSE layer END AS layer,
  CASE WHEN {_BROKEN} THEN '' ELSE task END AS task FROM m""")  # fmt: skip
def parse_paths(spark, folder):
    _orders(spark, folder).createOrReplaceTempView("strata_orders")
    documents = spark.sql(_MARKERS.replace("FROM orders", "FROM strata_orders"))
    return P.read_markers(documents.select("path", "content")).drop("wanted")


_CHUNK = f"""SELECT concat('computed_metrics_chunk_', lpad(cast(o_orderkey AS string), 9, '0'), '.json') AS path,
    {V.revision_sql("o_custkey")} AS revision, cast(o_orderkey % 24 AS int) AS layer,
    {_NUM} AS num FROM orders"""


@query("merge_chunks", f"""WITH c AS ({_CHUNK}) SELECT concat(revision, '_layer_', layer) AS "key",
  revision AS checkpoint, layer, cast(arg_max(num, path) AS double) AS prompt_entropy,
  cast(arg_max(num, path) AS double) AS curvature FROM c GROUP BY revision, layer""")  # fmt: skip
def merge_chunks(spark, folder):
    _orders(spark, folder).createOrReplaceTempView("strata_orders")
    rows = spark.sql(_CHUNK.replace("FROM orders", "FROM strata_orders"))
    content = F.format_string(
        '{"%s_layer_%d":{"checkpoint":"%s","layer":%d,"prompt_entropy":%s,"curvature":%s}}',
        "revision", "layer", "revision", "layer", "num", "num",
    )
    merged = T.merge_chunks(rows.select("path", content.alias("content")))
    return merged.select("key", "checkpoint", "layer", "prompt_entropy", "curvature")


@query("scan_scores_csv", with_views("""
  SELECT revision, layer, task, main_score,
    concat('{"test":{"note":"a, b","task":"', task, '"}}') AS all_scores FROM scores
  """, "scores"))  # fmt: skip
def scan_scores_csv(spark, folder):
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    payload = F.concat(F.lit('{"test":{"note":"a, b","task":"'), "task", F.lit('"}}'))
    rows = V.scores(spark, folder, once=True).withColumn("all_scores", payload)
    K.write_csv(rows, path)
    schema = "revision string, layer int, task string, main_score double, all_scores string"
    return T.read_scores(spark, path, schema)


@query("metrics_scan", with_views("""
  , arms AS (SELECT DISTINCT revision AS checkpoint, cast(layer AS int) AS layer FROM scores)
  SELECT checkpoint, layer, effective_rank, curvature FROM arms LEFT JOIN metrics
    USING (checkpoint, layer)""",
  "scores", "metrics"))
def metrics_scan(spark, folder):
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    cached = V.metrics(spark, folder).withColumnRenamed("checkpoint", "revision")
    K.write_arms(cached, path)
    arms = V.scores(spark, folder, once=True).select("revision", "layer").distinct()
    back = T.with_cached_metrics(arms, T.read_arms(spark, path), ["revision", "layer"])
    return back.select(
        F.col("revision").alias("checkpoint"), "layer", "effective_rank", "curvature"
    )


# Text records: a user turn is a query, the assistant's answer its document.
_SQL_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TURNS = """SELECT a.conv_id, a.turn, a.role, a.text AS body, b.text AS answer
  FROM conversations a LEFT JOIN conversations b
    ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'"""


def _turns(spark, folder) -> DataFrame:
    turns = V.table(spark, folder, "conversations")
    answers = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return turns.withColumnRenamed("text", "body").join(answers, ["conv_id", "turn"], "left")


@query("normalize_text", f"""SELECT conv_id, turn, CASE WHEN role IN ('system', 'assistant') THEN body
  WHEN answer IS NOT NULL THEN {_SQL_STRIP.format("concat(body, ' ', answer)")} ELSE body END AS text
  FROM ({_TURNS})""")  # fmt: skip
def normalize_text(spark, folder):
    body, answer, role = F.col("body"), F.col("answer"), F.col("role")
    even = F.col("turn") % 4 == 0
    records = _turns(spark, folder).select(
        "conv_id",
        "turn",
        F.when(role == "system", body).alias("text"),
        F.when(role == "assistant", body).alias("sentence"),
        F.when(role == "user", body).alias("query"),
        F.when(even, answer).alias("document"),
        F.when(~even & answer.isNotNull(), F.array(answer)).alias("positive"),
    )
    columns = ["text", "sentence", "query", "document", "positive"]
    return records.select("conv_id", "turn", X.record_text(columns).alias("text"))


@query("normalize_text_batch", f"""SELECT doc_id, len(t) AS n_texts, array_to_string(t, '|') AS texts
  FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN string_split(text, chr(10))
    WHEN 1 THEN [{_SQL_STRIP.format("concat(source, ' ', text)")}] ELSE [source, lang] END AS t
  FROM documents)""")  # fmt: skip
def normalize_text_batch(spark, folder):
    kind = F.col("doc_id") % 3
    batches = V.table(spark, folder, "documents").select(
        "doc_id",
        F.when(kind == 0, F.split("text", "\n")).alias("sentences"),
        F.when(kind == 1, F.array("text")).alias("document"),
        F.when(kind == 1, F.array("source"))
        .when(kind == 2, F.array("source", "lang"))
        .alias("query"),
    )
    texts = X.batch_texts(["sentences", "query", "document"])
    named = batches.select("doc_id", texts.alias("t"))
    return named.select(
        "doc_id", F.size("t").cast("long").alias("n_texts"), F.array_join("t", "|").alias("texts")
    )

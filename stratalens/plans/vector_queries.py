"""Corpus, vectors, matrix statistics and task scores over texts and embeddings."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as X
from ..operators import corpus as C
from ..operators import encode as N
from ..operators import evaluate as E
from ..operators import matrix_stats as M
from ..operators import neighbors as B
from ..operators.sampling import sample_rows
from ..session import shared_folder
from ..sources import corpus_cache as H
from . import views as V
from .registry import query, rounded
from .registry import sql_round as r
from .views import with_views

ARM = ["revision", "layer"]

# ---- corpus ---------------------------------------------------------------------------------

_N = "cast(substr(source, 4) AS int)"
_SOURCES = f"""sources AS (SELECT source AS task, doc_id AS pos,
    CASE WHEN {_N} % 4 = 0 THEN NULL ELSE lang END AS subset,
    CASE WHEN {_N} % 5 = 0 OR doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN {_N} % 3 = 0 THEN text END AS text, CASE WHEN {_N} % 3 = 1 THEN text END AS sentence1,
    CASE WHEN {_N} % 3 = 1 THEN lang END AS sentence2, CASE WHEN {_N} % 3 = 2 THEN text END AS query,
    text AS body FROM documents),
  choices AS (SELECT DISTINCT ON (task) task, subset, split FROM sources
    WHERE split IN ('train', 'test')
    ORDER BY task, split <> 'train', subset IS NOT NULL, subset),
  chosen AS (SELECT s.* FROM sources s JOIN choices c ON s.task = c.task AND s.split = c.split
    AND s.subset IS NOT DISTINCT FROM c.subset)"""


def _sources(spark, folder) -> DataFrame:
    n = F.substring("source", 4, 9).cast("int")
    text = F.col("text")
    test = (n % 5 == 0) | (F.col("doc_id") % 5 == 0)
    return V.table(spark, folder, "documents").select(
        F.col("source").alias("task"),
        F.col("doc_id").alias("pos"),
        F.when(n % 4 != 0, F.col("lang")).alias("subset"),
        F.when(test, "test").otherwise("train").alias("split"),
        F.when(n % 3 == 0, text).alias("text"),
        F.when(n % 3 == 1, text).alias("sentence1"),
        F.when(n % 3 == 1, F.col("lang")).alias("sentence2"),
        F.when(n % 3 == 2, text).alias("query"),
    )


@query("corpus_split", f"WITH {_SOURCES} SELECT task, subset, split FROM choices")
def corpus_split(spark, folder):
    return C.choose_split(_sources(spark, folder))


_NOT_BLANK = r"regexp_matches(body, '[^\s]')"


@query("corpus", f"WITH {_SOURCES} SELECT task, pos, body AS text FROM chosen WHERE {_NOT_BLANK}")
def corpus(spark, folder):
    return C.build_corpus(_sources(spark, folder))


def _cached(state: str, built: str, where: str = "") -> str:
    sources = _SOURCES.replace("AS body FROM documents)", f"AS body FROM documents {where})")
    return (
        f"SELECT * FROM (WITH {sources} SELECT '{state}' AS state, {built} AS built, task, pos, body AS text "
        f"FROM chosen WHERE {_NOT_BLANK})"
    )


@query("corpus_cache", " UNION ALL ".join([
    _cached("new", "true"), _cached("good", "false"), _cached("stale", "true", "WHERE doc_id % 7 <> 0"),
    _cached("broken", "true")]))
def corpus_cache(spark, folder):
    """A cache not made yet, a good one, one of other sources, and one whose rows were written over."""
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    sources = _sources(spark, folder)

    def read(state: str, rows: DataFrame, name: str) -> DataFrame:
        corpus, built = H.validated_corpus(spark, f"{path}/{name}", rows, C.build_corpus)
        return corpus.select(F.lit(state).alias("state"), F.lit(built).alias("built"), "task", "pos", "text")

    found = [read("new", sources, "a"), read("good", sources, "a")]
    found.append(read("stale", sources.where("pos % 7 <> 0"), "a"))
    read("new", sources, "b")
    sources.select("task").where("pos % 7 = 0").write.mode("overwrite").parquet(H.rows_folder(spark, f"{path}/b"))
    found.append(read("broken", sources, "b"))
    return functools.reduce(DataFrame.unionByName, found)


# every seventh first, so that the order is neither that of names nor of numbers
_TASK_ORDER = [f"src{7 * n % 20}" for n in range(20)]


@query("corpus_in_task_order", f"""WITH {_SOURCES} SELECT task, pos, row_number() OVER (ORDER BY
    list_position({_TASK_ORDER}, task), pos) AS place FROM chosen
  WHERE {_NOT_BLANK} AND list_contains({_TASK_ORDER}, task)""")  # fmt: skip
def corpus_in_task_order(spark, folder):
    """Where each text stands in the sequence of all tasks' texts."""
    corpus = C.build_corpus(_sources(spark, folder)).select("task", "pos")
    return C.in_task_order(corpus, _TASK_ORDER, place="place")


@query("corpus_limited", f"""WITH {_SOURCES} SELECT task, pos, body AS text FROM chosen
  WHERE {_NOT_BLANK} QUALIFY row_number() OVER (PARTITION BY task ORDER BY pos) <= 5""")  # fmt: skip
def corpus_limited(spark, folder):
    return C.build_corpus(_sources(spark, folder), max_per_task=5)


_RECORDS = """sources AS (SELECT source AS task, doc_id AS pos, CASE WHEN doc_id % 2 = 0 THEN text END AS text,
    CASE WHEN doc_id % 2 = 1 THEN string_split(text, chr(10)) END AS sentences, lang AS title
  FROM documents)"""
_SQL_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("corpus_records", f"""WITH {_RECORDS}, parts AS (SELECT task, pos,
    unnest(list_concat([text], coalesce(sentences, []), [CASE WHEN text IS NOT NULL THEN
      {_SQL_STRIP.format("concat(title, ' ', text)")} END])) AS body FROM sources)
  SELECT task, pos, body AS text FROM parts WHERE body IS NOT NULL AND {_NOT_BLANK}""")  # fmt: skip
def corpus_records(spark, folder):
    even = F.col("doc_id") % 2 == 0
    sources = V.table(spark, folder, "documents").select(
        F.col("source").alias("task"),
        F.col("doc_id").alias("pos"),
        F.lit(None).cast("string").alias("subset"),
        F.lit("train").alias("split"),
        F.when(even, F.col("text")).alias("text"),
        F.when(~even, F.split("text", "\n")).alias("sentences"),
        F.col("lang").alias("title"),
    )
    return C.build_record_corpus(sources).drop("part")


@query("embed_corpus", """WITH tokens AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS w
    FROM documents),
  cells AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 64 AS i, count(*) AS x
    FROM tokens WHERE w <> '' GROUP BY ALL)
  SELECT doc_id, coalesce(cast(sum(x) AS double), 0.0::DOUBLE) AS n_tokens, count(x) AS n_filled,
    coalesce(cast(sum(x * (i + 1)) AS double), 0.0::DOUBLE) AS weighted
  FROM documents LEFT JOIN cells USING (doc_id) GROUP BY doc_id""")  # fmt: skip
def embed_corpus(spark, folder):
    vectors = N.encode_texts(V.spread(V.table(spark, folder, "documents")), ["doc_id"])
    v = F.col("embedding")
    weighted = X.total(F.transform(v, lambda x, i: x * (i + 1)))
    return vectors.select(
        "doc_id",
        X.total(v).alias("n_tokens"),
        F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("n_filled"),
        weighted.alias("weighted"),
    )


@query("pair_texts", f"""SELECT doc_id, {_SQL_STRIP.format("concat(lang, ' ', text)")} AS text FROM documents
  WHERE lang IS NOT NULL AND text IS NOT NULL""")  # fmt: skip
def pair_texts(spark, folder):
    pair = T.pair_text(F.col("lang"), F.col("text"))
    rows = V.table(spark, folder, "documents").select("doc_id", pair.alias("text"))
    return rows.where("text IS NOT NULL")


# ---- vectors --------------------------------------------------------------------------------

_STATES = """states AS (SELECT vec_id AS row_id, list_transform(range(0, 8), lambda p:
    list_transform(embedding[p * 8 + 1 : p * 8 + 8], lambda x: cast(x AS double))) AS hidden,
    vec_id % 9 AS n FROM embeddings)"""


def _states(spark, folder) -> DataFrame:
    vector = X.as_double(F.col("embedding"))
    hidden = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda p: F.slice(vector, p * 8 + 1, F.lit(8))
    )
    n = (F.col("vec_id") % 9).cast("int")
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: (p >= 8 - n).cast("int"))
    return V.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), hidden.alias("hidden"), mask.alias("mask")
    )


def _entries(df: DataFrame, column: str, *keys: str) -> DataFrame:
    long = df.select(*keys, F.posexplode(column).alias("dim", "value"))
    return rounded(long, "value")


@query("pool_mean", f"""WITH {_STATES}, kept AS (SELECT row_id,
    hidden[CASE WHEN n = 0 THEN 1 ELSE 8 - n + 1 END : 8] AS h FROM states),
  cells AS (SELECT row_id, unnest(h) AS v FROM kept),
  dims AS (SELECT row_id, unnest(v) AS x, unnest(range(0, 8)) AS dim FROM cells)
  SELECT row_id, cast(dim AS int) AS dim, {r("avg(x)")} AS value FROM dims GROUP BY row_id, dim""")  # fmt: skip
def pool_mean(spark, folder):
    pooled = X.pool_mean(F.col("hidden"), F.col("mask"))
    return _entries(_states(spark, folder).withColumn("pooled", pooled), "pooled", "row_id")


@query("hidden_states", f"""WITH {_STATES} SELECT row_id, cast(unnest(range(0, 8)) AS int) AS dim,
  {r("unnest(hidden[row_id % 7 + 2])")} AS value FROM states""")  # fmt: skip
def hidden_states(spark, folder):
    """The states of a layer that differs from row to row."""
    layer = (F.col("row_id") % 7).cast("int")
    states = X.hidden_state(F.col("hidden"), layer)
    return _entries(_states(spark, folder).withColumn("state", states), "state", "row_id")


@query("pool_cls", f"""WITH {_STATES} SELECT row_id, cast(unnest(range(0, 8)) AS int) AS dim,
  {r("unnest(hidden[1])")} AS value FROM states""")  # fmt: skip
def pool_cls(spark, folder):
    pooled = X.pool_cls(F.col("hidden"))
    return _entries(_states(spark, folder).withColumn("pooled", pooled), "pooled", "row_id")


@query("pool_first_token", f"""WITH {_STATES} SELECT row_id, cast(unnest(range(0, 8)) AS int) AS dim,
  {r("unnest(hidden[CASE WHEN n = 0 THEN 1 ELSE 8 - n + 1 END])")} AS value FROM states""")  # fmt: skip
def pool_first_token(spark, folder):
    pooled = X.pool_cls(F.col("hidden"), F.col("mask"), first_unmasked=True)
    return _entries(_states(spark, folder).withColumn("pooled", pooled), "pooled", "row_id")


@query("l2_normalize", with_views(f"""SELECT revision, layer, row_id, cast(unnest(range(0, 64)) AS int) AS dim,
  {r("unnest(list_transform(embedding, lambda x: x / greatest(sqrt(list_dot_product(embedding, embedding)), 1e-12)))")}
  AS value FROM arm_embeddings""", "arm_embeddings"))  # fmt: skip
def l2_normalize(spark, folder):
    unit = X.l2_normalize(F.col("embedding"))
    rows = V.arm_embeddings(spark, folder).withColumn("unit", unit)
    return _entries(rows, "unit", *ARM, "row_id")


_NORM = "sqrt(list_dot_product(embedding, embedding))"


@query("norm_stats", with_views(f"""SELECT count(*) AS n_rows, {r(f"avg({_NORM})")} AS mean_norm,
  {r(f"stddev_pop({_NORM})")} AS std_norm FROM arm_embeddings""", "arm_embeddings"))  # fmt: skip
def norm_stats(spark, folder):
    return rounded(E.norm_stats(V.arm_embeddings(spark, folder)), "mean_norm", "std_norm")


_COS = (
    "list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-12) "
    "* (sqrt(list_dot_product({b}, {b})) + 1e-12))"
)


@query("cosine_pairwise", with_views(f"""SELECT a.layer, b.revision, a.row_id, {r(_COS.format(a="a.embedding", b="b.embedding"))} AS cosine
  FROM arm_embeddings a JOIN arm_embeddings b ON a.layer = b.layer AND a.row_id = b.row_id
    AND b.revision = a.revision + 1""", "arm_embeddings"))  # fmt: skip
def cosine_pairwise(spark, folder):
    """Every row of an arm against the same row one revision later."""
    rows = V.arm_embeddings(spark, folder)
    before = rows.withColumn("revision", F.col("revision") + 1)
    return rounded(E.cosine_pairwise(before, rows, ["layer", "revision", "row_id"]), "cosine")


_VECTORS = """vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS double)) AS v
  FROM embeddings)"""
_CENTRES = """centres AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM
    (SELECT label, unnest(v) AS x, unnest(range(0, 64)) AS i FROM {0}) GROUP BY label, i) GROUP BY label)"""


@query("cosine_matrix", f"""WITH {_VECTORS}, {_CENTRES.format("vectors")}
  SELECT vec_id AS left_id, centres.label AS right_id, {r(_COS.format(a="v", b="c"))} AS cosine
  FROM vectors, centres""")  # fmt: skip
def cosine_matrix(spark, folder):
    """Every vector against the label centroids, a reference set that does not grow with the data."""
    vectors = V.table(spark, folder, "embeddings")
    centres = E.label_centroids(vectors)
    return rounded(E.cosine_matrix(vectors, centres, "vec_id", "label"), "cosine")


# ---- matrix statistics ----------------------------------------------------------------------

_COV = """dims AS (SELECT revision, layer, row_id, unnest(embedding) AS x, unnest(range(0, 64)) AS i
    FROM arm_embeddings),
  centred AS (SELECT revision, layer, row_id, i, x - avg(x) OVER (PARTITION BY revision, layer, i) AS x,
    count(*) OVER (PARTITION BY revision, layer, i) AS n FROM dims),
  cov AS (SELECT a.revision, a.layer, a.i, b.i AS j, sum(a.x * b.x) / (max(a.n) - 1) AS c
    FROM centred a JOIN centred b USING (revision, layer, row_id) GROUP BY ALL),
  sums AS (SELECT revision, layer, sum(c) FILTER (i = j) AS t, sum(c * c) AS f FROM cov GROUP BY ALL)"""


@query("effective_rank_fro", with_views(f""", {_COV} SELECT revision, layer,
  {r("CASE WHEN t < 1e-10 THEN 1.0 ELSE t * t / (f + 1e-10) END")} AS effective_rank_fro FROM sums""",
  "arm_embeddings"))
def effective_rank_fro(spark, folder):
    return rounded(M.effective_rank_fro(V.arm_embeddings(spark, folder), ARM), "effective_rank_fro")


@query("anisotropy", with_views(f""", {_COV} SELECT revision, layer,
  {r("sqrt(f / 64 - (t / 64) * (t / 64)) / (t / 64 + 1e-10)")} AS anisotropy FROM sums""",
  "arm_embeddings"))
def anisotropy(spark, folder):
    return rounded(M.anisotropy(V.arm_embeddings(spark, folder), ARM), "anisotropy")


_SQUARINGS = 14
_SCALED = "c / sum(CASE WHEN i = j THEN c END) OVER (PARTITION BY revision, layer) AS c"


def _axis_sql(matrix: str, axis: str) -> str:
    """The leading eigenvector of a symmetric matrix, by squaring it until only that direction is
    left."""
    p = f"{axis}_p"
    steps = [f"{p}0 AS MATERIALIZED (SELECT revision, layer, i, j, {_SCALED} FROM {matrix})"]
    for k in range(1, _SQUARINGS + 1):
        steps.append(
            f"""{p}{k} AS MATERIALIZED (SELECT revision, layer, i, j, {_SCALED} FROM
    (SELECT a.revision, a.layer, a.i, b.j, sum(a.c * b.c) AS c FROM {p}{k - 1} a JOIN {p}{k - 1} b
     ON a.revision = b.revision AND a.layer = b.layer AND a.j = b.i GROUP BY ALL))"""
        )
    last = f"{p}{_SQUARINGS}"
    steps.append(
        f"""{axis} AS MATERIALIZED (SELECT revision, layer, i,
    c / sqrt(sum(c * c) OVER (PARTITION BY revision, layer)) AS v FROM {last} JOIN
    (SELECT revision, layer, arg_max(i, c) AS j FROM {last} WHERE i = j GROUP BY revision, layer)
    USING (revision, layer, j))"""
    )
    return ", ".join(steps)


def _rayleigh_sql(matrix: str, axis: str) -> str:
    return f"""SELECT m.revision, m.layer, sum(a.v * m.c * b.v) AS value FROM {matrix} m
  JOIN {axis} a ON a.revision = m.revision AND a.layer = m.layer AND a.i = m.i
  JOIN {axis} b ON b.revision = m.revision AND b.layer = m.layer AND b.i = m.j GROUP BY ALL"""


_AXIS = f"{_COV}, {_axis_sql('cov', 'axis')}"
# The inverse by Gauss-Jordan elimination; its largest eigenvalue is the inverse of the least one.
_INVERSE = f"""{_AXIS}, gj AS (SELECT revision, layer, 0 AS k, i, j, c FROM cov UNION ALL
    SELECT revision, layer, 0, i, 64 + j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END FROM cov),
  steps AS (SELECT * FROM gj UNION ALL
    SELECT a.revision, a.layer, a.k + 1, a.i, a.j,
      CASE WHEN a.i = a.k THEN a.c / p.c ELSE a.c - x.c * y.c / p.c END FROM steps a
    JOIN steps x ON x.revision = a.revision AND x.layer = a.layer AND x.i = a.i AND x.j = a.k
    JOIN steps y ON y.revision = a.revision AND y.layer = a.layer AND y.i = a.k AND y.j = a.j
    JOIN steps p ON p.revision = a.revision AND p.layer = a.layer AND p.i = a.k AND p.j = a.k
    WHERE a.k < 64),
  inv AS MATERIALIZED (SELECT revision, layer, i, j - 64 AS j, c FROM steps WHERE k = 64 AND j >= 64),
  {_axis_sql("inv", "thin")}, high AS ({_rayleigh_sql("cov", "axis")}),
  low AS ({_rayleigh_sql("inv", "thin")})"""
_LOGDET = f"""{_COV}, ridge AS MATERIALIZED (SELECT revision, layer, i, j,
    c + CASE WHEN i = j THEN 1e-10 ELSE 0 END AS c FROM cov),
  lu AS (SELECT revision, layer, 0 AS k, i, j, c FROM ridge UNION ALL
    SELECT a.revision, a.layer, a.k + 1, a.i, a.j, a.c - x.c * y.c / p.c FROM lu a
    JOIN lu x ON x.revision = a.revision AND x.layer = a.layer AND x.i = a.i AND x.j = a.k
    JOIN lu y ON y.revision = a.revision AND y.layer = a.layer AND y.i = a.k AND y.j = a.j
    JOIN lu p ON p.revision = a.revision AND p.layer = a.layer AND p.i = a.k AND p.j = a.k
    WHERE a.i > a.k AND a.j > a.k)"""


def _histogram_sql(values: str, name: str) -> str:
    return f""", vals AS ({values}),
  spans AS (SELECT revision, layer, CASE WHEN max(v) = min(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
    CASE WHEN max(v) = min(v) THEN 1 ELSE max(v) - min(v) END AS w, count(*) AS n FROM vals GROUP BY ALL),
  bins AS (SELECT revision, layer, n, least(floor((v - lo) / w * 50), 49) AS b, count(*) AS c
    FROM vals JOIN spans USING (revision, layer) GROUP BY ALL),
  terms AS (SELECT *, (c + 1e-10) / (n + 50e-10) AS p, 1e-10 / (n + 50e-10) AS p0 FROM bins)
  SELECT revision, layer, {r("sum(-p * ln(p)) + (50 - count(*)) * max(-p0 * ln(p0))")} AS {name}
  FROM terms GROUP BY revision, layer"""


def _register_spectral(name: str, statistic: str, oracle: str | None = None) -> None:
    @query(name, oracle)
    def run(spark, folder):
        rows = V.arm_embeddings(spark, folder)
        return rounded(M.spectral_statistic(rows, ARM, statistic), statistic)


_register_spectral("effective_rank", "effective_rank")
_register_spectral("condition_number", "condition_number", with_views(f""", {_INVERSE}
  SELECT revision, layer, {r("high.value / (1 / low.value + 1e-10)")} AS condition_number
  FROM high JOIN low USING (revision, layer)""", "arm_embeddings").replace("WITH", "WITH RECURSIVE", 1))  # fmt: skip
_register_spectral("spectral_norm", "spectral_norm", with_views(f""", {_AXIS}
  SELECT revision, layer, {r("value")} AS spectral_norm FROM ({_rayleigh_sql("cov", "axis")})""",
  "arm_embeddings"))
_register_spectral("logdet_cov", "logdet_covariance", with_views(f""", {_LOGDET}
  SELECT revision, layer, {r("sum(ln(c))")} AS logdet_covariance FROM lu WHERE i = k AND j = k
  GROUP BY revision, layer""", "arm_embeddings").replace("WITH", "WITH RECURSIVE", 1))  # fmt: skip


@query("prompt_entropy", with_views(f", {_AXIS}" + _histogram_sql(
    """SELECT revision, layer, row_id, sum(x * v) AS v FROM centred
    JOIN axis USING (revision, layer, i) GROUP BY ALL""", "prompt_entropy"),
    "arm_embeddings"))
def prompt_entropy(spark, folder):
    return rounded(M.prompt_entropy(V.arm_embeddings(spark, folder), ARM), "prompt_entropy")


@query("norm_entropy", with_views(_histogram_sql(
    f"SELECT revision, layer, {_NORM} AS v FROM arm_embeddings", "norm_entropy"),
    "arm_embeddings"))
def norm_entropy(spark, folder):
    return rounded(M.norm_entropy(V.arm_embeddings(spark, folder), ARM), "norm_entropy")


_UNIT = f"list_transform(embedding, lambda x: x / ({_NORM} + 1e-10))"
_SAMPLED = f"""SELECT a.revision, a.layer, 1 - list_dot_product(a.u, b.u) AS v FROM sampled a JOIN sampled b
  ON a.revision = b.revision AND a.layer = b.layer AND a.row_id < b.row_id"""
_COUNTED = "count(*) OVER (PARTITION BY revision, layer) AS n_rows"


def _sample(n: int | None) -> str:
    """All rows, or the first ``n`` by the sampling hash, as unit vectors."""
    first = "" if n is None else (
        "QUALIFY row_number() OVER (PARTITION BY revision, layer "
        f"ORDER BY md5(concat('0:', row_id)), row_id) <= {n}"
    )
    return f", sampled AS MATERIALIZED (SELECT revision, layer, row_id, {_UNIT} AS u, {_COUNTED} FROM arm_embeddings {first})"


def _dataset_entropy_sql(n: int | None) -> str:
    found = _sample(n) + _histogram_sql(_SAMPLED, "dataset_entropy")
    head, _, tail = found.rpartition("\n  SELECT revision, layer, ")
    return with_views(
        f"""{head}, found AS (SELECT revision, layer, {tail})
  SELECT revision, layer, max(n_rows) AS n_rows, count(*) AS n_used, max(dataset_entropy) AS dataset_entropy
  FROM sampled JOIN found USING (revision, layer) GROUP BY revision, layer""",
        "arm_embeddings",
    )


def _register_dataset_entropy(name: str, n: int | None) -> None:
    @query(name, _dataset_entropy_sql(n))
    def run(spark, folder):
        found = M.dataset_entropy(V.arm_embeddings(spark, folder), ARM, n)
        return rounded(found, "dataset_entropy")


_register_dataset_entropy("dataset_entropy", None)
_register_dataset_entropy("dataset_entropy_of_100", 100)


_PAIR_COS = f"""SELECT a.revision, a.layer, {r("avg(list_dot_product(a.u, b.u))")} AS mean_pairwise_cosine
  FROM sampled a JOIN sampled b ON a.revision = b.revision AND a.layer = b.layer AND a.row_id < b.row_id
  GROUP BY a.revision, a.layer"""


@query("mean_pairwise_cosine", with_views(f""", sampled AS (SELECT revision, layer, row_id, {_UNIT} AS u
  FROM arm_embeddings) {_PAIR_COS}""", "arm_embeddings"))  # fmt: skip
def mean_pairwise_cosine(spark, folder):
    rows = V.arm_embeddings(spark, folder)
    return rounded(M.mean_pairwise_cosine(rows, ARM), "mean_pairwise_cosine")


@query("mean_pairwise_cosine_sampled", with_views(
    f"""{_sample(100)}, found AS ({_PAIR_COS}) SELECT revision, layer, max(n_rows) AS n_rows,
  count(*) AS n_used, max(mean_pairwise_cosine) AS mean_pairwise_cosine
  FROM sampled JOIN found USING (revision, layer) GROUP BY revision, layer""", "arm_embeddings"))  # fmt: skip
def mean_pairwise_cosine_sampled(spark, folder):
    rows = V.arm_embeddings(spark, folder)
    return rounded(M.mean_pairwise_cosine(rows, ARM, sample=100), "mean_pairwise_cosine")


def _probes_sql(n: int | None) -> str:
    if n is None:
        return "probes AS (SELECT * FROM arm_embeddings)"
    return f"""probes AS MATERIALIZED (SELECT * FROM arm_embeddings QUALIFY row_number() OVER
    (PARTITION BY revision, layer ORDER BY md5(concat('0:', row_id)), row_id) <= {n})"""


def _near_sql(n: int | None) -> str:
    return f""", {_probes_sql(n)},
  pairs AS (SELECT p.revision, p.layer, p.row_id AS probe_id, e.row_id AS neighbor_id,
    list_distance(p.embedding, e.embedding) AS d, e.embedding AS v FROM probes p JOIN arm_embeddings e
    ON p.revision = e.revision AND p.layer = e.layer AND p.row_id <> e.row_id),
  near AS MATERIALIZED (SELECT *, cast(row_number() OVER (PARTITION BY revision, layer, probe_id
    ORDER BY d, neighbor_id) AS int) AS rank FROM pairs QUALIFY rank <= 10)"""


def _register_knn(name: str, n: int | None) -> None:
    """Every row is a probe, or ``n`` of each arm chosen by hash."""

    @query(name, with_views(f"""{_near_sql(n)}
  SELECT revision, layer, probe_id, neighbor_id, {r("d")} AS distance, rank FROM near""", "arm_embeddings"))  # fmt: skip
    def run(spark, folder):
        rows = V.arm_embeddings(spark, folder)
        probes = None if n is None else sample_rows(rows, ARM, n)
        return rounded(B.knn(rows, probes, ARM, vectors=False), "distance")


_register_knn("knn_join", None)
_register_knn("knn_join_of_100", 100)


def _curvature_sql(k: int = 10) -> str:
    """Condition numbers of the neighbours' centred Gram matrices, one of ``k`` rows a probe.

    The matrix's one null direction, that of equal entries, is lifted to the trace; the least eigenvalue
    is then the inverse of the inverse's largest. ``layer`` numbers the probes for the shared steps.
    """
    gram = f"""{_near_sql(None)},
  places AS (SELECT revision, layer * 1000000 + probe_id AS layer, layer AS arm, rank - 1 AS i, v FROM near),
  entries AS (SELECT revision, layer, i, unnest(v) AS x, unnest(range(0, 64)) AS e FROM places),
  middle AS (SELECT revision, layer, i, e, x - avg(x) OVER (PARTITION BY revision, layer, e) AS x FROM entries),
  rows10 AS MATERIALIZED (SELECT revision, layer, i, list(x ORDER BY e) AS x FROM middle GROUP BY ALL),
  gram AS MATERIALIZED (SELECT a.revision, a.layer, a.i, b.i AS j, list_dot_product(a.x, b.x) / {k - 1} AS c
    FROM rows10 a JOIN rows10 b USING (revision, layer)),
  traces AS (SELECT revision, layer, sum(c) AS t FROM gram WHERE i = j GROUP BY ALL),
  lifted AS MATERIALIZED (SELECT revision, layer, i, j, c + t / {k} AS c FROM gram JOIN traces USING (revision, layer))"""
    inverse = f""", gj AS (SELECT revision, layer, 0 AS k, i, j, c FROM lifted UNION ALL
    SELECT revision, layer, 0, i, {k} + j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END FROM lifted),
  steps AS (SELECT * FROM gj UNION ALL
    SELECT a.revision, a.layer, a.k + 1, a.i, a.j,
      CASE WHEN a.i = a.k THEN a.c / p.c ELSE a.c - x.c * y.c / p.c END FROM steps a
    JOIN steps x ON x.revision = a.revision AND x.layer = a.layer AND x.i = a.i AND x.j = a.k
    JOIN steps y ON y.revision = a.revision AND y.layer = a.layer AND y.i = a.k AND y.j = a.j
    JOIN steps p ON p.revision = a.revision AND p.layer = a.layer AND p.i = a.k AND p.j = a.k
    WHERE a.k < {k}),
  inv AS MATERIALIZED (SELECT revision, layer, i, j - {k} AS j, c FROM steps WHERE k = {k} AND j >= {k})"""
    return with_views(
        f"""{gram}{inverse}, {_axis_sql("gram", "wide")}, {_axis_sql("inv", "thin")},
  high AS ({_rayleigh_sql("gram", "wide")}), low AS ({_rayleigh_sql("inv", "thin")})
  SELECT revision, cast(high.layer // 1000000 AS int) AS layer, count(*) AS n_rows, count(*) AS n_probes,
    {r("avg(high.value / (1 / low.value + 1e-10))")} AS curvature
  FROM high JOIN low USING (revision, layer) GROUP BY ALL""",
        "arm_embeddings",
    ).replace("WITH", "WITH RECURSIVE", 1)


@query("curvature", _curvature_sql())
def curvature(spark, folder):
    return rounded(B.curvature(V.arm_embeddings(spark, folder), ARM, None), "curvature")


@query("repr_metrics")
def repr_metrics(spark, folder):
    table = M.representation_metrics(V.arm_embeddings(spark, folder), ARM)
    return rounded(table, *M.METRICS)


def _with_odd_rows(spark, folder) -> DataFrame:
    """The arms, some vectors of layer 1 missing and one of layer 2 not finite."""
    rows = V.arm_embeddings(spark, folder)
    first = F.col("row_id") == 2
    vector = F.when(first, F.transform("embedding", lambda x: x * float("nan")))
    missing = (F.col("layer") == 1) & (F.col("row_id") % 3 == 0)
    return rows.withColumn("embedding", F.when(~missing, F.coalesce(vector, "embedding")))


@query("odd_vectors", with_views(f""", kept AS (SELECT * FROM arm_embeddings
    WHERE NOT (layer = 1 AND row_id % 3 = 0)), sums AS (SELECT revision, layer, count(*) AS n,
    {r(f"avg({_NORM})")} AS mean_norm FROM kept GROUP BY revision, layer)
  SELECT revision, layer, n, CASE WHEN layer <> 2 THEN mean_norm END AS mean_norm,
    CASE WHEN layer = 2 THEN 'a vector is not finite' END AS reason FROM sums""", "arm_embeddings"))  # fmt: skip
def odd_vectors(spark, folder):
    """Rows without a vector are left out; an arm that cannot be measured has a reason."""
    rows = _with_odd_rows(spark, folder)
    norms = rows.where("embedding IS NOT NULL").groupBy(*ARM).agg(F.avg(X.norm(F.col("embedding"))).alias("m"))
    arms = M.representation_metrics(rows, ARM).join(norms, ARM)
    mean = F.when(F.col("reason").isNull() & F.col("effective_rank").isNotNull(), F.col("m"))
    return rounded(arms.select(*ARM, "n", mean.alias("mean_norm"), "reason"), "mean_norm")


# ---- task scores ----------------------------------------------------------------------------

_PAIRS = f"""{_VECTORS}, pairs AS (SELECT a.vec_id, cast(a.label = b.label AS int) AS gold,
    {_COS.format(a="a.v", b="b.v")} AS sim FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1)"""


def _pairs(spark, folder) -> DataFrame:
    """Each vector with the next one; equal labels are the gold pairs."""
    rows = V.table(spark, folder, "embeddings").select(
        "vec_id", "label", X.as_double(F.col("embedding")).alias("v")
    )
    after = rows.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("label2"), F.col("v").alias("w")
    )
    return rows.join(after, "vec_id").select(
        "vec_id",
        (F.col("label") == F.col("label2")).cast("int").alias("gold"),
        X.cosine(F.col("v"), F.col("w")).alias("sim"),
    )


@query("score_sts", f"""WITH {_PAIRS}, ranked AS (SELECT
    rank() OVER (ORDER BY gold) + (count(*) OVER (PARTITION BY gold) - 1) / 2 AS x,
    rank() OVER (ORDER BY sim) + (count(*) OVER (PARTITION BY sim) - 1) / 2 AS y FROM pairs)
  SELECT count(*) AS n_pairs, {r("corr(x, y)")} AS main_score FROM ranked""")  # fmt: skip
def score_sts(spark, folder):
    return rounded(E.spearman(_pairs(spark, folder), "gold", "sim"), "main_score")


@query("score_pair_ap", f"""WITH {_PAIRS}, cuts AS (SELECT sim, sum(gold) AS p, count(*) AS c FROM pairs GROUP BY sim),
  upto AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS seen FROM cuts WINDOW w AS (ORDER BY sim DESC))
  SELECT cast(sum(c) AS bigint) AS n_pairs, {r("sum(p * tp / seen) / sum(p)")} AS main_score FROM upto""")  # fmt: skip
def score_pair_ap(spark, folder):
    return rounded(E.average_precision(_pairs(spark, folder), "gold", "sim"), "main_score")


@query("score_rerank_map", f"""WITH {_VECTORS}, c AS (SELECT q.vec_id AS qid, d.vec_id AS did,
    cast(q.label = d.label AS int) AS rel, {_COS.format(a="q.v", b="d.v")} AS sim
    FROM vectors q JOIN vectors d ON d.vec_id BETWEEN q.vec_id + 1 AND q.vec_id + 20),
  ranked AS (SELECT *, row_number() OVER w AS n, sum(rel) OVER w AS hits FROM c
    WINDOW w AS (PARTITION BY qid ORDER BY sim DESC, did)),
  per AS (SELECT qid, avg(hits / n) AS ap, 1 / min(n) AS rr FROM ranked WHERE rel = 1 GROUP BY qid)
  SELECT count(*) AS n_queries, {r("avg(ap)")} AS main_score, {r("avg(rr)")} AS mrr FROM per""")  # fmt: skip
def score_rerank_map(spark, folder):
    """Each vector as a query over the twenty after it."""
    rows = V.table(spark, folder, "embeddings").select(
        "vec_id", "label", X.as_double(F.col("embedding")).alias("v")
    )
    queries = rows.select(
        F.col("vec_id").alias("query_id"),
        F.col("label").alias("query_label"),
        F.col("v").alias("q"),
        F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 20)).alias("candidate_id"),
    )
    documents = rows.select(
        F.col("vec_id").alias("candidate_id"), F.col("label").alias("candidate_label"), "v"
    )
    candidates = queries.join(documents, "candidate_id").select(
        "query_id",
        "candidate_id",
        X.cosine(F.col("q"), F.col("v")).alias("similarity"),
        (F.col("query_label") == F.col("candidate_label")).cast("int").alias("relevant"),
    )
    return rounded(E.reranking(candidates), "main_score", "mrr")


def _h(by: str) -> str:
    return f"(SELECT sum(-c / n * ln(c / n)) FROM (SELECT sum(c) AS c FROM cells GROUP BY {by}), total)"


def _h_given(given: str) -> str:
    return (
        f"(SELECT sum(-c / n * ln(c / t)) FROM cells JOIN (SELECT {given}, sum(c) AS t FROM cells "
        f"GROUP BY {given}) USING ({given}), total)"
    )


def _clustered_sql(steps: int = 10, seed: int = 7) -> str:
    """Lloyd steps one after the other, from the first vectors by the seeded hash of the id."""
    parts = [
        f"""WITH {_VECTORS}, k AS (SELECT greatest(count(DISTINCT label), 2) AS k FROM vectors),
  c0 AS MATERIALIZED (SELECT cast(row_number() OVER (ORDER BY md5(concat('{seed}:', vec_id)), vec_id) - 1 AS int)
    AS place, v AS c FROM vectors QUALIFY place < (SELECT k FROM k))"""
    ]
    for i in range(steps + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, any_value(v) AS v,
    arg_min(place, (list_distance(v, c), place)) AS place FROM vectors, c{i} GROUP BY vec_id)""")
        if i < steps:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.place, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN
    (SELECT place, list(x ORDER BY i) AS c FROM (SELECT place, i, avg(x) AS x FROM
      (SELECT place, unnest(v) AS x, unnest(range(0, 64)) AS i FROM a{i}) GROUP BY ALL) GROUP BY place) m
    ON m.place = c.place)""")
    parts.append(f"cells AS (SELECT label, place AS cluster, count(*) AS c FROM a{steps} GROUP BY ALL)")
    parts.append("total AS (SELECT sum(c) AS n FROM cells)")
    return ", ".join(parts) + f""", hc AS (SELECT 1 - {_h_given("cluster")} / {_h("label")} AS h,
    1 - {_h_given("label")} / {_h("cluster")} AS k)
  SELECT (SELECT cast(n AS bigint) FROM total) AS n_rows, {r("h")} AS homogeneity, {r("k")} AS completeness,
    {r("2 * h * k / (h + k)")} AS main_score FROM hc"""


@query("score_vmeasure", _clustered_sql())
def score_vmeasure(spark, folder):
    found = E.clustering(V.table(spark, folder, "embeddings"), seed=7, row="vec_id")
    return rounded(found, "homogeneity", "completeness", "main_score")


@query("v_measure", f"""WITH cells AS (SELECT label, vec_id % 7 + label % 2 AS cluster, count(*) AS c
    FROM embeddings GROUP BY ALL), total AS (SELECT sum(c) AS n FROM cells),
  hc AS (SELECT 1 - {_h_given("cluster")} / {_h("label")} AS h, 1 - {_h_given("label")} / {_h("cluster")} AS k)
  SELECT (SELECT cast(n AS bigint) FROM total) AS n_rows, {r("h")} AS homogeneity, {r("k")} AS completeness,
    {r("2 * h * k / (h + k)")} AS main_score FROM hc""")  # fmt: skip
def v_measure(spark, folder):
    cluster = F.col("vec_id") % 7 + F.col("label") % 2
    rows = V.table(spark, folder, "embeddings").select("label", cluster.alias("cluster"))
    return rounded(E.v_measure(rows), "homogeneity", "completeness", "main_score")


@query("score_centroid_acc", f"""WITH {_VECTORS}, train AS (SELECT * FROM vectors WHERE vec_id % 5 <> 0),
  test AS (SELECT * FROM vectors WHERE vec_id % 5 = 0), {_CENTRES.format("train")},
  near AS (SELECT vec_id, arg_min(centres.label, (list_distance(v, c), centres.label)) AS predicted,
    any_value(test.label) AS label FROM test, centres GROUP BY vec_id)
  SELECT count(*) AS n_rows, {r("avg(cast(label = predicted AS int))")} AS main_score FROM near""")  # fmt: skip
def score_centroid_acc(spark, folder):
    """Train on four fifths of the vectors, test on the rest."""
    rows = V.table(spark, folder, "embeddings").withColumnRenamed("vec_id", "row_id")
    test = F.col("row_id") % 5 == 0
    return rounded(E.centroid_accuracy(rows.where(~test), rows.where(test)), "main_score")

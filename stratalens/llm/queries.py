"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chosen_path,
    containment,
    fertility,
    identifiers,
    license_scan,
    line_crf,
    packing,
    repeats,
    secret_scan,
    token_file,
    vector_codes,
    warc,
    whitening,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, oracle: str | None = None):
    def register(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary())


@query("op8_token_file")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_file.token_documents(table(spark, folder, "documents"), vocabulary())


@query(
    "op3_warc",
    """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                      sha1(coalesce(html, '')) AS payload_digest FROM pages),
         l AS (SELECT payload_digest, max(page_id) AS leader FROM p WHERE payload_bytes >= 1000
               GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id <> leader THEN leader END AS refers_to
    FROM p LEFT JOIN l USING (payload_digest)""",
)
def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, folder, "pages"))


@query("op10_tokeniser_fertility")
def tokeniser_fertility(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return fertility.quality_rules(docs, vocabulary(), vocabulary("piece_bpe_32k.model"))


def _secret_sql() -> str:
    """The same spans by splitting and extracting; the base rules as they are stated."""
    parts = []
    for k, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
        SELECT row, {k} AS rule, '{rule.kind}' AS kind, unnest(range(1, len(f) + 1)) AS i, f, b,
               regexp_extract_all(t, '{pattern}', {rule.group}) AS g, {rule.least} AS least
        FROM (SELECT row, t, regexp_extract_all(t, '{pattern}') AS f,
                     string_split_regex(t, '{pattern}') AS b FROM d)""")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({" UNION ALL ".join(parts)}),
    s AS (SELECT row, rule, kind, list_sum(list_transform(b[1:i], lambda x: length(x)))
                 + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0) AS s,
                 length(f[i]) AS n FROM m WHERE length(g[i]) >= least),
    a AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign,
                 count(*) FILTER (kind = 'access') AS n_access,
                 count(*) FILTER (kind = 'hex') AS n_hex,
                 string_agg(concat(kind, ':', s::BIGINT, ':', (s + n)::BIGINT), ',' ORDER BY s, rule)
                   FILTER (rule < 3) AS base,
                 string_agg(concat(kind, ':', s::BIGINT, ':', (s + n)::BIGINT), ',' ORDER BY s, rule)
                   AS spans FROM s GROUP BY row)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
           coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (row)"""


@query("op5_secret_scan", _secret_sql())
def secrets_found(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, folder, "documents"))


@query(
    "op9_substring_dedup",
    """
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
               FROM documents),
    p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
    h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS h FROM p),
    f AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
    r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM h JOIN f USING (h)
          WHERE least < doc_id),
    g AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
    k AS (SELECT doc_id, len(w) AS n_words, len(coalesce(gone, [])) AS n_removed, w,
                 list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept
          FROM w LEFT JOIN g USING (doc_id))
    SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
    FROM k""",
)
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(table(spark, folder, "documents"))


@query("op2_line_crf")
def line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return line_crf.quality_scores(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


@query("op4_benchmark_containment")
def benchmark_containment(spark: SparkSession, folder: str) -> DataFrame:
    return containment.containment_search(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


@query("op7_chosen_path_join")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = chosen_path.similar_documents(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "n_links")


@query("op6_license_scan")
def licenses(spark: SparkSession, folder: str) -> DataFrame:
    """The table has no paths: a document lies under its source and language, a hundred ids to a
    directory."""
    docs = table(spark, folder, "documents")
    names = F.col("source"), F.col("lang"), F.floor(F.col("doc_id") / 100), F.col("doc_id")
    return license_scan.licenses(docs, F.concat_ws("/", *[n.cast("string") for n in names]))


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitening_digest(table(spark, folder, "embeddings"))


def _codes_sql() -> str:
    """The same steps as joins of parts and entries; the nearest entry is the least distance * 16 + index."""
    steps = [
        """
    v AS (SELECT vec_id, label, row_number() OVER () AS row,
                 list_transform(embedding, lambda c: CAST(floor(4096::DOUBLE * c) AS BIGINT)) AS x
          FROM embeddings WHERE len(embedding) > 0
            AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    t AS MATERIALIZED (SELECT row, vec_id, p, x[p * len(x) // 8 + 1 : (p + 1) * len(x) // 8] AS a
                       FROM v, range(8) AS r(p)),
    u AS MATERIALIZED (SELECT row, p, unnest(a) AS x, unnest(range(len(a))) AS i FROM t),
    b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, a) - 1 AS e, a AS c
                        FROM t QUALIFY e < 16)"""
    ]
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""
    n{k} AS MATERIALIZED (
      SELECT row, p, min(16 * CAST(list_sum(list_transform(list_zip(a, c), lambda z: (z[1] - z[2]) ** 2))
                                   AS BIGINT) + e) AS near FROM t JOIN b{k} USING (p) GROUP BY row, p)""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""
    m{k} AS (SELECT p, near % 16 AS e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS y
             FROM n{k} JOIN u USING (row, p) GROUP BY ALL),
    b{k + 1} AS MATERIALIZED (
      SELECT p, e, coalesce(any_value(g.c), any_value(b.c)) AS c FROM b{k} AS b
      LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS c FROM m{k} GROUP BY p, e) AS g USING (p, e)
      GROUP BY p, e)""")
    last = vector_codes.ROUNDS
    return f"""
    WITH {",".join(steps)},
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{last}),
    s AS (SELECT row, string_agg(format('{{:02x}}', near % 16), '' ORDER BY p) AS code,
                 CAST(sum(near // 16) AS BIGINT) AS error FROM n{last} GROUP BY row)
    SELECT vec_id, code, error,
           CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
    FROM v JOIN s USING (row), h"""


@query("op12_vector_codes", _codes_sql())
def vector_code_compression(spark: SparkSession, folder: str) -> DataFrame:
    found = vector_codes.product_codes(table(spark, folder, "embeddings"))
    return found.drop("label")


@query("op13_personal_identifiers")
def personal_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    return identifiers.identifier_digest(table(spark, folder, "documents"))

"""Task scores from embeddings: similarity, pairs, reranking, clustering, classification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import broadcast_if_small, durable
from .moments import to_matrix, vector_sums
from .ranking import average_ranks, positions, running_totals

BLOCK_VECTORS = 256
CENTROID_BYTES = 64 << 20  # centroids that travel with the tasks at a time


def cosine_pairwise(
    left: DataFrame, right: DataFrame, row: str | list[str] = "row_id", normalize: bool = True
) -> DataFrame:
    """``(row_id, cosine)`` of the vectors two tables hold under the same id, or list of key columns."""
    row = [row] if isinstance(row, str) else list(row)
    a = left.select(*row, V.as_double(F.col("embedding")).alias("_a"))
    b = right.select(*row, V.as_double(F.col("embedding")).alias("_b"))
    value = V.cosine(F.col("_a"), F.col("_b"), normalize)
    return a.join(b, row).select(*row, value.alias("cosine"))


def blocks_of(df: DataFrame, row: str, vector: Column, size: int = BLOCK_VECTORS) -> DataFrame:
    """``(block, members)``: vectors packed into about equal blocks of at most ``2 * size``."""
    kept = durable(df.select(F.col(row).alias("id"), vector.alias("v")))
    n = max(1, -(-kept.count() // size))
    bucket = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block")
    return kept.groupBy(bucket).agg(F.collect_list(F.struct("id", "v")).alias("members"))


def cosine_matrix(
    left: DataFrame,
    right: DataFrame,
    left_row: str = "row_id",
    right_row: str = "row_id",
    normalize: bool = True,
) -> DataFrame:
    """``(left_id, right_id, cosine)`` of every row of ``left`` with every vector of a reference
    set ``right``. The set is packed into blocks, sent to the rows if it is small enough, else
    joined by block."""

    def unit(vector: Column) -> Column:
        v = V.as_double(vector)
        return V.unit(v) if normalize else v

    packed = durable(blocks_of(right, right_row, unit(F.col("embedding"))))
    numbers = packed.agg(F.collect_list("block")).scalar()
    rows = left.select(F.col(left_row).alias("left_id"), unit(F.col("embedding")).alias("_u"))
    spread = rows.withColumn("block", F.explode(numbers))
    pairs = spread.join(broadcast_if_small(packed), "block")
    scored = pairs.select("left_id", F.explode(
        F.transform(
            "members",
            lambda m: F.struct(
                m["id"].alias("right_id"), V.dot(F.col("_u"), m["v"]).alias("cosine")
            ),
        )
    ).alias("p"))
    return scored.select("left_id", "p.right_id", "p.cosine")


def spearman(pairs: DataFrame, gold: str, similarity: str) -> DataFrame:
    """Rank correlation with average ranks for ties. Equal pairs are counted before sorting."""
    counted = durable(pairs.groupBy(gold, similarity).agg(F.count(F.lit(1)).alias("_w")))
    ranked = counted.join(average_ranks(counted, gold, "_w", "_rx"), gold)
    ranked = ranked.join(average_ranks(counted, similarity, "_w", "_ry"), similarity)
    n = counted.agg(F.sum("_w")).scalar()
    centre = (n + 1) / 2
    dx, dy = F.col("_rx") - centre, F.col("_ry") - centre
    sums = ranked.select("_w", dx.alias("dx"), dy.alias("dy")).agg(
        F.sum("_w").alias("n_pairs"),
        F.sum(F.col("_w") * F.col("dx") * F.col("dy")).alias("xy"),
        F.sum(F.col("_w") * F.col("dx") * F.col("dx")).alias("xx"),
        F.sum(F.col("_w") * F.col("dy") * F.col("dy")).alias("yy"),
    )
    value = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    return sums.select("n_pairs", value.alias("main_score"))


def average_precision(pairs: DataFrame, label: str, similarity: str) -> DataFrame:
    """Area under precision over recall, by decreasing similarity; equal similarities together."""
    at = pairs.groupBy(similarity).agg(
        F.sum(F.col(label).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_c")
    )
    order = [F.col(similarity).desc()]
    upto = running_totals(at, order, {"_tp": F.col("_p"), "_seen": F.col("_c")})
    gained = F.sum(F.col("_p") * F.col("_tp") / F.col("_seen"))
    return upto.agg(
        F.sum("_c").alias("n_pairs"), F.try_divide(gained, F.sum("_p")).alias("main_score")
    )


def reranking(candidates: DataFrame) -> DataFrame:
    """Mean average precision and mean reciprocal rank over ``(query_id, candidate_id, similarity,
    relevant)``; queries without a relevant candidate are left out."""
    # sorting reads its input twice: once for the ranges
    candidates = durable(candidates.select("query_id", "candidate_id", "similarity", "relevant"))
    order = [F.col("query_id"), F.col("similarity").desc(), F.col("candidate_id")]
    one = {"_rank": F.lit(1), "_hits": F.col("relevant").cast("long")}
    upto = running_totals(candidates, order, one)
    own = F.col("relevant").cast("long")
    starts = upto.groupBy("query_id").agg(
        F.min(F.col("_rank") - 1).alias("_rank0"), F.min(F.col("_hits") - own).alias("_hits0")
    )
    hits = upto.where(F.col("relevant").cast("boolean")).join(starts, "query_id")
    rank = F.col("_rank") - F.col("_rank0")
    precision = (F.col("_hits") - F.col("_hits0")) / rank
    per_query = hits.groupBy("query_id").agg(
        F.avg(precision).alias("ap"), (1 / F.min(rank)).alias("rr")
    )
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg("ap").alias("main_score"),
        F.avg("rr").alias("mrr"),
    )


def v_measure(assigned: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Homogeneity, completeness and their harmonic mean, from the contingency counts."""
    cells = assigned.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("c"))
    cells = durable(cells)
    n = cells.agg(F.sum("c")).scalar()

    def entropy(by: str) -> Column:
        sizes = cells.groupBy(by).agg(F.sum("c").alias("c"))
        share = F.col("c") / F.col("n")
        return sizes.withColumn("n", n).agg(F.sum(-share * F.log(share))).scalar()

    def conditional(given: str) -> Column:
        sizes = cells.groupBy(given).agg(F.sum("c").alias("t"))
        joined = cells.join(sizes, given).withColumn("n", n)
        term = -(F.col("c") / F.col("n")) * F.log(F.col("c") / F.col("t"))
        return joined.agg(F.sum(term)).scalar()

    measured = cells.agg(F.sum("c").alias("n_rows")).withColumns(
        {
            "h_label": entropy(label),
            "h_cluster": entropy(cluster),
            "h_label_given": conditional(cluster),
            "h_cluster_given": conditional(label),
        }
    )

    def share(inside: str, whole: str) -> Column:
        return F.when(F.col(whole) <= 0, 1.0).otherwise(1 - F.col(inside) / F.col(whole))

    h, c = F.col("homogeneity"), F.col("completeness")
    return (
        measured.withColumn("homogeneity", share("h_label_given", "h_label"))
        .withColumn("completeness", share("h_cluster_given", "h_cluster"))
        .withColumn("main_score", F.when(h + c > 0, 2 * h * c / (h + c)).otherwise(0.0))
        .select("n_rows", "homogeneity", "completeness", "main_score")
    )


def _placed(centres: Broadcast, keep: str):
    """Each row's nearest centre; of equally near ones the first."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = to_matrix(batch.column("embedding"))
                best, found = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
                for i, centre in enumerate(centres.value):
                    distance = ((x - centre) ** 2).sum(axis=1)
                    closer = distance < best
                    best[closer], found[closer] = distance[closer], i
                yield pa.RecordBatch.from_arrays(
                    [batch.column(keep), pa.array(found)], names=[keep, "cluster"]
                )

    return place


def kmeans(
    df: DataFrame, keep: str, k: int, steps: int, seed: int = 0, row: str = "row_id"
) -> DataFrame:
    """``(keep, cluster)`` after ``steps`` Lloyd steps. The first centres are the vectors of the first
    ``k`` rows by a seeded hash of the row id; a centre without rows stays where it is.

    A step folds sums and counts by cluster in every task and merges them; the driver holds the ``k``
    centres. Rows without a vector, or with one that is not finite, are no rows.
    """
    spark = df.sparkSession
    finite = F.forall("embedding", lambda x: F.abs(x) < float("inf"))
    rows = df.where(F.coalesce(finite, F.lit(False))).select(
        row, keep, V.as_double(F.col("embedding")).alias("embedding")
    )
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string")))
    first = rows.orderBy(digest, row).limit(k).select("embedding").collect()
    centres = np.array([r.embedding for r in first])

    def assigned(column: str) -> DataFrame:
        kind = rows.schema[column].dataType.simpleString()
        sent = spark.sparkContext.broadcast(centres)
        own = rows.select(*dict.fromkeys([column, "embedding"]))
        return own.mapInArrow(_placed(sent, column), f"`{column}` {kind}, cluster int")

    for _ in range(steps if len(centres) else 0):
        sums = vector_sums(assigned("embedding"), ["cluster"])
        centres = centres.copy()
        for r in sums.collect():  # a row a centre
            centres[r.cluster] = np.array(r.total) / r.n
    return assigned(keep)


def clustering(
    df: DataFrame, k: int | None = None, seed: int = 0, steps: int = 10, row: str = "row_id"
) -> DataFrame:
    """V-measure of k-means clusters against the labels; ``k`` defaults to the label count."""
    if k is None:
        k = df.select(F.count_distinct("label")).first()[0]
    return v_measure(kmeans(df, "label", max(k, 2), steps, seed, row))


def _nearer(centroids: Broadcast, first: int):
    """Moves rows on to a closer centroid of this block. Distances are sums of squared differences;
    centroids come in the order of their labels and only a smaller distance counts, so ties go to the
    lower label, whatever the blocks."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = to_matrix(batch.column("embedding"))
                best = np.array(batch.column("best").to_numpy(zero_copy_only=False))
                place = np.array(batch.column("place").to_numpy(zero_copy_only=False))
                for i, centroid in enumerate(centroids.value):
                    distance = ((x - centroid) ** 2).sum(axis=1)
                    closer = distance < best
                    best[closer] = distance[closer]
                    place[closer] = first + i
                columns = [batch.column("label"), batch.column("embedding"), pa.array(best), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return move


def centroid_accuracy(
    train: DataFrame, test: DataFrame, block: int = CENTROID_BYTES
) -> DataFrame:
    """Share of test rows whose closest label centroid is their own label's; labels of any type that has
    an order. Rows without a vector or a label are no rows.

    Centroids are numbered by label and sent to the tasks in blocks of at most ``block`` bytes, one
    pass for each: a row carries its closest one so far from block to block.
    """
    sums = vector_sums(train.where("label IS NOT NULL"), ["label"])
    centre = F.transform("total", lambda x: x / F.col("n"))
    centroids = positions(sums.select("label", centre.alias("centroid")), [F.col("label")], name="_place")
    centroids = durable(centroids.withColumn("_place", F.col("_place") - 1))
    widest = centroids.agg(F.max(F.size("centroid")), F.count(F.lit(1))).first()
    size = max(1, block // (8 * (widest[0] or 1) + 16))
    rows = test.where("label IS NOT NULL AND embedding IS NOT NULL").select(
        "label",
        V.as_double(F.col("embedding")).alias("embedding"),
        F.lit(float("inf")).alias("best"),
        F.lit(-1).cast("long").alias("place"),
    )
    for first in range(0, widest[1], size):
        own = centroids.where(F.col("_place").between(first, first + size - 1)).orderBy("_place")
        sent = test.sparkSession.sparkContext.broadcast(
            np.array([r["centroid"] for r in own.select("centroid").collect()])
        )
        rows = rows.mapInArrow(_nearer(sent, first), rows.schema)
    found = rows.join(
        centroids.select(F.col("label").alias("_predicted"), F.col("_place").alias("place")), "place", "left"
    )
    hit = F.coalesce((F.col("label") == F.col("_predicted")).cast("int"), F.lit(0))
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(hit).alias("main_score"))


def label_centroids(df: DataFrame) -> DataFrame:
    """``(label, embedding)``: mean vector of each label."""
    sums = vector_sums(df, ["label"])
    return sums.select("label", F.transform("total", lambda x: x / F.col("n")).alias("embedding"))


def norm_stats(df: DataFrame) -> DataFrame:
    """Mean and population standard deviation of the vector norms."""
    norms = df.select(V.norm(V.as_double(F.col("embedding"))).alias("norm"))
    return norms.agg(
        F.count("norm").alias("n_rows"),
        F.avg("norm").alias("mean_norm"),
        F.stddev_pop("norm").alias("std_norm"),
    )

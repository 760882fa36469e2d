"""Evaluation-result files to score tables.

Files are ``(path, content)`` rows. Every score is read where the file was scanned. Documents are not
shuffled; of a candidate's, only the metric objects of its splits are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import revisions as R
from ..functions import scores as S
from ..operators.score_search import search_scores
from ..schemas import MARKER
from ..session import written

UNIT = ["model_family", "model_size", "revision", "layer", "task"]

# Where a unit's result may lie below its directory.
CACHE_FOLDER = "no_model_name_available/no_revision_available"
RESULTS_FOLDER = "results"
LEGACY_FILE = "mteb_return.json"
MARKER_FILE = "done.json"

# Readers try the places in this order.
COLLECT_ORDER = ("cache", "direct", "legacy", "results")
EXTRACT_ORDER = ("direct", "results", "cache")
REPLAY_ORDER = ("results", "cache", "direct", "legacy")


def read_documents(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """Every file below ``root`` whose name matches, as ``(path, content)``."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def markers(documents: DataFrame) -> DataFrame:
    """Completion markers among the documents."""
    return documents.where(F.col("path").endswith("/" + MARKER_FILE))


def _place(path: Column) -> Column:
    results = rf"/{RESULTS_FOLDER}/[^/]+/[^/]+/[^/]+$"
    return (
        F.when(path.endswith("/" + LEGACY_FILE), "legacy")
        .when(path.contains(f"/{CACHE_FOLDER}/"), "cache")
        .when(path.rlike(results), "results")
        .otherwise("direct")
    )


def _unit_folder(path: Column, place: Column) -> Column:
    return (
        F.when(place == "cache", R.parent(path, 3))
        .when(place == "results", R.parent(path, 4))
        .otherwise(R.parent(path, 1))
    )


def _rank(place: Column, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(name) for name in order]), place)


def _with_unit(df: DataFrame) -> DataFrame:
    return df.withColumns(R.unit_of(F.col("path")))


def located(documents: DataFrame) -> DataFrame:
    """Adds ``place``, the unit's directory and the file's stem; markers and metadata left out."""
    path = F.col("path")
    name = F.element_at(F.split(path, "/"), -1)
    return (
        documents.where((name != MARKER_FILE) & ~name.contains("model_meta"))
        .withColumn("place", _place(path))
        .withColumn("unit_dir", _unit_folder(path, F.col("place")))
        .withColumn("stem", R.file_stem(path))
    )


def result_files(documents: DataFrame) -> DataFrame:
    """Files below a ``results`` directory named after the unit's task, in path order."""
    found = located(documents).where(F.col("place") == "results")
    return _with_unit(found.where(F.col("stem") == R.file_stem(F.col("unit_dir")))).drop("place")


def read_markers(documents: DataFrame) -> DataFrame:
    """Work unit of each marker: from its path, else from its fields, else empty (layer -1)."""
    done = F.from_json("content", MARKER)
    parsed = _with_unit(markers(documents)).withColumn("done", done)
    from_path = F.col("layer").isNotNull()
    fields = {
        name: F.when(from_path, F.col(name)).otherwise(
            F.coalesce(F.col(f"done.{name}"), F.lit(-1 if name == "layer" else ""))
        )
        for name in UNIT
    }
    wanted = F.coalesce(F.nullif(F.col("done.task"), F.lit("")), F.col("task"))
    return (
        parsed.withColumn("wanted", wanted)
        .withColumns(fields)
        .select(*UNIT, "wanted", R.parent(F.col("path")).alias("output_dir"))
    )


def collect_results(
    documents: DataFrame, order: Sequence[str] = COLLECT_ORDER, done: DataFrame | None = None
) -> DataFrame:
    """One row per marker with the score of the first place that yields one, else NULL.

    Documents are read once; of their texts only those of legacy files without a score in the usual
    place are kept, to be searched. ``done`` holds the markers if they were scanned on their own.
    """
    odd = (F.col("place") == "legacy") & F.col("structured").isNull()
    read = written(
        located(documents)
        .withColumn("structured", S.main_score(F.col("content")))
        .select("path", "unit_dir", "stem", "place", "structured", F.when(odd, F.col("content")).alias("content")),
        "result-scores",
    )
    found = search_scores(read.where("content IS NOT NULL"), "path")
    scored = read.join(found, "path", "left").select(
        "unit_dir", "stem", "place", F.coalesce("structured", "score").alias("score")
    )
    units = read_markers(documents if done is None else done)
    matched = units.join(
        scored,
        (units.output_dir == scored.unit_dir)
        & ((F.col("place") == "legacy") | (F.col("stem") == F.col("wanted"))),
        "left",
    )
    rank = F.when(F.col("score").isNotNull(), _rank(F.col("place"), order))
    return matched.groupBy("output_dir", *UNIT).agg(F.min_by("score", rank).alias("score"))


def _details(df: DataFrame) -> DataFrame:
    content = F.col("content")
    document = F.coalesce(F.get_json_object(content, "$.task_results[0]"), content)

    def text(field: str, default: Column) -> Column:
        return F.coalesce(F.get_json_object(document, f"$.{field}"), default)

    return df.withColumns(
        {
            "parsed": S.is_document(content),
            "main_score": S.main_score(content),
            "all_scores": S.all_scores(content),
            "task_name": text("task_name", F.col("task")),
            "mteb_version": text("mteb_version", F.lit("")),
            "evaluation_time": text("evaluation_time", F.lit("")),
        }
    )


def extract_scores(
    documents: DataFrame, order: Sequence[str] = EXTRACT_ORDER, done: DataFrame | None = None
) -> DataFrame:
    """One row per work unit with its main score, all scores and where they came from.

    The first result file of a unit, by path, decides; a unit without any falls back to the other
    places next to its marker, in ``order``, taking the first that parses. The documents are read
    once; ``done`` holds the markers if they were scanned on their own.
    """
    payload = [
        "main_score", "all_scores", "task_name", "mteb_version", "evaluation_time",
        "output_dir", "result_file",
    ]
    primary = F.col("place") == "results"
    places = [place for place in order if place != "results"]
    named = F.col("stem") == F.when(primary, R.file_stem(F.col("unit_dir"))).otherwise(F.col("task"))
    candidates = _details(
        _with_unit(located(documents)).where(
            F.col("layer").isNotNull() & F.col("place").isin("results", *places) & named
        )
    ).select(
        *UNIT,
        "unit_dir",
        "path",
        "parsed",
        F.when(primary, 0).otherwise(_rank(F.col("place"), places)).alias("rank"),
        F.when(primary, R.parent(F.col("path"), 3)).otherwise(F.col("unit_dir")).alias("output_dir"),
        F.col("path").alias("result_file"),
        *payload[:-2],
    )
    marked = (
        read_markers(documents if done is None else done)
        .select(F.col("output_dir").alias("unit_dir"), F.lit(True).alias("marked"))
        .distinct()
    )
    usable = (F.col("rank") == 0) | (F.col("parsed") & F.col("marked"))
    best = F.min_by(F.struct("parsed", *payload), F.struct("rank", "path")).alias("best")
    return (
        candidates.join(marked, "unit_dir", "left")
        .where(usable)
        .groupBy(*UNIT)
        .agg(best)
        .where("best.parsed")
        .select(*UNIT, *[f"best.{name}" for name in payload])
    )

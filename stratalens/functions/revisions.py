"""Column expressions over checkpoint names, layers, model sizes and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MODEL_ORG, MODEL_PREFIX

_UNIT_PATH = r"(?:^|/)mteb/([^/]+)/([^/]+)/([^/]+)/[^/_]*_(\d+)[^/]*/([^/]+)"


def is_checkpoint(revision: Column) -> Column:
    """``main`` or ``step`` followed by digits."""
    return revision.rlike(r"^step[0-9]+$") | (revision == "main")


def step_of(revision: Column) -> Column:
    """Step number of ``step<N>`` or ``step-<N>``, else NULL."""
    return F.regexp_extract(revision, r"^step-?(\d+)$", 1).try_cast("long")


def revision_kind(revision: Column) -> Column:
    """0 for steps, 1 for ``main``, 2 for any other name: the order they are listed in."""
    return (
        F.when(revision == "main", 1).when(step_of(revision).isNotNull(), 0).otherwise(2)
    )


def revision_order(revision: Column) -> list[Column]:
    """Sort keys: steps by number, then ``main``, then names of unknown form."""
    return [
        revision_kind(revision).asc(),
        F.coalesce(step_of(revision), F.lit(0)).asc(),
        revision.asc(),
    ]


def layers_of(spec: Column, n_layers: Column) -> Column:
    """``all`` as 0..n-1, else the listed layers; blanks are skipped."""
    listed = F.filter(F.split(spec, ","), lambda part: F.trim(part) != "")
    return F.when(
        F.lower(F.trim(spec)) == "all", F.sequence(F.lit(0), (n_layers - 1).cast("int"))
    ).otherwise(F.transform(listed, lambda part: F.trim(part).cast("int")))


def model_id(size: Column, org: str = MODEL_ORG) -> Column:
    return F.concat(F.lit(f"{org}/{MODEL_PREFIX}"), F.lower(F.trim(size)))


def escaped(identifier: Column) -> Column:
    """A model id as a directory name."""
    return F.replace(identifier, F.lit("/"), F.lit("__"))


def arm_key(revision: Column, layer: Column) -> Column:
    return F.concat_ws("@", revision, layer.cast("string"))


def parse_arm_key(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, "@", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).cast("int")


def safe_name(task: Column) -> Column:
    """A task name usable in a file path."""
    return F.translate(task, "/ ", "__")


def unit_of(path: Column) -> dict[str, Column]:
    """The five work-unit parts that follow the first ``mteb`` directory; NULL if malformed."""

    def part(group: int) -> Column:
        text = F.regexp_extract(path, _UNIT_PATH, group)
        return F.when(text != "", text)

    return {
        "model_family": part(1),
        "model_size": part(2),
        "revision": part(3),
        "layer": part(4).try_cast("int"),
        "task": part(5),
    }


def parent(path: Column, levels: int = 1) -> Column:
    return F.regexp_replace(path, rf"(/[^/]*){{{levels}}}$", "")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def task_bucket(task: Column, n: int) -> Column:
    """Adler-32 of the UTF-8 bytes modulo ``n``: the same shard in every process and language."""
    data = F.encode(task, "UTF-8")
    count = F.octet_length(task)
    positions = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(
        F.array().cast("array<int>")
    )
    codes = F.transform(
        positions, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    )
    sums = F.aggregate(
        codes,
        F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")),
        lambda acc, code: F.struct(
            ((acc["a"] + code) % 65521).alias("a"),
            ((acc["b"] + acc["a"] + code) % 65521).alias("b"),
        ),
    )
    return (sums["b"] * 65536 + sums["a"]) % n

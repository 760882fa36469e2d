"""Column expressions that read scores out of evaluation-result JSON.

All of them take the JSON text column and stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

# Split preference of the four readers. The first is the default everywhere.
DEFAULT_SPLITS = ("test", "validation", "dev")
AVERAGE_SPLITS = ("test", "validation", "default")
DOCUMENT_ORDER: tuple[str, ...] = ()
# Keys a legacy return value may carry its score under.
SCORE_KEYS = ("main_score", "score", "cos_sim", "spearman", "accuracy")

_NUMBER_TYPES = ("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def kind_is_number(kind: Column) -> Column:
    """Whether a variant's schema text names a number or a boolean."""
    return kind.isin(*_NUMBER_TYPES, "BOOLEAN") | kind.startswith("DECIMAL(")


def _number(value: Column) -> Column:
    def by_kind(kind: Column) -> Column:
        flag = F.try_variant_get(value, "$", "boolean").cast("double")
        number = F.when(kind == "BOOLEAN", flag).when(
            kind_is_number(kind), F.try_variant_get(value, "$", "double")
        )
        return F.nanvl(number, F.lit(None).cast("double"))

    return let(F.schema_of_variant(value), by_kind)


def number_of(value: Column) -> Column:
    """A JSON number or boolean as double; strings, nulls, lists and objects are NULL."""
    return let(value, _number)


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def is_list(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("ARRAY")


def is_document(content: Column) -> Column:
    """Whether the text is JSON; a bare NaN, as Python writes it, is let pass."""
    return (
        F.from_json(content, "map<string,variant>").isNotNull()
        | F.from_json(content, "array<variant>").isNotNull()
        | F.try_parse_json(content).isNotNull()
    )


def split_scores(content: Column) -> Column:
    """Split name -> list of metric objects, in document order; unwraps an outer result list."""
    schema = "scores map<string,variant>"
    outer = F.get_json_object(content, "$.task_results[0]")
    return F.coalesce(
        F.from_json(content, schema)["scores"], F.from_json(outer, schema)["scores"]
    )


def _entry_score(split: Column) -> Column:
    return number_of(F.try_variant_get(split, "$[0].main_score", "variant"))


def split_score(splits: Column, preferred: Sequence[str] = DEFAULT_SPLITS) -> Column:
    """``main_score`` of the first preferred split that has one, else of any split in order."""

    def pick(splits: Column) -> Column:
        named = [_entry_score(F.try_element_at(splits, F.lit(name))) for name in preferred]
        every = F.transform(F.map_values(splits), _entry_score)
        others = F.filter(every, lambda s: s.isNotNull())
        return F.coalesce(*named, F.get(others, F.lit(0)))

    return let(splits, pick)


def main_score(content: Column, preferred: Sequence[str] = DEFAULT_SPLITS) -> Column:
    """The same of a document's splits."""
    return split_score(split_scores(content), preferred)


def all_scores(content: Column) -> Column:
    """JSON text of split -> its first metric object; NULL when no split has one."""
    first = F.transform_values(
        split_scores(content), lambda _, split: F.try_variant_get(split, "$[0]", "variant")
    )
    kept = F.map_filter(first, lambda _, entry: is_object(entry))
    return F.nullif(F.to_json(kept), F.lit("{}"))


def metric_map(all_scores_text: Column, preferred: str = "test") -> Column:
    """Metric name -> value of the preferred split, else of the first split holding an object."""

    def pick(splits: Column) -> Column:
        objects = F.filter(F.map_values(splits), is_object)
        chosen = F.try_element_at(splits, F.lit(preferred))
        return F.coalesce(F.when(is_object(chosen), chosen), F.get(objects, F.lit(0)))

    entry = let(F.from_json(all_scores_text, "map<string,variant>"), pick)
    return F.try_variant_get(entry, "$", "map<string,variant>")


def mean_of_numbers(value: Column) -> Column:
    """Mean of the numeric elements of a JSON list, NULL without any."""
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), number_of)

    def mean(numbers: Column) -> Column:
        total = F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.size(numbers) > 0, total / F.size(numbers))

    return let(F.filter(items, lambda x: x.isNotNull()), mean)


def metric_value(value: Column) -> Column:
    """Numbers and booleans as double, numeric lists as their mean, anything else NULL."""
    return let(value, lambda v: F.when(is_list(v), mean_of_numbers(v)).otherwise(_number(v)))

"""Secret scans by a trigram inverted index, with DataFrame functions only.

From each rule's regex a Boolean query over lower-cased trigrams is derived: the trigrams that any match
must hold, as an AND of groups, each an OR of alternatives, each an AND of trigrams. The index has a
posting ``(trigram, document)`` for those trigrams of the rules that a document holds. Postings are
intersected by counting a document's trigrams per alternative, alternatives united into groups and
groups intersected into rules. Candidates are verified by the regex itself over their whole text. Rules
that need no trigram (long hexadecimal runs) scan every text.

A match's place is found without a UDF: a text split at the matches gives the pieces between them, and
the lengths of pieces and matches add up to code-point offsets. The work on a text is in proportion to
its length and its matches.

Null texts are empty: counts of 0 and empty span lists. Documents are told apart by id and text's hash;
equal rows get equal results, a row each; null ids are kept. An empty table gives no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from re import _constants as sre  # the standard library's own parse of a regex
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.let import let
from .common import spread, stored


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds, in order and without overlap; a match counts if its group ``group`` has
    ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    trigrams: list = field(default=None, compare=False, hash=False)


ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: The three base kinds first; then formats that public providers document for their keys.
RULES = [
    Rule("assign", ASSIGN, 2, 6),
    # a run of less than 16 or 24 has no part that counts, so the bound can stand in the regex
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
]
BASE = ["assign", "access", "hex"]

#: Strings that are followed side by side while a regex is read.
EXACT = 32
#: Matches of a text whose places are added up in one go.
STRETCH = 256


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Groups, all of which a text with a match satisfies: one of a group's alternatives is held,
    with all its trigrams, in the lower-cased text. No groups: nothing is known."""
    groups: list[list[frozenset[str]]] = []
    strings = {""}

    def flush() -> None:
        nonlocal strings
        found = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if all(found):
            # an alternative that asks for more than another adds nothing
            groups.append(sorted((f for f in found if not any(g < f for g in found)), key=sorted))
        strings = {""}

    def alternatives(items) -> set[str] | None:
        """All strings the items can match, if they are few."""
        out = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                more = {chr(arg).lower()}
            elif op is sre.IN and all(o in (sre.LITERAL,) for o, _ in arg):
                more = {chr(a).lower() for _, a in arg}
            elif op is sre.SUBPATTERN:
                more = alternatives(arg[3])
            elif op is sre.BRANCH:
                parts = [alternatives(p) for p in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op is sre.MAX_REPEAT and arg[1] == 1:
                more = alternatives(arg[2])
                more = None if more is None else more | {""} if arg[0] == 0 else more
            else:
                more = None
            if more is None or len(out) * len(more) > EXACT:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(items) -> None:
        nonlocal strings
        for op, arg in items:
            more = alternatives([(op, arg)])
            if more is not None and len(strings) * len(more) <= EXACT:
                strings = {a + b for a in strings for b in more}
                continue
            flush()
            if more is not None:
                strings = more
            elif op is sre.SUBPATTERN:
                walk(arg[3])
                flush()
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
                flush()

    walk(_parser.parse(pattern))
    flush()
    return groups


def _key(df: DataFrame) -> DataFrame:
    """All columns as the struct ``row``, so that their names meet no others."""
    rows = df.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("_h", F.xxhash64("text"))


def postings(keyed: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``(trigram, doc_id, _h)`` for the trigrams of ``vocabulary`` that a text holds."""
    # a projection of its own: lower-cased once, not once a trigram
    low = keyed.select("doc_id", "_h", F.lower("text").alias("low"))
    held = [F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary]
    found = low.select("doc_id", "_h", F.array_compact(F.array(*held)).alias("trigrams"))
    return found.select(F.explode("trigrams").alias("trigram"), "doc_id", "_h")


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(doc_id, _h, rules)``: the kinds whose trigram query the document's postings satisfy."""
    spark = index.sparkSession
    terms = [
        (rule.kind, g, a, trigram, len(alternative), len(groups))
        for rule in rules
        if (groups := trigram_query(rule.pattern))
        for g, group in enumerate(groups)
        for a, alternative in enumerate(group)
        for trigram in sorted(alternative)
    ]
    kinds = "kind string, g int, a int, trigram string, n_trigrams int, n_groups int"
    # as many rows as the rules' trigrams
    asked = F.broadcast(spark.createDataFrame(terms, kinds))
    own = ["doc_id", "_h", "kind", "n_groups"]
    hit = index.distinct().join(asked, "trigram")
    held = hit.groupBy(*own, "g", "a", "n_trigrams").count().where("count = n_trigrams")
    held = held.groupBy(*own).agg(F.count_distinct("g").alias("n")).where("n = n_groups")
    return held.groupBy("doc_id", "_h").agg(F.collect_set("kind").alias("rules"))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For whole numbers of 0 or more, each joined (``+``, the greater) with all before it. Appending
    to an array copies it, so stretches of ``STRETCH`` are run on their own and then joined."""
    none = F.array().cast("array<int>")

    def scan(part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda s, x: let(
                join(s["at"], x),
                lambda at: F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out")),
            ),
        )

    def joined(parts: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), scan(F.transform(parts, lambda p: p["at"]))["out"])
        return F.flatten(
            F.zip_with(
                parts,
                F.slice(ends, F.lit(1), F.size(parts)),
                lambda p, before: F.transform(p["out"], lambda x: join(before, x)),
            )
        )

    def stretches(whole: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.size(whole) / STRETCH).cast("int"))
        return F.transform(numbers, lambda k: scan(F.slice(whole, k * STRETCH + 1, STRETCH)))

    return let(values, lambda whole: let(stretches(whole), joined))


def _matches(rule: Rule) -> Column:
    """The counting matches as structs of start and end (exclusive). Every array is made once a text
    and walked once: a function of an element that names a regex would run it at every match."""
    regex = F.lit(rule.pattern)
    zero = F.array().cast("array<struct<start:int,end:int>>")

    def placed(found: Column) -> Column:
        between = F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(between, found, lambda b, m: F.length(b) + F.length(m))
        ends = _running(steps, lambda a, b: a + b)
        out = F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end")))
        if rule.least > 1:
            lengths = F.regexp_extract_all("text", regex, F.lit(rule.group))
            counted = F.zip_with(out, lengths, lambda p, g: F.when(F.length(g) >= rule.least, p))
            out = F.array_compact(counted)
        return F.when(F.size(found) > 0, out).otherwise(zero)

    return let(F.regexp_extract_all("text", regex, F.lit(0)), placed)


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``(row, text, spans)``: all matches as structs of start, order of the rule, end, kind, by
    start and then rule; a row for each document, whose columns are in ``row``."""
    keyed = _key(spread(docs))
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    vocabulary = sorted({t for q in queries.values() for g in q for a in g for t in a})
    index = stored(postings(keyed, vocabulary), "trigram-postings")
    found = candidates(index, rules).withColumnRenamed("doc_id", "_id").withColumnRenamed("_h", "_g")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g"))
    rows = keyed.join(found, same, "left").drop("_id", "_g", "_h")
    kinds = "array<struct<start:int,rule:int,end:int,kind:string>>"
    spans = []
    for k, rule in enumerate(rules):
        number, kind = F.lit(k).alias("rule"), F.lit(rule.kind).alias("kind")
        matches = F.transform(
            _matches(rule),
            lambda m: F.struct(m["start"].alias("start"), number, m["end"].alias("end"), kind),  # noqa: B023
        )
        if queries[rule.kind]:
            listed = F.array_contains(F.coalesce("rules", F.array().cast("array<string>")), rule.kind)
            matches = F.when(listed, matches).otherwise(F.array().cast(kinds))
        spans.append(matches.cast(kinds))
    return rows.select("row", "text", F.array_sort(F.concat(*spans)).alias("spans"))


def _listed(spans: Column) -> Column:
    def one(s: Column) -> Column:
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.transform(spans, one), ",")


def secret_digest(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans."""
    rows = find_secrets(docs.select("doc_id", "text"), rules)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return rows.select(
        "row.doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


MASK = "[SECRET]"
#: Characters of the blocks from which the text between masks is cut.
BLOCK = 4096


def _masked(blocks: Column) -> Column:
    """The text, given as blocks of ``BLOCK`` characters, with the union of ``spans`` masked. A piece
    is cut from its own blocks: from the whole text it would cost the way to it."""

    def piece(start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        held = F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1)
        return F.array_join(held, "").substr(start - first * BLOCK + 1, end - start)

    def joined(reach: Column) -> Column:
        # spans come by start: one that begins before the end of an earlier one adds to its mask
        before = F.slice(F.concat(F.array(F.lit(0)), reach), F.lit(1), F.size("spans"))
        first = F.zip_with("spans", before, lambda s, r: s["start"] >= r)
        starts = F.zip_with("spans", first, lambda s, f: F.when(f, s["start"]))
        pieces = F.zip_with(starts, before, lambda s, r: F.when(s.isNotNull(), piece(r, s)))
        # null at the spans that add to an earlier mask: joining leaves these out
        head = F.array_join(F.transform(pieces, lambda p: F.concat(p, F.lit(MASK))), "")
        return F.concat(head, piece(F.element_at(reach, -1), F.length("text")))

    return let(_running(F.transform("spans", lambda s: s["end"]), F.greatest), joined)


def redacted(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by :data:`MASK`, overlapping ones by one; a
    null text stays null. All columns are kept; ``n_chars`` is counted anew where there is one."""
    found = find_secrets(docs, rules)
    masked = let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), _masked)
    changed = F.size("spans") > 0
    rows = found.withColumn("masked", F.when(changed, masked).otherwise(F.col("row.text")))
    out = []
    for c in docs.columns:
        column = F.col(f"row.`{c}`")
        if c == "text":
            column = F.col("masked")
        elif c == "n_chars":
            column = F.when(changed, F.length("masked")).otherwise(column).cast(docs.schema[c].dataType)
        out.append(column.alias(c))
    return rows.select(*out)

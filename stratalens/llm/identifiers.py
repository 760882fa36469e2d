"""Personal identifiers by bootstrapped contextual extraction.

Seeds are what fixed rules find: mail addresses, IPv4 addresses, payment cards, phone numbers. One pass
over the texts gives, besides the seeds, every other candidate (a word, or numbers in a row, that holds
a digit or an at sign) with the words around it. Patterns are contexts at four widths: two words before
and one behind, two before, one on each side, one before. Patterns and instances (distinct strings) form
a graph, which Spark scores in rounds:

* a pattern's score for a kind is the lower Wilson bound of the share of its distinct instances that are
  known to be of that kind, so it takes many and nearly pure instances;
* an instance's score for a kind whose shape it has is the chance that not all of its contexts are wrong,
  each context counting by the best of its patterns that reach the least score; unscored contexts say
  nothing. One that reaches the least score is known in the next round, wherever it occurs.

It ends when a round finds nothing new, after ``rounds`` at most. Instances are counted once a pattern,
so that copies of a document do not vouch for themselves, and instances are kept as hashes, so that no
personal data is written to scratch tables; the words around them are.

Null and empty texts have no spans. Rows are told apart by a number of their own, so repeated rows and
equal or null ids each get their result. A text is looked through in time linear in its length,
whatever it holds. Candidates have 4 to 64 characters; words around are taken from the 80 characters
on either side. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import spread, stored, texts_of

#: Kinds in the order in which spans at one place are listed.
KINDS = ["email", "ip", "card", "phone"]
#: Least score of a pattern, and of an instance.
LEAST = 0.8
ROUNDS = 4
#: 95 % of the normal distribution, for the Wilson bound.
Z = 1.96
SHORTEST, LONGEST, AROUND = 4, 64, 80

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACES = " \t\n\x0b\x0c\r"
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_NUMBER = re.compile(r"[0-9()./-]+")
_MORE = re.compile(r"(?:\x20[0-9()./-]*[0-9][0-9()./-]*)*+")
_FIELD = re.compile(r"[\"']?[A-Za-z_]{2,}[\"']?[:=][\"']?")

_EMAIL_SHAPE = re.compile(r"(?=.*[A-Za-z])[^@\s]+(?:@|\(at\)|\[at\])[^@\s]{2,}")
_IP_SHAPE = re.compile(
    r"[0-9]{1,3}(?:[.-][0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}"
)
_NUMBER_SHAPE = re.compile(r"[0-9(][0-9\x20()./-]*[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match has one at sign; it begins with the run of its characters before that, as far as the
    last match reaches not."""
    free = 0
    for found in _DOMAIN.finditer(text):
        start = found.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < found.start():
            free = found.end()
            yield start, free


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time out of each chain of numbers joined by dots."""
    for chain in _CHAIN.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[::-2])) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        digits = found.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(found.group())) <= 15:
            yield found.span()


def seeds(text: str) -> list[tuple[int, int, int]]:
    """The base rules' spans as (start, kind, end), in order."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        found += [(s, 1, e) for s, e in _addresses(text)]
        found += [(s, 2, e) for s, e in _cards(text)]
        if "+" in text:
            found += [(s, 3, e) for s, e in _phones(text)]
    return sorted(found)


def others(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Candidates that do not touch a seed."""
    at, next_seed, reach = 0, 0, -1
    while mark := _MARK.search(text, at):
        first = mark.start()
        start = max(at, max(text.rfind(c, at, first) for c in _SPACES) + 1)
        gap = _SPACE.search(text, first)
        end = whole = gap.start() if gap else len(text)
        field = _FIELD.match(text, start, min(end, start + LONGEST))
        if field and field.end() <= first:
            start = field.end()
        if end - start <= LONGEST and _NUMBER.fullmatch(text, start, end):
            end = whole = _MORE.match(text, end).end()
        while start < end and text[start] in "\"'<[{,;:":
            start += 1
        while start < end and (
            text[end - 1] in "\"'>]},;:.!?" or text[end - 1] == ")" and "(" not in text[start:end]
        ):
            end -= 1
        at = max(whole, at + 1)
        while next_seed < len(taken) and taken[next_seed][0] < end:
            reach = max(reach, taken[next_seed][2])
            next_seed += 1
        if reach <= start and SHORTEST <= end - start <= LONGEST:
            yield start, end


def shapes(found: str) -> int:
    """The kinds whose shape a candidate has, as bits."""
    bits = bool(_EMAIL_SHAPE.fullmatch(found)) | bool(_IP_SHAPE.fullmatch(found)) << 1
    if _NUMBER_SHAPE.fullmatch(found):
        digits = len(_DIGIT.findall(found))
        bits |= (12 <= digits <= 19) << 2 | (7 <= digits <= 15) << 3
    return int(bits)


def _words(piece: str) -> list[str]:
    return _DIGIT.sub("0", piece.lower()).split()


def around(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The two words before and the one behind; the ends of the text are words too."""
    before = _words(text[max(0, start - AROUND) : start])
    behind = _words(text[end : end + AROUND])
    second, first = ["^", "^", *before][-2:]
    return second, first, (behind or ["$"])[0]


def _hash(found: str) -> int:
    name = hashlib.blake2b(found.lower().encode("utf-8", "surrogatepass"), digest_size=8)
    return int.from_bytes(name.digest(), "little", signed=True)


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_SEEN = pa.struct(
    [
        *((c, pa.int32()) for c in ("start", "end", "kind", "fits")),
        ("instance", pa.int64()),
        *((c, pa.string()) for c in ("second", "first", "behind")),
    ]
)


def scan(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, base, seen)``, written: each document's seeds, and all seeds and candidates with
    the words around them (``kind`` -1: no seed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, seen = [], []
            for text in texts_of(batch.column(1)):
                spans = seeds(text)
                base.append(spans)
                found = [(s, e, k) for s, k, e in spans]
                found += [(s, e, -1) for s, e in others(text, spans)]
                seen.append([_instance(text, *f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[dict(zip(("start", "kind", "end"), s)) for s in b] for b in base],
                             pa.list_(_SPAN)),
                    pa.array(seen, pa.list_(_SEEN)),
                ],
                ["doc_id", "base", "seen"],
            )

    kinds = "doc_id long, base array<struct<start:int,kind:int,end:int>>, seen array<struct<start:int,"
    kinds += "end:int,kind:int,fits:int,instance:long,second:string,first:string,behind:string>>"
    rows = spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, kinds)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "identifiers")


def _instance(text: str, start: int, end: int, kind: int) -> dict:
    found = text[start:end]
    second, first, behind = around(text, start, end)
    return {
        "start": start, "end": end, "kind": kind, "fits": shapes(found) if kind < 0 else 0,
        "instance": _hash(found), "second": second, "first": first, "behind": behind,
    }


def _forms() -> Column:
    """The patterns that a context belongs to."""
    slot = F.lit("_")
    return F.array(
        F.concat_ws(" ", "second", "first", slot, "behind"),
        F.concat_ws(" ", "second", "first", slot),
        F.concat_ws(" ", "first", slot, "behind"),
        F.concat_ws(" ", "first", slot),
    )


def _wilson(good: Column, n: Column) -> Column:
    share, z = good / n, Z * Z / n
    root = F.sqrt(share * (1 - share) / n + z / (4 * n))
    return (share + z / 2 - Z * root) / (1 + z)


def context_graph(scanned: DataFrame) -> DataFrame:
    """The distinct ``(second, first, behind, instance, kind, fits)``, written: contexts and what stands
    in them."""
    seen = scanned.select(F.explode("seen").alias("s")).select("s.*")
    own = ["second", "first", "behind", "instance", "kind", "fits"]
    return stored(seen.select(*own).distinct(), "identifier-contexts")


def score_patterns(edges: DataFrame, known: DataFrame | None) -> DataFrame:
    """``(pattern, kind, score, n)`` of patterns that reach the least score, ``edges`` being the
    distinct ``(pattern, instance, kind)``."""
    kind = F.col("kind")
    if known is not None:
        edges = edges.join(known.withColumnRenamed("kind", "found"), "instance", "left")
        kind = F.when(kind < 0, F.coalesce("found", kind)).otherwise(kind)
    edges = edges.select("pattern", kind.alias("kind"))
    counts = edges.groupBy("pattern").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(4)]
    )
    most = F.greatest(*[F.col(f"n{k}") for k in range(4)])
    best = F.coalesce(*[F.when(F.col(f"n{k}") == most, F.lit(k)) for k in range(4)])
    scored = counts.where(most > 0).select(
        "pattern", best.alias("kind"), _wilson(most, F.col("n")).alias("score"), "n"
    )
    return scored.where(F.col("score") >= LEAST)


def score_instances(graph: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(instance, kind, score)`` of candidates that reach the least score for a kind they may be."""
    free = graph.where("kind < 0 and fits > 0")
    own = ["second", "first", "behind", "instance", "fits"]
    met = free.select(*own, F.explode(_forms()).alias("pattern")).join(
        patterns.select("pattern", "kind", "score"), "pattern"
    )
    met = met.where(F.bit_get("fits", F.col("kind")) == 1)
    best = met.groupBy("instance", "second", "first", "behind", "kind").agg(
        F.max("score").alias("score")
    )
    wrong = F.exp(F.sum(F.log1p(-F.col("score"))))
    scored = best.groupBy("instance", "kind").agg((1 - wrong).alias("score"))
    scored = scored.where(F.col("score") >= LEAST).groupBy("instance")
    first = F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")
    return scored.agg(first, F.max("score").alias("score"))


def bootstrap(graph: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The patterns and the instances found by them, after the last round."""
    edges = graph.select("instance", "kind", F.explode(_forms()).alias("pattern"))
    edges = stored(edges.distinct(), "identifier-edges")
    patterns, known, size = None, None, 0
    for _ in range(rounds):
        patterns = stored(score_patterns(edges, known), "identifier-patterns")
        found = stored(score_instances(graph, broadcast_if_small(patterns)), "identifiers-found")
        known = broadcast_if_small(found.select("instance", "kind"))
        more = found.count()
        if more == size:
            break
        size = more
    return patterns, found


def find_identifiers(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, base, spans)``, a row a document: the base rules' spans and all spans, as structs of
    start, kind (its place in :data:`KINDS`) and end, by start and kind."""
    scanned = scan(docs)
    _, found = bootstrap(context_graph(scanned), rounds)
    seen = scanned.select("row", F.explode("seen").alias("s")).select("row", "s.*").where("kind < 0")
    named = broadcast_if_small(found.select("instance", F.col("kind").alias("named")))
    met = seen.join(named, "instance").select(
        "row", F.struct("start", F.col("named").alias("kind"), "end").alias("span")
    )
    added = met.groupBy("row").agg(F.collect_list("span").alias("added"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = F.array_sort(F.concat("base", F.coalesce("added", none)))
    return scanned.join(added, "row", "left").select("doc_id", "base", spans.alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])

    def one(s: Column) -> Column:
        kind = F.get(names, s["kind"])
        return F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.transform(spans, one), ",")


def identifier_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base rules' spans by kind, their hash, and all spans."""
    found = find_identifiers(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )

"""Removal of word sequences that an earlier document holds: seed and extend on winnowed anchors.

Of the word n-grams inside each window of ``WINDOW`` words the one with the least hash is the window's
anchor. The choice depends on the window's words alone, so equal windows have equal anchors, and a run
of neighbouring windows shares one. A run is a seed: its anchor, the hash of all words its windows
span, its document and place. That is one row for about five windows.

1. Anchors that only one document holds are dropped (partial aggregate, no group is gathered).
2. The seeds left are joined on anchors and extended both ways over the run's whole span at once: seeds
   with equal spans agree in all their windows. One representative for each span, that of the smallest
   id, stands for all of them.
3. Where an anchor has several spans, the representatives are extended word by word: each of their
   windows is compared with those of the other spans. This happens once a span, not once a pair or
   document, so a passage in a third of all documents makes no product.
4. A window is a repeat if a document with a smaller id holds it. Neighbouring repeats are united to
   maximal runs, at least ``WINDOW`` words long, whose words are removed.

Spans and windows are compared by an anchor's 64 bits and 64 independent bits over digests of their
words.

Null texts have no words. Documents without id come last: they lose what others hold, and take nothing
from others. Rows that share an id are judged each for itself and take nothing from one another. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, spans, spread, stored, texts_of, words

WINDOW = 13
GRAM = 5
LAST = (1 << 63) - 1
U = np.uint64
#: Odd multipliers of the rolling hashes and of the final mix.
BASES = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
MIXERS = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bytes of the longest word that is digested together with others.
LONG = 64
#: Bytes of the texts that are worked on together.
GROUP_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIXERS[0]
    x = (x ^ (x >> U(27))) * MIXERS[1]
    return x ^ (x >> U(31))


def word_places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 texts, one from each of ``bounds`` to the next: where each word starts and ends in
    ``data``, and how many words each text has."""
    gap = np.zeros(256, bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~gap[data]
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    # a text ends its last word, whatever the next text begins with
    cut = bounds[1:-1][inside[bounds[1:-1]] & inside[bounds[1:-1] + 1]]
    begins[cut] = ends[cut] = True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends), np.diff(np.searchsorted(starts, bounds))


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two independent 64-bit digests of each word: mixed from eight bytes at a time, those of words
    over ``LONG`` bytes by Blake2."""
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out = [mix(size.astype(np.uint64) + base) for base in BASES]
    own = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        own = own[size[own] > k]
        part = eight[starts[own] + k] & masks[np.minimum(size[own] - k, 8)]
        for values, base in zip(out, BASES):
            values[own] = mix((values[own] ^ part) * base)
    hashes = np.stack(out, 1)
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        hashes[i] = np.frombuffer(digest, "<u8")
    return hashes


class Rolling:
    """Hashes of any word ranges, by sums over powers of an odd base modulo 2^64."""

    def __init__(self, values: np.ndarray, base: np.uint64):
        n = len(values) + 1
        self.back = np.cumprod(np.full(n, U(pow(int(base), -1, 1 << 64)))) * base
        powers = np.cumprod(np.full(n, base))[:-1]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers)))

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        width = (end - first).astype(np.uint64)
        return mix((self.sums[end] - self.sums[first]) * self.back[first] + width)


def seeds(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts whose word digests follow one another: each run's text, first window (place in the text),
    number of windows, anchor and span hash."""
    n = len(hashes)
    owner = np.repeat(np.arange(len(counts)), counts)
    first_word = np.cumsum(counts) - counts
    windows = np.flatnonzero(owner[: max(0, n - WINDOW + 1)] == owner[WINDOW - 1 :])
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    grams_at = Rolling(hashes[:, 0], BASES[0])
    places = np.arange(n - GRAM + 1)
    gram = grams_at(places, places + GRAM)
    best, anchor = gram[windows], windows.copy()
    for k in range(1, WINDOW - GRAM + 1):
        other = gram[windows + k]
        less = other < best
        best = np.where(less, other, best)
        anchor[less] = windows[less] + k
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
    starts = np.flatnonzero(new)
    number = np.diff(np.append(starts, len(windows)))
    first = windows[starts]
    span = Rolling(hashes[:, 1], BASES[1])(first, first + number + WINDOW - 1)
    # the anchor's place in the span is part of what makes spans equal
    span = mix(span + (anchor[starts] - first).astype(np.uint64))
    text = owner[first]
    return text, first - first_word[text], number, best[starts].view(np.int64), span.view(np.int64)


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    """``doc`` orders, ``salt`` tells rows with one id apart: 128 bits of their text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.unhex(F.md5(text)).alias("salt"),
        text.alias("text"),
        *more,
    )


def _hashed(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of consecutive texts (none of them null) with their word digests and word counts."""
    if not len(texts):
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize)
    bounds = bounds.astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(bounds, bounds[first] + GROUP_BYTES, "right"))
        end = max(first + 1, min(end - 1, len(texts)))
        own = data[bounds[first] : bounds[end]]
        starts, ends, counts = word_places(own, bounds[first : end + 1] - bounds[first])
        yield first, end, word_digests(own, starts, ends), counts
        first = end


def _seed_rows(docs: DataFrame, whole: bool) -> DataFrame:
    """``anchor, doc``, or also the span's hash, ``at`` (place and number of windows) and salt."""
    kinds = {n: pa.int64() for n in ("anchor", "doc", "span", "at")} | {"salt": pa.binary()}
    schema = pa.schema(list(kinds.items())[: 5 if whole else 2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, salt = np.asarray(batch.column(0)), batch.column(1)
            for first, _, hashes, counts in _hashed(batch.column(2)):
                text, place, number, anchor, span = seeds(hashes, counts)
                own = first + text
                columns = [anchor, doc[own]]
                if whole:
                    columns += [span, place << 32 | number, salt.take(pa.array(own))]
                yield batch_of(schema, *columns)

    longs = "anchor long, doc long"
    return _rows(docs).mapInArrow(run, f"{longs}, span long, at long, salt binary" if whole else longs)


def _windows(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Single windows ``anchor, window, span, doc, bit`` of the asked seeds."""
    names = ["anchor", "window", "span", "doc", "bit"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    lists = asked.groupBy("doc", "salt").agg(
        F.collect_list("anchor").alias("anchors"),
        F.collect_list("span").alias("spans"),
        F.collect_list("at").alias("ats"),
    )
    rows = _rows(docs).join(lists, ["doc", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            doc = np.asarray(column["doc"])
            lengths = np.asarray(pa.compute.list_value_length(column["ats"])).astype(np.int64)
            ends = np.cumsum(lengths)
            flat = {n: np.asarray(column[n].flatten()) for n in ("anchors", "spans", "ats")}
            for first, end, hashes, counts in _hashed(column["text"]):
                own = slice(int(ends[first] - lengths[first]), int(ends[end - 1]))
                text = np.repeat(np.arange(end - first), lengths[first:end])
                at, anchor, span = (flat[n][own] for n in ("ats", "anchors", "spans"))
                number, start = at & 0xFF, (np.cumsum(counts) - counts)[text] + (at >> 32)
                place = spans(start, number)
                seed = np.repeat(np.arange(len(at)), number)
                window = Rolling(hashes[:, 1], BASES[1])(place, place + WINDOW)
                bit = np.left_shift(1, place - start[seed])
                yield batch_of(
                    schema,
                    anchor[seed],
                    window.view(np.int64),
                    span[seed],
                    doc[first + text[seed]],
                    bit,
                )

    columns = ["doc", "text", "anchors", "spans", "ats"]
    return rows.select(*columns).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``doc, salt, place, mask``: of the windows from ``place`` on, those whose bits are set in
    ``mask`` are repeats of a document with a smaller id."""
    shared = _seed_rows(docs, whole=False).groupBy("anchor")
    shared = shared.agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    shared = stored(shared.where("low < high").select("anchor"), "shared-anchors")
    found = stored(_seed_rows(docs, whole=True).join(shared, "anchor"), "shared-seeds")

    first = found.groupBy("anchor", "span").agg(F.min(F.struct("doc", "at", "salt")).alias("first"))
    first = stored(first.select("anchor", "span", "first.doc", "first.at", "first.salt"), "spans")
    several = first.groupBy("anchor").count().where("count > 1").select("anchor")
    windows = stored(_windows(docs, first.join(several, "anchor")), "windows")
    least = windows.groupBy("anchor", "window").agg(F.min("doc").alias("least"))
    masks = windows.join(least, ["anchor", "window"]).where("least < doc")
    masks = masks.groupBy("anchor", "span").agg(F.bit_or("bit").alias("mask"))

    judged = first.select("anchor", "span", F.col("doc").alias("least"))
    judged = stored(judged.join(masks, ["anchor", "span"], "left"), "judged-spans")
    mask = F.when(F.col("doc") > F.col("least"), F.expr("shiftleft(1L, cast(at & 255 AS int)) - 1"))
    return (
        found.join(judged, ["anchor", "span"])
        .withColumn("mask", F.coalesce(mask, "mask", F.lit(0)))
        .where("mask <> 0")
        .select(
            "doc",
            "salt",
            F.expr("cast(shiftright(at, 32) AS int)").alias("place"),
            F.col("mask").cast("int").alias("mask"),
        )
    )


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def without_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """What is left of each document; ``keep_text`` adds the kept words, joined by spaces."""
    docs = spread(docs.select("doc_id", "text"))
    marks = stored(repeated_windows(docs), "repeats").groupBy("doc", "salt")
    # a set: rows that share id and text have the same marks
    marks = marks.agg(F.collect_set(F.struct("place", "mask")).alias("marks"))
    rows = _rows(docs).withColumn("known", F.col("doc") != LAST).join(marks, ["doc", "salt"], "left")
    kinds = [(n, pa.int64()) for n in ("doc_id", "n_words", "n_removed")]
    schema = pa.schema([*kinds, ("kept_sha256", pa.string())] + [("text", pa.string())] * keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            doc = column["doc"].to_pylist()
            known = column["known"].to_pylist()
            out: list[tuple] = []
            for i, text in enumerate(texts_of(column["text"])):
                found = words(text)
                removed = 0
                if (own := column["marks"][i].values) is not None:
                    place, mask = np.asarray(own.field("place")), np.asarray(own.field("mask"))
                    run = np.arange(WINDOW - GRAM + 1)
                    at = (place[:, None] + run)[mask[:, None] >> run & 1 == 1]
                    n = len(found) + 1
                    change = np.bincount(at, minlength=n) - np.bincount(at + WINDOW, minlength=n)
                    keep = np.cumsum(change)[:-1] == 0
                    removed = len(found) - int(keep.sum())
                    found = [found[j] for j in np.flatnonzero(keep).tolist()]
                left = " ".join(found)
                sha = hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest()
                row = (doc[i] if known[i] else None, len(found) + removed, removed, sha)
                out.append(row + (left,) * keep_text)
            yield batch_of(schema, *(list(c) for c in zip(*out)) if out else [[]] * len(schema))

    columns = ["doc", "known", "text", "marks"]
    return rows.select(*columns).mapInArrow(run, KEPT + (", text string" if keep_text else ""))

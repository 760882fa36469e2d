"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are binned measures of the line and of its two neighbours
(length, words, case, digits, symbols, repeated words, repeated lines); a transition weight ties each line
to the next. A document's quality is the mean of its lines' forward-backward marginals, weighted by
their lengths, put on a probability scale by a logistic curve.

The field is fitted on the driver by Adam over at most ``TRAIN_DOCS`` labelled documents, those with
the least hashes of their ids among the rows whose crc32(doc_id) mod 3 is not 1. Of rows that share an id
the different texts count, of all of them the ``TRAIN_DOCS`` with the least hashes of id and text, but for
those that would take the sample above ``TRAIN_LINES`` lines. Every line takes its document's label. The line measures of that sample are made in tasks, from whole texts. Scoring is one
pass without a shuffle. Labels, language, source and id are no inputs of a score.

A null or empty text is one empty line. Ties of hashes go by id; a
document with several labels counts as good if one says so; null labels are left out. Repeated rows get
equal scores, a row each. A null id is never held out. Without any label all scores are 0.5. Other columns
are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, groups_of, spread, texts_of, worker_state

TRAIN_DOCS = 6000
TRAIN_LINES = 400_000
STEPS = 120
RATE = 0.1
PENALTY = 1e-4
#: Shares of the sample's lines that a measure's bins end at, finer where junk lies.
SHARES = (
    0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.2, 0.35, 0.5,
    0.65, 0.8, 0.9, 0.93, 0.96, 0.98, 0.99, 0.995,
)
BINS = len(SHARES) + 1
MEASURES = (
    "chars words word_length upper digits marks symbols distinct_words sentence_ends repeated_line"
).split()
SYMBOLS = "#*$%&|<>!~^_={}[]\\"
#: Bits of a character's classes.
SPACE, UPPER, LETTER, DIGIT, MARK, SYMBOL, END = (1 << k for k in range(7))


def _classes() -> np.ndarray:
    out = np.zeros(0x3000, np.uint8)
    for code in range(len(out)):
        c = chr(code)
        kind = unicodedata.category(c)
        out[code] = (
            SPACE * c.isspace()
            + UPPER * (kind == "Lu")
            + LETTER * (kind[0] == "L")
            + DIGIT * (kind == "Nd")
            + MARK * (kind[0] in "PS")
            + SYMBOL * (c in SYMBOLS)
            + END * (c in ".?!")
        )
    return out


def line_measures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines of the texts in order, each line's length, each text's line count."""
    classes = worker_state("character classes", _classes)
    counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
    codes = np.frombuffer(
        ("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4"
    )
    breaks = np.flatnonzero(codes == 10)
    starts = np.concatenate(([0], breaks[:-1] + 1))
    chars = breaks - starts
    kind = np.full(len(codes), LETTER, np.uint8)
    low = codes < len(classes)
    kind[low] = classes[codes[low]]
    totals = {
        bit: np.add.reduceat((kind & bit > 0).astype(np.int32), starts).astype(float)
        for bit in (UPPER, LETTER, DIGIT, MARK, SYMBOL, END)
    }
    # words: starts follow white space; their hashes are sums over powers of an odd number
    space = kind & SPACE > 0
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    base = np.uint64(0x9E3779B97F4A7C15)
    width = end - first
    place = np.arange(len(codes), dtype=np.uint64)
    inside = ~space
    begin = np.repeat(first, width).astype(np.uint64)
    power = np.cumprod(np.full(int(width.max(initial=0)) + 1, base))
    term = codes[inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    term = (term ^ (term >> np.uint64(29))) * power[(place[inside] - begin).astype(np.int64)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term)))
    ends = np.cumsum(width)
    word = sums[ends] - sums[ends - width]
    line = np.searchsorted(breaks, first)
    n_lines = len(chars)
    n_words = np.bincount(line, minlength=n_lines).astype(float)
    order = np.lexsort((word, line))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=n_lines).astype(float)
    # lines with words that their text holds twice
    value = np.zeros(n_lines, np.uint64)
    nth = np.arange(len(word)) - (np.cumsum(n_words) - n_words).astype(np.int64)[line]
    np.add.at(value, line, word * (2 * nth + 1).astype(np.uint64))
    text = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((value, text))
    same = (value[order][1:] == value[order][:-1]) & (text[order][1:] == text[order][:-1])
    repeated = np.zeros(n_lines)
    repeated[order[1:][same]] = 1
    repeated[order[:-1][same]] = 1
    repeated[n_words == 0] = 0

    some, letters = np.maximum(chars, 1), np.maximum(totals[LETTER], 1)
    per_word = np.maximum(n_words, 1)
    columns = [
        np.log1p(chars),
        np.log1p(n_words),
        np.bincount(line, width, n_lines) / per_word,
        totals[UPPER] / letters,
        totals[DIGIT] / some,
        totals[MARK] / some,
        totals[SYMBOL] / some,
        distinct / per_word,
        totals[END] / per_word,
        repeated,
    ]
    return np.stack(columns, 1).astype(np.float32), chars, counts


@dataclass
class Field:
    """``cuts`` bin the measures; ``weight`` has a row of bins for each measure of the line, the line
    before and the line after; ``link`` are the transition scores; ``slope`` and ``shift`` put the
    weighted marginals on a probability scale."""

    cuts: list
    weight: np.ndarray
    bias: float
    link: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def cells(self, measures: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The active feature of each measure and neighbour of each line."""
        n, own = len(measures), np.zeros(measures.shape, np.int64)
        for m, cut in enumerate(self.cuts):
            own[:, m] = np.searchsorted(cut, measures[:, m], side="right")
        last = np.cumsum(counts) - 1
        before, after = np.full_like(own, BINS + 1), np.full_like(own, BINS + 1)
        before[1:], after[:-1] = own[:-1], own[1:]
        before[last - counts + 1] = BINS + 1
        after[last] = BINS + 1
        every = np.concatenate((own, before, after), 1)
        return every + np.arange(every.shape[1]) * (BINS + 2) if n else every

    def marginals(self, cells: np.ndarray, counts: np.ndarray):
        """P(good) of each line, the expected transitions and the log of the normalisers."""
        score = self.weight.ravel()[cells].sum(1) + self.bias
        return forward_backward(score, counts, self.link)


def forward_backward(score: np.ndarray, counts: np.ndarray, link: np.ndarray):
    """Chains of ``counts`` lines. ``score`` is a line's score of good over bad."""
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    size, steps = counts[order], int(counts.max(initial=0))
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    move = np.exp(link)
    emit = np.stack([np.zeros(len(score)), np.clip(score, -30, 30)], 1)
    high = emit.max(1)
    emit = np.exp(emit - high[:, None])
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    log_z = high.sum()
    for t in range(steps):
        at = first[: active[t]] + t
        now = emit[at] * (alpha[at - 1] @ move if t else 1.0)
        total = now.sum(1, keepdims=True)
        log_z += np.log(total).sum()
        alpha[at] = now / total
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = first[: active[t + 1]] + t
        ahead = emit[at + 1] * beta[at + 1]
        back = ahead @ move.T
        pair = alpha[at][:, :, None] * move * ahead[:, None, :]
        pairs += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        beta[at] = back / back.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), pairs, log_z


def weighted(good: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(counts)), counts)
    weight = np.maximum(chars, 1)
    return np.bincount(text, good * weight, len(counts)) / np.bincount(text, weight, len(counts))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, 0.0, 0.0

    def step(self, gradient):
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (
            np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8
        )


def fit(measures: np.ndarray, chars: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum conditional likelihood of the line labels, then the curve on the documents'."""
    cuts = []
    for m in range(measures.shape[1]):
        cut = np.unique(np.quantile(measures[:, m], SHARES))
        cuts.append(cut)
    width = 3 * measures.shape[1] * (BINS + 2)
    field = Field(cuts, np.zeros(width), 0.0, np.zeros((2, 2)))
    cells = field.cells(measures, counts)
    truth = np.repeat(labels, counts).astype(float)
    good = np.bincount(labels, counts - 1.0, 2)
    seen = np.array([[good[0], 0.0], [0.0, good[1]]])
    optimiser, n = _Adam(RATE), len(truth)
    for _ in range(STEPS):
        p, pairs, _ = field.marginals(cells, counts)
        miss = truth - p
        step = np.bincount(cells.ravel(), np.repeat(miss, cells.shape[1]), width) / n
        gradient = np.concatenate((step, [miss.mean()], ((seen - pairs) / n).ravel()))
        flat = np.concatenate((field.weight, [field.bias], field.link.ravel()))
        flat = flat + optimiser.step(gradient - PENALTY * flat)
        field.weight, field.bias, field.link = flat[:width], float(flat[width]), flat[-4:].reshape(2, 2)
    x = logit(weighted(field.marginals(cells, counts)[0], chars, counts))
    curve, optimiser = np.array([1.0, 0.0]), _Adam(0.05)
    for _ in range(400):
        miss = labels - 1 / (1 + np.exp(-(curve[0] * x + curve[1])))
        pull = np.array([(miss * x).mean(), miss.mean()])
        curve = curve + optimiser.step(pull - np.array([1e-3 * (curve[0] - 1), 0.0]))
    field.slope, field.shift = max(float(curve[0]), 1e-3), float(curve[1])
    return field


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES
) -> Field | None:
    """A field from at most ``train_docs`` labelled documents that are not held out, with at most
    ``train_lines`` lines together."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(train_docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # a bounded number of ids, any number of rows
    rows = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).withColumn("_h", F.xxhash64("text"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    texts = rows.groupBy("_id", "_h").agg(F.max(lines).alias("lines"))
    texts = texts.orderBy(F.xxhash64("_id", "_h"), "_id", "_h").limit(train_docs)
    chosen, left = [], train_lines
    for r in texts.collect():
        if r["lines"] <= left:
            chosen.append((r["_id"], r["_h"]))
            left -= r["lines"]
    if not chosen:
        return None
    chosen = docs.sparkSession.createDataFrame(chosen, rows.select("_id", "_h").schema)
    rows = rows.join(F.broadcast(chosen), ["_id", "_h"]).dropDuplicates(["_id", "_h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = texts_of(batch.column(1)), batch.column(2).to_pylist()
            for first, end in groups_of(texts):
                measures, chars, counts = line_measures(texts[first:end])
                cut = np.cumsum(counts)[:-1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(first, end - first),
                        "label": pa.array(labels[first:end], pa.int32()),
                        "measures": [x.tobytes() for x in np.split(measures, cut)],
                        "chars": [x.tobytes() for x in np.split(chars.astype(np.int64), cut)],
                    }
                )

    kinds = "doc_id long, label int, measures binary, chars binary"
    rows = rows.select(F.col("doc_id").cast("long"), "text", F.col("_label").cast("int"))
    got = sorted(rows.mapInArrow(run, kinds).collect(), key=lambda r: (r[0], bytes(r[2])))
    if not got:
        return None
    measures = [np.frombuffer(r[2], np.float32).reshape(-1, len(MEASURES)) for r in got]
    chars = np.concatenate([np.frombuffer(r[3], np.int64) for r in got])
    counts = np.array([len(m) for m in measures], np.int64)
    return fit(np.concatenate(measures), chars, counts, np.array([r[1] for r in got], np.int64))


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with ``score``, all columns kept. Names that clash are written over."""
    names = [c for c in docs.columns if c != "score"]
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(text_at))
            out = np.full(len(texts), 0.5)
            for first, end in groups_of(texts) if field else ():
                measures, chars, counts = line_measures(texts[first:end])
                good, _, _ = field.marginals(field.cells(measures, counts), counts)
                x = logit(weighted(good, chars, counts))
                out[first:end] = 1 / (1 + np.exp(-(field.slope * x + field.shift)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out)], [*batch.schema.names, "score"]
            )

    rows = docs.select(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return spread(rows).mapInArrow(run, f"{kinds}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    field = train(docs, labels)
    rows = score(docs.select(F.col("doc_id").cast("long"), "text"), field)
    # only the id and the score leave the tasks' rows
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return rows.select("doc_id", held_out().alias("held_out"), "score", predicted)


def accepted(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with a score of 0.5 or more, with all columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # the struct keeps a column of the name score apart
    rows = score(docs.select("text", row), field).where("score >= 0.5")
    return rows.select("row.*")

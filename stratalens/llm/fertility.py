"""Quality rules on word counts and on how well public vocabularies fit a text.

Fertility: characters per token under each vocabulary, the share of byte-fallback tokens and the
entropy of the tokens. A text's entropy grows with its length, so what is judged is the mean entropy of
stretches of ``BLOCK`` tokens. Which values are odd depends on the language, so the rejection bands are
fitted per language over the whole table, from the texts that pass the base rules: ``WIDTH`` deviations
on both sides of a centre. Centre and deviation are the median and the median distance from it, in
which a source weighs as the root of its number of texts, so that a hot one does not set them. They are
taken from mergeable sketches by source. A language is judged by its own texts at any number of them:
there are least deviations, and few texts or a short one widen the band by degrees.

The base rules fail a text of less than 50 words, or with more than half of its words in three-word
windows that occur twice or more in it.

Null and empty texts have no words and fail. A null language is a group of its own, "und". Repeated
rows are judged each for itself, with equal results. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, groups_of, spans, spread, stored, texts_of, words
from .vocabulary import chunk_table

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Tokens to a stretch; a text that passes the base rules has as many.
BLOCK = MIN_WORDS
WIDTH = 4.5
#: A text of fewer tokens has a band wider by the root of the ratio.
FULL_TOKENS = 500
#: A language with this many texts has a band twice as wide as one with very many.
FEW = 8
#: Of a source's texts, the quantiles that stand for it.
QUANTILES = [q / 40 for q in range(1, 40, 2)]
SYMBOLS = "#*$%&|<>"
MEASURES = ["word_chars_per_token", "piece_chars_per_token", "byte_share", "entropy", "block_entropy"]
#: Judged measure -> its least deviation, as a share of the centre and absolute. Those of the ratios and
#: of entropy are about the least of the four languages of the test data.
LEAST = {
    "word_chars_per_token": (0.016, 0.0),
    "piece_chars_per_token": (0.016, 0.0),
    "byte_share": (0.0, 0.01),
    "block_entropy": (0.009, 0.0),
}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURED = (
    "doc_id long, language string, source string, "
    + ", ".join(f"{n} long" for n in COUNTS)
    + ", n_tokens long, "
    + ", ".join(f"{n} double" for n in MEASURES)
)


def repeated_words(numbers: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """For each text, its words in windows of three that it holds twice or more. ``numbers`` are the
    words of all texts in order, equal only for equal words; ``owner`` is each word's text."""
    out = np.zeros(n_texts, np.int64)
    if len(numbers) < 4:
        return out
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    _, dense = np.unique(numbers, return_inverse=True)
    base = int(dense.max()) + 1
    if base < 1 << 21:
        window = (dense[inside] * base + dense[inside + 1]) * base + dense[inside + 2]
    else:
        triples = np.stack([dense[inside], dense[inside + 1], dense[inside + 2]])
        _, window = np.unique(triples, axis=1, return_inverse=True)
    order = np.lexsort((window, owner[inside]))
    same = (window[order][1:] == window[order][:-1]) & (
        owner[inside][order][1:] == owner[inside][order][:-1]
    )
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = inside[order[twice]]
    covered = np.zeros(len(numbers), bool)
    for k in range(3):
        covered[at + k] = True
    return out + np.bincount(owner[covered], minlength=n_texts)


def measure(docs: DataFrame, word_file: str, piece_file: str) -> DataFrame:
    """The counts and the tokenisers' measures of every whole text, in one pass."""
    kinds = [pa.int64(), pa.string(), pa.string()]
    kinds += [pa.int64()] * (len(COUNTS) + 1) + [pa.float64()] * len(MEASURES)
    schema = pa.schema(list(zip([c.split()[0] for c in MEASURED.split(", ")], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(word_file, piece_file)
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        is_byte = np.array([model.is_byte(i) for i in range(model.vocab_size())])
        for batch in batches:
            texts = texts_of(batch.column(1))
            for first, end in groups_of(texts):
                part = texts[first:end]
                yield batch_of(
                    schema,
                    batch.column(0).slice(first, end - first),
                    batch.column(2).slice(first, end - first),
                    batch.column(3).slice(first, end - first),
                    *_measured(part, table, is_byte),
                )

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"), "text", lang.alias("language"), source.alias("source")
    )
    return spread(rows).mapInArrow(run, MEASURED)


def block_entropy(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean entropy of each text's stretches of ``BLOCK`` tokens, the last of which ends with the
    text; 0 for a shorter text. ``ids`` are the tokens of all texts in order."""
    texts = np.flatnonzero(counts >= BLOCK)
    number = -(-counts[texts] // BLOCK)
    text = np.repeat(texts, number)
    nth = spans(np.zeros(len(number), np.int64), number)
    place = (np.cumsum(counts) - counts)[text] + np.minimum(nth * BLOCK, counts[text] - BLOCK)
    blocks = np.sort(ids[place[:, None] + np.arange(BLOCK)], axis=1)
    new = np.ones(blocks.shape, bool)
    new[:, 1:] = blocks[:, 1:] != blocks[:, :-1]
    starts = np.flatnonzero(new)
    share = np.diff(np.append(starts, new.size)) / BLOCK
    sums = np.bincount(text[starts // BLOCK], -(share * np.log2(share)), len(counts))
    return sums / np.maximum(1, np.bincount(text, minlength=len(counts)))


def _measured(texts: list[str], table, is_byte: np.ndarray) -> list[np.ndarray]:
    table.trim()
    found = [words(t) for t in texts]
    n_words = np.fromiter(map(len, found), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), n_words)
    numbers = table.numbers([w for f in found for w in f])
    chars = np.fromiter((sum(map(len, f)) for f in found), np.int64, len(texts))
    symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
    duplicates = []
    for text in texts:
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        duplicates.append(len(lines) - len(set(lines)))
    repeats = repeated_words(numbers, owner, len(texts))

    word_ids, word_sizes = table.ids(numbers, 0)
    piece_ids, piece_sizes = table.ids(numbers, 1)
    n_tokens = np.bincount(owner, word_sizes, len(texts)).astype(np.int64)
    n_pieces = np.bincount(owner, piece_sizes, len(texts))
    n_bytes = np.bincount(np.repeat(owner, piece_sizes), is_byte[piece_ids], len(texts))
    entropy = np.zeros(len(texts))
    cuts = np.cumsum(n_tokens)
    for i, (a, b) in enumerate(zip((cuts - n_tokens).tolist(), cuts.tolist())):
        if b > a:
            ids = np.sort(word_ids[a:b])
            runs = np.diff(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))))
            share = runs / (b - a)
            entropy[i] = -(share * np.log2(share)).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratios = [
            np.where(n > 0, chars / n, 0.0) for n in (n_tokens.astype(float), n_pieces)
        ]
        share = np.where(n_pieces > 0, n_bytes / n_pieces, 0.0)
    even = block_entropy(word_ids, n_tokens)
    return [n_words, chars, symbols, duplicates, repeats, n_tokens, *ratios, share, entropy, even]


def _medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``language, n`` and the columns' medians per language, a source weighing as the root of its
    number of rows."""
    sketched = [F.percentile_approx(c, QUANTILES, 1000).alias(c) for c in columns]
    sources = rows.groupBy("language", "source").agg(F.count("*").alias("n"), *sketched)
    each = sources.select("language", "n", F.posexplode(F.arrays_zip(*columns)).alias("nth", "q"))
    weight = F.ceil(100 * F.sqrt("n"))
    # rounded, so that a language has a bounded number of values
    middle = [F.percentile(F.round(f"q.{c}", 4), 0.5, weight).alias(c) for c in columns]
    return each.groupBy("language").agg(F.sum(F.expr("if(nth = 0, n, 0)")).alias("n"), *middle)


def _ease() -> Column:
    """By how much a text's length widens its band."""
    return F.sqrt(F.greatest(F.lit(1.0), FULL_TOKENS / F.greatest(F.col("n_tokens"), F.lit(1))))


def bands(measured: DataFrame, width: float = WIDTH) -> DataFrame:
    """``language, <measure>_mid, <measure>_reach`` per language, the reach of texts of
    ``FULL_TOKENS`` tokens or more."""
    passed = measured.where(~F.col("base_failed"))
    names = list(LEAST)
    mids = _medians(passed, names)
    mids = mids.select("language", "n", *[F.col(c).alias(f"{c}_mid") for c in names])
    mids = stored(mids, "fertility-centres")
    far = passed.join(mids, "language").select(
        "language", "source", *[(F.abs(F.col(c) - F.col(f"{c}_mid")) / _ease()).alias(c) for c in names]
    )
    far = _medians(far, names).drop("n")
    rows = mids.join(far, "language")
    few = 1 + FEW / F.col("n")
    reach = [
        # 1.4826 median distances are a standard deviation
        (width * few * F.greatest(1.4826 * F.col(c), share * F.col(f"{c}_mid") + least)).alias(f"{c}_reach")
        for c, (share, least) in LEAST.items()
    ]
    return rows.select("language", *[f"{c}_mid" for c in names], *reach)


def judge(measured: DataFrame) -> DataFrame:
    """Base verdict, bands and verdict for stored :func:`measure` rows."""
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    rows = measured.withColumn("base_failed", failed)
    rows = rows.join(stored(bands(rows), "fertility-bands"), "language", "left")
    odd = F.lit(False)
    for name in LEAST:
        far = F.abs(F.col(name) - F.col(f"{name}_mid")) > F.col(f"{name}_reach") * _ease()
        odd |= F.coalesce(far, F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~odd).select(
        "doc_id", *COUNTS, "base_failed", "kept", "n_tokens", *MEASURES
    )


def quality_rules(docs: DataFrame, word_file: str, piece_file: str) -> DataFrame:
    """Counts, measures and verdicts of all documents."""
    return judge(stored(measure(docs, word_file, piece_file), "fertility"))

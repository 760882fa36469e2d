"""Text to vectors with a pluggable encoder, in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .moments import key_fields, to_lists

Encoder = Callable[[pa.Array], np.ndarray]
HELD_TOKENS = 1 << 18  # token buckets a task remembers


def hashed_tokens(dim: int = 64, normalize: bool = False) -> Encoder:
    """Counts of tokens between ASCII white space by hash bucket. Each distinct token of a batch is
    hashed once at most."""

    @lru_cache(maxsize=HELD_TOKENS)
    def bucket(token: str) -> int:
        return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim

    def encode(texts: pa.Array) -> np.ndarray:
        split = pc.ascii_split_whitespace(texts)
        row = pc.list_parent_indices(split).to_numpy()
        tokens = split.flatten().dictionary_encode()
        words = tokens.dictionary.to_pylist()
        buckets = np.array([bucket(w) if w else -1 for w in words], dtype=np.int64)
        cell = buckets[tokens.indices.to_numpy()]
        kept = cell >= 0
        flat = np.bincount(row[kept] * dim + cell[kept], minlength=len(texts) * dim)
        counts = flat.reshape(len(texts), dim).astype(np.float64)
        if normalize:
            counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
        return counts

    return encode


def encode_texts(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    load: Callable[[], Encoder] = hashed_tokens,
    batch_size: int = 256,
    name: str = "embedding",
) -> DataFrame:
    """``(keys…, embedding)``, one row in, one row out.

    ``load`` runs once per task, so a model is loaded once for all of its batches.
    """
    schema = T.StructType(key_fields(df, keys) + [T.StructField(name, T.ArrayType(T.DoubleType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            encoder = encoder or load()
            for start in range(0, whole.num_rows, batch_size):
                batch = whole.slice(start, batch_size)
                texts = pc.fill_null(batch.column(text).cast(pa.string()), "")
                vectors = np.asarray(encoder(texts), dtype=np.float64)
                columns = [batch.column(k) for k in keys] + [to_lists(vectors)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, name])

    return df.select(*keys, text).mapInArrow(encode, schema)

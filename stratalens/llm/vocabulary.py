"""Token ids by public tokenizer files, with the ids of frequent words remembered per worker.

Both vocabularies treat text between spaces or line ends on its own: no token and no
normalisation reaches over one. So a text's ids are those of its chunks, one after the other, and a
chunk needs the library only once as long as a worker remembers it.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain, compress, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import spans, worker_state

#: Chunks a worker remembers before it starts anew.
REMEMBERED = 600_000
#: Chunks are sent to the tokenizer in texts of about so many characters.
JOINED = 4_000


#: Takes chunks to the ids of all of them, and where each one's ids begin and how many they are.
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]


class ChunkTable:
    """Ids of chunks under some encoders. ``index`` numbers the chunks; under encoder e, chunk k
    has ``flat[e][starts[e][k] : starts[e][k] + sizes[e][k]]``."""

    def __init__(self, encoders: list[Encoder], folds: bool = False):
        """``folds``: the first encoder lower-cases, and takes marks behind a letter on their own."""
        self.encoders, self.folds = encoders, folds
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = [np.zeros(0, np.uint32) for _ in self.encoders]
        self.used = [0 for _ in self.encoders]
        self.starts = [np.zeros(0, np.int64) for _ in self.encoders]
        self.sizes = [np.zeros(0, np.int64) for _ in self.encoders]

    def trim(self) -> None:
        """Forget all if there is too much. Numbers given out before are void then."""
        if len(self.index) > REMEMBERED:
            self.clear()

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk; unknown ones are encoded and added."""
        found = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            self._add(list(dict.fromkeys(chunks[i] for i in missing.tolist())))
            found[missing] = [self.index[chunks[i]] for i in missing.tolist()]
        return found

    def _add(self, new: list[str]) -> None:
        first = len(self.index)
        self.index.update(zip(new, range(first, first + len(new))))
        for e, encode in enumerate(self.encoders):
            ids, starts, sizes = encode(new)
            used = self.used[e]
            self.flat[e] = _grown(self.flat[e], used, ids)
            self.used[e] = used + len(ids)
            self.starts[e] = _grown(self.starts[e], first, used + starts)
            self.sizes[e] = _grown(self.sizes[e], first, sizes)

    def ids(self, numbers: np.ndarray, encoder: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks in order, and the count of each chunk."""
        sizes = self.sizes[encoder][numbers]
        return self.flat[encoder][spans(self.starts[encoder][numbers], sizes)], sizes


def _grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    if used + len(more) > len(array):
        larger = np.zeros(max(2 * len(array), used + len(more)), array.dtype)
        larger[:used] = array[:used]
        array = larger
    array[used : used + len(more)] = more
    return array


def _plain(word: str) -> bool:
    """Offsets into the text are sure to fall on this word."""
    if word.isascii():
        return "<|" not in word
    if "<|" in word:
        return False
    return unicodedata.is_normalized("NFC", word) and len(word.lower()) == len(word)


def word_encoder(path: str) -> Encoder:
    """Ids of chunks by a ``tokenizers`` file, without special tokens added.

    Chunks are joined by spaces, as one call for each costs twice the time; the tokens' offsets
    tell them apart. Chunks whose offsets might shift go to the library alone.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joins = np.fromiter(map(_plain, chunks), bool, len(chunks))
        together = list(compress(chunks, joins))
        alone = list(compress(chunks, ~joins))
        ends = np.cumsum(np.fromiter(map(len, together), np.int64, len(together)) + 1)
        cuts = np.searchsorted(ends, np.arange(JOINED, ends[-1] if len(ends) else 0, JOINED))
        edges = np.unique(np.concatenate(([0], cuts, [len(together)]))).tolist()
        texts = [" ".join(together[i:j]) for i, j in zip(edges, edges[1:])]
        flat, counts = [], []
        for got, i, j in zip(tokenizer.encode_batch(texts, add_special_tokens=False), edges, edges[1:]):
            ids = got.ids
            flat.append(np.array(ids, np.uint32))
            at = np.fromiter(map(itemgetter(0), got.offsets), np.int64, len(ids))
            before = ends[i - 1] if i else 0
            upto = np.searchsorted(at, ends[i:j] - before)
            counts.append(np.diff(upto, prepend=0))
        for got in tokenizer.encode_batch(alone, add_special_tokens=False):
            flat.append(np.array(got.ids, np.uint32))
            counts.append(np.array([len(got.ids)]))
        sizes, starts = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        found = np.concatenate([*counts, np.zeros(0, np.int64)])
        order = np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins)))
        sizes[order] = found
        starts[order] = np.cumsum(found) - found
        return np.concatenate([*flat, np.zeros(0, np.uint32)]), starts, sizes

    return encode


def piece_encoder(path: str) -> Encoder:
    """Ids of chunks by a ``sentencepiece`` model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = model.encode(chunks, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        return ids, np.cumsum(sizes) - sizes, sizes

    return encode


def chunk_table(*files: str) -> ChunkTable:
    """This worker's table for the given vocabulary files, by their kind."""

    def make() -> ChunkTable:
        kinds = {True: piece_encoder, False: word_encoder}
        encoders = [kinds[f.endswith(".model")](f) for f in files]
        return ChunkTable(encoders, not files[0].endswith(".model"))

    return worker_state("chunks " + " ".join(files), make)


#: Longest stretch of a text that is split into chunks at once, and the characters of stretches
#: that are numbered together.
STRETCH = 1_000_000
TOGETHER = 4_000_000


def stretches(text: str) -> Iterable[str]:
    """The text in parts that end before a space."""
    at = 0
    while len(text) - at > STRETCH:
        end = text.find(" ", at + STRETCH)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:] if at else text


#: A full stop or comma between a letter and a space is a word of its own.
_MARKED = r"([a-z])([.,])( |$)"


def encode_texts(table: ChunkTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order and the count of each, by the table's first encoder.

    Chunks are cut and numbered by Arrow: Python sees each distinct one of some texts once.
    """
    flat, per_text, parts, owners, size = [], np.zeros(len(texts), np.int64), [], [], 0

    def flush() -> None:
        nonlocal parts, owners, size
        if parts:
            table.trim()
            spaced = pc.replace_substring(pa.array(parts, pa.large_string()), "\n", " ")
            if table.folds and not pc.any(pc.match_substring(spaced, "<|")).as_py():
                # fewer distinct chunks: a special token's text alone is not the same in lower case
                spaced = pc.replace_substring_regex(pc.ascii_lower(spaced), _MARKED, r"\1 \2 ")
            cut = pc.split_pattern(spaced, " ")
            chunks = cut.flatten().dictionary_encode()
            known = table.numbers(chunks.dictionary.to_pylist())
            ids, sizes = table.ids(known[chunks.indices.to_numpy()])
            flat.append(ids)
            total = np.concatenate(([0], np.cumsum(sizes)))
            ends = np.cumsum(pc.list_value_length(cut).to_numpy())
            np.add.at(per_text, owners, np.diff(total[np.concatenate(([0], ends))]))
        parts, owners, size = [], [], 0

    for i, text in enumerate(texts):
        for part in stretches(text):
            parts.append(part)
            owners.append(i)
            size += len(part)
            if size > TOGETHER:
                flush()
    flush()
    return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), per_text


def with_end(ids: np.ndarray, counts: np.ndarray, end: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id behind each text."""
    counts = counts + 1
    out = np.full(int(counts.sum()), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts) - 1] = False
    out[keep] = ids
    return out, counts

"""Token ids, packing and token files against the library's own encoding of whole texts."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import packing, token_file, vocabulary
from stratalens.llm.common import scratch

from .conftest import odd_rows


@pytest.fixture(scope="module")
def tokenizer(word_file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_file)


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB é́İßΣσ'.1,\n\t\x1c 　<|endoftx>\U0001f600", max_size=60))
def test_ids_by_chunks_are_those_of_the_text(tokenizer, word_file, text):
    table = vocabulary.chunk_table(word_file)
    ids, counts = vocabulary.encode_texts(table, [text, "", text])
    expected = tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == expected * 2
    assert counts.tolist() == [len(expected), 0, len(expected)]


@pytest.mark.parametrize(
    "text",
    ["Ab, c. D.", "a., b", "x.. y", "it's, I'M. 'S.", "é, É. e\u0301, E\u0301.", "1, 2. 3.5, a.b c,d", "A.\nB,\nC.",
     "ΑΣ, Σ. İ, ẞ. K.", "<|EndOfText|>, A. b", "<|endoftext|>. A, b", ",. a", "a ,. b", "A,", "a\t, b. \x0b", "Z. "],
)
def test_marks_and_capitals(tokenizer, word_file, text):
    ids, _ = vocabulary.encode_texts(vocabulary.chunk_table(word_file), [text, text])
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids * 2


def test_forgetting_changes_nothing(tokenizer, word_file, monkeypatch):
    monkeypatch.setattr(vocabulary, "REMEMBERED", 3)
    monkeypatch.setattr(vocabulary, "STRETCH", 20)
    table = vocabulary.ChunkTable([vocabulary.word_encoder(word_file)])
    texts = [r[1] or "" for r in odd_rows()[:9]] + ["a b c d e f g " * 5]
    ids, counts = vocabulary.encode_texts(table, texts)
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_packing(odd, tokenizer, word_file):
    rows = packing.pack(odd, word_file, capacity=512).collect()
    expected = Counter()
    for doc_id, text, *_ in odd_rows():
        ids = whole(tokenizer, text)
        for start in range(0, len(ids), 512):
            own = ids[start : start + 512]
            expected[doc_id, start // 512, start, len(own), crc(own)] += 1
    assert Counter((r[0], r[1], r[2], r[3], r[4]) for r in rows) == expected
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    lengths = [length for parts in by_sequence.values() for _, length in parts]
    assert len(by_sequence) == best_fit(lengths, 512)


def best_fit(lengths, capacity):
    """Best-fit decreasing, piece by piece."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_is_best_fit_decreasing(lengths):
    plan = packing.best_fit_plan(Counter(lengths), 64)
    assert plan.n_sequences == best_fit(lengths, 64)
    placed = []
    for length, count in Counter(lengths).items():
        for rank in range(count):
            run = np.flatnonzero((plan.length == length) & (plan.rank <= rank))[-1]
            nth = rank - plan.rank[run]
            place = plan.sequence[run] + nth // plan.each[run]
            placed.append((place, plan.offset[run] + nth % plan.each[run] * length, length))
    ends = {}
    for sequence, offset, length in sorted(placed):
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    assert all(e <= 64 for e in ends.values())


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 100)), st.integers(0, 100))
def test_tree_finds_the_least_room(rooms, asked):
    tree = packing.CapacityTree(100)
    for room in rooms:
        tree.set(room, True)
    assert tree.least(asked) == min((r for r in rooms if r >= asked), default=None)


def test_sequences_hold_the_ids(odd, tokenizer, word_file):
    made = packing.packed(packing.pieces(odd, word_file, 512, keep_ids=True).cache(), 512).cache()
    flat = {r["sequence_id"]: r["ids"] for r in packing.sequences(made).collect()}
    for r in made.collect():
        own = flat[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert own == r["ids"] and crc(own) == r["ids_crc32"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500))
def test_block_round_trip_and_access(ids):
    block = token_file.Block(token_file.encode_block(np.array(ids, np.uint32)))
    assert block.all().tolist() == ids
    assert [block[i] for i in range(0, len(ids), 7)] == ids[::7]
    with pytest.raises(IndexError):
        block[len(ids)]


def test_token_files(spark, odd, tokenizer, word_file, monkeypatch):
    rows = token_file.token_documents(odd, word_file).collect()
    order = lambda d: (d is not None, d or 0)
    rows = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in odd_rows()), key=order)
    at = 0
    expected = Counter((r[0], len(i), crc(i)) for r in odd_rows() for i in [whole(tokenizer, r[1])])
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert Counter((r[0], r[2], r[3]) for r in rows) == expected


def test_rows_of_one_id_are_split(spark, tokenizer, word_file):
    rows = [(5, f"text {i}") for i in range(300)] + [(None, "same")] * 300 + [(i, f"word {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    manifest = token_file.write_token_files(docs, word_file, scratch(spark, "t"), 9)
    assert max(r["n_docs"] for r in manifest.collect()) < 250
    got = token_file.read_token_documents(manifest).collect()
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter(
        (d, crc(whole(tokenizer, t))) for d, t in rows)
    assert got[-1]["start"] + got[-1]["n_tokens"] == sum(r["n_tokens"] for r in got)


def test_random_access_in_a_file(spark, odd, tokenizer, word_file):
    folder = scratch(spark, "tokens")
    manifest = token_file.write_token_files(odd.where("doc_id < 10"), word_file, folder, 1).collect()
    file = token_file.TokenFile(manifest[0]["path"])
    ids = [i for r in odd_rows() if r[0] and r[0] < 10 for i in whole(tokenizer, r[1])]
    assert len(ids) == manifest[0]["n_tokens"]
    assert [file[i] for i in range(0, len(ids), 997)] == ids[::997]


def test_empty_tables(nothing, word_file):
    assert packing.pack(nothing, word_file).count() == 0
    assert token_file.token_documents(nothing, word_file).count() == 0

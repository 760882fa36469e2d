"""Removal of repeats against a scan of all windows."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from stratalens.llm import repeats

from .conftest import SCHEMA, odd_rows, prose


def brute(rows):
    found = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in found:
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            if d is not None:
                least[key] = min(least.get(key, d), d)
    out = Counter()
    for d, w in found:
        gone = set()
        for i in range(len(w) - 12):
            first = least.get(tuple(w[i : i + 13]))
            if first is not None and (d is None or first < d):
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_odd_rows(odd):
    rows = repeats.without_repeats(odd).collect()
    assert Counter(map(tuple, rows)) == brute([r[:2] for r in odd_rows()])


def test_overlapping_passages_of_a_small_vocabulary(spark):
    pick = random.Random(5)
    parts = [prose(k, pick.randint(5, 40)).split() for k in range(12)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(pick.randint(0, 6)):
            part = pick.choice(parts)
            a = pick.randint(0, len(part) // 2)
            text += part[a : pick.randint(a, len(part))] * pick.choice((1, 1, 2))
            text += pick.choices("abc", k=pick.randint(0, 3))
        rows.append((d, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, repeats.without_repeats(frame).collect())) == brute(rows)


def test_kept_text(spark):
    passage = prose(1, 20).replace("\n", " ")
    rows = [(1, f"a {passage} b"), (2, f"c {passage} d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in repeats.without_repeats(frame, keep_text=True).collect()}
    assert got == {1: f"a {passage} b", 2: "c d"}


def test_empty(nothing):
    assert repeats.without_repeats(nothing).count() == 0
    assert "doc_id" in SCHEMA
    with pytest.raises(Exception):
        repeats.without_repeats(nothing.drop("text"))


def test_different_texts_of_one_id_are_told_apart(spark, like_salted):
    a, b = like_salted
    for key in (None, 7):
        for held, other in ((a, " ".join(b.split()[:14])), (a, b), (b, a)):
            rows = [(1, f"first {held} last"), (key, a), (key, b), (2, other)]
            frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
            assert Counter(map(tuple, repeats.without_repeats(frame).collect())) == brute(rows)


@pytest.mark.parametrize("size", [1, 50, 2_000_000])
def test_digests_tell_words_apart_as_the_rule_does(monkeypatch, size):
    monkeypatch.setattr(repeats, "GROUP_BYTES", size)
    pick = random.Random(3)
    texts = ["".join(pick.choices("ab é　\x1c\U0001f600\t\n\x0b\x0c\r\x85", k=pick.randint(0, 40))) for _ in range(500)]
    texts += ["", "x" * 300, " " + "y" * 65 + " " + "y" * 64 + " " + "y" * 63, "a", "a", ""]
    seen, done = {}, 0
    for first, end, hashes, counts in repeats._hashed(pa.array(["left out", *texts]).slice(1)):
        found = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts[first:end]]
        assert first == done and counts.tolist() == [len(w) for w in found]
        for word, digest in zip(sum(found, []), hashes.tolist(), strict=True):
            assert seen.setdefault(word, digest) == digest
        done = end
    assert done == len(texts)
    for k in (0, 1):
        assert len({d[k] for d in seen.values()}) == len(seen)

"""Counts against plain Python; bands and verdicts on odd tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from stratalens.llm import fertility

from .conftest import odd_rows, prose


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, duplicates, len(covered)


def test_counts(spark, odd, word_file, piece_file):
    rows = fertility.quality_rules(odd, word_file, piece_file).collect()
    expected = Counter((r[0], *plain(r[1])) for r in odd_rows())
    assert Counter(tuple(r)[:6] for r in rows) == expected
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_repeated_words_of_large_vocabularies():
    rng = np.random.default_rng(1)
    numbers, owner = rng.integers(0, 4, 400), np.sort(rng.integers(0, 5, 400))
    got = fertility.repeated_words(numbers, owner, 5)
    for d in range(5):
        text = " ".join(str(x) for x in numbers[owner == d])
        assert got[d] == plain(text)[4]


def test_odd_tokens_are_rejected_and_prose_is_kept(spark, word_file, piece_file):
    rows = [(i, prose(i, 300), "en") for i in range(150)]
    # every word a rare sign: bytes in one vocabulary, many tokens in the other
    rows += [(900, " ".join(chr(0x13000 + i) * 3 for i in range(200)), "en")]
    rows += [(901, prose(901, 200), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in fertility.quality_rules(frame, word_file, piece_file).collect()}
    assert all(got[i]["kept"] for i in range(150)) and got[901]["kept"]
    assert got[900]["byte_share"] > 0.5 and not got[900]["kept"] and not got[900]["base_failed"]


def test_measures_are_those_of_the_libraries(spark, word_file, piece_file):
    import sentencepiece
    from tokenizers import Tokenizer

    text = prose(3, 120)
    frame = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    row = fertility.measure(frame, word_file, piece_file).first()
    ids = Tokenizer.from_file(word_file).encode(text, add_special_tokens=False).ids
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file).encode(" ".join(text.split()))
    share = np.array(list(Counter(ids).values())) / len(ids)
    chars = len("".join(text.split()))
    assert row["word_chars_per_token"] == pytest.approx(chars / len(ids))
    assert row["piece_chars_per_token"] == pytest.approx(chars / len(pieces))
    assert row["entropy"] == pytest.approx(-(share * np.log2(share)).sum())


def test_empty(nothing, word_file, piece_file):
    assert fertility.quality_rules(nothing, word_file, piece_file).count() == 0


def menu(seed, n):
    """Fragments of few words, each three in a row different enough for the base rules."""
    pick = random.Random(seed)
    few = ["home", "login", "cart", "next", "prev", "help", "menu", "page", "top"]
    return " ".join(w + str(pick.randrange(3)) for w in pick.choices(few, k=n))


BANDED = "doc_id long, text string, lang string, source string"


def test_fragments_are_rejected_in_a_band_that_a_hot_source_does_not_set(spark, word_file, piece_file):
    clean = [(i, prose(i, 200 + i), "en", f"s{i % 8}") for i in range(120)]
    bad = [(1000 + i, menu(i, 300), "en", f"s{i % 8}") for i in range(12)]
    for hot in (0, 180):
        # copies of one fragment text are most of the rows, from one source
        rows = clean + bad + [(2000 + i, menu(99, 300), "en", "hot") for i in range(hot)]
        frame = spark.createDataFrame(rows, BANDED).repartition(3)
        got = fertility.quality_rules(frame, word_file, piece_file).collect()
        assert not any(r["base_failed"] for r in got)
        assert {r["doc_id"] for r in got if r["kept"]} == set(range(120))


def test_block_entropy():
    rng = np.random.default_rng(2)
    counts = np.array([0, 49, 50, 51, 137, 300])
    ids = rng.integers(0, 30, counts.sum())
    got, at = fertility.block_entropy(ids, counts), 0
    for n, value in zip(counts.tolist(), got):
        own, each = ids[at : at + n], []
        at += n
        for k in range(0, n if n >= 50 else 0, 50):
            share = np.array(list(Counter(own[min(k, n - 50) :][:50].tolist()).values())) / 50
            each.append(-(share * np.log2(share)).sum())
        assert value == pytest.approx(np.mean(each) if each else 0)


def test_a_rare_language_is_judged_alike_at_any_number_of_texts(spark, word_file, piece_file):
    greek = str.maketrans("anreoutishéw", "ανρεουτισηέω")
    rare = [(1000 + i, prose(i, 300).translate(greek), "el", f"s{i % 8}") for i in range(101)]
    common = [(i, prose(500 + i, 300), "en", f"s{i % 8}") for i in range(150)]
    for n in (1, 2, 5, 99, 101):
        frame = spark.createDataFrame(common + rare[:n], BANDED).repartition(3)
        got = fertility.quality_rules(frame, word_file, piece_file).collect()
        assert not any(r["base_failed"] for r in got)
        assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted(r[0] for r in common + rare[:n])

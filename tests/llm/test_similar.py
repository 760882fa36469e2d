"""The similarity join and the containment search against all pairs."""

import re
from collections import Counter

import numpy as np
import pytest

from stratalens.llm import chosen_path, containment

from .conftest import odd_rows, prose


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * n
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            r = find(i)
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return Counter((rows[i][0], least.get(find(i)), links[i]) for i in range(n))


def test_odd_rows(odd):
    got = chosen_path.similar_documents(odd).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == brute([r[:2] for r in odd_rows()])


def test_group_of_near_copies_over_several_blocks(spark, monkeypatch):
    # tasks get the module by value, so the smaller bounds reach them
    monkeypatch.setattr(chosen_path, "BLOCK", 20)
    monkeypatch.setattr(chosen_path, "SMALL", 8)
    pick = np.random.default_rng(5)
    base, rows = prose(1, 120).split(), []
    for d in range(110):
        text = list(base) if d < 100 else prose(d, 100).split()
        for at in pick.integers(0, len(text), pick.integers(0, 6)):
            text[at] = f"w{pick.integers(0, 9)}"
        rows.append((d, " ".join(text[: len(text) - int(pick.integers(0, 12))])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = chosen_path.similar_documents(frame).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_one_of_each(odd):
    kept = chosen_path.one_of_each(odd)
    assert kept.schema == odd.schema
    ids = Counter(r["doc_id"] for r in kept.collect())
    # near and exact copies of 1 go, a repeated row stays once, texts without words all stay
    assert 2 not in ids and 3 not in ids and 8 not in ids and ids[11] == 1 and ids[None] == 1
    assert all(ids[d] == 1 for d in (1, 4, 5, 6, 7, 9, 12, 13, 14)) and ids[10] == 2


def test_empty(nothing):
    assert chosen_path.similar_documents(nothing).count() == 0


def test_runs_reach_the_recall():
    assert (1 - chosen_path.met(0.8, chosen_path.DEPTH)) ** chosen_path.runs_needed() <= 1e-3


def test_sketch_estimates_similarity():
    sets = [np.unique(np.random.default_rng(k).integers(0, 2**63, 500).astype(np.uint64)) for k in (1, 2)]
    mixed = np.unique(np.concatenate((sets[0][:450], sets[1][:50])))
    own = chosen_path.sketches(np.concatenate((sets[0], mixed)), np.array([len(sets[0]), len(mixed)]))
    assert (own[0] == own[1]).mean() == pytest.approx(450 / 550, abs=0.2)


ITEMS = [
    (1, " ".join(prose(1, 200).split()[10:40])), (2, prose(50, 30)), (3, "ONE two"), (4, None),
    (5, ""), (6, " ".join(prose(2, 30_000).split()[20_000:20_050])), (6, prose(51, 20)),
    (None, " ".join(prose(3, 60).split()[5:40])), (7, " ".join(prose(7, 80).split()[:33] + ["x"] * 2)),
]


def contained(rows, items):
    out = Counter()
    for item, text in set(items):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        asked = shingles((text or "").lower())
        for d, t in rows if w else ():
            u = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
            k = min(5, len(w))
            own = {tuple(u[i : i + k]) for i in range(len(u) - k + 1)}
            shared = len(asked & own)
            if shared >= 0.8 * len(asked):
                out[d, item, len(asked), shared] += 1
    return out


@pytest.mark.parametrize("block", [containment.BLOCK_SHINGLES, 40])
def test_containment(spark, odd, block):
    items = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string")
    got = containment.containment_search(odd, items, block=block).collect()
    expected = contained([r[:2] for r in odd_rows()], ITEMS)
    assert Counter(tuple(r)[:4] for r in got) == expected
    assert {k[0] for k in expected} >= {1, 2, 3, 7, 8, 9, None}
    kept = containment.without_items(odd, items, block=block)
    assert kept.schema == odd.schema
    bad = {r[:2] for r in odd_rows() if contained([r[:2]], ITEMS)}
    left = Counter(r[:2] for r in odd_rows() if r[:2] not in bad)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == left


def test_empty_containment(spark, odd, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert containment.containment_search(nothing, items).count() == 0
    assert containment.containment_search(odd, items.where("false")).count() == 0
    assert containment.without_items(odd, items.where("false")).count() == odd.count()


def test_sketch_recall_over_sizes():
    rng = np.random.default_rng(1)
    for least in (5, 9, 30):
        factor = containment.bins_factor(least)
        for size in (50, 1000, 20_000):
            lost = 0
            for _ in range(200):
                own = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
                asked = rng.choice(own, least, replace=False)
                lost += not np.isin(asked, containment.sketch(own, factor)).any()
            assert lost <= 3


def test_different_texts_of_one_id_are_told_apart(spark, like_salted):
    a, b = like_salted
    for key in (None, 7):
        rows = [(key, a), (key, b), (9, a + " more"), (None, b + " of it")]
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        got = chosen_path.similar_documents(frame).select("doc_id", "class_id", "n_links").collect()
        assert Counter(map(tuple, got)) == brute(rows)
        for some in (rows[:2], rows):
            left = chosen_path.one_of_each(spark.createDataFrame(some, "doc_id long, text string"))
            assert sorted(r["text"].split()[0] for r in left.collect()) == sorted(x.split()[0] for x in (a, b))

"""Secret spans against regexes in Python; trigram queries on matching strings."""

import hashlib
import re
from collections import Counter

import pytest

from stratalens.llm import secret_scan
from stratalens.llm.secret_scan import RULES, Rule, trigram_query

from .conftest import SCHEMA, odd_rows

KEY = "AKIA" + "Z9" * 8
TEXTS = [
    f"é😀 Password = 'hunter22' and {KEY}! token:abc secret: \"longer-value\"",
    "api_key=APIKEY=xyz123 " + "0123456789abcdef" * 2 + " deadbeef",
    f"{KEY}{KEY} password:token: abcdefgh", "pass word = abcdefgh paſſword=abcdefgh toKen=abcdefgh",
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 9 + " xoxb-1234567890-ab AIza" + "S" * 35,
    "eyJhbGciOiJI.eyJzdWIiOiIx.c2ln", f"secret={'a' * 30} secret={'f' * 30}", "APIKEY:abcdef", None,
]


def spans(text):
    out = []
    for k, rule in enumerate(RULES):
        pattern = rule.pattern.replace("(?i:", "(?ai:")
        for m in re.finditer(pattern, text or ""):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), k, m.end(), rule.kind))
    return sorted(out)


def listed(found):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


@pytest.fixture(scope="module")
def frame(spark, odd):
    more = [(100 + i, t, "en", "s", len(t or ""), 1.0, "s", "r", 1, 2, "k", "i", 3) for i, t in enumerate(TEXTS)]
    return odd.unionByName(spark.createDataFrame(more + more[:1], SCHEMA))


def every():
    return [r[:2] for r in odd_rows()] + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(100, TEXTS[0])]


def test_spans(frame):
    expected = Counter()
    for doc_id, text in every():
        found = spans(text)
        base = [s for s in found if s[3] in secret_scan.BASE]
        count = Counter(s[3] for s in base)
        sha = hashlib.sha256(listed(base).encode()).hexdigest()
        expected[doc_id, count["assign"], count["access"], count["hex"], sha, listed(found)] += 1
    assert Counter(map(tuple, secret_scan.secret_digest(frame).collect())) == expected
    kinds = {s[3] for t in TEXTS for s in spans(t)}
    assert kinds == {r.kind for r in RULES}


def test_redaction(frame):
    def masked(text):
        if text is None:
            return None
        out, at = "", 0
        for a, _, b, _ in spans(text):
            if a >= at:
                out += text[at:a] + secret_scan.MASK
            at = max(at, b)
        return out + text[at:]

    got = secret_scan.redacted(frame)
    assert got.schema.names == frame.schema.names
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((d, masked(t)) for d, t in every())
    assert got.where("n_chars <> length(text)").count() == 0


def test_bounds_in_the_regex_change_nothing():
    text = "AKIAAKIA" + "A" * 14 + " AKIA1 " + "a" * 23 + "g" + "b" * 24 + KEY
    stated = [m[0] for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    assert [m[0] for m in re.finditer(RULES[1].pattern, text)] == stated
    stated = [m[0] for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert [m[0] for m in re.finditer(RULES[2].pattern, text)] == stated


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.kind)
def test_matches_satisfy_the_query(rule):
    query = trigram_query(rule.pattern)
    assert bool(query) == (rule.kind != "hex")
    for text in TEXTS:
        for m in re.finditer(rule.pattern.replace("(?i:", "(?ai:"), text or ""):
            low = m[0].lower()
            assert all(any(all(t in low for t in a) for a in group) for group in query)


def test_queries_of_small_regexes():
    assert trigram_query("abcd") == [[frozenset({"abc", "bcd"})]]
    assert trigram_query("(abc|xyz)+d") == [[frozenset({"abc"}), frozenset({"xyz"})]]
    assert trigram_query("ab?c") == []
    assert trigram_query("a.*bcd") == [[frozenset({"bcd"})]]
    assert trigram_query("ab[cd]e") == [[frozenset({"abc", "bce"}), frozenset({"abd", "bde"})]]


def test_no_rules_with_trigrams_and_empty(spark, frame, nothing):
    assert secret_scan.secret_digest(nothing).count() == 0
    rule = Rule("digits", r"[0-9]{3,}")
    rows = secret_scan.find_secrets(frame, [rule]).select("text", "spans").collect()
    for r in rows:
        expected = [(m.start(), m.end()) for m in re.finditer(rule.pattern, r["text"])]
        assert [(s["start"], s["end"]) for s in r["spans"]] == expected


def test_no_python_in_the_plan(frame):
    plan = secret_scan.secret_digest(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_very_many_matches_in_a_text(spark):
    parts = [f"{k:024x}{'-' if k % 3 else ' token=' + 'é'[: k % 2] + 'b' * 30 + ' '}" for k in range(100_000)]
    texts = ["".join(parts), "".join(parts[:255]), "".join(parts[:256]), "".join(parts[:513])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in secret_scan.secret_digest(frame).collect()}
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redacted(frame).collect()}
    for doc_id, text in enumerate(texts):
        found = spans(text)
        assert got[doc_id]["spans"] == listed(found)
        assert got[doc_id]["n_hex"] == sum(s[3] == "hex" for s in found)
        out, at = [], 0
        for a, _, b, _ in found:
            out += [text[at:a], secret_scan.MASK] if a >= at else []
            at = max(at, b)
        assert masked[doc_id] == "".join(out) + text[at:]

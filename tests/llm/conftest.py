"""Small tables with every oddity: nulls, empty and very long texts, repeated rows, equal ids, columns
whose names the operators use themselves."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, "
    "spans string, `row` string, doc long, salt long, `key` string, ids string, _h long"
)


def prose(seed, n, line=12):
    pick = random.Random(seed)
    found = ["".join(pick.choices(["the", "an", "re", "ou", "ti", "sh", "é", "wh"], k=pick.randint(1, 5)))
             for _ in range(n)]
    return "\n".join(" ".join(found[i : i + line]) for i in range(0, n, line))


def odd_rows():
    base, long = prose(1, 200), prose(2, 30_000)
    near = base.split(" ")
    near[40] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"),
        (8, "one two"), (9, long), (10, prose(3, 60)), (10, prose(4, 70)), (11, prose(5, 90)),
        (11, prose(5, 90)), (None, base), (None, prose(6, 40)), (12, "　wide\x1cspace é \U0001f600 İ ß"),
        (13, prose(7, 80) + " " + " ".join(base.split()[20:60])), (14, "x" * 300_000),
    ]
    out = []
    for i, (doc_id, text) in enumerate(texts):
        lang, source = (None, None) if i % 5 == 4 else ("en", "s0")
        n = None if text is None else len(text)
        out.append((doc_id, text, lang, source, n, 9.0, "spans", "row", 77, 78, "k", "ids", 79))
    return out


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def word_file():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def piece_file():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def like_salted(spark):
    """Two texts of 40 words of their own whose 64-bit hashes agree in the lower 24 bits."""
    words = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.concat_ws("x", "id", k))
    texts = spark.range(20_000).select(F.array_join(words, " ").alias("text"))
    key = F.xxhash64("text").bitwiseAND(0xFFFFFF)
    pair = texts.groupBy(key).agg(F.collect_list("text").alias("texts")).where("size(texts) > 1")
    return sorted(pair.first()["texts"])[:2]

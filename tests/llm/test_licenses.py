"""Licences against cosines in Python and a walk up the directories."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratalens.llm import license_scan
from stratalens.llm.license_scan import TEMPLATES, signature, template_weights, tokens

from .conftest import prose

MIT, GPL, APACHE = (TEMPLATES[k] for k in ("MIT", "GPL-3.0", "Apache-2.0"))
ROWS = [
    (1, MIT, "a/LICENSE"), (2, prose(1, 50), "a/b/c.txt"), (3, GPL, "a/b/LICENSE"),
    (4, prose(2, 50), "a/b/d/e/f.txt"), (5, prose(3, 50) + "\n" + APACHE + "\n" + prose(4, 50), "a/g.txt"),
    (6, prose(5, 20), "z/h.txt"), (7, None, "a/i.txt"), (8, "", "a/b/i.txt"), (9, prose(6, 9), None),
    (10, "Released under the MIT Licence", "q/j.txt"), (11, prose(7, 30), "flat"), (12, "the the the of", "q/r"),
    (2, prose(8, 30), "a/b/c.txt"), (None, MIT + "\n" + prose(9, 80), "z/k.txt"), (5, APACHE, "z/y/COPYING"),
    (13, prose(10, 30), "z/y/x/w"), (13, prose(10, 30), "z/y/x/w"), (14, MIT + "\n" + GPL + " " + prose(2, 30), "m/n"),
]


def expected():
    lines = [tokens(x) for r in ROWS for x in (r[1] or "").split("\n")]
    vocabulary = {t for x in TEMPLATES.values() for t in tokens(x)}
    held = Counter(t for x in lines for t in set(x))
    idf = lambda t: math.log((len(lines) + 1) / ((held[t] if t in vocabulary else 0) + 1)) + 1
    vectors = template_weights({t: idf(t) for t in vocabulary}, TEMPLATES)

    def best(text, threshold):
        found = Counter(tokens(text))
        w = {t: (1 + math.log(n)) * idf(t) for t, n in found.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        some = [(-round(sum(w[t] * x for t, x in v.items() if t in w) / norm, 6), name) for name, v in vectors.items()] if w else []
        some = [s for s in some if -s[0] >= threshold]
        return min(some) if some else None

    files, own = {}, []
    for _, text, path in ROWS:
        whole = best(text or "", license_scan.FILE_COSINE)
        line = [(*b, i) for i, x in enumerate((text or "").split("\n")) if (b := best(x, license_scan.LINE_COSINE))]
        own.append((whole, min(line) if line else None))
        if whole and path and "/" in path:
            d = path.rpartition("/")[0]
            files[d] = min(files.get(d, whole), whole)
    out = Counter()
    for (doc_id, _, path), (whole, line) in zip(ROWS, own):
        if whole:
            out[doc_id, whole[1], "file", None, None] += 1
            continue
        if line:
            out[doc_id, line[1], "line", line[2], None] += 1
            continue
        d = path.rpartition("/")[0] if path else ""
        while d and d not in files:
            d = d.rpartition("/")[0]
        out[(doc_id, files[d][1], "inherited", None, d) if d else (doc_id, None, None, None, None)] += 1
    return out


SCHEMA = "doc_id long, text string, path string, `unit` string, _h string, own string"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, "u", "h", "o") for r in ROWS], SCHEMA).repartition(3)


def test_licenses(frame):
    got = license_scan.licenses(frame, F.col("path")).collect()
    keys = ("doc_id", "license", "origin", "line", "directory")
    assert Counter(tuple(r[k] for k in keys) for r in got) == expected()
    assert {"file", "line", "inherited", None} == {r["origin"] for r in got}


def test_signature_is_complete():
    vectors = template_weights({t: 1.0 + len(t) for x in TEMPLATES.values() for t in tokens(x)}, TEMPLATES)
    cue = set(signature(vectors, 0.6))
    for v in vectors.values():
        assert math.sqrt(sum(w * w for t, w in v.items() if t not in cue)) < 0.6


def test_empty_and_native(spark, frame):
    none = spark.createDataFrame([], SCHEMA)
    assert license_scan.licenses(none, F.col("path")).count() == 0
    plan = license_scan.licenses(frame, F.col("path"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def wrapped(text, prefix, width):
    w = text.split()
    return "\n".join(prefix + " ".join(w[i : i + width]) for i in range(0, len(w), width))


#: As published, not taken from the module.
GPL_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
    "GNU General Public License for more details."
)
MIT_TEXT = (
    "MIT License Copyright (c) 2024 Some Author Permission is hereby granted, free of charge, to any person "
    "obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions:"
)
APACHE_HEADER = (
    "Copyright 2024 Some Author Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
    "this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
    "KIND, either express or implied."
)


def test_published_headers_in_longer_texts(spark):
    some = [("GPL-3.0", GPL_HEADER), ("MIT", MIT_TEXT), ("Apache-2.0", APACHE_HEADER)]
    rows, expected = [(99, prose(99, 300), "p/99")], {99: None}
    for i, (name, text) in enumerate(some):
        for j, (prefix, width) in enumerate((("# ", 6), (" * ", 11), ("", 16))):
            doc = 10 * i + j
            body = prose(doc, 200) + "\n" + wrapped(text, prefix, width) + "\n" + prose(50 + doc, 200)
            rows.append((doc, body, f"p{doc}/{doc}"))
            expected[doc] = name
        rows.append((100 + i, wrapped(text, "", 12), f"q{i}/LICENSE"))
        rows.append((200 + i, prose(200 + i, 60), f"q{i}/a/b"))
        expected |= {100 + i: name, 200 + i: name}
    frame = spark.createDataFrame(rows, "doc_id long, text string, path string").repartition(3)
    got = {r["doc_id"]: r for r in license_scan.licenses(frame, F.col("path")).collect()}
    assert {d: r["license"] for d, r in got.items()} == expected
    assert {got[d]["origin"] for d in (100, 101, 102)} == {"file"}
    assert {got[d]["origin"] for d in (200, 201, 202)} == {"inherited"}


def test_deep_paths_inherit_from_the_nearest_directory(spark):
    deep = "/".join(f"d{i}" for i in range(90))
    rows = [(1, MIT, "d0/LICENSE"), (2, GPL, f"{deep}/LICENSE"), (3, prose(1, 50), f"{deep}/e/f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r["doc_id"]: r for r in license_scan.licenses(frame, F.col("path")).collect()}
    assert (got[3]["license"], got[3]["directory"]) == ("GPL-3.0", deep)


def flat(seed, n):
    return " ".join(prose(seed, n).split())


def test_a_line_in_every_document_costs_the_same_anywhere(spark):
    """The rows of each plan's step stay those of the documents: nothing is written for a term or a block."""
    rows = [(i, f"{flat(i, 20)}\n{MIT}\n{prose(i + 1, 900)}", f"p/{i}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, path string").repartition(3)
    got = license_scan.licenses(frame, F.col("path"))
    assert {(r["license"], r["origin"], r["line"]) for r in got.collect()} == {("MIT", "line", 1)}
    assert "token" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_many_cued_lines_in_one_text(spark):
    text = "\n".join(MIT if i % 3 == 2 else flat(i, 12) for i in range(3000))
    frame = spark.createDataFrame([(1, text, "p/1"), (2, "\n" * 5000 + APACHE, "p/2")], "doc_id long, text string, path string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["line"]) for r in license_scan.licenses(frame, F.col("path")).collect()}
    assert got == {1: ("MIT", "line", 2), 2: ("Apache-2.0", "file", None)}

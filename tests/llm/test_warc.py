"""Archives against a plain account of the same pages."""

import gzip
import hashlib
from collections import Counter

import pytest
from pyarrow import fs

from stratalens.llm import warc
from stratalens.llm.common import scratch

SCHEMA = "page_id long, url string, html string, digest string, payload string, copy string, leader int"
LONG = "<p>é" + "x" * 3000


def rows():
    texts = [
        (1, "http://a/\r\nX: y", LONG), (2, None, LONG), (3, "http://b", LONG), (3, "http://b", LONG),
        (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", LONG),
        (None, "u", "z" * 1000), (8, "u", "é" * 500), (9, "u", "é" * 500), (10, "u", "a" * 999),
        (11, "u", "a" * 999), (12, "u", "\r\n\r\nWARC/1.1\r\n" * 40_000),
    ]
    return [(*t, "d", "p", "c", 1) for t in texts]


def expected():
    out, seen = Counter(), Counter()
    digests = {}
    for page, _, html, *_ in rows():
        data = (html or "").encode()
        digests.setdefault(hashlib.sha1(data).hexdigest(), []).append((page, len(data)))
    for digest, pages in digests.items():
        ids = [p for p, _ in pages if p is not None]
        for page, size in pages:
            leader = max(ids) if size >= 1000 and len(pages) > 1 and ids else None
            seen[page, digest] += 1
            own = leader is None or (page == leader and seen[page, digest] == 1)
            kind = ("response", None) if own else ("revisit", leader)
            out[page, size, digest, *kind] += 1
    return out


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def test_round_trip(pages):
    assert Counter(map(tuple, warc.archive_round_trip(pages).collect())) == expected()


def test_archives_are_warc_files_and_keep_payloads(spark, pages):
    manifest = warc.write_archives(warc.record_chunks(pages), scratch(spark, "warc"))
    text = b""
    for row in manifest.collect():
        system, name = fs.FileSystem.from_uri(row["path"])
        with system.open_input_file(name) as source:
            text += gzip.decompress(source.read())
    assert text.count(b"WARC-Record-ID: ") == len(rows())
    assert b"\r\nX: y" not in text
    chunks = warc.read_chunks(manifest)
    assert chunks.where("page_id = 12").count() == -(-len("\r\n\r\nWARC/1.1\r\n" * 40_000) // warc.CHUNK)
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_payloads(manifest).where("page_id is not null").collect()}
    by_id = {r[0]: (r[2] or "").encode() for r in rows()}
    assert all(by_id[k] == v for k, v in got.items()) and {3, 4, 5, 6, 7, 9, 12} <= set(got)


def test_running_digests(spark, pages):
    manifest = warc.write_archives(warc.record_chunks(pages.where("page_id = 12")), scratch(spark, "warc"))
    data, at = ("\r\n\r\nWARC/1.1\r\n" * 40_000).encode(), 0
    for row in warc.read_chunks(manifest).orderBy("chunk_no").collect():
        at += len(row["data"])
        assert row["digest"] == hashlib.sha1(data[:at]).hexdigest()


def test_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0

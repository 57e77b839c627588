"""Media columns: parsing, alignment, the store's round trip and the query's digests."""

import hashlib
import os
import zlib

import pytest
from lamella.llm import media, queries

from . import data

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><p>One <b>bold</b>
 text</p><img src="x1" alt="first"><figure><img src='x2'><img src="missing" alt="m"/><figcaption>Both &amp; <i>more</i></figcaption></figure>
<script>var a = "<p>no</p>";</script><noscript><img src="x9"></noscript>tail <video src="x1"></video><figure><figcaption>alone</figcaption></figure><p>end"""


def test_items():
    assert media.Reader().read(PAGE) == [
        ["text", "T", None, None], ["text", "One bold text", None, None], ["media", "first", "x1", None], ["media", "", "x2", "Both & more"],
        ["media", "m", "missing", "Both & more"], ["text", "tail", None, None], ["media", "", "x1", None], ["text", "alone", None, None], ["text", "end", None, None],
    ]


def test_interleave_and_resolve(spark):
    pages = spark.createDataFrame([(1, PAGE, "a", "b"), (1, PAGE, "a", "b"), (2, None, None, None), (None, "", "x", "y"), (4, "<p>" + "long " * 50000, "", "")], "page_id long, html string, items string, media string")
    stock = spark.createDataFrame([("x1", b"1"), ("x2", b"2"), ("x2", b"2"), (None, b"0"), ("unused", b"3")], "digest string, payload binary")
    got = media.resolve(media.interleave(pages), stock).collect()
    assert sorted((r["row"]["page_id"] or 0, len(r["items"])) for r in got) == [(0, 0), (1, 9), (1, 9), (2, 0), (4, 1)]
    for r in got:
        assert [i["pos"] for i in r["items"]] == list(range(len(r["items"])))
        for i in r["items"]:
            want = {"x1": b"1", "x2": b"2"}.get(i["ref"])
            assert (bytes(i["media"]["payload"]) if i["media"] else None) == want
    assert media.resolve(media.interleave(pages.limit(0)), stock).count() == 0


def test_png_is_lossless():
    for n in (64, 640, 6400):
        payload = bytes((i * i) % 256 for i in range(n))
        png = media.to_png(payload)
        assert media.from_png(png).tobytes() == payload
        try:
            media.from_png(png[:-20] + bytes([png[-20] ^ 1]) + png[-19:])
            raise AssertionError
        except (ValueError, zlib.error):
            pass


def feature(payload):
    """The feature in plain Python, a byte at a time."""
    high = [sum(1 for b in payload if b >> 4 == k) for k in range(16)]
    changes = sum(a != b for a, b in zip(payload, payload[1:]))
    return ":".join(map(str, [len(payload), sum(payload), len(set(payload)), changes, *high]))


def pad(raw):
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def test_query(spark, tmp_path):
    data.documents(spark).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op9_media(spark, f"file://{tmp_path}").collect()
    want = []
    for i, t, _, source, *_ in data.rows():
        raw = (t or "").encode()
        payload = pad(raw)
        png = media.to_png(payload)
        lines = (t or "").split("\n")
        half = len(lines) // 2
        parts = [" ".join("\n".join(x).split()) for x in (lines[:half], lines[half:])]
        row = (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature(payload))
        row += (f"Text of document {i}", 1 + bool(parts[0]), source or "", hashlib.sha256(pad((source or "").encode())).hexdigest(), 2 + sum(map(bool, parts)), sum(map(len, parts)))
        want.append(row)
    assert sorted(tuple(r) for r in got) == sorted(want)
    data.documents(spark, []).write.parquet(f"file://{tmp_path}/e/documents.parquet")
    assert queries.op9_media(spark, f"file://{tmp_path}/e").count() == 0


def test_null_payloads_are_not_stored(spark, tmp_path):
    where = f"file://{tmp_path}/m"
    media.store(spark.createDataFrame([(None, 1), (b"a" * 64, 2), (b"a" * 64, 3)], "payload binary, media int").coalesce(1), where)
    assert [r["payload_bytes"] for r in media.describe(spark, where).collect()] == [64]
    assert spark.read.parquet(where).count() == 1


PAGES = "/root/testdata/sf0.001/pages.parquet"


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no such table here")
def test_pages_with_several_media(spark):
    """Raw pages with two figures put in between their parts: texts, media, positions and captions against the parser itself."""
    pages = [(r["page_id"], (r["html"] or "")) for r in spark.read.parquet(f"file://{PAGES}").collect()]
    pages = [(i, h.replace("</p>", f'</p><figure><img src="m{i % 7}"><img src="hot"><figcaption>c{i}</figcaption></figure>')) for i, h in pages]
    stock = spark.createDataFrame([(f"m{k}", k) for k in range(6)] + [("hot", 99)], "digest string, value int")
    got = media.resolve(media.interleave(spark.createDataFrame(pages, "page_id long, html string")), stock).collect()
    assert sum(len(r["items"]) for r in got) > 5 * len(pages) and len(got) == len(pages)
    values = {f"m{k}": k for k in range(6)} | {"hot": 99}
    html = dict(pages)
    for r in got:
        want = media.Reader().read(html[r["row"]["page_id"]])
        assert [(i["pos"], i["kind"], i["text"], i["ref"], i["caption"], i["media"] and i["media"]["value"]) for i in r["items"]] == [(k, *x, values.get(x[2])) for k, x in enumerate(want)]

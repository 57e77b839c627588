"""Media columns: documents as ordered sequences of texts and media references, with payloads resolved by digest.

HTML is parsed into structs of text and media in document order. Media payloads
live in a store keyed by the digest of their content, where a partition writes
equal payloads once; references meet them in a join on that digest, and what they
find goes back to its place beside texts and captions.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from html.parser import HTMLParser
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Samples in a row of the stored image; payloads are padded with 0 to a positive multiple of it.
WIDTH = 64
MEDIA_TAGS = ("img", "video", "audio", "source", "embed")
HIDDEN_TAGS = ("script", "style", "template", "noscript")
#: Tags that do not end a run of text.
INLINE_TAGS = frozenset("a abbr b bdi bdo cite code data dfn em i kbd label mark q s samp small span strong sub sup time u var wbr".split())

# ---- sequences


class Reader(HTMLParser):
    """Items of a page in order: [kind, text, ref, caption]. A text item has its text; a media item its alternative text, reference and caption."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figures: list[list[int]] = []  # media items of each open figure
        self.caption: list[str] | None = None

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run.clear()
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        if tag not in INLINE_TAGS and self.caption is None:
            self.flush()
        a = dict(attrs)
        if tag in MEDIA_TAGS and a.get("src") and not self.hidden:
            if self.figures:
                self.figures[-1].append(len(self.items))
            self.items.append(["media", a.get("alt") or "", a["src"], None])
        elif tag == "figure":
            self.figures.append([])
        elif tag == "figcaption" and self.figures:
            self.caption = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in MEDIA_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in HIDDEN_TAGS:
            self.hidden = max(0, self.hidden - 1)
        if tag == "figcaption" and self.caption is not None:
            self.end_caption()
        if tag == "figure" and self.figures:
            if self.caption is not None:
                self.end_caption()
            self.figures.pop()
        if tag not in INLINE_TAGS and self.caption is None:
            self.flush()

    def end_caption(self):
        text, self.caption = " ".join("".join(self.caption).split()), None
        media = self.figures[-1]
        for i in media:
            self.items[i][3] = text
        if not media and text:  # a figure without media: its caption is text
            self.items.append(["text", text, None, None])

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)

    def read(self, html: str) -> list[list]:
        self.feed(html)
        self.close()
        if self.caption is not None:
            self.end_caption()
        self.flush()
        return self.items


ITEMS = "array<struct<pos:int,nth:int,kind:string,text:string,ref:string,caption:string>>"


def interleave(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """row (a struct of the columns keep), page (the SHA-256 of the page, 32 bytes) and items for each row of pages.

    items: array of struct(pos, nth, kind, text, ref, caption) in document order, pos from 0; kind is text or media, nth numbers the media from 0 and
    is null for text. White space is folded; what is in scripts and styles is left out; a figure's caption goes to all media in it and is no text of
    its own.
    Results: null or empty html has no items; repeated rows are kept each; an empty table gives no rows. Columns may have any names.
    """
    C.short_batches(pages.sparkSession)
    given = pages.select(F.struct(*[F.col(c) for c in keep]).alias("row"), C.whole(html).alias("html")).select("row", F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("page"), "html")
    kind = given.schema["row"].dataType.simpleString()

    def run(batches):
        names = ("kind", "text", "ref", "caption")
        item = pa.struct([("pos", pa.int32()), ("nth", pa.int32()), *[(n, pa.string()) for n in names]])
        for b in batches:
            found = []
            for html in b.column("html"):
                nth = count()
                items = Reader().read(html.as_py())
                found.append([{"pos": i, "nth": next(nth) if x[0] == "media" else None, **dict(zip(names, x, strict=True))} for i, x in enumerate(items)])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("page"), pa.array(found, pa.list_(item))], ["row", "page", "items"])

    return given.mapInArrow(run, f"row {kind}, page binary, items {ITEMS}")


@C.tidy
def resolve(sequences: DataFrame, media: DataFrame, *, digest: str = "digest") -> DataFrame:
    """sequences (row, page, items) with media, a struct of the other columns of media, added to each item: that whose digest is the item's ref, or null.

    Of the items, the fields nth and ref are used; others stay, and may be left out or added. Refs meet media in a join on the digest; what they
    find is united by page, in the order of nth, and goes back, so items stay aligned. Equal digests in media are the same content: one of them is
    taken. Both sides that may have few distinct values on many rows meet a stored table, so that Spark can split them.
    Results: a null ref or digest finds nothing; an empty table gives no rows.
    """
    value = F.struct(*[F.col(c) for c in media.columns if c != digest]).alias("media")
    stock = media.where(F.col(digest).isNotNull()).select(F.col(digest).alias("ref"), value).groupBy("ref").agg(F.first("media").alias("media"))
    refs = sequences.select("page", F.explode("items").alias("i")).where("i.nth is not null").select("page", "i.nth", "i.ref")
    found = refs.join(C.stored(stock, "stock"), "ref", "left").groupBy("page").agg(F.sort_array(F.collect_set(F.struct("nth", "media"))).alias("found"))
    out = sequences.join(C.stored(found, "found"), "page", "left")
    fields = [f.name for f in sequences.schema["items"].dataType.elementType]
    items = F.transform("items", lambda i: F.struct(*[i[c].alias(c) for c in fields], F.get("found", i["nth"])["media"].alias("media")))
    return out.select("row", "page", items.alias("items"))


# ---- the store


def chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def to_png(payload: bytes) -> bytes:
    """Payload as a grey 8-bit PNG of WIDTH columns."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def from_png(png: bytes) -> np.ndarray:
    """Samples of such a PNG, row by row."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data = 8, b""
    while at < len(png):
        n, name = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] != zlib.crc32(name + body):
            raise ValueError("a chunk is damaged")
        if name == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not a plain grey PNG")
        elif name == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not read")
    return lines[:, 1:].reshape(-1)


def padded(data: Column) -> Column:
    """Binary data with bytes 0 up to a positive multiple of WIDTH."""
    n = F.octet_length(data)
    size = F.greatest(F.lit(WIDTH), F.ceil(n / WIDTH) * WIDTH).cast("int")
    return F.call_function("rpad", data, size, F.lit(b"\0"))


def store(payloads: DataFrame, where: str) -> None:
    """Write payloads (binary column payload, each of a positive multiple of WIDTH bytes) as digest, media, to the folder where.

    A partition writes equal payloads once, as far as it remembers them; describe() gives one row for each digest in any case.
    Results: a null payload is not stored; an empty table leaves a folder without rows. Other columns are ignored.
    """
    C.short_batches(payloads.sparkSession)

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            digests, media = [], []
            for p in b.column("payload"):
                data = p.as_buffer().to_pybytes()
                key = hashlib.sha256(data)
                if key.digest() in seen:
                    continue
                if len(seen) > 200_000:  # saves space only: equal payloads of other partitions are stored again in any case
                    seen.clear()
                seen.add(key.digest())
                digests.append(key.hexdigest())
                media.append(to_png(data))
            yield pa.RecordBatch.from_pydict({"digest": digests, "media": media}, pa.schema([("digest", pa.string()), ("media", pa.binary())]))

    payloads.select("payload").where("payload is not null").mapInArrow(run, "digest string, media binary").write.option("compression", "none").parquet(where)


DESCRIBED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(samples: np.ndarray) -> str:
    """Size, sum, distinct values, changes between neighbours, and counts by the upper four bits of the samples."""
    values = np.bincount(samples, minlength=256)
    changes = int((samples[1:] != samples[:-1]).sum())
    parts = [len(samples), int(samples.sum(dtype=np.int64)), int((values > 0).sum()), changes, *values.reshape(16, 16).sum(1).tolist()]
    return ":".join(map(str, parts))


def describe(spark: SparkSession, where: str) -> DataFrame:
    """What the stored media hold, read back from the folder where: one row for each digest. Results: a damaged medium raises an error; a folder without rows gives none."""
    C.short_batches(spark)

    def run(batches):
        for b in batches:
            out = {n.split()[0]: [] for n in DESCRIBED.split(", ")}
            for digest, media in zip(b.column("digest").to_pylist(), b.column("media"), strict=True):
                png = media.as_buffer().to_pybytes()
                samples = from_png(png)
                data = samples.tobytes()
                row = (digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), feature(samples))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out)

    return spark.read.schema("digest string, media binary").parquet(where).mapInArrow(run, DESCRIBED).dropDuplicates(["digest"])


def folder(spark: SparkSession) -> str:
    return f"{C.shared_dir(spark)}/lamella/media-{uuid.uuid4().hex}"

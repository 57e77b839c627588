"""Token-ID files with a minimal perfect hash index.

Format: a Parquet folder without compression. A row is a shard: the ids of
consecutive documents (payload, raw little-endian integers of the width in dtype),
where each document ends in them (ends), and an index from document keys to
documents. The index is a minimal perfect hash of the shard's distinct keys
(level_sizes, level_bits, and level_ranks: the ones before each BLOCK of bits);
the slot of a key stores the key's fingerprint and the first and number of its
documents (slots). first_key and last_key let a reader skip shards by Parquet
statistics; part, seq and base (ids before the shard in its part) order shards by
ascending key.

A shard holds SHARD_BYTES of ids, or one longer document, and each row has pages
of its own, which the page index finds by key. So keyed access reads the footer
and the pages of the shards that may have the key: a bounded number of bytes
beside the document itself, however many there are.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import kernel

U = np.uint64
#: Bytes of ids after which a shard ends; a longer document is a shard of its own.
SHARD_BYTES = 1 << 17
#: Texts are encoded in groups of about so many bytes: new segments are sorted into the known ones once for each.
GROUP_BYTES = 2 << 20
#: Bits of the index between two stored ranks.
BLOCK = 512
#: Parquet settings that give each row pages of its own and let row groups end after any row.
PAGES = {"compression": "none", "parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}
#: Segments whose ids a worker keeps, also from task to task: some 50 MB.
CACHE = 800_000
#: Stands for a null key in a file; no document may have it as its key.
NULL_KEY = -(2**63)

# ---- encoding


def segments_encode_alone(spec: dict) -> bool:
    """Whether the tokenizer of this JSON is one for which the segments of Encoder encode alike wherever they stand: a byte-level BPE with the usual split pattern, no normalizer, and added tokens that take no white space beside them."""
    pre = spec.get("pre_tokenizer") or {}
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    model = spec.get("model") or {}
    plain = (model.get("type") or "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    added = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens") or [])
    return level and plain and added and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")


class Encoder:
    """Encodes with the tokenizers library, asking it once for each distinct segment.

    A byte-level BPE never merges across the pieces its split pattern makes, and a piece always begins at a space that stands behind a
    character that is not white space. So texts are cut at such spaces into segments, which encode alike wherever they stand; new ones
    are encoded together, as one text, and the known lengths of tokens in bytes tell whose they are. Segments with the string of an added token
    are encoded alone. With a tokenizer of another kind, whole texts are encoded.

    as_text: strings of special tokens in a text are ordinary text; if not, they are what the library makes of them by itself, special tokens.
    """

    def __init__(self, path: str, as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = as_text
        spec = json.loads(self.tokenizer.to_str())
        self.by_segment = segments_encode_alone(spec)
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or []]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # a character stands for a byte
        self.forget()

    def forget(self) -> None:
        """Known segments: hashes, ascending, with the place and number of their ids; recent ones in a second, smaller table of the same kind."""
        none = (np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int32))
        self.old, self.recent = none, none
        self.ids = np.empty(1 << 16, np.uint16 if len(self.n_bytes) <= 1 << 16 else np.uint32)
        self.n_ids = 0

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each hash; the number is -1 for one that is not known."""
        at, size = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        for known, places, sizes in (self.old, self.recent):
            if len(known):
                i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[i] == hashes
                at[hit], size[hit] = places[i[hit]], sizes[i[hit]]
        return at, size

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.ids.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Add segments that are not known."""
        last, second = data[end - 1], data[np.maximum(end - 2, 0)]
        plain = (data[start] == 32) & ((last > 32) & (last < 127) | (last >= 128) & (second == 0xC3)) & (end - start > 1)
        raw = data.tobytes()
        if any(t in raw for t in self.added):
            plain &= [not any(t in raw[a:b] for t in self.added) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        pieces, sizes = [], []
        together = np.flatnonzero(plain)
        for i in range(0, len(together), 8192):
            some = together[i : i + 8192]
            joined = b"".join([raw[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)])
            pieces += self.encode_whole([joined.decode()])
            edges = np.searchsorted(np.cumsum(self.n_bytes[pieces[-1]]), np.cumsum(end[some] - start[some])) + 1
            sizes.append(np.diff(edges, prepend=0))
        alone = np.flatnonzero(~plain)
        for i in range(0, len(alone), 1024):
            some = alone[i : i + 1024]
            found = self.encode_whole([raw[a:b].decode() for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)])
            pieces += found
            sizes.append(np.array([len(x) for x in found], np.int64))
        sizes, ids = np.concatenate(sizes), np.concatenate(pieces)
        at = self.n_ids + np.cumsum(sizes) - sizes
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(ids)), self.ids.dtype)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)
        order = np.concatenate([together, alone])
        self.recent = self.merged(self.recent, (hashes[order], at, sizes.astype(np.int32)))
        if 5 * len(self.recent[0]) > len(self.old[0]):
            self.old, self.recent = self.merged(self.old, self.recent), tuple(x[:0] for x in self.recent)

    @staticmethod
    def merged(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(both[0])
        return tuple(x[order] for x in both)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in data one after another, and each text's number of ids."""
        if not len(data):
            return np.empty(0, self.ids.dtype), np.zeros(len(offsets) - 1, np.int64)
        if not self.by_segment:
            raw = data.tobytes()
            found = self.encode_whole([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        before = np.concatenate([[32], data[:-1]])
        second = np.concatenate([[32, 32], data[:-2]])[: len(data)]
        # Behind printable ASCII or a Latin letter; behind other characters, some of which are white space, segments go on.
        cut = (data == 32) & (((before > 32) & (before < 127)) | ((before >= 128) & (second == 0xC3)))
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        h = kernel.span_hashes(data, start, end)
        unique, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.old[0]) > CACHE:
            self.forget()
        at, size = self.place(unique)
        new = np.flatnonzero(size < 0)
        if len(new):
            self.learn(data, start[first[new]], end[first[new]], unique[new])
            at[new], size[new] = self.place(unique[new])
        at, size = at[which], size[which]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(at - (upto - size), size) + np.arange(upto[-1])]
        edges = np.concatenate([[0], upto])[np.searchsorted(start, offsets)]
        return ids, np.diff(edges)


_encoders: dict[tuple[str, bool], Encoder] = {}
kernel.keepers.append(_encoders.clear)


def encoder(path: str, as_text: bool = False) -> Encoder:
    if (path, as_text) not in _encoders:
        _encoders[path, as_text] = Encoder(path, as_text)
    return _encoders[path, as_text]


def lengths(docs: DataFrame, *, tokenizer: str, text: str = "text", keep: Sequence[str] | None = None, name: str = "n_tokens", as_text: bool = False) -> DataFrame:
    """The columns keep of docs (all if None), and a column name: the ids of each row's text, its end id included, as write() stores them.

    Results: a null or empty text has the end id alone; repeated rows are counted each; an empty table gives no rows. A column of docs with that name is replaced.
    """
    C.short_batches(docs.sparkSession)
    row = F.struct(*[F.col(c) for c in (docs.columns if keep is None else keep) if c != name])
    given = docs.select(row.alias("row"), F.col(text).alias("text"))

    def run(batches):
        coder = encoder(tokenizer, as_text)
        for b in batches:
            n = [np.empty(0, np.int64), *(coder.encode(data, offsets)[1] for _, _, data, offsets in kernel.groups(b.column("text"), GROUP_BYTES))]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.concatenate(n) + 1)], ["row", "n"])

    return given.mapInArrow(run, f"row {given.schema['row'].dataType.simpleString()}, n long").select("row.*", F.col("n").alias(name))


# ---- the index


def level_places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (kernel.mix(keys.view(U) + U((level + 1) * int(kernel.BASE) % 2**64)) % U(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of levels and their bits: a key's place is a 1 in the first level where no other key falls on it; the ones before it number its slot."""
    sizes, bits, level = [], [], 0
    while len(keys):
        size = max(64, 2 * len(keys))
        place = level_places(keys, level, size)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        keys = keys[~alone[place]]
        level += 1
    return np.array(sizes, np.int32), np.packbits(np.concatenate(bits)) if bits else np.empty(0, np.uint8)


def ranks_of(bits: np.ndarray) -> np.ndarray:
    """The ones before each BLOCK of packed bits."""
    ones = np.bitwise_count(bits).astype(np.int64)
    ones = np.concatenate([ones, np.zeros(-len(ones) % (BLOCK // 8), np.int64)]).reshape(-1, BLOCK // 8).sum(1)
    return (np.cumsum(ones) - ones).astype(np.int32)


def slots_of(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slot of each key; a key that is not in the index gets any slot, or -1. A key reads one bit for each level, and one BLOCK for its rank."""
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        place = base + level_places(keys[left], level, size)
        hit = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0
        for i, p in zip(left[hit].tolist(), place[hit].tolist(), strict=True):
            block = p // BLOCK
            before = bits[block * (BLOCK // 8) : p >> 3]
            out[i] = int(ranks[block]) + int(np.bitwise_count(before).sum()) + (int(bits[p >> 3]) >> (8 - (p & 7))).bit_count()
        left, base = left[~hit], base + size
    return out


SLOT = np.dtype([("fingerprint", "<u4"), ("first", "<u4"), ("count", "<u4")])


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (kernel.mix(keys.view(U) ^ U(0xA0761D6478BD642F)) >> U(32)).astype(np.uint32)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """level_sizes, level_bits, level_ranks and slots for ascending keys; NULL_KEY stays out."""
    distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
    there = distinct != NULL_KEY
    distinct, first, count = distinct[there], first[there], count[there]
    sizes, bits = build_hash(distinct)
    slots, ranks = np.zeros(len(distinct), SLOT), ranks_of(bits)
    at = slots_of(distinct, sizes, bits, ranks)
    slots["fingerprint"][at], slots["first"][at], slots["count"][at] = fingerprints(distinct), first, count
    return sizes, bits, ranks, slots


# ---- files

SHARD = "part int, seq int, base long, n_tokens long, n_docs int, first_key long, last_key long, dtype string, keys binary, level_sizes binary, level_bits binary, level_ranks binary, slots binary, ends binary, payload binary"


def shards(batches: Iterable[pa.RecordBatch], path: str, end_id: int, as_text: bool) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    coder = encoder(path, as_text)
    dtype = "<u2" if max(len(coder.n_bytes), end_id) <= 1 << 16 else "<u4"
    names = [x.split()[0] for x in SHARD.split(", ")]
    keys: list[int] = []
    pieces: list[np.ndarray] = []
    seq = base = held = 0

    def flush() -> pa.RecordBatch:
        nonlocal seq, base, held
        k = np.array(keys, np.int64)
        ids = np.concatenate(pieces)
        sizes, bits, ranks, slots = build_index(k)
        ends = np.cumsum([len(p) for p in pieces], dtype="<i8")
        row = [part, seq, base, len(ids), len(k), int(k[0]), int(k[-1]), dtype, k.tobytes(), sizes.tobytes(), bits.tobytes(), ranks.tobytes(), slots.tobytes(), ends.tobytes(), ids.astype(dtype).tobytes()]
        seq, base, held = seq + 1, base + len(ids), 0
        keys.clear()
        pieces.clear()
        return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], SHARD_SCHEMA)

    width = np.dtype(dtype).itemsize
    for b in batches:
        key = b.column("key").fill_null(NULL_KEY).to_numpy()
        for first, last, data, offsets in kernel.groups(b.column("text"), GROUP_BYTES):
            ids, counts = coder.encode(data, offsets)
            upto = np.cumsum(counts)
            for i in range(last - first):
                piece = np.append(ids[upto[i] - counts[i] : upto[i]], ids.dtype.type(end_id))
                if held and held + len(piece) * width > SHARD_BYTES:
                    yield flush()
                keys.append(int(key[first + i]))
                pieces.append(piece)
                held += len(piece) * width
    if keys:
        yield flush()


SHARD_SCHEMA = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SHARD.split(", "))])


def write(docs: DataFrame, where: str, *, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, as_text: bool = False) -> None:
    """Write the token files of docs to the folder where, in ascending order of key.

    Texts are dealt out by ranges of (key, hash of text), so repeated keys need not stand in one part, and each part writes its own files.
    as_text: see Encoder.
    Results: a null or empty text has the end id alone; null keys come first, are stored and read but not found by key; repeated rows are stored each,
    ordered by their text's hash; a key that is no integer fails the cast; an empty table leaves a folder without rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    C.short_batches(spark)
    given = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    given = given.repartitionByRange("key", "h").sortWithinPartitions("key", "h").select("key", "text")
    given.mapInArrow(lambda b: shards(b, tokenizer, end_id, as_text), SHARD).write.options(**PAGES).parquet(where)


def find(row: dict, keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(key, ids before it in the shard, its ids) of the documents of a shard that have one of keys, through the shard's index."""
    sizes, bits = np.frombuffer(row["level_sizes"], np.int32), np.frombuffer(row["level_bits"], np.uint8)
    slots, ends = np.frombuffer(row["slots"], SLOT), np.frombuffer(row["ends"], "<i8")
    ids = np.frombuffer(row["payload"], row["dtype"])
    at = slots_of(keys, sizes, bits, np.frombuffer(row["level_ranks"], np.int32))
    real = (at >= 0) & (keys != NULL_KEY)
    real[real] = slots["fingerprint"][at[real]] == fingerprints(keys[real])
    # A fingerprint tells nearly all absent keys; the key itself tells the rest.
    real[real] = np.frombuffer(row["keys"], np.int64)[slots["first"][at[real]]] == keys[real]
    for k, s in zip(keys[real].tolist(), at[real].tolist(), strict=True):
        for i in range(slots["first"][s], slots["first"][s] + slots["count"][s]):
            a = int(ends[i - 1]) if i else 0
            yield k, a, ids[a : ends[i]]


DOCUMENT = "doc_id long, part int, before long, n_tokens long, ids_crc32 long, ids array<int>"


def read(spark: SparkSession, where: str, keys: list[int] | None = None, *, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of stored documents, read through the index.

    keys: a short list of keys; pages of shards that cannot have them are skipped. None: all keys of each shard, and the documents without one.
    Results: a key that no document has gives no row, one that several have gives each; a document without a key has a null doc_id; a folder
    without rows gives none.
    """
    files = spark.read.schema(SHARD).parquet(where)
    C.short_batches(spark)
    totals = sorted(files.groupBy("part").agg(F.sum("n_tokens")).collect())  # one row for each part, not for each shard
    upto = np.cumsum([0, *(n for _, n in totals)]).tolist()
    parts = F.broadcast(spark.createDataFrame([(p, upto[i]) for i, (p, _) in enumerate(totals)], "part int, ids_before long"))
    if keys is not None:
        there = [(F.col("first_key") <= k) & (F.col("last_key") >= k) for k in keys]
        condition = F.lit(False)
        for x in there:
            condition = condition | x
        files = files.where(condition)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i] for n in b.schema.names}
                row = {n: v.as_buffer() if pa.types.is_binary(v.type) else v.as_py() for n, v in row.items()}
                stored = np.frombuffer(row["keys"], np.int64)
                found = list(find(row, np.array(keys, np.int64) if keys is not None else np.unique(stored)))
                if keys is None and stored[0] == NULL_KEY:
                    ends, all_ids = np.frombuffer(row["ends"], "<i8"), np.frombuffer(row["payload"], row["dtype"])
                    n = int((stored == NULL_KEY).sum())
                    found += [(None, a := int(ends[j - 1]) if j else 0, all_ids[a : ends[j]]) for j in range(n)]
                out = {
                    "doc_id": [k for k, _, _ in found],
                    "part": [row["part"]] * len(found),
                    "before": [row["base"] + a for _, a, _ in found],
                    "n_tokens": [len(x) for _, _, x in found],
                    "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for _, _, x in found],
                    "ids": [x.astype(np.int32) if ids else None for _, _, x in found],
                }
                yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    out = files.mapInArrow(run, DOCUMENT).join(parts, "part")
    return out.select("doc_id", (F.col("ids_before") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def folder(spark: SparkSession) -> str:
    return f"{C.shared_dir(spark)}/lamella/tokens-{uuid.uuid4().hex}"

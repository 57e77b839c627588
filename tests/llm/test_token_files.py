"""Token files: ids against the tokenizers library, the index against its keys, and the round trip."""

import zlib

import numpy as np
import public_tokenizers
from lamella.llm import token_files as T
from tokenizers import Tokenizer

from . import data

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b   c", " lead", "tail  ", "a  b", "x　 y é é  ñ", "don't we'll I'M", "a\n b\n\n  c\t d", "1 22 333 !!! ?  \n", "emoji 😀 😀x", "<|endoftext|> a <|endoftext|>", "\u0085 x", "\x00 \x1c \x7f b", "é", " ", "  "]


def ids_of(texts, as_text=False, path=PATH):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = as_text
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_hash_is_minimal_and_perfect():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 20000):
        keys = np.unique(r.integers(-(2**62), 2**62, n))
        sizes, bits = T.build_hash(keys)
        assert sorted(T.slots_of(keys, sizes, bits, T.ranks_of(bits))) == list(range(len(keys)))


def test_absent_keys_are_not_found(monkeypatch):
    """Even if all fingerprints agree."""
    monkeypatch.setattr(T, "fingerprints", lambda keys: np.zeros(len(keys), np.uint32))
    keys = np.arange(0, 400, 2)
    sizes, bits, ranks, slots = T.build_index(keys)
    row = {"level_sizes": sizes.tobytes(), "level_bits": bits.tobytes(), "level_ranks": ranks.tobytes(), "slots": slots.tobytes(), "keys": keys.tobytes()}
    row |= {"ends": np.arange(1, 201).tobytes(), "payload": np.arange(200, dtype="<u2").tobytes(), "dtype": "<u2"}
    assert list(T.find(row, np.arange(1, 400, 2))) == []
    assert [(k, a, x.tolist()) for k, a, x in T.find(row, np.array([6, 398]))] == [(6, 3, [3]), (398, 199, [199])]


def test_keyed_access_reads_little(spark, tmp_path):
    """A lookup reads the pages of one shard, not the file."""
    import pyarrow.parquet as pq

    monkey = [(i, f"{i} " * 3000) for i in range(200)]
    where = f"{tmp_path}/t"
    T.write(spark.createDataFrame(monkey, "doc_id long, text string").coalesce(1), f"file://{where}", tokenizer=PATH)
    import glob

    size = 0
    for f in glob.glob(f"{where}/*.parquet"):
        meta = pq.read_metadata(f)
        for g in range(meta.num_row_groups):
            column = {meta.schema.column(c).name: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert column["payload"].compression == "UNCOMPRESSED" and column["first_key"].has_offset_index and column["first_key"].has_column_index
            size += column["payload"].total_compressed_size
    assert size > 5 * T.SHARD_BYTES
    (got,) = T.read(spark, f"file://{where}", [123]).collect()
    assert [list(got["ids"])] == [[*x, 0] for x in ids_of([monkey[123][1]])]


def test_write_and_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SHARD_BYTES", 3000)
    rows = [(r[0], r[1]) for r in data.rows()] + [(900 + i, t) for i, t in enumerate(ODD)] + [(-5, "negative"), (None, "no key"), (901, "a second text of one key")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, keys string").repartition(4)
    where = f"file://{tmp_path}/t"
    T.write(frame, where, tokenizer=PATH)
    got = T.read(spark, where).collect()
    want = sorted(((k is not None, k or 0), [*x, 0]) for (k, _), x in zip(rows, ids_of([t for _, t in rows]), strict=True))
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), list(r["ids"])) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    some = T.read(spark, where, [3, 901, 10**9, -5]).collect()
    assert sorted(r["doc_id"] for r in some) == [-5, 3, 3, 3, 901, 901]
    T.write(frame.limit(0), f"file://{tmp_path}/e", tokenizer=PATH)
    assert T.read(spark, f"file://{tmp_path}/e").count() == 0


def test_cache_starts_anew(monkeypatch):
    from lamella.llm import kernel
    import pyarrow as pa

    monkeypatch.setattr(T, "CACHE", 50)
    texts = data.texts() + ODD
    for as_text in (False, True):
        coder = T.Encoder(PATH, as_text)
        assert coder.by_segment
        for _ in range(2):
            for t, want in zip(texts, ids_of(texts, as_text), strict=True):
                for _, _, d, o in kernel.groups(pa.array([t])):
                    assert coder.encode(d, o)[0].tolist() == want
    assert ids_of(["x <|endoftext|> y"]) != ids_of(["x <|endoftext|> y"], True)


def test_other_tokenizers_encode_whole_texts():
    import pyarrow as pa
    from lamella.llm import kernel

    path = public_tokenizers.path("word_bpe_49k.json")
    coder = T.Encoder(path)
    assert not coder.by_segment
    texts = [t for t in data.texts() + ODD if t]
    got = [coder.encode(d, o)[0].tolist() for t in texts for _, _, d, o in kernel.groups(pa.array([t]))]
    assert got == ids_of(texts, path=path)


def test_lengths(spark):
    texts = [*data.texts(), *ODD, None]
    rows = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = T.lengths(rows, tokenizer=PATH)
    assert got.columns == ["doc_id", "text", "n_tokens"]
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {i: len(x) + 1 for i, x in enumerate(ids_of(texts))}
    assert T.lengths(rows.limit(0), tokenizer=PATH).count() == 0

"""Files, tables, the command line, slab streams and the entry module."""

import io

import numpy as np
import pytest
from lamella import cli
from lamella.operators import aggregates, structure
from lamella.sources import files, stream
from lamella.streaming import slabs
from lamella.volume import FormatError, LabelVolume, from_table

A = np.kron(np.random.default_rng(2).integers(0, 5, (3, 4, 2)), np.ones((3, 2, 2), int)).astype(np.uint16)


@pytest.mark.parametrize("name", ["v.ckl", "v.ckl.gz", "v.ckl.xz", "v.ckl.lzma", "v.npy", "v.npy.gz"])
def test_save_and_load(spark, tmp_path, name):
    v = LabelVolume.from_numpy(spark, A)
    path = tmp_path / name
    files.save(v, path)
    assert (files.load_any(spark, path).to_numpy() == A).all()
    if "ckl" in name:
        assert files.load_num_labels(path) == len(np.unique(A))
        assert files.load_header(path).sx == A.shape[0]
        assert (files.aload(spark, io.BytesIO(files.bload(path))) == A).all()


def test_numpy_in_blocks(spark, tmp_path):
    v = LabelVolume.from_numpy(spark, A)
    files.save_numpy(v, tmp_path / "b.npy")
    assert (np.load(tmp_path / "b.npy") == A).all()


def test_unknown_formats(spark, tmp_path):
    v = LabelVolume.from_numpy(spark, A)
    for name in ("v.xyz", "v"):
        with pytest.raises(FormatError):
            files.save(v, tmp_path / name)
    (tmp_path / "bad.ckl").write_bytes(b"nothing")
    with pytest.raises(FormatError):
        files.load(spark, tmp_path / "bad.ckl")


def test_tables(spark, tmp_path):
    v = LabelVolume.from_numpy(spark, A)
    for i, order in enumerate((0, 2)):
        files.save(v, tmp_path / f"{i}.ckl", context_order=order)
    found = files.read_streams(spark, f"file://{tmp_path}/*.ckl")
    assert found.count() == 2 * A.size
    for name in {r["path"] for r in found.select("path").distinct().collect()}:
        assert structure.array_equal(from_table(found.where(found.path == name), A.shape), v)
    files.write_table(v, f"file://{tmp_path}/t")
    assert structure.array_equal(from_table(files.read_table(spark, f"file://{tmp_path}/t")), v)
    plan = files.read_table(spark, f"file://{tmp_path}/t").where("z = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(z" in plan
    files.write_sidecar(v, f"file://{tmp_path}/s")
    assert sorted(files.read_sidecar(spark, f"file://{tmp_path}/s").collect()) == sorted(aggregates.label_stats(v).collect())


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "a.npy")
    np.save(path, A)
    assert cli.main([path, "-m", "1"]) == 0
    packed = str(tmp_path / "a.ckl")
    assert cli.main(["-T", packed]) == 0 and cli.main(["-i", packed]) == 0 and cli.main(["-l", packed]) == 0 and cli.main(["-M", packed]) == 0
    assert " ".join(map(str, np.unique(A))) in capsys.readouterr().out
    (tmp_path / "a.npy").unlink()
    assert cli.main(["-d", packed]) == 0 and (np.load(path) == A).all()
    raw = bytearray((tmp_path / "a.ckl").read_bytes())
    raw[-1] ^= 1
    (tmp_path / "a.ckl").write_bytes(raw)
    assert cli.main(["-T", packed]) == 1 and cli.main(["-d", str(tmp_path / "none.ckl")]) == 1
    assert stream.check(bytes(raw))["bad_z"] == [A.shape[2] - 1]


def test_slabs(spark, tmp_path):
    v = LabelVolume.from_numpy(spark, A)
    for z in range(A.shape[2]):
        v.voxels.where(f"z = {z}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    q = slabs.running_stats(slabs.read_slabs(spark, f"file://{tmp_path}/in", 1)).writeStream.outputMode("complete").format("memory").queryName("slabs").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("slabs").collect()) == sorted(tuple(r) for r in aggregates.label_stats(v).collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

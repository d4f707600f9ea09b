import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, LessThan

from lodestone.sources import tensor_files as TF
from lodestone.sources import tensors as T

LONG = f"{TF.PREFIX}.layers.%d.{TF.SEGMENT}.%s.%s.weight"


def folder(path, name, layers, seed=0):
    r = np.random.default_rng(seed)
    tensors = {LONG % (i, m, p): r.normal(size=(4, 6) if p == "lora_A" else (6, 4)).astype(np.float32) for i in range(layers) for m in ("q_proj", "v_proj") for p in ("lora_A", "lora_B")}
    (path / name).mkdir(parents=True)
    (path / name / TF.TENSOR_FILE).write_bytes(T.packed_file(tensors, {"adapter_config": '{"r": 4}'}))
    (path / name / TF.CONFIG_FILE).write_text('{"r": 4, "lora_alpha": 8.0}')
    return tensors


def test_folders_round_trip_and_prune(spark, tmp_path):
    want = {n: folder(tmp_path, n, k, k) for n, k in (("one", 3), ("two", 12))}
    (tmp_path / "unfinished").mkdir()
    (tmp_path / "unfinished" / TF.TENSOR_FILE).write_bytes(T.packed_file({"layers.0.q_proj.lora_A.weight": np.ones((2, 2))}))
    (tmp_path / "two" / f".{TF.TENSOR_FILE}.part").write_bytes(b"half")
    got = TF.read_adapters(spark, str(tmp_path), "r int, lora_alpha double")
    rows = got.collect()
    assert {(r.folder, r.name) for r in rows} == {(f, n) for f, ts in want.items() for n in ts}
    assert all(np.array_equal(np.reshape(r.data, r.shape), want[r.folder][r.name].astype(float)) and r.config.r == 4 for r in rows)
    few = got.where("layer >= 10 AND module = 'v_proj' AND folder = 'two'")
    assert sorted((r.layer, r.part) for r in few.collect()) == [(i, p) for i in (10, 11) for p in ("lora_A", "lora_B")]
    assert TF.read_tensors(spark, str(tmp_path), data="false").where("layer = 1").agg(F.count("data"), F.count("*")).first()[:] == (0, 8)


@pytest.mark.parametrize("slice_bytes", [100, 700, 1 << 20])
def test_every_tensor_is_in_one_slice(spark, tmp_path, slice_bytes):
    want = folder(tmp_path, "a", 5)
    (tmp_path / "b.safetensors").write_bytes(T.packed_file({"empty": np.zeros((0, 3)), "last": np.zeros((0,))}))
    got = [(r.path.rsplit("/", 1)[-1], r.name) for r in TF.read_tensors(spark, f"file://{tmp_path}", slice_bytes=slice_bytes).collect()]
    assert sorted(got) == sorted([(TF.TENSOR_FILE, n) for n in want] + [("b.safetensors", "empty"), ("b.safetensors", "last")])
    assert TF.read_tensors(spark, str(tmp_path), slice_bytes=slice_bytes).rdd.getNumPartitions() == (1 if slice_bytes > 5000 else sum(-(-f.stat().st_size // slice_bytes) for f in tmp_path.rglob("*.safetensors") if f.stat().st_size > slice_bytes) + (slice_bytes == 700))


def test_pruned_bytes_are_not_read(tmp_path, monkeypatch):
    folder(tmp_path, "a", 40)
    reader = TF.TensorReader({"path": str(tmp_path)})
    rest = list(reader.pushFilters([LessThan(("layer",), 2), EqualTo(("module",), "q_proj"), IsNotNull(("layer",)), In(("part",), ("lora_A",))]))
    assert [type(f) for f in rest] == [IsNotNull]
    ranges = []
    real = TF.opened

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def size(self):
            return self.f.size()

        def read_at(self, n, at):
            ranges.append((at, n))
            return self.f.read_at(n, at)

    class System:
        def __init__(self, system):
            self.get_file_info, self.system = system.get_file_info, system

        def open_input_file(self, path):
            return Counted(self.system.open_input_file(path))

    monkeypatch.setattr(TF, "opened", lambda p: (System(real(p)[0]), real(p)[1]))
    rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert sorted(r["layer"] for r in rows) == [0, 1] and all(len(r["data"]) == 24 for r in rows)
    assert sum(n for _, n in ranges[2:]) == 2 * 24 * 4 and len(ranges) == 4  # the header's length, the header, two tensors


def test_dtypes_and_broken_files(spark, tmp_path):
    parts = {"a": ("F64", np.array([1.5, -2.0])), "b": ("F16", np.array([0.5], "<f2")), "c": ("BF16", np.array([0x3FC0], "<u2")), "d": ("I8", np.array([-3], "i1")), "e": ("BOOL", np.array([True, False]))}
    head, data = {}, b""
    for k, (kind, x) in parts.items():
        head[k] = {"dtype": kind, "shape": [len(x)], "data_offsets": [len(data), len(data) + x.nbytes]}
        data += x.tobytes()
    text = json.dumps(head).encode()
    (tmp_path / "x.safetensors").write_bytes(len(text).to_bytes(8, "little") + text + data)
    assert {r.name: r.data for r in TF.read_tensors(spark, str(tmp_path)).collect()} == {"a": [1.5, -2.0], "b": [0.5], "c": [1.5], "d": [-3.0], "e": [1.0, 0.0]}
    for bad in (b"", b"\xff" * 20, len(text).to_bytes(8, "little") + text + data[:-1]):
        (tmp_path / "x.safetensors").write_bytes(bad)
        with pytest.raises(Exception, match="header|tile|left over|short"):
            TF.read_tensors(spark, str(tmp_path)).collect()


def test_writing_folders(spark, tmp_path):
    rows = [("f1", LONG % (0, "q_proj", "lora_A"), [2, 2], [1.0, 2.0, 3.0, 4.0]), ("f2", "layers.0.q_proj.lora_B.weight", [1], [5.0])]
    t = spark.createDataFrame(rows, "folder string, name string, shape array<int>, data array<double>")
    c = spark.createDataFrame([("f1", '{"r": 2}'), ("f2", '{"r": 1}')], "folder string, config string")
    first = sorted(map(tuple, TF.write_adapters(t, c, str(tmp_path)).collect()))
    assert first == sorted(map(tuple, TF.write_adapters(t, c, str(tmp_path)).collect())) and [r[:2] for r in first] == [("f1", 1), ("f2", 1)]
    assert sorted(p.name for p in (tmp_path / "f1").iterdir()) == [TF.CONFIG_FILE, TF.TENSOR_FILE]
    got = {r.folder: (r.config.r, r.data, r.module) for r in TF.read_adapters(spark, str(tmp_path), "r int").collect()}
    assert got == {"f1": (2, [1.0, 2.0, 3.0, 4.0], "q_proj"), "f2": (1, [5.0], "q_proj")}
    with pytest.raises(Exception, match="one configuration"):
        TF.write_adapters(t, c.where("folder = 'f1'"), str(tmp_path)).collect()


def test_names_and_structure(spark):
    t = lambda names: spark.createDataFrame([("f", n, [8, 64] if "lora_A" in n else [64, 8]) for n in names], "f string, name string, shape array<int>")
    both = [LONG % (3, "k_proj", "lora_A"), "layers.0.o_proj.lora_B.weight"]
    assert [r.name for r in TF.renamed(t(both), ["f"], "name", "short").orderBy("name").collect()] == ["layers.0.o_proj.lora_B.weight", "layers.3.k_proj.lora_A.weight"]
    assert [r.name for r in TF.renamed(t(both[1:]), ["f"], "name", "long").collect()] == [LONG % (0, "o_proj", "lora_B")]
    with pytest.raises(Exception, match="several tensors would be named"):
        TF.renamed(t([LONG % (3, "k_proj", "lora_A"), "layers.3.k_proj.lora_A.weight"]), ["f"], "name", "short").collect()
    with pytest.raises(Exception, match="unrecognised tensor"):
        TF.renamed(t(["layers.3.k_proj.weight"]), ["f"], "name", "short").collect()
    names = [f"layers.{i}.q_proj.{p}.weight" for i in (0, 2) for p in ("lora_A", "lora_B")]
    assert [tuple(r)[1:] for r in TF.described(t(names), ["f"]).collect()] == [(2, ["q_proj"], 8, 4, ["missing_layers"])]
    odd = t(names[:2]).unionByName(spark.createDataFrame([("f", "layers.1.q_proj.lora_A.weight", [16])], "f string, name string, shape array<int>"))
    assert TF.described(odd, ["f"]).first().problems == ["not_2d", "mixed_rank", "count"]

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.sources import files as S
from lodestone.sources import tensors as T


def test_jsonl_round_trip_and_failures(spark, tmp_path):
    rows = spark.createDataFrame([("t1", None, "x"), ("t2", "y", None)], schemas.SAMPLE)
    S.write_jsonl(rows, f"{tmp_path}/s")
    back = S.read_jsonl(spark, f"{tmp_path}/s", schemas.SAMPLE, ["task_id"])
    assert sorted(map(str, S.samples(back).select("task_id", "sample").collect())) == ["Row(task_id='t1', sample='x')", "Row(task_id='t2', sample='y')"]
    (tmp_path / "bad.jsonl").write_text('{"task_id": "a"}\n\n{"task_id": \n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        S.read_jsonl(spark, f"{tmp_path}/bad.jsonl", schemas.SAMPLE).collect()
    (tmp_path / "null.jsonl").write_text('{"solution": "x"}\n\n')
    with pytest.raises(Exception, match="missing task_id"):
        S.read_jsonl(spark, f"{tmp_path}/null.jsonl", schemas.SAMPLE, ["task_id"]).collect()


def test_logs_append(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "n int")
    S.append_log(one, f"{tmp_path}/log")
    S.append_log(one, f"{tmp_path}/log")
    assert S.read_jsonl(spark, f"{tmp_path}/log", "n int").count() == 2


def test_discovery_and_decoding(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.py").write_bytes(b"one\r\ntwo")
    (tmp_path / "a/y.py").write_bytes(b"\xff\xfe")
    (tmp_path / "z.py").write_bytes(b"a\x00b")
    (tmp_path / "z.txt").write_text("no")
    got = {r.path: r.t for r in S.discover(spark, str(tmp_path)).select("path", S.decoded(F.col("content")).alias("t")).collect()}
    assert got == {"a/b/x.py": "one\ntwo", "a/y.py": None, "z.py": None}


def test_manifests_and_nested_maps(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"manifest_version": "1", "seed": 7,\n "shards": [{"client_id": "c0", "num_files": 3}, {"client_id": "c1"}]}')
    m = S.read_document(spark, f"{tmp_path}/m.json", schemas.PARTITION_MANIFEST)
    assert sorted(r.client_id for r in S.shards(m).collect()) == ["c0", "c1"]
    (tmp_path / "r.json").write_text('{"round": 1, "clusters": {"web": {"n": 1}, "sci": {"n": 2}}}')
    r = S.read_document(spark, f"{tmp_path}/r.json", "round int, clusters map<string,struct<n:int>>, clients map<string,struct<n:int>>")
    assert sorted((x.cluster, x.n) for x in S.nested(r.drop("clients"), "clusters", "cluster").collect()) == [("sci", 2), ("web", 1)]
    with pytest.raises(Exception, match="missing clients"):
        S.nested(r, "clients", "client").collect()


def test_tasks_by_suffix(spark):
    tasks = spark.createDataFrame([(t,) for t in ("HE/10", "HE/9", "HE/x", "other")], "task_id string")
    assert [r.task_id for r in S.first_tasks(tasks, 3).collect()] == ["HE/9", "HE/10", "HE/x"]


def test_tensor_files(spark):
    data = T.to_file({"layers.0.q_proj.lora_A.weight": np.arange(6).reshape(2, 3), "layers.0.q_proj.lora_B.weight": np.ones((3, 2))})
    assert T.is_valid(data) and not T.is_valid(data[:-1]) and not T.is_valid(b"\xff" * 20) and not T.is_valid(b"")
    rows = T.tensor_rows(spark.createDataFrame([("a", bytearray(data))], "k string, c binary"), "k", "c")
    layer, module, part = T.key_parts(F.col("name"))
    got = sorted(map(tuple, rows.select(layer, module, part, "shape", F.size("data")).collect()))
    assert got == [(0, "q_proj", "A", [2, 3], 6), (0, "q_proj", "B", [3, 2], 6)]


def test_base64_sizes(spark):
    rows = [(base64.b64encode(b"\x00" * 24).decode(), [2, 3]), (base64.b64encode(b"\x00" * 20).decode(), [2, 3])]
    assert [r[0] for r in spark.createDataFrame(rows, "d string, s array<int>").select(T.base64_fits(F.col("d"), F.col("s"))).collect()] == [True, False]


@pytest.mark.parametrize("name", [n for n in dir(schemas) if n.isupper()])
def test_schemas_parse(spark, name):
    ddl = getattr(schemas, name)
    assert spark.createDataFrame([], ddl if not ddl.startswith("struct<") else f"x {ddl}").columns

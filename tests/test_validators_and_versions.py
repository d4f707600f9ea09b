import dataclasses
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import kernels as K
from lodestone.operators import lowrank as L
from lodestone.operators import validators as V
from lodestone.operators.ordering import hash_bucket, running
from lodestone.sources import files as S
from lodestone.sources import scratch
from lodestone.sources import tensors as T
from lodestone.sources import versions as R

RNG = np.random.default_rng(11)


def test_empty_source_is_an_error(spark):
    some, none = spark.range(3), spark.range(0)
    assert sorted((r.origin, r.id) for r in V.union_of({"a": some, "b": some}).collect()) == [(o, i) for o in "ab" for i in range(3)]
    with pytest.raises(Exception, match="source b is empty"):
        V.union_of({"a": some, "b": none}).collect()
    with pytest.raises(Exception, match="source b is empty"):
        V.union_of({"a": some, "b": none}).groupBy("origin").count().collect()


def test_upload_shapes(spark):
    ok = {"client_id": "c", "round_id": 1, "rank": 4, "target_modules": []}
    deep = {"client_id": "c", "round": 1, "hparams": {"rank": 4, "target_modules": ["q"]}}
    cases = [
        (json.dumps(ok), []), (json.dumps(deep), []), (json.dumps(ok | {"rank": 1.5}), ["rank must be a integer"]), (json.dumps(ok | {"target_modules": ["q", 1]}), ["target_modules must be a list of strings"]),
        (json.dumps({k: v for k, v in ok.items() if k != "client_id"}), ["missing client_id"]), (json.dumps(deep | {"hparams": {}}), ["missing rank", "missing target_modules"]), ("[]", ["not an object"]), ("{", ["not an object"]), (None, ["not an object"]),
    ]
    rows = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(cases)], "i int, d string")
    got = {r.i: r.p for r in rows.select("i", V.upload_problems(F.col("d")).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_module_sets(spark):
    rows = [("a", "cluster", "q"), ("a", "cluster", "v"), ("a", "client", "q"), ("b", "client", "q"), ("c", "cluster", "q"), ("c", "client", "q")]
    got = {r.k: (r.only_cluster, r.only_client) for r in V.module_differences(spark.createDataFrame(rows, "k string, part string, m string"), ["k"], "part", "m").collect()}
    assert got == {"a": (["v"], []), "b": ([], []), "c": ([], [])}


def test_versions_are_immutable_and_checked(spark, tmp_path):
    root = str(tmp_path)
    assert [R.save(spark, root, "web", p, "cluster") for p in (b"one", b"two")] == [1, 2] and R.save(spark, root, "sci", b"x", "client") == 1
    assert R.load(spark, root, "web") == b"two" and R.load(spark, root, "web", 1, "cluster") == b"one"
    with pytest.raises(KeyError):
        R.load(spark, root, "web", 3)
    with pytest.raises(ValueError, match="is a cluster"):
        R.load(spark, root, "web", 1, "client")
    assert sorted((r.name, r.version) for r in R.latest(R.scan(spark, root)).collect()) == [("sci", 1), ("web", 2)]
    (tmp_path / "name=web/version=3").mkdir()  # what a dead attempt has left
    assert R.version_numbers(spark, root, "web") == [1, 2] and R.save(spark, root, "web", b"three", "cluster") == 3
    spark.createDataFrame([("cluster", None, "0" * 64, 3, bytearray(b"bad"))], R.ROW).write.mode("overwrite").parquet(f"{root}/name=web/version=2")
    with pytest.raises(ValueError, match="digest"):
        R.load(spark, root, "web", 2)
    assert [(r.name, r.version) for r in R.broken(R.scan(spark, root)).collect()] == [("web", 2)]


def test_documents_and_runs(spark, tmp_path):
    for exp, run, n in (("e1", "a", 1), ("e1", "b", 2), ("e2", "a", 3)):
        for _ in range(2):  # replacing a document
            S.write_document(spark, f"{tmp_path}/{exp}/{run}/run.json", {"n": n})
    assert [(r.path, r.n) for r in S.read_runs(spark, str(tmp_path), "n int").collect()] == [("e1/a", 1), ("e1/b", 2), ("e2/a", 3)]
    assert [r.n for r in S.read_runs(spark, str(tmp_path), "n int", "e1").collect()] == [1, 2]


def test_discovery_of_subpaths_and_order(spark, tmp_path):
    for p in ("a/b.py", "a/b/c.py", "a-b/x.py", "z/y.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    assert [r.path for r in S.sorted_texts(spark, str(tmp_path)).collect()] == ["a/b/c.py", "a/b.py", "a-b/x.py", "z/y.py"]
    assert sorted(r.path for r in S.discover(spark, str(tmp_path), subpaths=["a", "z"]).select("path").collect()) == ["a/b.py", "a/b/c.py", "z/y.py"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        S.discover(spark, str(tmp_path), subpaths=["no"], missing="error").collect()


@dataclasses.dataclass
class Inner:
    n: int = 3


@dataclasses.dataclass
class Outer:
    name: str
    inner: Inner = dataclasses.field(default_factory=Inner)


def test_settings_and_run_ids():
    assert S.load_config('{"name": "${WHO}-${X:-y}", "inner": {"n": 4}}', Outer, {"WHO": 'a"b'}) == Outer('a"b-y', Inner(4))
    for bad, error in (('{"name": "${NO}"}', KeyError), ('{"inner": {}}', ValueError), ('{"name": "a", "x": 1}', ValueError)):
        with pytest.raises(error):
            S.load_config(bad, Outer, {})
    assert S.run_id({"a": 1, "seed": 2}, ("seed",)) == S.run_id({"seed": 3, "a": 1}, ("seed",)) and len(S.run_id({})) == 10


def test_round_trip_differences(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "b": 2}',), ('{"a": 1, "b": null}',)], "j string")
    assert [(r.j, r.lost) for r in S.round_trip_differences(rows, "j", "a int").collect()] == [('{"a": 1, "b": 2}', ["b"])]


def test_tasks_fall_back_and_must_exist(spark, tmp_path):
    S.write_jsonl(spark.createDataFrame([("t1",)], "task_id string"), f"{tmp_path}/two")
    assert [r.task_id for r in S.tasks(spark, [f"{tmp_path}/one", f"{tmp_path}/two"], "task_id string").collect()] == ["t1"]
    with pytest.raises(FileNotFoundError):
        S.tasks(spark, [f"{tmp_path}/one"], "task_id string")
    (tmp_path / "empty.jsonl").write_text("")
    with pytest.raises(Exception, match="source tasks is empty"):
        S.tasks(spark, [f"{tmp_path}/empty.jsonl"], "task_id string").collect()


def test_adapter_directory_and_bad_headers(spark, tmp_path):
    t = {"layers.0.q.lora_A.weight": np.ones((2, 3))}
    T.write_adapter(spark, f"{tmp_path}/a", {"r": 2}, t)
    row = T.read_adapter(spark, f"{tmp_path}/a", "r int").first()
    assert row.config.r == 2 and row["shape"] == [2, 3] and row.data == [1.0] * 6
    good = T.to_file(t)
    n = int.from_bytes(good[:8], "little")
    for old, new in ((b'"shape":[2,3]', b'"shape":[-2,-3]'), (b'"data_offsets":[0,24]', b'"data_offsets":[0.0,24.0]')):
        head = good[8 : 8 + n].replace(old, new)
        assert not T.is_valid(len(head).to_bytes(8, "little") + head + good[8 + n :])
    assert not T.is_valid((2).to_bytes(8, "little") + b"[]")


def test_running_sums_in_ranges(spark):
    rows = [(g, int(x), int(s)) for g in ("a", "b", None) for x, s in zip(RNG.permutation(200), RNG.integers(0, 5, 200), strict=True)]
    df = spark.createDataFrame(rows, "g string, x int, s int")
    got = {(r.g, r.x): (r["_at"], r["_n"]) for r in running(df, ["g"], ["x"], F.floor(F.col("x") / 7), F.col("s")).collect()}
    for g, x, _ in rows:
        assert got[g, x] == (sum(s for h, y, s in rows if h == g and y < x), sum(s for h, _, s in rows if h == g))
    hashed = df.withColumn("h", F.sha2(F.col("x").cast("string"), 256))
    placed = running(hashed, ["g"], ["h"], hash_bucket(F.col("h"))).where("g = 'a'").orderBy("h").collect()
    assert [r["_at"] for r in placed] == list(range(200))


def test_scratch_folder_is_shared(spark):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)
    assert scratch.shared_dir(spark)


def test_update_gram_subtracts_the_start(spark):
    f = [(RNG.normal(size=(2, 4)), RNG.normal(size=(3, 2))) for _ in range(5)]
    rows = [(m, i, 2, a.ravel().tolist(), b.ravel().tolist()) for m in (0, 1) for i, (a, b) in enumerate(f[:4])]
    starts = spark.createDataFrame([(1, 2, f[4][0].ravel().tolist(), f[4][1].ravel().tolist())], "module int, start_rank int, start_a array<double>, start_b array<double>")
    df = spark.createDataFrame(rows, "module int, adapter int, rank int, a array<double>, b array<double>")
    plain = [(b @ a).ravel() for a, b in f]
    for r in L.factor_gram(df, ["module"], starts).collect():
        assert np.isclose(r.dot, plain[r.i] @ plain[r.j] + (plain[r.i] - plain[4]) @ (plain[r.j] - plain[4]))


def test_recluster_moves_or_falls_back(spark):
    x = np.repeat(RNG.normal(size=(2, 8)), 3, 0) + 0.01 * RNG.normal(size=(6, 8))
    gram = spark.createDataFrame([(i, j, float(x[i] @ x[j])) for i in range(6) for j in range(i, 6)], "i int, j int, dot double")
    before = spark.createDataFrame([(i, int(i > 3)) for i in range(6)], "adapter int, before int")
    got = {r.id: (r.after, r.moved, r.method) for r in K.recluster(gram, before, 2).collect()}
    assert got == {i: (int(i > 2), i == 3, "dynamic") for i in range(6)}
    for other, reason in ((K.recluster(gram, before.where("adapter > 0"), 2), "unassigned client"), (K.recluster(gram, before, 7), "too few clients"), (K.recluster(gram, before, 2, min_size=4), "degenerate clusters"), (K.recluster(gram, before, 2, min_gap=3.0), "weak separation")):
        rows = other.collect()
        assert {r.reason for r in rows} == {reason} and not any(r.moved for r in rows) and all(r.before == r.after for r in rows)


def test_rows_keep_their_errors(spark):
    def half(r):
        return {"i": r["i"], "h": 6 // r["i"]}

    got = sorted((r.i is None, r.i, r.h, r.error) for r in K.apply_rows(spark.createDataFrame([(0,), (1,), (2,)], "i long"), half, "i bigint, h bigint").collect())
    assert [g[:3] for g in got[:2]] == [(False, 1, 6), (False, 2, 3)] and got[2][3].startswith("ZeroDivisionError")


def test_places_of_paths_read_their_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def there(path):
        read.add(1)
        return path is not None

    paths = [f"{a}/{b}.py" for a in ("a", "a-b", "a/b") for b in range(20)]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").where(there("path"))
    got = {r.path: r.place for r in S.numbered_paths(rows, "path", "place").collect()}
    assert got == {p: i for i, p in enumerate(sorted(paths, key=lambda p: p.split("/")))}
    assert read.value == len(paths)

import hashlib
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import kernels as K
from lodestone.operators import ordering as O
from lodestone.operators import rounds as R
from lodestone.operators import similarity as M
from lodestone.sources import files as S
from lodestone.sources import packs as P


def some_files(spark, n=60):
    rows = [(f"d{i % 5}/f{i}.txt", bytearray(f"file {i}\n".encode() * (i * 37 % 200))) for i in range(n)] + [("empty", bytearray()), ("none", None), ("long/" + "x" * 150, bytearray(b"\x00\xff"))]
    return rows, spark.createDataFrame(rows, "path string, content binary").repartition(4)


@pytest.mark.parametrize("archives", [1, 5])
def test_packs_round_trip(spark, tmp_path, archives):
    rows, df = some_files(spark)
    for root in (f"{tmp_path}/a", f"{tmp_path}/b"):
        manifest = P.write_pack(df, root, archives).collect()
        assert {(r.path, r.num_bytes, r.sha256) for r in manifest} == {(p, len(c or b""), hashlib.sha256(bytes(c or b"")).hexdigest()) for p, c in rows}
        assert {r.path: bytes(r.content) for r in P.read_pack(spark, root).collect()} == {p: bytes(c or b"") for p, c in rows}
        assert P.verified_pack(spark, root).count() == 0
    tars = sorted(p.name for p in (tmp_path / "a").glob("*.tar"))
    assert 1 <= len(tars) <= archives and all((tmp_path / "a" / t).read_bytes() == (tmp_path / "b" / t).read_bytes() for t in tars)
    with tarfile.open(tmp_path / "a" / tars[0]) as t:
        assert t.getnames() == sorted(t.getnames())


def test_damage_shows(spark, tmp_path):
    rows, df = some_files(spark, 9)
    P.write_pack(df, f"{tmp_path}/p")
    P.write_pack(df.where("path <> 'empty'").withColumn("content", F.when(F.col("path") == "d1/f1.txt", F.lit(b"x")).otherwise(F.col("content"))).unionByName(spark.createDataFrame([("new", bytearray(b"1"))], df.schema)), f"{tmp_path}/q")
    (tmp_path / "p/files-00000.tar").write_bytes((tmp_path / "q/files-00000.tar").read_bytes())
    assert {tuple(r) for r in P.verified_pack(spark, f"{tmp_path}/p").collect()} == {("empty", "missing"), ("new", "extra"), ("d1/f1.txt", "changed")}


@pytest.mark.parametrize("path, text", [("../up", "path refused"), ("/etc/x", "path refused"), (None, "path refused"), ("d0/f0.txt", "occurs twice")])
def test_paths_are_refused(spark, tmp_path, path, text):
    _, df = some_files(spark, 3)
    with pytest.raises(Exception, match=text):
        P.write_pack(df.unionByName(spark.createDataFrame([(path, bytearray(b"1"))], df.schema)), f"{tmp_path}/p")


@pytest.mark.parametrize("gather", [0, 3, 10_000])
def test_digests_of_groups_of_any_size(spark, gather):
    rows = [("a", f"t{i % 90}") for i in range(200)] + [("b", "x"), (None, "y"), (None, "z")]
    got = {r.g: (r.n, r["first"], r.digest) for r in O.text_digest(spark.createDataFrame(rows, "g string, t string").repartition(3), ["g"], "t", ",", gather).collect()}
    for g in ("a", "b", None):
        texts = sorted(t for h, t in rows if h == g)
        assert got[g] == (len(texts), texts[0], hashlib.sha256(",".join(texts).encode()).hexdigest())


def test_many_small_groups_are_streamed_in_blocks(spark):
    df = spark.range(9000).select((F.col("id") % 4500).alias("g"), F.col("id").cast("string").alias("t"))
    got = {r.g: r.digest for r in O.streamed_digest(df, ["g"], ["t"], F.col("t").cast("binary"), b"+").collect()}
    assert len(got) == 4500 and all(got[g] == hashlib.sha256("+".join(sorted([str(g), str(g + 4500)])).encode()).hexdigest() for g in range(0, 4500, 97))


def test_adapter_hash_depends_on_names_and_values_alone():
    a, b = np.arange(6.0).reshape(2, 3), np.ones((3, 2))
    one = K.adapter_hash({"a": a, "b": b})
    assert one == K.adapter_hash({"b": b, "a": np.asfortranarray(a)}) == hashlib.sha256(b"a" + a.astype(np.float32).tobytes() + b"b" + b.astype(np.float32).tobytes()).hexdigest()
    assert len({one, K.adapter_hash({"a": b, "b": a}), K.adapter_hash({"a": a, "c": b}), K.adapter_hash({"a": a + 1, "b": b})}) == 4


@pytest.mark.parametrize("n, budget, micro", [(5, 12, 4), (5, 5, 5), (7, 3, 2), (1, 4, 3)])
def test_schedule_spends_the_budget_in_epochs(n, budget, micro):
    batches = K.budget_schedule(n, budget, micro, 7)
    flat = [i for b in batches for i in b]
    assert len(flat) == budget and all(len(b) == micro for b in batches[:-1]) and 1 <= len(batches[-1]) <= micro
    for at in range(0, budget, n):
        epoch = flat[at : at + n]
        assert len(set(epoch)) == len(epoch) and set(epoch) <= set(range(n))
    assert batches == K.budget_schedule(n, budget, micro, 7) and (n < 5 or budget < 12 or batches != K.budget_schedule(n, budget, micro, 8))


def test_rows_whose_call_fails_keep_their_error(spark):
    def handle(row):
        if row["n"] == 2:
            raise KeyError("two")
        return {"n": row["n"], "twice": 2 * row["n"]}

    got = sorted((r.n, r.twice, r.error) for r in K.apply_rows(spark.range(1, 4).select(F.col("id").alias("n")), handle, "n bigint, twice bigint").where("error IS NULL").collect())
    assert got == [(1, 2, None), (3, 6, None)]
    assert [r.error for r in K.apply_rows(spark.range(2, 3).select(F.col("id").alias("n")), handle, "n bigint, twice bigint").collect()] == ["KeyError: 'two'"]


def test_vectors_cluster_around_planted_directions(spark):
    r = np.random.default_rng(3)
    centre = np.linalg.qr(r.normal(size=(12, 3)))[0].T
    rows = [(i, (centre[i % 3] * r.uniform(0.5, 20) + 0.02 * r.normal(size=12)).tolist()) for i in range(90)]
    got = {x.k: x.cluster for x in M.cluster_vectors(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", 3).collect()}
    assert [got[i] for i in range(90)] == [i % 3 for i in range(90)]  # numbered by the least key in them


def test_labels_by_first_use(spark):
    rows = [(3, "z"), (1, "b"), (2, "z"), (5, "a"), (4, "b")]
    got = {x.k: x.canonical for x in M.canonical_labels(spark.createDataFrame(rows, "k int, l string"), "k", "l").collect()}
    assert got == {1: 0, 4: 0, 2: 1, 3: 1, 5: 2}


def test_upserts_keep_their_place(spark):
    rows = [("r", "b", 1, 10), ("r", "a", 2, 20), ("r", "b", 3, 30), ("s", "a", 4, 40)]
    got = {(x.run, x.key): (x.v, x.position) for x in R.keyed_upserts(spark.createDataFrame(rows, "run string, key string, seq int, v int"), "run", "key", "seq").collect()}
    assert got == {("r", "b"): (30, 1), ("r", "a"): (20, 2), ("s", "a"): (40, 1)}


def test_configurations_hash_by_content():
    assert S.config_hash({"a": 1, "b": [2]}) == hashlib.sha256(b'{"a":1,"b":[2]}').hexdigest()
    assert S.run_id({"lr": 1, "out": "x"}, ("out",)) == S.run_id({"out": "y", "lr": 1}, ("out",)) != S.run_id({"lr": 2}, ())

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import compose as C
from lodestone.operators import similarity as M
from lodestone.sources import files as S

PART = "key string, part int, module string, coefficient double, rank int, a array<double>, b array<double>"


def part(key, n, module, c, rank, seed):
    r = np.random.default_rng(seed)
    return (key, n, module, c, rank, r.normal(size=rank * 5).tolist(), r.normal(size=3 * rank).tolist())


def product(row):
    return np.reshape(row[6], (3, row[4])) @ np.reshape(row[5], (row[4], 5))


def test_composites_add_up(spark):
    rows = [part("x", 0, "q", 0.5, 2, 1), part("x", 1, "q", 2.0, 3, 2), part("x", 1, "v", 2.0, 3, 3), part("y", 0, "q", 0.0, 2, 4), part("y", 1, "q", 1.0, 3, 5), part("z", 0, "q", 0.0, 2, 6), part("z", 1, "q", 0.0, 4, 7), (None, *part("", 0, "q", 1.0, 1, 8)[1:])]
    got = {(r.key, r.module): r for r in C.compose(spark.createDataFrame(rows, PART), ["key"]).collect()}
    assert {k: r.rank for k, r in got.items()} == {("x", "q"): 5, ("x", "v"): 3, ("y", "q"): 3, ("z", "q"): 2, (None, "q"): 1}
    for (key, module), r in got.items():
        want = sum(x[3] * product(x) for x in rows if (x[0], x[2]) == (key, module))
        assert np.allclose(np.reshape(r.b, (3, r.rank)) @ np.reshape(r.a, (r.rank, 5)), want)
    assert got["y", "q"].a == rows[4][5] and got["y", "q"].b == rows[4][6]  # a part alone stays as it was


@pytest.mark.parametrize("rows, text", [([(0, "q", 1.0), (1, "q", 1.0), (1, "v", 1.0)], "different modules"), ([(0, "q", 0.0), (1, "q", 0.0)], "would be empty")])
def test_the_strict_variant_refuses(spark, rows, text):
    df = spark.createDataFrame([part("x", n, m, c, 2, i) for i, (n, m, c) in enumerate(rows)], PART)
    assert C.compose(df, ["key"]).count() > 0
    with pytest.raises(Exception, match=text):
        C.compose(df, ["key"], same_modules=True).collect()
    fine = spark.createDataFrame([part("x", 0, "q", 0.0, 2, 1), part("x", 1, "q", 1.0, 2, 2), part("x", 1, "v", 1.0, 2, 3)], PART)
    assert C.compose(fine, ["key"], same_modules=True).count() == 2  # a part that counts nothing needs no modules


def test_cascade_reuses_and_builds(spark):
    steps = spark.createDataFrame([("a", 3, "t1", 1), ("b", 2, "t2", None), ("b", 2, "t1", None), ("b", 2, "t2", None), ("c", 1, "t9", None)], "name string, from_version int, target string, reuse_version int")
    stored = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("b", 7)], "name string, version int")
    got = {(r.name, r.target): (r.to_version, r.rebuilt, r.reason) for r in C.apply_cascade(steps, stored, "promote", "why").collect()}
    assert got == {("a", "t1"): (1, False, "cascade v3 -> v1: why"), ("b", "t1"): (8, True, "cascade v2 -> v8: why"), ("b", "t2"): (9, True, "cascade v2 -> v9: why"), ("c", "t9"): (1, True, "cascade v1 -> v1: why")}


def test_freezing(spark):
    runs = spark.createDataFrame([("e1", "r1", "completed"), ("e2", "r1", "completed"), ("e2", "r2", "running"), ("e3", "r1", None)], "experiment string, run string, status string")
    what = lambda *names: spark.createDataFrame([(n,) for n in names], "experiment string")
    assert [tuple(r) for r in C.frozen(runs, what("e1", "new"), "v1").orderBy("experiment").collect()] == [("e1", "v1"), ("new", "v1")]
    for bad in ("e2", "e3"):
        with pytest.raises(Exception, match=f"cannot freeze {bad}: unfinished run"):
            C.frozen(runs, what("e1", bad), "v1").collect()
    updates = spark.createDataFrame([("e1", "r1"), ("e1", "new"), ("e2", "r1"), ("e2", "r2")], "experiment string, run string")
    got = {(r.experiment, r.run): r.verdict for r in C.update_verdicts(runs, updates, what("e1")).collect()}
    assert got == {("e1", "r1"): "frozen", ("e1", "new"): "frozen", ("e2", "r1"): "completed", ("e2", "r2"): "written"}


def test_decisions_and_their_errors(spark):
    rows = [(2, 1, 0.06, 0.05, 0.5, 0.48), (2, 1, 0.05, 0.05, 0.5, 0.5), (2, 1, None, 0.05, 0.5, 0.5), (2, 1, 0.2, 0.05, None, 0.5), (2, 1, 0.2, 0.05, 0.5, 0.4), (1, None, 0.2, 0.05, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "version int, previous_version int, delta double, band double, base_guard double, cand_guard double")
    got = [(r.action, r.active_version_after) for r in C.decide(df, tolerance=0.03).collect()]
    assert got == [("promote", 2), ("rollback", 1), ("rollback", 1), ("rollback", 1), ("rollback", 1), ("promote", 1)]
    first = spark.createDataFrame([(1, None, 0.01, 0.05, 0.5, 0.5)], df.schema)
    assert C.decide(first, refuse=False).first().reason == "rollback indicated (edit_similarity delta 0.0100 does not clear noise band 0.0500; HumanEval pass@1 drop 0.0000 within 0.02 tolerance) but there is no previous version to roll back to"
    with pytest.raises(Exception, match="no previous version"):
        C.decide(first).collect()


def test_lookups_refuse_unknown_keys(spark):
    known = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    assert sorted(tuple(r) for r in C.checked_lookup(spark.createDataFrame([(1, 5), (1, 6)], "id int, n int"), known, "id").collect()) == [(1, 5, "a"), (1, 6, "a")]
    for bad, text in ((3, "unknown id: 3"), (None, "unknown id: null")):
        with pytest.raises(Exception, match=text):
            C.checked_lookup(spark.createDataFrame([(1, 5), (bad, 6)], "id int, n int"), known, "id").collect()


def test_decisions_of_one_version(spark):
    v = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "name string, version int")
    d = spark.createDataFrame([("a", 2, 9, "rollback"), ("a", 2, 3, "promote"), ("a", 7, 1, "promote")], "name string, version int, seq int, action string")
    got = [(r.name, r.version, r.is_active, [x.action for x in r.decisions]) for r in C.version_history(v, d, spark.createDataFrame([("a", 2)], "name string, active int")).orderBy("name", "version").collect()]
    assert got == [("a", 1, False, []), ("a", 2, True, ["promote", "rollback"]), ("b", 1, False, [])]


@pytest.mark.parametrize("k", [3, 6, 8])
def test_agreement_tries_all_renamings(spark, k):
    turned = [(i % k, (i % k * 3 + 1) % k if k % 3 else (i % k + 1) % k) for i in range(40)]
    df = spark.createDataFrame([*turned, (0, 0)], "a int, b int")
    want = (41 if turned[0] == (0, 0) else 40) / 41
    assert M.agreement(df, "a", "b", k).first().agreement == pytest.approx(want)
    with pytest.raises(ValueError):
        M.agreement(df, "a", "b", 9)


def test_partitions_are_compared_by_id(spark):
    rows = [([1.0, 0.0], 0, 1), ([1.0, 0.1], 0, 1), ([0.0, 1.0], 1, 0), ([0.1, 1.0], 1, 1)]
    r = M.compare_partitions(spark.createDataFrame(rows, "v array<double>, a int, b int"), "v", "a", "b").first()
    assert r.agreement == 0.25 and r.ari < 1 and r.dynamic_cohesion > r.warm_start_cohesion and r.dynamic_separation < r.warm_start_separation


def test_discovery_skips_missing_folders_with_a_warning(spark, tmp_path):
    for f in ("src/a.py", "src/deep/b.pyi", "docs/c.py", "src/n.txt"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    paths = lambda **how: sorted(r.path for r in S.discover(spark, str(tmp_path), ["*.py", "*.pyi"], **how).collect())
    with pytest.warns(UserWarning, match="gone does not exist"):
        assert paths(subpaths=["src", "gone", "src/deep"]) == ["src/a.py", "src/deep/b.pyi"]
    with pytest.warns(UserWarning):
        assert paths(subpaths=["gone"]) == ["docs/c.py", "src/a.py", "src/deep/b.pyi"]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert paths() == ["docs/c.py", "src/a.py", "src/deep/b.pyi"]
        assert S.discover(spark, str(tmp_path), "*.txt").count() == 1

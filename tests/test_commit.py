import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import validators as V
from lodestone.sources import commit
from lodestone.sources import files as S
from lodestone.sources import versions as R


def listing(path):
    return sorted(f for f in os.listdir(path) if not f.endswith(".crc"))


def test_the_second_of_two_writers_fails(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert R.save(spark, root, "web", b"one", "cluster") == 1
    (mine, n), (theirs, m) = R.stage(spark, root, "web", b"mine", "cluster"), R.stage(spark, root, "web", b"theirs", "cluster")
    assert n == m == 2 and R.version_numbers(spark, root, "web") == [1]
    commit.publish(spark, theirs, f"{root}/name=web/version=2")
    with pytest.raises(commit.AlreadyThere):
        commit.publish(spark, mine, f"{root}/name=web/version=2")
    assert R.load(spark, root, "web", 2) == b"theirs" and listing(tmp_path / "name=web") == ["version=1", "version=2"]
    assert R.save(spark, root, "web", b"mine", "cluster") == 3


def test_a_dead_attempt_is_seen_by_nobody(spark, tmp_path):
    root = str(tmp_path)
    R.save(spark, root, "web", b"one", "cluster")
    part, _ = R.stage(spark, root, "web", b"half", "cluster")  # and then the writer dies
    assert R.version_numbers(spark, root, "web") == [1] and [r.version for r in R.scan(spark, root).collect()] == [1]
    assert os.path.isdir(part) and R.save(spark, root, "web", b"two", "cluster") == 2
    assert R.load(spark, root, "web") == b"two" and R.broken(R.scan(spark, root)).count() == 0


def test_kinds_and_names_are_refused(spark, tmp_path):
    root = str(tmp_path)
    R.save(spark, root, "web", b"one", "cluster")
    with pytest.raises(R.KindMismatch):
        R.save(spark, root, "web", b"two", "composite")
    for bad in ("", ".web", "a#b", "a/b", "n" * 65, "x\n", "é"):
        with pytest.raises(ValueError, match="invalid name"):
            R.save(spark, root, bad, b"x", "cluster")
    names = spark.createDataFrame([(x,) for x in ("web", "a.b_c-1", "n" * 64, "a#b", "x\n", "", ".a")], "n string")
    assert [r.ok for r in names.select(F.col("n").rlike(V.NAME).alias("ok")).collect()] == [True] * 3 + [False] * 4


def test_the_active_pointer_is_swapped(spark, tmp_path):
    root = str(tmp_path)
    for payload in (b"1", b"2"):
        R.save(spark, root, "web", payload, "cluster")
    assert R.active(spark, root, "web") is None
    for v in (2, 1):
        R.set_active(spark, root, "web", v)
        assert R.active(spark, root, "web") == v
    with pytest.raises(KeyError):
        R.set_active(spark, root, "web", 3)
    assert R.scan(spark, root).count() == 2


def test_documents_are_old_or_new(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/run.json"
    S.write_document(spark, path, {"n": 1})
    first = json.loads((tmp_path / "run.json").read_text())
    seen = []

    def crash(spark, source, target, overwrite):
        seen.append((os.path.exists(source), json.loads((tmp_path / "run.json").read_text())))
        raise RuntimeError("crash before the swap")

    with monkeypatch.context() as m:
        m.setattr(commit, "_rename", crash)
        with pytest.raises(RuntimeError):
            S.write_document(spark, path, {"n": 2})
    assert seen == [(True, first)] and json.loads((tmp_path / "run.json").read_text()) == first
    S.write_document(spark, path, {"n": "é"})
    assert json.loads((tmp_path / "run.json").read_text()) == {"n": "é"} and listing(tmp_path) == ["run.json"]

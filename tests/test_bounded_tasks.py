"""Work and reading of a task that must not grow with the table."""

from pyspark.sql import functions as F

from lodestone.operators import kernels as K
from lodestone.operators import validators as V
from lodestone.sources import packs as PK


def test_schedules_of_one_size_are_made_once(monkeypatch):
    made = []
    whole = K.budget_schedule
    monkeypatch.setattr(K, "budget_schedule", lambda *a: made.append(a) or whole(*a))
    K.schedule_batches.cache_clear()
    assert [K.schedule_batches(n, 2 * n, 4, 7) for n in (10, 10, 7, 10)] == [5, 5, 4, 5]
    assert len(made) == 2


def test_packs_get_more_archives_as_they_grow(spark, tmp_path):
    files = spark.range(200).select(F.concat(F.lit("a/"), F.lpad("id", 4, "0")).alias("path"), F.repeat(F.lit("x"), 1000).cast("binary").alias("content"))
    manifest = PK.write_pack(files, str(tmp_path / "p"), archives=2, most_bytes=20_000)
    per = [r.b for r in manifest.groupBy("archive").agg(F.sum("num_bytes").alias("b")).collect()]
    assert len(per) >= 8 and sum(per) == 200_000 and max(per) < 80_000
    assert PK.read_pack(spark, str(tmp_path / "p")).count() == 200 and PK.verified_pack(spark, str(tmp_path / "p")).count() == 0


def test_plans_are_accepted_after_one_shuffle(spark):
    rows = [(1, c, 1) for c in "abcd"] + [(2, "a", 1), (2, "a", 0)] + [(3, None, 1), (3, "b", 2)] + [(None, "a", 1)]
    out = V.plan_acceptance(spark.createDataFrame(rows, "plan int, client string, files int"), "plan", "client", "files", None, 6, 4)
    got = {r.plan: (list(r.errors), list(r.warnings), r.accepted) for r in out.collect()}
    assert got == {
        1: ([], [], True), 2: (["duplicate_client", "empty_shard"], ["count_mismatch"], False), 3: (["duplicate_client"], ["count_mismatch"], False), None: (["too_few_clients"], ["count_mismatch"], False),
    }
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Expand" not in plan

"""Paths and parents in graphs move by edge, not by path."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators.ordering import text_digest
from lodestone.operators.registry_rules import grandparents


@pytest.mark.parametrize("most", [0, 40, 10_000])
def test_grandparents_match_pairs_at_every_bound(spark, most):
    r = random.Random(3)
    up = [(r.choice([None, *range(30)]), r.choice([None, *range(12)])) for _ in range(150)] + [(g, 0) for g in range(60)]
    down = [(r.choice([None, *range(14)]), r.choice([None, *range(20)])) for _ in range(120)]
    paths, old = defaultdict(int), defaultdict(set)
    for mid, node in set(down):
        for g, m in set(up):
            if m == mid and m is not None:
                paths[node] += 1
                old[node] |= {g} - {None}
    got = grandparents(spark.createDataFrame(up, "grandparent long, mid long"), spark.createDataFrame(down, "mid long, node long"), most).collect()
    assert sorted(((x.node, x.n_grandparents, x.n_paths) for x in got), key=str) == sorted(((n, len(old[n]), paths[n]) for n in paths), key=str)


def test_grandparents_move_a_row_an_edge(spark):
    """40 grandparents over 50 mids to 100 nodes are 200,000 paths and 5,000 edges."""
    up = spark.range(2000).selectExpr("id % 40 as grandparent", "id div 40 as mid")
    down = spark.range(5000).selectExpr("id % 50 as mid", "id div 50 as node")
    out = grandparents(up, down)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    assert {(x.n_grandparents, x.n_paths) for x in out.collect()} == {(40, 2000)}
    assert "grandparent#" not in plan.toString().split("Join", 1)[0]  # no pair above the join


@pytest.mark.parametrize("gather", [2, 100])
def test_text_digest_of_distinct_values(spark, gather):
    rows = [(g, v) for g in (1, None) for v in (10, 9, 9, 10, None, 2)] + [(5, None), (7, 3), (7, 3)]
    got = text_digest(spark.createDataFrame(rows, "g long, v long"), ["g"], "v", ",", gather, text=lambda v: F.concat(F.lit("n:"), v.cast("string")), distinct=True).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(g, 4, "n:10", sha("n:10,n:2,n:9")) for g in (1, None)] + [(5, 1, None, sha("")), (7, 1, "n:3", sha("n:3"))]
    assert sorted((tuple(x) for x in got), key=str) == sorted(want, key=str)

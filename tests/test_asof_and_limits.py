import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import asof, ordering
from lodestone.operators import corpus as C


def plain_as_of(probes, versions, strict):
    out = []
    for name, at, tag in probes:
        fits = [(v, x) for n, v, x in versions if n == name and None not in (n, v, at) and (v < at or v == at and not strict)]
        out.append((name, at, tag, max(fits, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("span", [1, 7, 10_000])
def test_as_of_matches_brute_force(spark, strict, span):
    r = random.Random(span)
    names = ["hot"] * 6 + ["a", "b", None]
    versions = [(r.choice(names), r.choice([None, *range(-60, 60)]), r.randint(0, 9)) for _ in range(150)]
    probes = [(r.choice([*names, "none"]), r.choice([None, *range(-70, 70)]), r.randint(0, 2)) for _ in range(250)]
    v = spark.createDataFrame(versions, "name string, at int, _v int")
    p = spark.createDataFrame(probes, "name string, at int, _late int")
    got = asof.as_of(p, v, ["name"], "at", lambda at: F.floor(at / span), strict)
    assert got.columns == ["name", "at", "_late", "found"]
    rows = sorted(((x.name, x.at, x._late, tuple(x.found) if x.found else None) for x in got.collect()), key=str)
    assert rows == plain_as_of(probes, versions, strict)


def test_as_of_without_rows_and_with_several_keys(spark):
    v = spark.createDataFrame([(1, "x", 5, "old"), (1, "y", 5, "other")], "k int, l string, at int, what string")
    p = spark.createDataFrame([(1, "x", 9), (2, "x", 9)], "k int, l string, at int")
    find = lambda a, b: sorted((x.k, x.found and x.found.what) for x in asof.as_of(a, b, ["k", "l"], "at", lambda at: F.floor(at / 4)).collect())
    assert find(p, v) == [(1, "old"), (2, None)]
    assert find(p, v.limit(0)) == [(1, None), (2, None)]
    assert find(p.limit(0), v) == []


def plain_examples(files, most):
    out = []
    for name, text in sorted((f for f in files if f[0] is not None), key=lambda f: f[0].split("/")):
        if text is None:
            continue
        lines, kept, seen = text.split("\n"), 0, 0
        lines = lines[:-1] if lines[-1] == "" else lines
        for i, line in enumerate(lines):
            if i < 3 or len(line.strip(" \t")) < 4 or line.strip(" \t").startswith("#"):
                continue
            if seen % 7 == 0 and kept < 2 * max(1, -(-most // len(files))):
                out.append((name, i, "\n".join(lines[:i]) + "\n", line))
                kept += 1
            seen += 1
    return out[:most]


@pytest.mark.parametrize("most", [1, 3, 40, 100_000])
def test_first_examples_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 9)
    r = random.Random(most)
    line = lambda: r.choice(["value = 1", "# note", "", "xy", "long line of code", "\tdeep()"])
    files = [(f"{r.choice('abc')}/{r.choice(['d', 'd0', 'd-', 'é'])}/{i}.py", "\n".join(line() for _ in range(r.randint(0, 90)))) for i in range(60)]
    files += [("a/none.py", None), (None, "\n" * 5 + "value = 1"), ("a", "x\n" * 3 + "value = 2")]
    df = spark.createDataFrame([(*f, 1) for f in files], "file string, text string, _at int").repartition(3)
    got = [tuple(x) for x in C.first_examples(df, "file", "text", most).collect()]
    assert sorted(got) == sorted(plain_examples(files, most))
    assert C.first_examples(df.limit(0), "file", "text", most).count() == 0


def test_ranges_follow_the_order(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 50)
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("k"))
    got = df.select("k", ordering.range_bucket(df, F.col("k")).alias("b")).groupBy("b").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")).orderBy("lo").collect()
    assert len(got) > 20 and all(x.hi < y.lo and x.b < y.b for x, y in zip(got, got[1:], strict=False)) and max(x.n for x in got) < 400

import re
from fnmatch import fnmatchcase

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import balance as B
from lodestone.operators import corpus as C


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [
        ("**/tests/**", "tests/t.py", True), ("**/tests/**", "a/b/tests/c/t.py", True), ("**/tests/**", "a/tests.py", False), ("*.py", "a/b.py", False), ("*.py", "b.py", True),
        ("a/?.py", "a/b.py", True), ("a/[!b].py", "a/b.py", False), ("a/[bc].py", "a/c.py", True), ("**", "x/y", True), ("a/**", "a", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("A.py", "a.py", False), ("a+.py", "aa.py", False),
    ],
)
def test_globs(glob, path, want):
    assert bool(re.match(X.glob_pattern(glob), path)) == want
    if "**" not in glob and glob.count("/") == path.count("/"):
        assert all(fnmatchcase(a, b) for a, b in zip(path.split("/"), glob.split("/"), strict=True)) == want


def test_text_functions_match_python(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc", "# c\n\n x \n\t# d\n  y", "  z\x1c", "é\x85q r", "one\x0btwo\x0cthree"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = rows.select("t", X.count_lines(X.normalise_newlines(t)).alias("n"), X.count_code_lines(t).alias("c"), X.strip(t).alias("s"), X.truncated(t, 5).alias("short"), X.split_lines(t).alias("lines")).collect()
    for r in got:
        norm = r.t.replace("\r\n", "\n").replace("\r", "\n")
        assert r.n == norm.count("\n") + (not norm.endswith("\n") if norm else 0)
        assert r.c == sum(bool(x.strip()) and not x.strip().startswith("#") for x in r.t.splitlines())
        assert r.s == r.t.strip() and r.lines == (r.t.splitlines() or [])
        flat = " ".join(r.t.split())
        assert r.short == (flat if len(flat) <= 5 else flat[:4] + "…")


def test_acceptance_cascade_order(spark):
    long = "x = 1\n" * 12
    files = [("tests/a.py", ""), ("a.py", ""), ("b.py", "x\n" * 200), ("c.py", "   \n"), ("d.py", None), ("e.py", long), ("f.py", long.replace("\n", "\r\n")), ("tests/g.py", long), ("h.py", long + "y = 2\n")]
    df = C.with_text_columns(spark.createDataFrame(files, "path string, content string"))
    got = {r.path: r.reason for r in C.filter_reasons(df, ["**/tests/**"], ["path"], max_bytes=300).collect()}
    assert got == {"tests/a.py": "excluded_glob", "a.py": "empty", "b.py": "too_large", "c.py": "too_few_code_lines", "d.py": "undecodable", "e.py": None, "f.py": "duplicate_content", "tests/g.py": "excluded_glob", "h.py": None}


def test_balance_golden_figures(spark):
    """Equal shards have no inequality; one shard with everything has the most."""
    same = B.balance(spark.createDataFrame([(f"c{i}", 5) for i in range(4)], "c string, n long"), "c", "n").first()
    assert (same.gini, same.coefficient_of_variation, same.imbalance_ratio, same.min_client, same.max_client) == (0.0, 0.0, 1.0, "c0", "c0")
    one = B.balance(spark.createDataFrame([("a", 0), ("b", 9)], "c string, n long"), "c", "n").first()
    assert one.gini == 0.5 and one.imbalance_ratio == float("inf") and one.max_client == "b"
    assert B.balance(spark.createDataFrame([], "c string, n long"), "c", "n").count() == 0


def test_developer_bases(spark):
    rows = [("nested", i, f"src/{'ab'[i % 2]}/f{i}.py") for i in range(8)] + [("flat", i, f"f{i}.py") for i in range(14)] + [("tiny", i, f"f{i}.py") for i in range(3)]
    df = spark.createDataFrame(rows, "cluster string, id long, path string")
    out = C.developers(df, "cluster", "id", "path", 20260616, 6, 2)
    got = {r.cluster: (r.basis, r.n) for r in out.groupBy("cluster", "basis").agg(F.countDistinct("dev_index").alias("n")).collect()}
    assert got == {"nested": ("module_path", 2), "flat": ("deterministic_hash_chunk", 2), "tiny": ("single_developer_whole_project", 1)}


def test_budget_floors_and_caps(spark):
    counts = {"a": 1286, "b": 1687, "c": 1696, "d": 80, "e": 52, "f": 170, "g": 4}
    got = {r.c: r.chunk_budget for r in C.budgets(spark.createDataFrame(list(counts.items()), "c string, n long"), "n", 1200).collect()}
    weight = sum(n**0.5 for n in counts.values())
    for c, n in counts.items():
        assert got[c] == max(round(min(1200 * n**0.5 / weight, max(n * 3.0, 20))), min(20, n))


def test_holdout_bounds(spark):
    df = spark.createDataFrame([(f"g{n}", i) for n in (1, 2, 5, 40) for i in range(n)], "g string, i long")
    held = {r.g: r.h for r in C.holdout(df, "g", "i", 1, 0.1).groupBy("g").agg(F.sum(F.col("held_out").cast("int")).alias("h")).collect()}
    assert held == {"g1": None, "g2": 1, "g5": 1, "g40": 4}


def test_code_lines_as_lines_say(spark):
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\n\r", ""]
    heads = ["a", "  a # b", "# a", "\u3000# a", "\x1f\xa0a", "", " ", "^", "é", "\U0001f600 #"]
    texts = ["".join(h + e for h in heads) for e in ends] + [h + e + k + "x" for h in heads for e in ends for k in heads] + ["", "\n", "#", "x" * 5000 + "\n#"]
    t = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = rows.select("t", X.count_code_lines(t).alias("c"), X.count_lines(t).alias("n")).collect()
    code = lambda x: sum(s != "" and s[0] != "#" for s in map(str.strip, x.splitlines()))
    assert [(r.c, r.n) for r in got] == [(None, None) if r.t is None else (code(r.t), len(r.t.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n")) if r.t else 0) for r in got]


def test_code_lines_are_cheaper_than_a_class_at_every_character(spark):
    import time

    t = F.col("t")
    rows = spark.range(0, 400, 1, 4).select(F.concat(F.repeat(F.lit("words of a line "), 1000), F.col("id").cast("string")).alias("t")).cache()
    slow = F.regexp_count(t, F.lit(f"(?<![^{X.END}])[{X.BLANK}]*+[^#{X.SPACE}]"))

    def seconds(count):
        start = time.perf_counter()
        assert rows.agg(F.sum(count)).first()[0] == 400
        return time.perf_counter() - start

    for count in (slow, X.count_code_lines(t)):
        seconds(count)
    assert min(seconds(X.count_code_lines(t)) for _ in range(3)) < 0.5 * min(seconds(slow) for _ in range(3))

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup as E

SCHEMA = "doc_id bigint, text string, keep_id string, h string"


def plain(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    out, done = [], set()
    for i, t in norm:
        keep = min((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep and t not in done, hashlib.sha256(t.encode()).hexdigest()))
        if i == keep:
            done.add(t)
    return sorted(out, key=str)


def sample():
    r = random.Random(5)
    rows = [(None, None), (1, ""), (2, None), (7, " "), (8, "\t\n"), (7, " "), (None, "only null"), (None, "only  null"), (4, "é" * 30_000), (5, "é" * 30_000)]
    for _ in range(60):
        t = " ".join(r.choice(["alpha", "béta", "c", "𝔘x", "gamma\n"]) for _ in range(r.choice([1, 3, 900])))
        rows += [(r.randint(10, 90), t.replace(" ", "\n ", r.randint(0, 2))) for _ in range(r.randint(1, 3))]
    return rows


@pytest.mark.parametrize("bits", [64, 2])
def test_matches_brute_force(spark, bits):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in sample()], SCHEMA)
    got = E.exact_duplicates(df, hash_bits=bits).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got), key=str) == plain(sample())


def test_chunks_join_to_the_text_and_move_with_content(spark):
    r = random.Random(2)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz 𝔘é") for _ in range(20_000))
    df = spark.createDataFrame([(1, text), (2, "some words in front " + text)], "doc_id int, text string")
    a, b = (x.c for x in df.select(E.chunks(F.col("text")).alias("c")).collect())
    assert "".join(a) == text and "".join(b) == "some words in front " + text
    assert len(a) > 5 and len(set(a) & set(b)) >= len(a) - 2


def test_deduplicated_keeps_columns_and_one_row(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in sample()], SCHEMA)
    got = E.deduplicated(df)
    assert got.columns == df.columns and got.count() == sum(x[3] for x in plain(sample()))


def test_empty_table(spark):
    assert E.exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(sample(), "doc_id bigint, text string")
    plan = E.exact_duplicates(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|BatchEval", plan)


def test_a_clash_moves_only_the_texts_it_touches(spark):
    r = random.Random(8)
    long = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200_000)) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate([*long, *long, "short", "short", ""])]
    got = E.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), hash_bits=8).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got), key=str) == plain(rows)

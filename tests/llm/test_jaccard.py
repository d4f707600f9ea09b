import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import jaccard, simhash
from tests_llm_plain import plain_survivors

COLUMNS = "doc_id bigint, text string, root string"


def documents():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    line = r.choices(words, k=30)
    rows = [(1, None), (2, ""), (3, "  "), (4, "three words only"), (5, "Three  words only"), (6, "three words more")]
    for g in range(25):
        base = r.choices(words, k=r.choice([7, 12, 60, 150, 400]))
        base = base + line if g % 3 == 0 else base
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 40))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((10 + len(rows) * 7 % 1009, " ".join(copy[: len(copy) - r.choice([0, 0, 1, 3])])))
    return rows


@pytest.mark.parametrize("counters, small", [(1, 8), (100, 1), (1 << 20, 3)])
def test_survivors_match_brute_force_in_any_order(spark, monkeypatch, counters, small):
    monkeypatch.setattr(jaccard, "COUNTERS", counters)
    monkeypatch.setattr(jaccard, "SMALL", small)
    rows = documents()
    got = simhash.survivors(spark.createDataFrame([(*x, "clash") for x in rows], COLUMNS), width=5, similar=True)
    assert got.columns == ["doc_id", "text", "root"] and sorted(x.doc_id for x in got.collect()) == plain_survivors(rows)


def test_pipeline_stage_matches_brute_force(spark):
    rows = documents()
    got = corpus_pipeline.near(spark, spark.createDataFrame([(*x, "clash") for x in rows], COLUMNS), "")
    assert sorted(x.doc_id for x in got.collect()) == plain_survivors(rows)


def test_empty_table(spark):
    assert simhash.survivors(spark.createDataFrame([], COLUMNS), width=5, similar=True).collect() == []


def test_fingerprints_miss_pairs_that_the_stage_finds(spark):
    """Pairs of similarity 0.8 to 0.95: a few bits find few of them, the stage finds all."""
    r = random.Random(1)
    words, rows = [f"w{i}" for i in range(3000)], []
    for k in range(40):
        text = r.choices(words, k=200)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[: 186 + k % 10]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(x.doc_id for x in simhash.survivors(df, width=5, similar=True).collect()) == [2 * k for k in range(40)]
    assert simhash.survivors(df, width=5).count() > 50


def test_counts_are_those_of_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTERS", 5000)
    rows = documents()
    keyed = spark.createDataFrame([(i, t or "") for i, (_, t) in enumerate(rows)], "key bigint, text string").repartition(5)
    table, common = jaccard.shingle_counts(keyed, 5)
    want = np.zeros(5000, np.int64)
    for _, t in rows:
        np.add.at(want, jaccard.counter(jaccard.shingles((t or "").encode()), 5000), 1)
    assert (table == jaccard.level(want)).all()
    load = want.sum() / 5000
    assert common == jaccard.level(np.array([load + 4 * load**0.5 + 2]))[0]


def test_a_line_in_a_share_of_all_texts_makes_no_candidates(spark, monkeypatch):
    n, r = 1200, random.Random(7)
    line = " ".join(f"shared{i}" for i in range(8))
    word = lambda: f"w{r.randrange(10**6)}"
    rows = [(i, " ".join([*(word() for _ in range(30)), *([line] if i % 4 == 0 else []), *(word() for _ in range(30))])) for i in range(n)]
    seen, real = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *more: (seen.append(pairs.distinct().count()), real(pairs, *more))[1])
    got = simhash.survivors(spark.createDataFrame(rows, "doc_id bigint, text string"), width=5, similar=True)
    assert got.count() == n and sum(seen) < n // 10


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "doc_id bigint, text string")
    real, seeds = F.xxhash64, []

    def weak(*columns):
        if len(columns) == 1:
            seeds.append(0)
            return F.lit(7).cast("bigint")
        seeds.append(1)
        return real(*columns)

    monkeypatch.setattr(jaccard.F, "xxhash64", weak)
    key = jaccard.text_keys(df, "text")
    monkeypatch.undo()
    assert seeds == [0, 1] and df.select(key.alias("k")).distinct().count() == 3

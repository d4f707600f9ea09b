import random
from collections import Counter, defaultdict
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import packing as P
from lodestone.llm import token_rollup as T


def words():
    return F.regexp_count("text", F.lit(r"\S+"))


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts, strict=True))


@settings(deadline=None, max_examples=200)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, k):
    lengths = sorted(histogram)
    counts = [histogram[x] for x in lengths]
    got = P.boundaries(lengths, counts, k)
    assert got == sorted(set(got)) and len(got) <= k and got[-1] == lengths[-1]
    best = min(padding(lengths, counts, [*c, lengths[-1]]) for r in range(k) for c in combinations(lengths[:-1], r))
    assert padding(lengths, counts, got) == best


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 20)
    r = random.Random(2)
    rows = [(None, None, "x"), (1, "", "x"), (2, "one two  three\n", "x"), (2, "one two  three\n", "x"), (3, "w " * 1000, "x"), (None, "a b", "x")]
    rows += [(i, " ".join(["w"] * r.randint(1, 90)), "x") for i in range(10, 300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, bucket string")
    got = P.pack(df, words(), longest=64, buckets=4, budget=256).collect()
    want = Counter()
    for i, t, _ in rows:
        n = len((t or "").split())
        want.update((i, p, min(64, n - 64 * p)) for p in range(max(1, -(-n // 64))))
    assert Counter((x.doc_id, x.piece, x.length) for x in got) == want
    batches = defaultdict(list)
    for x in got:
        if x.length:
            assert x.length <= x.bucket <= 64 and x.start == 64 * x.piece
            batches[x.bucket, x.batch].append(x.slot)
        else:
            assert x.bucket is None and x.batch is None
    per_bucket = defaultdict(list)
    for (b, k), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and b * len(slots) <= 256
        per_bucket[b].append((k, len(slots)))
    for b, found in per_bucket.items():  # all batches but the last are full
        found.sort()
        assert [k for k, _ in found] == list(range(len(found))) and all(n == 256 // b for _, n in found[:-1])
    bounds = sorted(per_bucket)
    assert all(x.bucket == min(b for b in bounds if b >= x.length) for x in got if x.length)


def test_empty_and_wordless_tables(spark):
    schema = "doc_id bigint, text string"
    assert P.pack(spark.createDataFrame([], schema), words()).collect() == []
    assert [x.bucket for x in P.pack(spark.createDataFrame([(1, " ")], schema), words()).collect()] == [None]


def test_token_lengths_and_many_null_ids(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 10)
    tokenizer = T.Tokenizer("/opt/tokenizers", "byte_bpe_50k")
    texts = [None, "", *(f"some words no. {i} " * (1 + i % 40) for i in range(200))]
    df = spark.createDataFrame([(None if i % 3 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = P.pack(df, tokenizer, longest=128, buckets=3, budget=512).collect()
    count = T.Counter(tokenizer.read()).count
    want = Counter(min(128, count(t or "") - 128 * p) for t in texts for p in range(max(1, -(-count(t or "") // 128))))
    assert Counter(x.length for x in got) == want
    slots = Counter((x.bucket, x.batch, x.slot) for x in got if x.length)
    assert max(slots.values()) == 1 and all(b * (s + 1) <= 512 for b, _, s in slots)

import math
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import lm_score as L


def plain(rows, least=2):
    docs = {}
    for k, (i, t) in enumerate(rows):
        docs.setdefault(("none", k) if i is None else i, []).append([w.decode() for w in (t or "").encode().lower().split()])
    uni, bi = Counter(), Counter()
    for texts in docs.values():
        for w in texts:
            uni.update(w)
            uni.update([None] * bool(w))
            bi.update(zip([None, *w], w, strict=False))
    total = sum(n for w, n in uni.items() if w is not None)
    out = {}
    for i, texts in docs.items():
        s = [math.log(bi[p] / uni[p[0]]) if bi[p] >= least else math.log(0.4 * uni[p[1]] / total) for w in texts for p in zip([None, *w], w, strict=False)]
        out[i] = (len(s), sum(s) / len(s) if s else None)
    return [(i, *(out[i] if i is not None else (0, None))) for i, _ in rows]


def sample():
    r = random.Random(4)
    vocab = ["the", "The", "of", "É", "x\xa0y"] + [f"w{i}" for i in range(200)]
    rows = [(None, None), (None, "the null row"), (1, ""), (2, " \n"), (3, "x " * 3000), (4, "once only here"), (-5, "the of"), (7, "the of"), (7, "of the")]
    return rows + [(r.randint(8, 60), "\t".join(r.choice(vocab[: r.choice([5, 200])]) for _ in range(r.randint(0, 60)))) for _ in range(80)]


def check(got, want):
    key = lambda x: (str(x[0]), x[1], x[2] or 0)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a.doc_id == b[0] and a.n_words == b[1]
        assert (a.score is None) == (b[2] is None) and (b[2] is None or math.isclose(a.score, b[2], rel_tol=1e-9, abs_tol=1e-12))


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", 1.0) for x in rows], "doc_id bigint, text string, block string, score double")


@pytest.mark.parametrize(("head", "least"), [(65_535, 1), (65_535, 2), (3, 2), (0, 1)])
def test_matches_brute_force(spark, head, least):
    check(L.scores(frame(spark, sample()), min_count=least, head=head, flush=50).collect(), plain(sample(), least))


def test_words_that_share_a_hash_are_told_apart(spark):
    taken = {}
    for w in {w for _, t in sample() for w in (t or "").encode().lower().split()}:
        taken.setdefault(L.word_hash(w, 8), []).append(w)
    assert set(L.clashing_words(frame(spark, sample()), 8)) == {w for ws in taken.values() if len(ws) > 1 for w in ws}
    check(L.scores(frame(spark, sample()), min_count=2, head=20, hash_bits=8).collect(), plain(sample()))


def test_long_texts_and_a_probe_of_a_huge_table(spark):
    from lodestone.llm.common import share_of

    share = spark.range(1).select(share_of(L.F.lit(0), 4000, 10**10).alias("a"), share_of(L.F.lit(-1), 4000, 10**10).alias("b"), share_of(L.F.lit(-1), 10, 3).alias("c")).first()
    assert (share.a, share.b, share.c) == (True, False, True)
    rows = [(1, "one two three four " * 60_000), (2, "one two")]
    check(L.scores(frame(spark, rows)).collect(), plain(rows, 1))


def test_partial_sums_stay_bounded():
    sums, sent, most = L.Sums(4, flush=100), [], 0
    for i in range(1000):  # a thousand times more documents than fit
        sums.add(np.arange(i * 100, i * 100 + 60), np.ones(60), np.ones(60, np.int64))
        sent += list(sums.full())
        most = max(most, sums.size)
    sent += list(sums.blocks())
    assert most <= 160 and sum(int(L.opened(b)[2].sum()) for _, _, b in sent) == 60_000


def test_blocks_round_trip():
    columns = [np.arange(5, dtype=np.int64) - 3, np.zeros(0, np.uint16), np.array([1.5, -2.0]), np.array([7], np.int8)]
    for a, b in zip(columns, L.opened(L.shut(*columns)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def test_empty_table(spark):
    assert L.scores(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@pytest.mark.parametrize("ids", [[-(2**63), 2, None], [-(2**63), 2**63 - 1, None], [-(2**63), 2**63 - 1, 0, 1, None], [None, None, 5]])
def test_every_id_is_a_legal_one(spark, ids):
    df = spark.createDataFrame([(i, "one two three one two four") for i in ids], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_words, r.score is not None) for r in L.scores(df).collect())
    assert got == sorted((str(i), 0 if i is None else 6, i is not None) for i in ids)

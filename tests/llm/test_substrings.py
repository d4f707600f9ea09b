import hashlib
import random
import re

import numpy as np
import pytest

from lodestone.llm import substrings as S


def plain(rows, width=13):
    split = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    owner = {}
    for i, w in split:
        if i is not None:
            for a in range(len(w) - width + 1):
                g = tuple(w[a : a + width])
                owner[g] = min(owner.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for a in range(len(w) - width + 1):
                if owner[tuple(w[a : a + width])] < i:
                    gone.update(range(a, a + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def sample():
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(40)] + ["É", "a\xa0b"]
    some = lambda n: [r.choice(vocab) for _ in range(n)]
    passages = [some(r.randint(13, 70)) for _ in range(6)]
    rows = [(None, None), (1, ""), (2, " \n"), (None, " ".join(passages[0])), (3, "x " * 2000), (4, "x " * 50), (5, "one two")]
    rows += [(6, " ".join(passages[0])), (6, " ".join(passages[0])), (6, " ".join(passages[1] * 2))]
    for i in range(80):
        t = some(r.randint(0, 40))
        for p in r.sample(passages, r.randint(0, 3)):
            a = r.randrange(len(p))
            t += p[a:] + some(r.randint(0, 9))
        rows.append((r.randint(7, 90), "\t ".join(t)))
    rows += [(100 + i, " ".join([*some(3), *passages[2], *some(3)])) for i in range(60)]
    return rows


@pytest.mark.parametrize("share", [1 / 2000, 0.0])
def test_matches_brute_force(spark, monkeypatch, share):
    if not share:  # every minimiser with over 8 strings is split
        monkeypatch.setattr(S, "HOT_SHARE", 1e-3)
        monkeypatch.setattr(S, "hot_minimisers", lambda docs, n, width, gram: np.sort(np.concatenate([S.super_kmers(t.encode().split(), 13, 3, np.zeros(0, np.uint64))[0] for _, t in sample() if t and len(t.split()) > 13])))
    df = spark.createDataFrame([(*x, "clash", 1) for x in sample()], "doc_id bigint, text string, bucket string, start int")
    got = S.without_repeats(df, buckets=7).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256, x.text) for x in got), key=str) == plain(sample())
    assert all(x.n_removed == sum(b - a for a, b in x.removed) for x in got)


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    class Same:
        def integers(self, low, high, n, kind):
            return np.ones(n, kind)

    strings = [b"a b c d", b"b c d e", b"c d a b"]
    want = S.repeated_windows(strings, np.array([3, 2, 1]), 3)
    monkeypatch.setattr(S.np.random, "default_rng", lambda _: Same())
    got = S.repeated_windows(strings, np.array([3, 2, 1]), 3)
    assert want[1].tolist() == got[1].tolist() == [3, 2, 2, 2, 1, 1]


def test_super_kmers_cover_each_window_once():
    words = [f"w{i % 17}".encode() for i in range(200)]
    keys, starts, n = S.super_kmers(words, 13, 3, np.zeros(0, np.uint64))
    assert n.sum() == 188 and starts[0] == 0 and (starts[1:] == np.cumsum(n)[:-1]).all() and len(keys) < 188


def test_empty_table(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []

import math
import random
import re

import numpy as np
import pytest

from lodestone.llm import lexical as L
from lodestone.llm.common import materialised

SMALL = L.SMALL_SIDE


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    sets = [(d, split(t)) for d, t in docs if split(t)]
    big_n, big_l = len(sets), sum(len(w) for _, w in sets)
    df = {}
    for _, w in sets:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        terms, scored = split(text), []
        for d, w in sets:
            m = 100 - 25 + (25 * len(w) * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 12 * m)) for t in terms if t in w)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def sample():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["É", "naïve", "a1b2"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(None, "w1 w2 rare"), (None, "rare"), (3, None), (4, ""), (5, "?! -"), (-7, "Rare W1"), (8, "w0 " * 3000), (9, "only"), (9, "only"), (2**63 - 1, "edge rare"), (-(2**63), "edge rare")]
    docs += [(r.randint(10, 400), r.choice([" ", "-", "\x00", "[", "\n"]).join(r.choices(vocab, weights, k=r.randint(1, 80)))) for _ in range(400)]
    docs += [(1000 + i, "twin w3 w4") for i in range(60)]
    items = [(f"i{i}", " ".join(r.choices(vocab, weights, k=r.randint(1, 30)))) for i in range(20)]
    return docs, items + [("none", "unknown words"), ("empty", ""), ("null", None), (None, "w5"), ("rep", "rare rare W9"), ("rep", "rare rare W9"), ("twin", "TWIN"), ("edge", "edge"), ("only", "only w0")]


@pytest.mark.parametrize("segment_bytes, small, k, step", [(1500, SMALL, 20, 32), (1 << 20, 0, 3, 1024), (400, SMALL, 1, 8)])
def test_matches_brute_force(spark, monkeypatch, segment_bytes, small, k, step):
    monkeypatch.setattr(L, "SMALL_SIDE", small)
    monkeypatch.setattr(L, "STEP", step)
    monkeypatch.setattr(L, "ITEMS", 7)
    docs, items = sample()
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id bigint, text string, segment string, term int").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, q int")
    index = materialised(L.build_index(d, segment_bytes=segment_bytes), "index")
    got = L.search(index, q, k)
    assert got.dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, k)
    assert index.where("term IS NULL").count() > (3 if segment_bytes < 2000 else 2)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame(x, f"{c} int, text string") for x, c in (([(1, "a b")], "doc_id"), ([(1, "a")], "item_id")))
    index = materialised(L.build_index(docs), "index")
    none = materialised(L.build_index(docs.limit(0)), "index")
    assert [tuple(x)[:3] for x in L.search(index, items).collect()] == [(1, 1, 1)]
    assert L.search(none, items).count() == L.search(index, items.limit(0)).count() == 0


def test_numbers_survive_packing():
    r = random.Random(1)
    x = np.array([0, 1, 127, 128, 2**14 - 1, 2**14, 2**62, *(r.randrange(2 ** r.randint(1, 62)) for _ in range(500))])
    data, ends = L.packed(x)
    assert (L.unpacked(data.tobytes()) == x).all() and ends[-1] == len(data)


def test_skipping_lists_loses_nothing():
    r = random.Random(6)
    for _ in range(60):
        n, k = r.randint(1, 300), r.randint(1, 8)
        lists = []
        for _ in range(r.randint(1, 6)):
            at = np.array(sorted(r.sample(range(n), r.randint(1, n))))
            lists.append((at, np.array([r.choice([1, 2, 3, 1000]) for _ in at]) * r.choice([1, 50, 2**45])))
        ids = [3 * i - 50 for i in range(n)]
        heap, total = [], {}
        for at, c in lists:
            for a, x in zip(at.tolist(), c.tolist(), strict=True):
                total[a] = total.get(a, 0) + x
        L.best_of(lists, ids, heap, k, lambda i, lists=lists: dict(zip(lists[i][0].tolist(), lists[i][1].tolist(), strict=True)))
        assert sorted(heap, reverse=True) == sorted(((s, -ids[a]) for a, s in total.items()), reverse=True)[:k]

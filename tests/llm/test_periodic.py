import hashlib
import random
import re
import zlib

import pytest

from lodestone.llm import periodic as P
from lodestone.llm.queries import op11_periodic_runs


def plain_runs(s, least):
    """By the definition: every stretch in which words q apart are identical, q being its smallest period."""
    n, out = len(s), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and s[i] == s[i + q]:
                i += 1
            w = s[a : i + q]
            if i > a and len(w) >= max(least, 2 * q) and not any(all(w[k] == w[k + d] for k in range(len(w) - d)) for d in range(1, q)):
                out.append((a, len(w), q))
            i += i == a
    return sorted(out)


def plain_row(doc, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n, h = len(w), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 12)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    kept = " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + k for s, k, q in runs))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(kept))


def words(r, n, kinds):
    return [r.randrange(kinds) for _ in range(n)]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_match_the_definition(least):
    r = random.Random(least)
    for _ in range(1500):
        s = words(r, r.randint(0, 45), r.randint(1, 4))
        if s and r.random() < 0.6:
            p, a = r.randint(1, 8), r.randrange(len(s))
            s = s[:a] + ((s[:p] * len(s))[: r.randint(1, 30)]) + s[a:]
        assert P.runs_of(s, least) == plain_runs(s, least)


def hard(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    r = random.Random(3)
    yield b[:n]
    yield [7] * n
    yield [7] * (n // 2) + [1] + [7] * (n // 2)
    yield list(range(n))
    yield list(range(n, 0, -1))
    yield [i.bit_count() & 1 for i in range(n)]
    yield [(i & -i).bit_length() for i in range(1, n)]
    yield (words(r, 97, 9) * n)[:n]
    yield words(r, n, 2)
    yield sum(([0] * k + [1] for k in range(int((2 * n) ** 0.5))), [])


def test_comparisons_grow_with_the_length():
    for s in hard(20_000):
        for letters in (s, [-x for x in s]):
            assert P.next_smaller(letters)[2] <= 4 * len(s)


def test_runs_of_hard_words():
    for s in hard(300):
        assert P.runs_of(s, 12) == plain_runs(s, 12)


def test_cutting_loses_no_run():
    r = random.Random(5)
    for _ in range(200):
        texts = []
        for _ in range(r.randint(1, 6)):
            w = words(r, r.randint(0, 60), r.choice([3, 30, 300]))
            a = r.randrange(len(w) + 1)
            texts.append([b"%d" % x for x in w[:a] + w[a : a + r.randint(1, 9)] * r.randint(1, 9) + w[a:]])
        assert P.text_runs(texts) == [plain_runs(t, 12) for t in texts]


def rows():
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(30)] + ["É", "a\xa0b", "nul\0"]
    out = [(None, None), (None, "so " * 40), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 3000), (4, "x " * 3000), (5, "a b " * 6), (6, "a b " * 5 + "a"), (7, "nul nul\0 " * 9)]
    for i in range(10, 260):
        w = [r.choice(vocab) for _ in range(r.randint(0, 70))]
        a = r.randrange(len(w) + 1)
        out.append((i, r.choice([" ", "\n", "\t \x0b"]).join(w[:a] + w[a : a + r.randint(1, 12)] * r.choice([1, 2, 3, 7]) + w[a:])))
    return out


def test_query_matches_brute_force(spark, tmp_path):
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows()], "doc_id bigint, text string, n_words int, runs string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes[:6]} == {"bigint"}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(plain_row(*x)) for x in rows())


def test_general_interface(spark):
    df = spark.createDataFrame([("a", "go go go go stop", 1), (None, "x y x y x y", 2)], "id string, body string, k0 int")
    got = {r.id: (r.k0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in P.collapse_runs(df, "body", ("id", "k0"), least=4).collect()}
    assert got == {"a": (1, 5, [(0, 4, 1)], "go stop"), None: (2, 6, [(0, 6, 2)], "x y")}
    assert P.collapse_runs(df.limit(0), "body", ("id",)).count() == 0
    with pytest.raises(ValueError):
        P.collapse_runs(df.withColumn("runs", df.id), "body", ("runs",))


def test_very_long_text(spark):
    r = random.Random(2)
    text = " ".join(f"{r.randrange(10**9)}" for _ in range(200_000)) + " again and" * 100_000
    got = P.collapse_runs(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [tuple(x) for x in got.runs] == [(200_000, 200_000, 2)] and got.collapsed.endswith(" again and") and got.n_words == 400_000

import math
import random
import zlib

import numpy as np

from lodestone.llm import langid, quality
from lodestone.llm.common import held_out

WORDS = {"aa": "the of and running house".split(), "bb": "der die und haus läuft".split()}


def docs():
    r = random.Random(1)
    rows = [(None, None, "aa"), (1, "", "bb"), (2, None, None), (3, "12 + 3!", "aa"), (3, "12 + 3!", "aa"), (4, "x " * 300_000, "aa")]
    for i in range(10, 500):
        lang = r.choice(["aa", "bb"])
        words = [r.choice(WORDS[lang]) for _ in range(r.randint(4, 40))]
        junk = i % 3 == 0
        rows.append((i, " ".join(w.upper() + "!!" if junk else w for w in words), lang))
    return rows


def frames(spark):
    d = spark.createDataFrame([(*x, "clash", 0.5) for x in docs()], "doc_id bigint, text string, lang string, predicted string, score double")
    l = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(10, 500)] + [(None, 1, 0), (11, None, 0), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")
    return d, l


def test_held_out_is_the_remainder_2(spark):
    got = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(x.h == (zlib.crc32(str(x.id).encode()) % 4 == 2) for x in got)


def test_quality_on_held_out_rows(spark):
    d, l = frames(spark)
    got = quality.score(d, quality.train(d, l)).withColumn("h", held_out()).collect()
    assert len(got) == len(docs()) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    held = [x for x in got if x.h and x.doc_id >= 10]
    assert sum(x.predicted == (x.doc_id % 3 != 0) for x in held) > 0.95 * len(held)


def test_scores_are_sparse_dot_products_in_any_piece_size(monkeypatch):
    text = b" ".join(f"w{i % 50}, Xy{i % 7}!!".encode() for i in range(400))
    w = np.random.default_rng(0).normal(size=1 << quality.BITS)
    i, x = quality.features(text, quality.Codes())
    for piece in (1 << 18, 64, 7):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert math.isclose(sum(w[k].sum() * v for k, v in quality.blocks(text, quality.Codes())), w[i] @ x, rel_tol=1e-9)


def test_training_ignores_held_out_labels(spark):
    d, l = frames(spark)
    flipped = l.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = quality.train(d, l), quality.train(d, flipped)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_language_on_held_out_rows(spark):
    d, _ = frames(spark)
    got = langid.predict(d, langid.train(d)).withColumn("h", held_out()).collect()
    want = {i: lang for i, _, lang in docs()}
    assert len(got) == len(docs()) and all(0 <= x.score <= 1 for x in got)
    assert all(x.lang_pred == "und" and x.score == 0 for x in got if x.doc_id in (None, 1, 2, 3))
    held = [x for x in got if x.h and x.doc_id and x.doc_id >= 10]
    assert sum(x.lang_pred == want[x.doc_id] for x in held) > 0.95 * len(held)


def test_batched_products_equal_kernel_regression():
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("abcdé "), 60)) for _ in range(40)]
    x = langid.presences(texts)
    marks, out, names = langid.fit(x, ["p", "q"] * 20, landmarks=16)
    sets = [set(np.flatnonzero(v)) for v in x]
    k = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets[:16]] for a in sets])
    assert names == ["p", "q"] and np.allclose(langid.normalised(x) @ marks.T, k, atol=1e-5)


def test_empty_tables(spark):
    d, l = frames(spark)
    assert quality.score(d.limit(0), quality.train(d.limit(0), l.limit(0))).collect() == []
    assert langid.predict(d.limit(0), langid.train(d.limit(0))).collect() == []


def test_fit_is_plain_ftrl():
    r = np.random.default_rng(7)
    rows = [(np.sort(r.choice(50, 6, replace=False)), r.random(6), int(r.random() < 0.3)) for _ in range(60)]
    w, bias = quality.fit_ftrl(rows, epochs=2)
    z, n, weight = {}, {}, {}
    share = sum(y for *_, y in rows) / len(rows)
    for _ in range(2):
        for idx, val, y in rows:
            x = dict(zip(idx.tolist(), (10.0 * val).tolist(), strict=True)) | {"bias": 1.0}
            for k in x:
                a = z.get(k, 0.0)
                weight[k] = 0.0 if abs(a) <= 1e-4 else -(a - math.copysign(1e-4, a)) / ((0.1 + math.sqrt(n.get(k, 0.0))) / 1.0 + 1e-3)
            p = 1 / (1 + math.exp(-sum(weight[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * (0.5 / share if y else 0.5 / (1 - share)) * v
                sigma = math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))
                z[k] = z.get(k, 0.0) + g - sigma * weight[k]
                n[k] = n.get(k, 0.0) + g * g
    final = {k: 0.0 if abs(a) <= 1e-4 else -(a - math.copysign(1e-4, a)) / ((0.1 + math.sqrt(n[k])) + 1e-3) for k, a in z.items()}
    assert math.isclose(bias, final["bias"], rel_tol=1e-9) and all(math.isclose(w[k], final.get(k, 0.0), rel_tol=1e-9, abs_tol=1e-12) for k in range(50))


def test_features_are_plain_ngrams():
    top = 1 << 64

    def slot(x, salt):
        x = (x + salt) * 0x9E3779B97F4A7C15 % top
        return ((x ^ x >> 31) * 0xBF58476D1CE4E5B9 % top) >> (64 - quality.BITS)

    text = "One two two, THREE 44 -- two two x".encode()
    tokens = quality.TOKEN.findall(text)
    h = [zlib.crc32(t) for t in tokens]
    s = [quality.shape(t) + 4096 * (t in tokens[max(0, i - 2) : i]) for i, t in enumerate(tokens)]
    want = {}
    for block, (x, orders) in enumerate(((h, 2), (s, 3))):
        for order in range(1, orders + 1):
            for i in range(order - 1, len(x)):
                y = x[i]
                for back in range(1, order):
                    y = (y * 1_000_003 + x[i - back]) % top
                k = slot(y, 11 + block if order == 1 else 100 * order + block)
                want[k] = want.get(k, 0.0) + 1 / len(tokens)
    got = dict(zip(*(v.tolist() for v in quality.features(text, quality.Codes())), strict=True))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_sample_is_bounded_in_bytes(spark):
    d, l = frames(spark)
    some, none = quality.train(d, l, sample_bytes=20_000), quality.train(d, l, sample_bytes=1)
    assert np.any(some[0]) and not np.any(none[0]) and none[1] == 0


def test_prediction_is_kernel_ridge_regression(spark):
    """Against the same regression written with sets of n-grams and explicit kernels."""
    r = random.Random(9)
    letters = {"aa": "abcdefgh ", "bb": "defghijk ", "cc": "hijklmno "}
    rows = [(i, "".join(r.choices(letters[lang], k=r.randint(20, 80))), lang) for i, lang in enumerate(r.choices(list(letters), k=90))]
    schema = "doc_id bigint, text string, lang string, l string, rate double, u double"
    d = spark.createDataFrame([(*x, "clash", 0.5, 0.5) for x in rows], schema)
    top = 1 << 64

    def grams(t):
        c, out = [ord(x) for x in " " + t.lower() + " "], set()
        for n in (1, 2, 3, 4):
            for i in range(len(c) - n + 1):
                x = c[i]
                for k in range(1, n):
                    x = (x * 0x100000001B3 + c[i + k]) % top
                out.add(((x + n) * 0x9E3779B97F4A7C15 % top) >> (64 - langid.SLOT_BITS))
        return out

    model = langid.train(d)
    kept = [(i, t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    marks, out, names = model
    assert names == ["aa", "bb", "cc"] and len(marks) == min(len(kept), 128)
    sets, y = [grams(t) for _, t, _ in kept], [names.index(g) for *_, g in kept]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    # here every training text is a landmark, so the map is exact: weighted ridge regression in the kernel's own space
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    value, vector = np.linalg.eigh(k)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = np.hstack([k @ root, np.ones((len(k), 1))])
    weight = np.diag(1 / np.bincount(y)[y])
    target = 2 * np.eye(3)[y] - 1
    ridge = 1e-2 * 3 / phi.shape[1] * np.eye(phi.shape[1])
    beta = np.linalg.solve(phi.T @ weight @ phi + ridge, phi.T @ weight @ target)
    got = {x.doc_id: x for x in langid.predict(d, model).collect()}
    for i, t, _ in rows:
        f = np.append(np.array([kernel(grams(t), b) for b in sets]) @ root, 1.0) @ beta
        assert got[i].lang_pred == names[int(f.argmax())] and abs(got[i].score - min(1, max(0, (f.max() + 1) / 2))) < 1e-3

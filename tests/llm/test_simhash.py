import random

from lodestone.llm import simhash
from tests_llm_plain import plain_components, plain_fingerprint


def test_fingerprint_matches_a_plain_one():
    r = random.Random(1)
    texts = ["", " \t\n", "One", "Two Words", "É A\x0bB\x0cC\xa0D e", "x " * 5000]
    texts += [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(1, 200))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)
    assert simhash.fingerprint(None) == 0


def test_bands_cover_all_bits_once():
    for g in range(4, 17):
        masks = simhash.band_masks(g)
        assert sum(masks) == (1 << 64) - 1 and len(masks) == g


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id string")
    return simhash.near_duplicates(df)


def test_components_match_brute_force(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, None), (3, None), (9, ""), (9, ""), (12, "  "), (None, "same text again here")]
    for g in range(12):
        base = [r.choice(words) for _ in range(r.choice([5, 60, 300]))]
        for _ in range(r.randint(1, 14)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((r.randint(1, 10_000), " ".join(copy)))
    got = run(spark, [(i, t, "clash", "clash") for i, t in rows]).collect()
    want_fp = [(i, plain_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f, c) for (i, f), c in zip(want_fp, plain_components(want_fp), strict=True)), key=str)
    assert sorted(((x.doc_id, x.fp % (1 << 64), x.component_id) for x in got), key=str) == want
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id bigint, text string, fp string, root string")
    left = simhash.survivors(df)
    assert left.columns == df.columns
    ids = [x.doc_id for x in left.collect()]
    components = {c for *_, c in want}
    assert sorted(ids, key=str) == sorted(components, key=str)


def test_empty_table(spark):
    assert run(spark, []).collect() == []


def test_dense_groups_stay_linear(spark):
    """Fingerprints around one centre: linked through cells without all pairs, same components as brute force."""
    from lodestone.llm.common import connected_components

    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(5, 5), (None, 4)] + [(1000, i) for i in range(1001, 1200)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label

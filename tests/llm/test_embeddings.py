import random

import numpy as np
import pytest

from lodestone.llm import embeddings as E


def plain(rows, cosine=0.93):
    def fit(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if lab is not None and fit(v) else None for _, v, lab in rows]
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    part = list(range(n))
    for i in range(n):
        for j in near[i]:
            a, b = part[i], part[j]
            if a != b:
                part = [a if x == b else x for x in part]
    out = []
    for i in range(n):
        least = min((rows[j][0] for j in range(n) if part[j] == part[i] and rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=str)


def sample(n=400, dim=12, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(14, dim))
    rows = []
    for i in range(n):
        kind = i % 5
        v = r.normal(size=dim) if kind == 0 else centres[r.integers(14)] + r.normal(size=dim) * (0.02, 0.15, 0.25, 0.3)[kind - 1]
        rows.append((int(i * 7 % 1009), v.astype(np.float32).tolist(), [0, 0, 0, 1, None][r.integers(5)]))
    rows += [(2000 + i, rows[1][1], 0) for i in range(80)]  # copies
    rows += [(2200 + i, (np.array(rows[1][1]) * (i + 2)).tolist(), 0) for i in range(10)]  # the same direction
    chain = np.array([[np.cos(a), np.sin(a)] + [0] * (dim - 2) for a in np.arange(0, 3, 0.3)])
    rows += [(3000 - i, v.tolist(), 2) for i, v in enumerate(chain)]
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [None, *[1.0] * (dim - 1)], [float("inf"), *[1.0] * (dim - 1)], [1.0, 0.0], [1.0, 0.01]]
    rows += [(4000 + i, v, 0) for i, v in enumerate(bad)] + [(None, rows[1][1], 0), (None, [5.0, 5.0, -5.0], 1), (4100, [1e30] * dim, 1), (4101, [1e-30] * dim, 1), (4000, [1.0] * 3, 0)]
    return rows


@pytest.mark.parametrize("cell, fan, tile", [(2048, 32, 2048), (12, 4, 7)])
def test_matches_brute_force(spark, cell, fan, tile):
    rows = sample()
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id bigint, embedding array<float>, label int, cell string").repartition(3)
    got = E.near_vectors(df, cell=cell, fan=fan, tile=tile)
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_groups_of_near_copies_and_their_surroundings(spark):
    """Two groups, one of them with vectors that link to some of it only, among unrelated vectors."""
    r = np.random.default_rng(2)
    centre = r.normal(size=(2, 32))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    rows = [(i, (centre[i % 3 % 2] + 0.012 * r.normal(size=32)).astype(np.float32).tolist(), "a/1") for i in range(900)]
    rows += [(1000 + i, r.normal(size=32).astype(np.float32).tolist(), "a/1") for i in range(200)]
    rows += [(2000 + i, (centre[0] + r.uniform(0.03, 0.09) * r.normal(size=32)).astype(np.float32).tolist(), "a/1") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label string")
    got = E.near_vectors(df, cell=50, fan=8, tile=64).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    assert any(0 < x.n_links < 599 for x in got if x.vec_id >= 2000)


def test_a_split_keeps_pivots_apart(spark):
    r = np.random.default_rng(4)
    rows = [(i, (np.eye(8)[i % 2] + 0.01 * r.normal(size=8)).tolist(), 1) for i in range(600)]
    got = E.near_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int"), cell=40, fan=16, tile=32).collect()
    assert {(x.n_links, x.component_id) for x in got} == {(299, 0), (299, 1)}


def test_a_border_case_is_summed_exactly():
    x = np.array([[1.0, 0.0]])
    y = np.array([[0.93, np.sqrt(1 - 0.93**2)], [0.93 - 1e-9, np.sqrt(1 - (0.93 - 1e-9) ** 2)]])
    assert E.linked(x, y, 0.93).tolist() == [[True, False]]


def test_stars_span_all_links():
    r = random.Random(3)
    for _ in range(50):
        a = np.array([[r.random() < 0.15 for _ in range(9)] for _ in range(8)])
        seen = [(set(x.tolist()), set(y.tolist())) for x, y in E._stars(a)]
        assert sum(len(x) for x, _ in seen) == a.any(1).sum() and sum(len(y) for _, y in seen) == a.any(0).sum()
        assert all(sum(i in x and j in y for x, y in seen) == 1 for i, j in zip(*np.nonzero(a), strict=True))


def test_empty_and_doubles(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1)], "id int, v array<double>, l int")
    assert sorted(map(tuple, E.near_vectors(df, vec_id="id", vector="v", label="l").collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert E.near_vectors(df.limit(0), vec_id="id", vector="v", label="l").count() == 0
    with pytest.raises(ValueError):
        E.near_vectors(df, 0.2)

import numpy as np
import pytest

from wayside.llm import vectors
from wayside.llm.components import components


def brute(rows, cosine):
    """n_links and smallest reachable id by all pairs."""
    ids = [i for i, _ in rows]
    unit = []
    for _, v in rows:
        x = None if not v or any(c is None for c in v) else np.array(v, dtype=float)
        unit.append(None if x is None or not np.isfinite(x).all() or not x.any() else x / np.abs(x).max() / np.sqrt(((x / np.abs(x).max()) ** 2).sum()))
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (n[i], least[find(i)], least[find(i)] == ids[i]) for i in range(len(rows))}


def made(seed, n, width):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, width))
    x = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, width)) * rng.choice([0.02, 0.25, 0.5], (n, 1))
    x[rng.random(n) < 0.1] = x[0]
    return x


@pytest.mark.parametrize(("seed", "width", "block"), [(1, 6, 37), (2, 24, 64)])
def test_links_equal_all_pairs(spark, seed, width, block):
    x = made(seed, 400, width)
    rows = [(int(i) * 7, [float(v) for v in r]) for i, r in zip(np.random.default_rng(seed).permutation(400), x, strict=True)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * width), (5003, [1.0, None]), (5004, [float("nan")] * width), (5005, [float("inf")] * width), (5006, [1.0, 0.0]), (5007, [2.0, 0.0]), (5008, [c * 1e200 for c in rows[0][1]])]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "vec_id long, embedding array<double>, label int, members string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df, block=block).collect()}
    assert got == brute(rows, 0.9)


def test_rows_without_id_and_no_rows(spark):
    df = spark.createDataFrame([(None, [1.0]), (None, None), (1, [1.0]), (2, [3.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in vectors.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 0, None, False)] * 2 + [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)], key=str)
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [0])
def test_components_equal_search(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(0, i) for i in range(2000, 2100)] + [(7, 7), (None, 1)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = {}
    for a, b in pairs:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [] if start in want else [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

import hashlib
import math

import numpy as np
import pytest

from wayside.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label string, q string, salt string, code int"


def brute(rows, parts, entries, rounds, scale):
    """Codes and codebooks by comparing with every entry, in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for k in range(len(first)):
                mine = [cut(v, p) for (_, v, _), n in zip(kept, near, strict=True) if n[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, label, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n)) for (i, _, label), n in zip(kept, assign(), strict=True)]
    by_label = {}
    for _, label, _, error in out:
        by_label[label] = by_label.get(label, 0) + error
    return sorted(((i, code, error, by_label[label]) for i, label, code, error in out), key=str), books


def made(seed, n, width):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)) * rng.choice([0.1, 1.0], (n, 1))
    x[rng.random(n) < 0.3] = x[0]
    return [(int(i) % 150 * 3, [float(c) for c in v], rng.choice([None, "a", "b"], p=[0.6, 0.3, 0.1])) for i, v in enumerate(x)]


@pytest.mark.parametrize(("seed", "width", "entries", "scale"), [(1, 8, 40, 16), (2, 4, 64, 2)])
def test_equals_every_entry(spark, seed, width, entries, scale):
    rows = made(seed, 260, width)
    rows += [(None, rows[5][1], None), (None, [0.0] * width, "a"), (7, None, "a"), (8, [None] * width, None), (9, [float("nan")] * width, None), (10, [float("inf")] * width, None)]
    df = spark.createDataFrame([(*r, "clash", "clash", 3) for r in rows], SCHEMA).repartition(3)
    coded, books = codes.encode(df, parts=4, entries=entries, scale=scale)
    got = sorted((tuple(r) for r in codes.with_label_error(coded).select("vec_id", "code", "error", "label_error").collect()), key=str)
    want, want_books = brute(rows, 4, entries, 2, scale)
    assert got == want and books.tolist() == want_books


def test_other_lengths_few_rows_and_none(spark):
    rows = [(1, [], "x"), (2, [1.0, 2.0, 3.0], "x"), (3, [0.5, 1.5], "x"), (4, [0.5, 1.5], None), (5, [1.0] * 4, "x")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    coded, books = codes.encode(df, parts=2)
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in codes.with_label_error(coded).collect()}
    assert got == {1: (None, None, 0), 2: (None, None, 0), 3: ("0000", 0, 0), 4: ("0000", 0, 0), 5: (None, None, 0)}
    assert books.shape == (2, 2, 1)
    coded, books = codes.encode(df.limit(0))
    assert codes.with_label_error(coded).count() == 0 and books.size == 0


@pytest.mark.parametrize(("seed", "width", "spread"), [(0, 1, 3), (1, 3, 2), (2, 4, 200), (3, 6, 2**25)])
def test_tree_finds_the_lowest_of_the_nearest(seed, width, spread):
    rng = np.random.default_rng(seed)
    entries, queries = rng.integers(-spread, spread, (64, width)), rng.integers(-spread, spread, (2000, width))
    found = codes.Search(codes.Gnat(entries, np.arange(64)), queries)
    d = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (found.index == d.argmin(axis=1)).all() and (found.distance == d.min(axis=1)).all()
    if width < 6:
        assert found.measured < d.size  # whole subtrees were left out


def test_query_equals_every_entry(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, books = brute(rows, 16, 64, 2, 256)
    got = codes.op13_codes(spark, sf).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}

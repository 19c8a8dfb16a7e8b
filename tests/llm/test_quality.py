import numpy as np

from wayside.llm import quality
from wayside.llm.ridge import CELLS, Isotonic


def auc(score, y):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        ranks[score == v] = ranks[score == v].mean()
    p = y.sum()
    return (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(2)
    at = np.sort(rng.choice(CELLS, 30, replace=False))
    n, p = np.zeros(CELLS), np.zeros(CELLS)
    n[at] = rng.integers(1, 9, 30)
    p[at] = np.minimum(n[at], rng.integers(0, 9, 30))
    fitted = Isotonic(n, p)
    assert (np.diff(fitted.y) >= -0.2).all() and (np.diff(fitted.x) > 0).all()
    mean = p[at] / n[at]
    # minimax form of isotonic regression
    want = [max(min(np.average(mean[a : b + 1], weights=n[at][a : b + 1]) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert len(np.unique(np.round(want, 9))) == len(fitted.y)


def test_statistics_of_odd_texts():
    rows = quality.statistics([b"", b"  \n", "é".encode(), b"word " * 100000, b"a\nb\na"])
    assert rows.shape == (5, quality.WIDTH) and np.isfinite(rows).all() and not rows[0].any()


def test_learn_and_score(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "###".join(rng.choice(["one", "two", "three", "four"], 20)) if i % 2 else " ".join(rng.choice(["one", "two", "three", "four"], 20)), "x", 7.0) for i in range(200)]
    rows += [(200, None, "x", 7.0), (201, "", "x", 7.0), (None, "one two", "x", None), (0, rows[0][1], "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(200)] + [(None, 1, 1), (3, None, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 204 and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    empty = quality.learn(docs, labels.limit(0))
    assert {round(r["score"], 2) for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.op1_quality(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    print(auc(rows["score"].to_numpy(), rows["quality"].to_numpy()))
    assert auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.9

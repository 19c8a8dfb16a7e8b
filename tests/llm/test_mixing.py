import numpy as np
from pyspark.sql import functions as F

from wayside.llm import mixing


def plain_fit(p, tokens, targets, steps):
    """Projected gradient on the whole vector of rates."""
    share, total = np.array(targets) / np.sum(targets), tokens.sum()
    rate = np.ones(len(p))
    for step in range(steps):
        residual = (rate * tokens) @ p / total - share
        if np.abs(residual).max() < mixing.CLOSE or step == steps - 1:
            break
        gram = (p * (tokens * (rate > 0))[:, None]).T @ p / total
        rate = np.maximum(0, rate - p @ np.linalg.solve(gram + mixing.RIDGE * np.eye(p.shape[1]), residual))
    return rate


def test_rates_equal_plain_projected_gradient(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.2, 0.1], 500)
    tokens = rng.integers(0, 900, 500)
    df = spark.createDataFrame([(i, int(t), *map(float, x)) for i, (t, x) in enumerate(zip(tokens, p, strict=True))], "i int, n_tokens long, a double, b double, c double")
    rate, reached = mixing.fit_rates(df, ["a", "b", "c"], [0.1, 0.2, 0.7])
    got = np.array([r[0] for r in df.orderBy("i").select(rate.alias("r")).collect()])
    assert np.allclose(got, plain_fit(p, tokens, [0.1, 0.2, 0.7], mixing.STEPS))
    assert (got >= 0).all() and np.abs((got * tokens) @ p / tokens.sum() - [0.1, 0.2, 0.7]).max() < 1e-3 and np.allclose(reached, (got * tokens) @ p / tokens.sum())


def documents(spark):
    rows = [(i, ("plain words of an article about rivers " if i % 3 else "JUNK!!! $$$ JUNK!!! ") * (1 + i % 5), "x", 1.5) for i in range(90)]
    rows += [(90, None, "x", 1.5), (91, "", None, None), (None, "plain words", "x", None), (1, rows[1][1], "x", 1.5), (93, "river " * 40000, "x", None)]
    labels = [(i, "good" if i % 3 else "poor") for i in range(60)] + [(None, "good"), (3, None), (1, "other"), (999, "good")]
    return spark.createDataFrame(rows, "doc_id long, text string, rate string, f_words double"), spark.createDataFrame(labels, "doc_id long, domain string")


def test_mix(spark):
    docs, labelled = documents(spark)
    got = mixing.mix(docs, labelled, {"good": 0.5, "poor": 0.5}).collect()
    assert len(got) == 95
    for r in got:
        assert abs(r["p_good"] + r["p_poor"] - 1) < 1e-9 and r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1
        if r["doc_id"] is not None and r["doc_id"] < 90:
            assert (r["p_good"] > 0.5) == (r["doc_id"] % 3 > 0)
    assert {r["doc_id"]: r["n_tokens"] for r in got}[93] == 40000 and {r["n_tokens"] for r in got if r["doc_id"] in (90, 91)} == {0}
    expected = sum(r["rate"] * r["n_tokens"] * r["p_good"] for r in got) / sum(r["n_tokens"] for r in got)
    assert abs(expected - 0.5) < 0.01


def test_no_labels_and_no_rows(spark):
    docs, labelled = documents(spark)
    got = mixing.mix(docs, labelled.limit(0), {"good": 0.5, "poor": 0.5}).collect()
    assert {round(r["p_good"], 6) for r in got} == {0.5} and {round(r["rate"], 3) for r in got} == {1.0}
    assert mixing.mix(docs.limit(0), labelled, {"good": 0.5, "poor": 0.5}).count() == 0


def test_targets_on_documents(spark):
    rows = mixing.op10_mixing(spark, "/root/testdata/sf0.01")
    assert not [f for f in ("Python", "Arrow", "Pandas") if f in rows._jdf.queryExecution().executedPlan().toString()]
    total = rows.agg(F.sum("n_tokens")).first()[0]
    for d, share in mixing.TARGETS.items():
        assert abs(rows.agg(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}"))).first()[0] / total - share) < 0.01


def test_statistics_in_two_passes_count_every_character(spark):
    """Symbols and capitals by one pass over the text and one over what it leaves, equal to a count in plain Python."""
    import string

    texts = [None, "", "A", "~!-]^[\\`{}", "É\u00dfZ z\U0001f600Q.\n\tX", string.printable * 3, "plain", "ÀÁ" * 50 + "AZ@[`{/:09az"]
    rows = mixing.with_statistics(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
    for r in rows.collect():
        text = r["text"] or ""
        symbols, capitals = (sum(ch in kind for ch in text) for kind in (string.punctuation, string.ascii_uppercase))
        assert r["f_symbols"] == 1 - (len(text) - symbols) / (len(text) + 1) and r["f_capitals"] == 1 - (len(text) - capitals) / (len(text) + 1)
    assert "translate" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_marks_are_looked_up_by_domain(spark):
    model = mixing.SoftMembership(["a", "b", "c"])
    model.words = {"a": ["x", "y"], "b": ["y", "z"], "c": []}
    docs = spark.createDataFrame([(0, ["x", "y", "q"]), (1, ["z"]), (2, []), (3, ["", "q"])], "i int, _words array<string>")
    got = {r["i"]: [round(np.expm1(r[f"f_marks{k}"])) for k in range(3)] for r in model.with_features(docs).collect()}
    assert got == {0: [2, 1, 0], 1: [0, 1, 0], 2: [0, 0, 0], 3: [0, 0, 0]}

import numpy as np

from wayside.llm import toxicity
from wayside.llm.words import words_and_beginnings


def test_features_equal_plain_words():
    texts = ["Idiot! été straßen, IDIOTIC", "", "x1 y", "été"]
    hashes, of = words_and_beginnings([t.encode() for t in texts], (4,))
    by = [set(hashes[of == i].tolist()) for i in range(4)]
    idiot, idio = (words_and_beginnings([w.encode()], (4,))[0][k] for w, k in (("idiot", 0), ("idiotx", 1)))
    assert int(idiot) in by[0] and int(idio) in by[0] and not by[1] and len(by[2]) == 2
    assert len(by[3]) == 2 and by[3] <= by[0]  # the word has five bytes


def docs_and_labels(spark):
    rng = np.random.default_rng(0)
    plain = [f"word{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(400):
        rude, threat = i % 4 == 0, i % 8 == 0
        words = [*rng.choice(plain, 20), *(["insultor"] if rude else []), *(["menace"] if threat else [])]
        rows.append((i, " ".join(rng.permutation(words)), "x", 1.0))
        labels.append((i, int(rude), int(threat)))
    rows += [(1000, None, "x", 1.0), (1001, "", "x", 1.0), (None, "insultor", "x", 1.0), (0, rows[0][1], None, None)]
    labels += [(None, 1, 1), (5, None, 1), (0, 1, 1), (9999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, fold string, p_rude double"), spark.createDataFrame(labels, "doc_id long, rude int, threat int")


def test_chain(spark):
    docs, labels = docs_and_labels(spark)
    model = toxicity.learn(docs, labels, ["rude", "threat"])
    assert len(model.links[1][0]) == len(model.links[0][0]) + 1
    got = toxicity.score(docs, model).collect()
    assert len(got) == 404
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 1000:
            assert (r["p_rude"] > 0.5) == (r["doc_id"] % 4 == 0) and (r["p_threat"] > 0.5) == (r["doc_id"] % 8 == 0)
    odd = {r["doc_id"]: r for r in got if r["doc_id"] in (None, 1000, 1001)}
    assert odd[None]["p_rude"] > 0.5 and odd[1000]["p_rude"] == odd[1001]["p_rude"] < 0.5


def test_no_labels_and_no_rows(spark):
    docs, labels = docs_and_labels(spark)
    model = toxicity.learn(docs, labels.limit(0), ["rude", "threat"])
    assert {round(r["p_threat"], 2) for r in toxicity.score(docs, model).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("toxic", "label")
    rows = toxicity.op2_toxicity(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    caught = rows[rows["label"] == 1]["toxic"].mean()
    wrong = rows[rows["label"] == 0]["toxic"].mean()
    print(caught, wrong)
    assert caught > 0.75 and wrong < 0.02

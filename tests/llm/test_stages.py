"""Stages over tables that no corpus should have, but some do."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
ROWS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHING = ["f_words", "_words", "_u", "_text", "_own", "secret_spans", "_rules", "_id", "lang_pred", "score", "rate", "copies", "n_tokens", "p_good", "_copy", "component_id", "kept", "a.b"]
STAGES = dict(corpus_pipeline.STAGES)
LONG = "the river runs past the old mill and " * 30_000


def odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and ids, secrets; every row repeats in its clashing columns what it is."""
    plain = [r[:5] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(40).collect()]
    plain = [tuple(r) for r in plain]
    secret = "the garden of the house has a gate, its token = abcdef123456 and no more"
    odd = [
        (10**6, None, None, None, None),
        (10**6 + 1, "", "en", "s", 0),
        (None, "the people of the town have the right to speak", None, "s", None),
        (None, None, None, None, None),
        (10**6 + 2, LONG, None, "s", len(LONG)),
        (10**6 + 3, secret, None, "s", len(secret)),
        (10**6 + 3, secret, None, "s", len(secret)),
        (10**6 + 3, "another text of the same id about the weather of the coast", None, "s", 5),
    ]
    docs = spark.createDataFrame(plain + odd, ROWS)
    return docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})


def key(r):
    return (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])


@pytest.fixture(scope="module")
def docs(spark):
    return odd_rows(spark).cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, name):
    empty = spark.createDataFrame([], ROWS).withColumn("f_words", F.lit("x"))
    got = STAGES[name](spark, empty, SF)
    assert got.collect() == [] and (name == "packing" or got.columns == empty.columns)


@pytest.mark.parametrize("name", ["language", "near_duplicates", "secrets", "mixing"])
def test_clashing_columns_come_back(spark, docs, name):
    rows = STAGES[name](spark, docs, SF).collect()
    assert rows
    for r in rows:
        assert list(r.asDict()) == docs.columns
        assert all(r[c] == c + str("none" if r["doc_id"] is None else r["doc_id"]) for c in CLASHING)


def test_language(spark, docs):
    got = Counter(map(key, STAGES["language"](spark, docs, SF).collect()))
    ids = Counter(k[0] for k in got.elements())
    assert 10**6 not in ids and 10**6 + 1 not in ids  # no letters
    assert ids[10**6 + 2] == 1 and ids[10**6 + 3] == 3 and ids[None] == 1
    assert all(k[2] for k in got)


def test_near_duplicates(spark, docs):
    before, got = Counter(map(key, docs.collect())), Counter(map(key, STAGES["near_duplicates"](spark, docs, SF).collect()))
    assert not got - before and max(got.values()) == 1
    ids = Counter(k[0] for k in got.elements())
    assert ids[None] == 2 and ids[10**6] == 1 and ids[10**6 + 1] == 1 and ids[10**6 + 2] == 1 and ids[10**6 + 3] == 2


def test_secrets(spark, docs):
    before, rows = docs.collect(), STAGES["secrets"](spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in before)
    hidden = [r for r in rows if r["doc_id"] == 10**6 + 3 and "[SECRET]" in r["text"]]
    assert len(hidden) == 2 and all("abcdef123456" not in r["text"] and r["n_chars"] == len(r["text"]) for r in hidden)
    same = Counter(map(key, before)) & Counter(map(key, rows))
    assert {None, 10**6, 10**6 + 1, 10**6 + 2} <= {k[0] for k in same}


def test_mixing(spark, docs):
    got = Counter(map(key, STAGES["mixing"](spark, docs, SF).collect()))
    before = Counter(map(key, docs.collect()))
    assert set(got) <= set(before)
    for k, n in before.items():  # equal rows are repeated equally often
        assert got[k] % n == 0


def test_packing(spark, docs):
    rows = STAGES["packing"](spark, docs, SF).collect()
    pieces = Counter((r["doc_id"], r["piece"]) for r in rows)
    assert pieces[10**6, 0] == 1 and pieces[10**6 + 1, 0] == 1 and pieces[10**6 + 3, 0] == 3 and pieces[None, 0] == 2
    long = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == 10**6 + 2)
    assert len(long) > 10 and all(s == 4096 * i and n <= 4096 for i, (s, n) in enumerate(long))

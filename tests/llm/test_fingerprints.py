import hashlib

import numpy as np
import pytest

from wayside.llm import fingerprints as fp


def plain_rows(rows):
    ordered = sorted(((i is not None, i or 0, t or "", i) for i, t in rows), key=lambda r: r[:3])
    for k, (_, _, text, doc_id) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][2]
        n = len(text) // 4
        yield doc_id, text, (text[:-n] if n else text) + following[:n], following


@pytest.mark.parametrize("buckets", ["1", "3", "7"])
def test_edited_texts(spark, buckets):
    words = ["river", "stone", "überall", "Été", "日本", "x1"]
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(0, 30)))) for i in rng.permutation(40) * 3]
    rows += [(None, "no id"), (None, None), (5, None), (5, "twice"), (5, "twice"), (200, "long " * 20000)]
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _tail string, _bucket int")
        got = fp.compare_with_next(docs, fp.lexicon(docs)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = [(i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in plain_rows(rows)]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted([(r[0], r[1], r[2]) for r in got], key=key) == sorted(want, key=key)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")
    r = fp.compare_with_next(one, fp.lexicon(one)).collect()[0]
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(("a b c d e f g h"[:-3] + "a b").encode()).hexdigest()
    assert fp.compare_with_next(one.limit(0), fp.lexicon(one.limit(0))).count() == 0


def test_equal_texts_have_equal_fingerprints_and_likeness_follows_jaccard():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    for size in (8, 100, 2000):
        for share in (0.0, 0.5, 0.75, 1.0):
            guesses = []
            for _ in range(20):
                pool = rng.permutation(vocabulary)[: 2 * size]
                same = int(share * size)
                a, b = pool[:size], [*pool[:same], *pool[size : 2 * size - same]]
                n, h = fp.fingerprints([" ".join(a).encode(), " ".join(rng.permutation(b)).encode()], np.empty(0, dtype=np.uint64))
                guesses.append(fp.likeness(n[:1], h[:1], n[1:], h[1:])[0])
            assert abs(np.mean(guesses) - share * size / (2 * size - int(share * size))) < 0.12
            assert share < 1 or min(guesses) == 1.0


def test_lexicon_band(spark):
    docs = spark.createDataFrame([(i, f"all {'half' if i % 2 else ''} pair{i // 2} one{i}") for i in range(40)], "doc_id long, text string")
    pairs = {int(x) for i in range(20) for x in fp.distinct_terms([f"pair{i}".encode()])[0]}
    assert {int(x) for x in fp.lexicon(docs)} == pairs
    assert len(fp.lexicon(docs, most=1.0, size=1)) == 1


def test_documents_near_their_edits(spark):
    rows = fp.op4_fingerprint(spark, "/root/testdata/sf0.01").toPandas()
    assert (rows["near_edited"] > rows["near_next"]).mean() > 0.9
    assert rows["near_edited"].median() > 0.4 and rows["near_next"].median() < 0.25

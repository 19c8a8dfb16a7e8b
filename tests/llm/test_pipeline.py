from collections import Counter

import numpy as np
from test_minhash import plain_set
from test_packing import holds, ids_of
from test_secrets import plain_spans

import corpus_pipeline
from wayside.llm import language, mixing, packing

SF = "/root/testdata/sf0.001"


def plain_groups(rows):
    """Row numbers of the document that stays of each group, by all pairs."""
    sets = [plain_set(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return {r["doc_id"] for i, r in enumerate(rows) if least[find(i)] == r["doc_id"]}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12 34 ###", None, "s", 9), (10**6 + 1, None, None, None, None), (10**6 + 2, 'the house token = "abcdef123456"', None, None, 32)], docs.schema)
    docs = docs.unionByName(extra).cache()
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        results.append(stage(spark, results[-1], SF).cache())
    rows = [r.collect() for r in results]
    for r in results[1:5]:
        assert r.columns == docs.columns

    model = language.learn(docs)
    def known(text):  # the share of n-grams of one text alone
        shares, total = model.shares([(text or "").lower()])
        return total[0] > 0 and shares.max() >= corpus_pipeline.LEAST_KNOWN
    assert {r["doc_id"] for r in rows[1]} == {r["doc_id"] for r in rows[0] if known(r["text"])}
    assert {r["doc_id"] for r in rows[0]} - {r["doc_id"] for r in rows[1]} >= {10**6, 10**6 + 1} and all(r["lang"] for r in rows[1])

    assert Counter(r["doc_id"] for r in rows[2]) == Counter(plain_groups(rows[1]))

    before = {r["doc_id"]: r for r in rows[2]}
    assert len(rows[3]) == len(rows[2])
    for r in rows[3]:
        text, out, at = before[r["doc_id"]]["text"], "", 0
        for start, _, end in plain_spans(text):
            out, at = (out + text[at:start] + "[SECRET]" if start >= at else out), max(at, end)
        assert r["text"] == out + text[at:] and r["n_chars"] == len(r["text"])

    rates = {r["doc_id"]: r for r in mixing.mix(results[3], mixing.domains_of(spark.read.parquet(f"{SF}/labels.parquet")), mixing.TARGETS).collect()}
    assert Counter(r["doc_id"] for r in rows[4]) == Counter({k: r["copies"] for k, r in rates.items() if r["copies"]})

    holds(rows[5], packing.CAPACITY)
    want = Counter()
    for r in rows[4]:
        n = len(ids_of(r["text"]))
        want.update((r["doc_id"], i, at, min(4096, n - at)) for i, at in enumerate(range(0, n, 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows[5]) == want
    tokens = sum(r["length"] for r in rows[5])
    assert len({r["sequence_id"] for r in rows[5]}) <= np.ceil(tokens / 4096) * 1.05 + 1


def test_registered(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())

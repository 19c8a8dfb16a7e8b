import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayside.llm import minhash

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_set(text):
    words = WORD.findall((text or "").translate(UPPER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    """(doc_id, n, component, kept) of every row by all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(s), least.get(find(i)), doc is not None and doc == least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    passage, license_line, texts = word(60), word(12), []
    for _ in range(25):  # groups of copies with some words changed
        original = word(int(rng.choice([6, 30, 90, 300])))
        for _ in range(int(rng.integers(1, 8))):
            copy = list(original)
            for at in rng.integers(0, len(copy), int(len(copy) * rng.choice([0, 0.01, 0.03, 0.06]))):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    for _ in range(40):  # one passage with more or less around it
        texts.append(" ".join([*word(int(rng.integers(0, 12))), *passage, *word(int(rng.integers(0, 25)))]))
    for _ in range(20):
        texts.append(" ".join([*word(50), *license_line]))
    texts += [texts[0]] * 30 + ["Some SHORT text", "some short\ttext ", "a b c d e", "A B C D E", "x", "\u00c9t\u00e9 a b c d", "\u00e9t\u00e9 a b c d", "", "  \n", None, "long " * 30000, "long " * 30001]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) * 3, texts, strict=True)]
    return [*rows, (None, texts[0]), (None, None), rows[5], (rows[0][0], "another text under one of the ids")]


@pytest.mark.parametrize("common", [64, 4])
def test_components_equal_all_pairs(spark, monkeypatch, common):
    monkeypatch.setattr(minhash, "COMMON", common)
    monkeypatch.setattr(minhash, "LEADERS", 256 if common == 64 else 2)
    rows = corpus(common)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, rep string, n_shingles int")
    assert sorted((tuple(r) for r in minhash.near_documents(df).collect()), key=str) == brute(rows)


def test_union_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = np.concatenate([a[:450], rng.integers(0, 2**63, 60, dtype=np.uint64)])
    pack = lambda x: np.sort(x)[: minhash.KEPT].tobytes()
    left, right = minhash._filled([pack(a), pack(a[:10]), b""]), minhash._filled([pack(b), pack(a[:9]), b""])
    got = minhash.union_estimate(left, right)
    union = np.sort(np.union1d(a, b))[: minhash.KEPT]
    assert got[0] == np.mean(np.isin(union, a) & np.isin(union, b)) and got[1] == 0.9 and got[2] == 0


def test_no_rows(spark):
    assert minhash.near_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_common_passages_with_more_or_less_of_their_own(spark):
    """Chains of documents that share a passage: links that only other than the smallest document of a list have."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passages = [word(40) for _ in range(6)]
    texts = [" ".join(word(int(rng.integers(0, 16))) + passages[0] + word(int(rng.integers(0, 10)))) for _ in range(90)]
    for _ in range(160):  # several passages in one order, of which some are left out
        out = [p for p in passages if rng.random() < 0.8]
        texts.append(" ".join(sum(out, []) + word(int(rng.integers(0, 30)))))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    got = minhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_only_possible_partners_are_multiplied_out(spark):
    """In one list with many leaders a row meets those that its size, what both have left and the components allow."""
    sets = [(7, i, n, rest, c) for i, (n, rest, c) in enumerate([(100, 100, 0), (90, 90, 1), (95, 40, 2), (60, 60, 3), (100, 100, 0), (20, 20, 4), (22, 22, 5)])]
    led = spark.createDataFrame(sets, "value long, class_id long, n int, rest int, component long")
    leads = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).cast("long").alias("class_id"), F.lit(rest).alias("rest"), F.lit(c).cast("long").alias("component")) for _, i, n, rest, c in sets])
    met = minhash.met_leaders(led.withColumn("led", leads))
    assert sorted((r.a, r.b) for r in met.collect()) == sorted((a, b) for a, b in [(0, 1), (1, 4), (5, 6)] for a, b in [(a, b), (b, a)])
    assert "explode(filter(" in met._jdf.queryExecution().optimizedPlan().toString()

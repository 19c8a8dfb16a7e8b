import re

import numpy as np

from wayside.llm import language
from wayside.llm.words import mix


def plain_grams(text):
    """The n-grams of one text as symbol tuples."""
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    symbols = [ord(c) for c in " " + " ".join(low.split()) + " "] if low.strip() else []
    return [tuple(symbols[i : i + n]) for n in language.SIZES for i in range(len(symbols) - n + 1)]


def code_of(gram):
    code = np.array([len(gram)], dtype=np.uint64)
    for s in gram:
        code = code * np.uint64(1_099_511_628_211) + np.uint64(s)
    return int(mix(code)[0])


TEXTS = ["", "  ..", "A", "12 a1b  --c\n", "  Été  à  la plage! ", "İstanbul ΣΑΣ", "it's", "x  y", "###"]


def test_grams_equal_plain_grams():
    lows = [t.lower() for t in TEXTS]
    codes, of = language.grams(lows)
    for i, text in enumerate(lows):
        assert sorted(int(c) for c in codes[of == i]) == sorted(code_of(g) for g in plain_grams(text))


def test_filter_has_every_gram_and_few_others():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 20000, dtype=np.uint64) for _ in range(2))
    filters = language.LanguageFilter.of({"a": a, "b": b})
    for codes, name in ((a, 0), (b, 1)):
        found = None
        for at in filters.positions(codes):
            found = filters.masks[at] if found is None else found & filters.masks[at]
        assert filters.bit(found, name).all() and filters.bit(found, 1 - name).mean() < 0.01


def test_more_than_64_languages():
    filters = language.LanguageFilter.of({f"l{i}": np.array([i * 7919 + 1], dtype=np.uint64) for i in range(70)})
    assert filters.masks.shape[1] == 2


def documents(spark):
    en = ["the house on the hill was with them", "this thing and that thing are other things", "she would rather have the other one"]
    de = ["das haus auf dem berg war schön und groß", "ich möchte nicht über die straße gehen", "der schnee ist weiß und die nacht ist kalt"]
    rows = [(i, t, lang, "clash", 0.5) for i, (t, lang) in enumerate([(t, "en") for t in en * 6] + [(t, "de") for t in de * 5])]
    rows += [(100, None, "en", None, None), (101, "", "en", None, None), (102, "12 ### 🙂", None, None, None), (103, "das schöne haus auf der straße", None, None, None), (None, "the other hill", None, None, None), (2**60 + 1, "日本", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")


def test_identify(spark):
    docs = documents(spark)
    model = language.learn(docs)
    assert model.languages == ["en", "de"]
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert got[None]["lang_pred"] == "en" and got[103]["lang_pred"] == "de"
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[101]["score"] == 0
    assert got[2**60 + 1]["lang_pred"] == "en" and 0 <= got[2**60 + 1]["score"] < 0.05
    for r in got.values():
        assert r["doc_id"] in (100, None) or r["lang"] is None or not r["text"] or r["lang_pred"] == r["lang"]


def test_empty_and_unlabelled_tables(spark):
    docs = documents(spark)
    model = language.learn(docs.where("doc_id > 101"))
    assert model.languages == [] and {r["lang_pred"] for r in language.identify(docs, model).collect()} == {"und"}
    assert language.identify(docs.limit(0), language.learn(docs)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = language.op6_language(spark, sf).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert re.fullmatch("[a-z]+", rows[0]["lang_pred"])

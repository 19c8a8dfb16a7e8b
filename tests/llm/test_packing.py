import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayside.llm import packing

SCHEMA = "doc_id long, text string, length string, piece string"


def ids_of(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def holds(rows, capacity):
    """Every sequence is filled without gaps and not beyond its capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by


def test_pieces_equal_whole_encoding(spark):
    texts = [
        "It's a Test, don't  stop:\n\tNaïve Ærø ΣΑΣ é ́x 12.5% ###", None, "", "   ", "<|endoftext|> a<|startoftext|>b", " x y \x1c z\x0b\x0cw\u0085v",
        "Été, ÉCOLE. straße%%% ÿ?! (a.) \"b\". x². 3.14. don't. we'll, 's, o'. ab'. \u212a. \u017ft. İx, ẞ! é\u0301. A\u030a; ×y. ÷",
        "日本語のテキスト 한국어 🙂🙂", "word " * 9001, "x" * 20000,
    ]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(0, texts[0], None, None)], SCHEMA)
    rows = packing.pack(packing.tokenize(docs)).collect()
    holds(rows, 4096)
    seen = defaultdict(list)
    for r in rows:
        seen[r["doc_id"], r["piece"]].append(r)
    for i, text in enumerate(texts):
        ids = ids_of(text)
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            for r in seen[i, piece]:
                assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
            assert len(seen.pop((i, piece))) == (2 if i == 0 else 1)
    assert not seen


def test_empty_table(spark):
    assert packing.pack(packing.tokenize(spark.createDataFrame([], SCHEMA))).count() == 0


def one_by_one(lengths, capacity):
    """Best fit decreasing, a piece at a time."""
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= length]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= length
        else:
            free.append(capacity - length)
    return len(free)


@pytest.mark.parametrize("seed", range(4))
def test_as_few_sequences_as_one_by_one(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(3, 1, 600).astype(int) + 1, 100)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    places = packing.plan_places(counts, 100)
    used = {first + i for _, a, b, first, _ in places for i in range(b - a)}
    assert sum(b - a for _, a, b, _, _ in places) == 600
    assert len(used) == one_by_one(lengths, 100)


@pytest.mark.parametrize("select", ["norm", "dot"])
def test_every_capacity_holds(spark, select):
    rng = np.random.default_rng(7)
    lengths = rng.integers(1, 101, 500)
    pieces = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    rows = packing.pack(pieces, 100, max_docs=3, max_attention=5000 * 2, select=select).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(500))
    for parts in holds(rows, 100).values():
        assert len(parts) <= 3 and sum(n * n for _, n in parts) <= 10000


@pytest.mark.parametrize("select", ["norm", "dot"])
def test_attention_capacity_binds(spark, select):
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 61, 500)
    pieces = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")

    def cost(rows):
        return [sum(n * n for _, n in parts) for parts in holds(rows, 100).values()]

    rows = packing.pack(pieces, 100, max_attention=4000, select=select).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(500)) and max(cost(rows)) <= 4000
    assert max(cost(packing.pack(pieces, 100, select=select).collect())) > 4000

import hashlib
import random

import pytest

from wayside.llm import chat
from wayside.llm.chat import Template, format_conversations, read_loss, read_turns

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int, segments string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def read(rows):
    made = format_conversations(rows)
    return made.select("conv_id", "formatted", "segments", read_turns(made["formatted"]).alias("turns"), read_loss(made["segments"]).alias("loss")).collect()


def expected(rows):
    """Turns of each conversation, in order; rows without id by themselves."""
    by = {}
    for k, (conv, turn, role, text) in enumerate(rows):
        by.setdefault((conv, k if conv is None else None), []).append((turn is not None, turn or 0, role or "", text or ""))
    return sorted((str(conv), [(role, text) for *_, role, text in sorted(turns)]) for (conv, _), turns in by.items())


def by_hand(turns):
    """The template written out in plain Python, with an escape put behind each lead of a mark."""
    marks, out, last = chat.LLAMA_LIKE.marks, "", None
    pairs = {r: (a, b) for r, a, b in chat.LLAMA_LIKE.roles}

    def escaped(text):
        made = []
        for i, c in enumerate(text):
            made.append(c)
            if c in "<[" and any(text[i + 1 : i + 50].lstrip("\\").startswith(m[1:]) for m in marks):
                made.append("\\")
        return "".join(made)

    for role, text in turns:
        if role == last:
            out += "[PART]"
        else:
            out += "" if last is None else pairs.get(last, ("", "[/ROLE]"))[1]
            out += pairs[role][0] if role in pairs else f"[ROLE]{escaped(role)}[NAME]"
        out, last = out + escaped(text), role
    return out + pairs.get(last, ("", "[/ROLE]"))[1]


def test_round_trip_of_marks_nulls_ties_and_repeats(spark):
    rng = random.Random(1)
    atoms = ["<s>", "</s>", "[INST]", "[/INST]", "[PART]", "[NAME]", "[ROLE]", "<\\s>", "[\\\\/INST]", "[", "<", "\\", "s>", "PART]", "\n", "ö", "🙂", "$1", " ok "]
    text = lambda: rng.choice([None, "", "".join(rng.choices(atoms, k=rng.randint(1, 9)))])
    roles = ["user", "assistant", "system", "tool", "a[NAME]b</s>", "", None]
    rows = [(rng.randint(0, 40), rng.choice([None, 0, 1, 2, 3]), rng.choice(roles), text()) for _ in range(400)]
    rows += [(None, 1, "user", "x"), (None, 1, "user", "x"), (None, None, None, None), (50, 1, "user", "y"), (50, 1, "user", "y"), (51, 0, "assistant", "long [INST] " * 200_000)]
    got = read(spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA))
    want = expected(rows)
    assert sorted((str(r["conv_id"]), [tuple(t) for t in r["turns"]]) for r in got) == want
    assert sorted((str(r["conv_id"]), r["formatted"]) for r in got) == sorted((c, by_hand(t)) for c, t in want)
    for r in got:
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")


def test_many_turns_merge_and_empty_table(spark):
    rows = [(1, i, "user" if i // 3 % 2 else "assistant", f"t{i}") for i in range(20_000)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    (got,) = read(df)
    assert [tuple(t) for t in got["turns"]] == [r[2:] for r in rows]
    assert got["formatted"].startswith("<s>t0[PART]t1[PART]t2</s>[INST]t3")
    assert read(df.limit(0)) == []


def test_marks_must_be_told_apart():
    with pytest.raises(ValueError, match="lead"):
        Template(part="[a[b]")
    with pytest.raises(ValueError, match="differ"):
        Template(part="[NAME]")


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + list(chat.MARKS_INSIDE)
    want = {}
    for conv, turns in expected(rows):
        loss = "".join(text for role, text in turns if role == "assistant")
        want[int(conv)] = (len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)), len(loss), sha(loss), len(by_hand(turns)))
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.op11_chat(spark, sf).collect()}
    assert got == want and got[-1][0] == 2

"""Conversations as training text, by relational formatting.

The turns of a conversation are collected as structs and sorted, adjacent turns
of one role are merged with array functions, and the text is put together from
segments, all in Spark expressions.  A segment is a piece of text and whether
the loss counts it; the formatted text is all segments in a row.

Marks of the template begin with a lead character and hold none after it, so a
mark can only begin where a lead stands and two marks never overlap, not even
across the seam of a text and a mark.  A text that holds a mark, or a mark with
escapes behind its lead, gets one more escape there, and reading takes one away.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks around the turns of each role; a role that is not listed is written out between ``other`` and ``name``."""

    roles: tuple[tuple[str, str, str], ...] = (("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    name: str = "[NAME]"
    part: str = "[PART]"
    #: Roles whose texts the loss counts.
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        leads, marks = {m[:1] for m in self.marks}, self.marks
        if len(set(marks)) < len(marks) or any(len(m) < 2 or ESCAPE in m or leads & set(m[1:]) for m in marks):
            raise ValueError("marks must differ, have two characters or more, no escape, and a lead character at their beginning only")

    @property
    def marks(self) -> list[str]:
        return [m for _, *pair in self.roles for m in pair] + [*self.other, self.name, self.part]

    @property
    def closers(self) -> list[str]:
        return [close for _, _, close in self.roles] + [self.other[1]]

    def marked(self, least: int) -> str:
        """Pattern of a mark with ``least`` escapes or more behind its lead, in three groups."""
        leads, rests = sorted({m[0] for m in self.marks}), sorted({m[1:] for m in self.marks})
        return f"([{''.join(map(re.escape, leads))}]){re.escape(ESCAPE) * least}({re.escape(ESCAPE)}*)({'|'.join(map(re.escape, rests))})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.marked(0), "$1" + ESCAPE * 2 + "$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.marked(1), "$1$2$3")


LLAMA_LIKE = Template()


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_conversations(rows: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """``conv_id, segments array<struct<text, loss>>, formatted`` for every conversation in ``rows (conv_id, turn, role, text)``.

    Turns are in the order of ``turn`` (null first), then role, then text, so
    ties and repeated rows have one result; repeated rows are turns of their own.
    Null texts and roles are empty.  A row without ``conv_id`` is a conversation
    by itself, with a null id.  Other columns are passed over, an empty table
    gives no rows.  A conversation is one value, so it has to fit in one.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.select("conv_id", turn.alias("one"))
    grouped = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    sorted_turns = grouped.unionByName(turns.where("conv_id IS NULL").select("conv_id", F.array("one").alias("turns")))

    # where a run of turns of one role begins
    before = lambda i: F.get("turns", i - 1)["role"]
    begins = F.filter(F.transform("turns", lambda t, i: F.when((i == 0) | (before(i) != t["role"]), i)), lambda i: i.isNotNull())
    runs = sorted_turns.select("conv_id", "turns", begins.alias("begins"))
    length = lambda at, k: F.coalesce(F.get("begins", k + 1), F.size("turns")) - at
    blocks = runs.select(
        "conv_id",
        F.transform("begins", lambda at, k: F.struct(F.get("turns", at)["role"].alias("role"), F.transform(F.slice("turns", at + 1, length(at, k)), lambda t: t["text"]).alias("texts"))).alias("blocks"),
    )

    def opening(role: Column) -> Column:
        out = F.concat(F.lit(template.other[0]), template.escape(role), F.lit(template.name))
        for known, mark, _ in template.roles:
            out = F.when(role == known, mark).otherwise(out)
        return out

    def closing(role: Column) -> Column:
        out = F.lit(template.other[1])
        for known, _, mark in template.roles:
            out = F.when(role == known, mark).otherwise(out)
        return out

    def written(block: Column) -> Column:
        texts = F.transform(
            block["texts"],
            lambda text, i: F.array(
                _segment(F.when(i == 0, opening(block["role"])).otherwise(template.part), F.lit(False)),
                _segment(template.escape(text), block["role"].isin(*template.trained)),
            ),
        )
        return F.concat(F.flatten(texts), F.array(_segment(closing(block["role"]), F.lit(False))))

    segments = blocks.select("conv_id", F.flatten(F.transform("blocks", written)).alias("segments"))
    return segments.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: Column, template: Template = LLAMA_LIKE) -> Column:
    """The turns, ``array<struct<role, text>>``, of a formatted text."""
    pieces = F.split(formatted, "|".join(map(re.escape, template.closers)), -1)

    def turns(piece: Column) -> Column:
        role = template.unescape(F.substring_index(F.substr(piece, F.lit(len(template.other[0]) + 1)), template.name, 1))
        body = F.substr(piece, F.instr(piece, template.name) + len(template.name))
        for known, mark, _ in template.roles:
            is_known = F.startswith(piece, F.lit(mark))
            role = F.when(is_known, known).otherwise(role)
            body = F.when(is_known, F.substr(piece, F.lit(len(mark) + 1))).otherwise(body)
        return F.transform(F.split(body, re.escape(template.part), -1), lambda text: F.struct(role.alias("role"), template.unescape(text).alias("text")))

    # what follows the last mark is empty
    return F.flatten(F.transform(F.filter(pieces, lambda p: p != ""), turns))


def read_loss(segments: Column, template: Template = LLAMA_LIKE) -> Column:
    """All text that the loss counts, without escapes."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


#: A conversation whose texts hold marks of the template.
MARKS_INSIDE = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and digests of all formatted conversations, read back from the output."""
    columns = ["conv_id", "turn", "role", "text"]
    own = spark.createDataFrame(list(MARKS_INSIDE), "conv_id long, turn long, role string, text string")
    made = format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*columns).unionByName(own))
    read = made.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def oracle_sql() -> str:
    """Turns by rows in DuckDB; the formatted length is the sum of marks, texts and escapes."""
    t = LLAMA_LIKE
    opened = " ".join(f"WHEN '{role}' THEN {len(mark)}" for role, mark, _ in t.roles)
    closed = " ".join(f"WHEN '{role}' THEN {len(mark)}" for role, _, mark in t.roles)
    escaped = lambda c: f"length(regexp_replace({c}, '{t.marked(0)}', '\\1\\\\\\2\\3', 'g'))"
    own = ", ".join(f"({c}, {n}, '{role}', '{text}')" for c, n, role, text in MARKS_INSIDE)
    return f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone
        FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {own})),
    beside AS (
        SELECT *, lag(role) OVER w IS DISTINCT FROM role AS first, lead(role) OVER w IS DISTINCT FROM role AS last
        FROM turns WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)),
    sized AS (
        SELECT *, {escaped("text")} + CASE WHEN first THEN CASE role {opened} ELSE {len(t.other[0]) + len(t.name)} + {escaped("role")} END ELSE {len(t.part)} END
            + CASE WHEN last THEN CASE role {closed} ELSE {len(t.other[1])} END ELSE 0 END AS n
        FROM beside),
    read AS (
        SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
            coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n) AS n
        FROM sized GROUP BY conv_id, alone)
    SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM read"""

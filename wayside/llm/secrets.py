"""Secret scans behind an inverted index of trigrams.

Each rule is a regular expression.  From its syntax tree comes a Boolean query:
an OR of clauses, each a set of trigrams that every match must contain.  The
index maps a trigram to the documents that hold it (only trigrams that some rule
asks for are kept); the postings of a clause are intersected, and only the
documents that remain are verified with the expression.  A rule without
mandatory trigrams scans every text.  Trigrams are taken from lower-cased text,
so one index serves rules of either case.

Everything on the data is a DataFrame expression; Python only reads the rules.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches leftmost without overlap; a match counts if ``group`` has ``at_least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0


#: The quantifiers {16,} and {24,} find the runs that + finds and that have 20 and 24 characters: a shorter run fails as a whole.
BASE_RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: A private key: the BEGIN line, then all up to the END line if no other such line comes first; if there is none, as in a text that was cut off, the
#: header fields and the base64 lines.  Line ends may be blanks or escaped.  Loops over single characters need no stack in Java; the hyphens of a body are few.
_BODY = r"A-Za-z0-9+/="
_GAPS = r"\x20\t\r\n\\\"'>"
_ENDED = r"[^-]*(?:-{1,4}[^-]+){0,100}-----END [A-Z ]*PRIVATE KEY-----"
_CUT_OFF = rf"(?:[{_GAPS}]*n?(?:Proc-Type|DEK-Info):\x20*[A-Za-z0-9,-]+){{0,4}}[{_GAPS}]*(?:[{_BODY}]{{16,}}[{_BODY}{_GAPS}]*|[{_BODY}]{{1,15}}[{_GAPS}]*$)"
#: Formats that their issuers fix.
MORE_RULES = [
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_ENDED}|{_CUT_OFF})?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
]
RULES = [*BASE_RULES, *MORE_RULES]

#: Most strings that are carried along while a rule is read; beyond, the query asks for less.
MOST_STRINGS = 64

_ANY: frozenset = frozenset([frozenset()])  # the query that every text fulfils: one clause without trigrams


def _reduced(clauses) -> frozenset:
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _both(a: frozenset, b: frozenset) -> frozenset:
    return _reduced({x | y for x in a for y in b})


def _of_strings(strings: set[str]) -> frozenset:
    return _reduced({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _query(tree) -> tuple[set[str] | None, frozenset]:
    """(all strings that ``tree`` matches, if few; the clauses of trigrams) of a parsed expression."""
    found, run = _ANY, {""}
    exact = True
    for op, arg in tree:
        strings, clauses = None, _ANY
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            strings = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            strings, clauses = _query(arg[-1])
        elif op is sre.BRANCH:
            options = [_query(x) for x in arg[1]]
            if all(s is not None for s, _ in options):
                strings = set().union(*(s for s, _ in options))
            clauses = _reduced(set().union(*(c for _, c in options)))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = arg
            inner, inner_clauses = _query(body)
            if inner is not None and (least, most) == (0, 1):
                strings = inner | {""}
            elif inner is not None and least == most == 1:
                strings = inner
            elif least:
                clauses = inner_clauses
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        found = _both(found, _of_strings(run))
        if strings is not None:
            run = strings
        else:
            found, run, exact = _both(found, clauses), {""}, False
    whole = run if exact and found == _ANY else None
    return whole, _both(found, _of_strings(run))


def trigram_query(pattern: str) -> list[list[str]]:
    """The clauses of a rule, each a sorted list of trigrams; empty if the rule has no mandatory trigram."""
    clauses = _query(sre_parser.parse(pattern))[1]
    return [] if frozenset() in clauses else sorted(sorted(c) for c in clauses)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings ``trigram, doc_id`` of the given trigrams over whole texts."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id, rules``: the rules of which at least one clause lies in the document."""
    spark = index.sparkSession
    asked = [
        (t, f"{rule.kind}/{n}", rule.kind, 1 << i, (1 << len(clause)) - 1)
        for rule in rules
        for n, clause in enumerate(trigram_query(rule.pattern))
        for i, t in enumerate(clause)
    ]
    # one row per trigram of a rule: its size is that of the rule list, not of the data
    clauses = spark.createDataFrame(asked, "trigram string, clause string, rule string, bit long, full long")
    met = index.join(F.broadcast(clauses), "trigram").groupBy("doc_id", "rule", "clause", "full").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = full").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, order: int, rule: Rule) -> Column:
    """Array of (start, order, end) of the rule's matches that count; text between matches gives the places."""
    between = F.split(text, rule.pattern, -1)
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.transform(F.slice(between, 1, F.size(between) - 1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x)).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)).alias("judged"),
    )
    none = F.array().cast("array<struct<start:int,ord:int,end:int>>")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + x["size"]
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["judged"] >= rule.at_least, F.concat(done["out"], span)).otherwise(done["out"]).alias("out"))

    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda done: done["out"])
    return F.when(F.rlike(text, pattern), found).otherwise(none)


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, ord, end), sorted; ``ord`` is the rule's place in ``rules``.

    Places count code points, ends are exclusive.  Null texts count as empty and
    have no spans; rows that repeat, or whose id is null, are each verified.
    Columns named ``secret_spans`` or ``_rules`` are replaced.
    """
    rules = RULES if rules is None else rules
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for clauses in queries.values() for clause in clauses for t in clause})
    whole = docs.drop("_rules", "secret_spans", "_id")
    found = candidates(trigram_index(docs, trigrams), rules).select(F.col("doc_id").alias("_id"), F.col("rules").alias("_rules"))
    joined = whole.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:int,ord:int,end:int>>")
    each = [
        F.when(F.array_contains("_rules", r.kind), _spans(text, i, r)).otherwise(none) if queries[r.kind] else _spans(text, i, r) for i, r in enumerate(rules)
    ]
    return joined.withColumn("secret_spans", F.array_sort(F.concat(*each))).drop("_rules", "_id")


def spans_text(spans: Column, rules: list[Rule]) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["ord"] + 1), x["start"], x["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced; overlapping spans give one mark."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, x: Column) -> Column:
        kept = F.concat(done["out"], text.substr(done["at"] + 1, x["start"] - done["at"]), F.lit(mark))
        out = F.when(x["start"] >= done["at"], kept).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), out.alias("out"))

    masked = F.aggregate(spans, begin, step, lambda done: F.concat(done["out"], text.substr(done["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, masked).otherwise(text)


def _count(order: int) -> Column:
    return F.size(F.filter("secret_spans", lambda x: x["ord"] == order)).cast("long")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    base = F.filter("secret_spans", lambda x: x["ord"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        *[_count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)],
        F.sha2(spans_text(base, RULES), 256).alias("base_sha256"),
        spans_text(F.col("secret_spans"), RULES).alias("spans"),
    )


def oracle_sql() -> str:
    """The same rows in DuckDB: places from the text between matches."""
    parts = [
        f"""SELECT doc_id, row_id, '{r.kind}' AS kind, {i} AS ord, {r.at_least} AS at_least, regexp_extract_all(t, p, 0) AS ms, regexp_extract_all(t, p, {r.group}) AS gs,
        string_split_regex(t, p) AS ps FROM (SELECT *, '{r.pattern.replace("'", "''")}' AS p FROM texts)"""
        for i, r in enumerate(RULES)
    ]
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row_id FROM documents),
    found AS ({" UNION ALL ".join(parts)}),
    each_match AS (SELECT doc_id, row_id, kind, ord, at_least, unnest(ms) AS m, unnest(gs) AS g, unnest(ps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM found WHERE len(ms) > 0),
    placed AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY row_id, kind ORDER BY i) AS BIGINT) AS stop FROM each_match),
    kept AS (SELECT row_id, kind, ord, stop - length(m) AS start, stop FROM placed WHERE length(g) >= at_least),
    summed AS (SELECT row_id, {counts},
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (WHERE ord < {len(BASE_RULES)}) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM kept GROUP BY row_id)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM texts LEFT JOIN summed USING (row_id)"""

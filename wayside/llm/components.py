"""Connected components of a table of links, and classes of equal rows."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.llm.storage import stored

#: Parts that the rows of one key are dealt to, so that no key meets in one task.
SALTS = 16


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def replace_ids(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``column`` mapped through ``mapping (id, component)``; what is not in it stays.  A common value is dealt to several tasks."""
    salted = df.withColumn("_salt", _salt(*df.columns))
    right = mapping.select(F.col("id").alias("_id"), F.col("component").alias("_to"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_right"))
    joined = salted.join(right, (F.col(column) == F.col("_id")) & (F.col("_salt") == F.col("_right")), "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_salt", "_right", "_id", "_to")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``links (a, b)``: the smallest id that it reaches.

    Each round every id takes, of itself and its neighbours, the one with the
    smallest hash of this round as its parent; parents are followed a few times,
    and the links between what remains go to the next round.  As the order is
    random, chains are short and a constant part of the ids goes in each round.
    Links with a null end and of an id to itself are passed over.
    """
    links = stored(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mapping = None
    for turn in itertools.count():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.min(F.struct(F.xxhash64(F.lit(turn), "b").alias("h"), F.col("b").alias("id")))
        own = F.struct(F.xxhash64(F.lit(turn), "a").alias("h"), F.col("a").alias("id"))
        parent = both.groupBy("a").agg(best.alias("best")).select(F.col("a").alias("id"), F.least("best", own)["id"].alias("component"))
        if mapping is None and links.isEmpty():
            return parent
        parent = stored(parent)
        hopped = stored(replace_ids(parent, "component", parent))
        hopped = stored(replace_ids(hopped, "component", hopped))
        mapping = hopped if mapping is None else stored(replace_ids(mapping, "component", hopped))
        rest = replace_ids(replace_ids(links, "a", hopped), "b", hopped).where("a <> b")
        links = stored(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if links.isEmpty():
            break
    least = mapping.groupBy("component").agg(F.min("id").alias("least")).select(F.col("component").alias("id"), F.col("least").alias("component"))
    return stored(replace_ids(mapping, "component", least))


#: Members of a class that share a join key.
PER_SALT = 1000


def _class_salt(id_column: str) -> Column:
    return F.pmod(F.xxhash64(id_column), F.ceil(F.col("members") / PER_SALT)).cast("int")


def classes(rows: DataFrame, key: list[str], id_column: str) -> tuple[DataFrame, DataFrame]:
    """Classes of rows with equal, non-null ``key``.

    Returns ``rows`` with ``rep``, the smallest id of the row's class, and
    ``members``, its size; and one row (key, rep, members) per class.  Both carry
    ``class_id``, a number of the class.  A class may hold a large part of all
    rows: it is summed up in parts first and each part is joined by itself.
    """
    salted = rows.withColumn("_salt", _salt(id_column))
    parts = salted.groupBy(*key, "_salt").agg(F.min(id_column).alias("rep"), F.count("*").alias("members"))
    whole = parts.groupBy(*key).agg(F.min("rep").alias("rep"), F.sum("members").alias("members"), F.collect_list("_salt").alias("_salts"))
    whole = stored(whole.withColumn("class_id", F.monotonically_increasing_id()))
    back = whole.select(*key, "rep", "members", "class_id", F.explode("_salts").alias("_salt"))
    return salted.join(back, [*key, "_salt"]).drop("_salt"), whole.drop("_salts")


def join_class_results(members: DataFrame, results: DataFrame, id_column: str, key: str = "rep") -> DataFrame:
    """``members`` (of ``classes``) with the columns of ``results`` (one row per ``key``, with ``members``); large classes are dealt out."""
    dealt = results.withColumn("_salt", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("members") / PER_SALT) - 1).cast("int"))))
    return members.withColumn("_salt", _class_salt(id_column)).join(dealt.drop("members"), [key, "_salt"]).drop("_salt")

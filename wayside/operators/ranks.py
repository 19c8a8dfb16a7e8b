"""How many of a school's events rank before a given item, without spelling the events out.

What an event adds to the score of a link does not depend on the link.  So the
events of a school and placement are kept as steps: the distinct bonuses with the
number of events that have them, sorted by their sum and cut into pages, beside a
directory of the pages.  A point asks how many events, put on its link, would
rank before a given item.  Pages that lie above for sure are counted as a whole
from the directory, the page around the asked score is compared step by step with
the very additions that scores are made of, and only events with exactly the
item's score are told apart by their ids.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayside.session import settle

#: Steps of a page.
PAGE = 256
#: Ids of a step that are kept beside it, smallest first; a pick of the school itself is among them.
FIRST_IDS = 4
#: Distance from which the order of additions cannot change a comparison, relative to the numbers.
CLEAR = 1e-9

SCHOOL = ["school_id", "placement"]
BONUSES = ["open_day_bonus", "featured_event_bonus", "event_priority_boost"]
STEP = [*SCHOOL, *BONUSES]


class Steps(NamedTuple):
    """``directory``: a row per school and placement with its pages; ``pages``: a row per page with its steps; ``events``: the events of each step."""

    directory: DataFrame
    pages: DataFrame
    events: DataFrame


def bonus_steps(visible: DataFrame) -> Steps:
    """Steps of ``visible (school_id, placement, event_id, *BONUSES)``; a missing bonus adds nothing."""
    c = F.col
    events = visible.select(*SCHOOL, "event_id", *[F.coalesce(b, F.lit(0.0)).alias(b) for b in BONUSES])
    counted = events.groupBy(*STEP).agg(F.count(F.lit(1)).alias("n"))
    by_id = W.partitionBy(*STEP).orderBy("event_id")
    heads = events.withColumn("_rn", F.row_number().over(by_id)).where(c("_rn") <= FIRST_IDS)
    ids = heads.groupBy(*STEP).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    total = c(BONUSES[0]) + c(BONUSES[1]) + c(BONUSES[2])
    steps = counted.join(ids, STEP).withColumn("total", total)
    order = W.partitionBy(*SCHOOL).orderBy(c("total").desc(), *BONUSES)
    paged = steps.withColumn("page", F.floor((F.row_number().over(order) - 1) / PAGE).cast("int"))
    pages = settle(
        paged.groupBy(*SCHOOL, "page").agg(
            F.collect_list(F.struct(*BONUSES, "n", "ids")).alias("steps"), F.min("total").alias("low"), F.max("total").alias("high"), F.sum("n").alias("n")
        )
    )
    directory = pages.groupBy(*SCHOOL).agg(F.collect_list(F.struct("page", "low", "high", "n")).alias("pages"))
    return Steps(directory, pages.select(*SCHOOL, "page", "steps"), events)


def _score(base: Column, step: Column) -> Column:
    for bonus in BONUSES:
        base = base + step[bonus]
    return base


def _total(of: Column) -> Column:
    return F.aggregate(of, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])


def _counted(points: DataFrame, steps: Steps, keep: list[str]) -> DataFrame:
    """``keep`` for every point whose school shows events, in rows of one page: ``sure``, the events on pages above, with ``first`` in one row
    of the point, ``compared``, those found step by step, and ``unlisted``, the tied steps whose ids must be looked up."""
    c = F.col
    asked = [*keep, *SCHOOL, "base", "score", "content_kind", "content_id"]
    clear = F.greatest(F.lit(1.0), F.abs("score"), F.abs("base")) * CLEAR
    gap = c("score") - c("base")
    near = lambda p: (p["low"] <= gap + clear) & (p["high"] >= gap - clear)
    met = points.select(*list(dict.fromkeys(asked))).join(steps.directory, SCHOOL)
    sure = F.when(c("score").isNull(), _total(c("pages"))).otherwise(_total(F.filter("pages", lambda p: p["low"] > gap + clear)))
    around = F.when(c("score").isNotNull(), F.transform(F.filter("pages", near), lambda p: p["page"]))
    met = met.select("*", sure.alias("sure"), F.posexplode_outer(around).alias("_at", "page")).drop("pages").join(steps.pages, [*SCHOOL, "page"], "left")

    equal = lambda s: (_score(c("base"), s) == c("score")) & (c("content_kind") == "event")
    listed = lambda s: (s["n"] <= F.size(s["ids"])) | (c("content_id") <= F.element_at(s["ids"], -1))
    ahead = (
        lambda s: F.when((_score(c("base"), s) > c("score")) | ((_score(c("base"), s) == c("score")) & (c("content_kind") > "event")), s["n"])
        .when(equal(s) & listed(s), F.size(F.filter(s["ids"], lambda i: i < c("content_id"))).cast("long"))
        .otherwise(F.lit(0).cast("long"))
    )
    compared = F.coalesce(F.aggregate("steps", F.lit(0).cast("long"), lambda acc, s: acc + ahead(s)), F.lit(0).cast("long"))
    tied = F.filter("steps", lambda s: equal(s) & ~listed(s))
    unlisted = F.transform(tied, lambda s: F.struct(*[s[b].alias(b) for b in BONUSES]))
    keys = list(dict.fromkeys([*keep, *SCHOOL, "content_id"]))
    first = (F.coalesce("_at", F.lit(0)) == 0).alias("first")
    return settle(met.select(*keys, "sure", first, compared.alias("compared"), F.coalesce(unlisted, F.array()).alias("unlisted")), "zstd")


def _tied(counted: DataFrame, steps: Steps, keep: list[str]) -> DataFrame | None:
    """``keep`` and ``below``, events of a tied step that come first by their ids."""
    c = F.col
    keys = list(dict.fromkeys([*keep, *SCHOOL, "content_id"]))
    ties = counted.where(F.size("unlisted") > 0).select(*keys, F.explode("unlisted").alias("s")).select(*keys, *[c(f"s.{b}").alias(b) for b in BONUSES])
    if ties.isEmpty():
        return None
    # an item of another school with exactly the score of a long step: its place among the step's ids, counted in one merged order
    places = ties.select(*STEP, "content_id").distinct().withColumnRenamed("content_id", "id")
    ids = steps.events.join(places.select(*STEP).distinct(), STEP, "left_semi").select(*STEP, c("event_id").alias("id"), F.lit(1).alias("one"))
    merged = ids.unionByName(places.withColumn("one", F.lit(0)))
    order = W.partitionBy(*STEP).orderBy("id").rangeBetween(W.unboundedPreceding, W.currentRow)
    placed = merged.withColumn("below", F.sum("one").over(order)).groupBy(*STEP, "id").agg((F.max("below") - F.sum("one")).alias("below"))
    return ties.join(placed.withColumnRenamed("id", "content_id"), [*STEP, "content_id"]).select(*keep, "below")


def events_before(points: DataFrame, steps: Steps, point: list[str]) -> DataFrame:
    """``point`` and ``n`` for every point whose school shows events.

    ``points`` hold the columns of ``point``, ``school_id``, ``placement``,
    ``base`` (what the bonuses are added to) and the item ``score, content_kind,
    content_id``; with a null score all events count.
    """
    counted = _counted(points, steps, point)
    out = counted.groupBy(*point).agg((F.max("sure") + F.sum("compared")).alias("n"))
    tied = _tied(counted, steps, point)
    if tied is None:
        return out
    extra = tied.groupBy(*point).agg(F.sum("below").alias("below"))
    return out.join(extra, point, "left").select(*point, (F.col("n") + F.coalesce("below", F.lit(0))).alias("n"))


def sums_before(points: DataFrame, steps: Steps, by: list[str], sums: list[str]) -> DataFrame:
    """The numbers of ``events_before``, added up per ``by`` where they are counted.

    Every column of ``sums`` is a struct: a point adds its number times ``w``,
    less ``less``.  Points need no key of their own.
    """
    c = F.col
    counted = _counted(points, steps, [*by, *sums])
    n = F.when(c("first"), c("sure")).otherwise(F.lit(0)) + c("compared")
    rows = counted.select(*by, *[(c(s)["w"] * n - F.when(c("first"), c(s)["less"]).otherwise(F.lit(0))).alias(s) for s in sums])
    tied = _tied(counted, steps, [*by, *sums])
    if tied is not None:
        rows = rows.unionByName(tied.select(*by, *[(c(s)["w"] * c("below")).alias(s) for s in sums]))
    return rows.groupBy(*by).agg(*[F.sum(s).alias(s) for s in sums])

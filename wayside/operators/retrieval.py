"""Candidate links of a request, in a fixed order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayside.config import DEFAULT_CONFIG, RankingConfig
from wayside.functions.geo import add_direction, ellipsoid_m
from wayside.functions.text import non_blank, truthy
from wayside.operators import graph
from wayside.operators.context import school_area
from wayside.operators.links import nearest, within_spots
from wayside.operators.topn import first_per_key
from wayside.session import settle, spread

LINK = ["school_id", "station_id", "walking_minutes", "distance_meters", "hop_distance", "line_name"]
CONTRACT = ["distance_meters", "walking_minutes", "school_id", "station_id"]
TARGET = ["request_id", "target_station_id", "target_line_name", "target_latitude", "target_longitude", "max_hops"]
BOOSTS = {"direct": 3.0, "same_line": 1.0, "nearby": 0.5}  # fixed values

SIGNATURE = [
    "target_station_id", "target_name", "target_line_name", "target_line_id", "target_area_id",
    "target_latitude", "target_longitude", "explicit", "has_line", "has_area", "line_id", "ctx_line_name", "city_name",
    "prefecture_name", "conflict", "area_origin", "line_origin", "max_hops",
]


def retrieval_order(direct: Column) -> list[Column]:
    """Direct station first, then metres, minutes, school and station."""
    return [F.when(direct, 0).otherwise(1), *[F.col(n) for n in CONTRACT]]


def max_hops(cfg: RankingConfig, placement: str = "placement") -> Column:
    out = F.lit(None).cast("int")
    for p in cfg.placements:
        out = F.when(F.col(placement) == p.name, F.lit(p.neighbor_max_hops)).otherwise(out)
    return out


def enrich_links(links: DataFrame, stations: DataFrame, schools: DataFrame, areas: DataFrame) -> DataFrame:
    """Links with their station and with the school's area, once per link."""
    st = stations.select(
        F.col("id").alias("station_id"), F.col("line_id").alias("candidate_line_id"), F.col("area_id").alias("candidate_area_id"), "latitude", "longitude"
    )
    sc = school_area(schools, areas).select(
        F.col("id").alias("school_id"), F.col("area").alias("school_area"), "school_area_id", "school_prefecture_name"
    )
    return links.select(*LINK).join(st, "station_id").join(sc, "school_id")


def with_signature(ctx: DataFrame, areas: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Add the graph origins and ``sig``: requests with one sig share all their candidates."""
    rows = graph.line_origin(graph.area_origin(ctx, areas)).withColumns(
        {
            "explicit": F.col("ctx_station_id").isNotNull(),
            "line_id": non_blank("line_id"),
            "ctx_line_name": F.col("line_name"),
            "max_hops": max_hops(cfg),
        }
    )
    return rows.withColumn("sig", F.md5(F.to_json(F.struct(*SIGNATURE))))


def distinct_signatures(rows: DataFrame, line_adj: DataFrame, area_adj: DataFrame) -> DataFrame:
    sigs = rows.where(F.col("target_latitude").isNotNull()).select("sig", *SIGNATURE).dropDuplicates(["sig"])
    sigs = graph.expand_areas(graph.expand_lines(sigs, line_adj), area_adj)
    none = F.array().cast("array<string>")
    return sigs.withColumns({n: F.coalesce(n, none) for n in ("adjacent_lines", "adjacent_areas")})


def _top(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """First ``limit`` links per key by the contract order."""
    return first_per_key(df, keys, CONTRACT, limit)


def _numbered(links: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """Distinct links with ``_n``, numbers in contract order, and the number of kinds a link comes in at most.

    Rows that agree in the contract columns and differ in others have numbers
    that differ only in their remainder by that second result.
    """
    rows = settle(links.select(*CONTRACT, *columns).distinct().orderBy(*CONTRACT, *columns).withColumn("_o", F.monotonically_increasing_id()))
    kinds = rows.groupBy(*CONTRACT).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    if kinds == 1:
        return rows.withColumnRenamed("_o", "_n"), 1
    same = W.partitionBy(*CONTRACT)
    number = F.min("_o").over(same) * kinds + F.row_number().over(same.orderBy("_o")) - 1
    return settle(rows.withColumn("_n", number).drop("_o")), kinds


def _lists(links: DataFrame, keys: list[str], limit: int, kinds: int) -> DataFrame:
    """The sorted numbers of the first ``limit`` links per key, as ``links``, and how many they are, as ``n``."""
    top = first_per_key(links.select(*keys, "_n"), keys, [F.col("_n") - F.col("_n") % kinds], limit, number=F.dense_rank)
    rows = top.groupBy(*keys).agg(F.array_sort(F.collect_set("_n")).alias("links"))
    links_of = F.transform("links", lambda x: x - x % kinds)
    return rows.withColumn("n", F.size("links") if kinds == 1 else F.size(F.array_distinct(links_of)))


def _merged(rows: DataFrame, stages: list[str], limit: int, kinds: int) -> DataFrame:
    """Lay sorted lists of numbers one behind the other, each link in the first one that has it.

    Adds ``links``, cut to ``limit``, and ``ends``, the place behind each stage's last link.
    """
    c = F.col
    none = F.array().cast("array<bigint>")
    rows = rows.withColumns({"links": none, "_seen": none})
    for stage in stages:
        rows = rows.withColumn("_new", F.array_except(stage, "_seen"))
        rows = rows.withColumn("_seen", F.concat("_seen", "_new"))
        if kinds > 1:
            rows = rows.withColumn("_new", F.filter("_new", lambda x, i: (i == 0) | (x - x % kinds != F.get("_new", i - 1) - F.get("_new", i - 1) % kinds)))
        rows = rows.withColumn("links", F.concat("links", "_new") if kinds > 1 else c("_seen")).withColumn(f"_end_{stage}", F.size("links"))
    ends = F.array(*[c(f"_end_{stage}") for stage in stages])
    return rows.withColumns({"links": F.slice("links", 1, limit), "ends": ends}).drop("_new", "_seen", *[f"_end_{stage}" for stage in stages])


def _asks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values that lists are asked by, numbered as ``_ask``."""
    return settle(rows.select(*columns).distinct().withColumn("_ask", F.monotonically_increasing_id()))


def _answered(rows: DataFrame, asks: DataFrame, columns: list[str], lists: DataFrame, by: list[str]) -> DataFrame:
    """The lists of ``_ask`` for the rows that asked."""
    on = [rows[n].eqNullSafe(asks[n]) for n in columns]
    return rows.join(asks, on).select(*[rows[n] for n in by], "_ask").join(lists, "_ask").select(*by, "n", "links")


def _listed(rows: DataFrame, by: list[str], stages: list[int]) -> DataFrame:
    """From rows with ``_stage`` and a list of ``links``: one row per ``by`` and each stage's sorted list as ``_s<stage>``."""
    per = rows.groupBy(*by).agg(F.collect_list(F.struct("_stage", "links")).alias("_lists"))
    of = lambda i: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("_lists", lambda x: x["_stage"] == i), lambda x: x["links"]))))
    return per.select(*by, *[of(i).alias(f"_s{i}") for i in stages])


def _flags(rows: DataFrame, cap: float) -> DataFrame:
    """The membership flags of each (signature, link), nulls as SQL has them."""
    c = F.col
    same_line = (c("line_id").isNotNull() & (c("candidate_line_id") == c("line_id"))) | (
        c("ctx_line_name").isNotNull() & (c("line_id").isNull() | c("candidate_line_id").isNull()) & (c("line_name") == c("ctx_line_name"))
    )
    area, pref = F.lower("school_area"), F.lower(F.coalesce("school_prefecture_name", F.lit("")))
    city, asked = F.lower("city_name"), F.lower("prefecture_name")
    same_city = c("city_name").isNotNull() & (area == city) & (c("prefecture_name").isNull() | (pref == asked))
    in_prefecture = (area == asked) | (pref == asked)
    near = c("target_distance") <= cap
    adjacent_area = F.array_contains("adjacent_areas", c("candidate_area_id"))
    neighbor = (
        c("explicit")
        & (c("station_id") != c("target_station_id"))
        & ~same_line
        & (c("city_name").isNull() | (area != city))
        & (c("prefecture_name").isNull() | ~in_prefecture)
        & (near | adjacent_area)
    )
    adjacent_line = F.array_contains("adjacent_lines", c("candidate_line_id")) & (c("hop_distance") <= c("max_hops")) & near
    rows = rows.withColumn("target_distance", ellipsoid_m("_a", "_b")).withColumns(
        {
            "is_strict_station": c("explicit") & (c("station_id") == c("target_station_id")),
            "is_same_line": truthy(same_line),
            "is_adjacent_line": truthy(adjacent_line),
            "is_same_city": truthy(same_city),
            "is_same_prefecture": truthy(c("prefecture_name").isNotNull() & in_prefecture),
            "is_neighbor_area": truthy(neighbor),
        }
    )
    bucket = F.lit(6)
    names = ["is_strict_station", "is_same_line", "is_adjacent_line", "is_same_city", "is_same_prefecture", "is_neighbor_area"]
    for i, name in reversed(list(enumerate(names))):
        bucket = F.when(c(name), F.lit(i)).otherwise(bucket)
    return rows.withColumn("bucket", bucket)


class Candidates(NamedTuple):
    """``lists``: a row per signature with its ``links`` as numbers, in order, and the ``ends`` of its buckets; ``numbered``: the links with their
    number ``_n``; ``outside``: rows of links beyond every flag."""

    lists: DataFrame
    numbered: DataFrame
    outside: DataFrame


def candidate_lists(sigs: DataFrame, enriched: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> Candidates:
    """Ordered candidate links per signature, as lists.

    Each flag is a key (station, line, city, prefecture, area, target spot).
    Inside a key the order does not depend on the request, so every key has one
    sorted list of its best ``limit`` links, shared by all signatures that ask
    it.  A signature lays the lists of its flags one behind the other, in the
    order of the buckets; a flag is asked only if no list before it reaches
    ``limit``, as its links would all rank behind.  Lists that were not cut hold
    all links of their flag, hence the result is exact.  Links are numbers in
    the contract's order until they are picked.  Links outside every flag are
    only added for signatures with too few flagged ones, by a nearest search.
    """
    c = F.col
    cap, limit = cfg.neighbor_cap_meters, cfg.candidate_limit
    minimum = max(cfg.minimum_candidates, 1)
    # directions are worked out per place, so that a pair needs little trigonometry
    sigs = add_direction(sigs, "target_latitude", "target_longitude", "_a")
    keep = max(limit, minimum)
    slim = enriched.withColumns({"_area": F.lower("school_area"), "_pref": F.lower(F.coalesce("school_prefecture_name", F.lit("")))})
    attributes = ["line_name", "hop_distance", "candidate_line_id", "candidate_area_id", "latitude", "longitude", "_area", "_pref"]
    numbered, kinds = _numbered(slim, *attributes)

    def key(tag: str, *values: Column) -> Column:
        return F.concat(F.lit(f"{tag}:"), *[x for v in values for x in (v, F.lit("|"))])

    # every link under each key it can be asked by
    entries = F.array(
        key("station", c("station_id")),
        key("line", c("candidate_line_id")),
        key("name", c("line_name")),
        F.when(c("candidate_line_id").isNull(), key("bare", c("line_name"))),
        key("city", c("_area")),
        key("city+", c("_area"), c("_pref")),
        key("prefecture", c("_area")),
        F.when(~c("_pref").eqNullSafe(c("_area")), key("prefecture", c("_pref"))),
    )
    keyed = settle(_lists(numbered.select("_n", F.explode(F.array_compact(entries)).alias("_key")), ["_key"], keep, kinds))

    city, asked = F.lower("city_name"), F.lower("prefecture_name")

    def ask(stage: int, k: Column) -> Column:
        return F.when(k.isNotNull(), F.struct(F.lit(stage).alias("_stage"), k.alias("_key")))

    wants = F.array_compact(
        F.array(
            ask(0, F.when(c("explicit"), key("station", c("target_station_id")))),
            ask(1, key("line", c("line_id"))),
            ask(1, F.when(c("line_id").isNull(), key("name", c("ctx_line_name"))).otherwise(key("bare", c("ctx_line_name")))),
            ask(3, F.when(asked.isNull(), key("city", city)).otherwise(key("city+", city, asked))),
            ask(4, key("prefecture", asked)),
        )
    )
    asking = sigs.select("sig", F.explode(wants).alias("_w")).select("sig", "_w._stage", "_w._key")
    sized = asking.join(keyed.select("_key", "n"), "_key").groupBy("sig").agg(*[F.max(F.when(c("_stage") == i, c("n"))).alias(f"_n{i}") for i in (0, 1, 3, 4)])
    full = lambda *stages: F.greatest(F.lit(0), *[F.coalesce(f"_n{i}", F.lit(0)) for i in stages]) >= keep
    asked_so_far = sigs.join(sized, "sig", "left")

    # places around the target spots of those that are not full by station and line
    at = settle(
        asked_so_far.where((c("explicit") | (F.size("adjacent_lines") > 0)) & ~full(0, 1)).select(
            "sig", c("target_latitude").alias("from_latitude"), c("target_longitude").alias("from_longitude"), "explicit", "line_id", "ctx_line_name",
            city.alias("_city"), asked.alias("_asked"), "max_hops", "adjacent_lines", "adjacent_areas", "_n0", "_n1", "_n3", "_n4",
        )
    )
    spot = ["from_latitude", "from_longitude"]
    spots = at.select(c("from_latitude").alias("latitude"), c("from_longitude").alias("longitude")).distinct()
    spot_pairs = settle(within_spots(spots, numbered.select("latitude", "longitude").distinct(), cap).select(*spot, "to_latitude", "to_longitude"))
    alike = ["candidate_line_id", "line_name", "_area", "_pref"]
    link_group = [c("_n") - c("_n") % kinds]
    local = first_per_key(numbered.select("_n", "latitude", "longitude", "hop_distance", *alike), ["latitude", "longitude", "hop_distance", *alike], link_group, keep, number=F.dense_rank)
    local = settle(local.withColumnsRenamed({"latitude": "to_latitude", "longitude": "to_longitude"}))
    place = ["to_latitude", "to_longitude"]

    on_line = [*spot, "_line", "max_hops"]
    by_line = at.where(F.size("adjacent_lines") > 0).withColumn("_line", F.explode("adjacent_lines"))
    line_asks = _asks(by_line, on_line)
    reached = line_asks.join(spot_pairs, spot).join(
        local.select("_n", *place, c("candidate_line_id").alias("_line"), "hop_distance"), [*place, "_line"]
    )
    second = settle(_answered(by_line, line_asks, on_line, _lists(reached.where(c("hop_distance") <= c("max_hops")), ["_ask"], keep, kinds), ["sig"]))

    # neighbours: what is near or in an adjacent area and passes what the request excludes
    widest = second.groupBy("sig").agg(F.max("n").alias("_n2"))
    after = asked_so_far.join(widest, "sig", "left").select("sig", *[(~full(*range(i))).alias(f"_open{i}") for i in (3, 4, 5)])
    fifth = settle(at.where("explicit").join(widest, "sig", "left").where(~full(0, 1, 2, 3, 4)))
    excludes = ["line_id", "ctx_line_name", "_city", "_asked"]
    same_line = (c("line_id").isNotNull() & (c("candidate_line_id") == c("line_id"))) | (
        c("ctx_line_name").isNotNull() & (c("line_id").isNull() | c("candidate_line_id").isNull()) & (c("line_name") == c("ctx_line_name"))
    )
    in_prefecture = (c("_area") == c("_asked")) | (c("_pref") == c("_asked"))
    passes = ~same_line & (c("_city").isNull() | (c("_area") != c("_city"))) & (c("_asked").isNull() | ~in_prefecture)
    near_asks = _asks(fifth, [*spot, *excludes])
    near = near_asks.join(spot_pairs, spot).join(local, place).where(passes)
    in_area = fifth.withColumn("candidate_area_id", F.explode("adjacent_areas"))
    area_asks = _asks(in_area, ["candidate_area_id", *excludes])
    by_area = first_per_key(numbered.select("_n", "candidate_area_id", *alike), ["candidate_area_id", *alike], link_group, keep, number=F.dense_rank)
    adjacent = area_asks.join(by_area, "candidate_area_id").where(passes)
    neighbors = _answered(fifth, near_asks, [*spot, *excludes], _lists(near, ["_ask"], keep, kinds), ["sig"]).unionByName(
        _answered(in_area, area_asks, ["candidate_area_id", *excludes], _lists(adjacent, ["_ask"], keep, kinds), ["sig"])
    )

    open_to = F.when(c("_stage") == 3, c("_open3")).when(c("_stage") == 4, c("_open4")).otherwise(True)
    simple = asking.join(after, "sig").where(open_to).join(keyed, "_key").select("sig", "_stage", "links")
    lists = simple.unionByName(second.select("sig", F.lit(2).alias("_stage"), "links")).unionByName(neighbors.select("sig", F.lit(5).alias("_stage"), "links"))
    stages = list(range(6))
    merged = settle(_merged(_listed(lists, ["sig"], stages), [f"_s{i}" for i in stages], limit, kinds).select("sig", "links", "ends"))

    under = sigs.join(merged.select("sig", F.size("links").alias("_found")), "sig", "left").where(F.coalesce("_found", F.lit(0)) < minimum)
    points = under.select(c("target_latitude").alias("latitude"), c("target_longitude").alias("longitude")).distinct()
    close = nearest(points, enriched, limit + minimum, tuple(CONTRACT)).withColumnsRenamed({"to_latitude": "latitude", "to_longitude": "longitude"})
    at_spot = (c("target_latitude") == c("from_latitude")) & (c("target_longitude") == c("from_longitude"))
    outside = under.join(close.drop("distance_m", "rank"), at_spot).drop(*spot)
    outside = add_direction(outside, "latitude", "longitude", "_b")
    outside = _flags(outside, cap).where(c("bucket") == 6)
    far_order = W.partitionBy("sig").orderBy("target_distance", *CONTRACT)
    outside = outside.withColumn("position", F.row_number().over(far_order) + F.coalesce("_found", F.lit(0)))
    outside = outside.where(c("position") <= limit).select("sig", *LINK, "bucket", "position")
    return Candidates(merged, numbered, outside)


def candidate_rows(found: Candidates) -> DataFrame:
    """A row per signature and candidate link, with ``bucket`` and ``position``."""
    bucket = F.size(F.filter("ends", lambda e: e <= F.col("_at"))).alias("bucket")
    picked = found.lists.select("sig", F.posexplode("links").alias("_at", "_n"), "ends").select("sig", "_n", bucket, (F.col("_at") + 1).alias("position"))
    scoped = settle(picked.join(found.numbered.select("_n", *LINK), "_n").select("sig", *LINK, "bucket", "position"))
    return scoped.unionByName(found.outside)


def candidate_counts(found: Candidates) -> DataFrame:
    """``sig`` and ``candidate_count``, the number of its ``candidate_rows``: the lists' lengths tell it, no row is looked up."""
    inside = found.lists.select("sig", F.size("links").cast("long").alias("n")).where("n > 0")
    outside = found.outside.select("sig", F.lit(1).cast("long").alias("n"))
    return inside.unionByName(outside).groupBy("sig").agg(F.sum("n").alias("candidate_count"))


def retrieved_links(found: Candidates) -> DataFrame:
    """School and station of every candidate link, once each: numbers are made distinct in each task, before they are looked up."""
    numbers = found.lists.select(F.explode("links").alias("_n")).distinct()
    inside = numbers.join(found.numbered.select("_n", "school_id", "station_id"), "_n").drop("_n")
    return inside.unionByName(found.outside.select("school_id", "station_id")).distinct()


def context_candidates(sigs: DataFrame, enriched: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Ordered candidate links per signature, a row each."""
    return candidate_rows(candidate_lists(sigs, enriched, cfg))


def with_requests(sigs: DataFrame, rows: DataFrame, most: int = 1000) -> DataFrame:
    """``sigs`` with ``requests``, the ids of their requests; a signature of very many comes in rows of about ``most`` each."""
    asked = rows.select("sig", "request_id")
    sizes = asked.groupBy("sig").agg(F.count(F.lit(1)).alias("_n"))
    parts = asked.join(sizes, "sig").withColumn("_part", F.pmod(F.xxhash64("request_id"), F.ceil(F.col("_n") / most)))
    return parts.groupBy("sig", "_part").agg(F.collect_list(F.struct("request_id")).alias("requests")).drop("_part").join(sigs, "sig")


def signature_links(found: Candidates, sigs: DataFrame) -> DataFrame:
    """The columns of ``sigs`` with each candidate link.

    Signatures are dealt out with their lists, before these are multiplied out.
    """
    whole = spread(found.lists.select("sig", "links"), "sig").join(sigs, "sig")
    inside = whole.withColumn("_n", F.explode("links")).drop("links").join(found.numbered.select("_n", *LINK), "_n").drop("_n")
    return inside.unionByName(found.outside.select("sig", *LINK).join(sigs, "sig"))


def placed_links(found: Candidates, sigs: DataFrame, places: DataFrame, per_task: int = 4) -> DataFrame:
    """The rows of ``signature_links`` with the columns of ``places (school_id, station_id, ...)``.

    Signatures are dealt out in blocks, and every block is sent the links that
    its lists name, once each.  So the multiplied rows stay where they are, however
    many links there are, if the writing query may join rows that are dealt out
    by their block alone (``settle`` with ``ALL_KEYS`` off; else they are shuffled).
    """
    blocks = per_task * int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("sig"), F.lit(blocks)).cast("int")
    lists = found.lists.select(block.alias("_block"), "sig", "links")
    asked = lists.select("_block", F.explode("links").alias("_n")).distinct()
    sent = asked.join(found.numbered.select("_n", *LINK).join(places, ["school_id", "station_id"]), "_n")
    whole = spread(lists, "_block").join(sigs.withColumn("_block", block), ["_block", "sig"])
    inside = whole.withColumn("_n", F.explode("links")).drop("links").join(sent.hint("shuffle_hash"), ["_block", "_n"]).drop("_block", "_n")
    return inside.unionByName(found.outside.select("sig", *LINK).join(sigs, "sig").join(places, ["school_id", "station_id"]))


def named_links(found: Candidates, sigs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``signature_links`` that ``keys (sig, school_id, station_id)`` name; of the lists, only the named numbers are multiplied out."""
    link = ["school_id", "station_id"]
    wanted = keys.join(found.numbered.select("_n", *link), link).groupBy("sig").agg(F.collect_set("_n").alias("_wanted"))
    named = found.lists.select("sig", "links").join(wanted, "sig").select("sig", F.explode(F.array_intersect("links", "_wanted")).alias("_n"))
    inside = named.join(found.numbered.select("_n", *LINK), "_n").select("sig", *LINK)
    return inside.unionByName(found.outside.select("sig", *LINK).join(keys, ["sig", *link], "left_semi")).join(sigs, "sig")


def station_candidates(targets: DataFrame, enriched: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Links of the target station, or of its line nearby.

    ``targets``: the columns named in ``TARGET``.  Stations and (spot, line, hops) have one list each, which requests share.
    """
    c = F.col
    limit, cap = cfg.candidate_limit, cfg.neighbor_cap_meters
    me = ["request_id", "target_station_id"]
    targets = settle(targets.select(*TARGET).distinct().withColumnsRenamed({"target_latitude": "from_latitude", "target_longitude": "from_longitude"}))
    numbered, kinds = _numbered(enriched, "line_name", "hop_distance", "latitude", "longitude")
    own = settle(_lists(numbered, ["station_id"], limit, kinds))
    direct = targets.join(own, c("target_station_id") == c("station_id"))
    spot, place, on_line = ["from_latitude", "from_longitude"], ["to_latitude", "to_longitude"], ["from_latitude", "from_longitude", "target_line_name", "max_hops"]
    rest = settle(targets.join(own.where(c("n") >= limit).select(c("station_id").alias("target_station_id")), "target_station_id", "left_anti"))
    spots = rest.select(c("from_latitude").alias("latitude"), c("from_longitude").alias("longitude")).distinct()
    pairs = within_spots(spots, numbered.select("latitude", "longitude").distinct(), cap).select(*spot, *place)
    group = [c("_n") - c("_n") % kinds]
    local = first_per_key(numbered.select("_n", "latitude", "longitude", "line_name", "hop_distance"), ["latitude", "longitude", "line_name", "hop_distance"], group, limit, number=F.dense_rank)
    local = local.withColumnsRenamed({"latitude": "to_latitude", "longitude": "to_longitude", "line_name": "target_line_name"})
    asks = _asks(rest, on_line)
    near = asks.join(pairs, spot).join(local, [*place, "target_line_name"]).where(c("hop_distance") <= c("max_hops"))
    line = _answered(rest, asks, on_line, _lists(near, ["_ask"], limit, kinds), me)
    lists = direct.select(*me, F.lit(0).alias("_stage"), "links").unionByName(line.select(*me, F.lit(1).alias("_stage"), "links"))
    merged = _merged(_listed(lists, me, [0, 1]), ["_s0", "_s1"], limit, kinds)
    picked = merged.select(*me, F.posexplode("links").alias("_at", "_n"))
    return picked.join(numbered.select("_n", *LINK), "_n").select(*me, *LINK, (c("_at") + 1).alias("position"))


def build_projection(links: DataFrame, schools: DataFrame, stations: DataFrame, events: DataFrame, popularity: DataFrame) -> DataFrame:
    """The flat document per link that index-style retrieval reads."""
    open_days = events.where("is_active").groupBy("school_id").agg(F.count_if("is_open_day").alias("open_day_count"))
    sc = schools.select(F.col("id").alias("school_id"), F.col("name").alias("school_name"), F.col("area").alias("school_area"), "school_type")
    st = stations.select(
        F.col("id").alias("station_id"), F.col("name").alias("station_name"), F.col("line_name").alias("station_line_name"), "latitude", "longitude"
    )
    return (
        links.select("school_id", "station_id", "walking_minutes", "distance_meters", "hop_distance")
        .join(sc, "school_id")
        .join(st, "station_id")
        .join(open_days, "school_id", "left")
        .join(popularity.select("school_id", "popularity_score"), "school_id", "left")
        .select(
            F.concat_ws(":", "school_id", "station_id").alias("document_id"),
            "school_id", "school_name", "school_area", "school_type", "station_id", "station_name",
            F.col("station_line_name").alias("line_name"), "latitude", "longitude",
            "walking_minutes", "distance_meters", "hop_distance",
            F.coalesce("open_day_count", F.lit(0).cast("long")).alias("open_day_count"),
            F.coalesce("popularity_score", F.lit(0.0)).alias("popularity_score"),
        )
    )


def projection_candidates(targets: DataFrame, projection: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Index-style retrieval: the best boosts win, then the contract order.

    Stations, lines and (spot, line) have one list each, which requests share; what is
    nearby is asked only by requests whose station and line do not reach the limit.
    A request that comes ``m`` times gets each link ``m`` times.
    """
    c = F.col
    limit, cap = cfg.candidate_limit, cfg.neighbor_cap_meters
    me = ["request_id", "target_station_id"]
    targets = targets.select(*TARGET).withColumnsRenamed({"target_latitude": "from_latitude", "target_longitude": "from_longitude"})
    targets = settle(targets.groupBy(*targets.columns).agg(F.count(F.lit(1)).cast("int").alias("_times")))
    numbered = settle(projection.select(*LINK, "latitude", "longitude").orderBy(*CONTRACT).withColumn("_n", F.monotonically_increasing_id()))
    of_station = settle(_lists(numbered, ["station_id"], limit, 1))
    of_line = settle(_lists(numbered, ["line_name"], limit, 1))
    direct = targets.join(of_station, c("target_station_id") == c("station_id"))
    line = targets.join(of_line, c("target_line_name") == c("line_name"))
    full = direct.select("request_id", "n").unionByName(line.select("request_id", "n")).where(c("n") >= limit).select("request_id").distinct()
    rest = settle(targets.where(c("target_line_name").isNotNull()).join(full, "request_id", "left_anti"))
    spot, place, on_line = ["from_latitude", "from_longitude"], ["to_latitude", "to_longitude"], ["from_latitude", "from_longitude", "target_line_name"]
    spots = rest.select(c("from_latitude").alias("latitude"), c("from_longitude").alias("longitude")).distinct()
    pairs = within_spots(spots, numbered.select("latitude", "longitude").distinct(), cap, "sphere").select(*spot, *place)
    local = first_per_key(numbered.select("_n", "latitude", "longitude", "line_name"), ["latitude", "longitude", "line_name"], ["_n"], limit)
    local = local.withColumnsRenamed({"latitude": "to_latitude", "longitude": "to_longitude"})
    asks = _asks(rest, on_line)
    near = asks.join(pairs, spot).join(local, place).where(c("target_line_name") != c("line_name"))
    nearby = _answered(rest, asks, on_line, _lists(near, ["_ask"], limit, 1), [*me, "_times"])
    lists = None
    for stage, part in enumerate((direct, line, nearby)):
        rows = part.select(*me, "_times", F.lit(stage).alias("_stage"), "links")
        lists = rows if lists is None else lists.unionByName(rows)
    merged = _merged(_listed(lists, [*me, "_times"], [0, 1, 2]), ["_s0", "_s1", "_s2"], limit, 1)
    boost = F.element_at(F.array(*[F.lit(BOOSTS[n]) for n in ("direct", "same_line", "nearby")]), F.size(F.filter("ends", lambda e: e <= c("_at"))) + 1)
    entries = F.transform("links", lambda x, i: F.struct(F.when(i < F.get("ends", F.lit(0)), 0).otherwise(1).alias("far"), x.alias("n"), i.alias("at")))
    times = F.slice(F.flatten(F.transform(entries, lambda e: F.array_repeat(e, c("_times")))), 1, limit)
    hits = merged.withColumn("_hits", F.array_sort(times)).select(*me, "ends", F.posexplode("_hits").alias("_place", "_e"))
    hits = hits.select(*me, "ends", (c("_place") + 1).alias("position"), c("_e.n").alias("_n"), c("_e.at").alias("_at")).withColumn("boost", boost)
    return hits.join(numbered.select("_n", *LINK), "_n").select(*me, *LINK, "boost", "position")


def retrieve(rows: DataFrame, by_context: DataFrame, by_index: DataFrame | None, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Pick the backend per request.

    Index results serve requests with a station and no area, when they reach
    the minimum; everything else takes the context retrieval.
    """
    cols = ["request_id", *LINK, "position", "backend"]
    asking = rows.select("request_id", "sig")
    if by_index is None:
        return asking.join(by_context, "sig").withColumn("backend", F.lit("sql")).select(*cols)
    eligible = rows.where(F.col("explicit") & ~F.col("has_area")).select("request_id")
    enough = (
        by_index.groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= cfg.minimum_candidates)
        .join(eligible, "request_id", "left_semi")
        .select("request_id")
    )
    enough = settle(enough)
    indexed = by_index.join(enough, "request_id", "left_semi").withColumn("backend", F.lit("index"))
    rest = asking.join(enough, "request_id", "left_anti").join(by_context, "sig").withColumn("backend", F.lit("sql"))
    return indexed.select(*cols).unionByName(rest.select(*cols))


def projection_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents to write, and ids no longer wanted."""
    upserts = new.select("document_id", F.lit("upsert").alias("action"))
    stale = old.select("document_id").join(new.select("document_id"), "document_id", "left_anti")
    return upserts.unionByName(stale.select("document_id", F.lit("delete").alias("action")))


def candidate_slice(candidates: DataFrame, dims: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The part of each table that the retrieved links touch."""
    schools = dims["schools"].join(candidates.select(F.col("school_id").alias("id")).distinct(), "id", "left_semi")
    stations = dims["stations"].join(candidates.select(F.col("station_id").alias("id")).distinct(), "id", "left_semi")
    sid = schools.select(F.col("id").alias("school_id"))
    whole = candidates.join(sid, "school_id", "left_semi").join(stations.select(F.col("id").alias("station_id")), "station_id", "left_semi")
    return {
        "schools": schools,
        "stations": stations,
        "links": whole,
        "events": dims["events"].where("is_active").join(sid, "school_id", "left_semi"),
        "popularity": dims["popularity"].join(sid, "school_id", "left_semi"),
        "area_affinity": dims["area_affinity"].join(schools.select("area").distinct(), "area", "left_semi"),
        "user_affinity": dims["user_affinity"].join(sid, "school_id", "left_semi"),
    }


def retrieval_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per request: do two backends return the same links in the same order?"""
    key = ["request_id", "position"]
    left = a.select(*key, F.struct("school_id", "station_id").alias("l"))
    right = b.select(*key, F.struct("school_id", "station_id").alias("r"))
    both = left.join(right, key, "full")
    return both.groupBy("request_id").agg(
        F.count("l").alias("left_rows"), F.count("r").alias("right_rows"), F.bool_and(F.col("l").eqNullSafe(F.col("r"))).alias("same_order")
    )

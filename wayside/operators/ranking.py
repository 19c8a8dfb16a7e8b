"""Stage choice, scoring, diversity and the recommendation batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayside.config import AREA_CONFLICT, CORE_REASONS, DEFAULT_CONFIG, PLACEMENT_LABELS, RankingConfig
from wayside.functions.geo import sphere_m
from wayside.functions.text import non_blank, same_ascii, truthy
from wayside.operators import explain, ranks
from wayside.operators.explain import fill, lookup
from wayside.session import ALL_KEYS, settle, spread

# fixed values: plan reasons
STOP = {
    "sufficient_scoped": "sufficient_scoped_candidates",
    "underfilled_area": "underfilled_area_context",
    "sufficient_global": "sufficient_safe_global_candidates",
    "best_available": "best_available_non_empty_stage",
    "none": "no_candidates_available",
}
SKIPPED = "not_needed_after_selected_stage"
BELOW = "candidate_count_below_minimum"
BELOW_BY_STAGE = {
    "same_line": "line_graph_same_line_candidates_below_minimum",
    "neighbor_area": "area_graph_neighbor_candidates_below_minimum",
}
NO_STATION = "station_context_not_explicit"
NO_LINE = "line_context_not_explicit"
NO_SAME_LINE = "line_graph_no_same_line_candidates"
IGNORED_HINT = "area_hint_ignored_by_station_conflict"
NO_CITY = "city_context_missing"
NO_PREFECTURE = "prefecture_context_missing"
NO_NEIGHBOR = "area_graph_no_neighbor_candidates_within_distance_cap"

COMPONENTS = [
    "direct_station_bonus", "line_match_bonus", "school_station_distance", "walking_minutes",
    "neighbor_station_proximity", "popularity_snapshot_bonus", "area_affinity_bonus", "user_affinity_bonus",
    "fallback_penalty", "content_kind_boost", "open_day_bonus", "featured_event_bonus", "event_priority_boost",
]


def explicit_flags(df: DataFrame) -> DataFrame:
    """Which parts of the context are explicit; no context counts as explicit."""
    no_context = ~F.coalesce("has_context", F.lit(True)) if "has_context" in df.columns else F.lit(False)
    has_line = F.col("ctx_line_name").isNotNull()
    return df.withColumns(
        {
            "station_explicit": no_context | F.col("explicit"),
            "line_explicit": no_context | has_line | F.col("explicit"),
        }
    )


def route_evidence(cands: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Line match, distance, cap, hop, bucket and interchange evidence per link."""
    c = F.col
    target_line = F.when(c("has_line"), non_blank("line_id")).otherwise(non_blank("target_line_id"))
    target_area = F.coalesce(non_blank("target_area_id"), F.when(c("has_area") & ~c("conflict"), c("area_origin")))
    d = F.col("station_distance_meters")
    out = cands.withColumns(
        {
            "evidence_line_id": target_line,
            "evidence_line_name": F.coalesce("ctx_line_name", "target_line_name"),
            "evidence_area_id": target_area,
            "station_distance_meters": sphere_m("target_latitude", "target_longitude", "latitude", "longitude"),
        }
    )
    lines = F.when(c("evidence_line_id") == c("line_origin"), c("adjacent_lines"))
    near_areas = F.when(c("evidence_area_id") == c("area_origin"), c("adjacent_areas"))
    by_id = (
        F.when(truthy(c("candidate_line_id") == c("evidence_line_id")), "line_id")
        .when(truthy(F.array_contains(lines, c("candidate_line_id"))), "line_graph_adjacent_line_id")
        .when(c("candidate_line_id").isNull() & (c("line_name") == c("evidence_line_name")), "line_name_fallback")
        .otherwise("none")
    )
    by_name = F.when(c("line_name") == c("evidence_line_name"), "line_name").otherwise("none")
    out = out.withColumns(
        {
            "match_kind": F.when(c("evidence_line_id").isNotNull(), by_id).otherwise(by_name),
            "within_cap": d <= cfg.neighbor_cap_meters,
            "within_hops": c("hop_distance") <= c("max_hops"),
            "is_adjacent_area": truthy(F.array_contains(near_areas, c("candidate_area_id"))),
        }
    )
    bucket = (
        F.when(d <= cfg.interchange_meters, "very_near_station")
        .when(d <= cfg.walkable_meters, "walkable_neighbor")
        .when(c("within_cap"), "nearby_area")
        .otherwise("outside_neighbor_cap")
    )
    return out.withColumns(
        {
            "distance_bucket": bucket,
            "interchange_like": (d <= cfg.interchange_meters)
            & (c("station_id") != c("target_station_id"))
            & truthy(same_ascii(c("target_name"), c("candidate_name")))
            & (c("match_kind") == "none"),
            "counts_as_same_line": (c("match_kind") != "none")
            & ((c("match_kind") != "line_graph_adjacent_line_id") | (c("within_cap") & c("within_hops"))),
        }
    )


def stage_flags(cands: DataFrame) -> DataFrame:
    """One boolean per ladder stage for every (signature, link)."""
    c = F.col
    city, pref = (F.when(~c("conflict"), c(n)) for n in ("city_name", "prefecture_name"))
    pref_match = truthy(same_ascii(c("school_prefecture"), pref))
    same_city = truthy(same_ascii(c("school_area"), city)) & (pref.isNull() | pref_match)
    same_pref = pref.isNotNull() & (pref_match | truthy(same_ascii(c("school_area"), pref)))
    out = explicit_flags(cands).withColumns({"_city": same_city, "_pref": same_pref})
    neighbor = (
        c("station_explicit")
        & (c("station_id") != c("target_station_id"))
        & ~c("counts_as_same_line")
        & ~c("_city")
        & ~c("_pref")
        & (c("within_cap") | c("is_adjacent_area"))
    )
    return out.withColumns(
        {
            "in_strict_station": c("station_explicit") & (c("station_id") == c("target_station_id")),
            "in_same_line": c("line_explicit") & c("counts_as_same_line"),
            "in_same_city": c("_city"),
            "in_same_prefecture": c("_pref"),
            "in_neighbor_area": neighbor,
            "in_safe_global_popular": F.lit(True),
        }
    ).drop("_city", "_pref")


def stage_counts(flags: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Links per stage, as an array in ladder order."""
    counts = F.array(*[F.count_if(f"in_{stage}").cast("int") for stage in cfg.ladder])
    return flags.groupBy("sig").agg(counts.alias("counts"))


def select_stage(plans: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Choose a stage from ``counts``; expects the signature columns, too."""
    c = F.col
    need = F.lit(cfg.minimum_candidates)
    at = {stage: F.get("counts", F.lit(i)) for i, stage in enumerate(cfg.ladder)}
    usable = ~c("conflict") & (c("city_name").isNotNull() | c("prefecture_name").isNotNull())
    scoped = [s for s in cfg.ladder if s != "safe_global_popular"]
    area = [s for s in cfg.ladder if s in ("same_city", "same_prefecture")]
    none = F.lit(None).cast("string")
    first_full = F.coalesce(*[F.when(at[s] >= need, F.lit(s)) for s in scoped], none)
    first_area = F.when(usable, F.coalesce(*[F.when(at[s] > 0, F.lit(s)) for s in area], none)) if area else none
    full_global = F.when(at["safe_global_popular"] >= need, F.lit("safe_global_popular")) if "safe_global_popular" in at else none
    ranked = F.array(*[F.struct(at[s].alias("n"), F.lit(-i).alias("o"), F.lit(s).alias("s")) for i, s in enumerate(cfg.ladder)])
    largest = F.array_max(F.filter(ranked, lambda x: x["n"] > 0))["s"]
    stage = F.coalesce(first_full, first_area, full_global, largest, F.lit("safe_global_popular"))
    reason = (
        F.when(first_full.isNotNull(), "sufficient_scoped")
        .when(first_area.isNotNull(), "underfilled_area")
        .when(full_global.isNotNull(), "sufficient_global")
        .when(largest.isNotNull(), "best_available")
        .otherwise("none")
    )
    return plans.withColumns({"fallback_stage": stage, "selection": reason, "area_context_usable": usable})


def plan_trace(plans: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Add ``stop_reason`` and ``stages``: count, status and reason per stage."""
    c = F.col
    need = cfg.minimum_candidates
    priority = {s: i for i, s in enumerate(cfg.ladder)}
    chosen = lookup({s: F.lit(i) for s, i in priority.items()}, c("fallback_stage"))
    stops = ~c("selection").isin("best_available", "none")
    city, pref = (F.when(~c("conflict"), c(n)).isNotNull() for n in ("city_name", "prefecture_name"))
    entries = []
    for i, stage in enumerate(cfg.ladder):
        n = F.get("counts", F.lit(i))
        missing = F.lit(BELOW)
        if stage == "strict_station":
            missing = F.when(~c("station_explicit"), NO_STATION).otherwise(BELOW)
        elif stage == "same_line":
            missing = F.when(~c("line_explicit"), NO_LINE).otherwise(NO_SAME_LINE)
        elif stage == "same_city":
            missing = F.when(c("conflict"), IGNORED_HINT).when(~city, NO_CITY).otherwise(BELOW)
        elif stage == "same_prefecture":
            missing = F.when(c("conflict"), IGNORED_HINT).when(~pref, NO_PREFECTURE).otherwise(BELOW)
        elif stage == "neighbor_area":
            missing = F.when(~c("station_explicit"), NO_STATION).otherwise(NO_NEIGHBOR)
        selected = c("fallback_stage") == stage
        skipped = stops & (F.lit(i) > chosen)
        status = F.when(selected, "selected").when(skipped, "skipped").otherwise("insufficient")
        few = (n > 0) & (n < need)
        reason = (
            F.when(selected, F.concat(F.lit("selected_"), lookup(STOP, c("selection"))))
            .when(skipped, SKIPPED)
            .when(few, BELOW_BY_STAGE.get(stage, BELOW))
            .otherwise(missing)
        )
        entries.append(
            F.struct(
                F.lit(stage).alias("stage"), n.alias("candidate_count"), F.lit(need).alias("required_min_candidates"),
                status.alias("status"), reason.alias("reason_code"),
            )
        )
    return plans.withColumns({"stop_reason": lookup(STOP, c("selection")), "stages": F.array(*entries)})


def _placement(cfg: RankingConfig, attr: str, kind: str = "double") -> Column:
    return lookup({p.name: F.lit(getattr(p, attr)).cast(kind) for p in cfg.placements}, F.col("placement"))


def visible_events(events: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Active events, once per placement that shows them, with their bonuses."""
    c = F.col
    every = F.array(*[F.lit(p.name) for p in cfg.placements if "event" in p.kinds])
    shown = F.when(F.size(F.coalesce("placement_tags", F.array())) == 0, every).otherwise(F.array_intersect(every, "placement_tags"))
    rows = events.where("is_active").withColumn("placement", F.explode(shown))
    return rows.select(
        "school_id",
        "placement",
        c("id").alias("event_id"),
        F.when(c("is_open_day"), F.lit(cfg.open_day_bonus)).alias("open_day_bonus"),
        F.when(c("is_featured"), _placement(cfg, "featured_bonus")).alias("featured_event_bonus"),
        F.when(c("priority_weight") > 0, c("priority_weight") * _placement(cfg, "priority_weight")).alias("event_priority_boost"),
    )


def leading_events(visible: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Per school and placement, the events that can still be selected.

    Two events of one school differ only by their bonuses.  With the same
    flags the score grows with the priority, so only the ``same_school_cap``
    best ids per weight, and weights within rounding distance of the best,
    can be taken.  This bounds what every candidate link is multiplied by,
    however many events a school has; the cut also happens before the shuffle.
    """
    cap = max(p.same_school_cap for p in cfg.placements)
    c = F.col
    combo = ["school_id", "placement", "_open", "_featured"]
    flagged = visible.withColumns(
        {
            "_open": c("open_day_bonus").isNotNull(),
            "_featured": c("featured_event_bonus").isNotNull(),
            "_weight": F.coalesce("event_priority_boost", F.lit(0.0)),
        }
    )
    same = W.partitionBy(*combo, "_weight").orderBy("event_id")
    heads = flagged.withColumn("_rn", F.row_number().over(same)).where(c("_rn") <= cap)
    band = W.partitionBy(*combo).orderBy(F.floor(c("_weight") * 1e9).desc())
    top = heads.withColumn("_band", F.dense_rank().over(band)).where(c("_band") <= cap + 1)
    return top.drop("_open", "_featured", "_weight", "_rn", "_band")


def _sum(names: list[str], total: Column | None = None) -> Column:
    total = F.lit(0.0) if total is None else total
    for name in names:
        total = total + F.coalesce(name, F.lit(0.0))
    return total


def link_components(cands: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Score parts that depend on the link and the target only."""
    c = F.col

    def closeness(scale: float, value: Column) -> Column:
        return F.greatest(F.lit(scale) - value.cast("double"), F.lit(0.0)) / F.lit(scale)

    return cands.withColumns(
        {
            "direct_station_bonus": F.when(c("station_id") == c("target_station_id"), F.lit(cfg.direct_station_bonus)),
            "school_station_distance": closeness(cfg.distance_scale_meters, c("distance_meters")),
            "walking_minutes_score": closeness(cfg.walking_scale_minutes, c("walking_minutes")),
            "neighbor_station_proximity": closeness(cfg.neighbor_cap_meters, c("station_distance_meters")),
            "popularity_snapshot_bonus": c("popularity.popularity_score") * cfg.popularity_weight,
            "area_affinity_bonus": c("area_affinity.affinity_score") * cfg.area_affinity_weight,
        }
    )


#: The parts of ``base_score`` in the order of their addition; those up to ``LINK_PARTS`` depend on the link and the target only.
BASE_PARTS = ["walking_minutes_score" if n == "walking_minutes" else n for n in COMPONENTS[:9]]
LINK_PARTS = 7


def _penalty(cfg: RankingConfig) -> Column:
    stage = F.col("fallback_stage")
    return F.when(stage == "neighbor_area", F.lit(-cfg.neighbor_penalty)).when(stage == "safe_global_popular", F.lit(-(cfg.neighbor_penalty * 2.0)))


def request_components(rows: DataFrame, user_affinity: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Add the base parts that depend on the request class, and ``base_score``, to links with their class and all parts.

    ``walking_minutes`` names both a link column and a score part; inside the
    pipeline the part is called ``walking_minutes_score``.
    """
    c = F.col
    ua = user_affinity.select("user_id", "school_id", F.struct("user_id", "affinity_score", "event_count").alias("user_affinity"))
    rows = rows.join(ua, ["user_id", "school_id"], "left")
    neighbor = c("fallback_stage") == "neighbor_area"
    line_bonus = F.when(neighbor, _placement(cfg, "same_line_bonus")).otherwise(F.lit(cfg.line_match_bonus))
    rows = rows.withColumns(
        {
            "line_match_bonus": F.when(c("counts_as_same_line"), line_bonus),
            "user_affinity_bonus": c("user_affinity.affinity_score") * cfg.user_affinity_weight,
            "fallback_penalty": _penalty(cfg),
        }
    )
    return rows.withColumn("base_score", _sum(BASE_PARTS))


def base_scores(selected: DataFrame, classes: DataFrame, user_affinity: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Selected-stage links per request class: their keys and ``base_score`` only.

    This is what ranking multiplies; names, texts and score parts are looked up
    again for the few picked links.  ``link_score`` sums up what comes before the
    class's own parts, so the additions are those of ``request_components``.
    """
    c = F.col
    ua = user_affinity.select("user_id", "school_id", (c("affinity_score") * cfg.user_affinity_weight).alias("user_affinity_bonus"))
    ua = ua.join(classes.select("user_id").distinct(), "user_id", "left_semi")
    rows = selected.join(classes, "sig").join(ua, ["user_id", "school_id"], "left").withColumn("fallback_penalty", _penalty(cfg))
    return rows.withColumn("base_score", _sum(["user_affinity_bonus", "fallback_penalty"], c("link_score"))).select(*LINK_KEY, "placement", "base_score")


LINK_KEY = ["class_id", "school_id", "group_id", "station_id"]
ITEM = ["class_id", "content_kind", "content_id", "school_id", "group_id", "station_id", "event_id", "score"]


def _event_rows(base: DataFrame, events: DataFrame, cfg: RankingConfig) -> DataFrame:
    boost = _placement(cfg, "event_boost")
    rows = base.select(*LINK_KEY, "placement", "base_score").join(events, ["school_id", "placement"])
    score = F.col("base_score") + F.when(boost != 0, boost).otherwise(F.lit(0.0))
    for name in COMPONENTS[10:]:
        score = score + F.coalesce(name, F.lit(0.0))
    return rows.withColumn("score", score).select(
        "class_id", F.lit("event").alias("content_kind"), F.col("event_id").alias("content_id"),
        "school_id", "group_id", "station_id", "event_id", "score",
    )


def _school_rows(base: DataFrame, cfg: RankingConfig) -> DataFrame:
    shown = [p.name for p in cfg.placements if "school" in p.kinds]
    boost = _placement(cfg, "school_boost")
    score = F.col("base_score") + F.when(boost != 0, boost).otherwise(F.lit(0.0))
    return base.where(F.col("placement").isin(*shown)).select(
        "class_id", F.lit("school").alias("content_kind"), F.col("school_id").alias("content_id"), "school_id", "group_id",
        "station_id", F.lit(None).cast("string").alias("event_id"), score.alias("score"),
    )


def expand_items(base: DataFrame, events: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """School and event rows with their total score."""
    return _school_rows(base, cfg).unionByName(_event_rows(base, events, cfg))


def item_totals(base: DataFrame, events: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """What the rows of ``expand_items`` add up to: ``items``, ``best`` and ``total`` score per class and kind.

    A school's events add the same bonuses to each of its links, so they are
    counted and summed up once per school and placement, and no link meets them
    one by one.
    """
    c = F.col
    bonus = _sum(COMPONENTS[10:])
    lifts = settle(events.groupBy("school_id", "placement").agg(F.count(F.lit(1)).alias("_n"), F.max(bonus).alias("_best"), F.sum(bonus).alias("_sum")))
    boost = _placement(cfg, "event_boost")
    score = c("base_score") + F.when(boost != 0, boost).otherwise(F.lit(0.0))
    rows = base.select("class_id", "school_id", "placement", "base_score").join(lifts, ["school_id", "placement"])
    shown = rows.groupBy("class_id").agg(F.sum("_n").alias("items"), F.max(score + c("_best")).alias("best"), F.sum(score * c("_n") + c("_sum")).alias("total"))
    schools = _school_rows(base, cfg).groupBy("class_id").agg(F.count(F.lit(1)).alias("items"), F.max("score").alias("best"), F.sum("score").alias("total"))
    kinds = {"school": schools, "event": shown}
    school, event = (df.select("class_id", F.lit(kind).alias("content_kind"), "items", "best", "total") for kind, df in kinds.items())
    return school.unionByName(event)


def rank_order() -> list[Column]:
    """Score, then kind, content and station (the stage is equal within a request)."""
    return [F.col("score").desc(), F.col("content_kind"), F.col("content_id"), F.col("station_id")]


def best_items(items: DataFrame) -> DataFrame:
    """Best row per (kind, content)."""
    order = W.partitionBy("class_id", "content_kind", "content_id").orderBy(*rank_order())
    return items.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == 1).drop("_rn")


def kind_caps(limit: Column, cfg: RankingConfig, attr: str) -> Column:
    ratio = _placement(cfg, attr)
    n = F.ceil(limit.cast("double") * ratio).cast("int")
    return F.coalesce(F.least(F.greatest(n, F.lit(1)), limit), limit)


def diversify(items: DataFrame, classes: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Greedy pick per request class under school, group and kind caps.

    Items are best per content and come in any order.  Counts only grow, so
    for the pick itself the first ``same_school_cap`` items per school and
    kind are enough; the folded array is therefore bounded by the retrieval
    limit.  Result: one row per class with ``picked`` in order.
    """
    c = F.col
    cap = max(p.same_school_cap for p in cfg.placements)
    per_school = W.partitionBy("class_id", "school_id", "content_kind").orderBy(*rank_order())
    few = items.withColumn("_rn", F.row_number().over(per_school)).where(c("_rn") <= cap)
    entry = F.struct(
        (-c("score")).alias("neg"), "content_kind", "content_id", "station_id", "school_id", "group_id", "event_id", "score"
    )
    folded = few.groupBy("class_id").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    rows = folded.join(
        classes.select(
            "class_id", "placement", "limit",
            kind_caps(c("limit"), cfg, "school_ratio").alias("max_school"), kind_caps(c("limit"), cfg, "event_ratio").alias("max_event"),
            _placement(cfg, "same_school_cap", "int").alias("school_cap"), _placement(cfg, "same_group_cap", "int").alias("group_cap"),
        ),
        "class_id",
    )

    def count(state, name, value):
        return F.size(F.filter(state, lambda x: x[name] == value))

    def step(state, x):
        room = F.size(state) < c("limit")
        max_kind = F.when(x["content_kind"] == "school", c("max_school")).otherwise(c("max_event"))
        fits = (
            (count(state, "school_id", x["school_id"]) < c("school_cap"))
            & (count(state, "group_id", x["group_id"]) < c("group_cap"))
            & (count(state, "content_kind", x["content_kind"]) < max_kind)
        )
        return F.when(room & fits, F.concat(state, F.array(x))).otherwise(state)

    picked = F.aggregate("items", F.slice("items", 1, 0), step)
    return rows.withColumn("picked", picked).drop("items")


def _skip_rows(base: DataFrame, cut: DataFrame, cfg: RankingConfig) -> DataFrame:
    """A row per class and school: ``why`` the school is skipped before the last pick, and ``points`` to count its skipped events from.

    Of a school's links only the best one gives the school and its events their
    rank.  An item is skipped for its school behind the pick that fills the
    school's cap, else for its group behind the one that fills the group's, else
    for its kind; so the numbers of events before those picks and before the last
    one, asked from the school's bonus steps, tell all counts.  These are sums and
    differences of those numbers: every point knows how often it counts for each
    reason.  Links are dealt out by their class once.
    """
    c = F.col
    event_boost, school_boost = _placement(cfg, "event_boost"), _placement(cfg, "school_boost")
    lifted = lambda boost: c("base_score") + F.when(boost != 0, boost).otherwise(F.lit(0.0))
    first_by = lambda score: F.min(F.struct((-score).alias("neg"), "station_id", "group_id"))
    best = spread(base.select(*LINK_KEY, "placement", "base_score"), "class_id").groupBy("class_id", "school_id", "placement").agg(
        F.max("base_score").alias("base_score"), first_by(c("base_score"))["group_id"].alias("group_id"), first_by(lifted(school_boost)).alias("own")
    )
    rows = best.join(cut, "class_id")

    rank = ["neg", "content_kind", "content_id", "station_id"]

    def key(s):
        return F.struct(*[s[n].alias(n) for n in rank])

    item = F.struct(c("own.neg").alias("neg"), F.lit("school").alias("content_kind"), c("school_id").alias("content_id"), c("own.station_id").alias("station_id"))
    last = F.when(F.size("picked") >= c("limit"), F.element_at("picked", -1))
    before = last.isNull() | (item < key(last))
    ahead = F.filter("picked", lambda p: key(p) < item)
    taken = F.exists("picked", lambda p: (p["content_kind"] == "school") & (p["content_id"] == c("school_id")))
    full_school = F.size(F.filter(ahead, lambda p: p["school_id"] == c("school_id"))) >= c("school_cap")
    full_group = F.size(F.filter(ahead, lambda p: p["group_id"] == c("own.group_id"))) >= c("group_cap")
    shown = c("placement").isin(*[p.name for p in cfg.placements if "school" in p.kinds])
    why = F.when(shown & before & ~taken, F.when(full_school, "same_school").when(full_group, "same_group").otherwise("kind_school"))

    same = lambda name, cap: F.get(  # noqa: E731 - place in the picks, from one, of the one that fills the cap
        F.filter(F.transform("picked", lambda p, i: F.when(p[name] == c(name), i + 1)), lambda i: i.isNotNull()), c(cap) - 1
    )
    none = F.lit(1 << 30)
    rows = rows.withColumns(
        {
            "why": why, "at_school": F.coalesce(same("school_id", "school_cap"), none), "at_group": F.coalesce(same("group_id", "group_cap"), none),
            "at_last": F.when(F.size("picked") >= c("limit"), F.size("picked")).otherwise(none),
        }
    )
    own = lambda p: (p["school_id"] == c("school_id")) & (p["content_kind"] == "event")
    mine = F.transform("picked", lambda p, i: F.when(own(p), i + 1))
    first = F.least("at_school", "at_group", "at_last")
    rows = rows.withColumns(
        {
            "taken": F.size(F.filter(mine, lambda i: i < first)),
            "by_school": (c("at_school") < c("at_last")).cast("int"),
            "by_group": (c("at_group") < F.least("at_school", "at_last")).cast("int"),
        }
    )
    s, g = c("by_school"), c("by_group")

    def cut_at(at: str, **sums: tuple[Column, Column]) -> Column:
        """A point, the weight of its number of events for each reason, and what each sum is lessened by."""
        pick = F.get("picked", c(at) - 1)
        parts = [F.struct(w.cast("int").alias("w"), less.cast("int").alias("less")).alias(n) for n, (w, less) in sums.items()]
        return F.struct(*[pick[n].alias(n) for n in ("score", "content_kind", "content_id")], *parts)

    def itself(at: str) -> Column:
        return F.coalesce(own(F.get("picked", c(at) - 1)), F.lit(False))

    no, yes = F.lit(0), F.lit(1)
    cuts = F.array(
        cut_at("at_last", same_school=(s, no), same_group=(g * (1 - s), no), kind_event=((1 - g) * (1 - s), c("taken"))),
        F.when(s == 1, cut_at("at_school", same_school=(-yes, itself("at_school")), same_group=(g, no), kind_event=(1 - g, no))),
        F.when(g == 1, cut_at("at_group", same_school=(no, no), same_group=(-yes, itself("at_group")), kind_event=(yes, no))),
    )
    return settle(rows.select("class_id", "school_id", "placement", "why", lifted(event_boost).alias("base"), F.array_compact(cuts).alias("points")), "zstd")


def diversity_summary(base: DataFrame, visible: DataFrame, picks: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Counts of items skipped by the school, group and kind caps before the last pick.

    Schools are looked at one by one, events are counted by rank queries (see ``ranks``).
    """
    c = F.col
    rows = _skip_rows(base, picks.select("class_id", "picked", "school_cap", "group_cap", "limit"), cfg)
    schools = rows.where(c("why").isNotNull()).select("class_id", "why", F.lit(1).cast("long").alias("n"))
    whys = ["same_school", "same_group", "kind_event"]
    points = rows.select("class_id", "school_id", "placement", "base", F.explode("points").alias("p")).select("class_id", "school_id", "placement", "base", "p.*")
    sums = ranks.sums_before(points, ranks.bonus_steps(visible), ["class_id"], whys)
    events = sums.select("class_id", F.explode(F.array(*[F.struct(F.lit(n).alias("why"), c(n).alias("n")) for n in whys])).alias("s")).select("class_id", "s.why", "s.n")
    return schools.unionByName(events).groupBy("class_id").agg(
        *[F.coalesce(F.sum(F.when(c("why") == n, c("n"))), F.lit(0)).alias(f"skipped_{n}") for n in ("same_school", "same_group", "kind_school", "kind_event")]
    )


def score_breakdown(cfg: RankingConfig = DEFAULT_CONFIG) -> Column:
    """The ordered score parts of a picked item, with texts and debug details."""
    c = F.col
    event = c("content_kind") == "event"
    metres = F.round("station_distance_meters").cast("long").cast("string")
    hops = F.concat(c("hop_distance").cast("string"), F.lit("駅目安"))
    line_text = F.when(
        c("match_kind") == "line_graph_adjacent_line_id",
        fill("{line} と接続する路線の候補です（{hops}）。", line=c("evidence_line_name"), hops=hops),
    ).otherwise(fill("{line} 沿線として確認できる候補です（{hops}）。", line=c("evidence_line_name"), hops=hops))
    route = {"target": c("target_name"), "near": c("candidate_name"), "m": metres}
    route_text = (
        F.when(c("interchange_like"), fill("{target} と同名駅の乗換相当として、{near} まで約 {m}m の近さを反映しています。", **route))
        .when(c("is_adjacent_area"), fill("{target} と隣接するエリアの候補として、{near} まで約 {m}m の距離も確認しています。", **route))
        .otherwise(fill("{target} から {near} まで約 {m}m の近さを反映しています。", **route))
    )
    place = lookup(PLACEMENT_LABELS, c("placement"))
    stage_global = c("fallback_stage") == "safe_global_popular"
    line_json = F.struct(
        c("match_kind"), c("evidence_line_id").alias("target_line_id"), "candidate_line_id", c("evidence_line_name").alias("target_line_name"),
        c("line_name").alias("candidate_line_name"), "hop_distance", c("within_cap").alias("within_neighbor_distance_cap"),
        c("within_hops").alias("within_neighbor_hops"),
    )
    route_json = F.struct(
        F.round("station_distance_meters").cast("long").alias("station_distance_meters"), "distance_bucket", "hop_distance",
        c("within_cap").alias("within_neighbor_distance_cap"), c("within_hops").alias("within_neighbor_hops"), "interchange_like",
        F.struct("is_adjacent_area", c("evidence_area_id").alias("target_area_id"), "candidate_area_id").alias("area_graph"),
        F.struct(
            (c("match_kind") != "none").alias("is_same_line"), "match_kind", c("evidence_line_name").alias("target_line_name"),
            c("line_name").alias("candidate_line_name"),
        ).alias("line_match"),
    )
    texts: dict[str, tuple[Column, Column, Column | None]] = {
        "direct_station_bonus": (c("direct_station_bonus"), fill("{t} に直結しています。", t=c("target_name")), None),
        "line_match_bonus": (c("line_match_bonus"), line_text, line_json),
        "school_station_distance": (
            c("school_station_distance"),
            fill("{s} から徒歩 {n} 分です。", s=c("candidate_name"), n=c("walking_minutes").cast("string")),
            None,
        ),
        "walking_minutes": (c("walking_minutes_score"), F.lit("徒歩分数を短い順に評価しました。"), None),
        "neighbor_station_proximity": (c("neighbor_station_proximity"), route_text, route_json),
        "popularity_snapshot_bonus": (
            c("popularity_snapshot_bonus"), F.lit("最近の行動ログで人気が高い学校を少しだけ押し上げます。"), c("popularity")
        ),
        "area_affinity_bonus": (
            c("area_affinity_bonus"), fill("{a} エリアの行動傾向を少し反映しました。", a=c("school_area")), c("area_affinity")
        ),
        "user_affinity_bonus": (c("user_affinity_bonus"), F.lit("このユーザーの最近の反応を少し反映しました。"), c("user_affinity")),
        "neighbor_area_penalty": (
            F.when(~stage_global, c("fallback_penalty")), F.lit("直結候補ではないため、控えめに減点しています。"), None
        ),
        "safe_global_distance_penalty": (
            F.when(stage_global, c("fallback_penalty")), F.lit("広域候補のため、極端に遠い提示を抑える減点を入れています。"), None
        ),
        "content_kind_boost": (
            c("content_kind_boost"),
            F.when(event, F.concat(place, F.lit(" ではイベント候補を少し前に出します。"))).otherwise(
                F.concat(place, F.lit(" では学校候補を少し前に出します。"))
            ),
            None,
        ),
        "open_day_bonus": (
            c("open_day_bonus"), F.lit("公開イベントを持つ候補を少しだけ押し上げます。"), F.struct("event_id", "event_category")
        ),
        "featured_event_bonus": (
            c("featured_event_bonus"), F.lit("注目イベントとして運用上の優先度を反映しています。"), F.struct("event_id")
        ),
        "event_priority_boost": (
            c("event_priority_boost"), F.lit("イベントの運用優先度を少し反映しました。"), F.struct("event_id", "priority_weight")
        ),
    }
    parts = []
    for feature, (value, text, details) in texts.items():
        shown = F.lit(None).cast("string") if details is None else F.when(c("debug"), F.to_json(details))
        part = F.struct(
            F.lit(feature).alias("feature"), F.lit(CORE_REASONS[feature][0]).alias("reason_code"), value.alias("value"),
            text.alias("reason"), shown.alias("details"),
        )
        parts.append(F.when(value.isNotNull(), part))
    return F.array_compact(F.array(*parts))


def plan_candidates(sigs: DataFrame, cands: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> tuple[DataFrame, DataFrame]:
    """Stage plan per signature, and the links of the chosen stage: their keys and ``link_score``.

    ``sigs`` carry the signature columns, ``cands`` these, too, and the links
    with their school, station and snapshot columns.  No link of the neighbour
    stage counts as one of the same line, so the line's part of ``link_score``
    does not depend on the placement.
    """
    rows = link_evidence(cands, cfg).withColumn("line_match_bonus", F.when(F.col("counts_as_same_line"), F.lit(cfg.line_match_bonus)))
    flags = settle(
        rows.select("sig", "school_id", "group_id", "station_id", *[f"in_{s}" for s in cfg.ladder], _sum(BASE_PARTS[:LINK_PARTS]).alias("link_score")),
        "zstd", **{ALL_KEYS: "false"},
    )
    counts = stage_counts(flags, cfg)
    zero = F.array(*[F.lit(0) for _ in cfg.ladder])
    plans = explicit_flags(sigs).join(counts, "sig", "left").withColumn("counts", F.coalesce("counts", zero))
    plans = plan_trace(select_stage(plans, cfg), cfg)
    plans = settle(plans)
    return plans, _in_stage(flags, plans, cfg)


def link_evidence(cands: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Evidence, stage flags and score parts of every (signature, link)."""
    return link_components(stage_flags(route_evidence(cands, cfg)), cfg)


def _in_stage(flags: DataFrame, plans: DataFrame, cfg: RankingConfig) -> DataFrame:
    chosen = lookup({s: F.col(f"in_{s}") for s in cfg.ladder}, F.col("fallback_stage"))
    return flags.join(plans.select("sig", "fallback_stage"), "sig").where(chosen)


def picked_keys(picks: DataFrame, classes: DataFrame) -> DataFrame:
    """``sig, school_id, station_id`` of the links that were picked, once each."""
    flat = picks.select("class_id", F.explode("picked").alias("p")).select("class_id", "p.school_id", "p.station_id")
    return flat.join(classes.select("class_id", "sig"), "class_id").select("sig", "school_id", "station_id").distinct()


def picked_links(cands: DataFrame, plans: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Links with all their evidence, for ``describe_items``: ``cands`` are those of ``plan_candidates``, cut to the picked keys."""
    return settle(_in_stage(link_evidence(cands, cfg), plans, cfg))


def attach_snapshots(cands: DataFrame, popularity: DataFrame, area_affinity: DataFrame) -> DataFrame:
    """Add the popularity and area snapshot rows as structs."""
    pop = popularity.select("school_id", F.struct(*[n for n in popularity.columns if n != "school_id"]).alias("popularity"))
    area = area_affinity.select(F.col("area").alias("school_area"), F.struct(*area_affinity.columns).alias("area_affinity"))
    return cands.join(pop, "school_id", "left").join(area, "school_area", "left")


def attach_dims(links: DataFrame, schools: DataFrame, stations: DataFrame) -> DataFrame:
    """Add school and station columns; links with a missing side are dropped."""
    st = stations.select(
        F.col("id").alias("station_id"), F.col("name").alias("candidate_name"), F.col("line_name").alias("station_line_name"),
        F.col("line_id").alias("candidate_line_id"), F.col("area_id").alias("candidate_area_id"), "latitude", "longitude",
    )
    sc = schools.select(
        F.col("id").alias("school_id"), F.col("name").alias("school_name"), F.col("area").alias("school_area"),
        F.col("prefecture_name").alias("school_prefecture"), "group_id",
    )
    return links.join(st, "station_id").join(sc, "school_id")


def request_classes(rows: DataFrame, user_affinity: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> tuple[DataFrame, DataFrame]:
    """Group requests that must get the same answer.

    The answer depends on the signature, placement, limit and debug flag, and
    on the user only when the user has affinity rows.  Each class is ranked
    once.  Returns (request -> class, classes).
    """
    known = user_affinity.select("user_id").distinct().withColumn("_known", F.lit(True))
    limit = F.least(F.greatest(F.coalesce("limit", F.lit(cfg.limit_default)), F.lit(1)), F.lit(cfg.limit_max))
    keyed = rows.join(known, "user_id", "left").select(
        "request_id", "sig", "placement", "debug", limit.alias("limit"), F.when(F.col("_known"), F.col("user_id")).alias("user_id")
    )
    parts = ["sig", "placement", "limit", "debug", "user_id"]
    keyed = keyed.withColumn("class_id", F.md5(F.to_json(F.struct(*parts))))
    return keyed.select("request_id", "class_id", "sig"), keyed.select("class_id", *parts).dropDuplicates(["class_id"])


def contenders(base: DataFrame, events: DataFrame, classes: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """The rows of ``base`` that can still be picked, as a school (``as_school``) or by an event (``as_event``).

    A school's events add the same to all its links, so only its best link
    counts.  If an item is picked, every school of its group with a better item
    of its kind has been picked from, else the group were full and the item
    skipped; so the schools ahead in its group are less than the group's cap.
    Schools ahead in other groups have been picked from or belong to a full
    group, which bounds them by the limit.  Rows within rounding distance of a
    cut stay.  A class is cut in one task, before events multiply its links.
    """
    c = F.col
    per_group = max(p.same_group_cap for p in cfg.placements)
    lifts = events.groupBy("school_id", "placement").agg(F.max(_sum(COMPONENTS[10:])).alias("_lift"))
    rows = spread(base.select(*LINK_KEY, "placement", "base_score").join(lifts, ["school_id", "placement"], "left"), "class_id")
    rows = rows.join(classes.select("class_id", ((c("limit") - 1) * (1 + per_group) + 1).alias("_most")), "class_id")

    def reaches(value: str, bound: Column) -> Column:
        return c(value) >= bound - F.greatest(F.lit(1.0), F.abs(bound)) * ranks.CLEAR

    school = W.partitionBy("class_id", "school_id")
    rows = rows.withColumns(
        {
            "_best": F.max("base_score").over(school),
            # a school that is listed with several groups is neither cut nor counted
            "_odd": ~F.min("group_id").over(school).eqNullSafe(F.max("group_id").over(school)) | (F.count("group_id").over(school) % F.count(F.lit(1)).over(school) != 0),
        }
    ).where(reaches("base_score", c("_best")))
    rows = rows.withColumns({"_school": c("_best"), "_event": c("_best") + c("_lift")})
    group, whole = W.partitionBy("class_id", "group_id"), W.partitionBy("class_id")
    for kind in ("school", "event"):
        value = f"_{kind}"
        rows = rows.withColumn("_v", F.when(~c("_odd"), c(value)))
        place = F.dense_rank().over(group.orderBy(c("_v").desc_nulls_last(), "school_id"))
        rows = rows.withColumn("_at", F.when(c("group_id").isNull(), F.lit(1)).otherwise(place))
        rows = rows.withColumn("_least", F.min(F.when(c("_at") <= per_group, c("_v"))).over(group))
        rows = rows.withColumn("_v", F.when(c("_at") <= per_group, c("_v")))
        rows = rows.withColumn("_at", F.dense_rank().over(whole.orderBy(c("_v").desc_nulls_last(), "school_id")))
        rows = rows.withColumn("_bound", F.min(F.when(c("_at") <= c("_most"), c("_v"))).over(whole))
        ahead = (c("group_id").isNull() | reaches(value, c("_least"))) & reaches(value, c("_bound"))
        rows = rows.withColumn(f"as_{kind}", c(value).isNotNull() & (c("_odd") | truthy(ahead)))
    return rows.where("as_school OR as_event").select(*LINK_KEY, "placement", "base_score", "as_school", "as_event")


def pick_items(base: DataFrame, classes: DataFrame, visible: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG) -> DataFrame:
    """Diverse picks per class (one row each)."""
    events = leading_events(visible, cfg)
    few = settle(contenders(base, events, classes, cfg))
    items = _school_rows(few.where("as_school"), cfg).unionByName(_event_rows(few.where("as_event"), events, cfg))
    return diversify(best_items(items), classes, cfg)


def describe_items(
    picks: DataFrame, selected: DataFrame, classes: DataFrame, user_affinity: DataFrame, events: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG
) -> DataFrame:
    """Spell out the picked items: names, score parts and explanation, rebuilt by key for the picked links."""
    c = F.col
    flat = picks.select("class_id", F.posexplode("picked").alias("pos", "p")).select(
        "class_id", (c("pos") + 1).alias("position"), *[c(f"p.{n}").alias(n) for n in ("content_kind", "content_id", "school_id", "station_id", "event_id", "score")]
    )
    ev = events.select(
        c("id").alias("event_id"), c("title").alias("event_title"), "event_category", "is_open_day", "is_featured", "priority_weight"
    )
    rows = flat.join(classes, "class_id").join(selected, ["sig", "school_id", "station_id"])
    rows = request_components(rows, user_affinity, cfg).join(ev, "event_id", "left")
    event = c("content_kind") == "event"
    boost = F.when(event, _placement(cfg, "event_boost")).otherwise(_placement(cfg, "school_boost"))
    rows = rows.withColumns(
        {
            "content_kind_boost": F.when(boost != 0, boost),
            "open_day_bonus": F.when(c("is_open_day"), F.lit(cfg.open_day_bonus)),
            "featured_event_bonus": F.when(c("is_featured"), _placement(cfg, "featured_bonus")),
            "event_priority_boost": F.when(c("priority_weight") > 0, c("priority_weight") * _placement(cfg, "priority_weight")),
        }
    )
    rows = rows.withColumn("score_breakdown", score_breakdown(cfg))
    rows = rows.withColumn("labels", explain.top_labels(c("score_breakdown")))
    return rows.select(
        "class_id", "position", "content_kind", "content_id", "school_id", "school_name", "event_id", "event_title",
        c("station_id").alias("primary_station_id"), c("candidate_name").alias("primary_station_name"),
        c("station_line_name").alias("line_name"), "score",
        explain.item_explanation(c("content_kind"), c("fallback_stage"), c("labels")).alias("explanation"),
        "score_breakdown", "fallback_stage", "group_id", "labels",
    )


def describe_results(
    picks: DataFrame, items: DataFrame, base: DataFrame, visible: DataFrame, classes: DataFrame, plans: DataFrame, cfg: RankingConfig = DEFAULT_CONFIG
) -> DataFrame:
    """One header per class: stage, counts, plan trace and explanation.

    ``effective_limit`` is the request's limit after its bounds were applied;
    ``candidates_cut`` says that the pool filled the retrieval limit, so that the
    counts are those of a pool that may have been cut.
    """
    c = F.col
    skips = [f"skipped_{n}" for n in ("same_school", "same_group", "kind_school", "kind_event")]
    summary = diversity_summary(base, visible, picks, cfg)
    first = items.where("position = 1").select("class_id", "labels", "score_breakdown")
    zero = F.lit(0).cast("long")
    rows = (
        classes.select("class_id", "sig", "placement", "limit")
        .join(picks.select("class_id", F.size("picked").alias("selected_count")), "class_id")
        .join(first, "class_id")
        .join(summary, "class_id", "left")
        .join(
            plans.select("sig", "fallback_stage", "counts", "stop_reason", "area_context_usable", "stages", "target_name", "target_line_name", "ctx_line_name"),
            "sig",
        )
        .withColumns({n: F.coalesce(n, zero) for n in skips})
    )
    sentence = explain.diversity_sentence(c("selected_count"), *[c(n) for n in skips])
    text = explain.result_explanation(c("placement"), c("fallback_stage"), c("target_name"), c("target_line_name"), c("labels"), sentence)
    counts = F.map_from_arrays(F.array(*[F.lit(s) for s in cfg.ladder]), c("counts"))
    return rows.select(
        "class_id", "fallback_stage", text.alias("explanation"), "score_breakdown", counts.alias("candidate_counts"),
        F.lit(cfg.minimum_candidates).alias("minimum_candidate_count"), "stop_reason", "area_context_usable", "stages",
        "selected_count", *skips, c("limit").alias("effective_limit"), (F.array_max("counts") >= cfg.candidate_limit).alias("candidates_cut"),
        F.lit(cfg.profile_version).alias("profile_version"), F.lit(cfg.algorithm_version).alias("algorithm_version"),
    )


def conflict_of(warnings: str = "warnings") -> Column:
    return truthy(F.exists(warnings, lambda w: w["code"] == AREA_CONFLICT))

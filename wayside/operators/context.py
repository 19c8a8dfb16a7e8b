"""Request context: which station, line or area a request is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.config import AREA_CONFLICT
from wayside.functions.text import non_blank, same_ascii, trimmed, truthy, user_hash
from wayside.functions.times import hours_between
from wayside.session import spread

# fixed values
SEARCH_WINDOW_HOURS = 72
SEARCH_CONFIDENCE = (0.32, 0.88)
CONFIDENCE = {"request_station": 1.0, "request_line": 0.95, "request_area": 0.95, "default_safe_context": 0.20}
HIERARCHY_CONFIDENCE = {
    "request_station": 0.95,
    "request_line": 0.90,
    "request_area": 0.85,
    "user_profile_area": 0.60,
    "default_safe_context": 0.20,
}
CONFLICT_MESSAGE = "station context was used and conflicting area hint was ignored"
PRIVACY_LEVEL = "coarse_area"
EVIDENCE_KIND = {
    "request_station": "request_station",
    "request_line": "request_line",
    "request_area": "request_area",
    "user_profile_area": "user_profile_context",
    "recent_search_context": "search_execute",
    "recent_behavior_context": "recent_behavior_context",
    "default_safe_context": "default_safe_context",
}
ALLOWED_SHAPES = {
    "request_area": ["area"],
    "request_line": ["line", "area+line"],
    "request_station": ["line+station", "area+line+station"],
    "user_profile_area": ["area", "line", "station", "area+line", "area+station", "line+station", "area+line+station"],
    "recent_search_context": ["line+station"],
    "recent_behavior_context": [],
    "default_safe_context": [""],
}

HINT = ["country", "prefecture_code", "prefecture_name", "city_code", "city_name"]
FIELDS = {
    "context_source": "string", "confidence": "double", "has_area": "boolean", "country": "string",
    "prefecture_code": "string", "prefecture_name": "string", "city_code": "string", "city_name": "string",
    "has_line": "boolean", "line_id": "string", "line_name": "string", "operator_name": "string",
    "ctx_station_id": "string", "ctx_station_name": "string",
    "warnings": "array<struct<code:string,message:string>>",
}
REQUEST = ["request_id", "user_id", "placement", "limit", "debug"]


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _context(**given: Column) -> Column:
    base = {"has_area": F.lit(False), "has_line": F.lit(False), "warnings": F.array().cast(FIELDS["warnings"])}
    base.update(given)
    return F.struct(*[base.get(name, _none(kind)).cast(kind).alias(name) for name, kind in FIELDS.items()])


def normalize_area(df: DataFrame) -> DataFrame:
    """Trim the area hint, turn blanks into nulls, default the country."""
    out = {name: non_blank(name) for name in HINT if name != "country"}
    out["country"] = F.coalesce(non_blank("country"), F.lit("JP"))
    return df.withColumns(out)


def request_context(requests: DataFrame) -> DataFrame:
    """Fill a missing context station from the target station."""
    own = non_blank("station_id")
    return requests.withColumn(
        "station_id", F.when(own.isNotNull(), F.col("station_id")).otherwise(F.coalesce(trimmed("target_station_id"), "station_id"))
    )


def lookup_area(df: DataFrame, areas: DataFrame, hint: dict[str, str], out: str) -> DataFrame:
    """Add struct ``out``: the best area for a hint whose nulls are ignored.

    Works on the distinct hints.  Each hint probes by its most selective part
    (city code, city name, prefecture code, prefecture name), the other parts
    are residual, and the winner is a partial aggregate.
    """
    parts = F.struct(*[F.col(hint[name]).alias(name) for name in HINT])
    df = df.withColumn("_hint", F.to_json(parts))
    c = F.col
    probe = F.coalesce(
        *[
            F.concat(F.lit(tag), value)
            for tag, value in (
                ("cc:", c("city_code")),
                ("cn:", F.lower("city_name")),
                ("pc:", c("prefecture_code")),
                ("pn:", F.lower("prefecture_name")),
            )
        ]
    )
    hints = df.select("_hint", *[c(hint[name]).alias(name) for name in HINT]).distinct().withColumn("_probe", probe)
    keyed = areas.select(
        F.struct(*areas.columns).alias("a"),
        F.explode(
            F.array_compact(
                F.array(
                    F.concat(F.lit("cc:"), "city_code"),
                    F.concat(F.lit("cn:"), F.lower("city_name")),
                    F.concat(F.lit("pc:"), "prefecture_code"),
                    F.concat(F.lit("pn:"), F.lower("prefecture_name")),
                )
            )
        ).alias("_probe"),
    )
    fits = (
        (c("a.country_code") == c("country"))
        & (c("city_code").isNull() | (c("a.city_code") == c("city_code")))
        & (c("prefecture_code").isNull() | (c("a.prefecture_code") == c("prefecture_code")))
        & (c("city_name").isNull() | (F.lower("a.city_name") == F.lower("city_name")))
        & (c("prefecture_name").isNull() | (F.lower("a.prefecture_name") == F.lower("prefecture_name")))
    )
    by_city = c("city_code").isNotNull() | c("city_name").isNotNull()
    by_prefecture = c("prefecture_code").isNotNull() | c("prefecture_name").isNotNull()
    is_city, is_prefecture = c("a.area_level") == "city", c("a.area_level") == "prefecture"
    level = F.when((by_city & is_city) | (by_prefecture & is_prefecture), 0).otherwise(1)
    named = F.when(by_city & is_city & c("a.prefecture_name").isNotNull(), 0).otherwise(1)
    best = (
        hints.join(keyed, "_probe")
        .where(fits)
        .groupBy("_hint")
        .agg(F.min_by("a", F.struct(level.alias("l"), named.alias("n"), c("a.area_id").alias("i"))).alias(out))
    )
    return df.join(best, "_hint", "left").drop("_hint")


def school_area(schools: DataFrame, areas: DataFrame) -> DataFrame:
    """City area of each school: same prefecture first, then the lowest id."""
    c = F.col
    cities = areas.where((c("country_code") == "JP") & (c("area_level") == "city")).select(
        F.lower("city_name").alias("_city"), c("area_id").alias("school_area_id"), c("prefecture_name").alias("_area_prefecture")
    )
    distinct = schools.select("area", "prefecture_name").distinct()
    same = truthy(F.lower("_area_prefecture") == F.lower("prefecture_name"))
    open_ = c("prefecture_name").isNull() | c("_area_prefecture").isNull() | same
    best = (
        distinct.withColumn("_city", F.lower("area"))
        .join(cities, "_city")
        .where(open_)
        .groupBy("area", "prefecture_name")
        .agg(
            F.min_by(
                F.struct("school_area_id", "_area_prefecture"), F.struct((~same).alias("o"), c("school_area_id").alias("i"))
            ).alias("best")
        )
    )
    joined = schools.alias("s").join(
        best.alias("b"), (c("s.area") == c("b.area")) & c("s.prefecture_name").eqNullSafe(c("b.prefecture_name")), "left"
    )
    return joined.select(
        "s.*",
        c("b.best.school_area_id").alias("school_area_id"),
        F.coalesce("s.prefecture_name", "b.best._area_prefecture").alias("school_prefecture_name"),
    )


def recent_search(log: DataFrame, stations: DataFrame, as_of: Column) -> DataFrame:
    """Newest station search per user in the last 72 hours, with confidence."""
    fresh = log.where(
        (F.col("event_type") == "search_execute")
        & (F.col("occurred_at") <= as_of)
        & (F.col("occurred_at") >= as_of - F.expr(f"INTERVAL {SEARCH_WINDOW_HOURS} HOURS"))
    ).select("user_id", "id", "occurred_at", F.col("target_station_id").alias("station_id"))
    known = fresh.join(stations.select(F.col("id").alias("station_id")), "station_id", "left_semi")
    newest = known.groupBy("user_id").agg(
        F.max_by(F.struct("station_id", "occurred_at"), F.struct("occurred_at", "id")).alias("s")
    )
    window = F.lit(float(SEARCH_WINDOW_HOURS))
    age = F.least(F.greatest(hours_between(as_of, F.col("s.occurred_at")), F.lit(0.0)), window)
    fresh_part = 1.0 - age / window
    low, high = SEARCH_CONFIDENCE
    return newest.select(
        "user_id",
        F.col("s.station_id").alias("station_id"),
        (F.lit(low) + F.lit(high - low) * (fresh_part * fresh_part)).alias("confidence"),
    )


def profile_context(profiles: DataFrame, areas: DataFrame, lines: DataFrame, stations: DataFrame, as_of: Column) -> DataFrame:
    """Unexpired profiles that carry an area signal, a line or a station."""
    c = F.col
    live = profiles.where(c("retained_until").isNull() | (c("retained_until") > as_of)).alias("p")
    joined = (
        live.join(areas.alias("a"), c("a.area_id") == c("p.area_id"), "left")
        .join(lines.alias("l"), c("l.line_id") == c("p.line_id"), "left")
        .join(stations.select(c("id").alias("sid"), c("name").alias("sname")).alias("s"), c("s.sid") == c("p.station_id"), "left")
    )
    signal = F.coalesce(*[non_blank(f"a.{n}") for n in ("prefecture_code", "prefecture_name", "city_code", "city_name")])
    has_area = c("a.country_code").isNotNull() & signal.isNotNull()
    area = {n: F.when(has_area, c(f"a.{n}")) for n in ("prefecture_code", "prefecture_name", "city_code", "city_name")}
    ctx = _context(
        context_source=F.lit("user_profile_area"),
        confidence=c("p.confidence"),
        has_area=has_area,
        country=F.when(has_area, c("a.country_code")),
        has_line=c("l.line_name").isNotNull(),
        line_id=c("l.line_id"),
        line_name=c("l.line_name"),
        operator_name=c("l.operator_name"),
        ctx_station_id=c("s.sid"),
        ctx_station_name=c("s.sname"),
        **area,
    )
    useful = has_area | c("l.line_name").isNotNull() | c("s.sid").isNotNull()
    return joined.where(useful).select(c("p.user_id").alias("user_id"), ctx.alias("profile"))


def strongest_user_context(recent: Column, profile: Column) -> Column:
    """A profile wins when it is at least as sure as the recent search."""
    both = F.when(profile["confidence"] >= recent["confidence"], profile).otherwise(recent)
    return F.when(recent.isNull(), profile).when(profile.isNull(), recent).otherwise(both)


def area_hint_matches() -> Column:
    """Whether a station agrees with an area hint; expects the joined row."""
    c = F.col
    inferred = F.when(c("city_code").isNotNull() | c("city_name").isNotNull(), c("_city_area"))
    st = {n: non_blank(f"st.area.{n}") for n in ("country_code", "prefecture_code", "prefecture_name", "city_code", "city_name")}
    asked_country = non_blank("_raw_country")
    ok_country = asked_country.isNull() | truthy(same_ascii(F.coalesce(st["country_code"], F.lit("JP")), asked_country))
    ok_code = c("city_code").isNull() | truthy(same_ascii(c("st.area.city_code"), c("city_code")))
    ok_city = c("city_name").isNull() | F.when(
        st["city_name"].isNotNull(), truthy(same_ascii(st["city_name"], c("city_name")))
    ).otherwise(truthy(c("_linked_city")))

    def agrees(name: str) -> Column:
        actual = F.when(st[name].isNotNull(), st[name]).otherwise(inferred[name])
        return c(name).isNull() | truthy(same_ascii(actual, c(name)))

    return ok_country & ok_code & ok_city & agrees("prefecture_code") & agrees("prefecture_name")


def _station_rows(stations: DataFrame, lines: DataFrame, areas: DataFrame) -> DataFrame:
    c = F.col
    joined = (
        stations.alias("s")
        .join(lines.alias("l"), c("l.line_id") == c("s.line_id"), "left")
        .join(areas.alias("a"), c("a.area_id") == c("s.area_id"), "left")
    )
    area = F.struct(*[c(f"a.{n}").alias(n) for n in ("country_code", "prefecture_code", "prefecture_name", "city_code", "city_name")])
    return joined.select(
        c("s.id").alias("_sid"),
        F.struct("s.id", "s.name", "s.line_name", "s.line_id", c("l.operator_name").alias("operator_name"), area.alias("area")).alias("st"),
    )


def resolve_context(
    requests: DataFrame,
    stations: DataFrame,
    lines: DataFrame,
    areas: DataFrame,
    links: DataFrame,
    schools: DataFrame,
    log: DataFrame,
    profiles: DataFrame,
    as_of: Column,
    use_recent: bool = True,
) -> DataFrame:
    """Resolve every request: station, line, area, user, then a safe default."""
    c = F.col
    req = request_context(requests).withColumn("_raw_country", c("country"))
    req = normalize_area(req).withColumns(
        {
            "_blank": truthy(trimmed("station_id") == ""),
            "_station": non_blank("station_id"),
            "_line": non_blank("line_id"),
            "_line_name": non_blank("line_name"),
            "_has_hint": F.coalesce("prefecture_code", "prefecture_name", "city_code", "city_name").isNotNull(),
        }
    )
    station_rows = _station_rows(stations, lines, areas)
    req = req.join(station_rows, c("_station") == c("_sid"), "left").drop("_sid")
    req = lookup_area(req, areas, {n: n for n in HINT}, "_area")
    # country, city code and city name alone: fills a prefecture the station lacks
    city_country = F.coalesce(non_blank("_raw_country"), non_blank("st.area.country_code"), F.lit("JP"))
    req = req.withColumns({"_cc": city_country, "_none": _none()})
    req = lookup_area(
        req,
        areas,
        {"country": "_cc", "prefecture_code": "_none", "prefecture_name": "_none", "city_code": "city_code", "city_name": "city_name"},
        "_city_area",
    )
    linked = (
        links.select("school_id", c("station_id").alias("_station"))
        .join(schools.select(c("id").alias("school_id"), F.lower("area").alias("_city")), "school_id")
        .select("_station", "_city")
        .distinct()
        .withColumn("_linked_city", F.lit(True))
    )
    req = req.withColumn("_city", F.lower("city_name")).join(linked, ["_station", "_city"], "left")

    by_id = lines.select(c("line_id").alias("_line"), F.struct("line_id", "line_name", "operator_name").alias("_by_id"))
    by_name = lines.groupBy(c("line_name").alias("_line_name")).agg(
        F.min_by(F.struct("line_id", "line_name", "operator_name"), "line_id").alias("_by_name")
    )
    req = req.join(by_id, "_line", "left").join(by_name, "_line_name", "left")

    req = req.join(profile_context(profiles, areas, lines, stations, as_of), "user_id", "left")
    if use_recent:
        seen = recent_search(log, stations, as_of).join(station_rows, c("station_id") == c("_sid"))
        recent = _context(
            context_source=F.lit("recent_search_context"), confidence=c("confidence"), has_line=F.lit(True),
            line_id=c("st.line_id"), line_name=c("st.line_name"), operator_name=c("st.operator_name"),
            ctx_station_id=c("st.id"), ctx_station_name=c("st.name"),
        )
        req = req.join(seen.select("user_id", recent.alias("recent")), "user_id", "left")
        user_ctx = strongest_user_context(c("recent"), c("profile"))
    else:
        user_ctx = c("profile")

    # joins leave the rows without their key in one partition
    req = spread(req, "request_id")
    # the hint as resolved: the stored area when one fits, the hint itself otherwise
    names = {"country": "country_code", **{n: n for n in HINT if n != "country"}}
    area = {n: F.when(c("_area").isNotNull(), c(f"_area.{stored}")).otherwise(c(n)) for n, stored in names.items()}

    def area_if(cond: Column) -> dict[str, Column]:
        return {"has_area": truthy(cond), **{n: F.when(cond, v) for n, v in area.items()}}

    # shared conditions are columns of their own, so that they are evaluated once
    found_line = F.coalesce(c("_by_id"), c("_by_name"))
    req = req.withColumns({"_conflict": c("_has_hint") & ~area_hint_matches(), "_found": found_line, "_user": user_ctx})
    req = req.withColumns({f"_h_{n}": value for n, value in area.items()})
    area = {n: c(f"_h_{n}") for n in area}
    conflict, found_line = c("_conflict"), c("_found")
    warning = F.array(F.struct(F.lit(AREA_CONFLICT).alias("code"), F.lit(CONFLICT_MESSAGE).alias("message")))
    none_yet = F.array().cast(FIELDS["warnings"])
    station_ctx = _context(
        context_source=F.lit("request_station"), confidence=F.lit(CONFIDENCE["request_station"]), has_line=F.lit(True),
        line_id=c("st.line_id"), line_name=c("st.line_name"), operator_name=c("st.operator_name"),
        ctx_station_id=c("st.id"), ctx_station_name=c("st.name"),
        warnings=F.when(conflict, warning).otherwise(none_yet), **area_if(c("_has_hint") & ~conflict),
    )
    line_ctx = _context(
        context_source=F.lit("request_line"), confidence=F.lit(CONFIDENCE["request_line"]), has_line=F.lit(True),
        line_id=found_line["line_id"], line_name=F.coalesce(found_line["line_name"], c("_line_name")),
        operator_name=found_line["operator_name"], **area_if(c("_has_hint")),
    )
    area_ctx = _context(
        context_source=F.lit("request_area"), confidence=F.lit(CONFIDENCE["request_area"]), **area_if(c("_has_hint"))
    )
    safe = _context(context_source=F.lit("default_safe_context"), confidence=F.lit(CONFIDENCE["default_safe_context"]))
    asks_line = c("_line").isNotNull() | c("_line_name").isNotNull()
    error = (
        F.when(c("_blank"), F.lit("station_id must not be blank"))
        .when(c("_station").isNotNull() & c("st").isNull(), F.concat(F.lit("unknown station: "), "_station"))
        .when(
            c("_station").isNull() & c("_line").isNotNull() & c("_by_id").isNull() & c("_line_name").isNull(),
            F.concat(F.lit("unknown line_id: "), "_line"),
        )
    )
    rung = (
        F.when(error.isNotNull(), "error")
        .when(c("_station").isNotNull(), "station")
        .when(asks_line, "line")
        .when(c("_has_hint"), "area")
        .when(c("_user").isNotNull(), "user")
        .otherwise("safe")
    )
    ladder = {"station": station_ctx, "line": line_ctx, "area": area_ctx, "user": c("_user"), "safe": safe}
    out = req.withColumns({"error": error, "_rung": rung})
    out = out.select(*REQUEST, "error", "_rung", *[ctx.alias(f"_{name}") for name, ctx in ladder.items()])

    def pick(field: str) -> Column:
        value = F.lit(None)
        for name in ladder:
            value = F.when(c("_rung") == name, c(f"_{name}.{field}")).otherwise(value)
        return value.alias(field)

    return out.select(*REQUEST, *[pick(n) for n in FIELDS], "error")


def decay_evidence(evidence: DataFrame, max_age_hours: float) -> DataFrame:
    """Confidence that fades with the square of the age; no age, no fading."""
    part = F.least(F.col("age_hours") / F.lit(max_age_hours), F.lit(1.0))
    faded = F.col("confidence") * (1.0 - part * part)
    return evidence.withColumn("decayed", F.when(F.col("age_hours") <= 0, F.col("confidence")).otherwise(faded))


def resolve_hierarchy(requests: DataFrame) -> DataFrame:
    """Context from the request and profile alone, without any lookup."""
    c = F.col
    line = F.coalesce(non_blank("line_id"), non_blank("line_name"))
    hint = F.coalesce(*[non_blank(n) for n in HINT if n != "country"])
    profile_hint = F.coalesce(*[non_blank(f"profile_{n}") for n in HINT if n != "country"])
    source = (
        F.when(non_blank("station_id").isNotNull(), "request_station")
        .when(line.isNotNull(), "request_line")
        .when(hint.isNotNull(), "request_area")
        .when(profile_hint.isNotNull(), "user_profile_area")
        .otherwise("default_safe_context")
    )
    out = requests.withColumn("context_source", source)
    confidence = F.lit(None).cast("double")
    for name, value in HIERARCHY_CONFIDENCE.items():
        confidence = F.when(c("context_source") == name, F.lit(value)).otherwise(confidence)
    is_line = c("context_source") == "request_line"
    from_profile = c("context_source") == "user_profile_area"
    return out.select(
        "request_id",
        "context_source",
        confidence.alias("confidence"),
        F.when(c("context_source") == "request_station", c("station_id")).alias("ctx_station_id"),
        F.when(is_line, non_blank("line_id")).alias("line_id"),
        F.when(is_line, F.coalesce(non_blank("line_name"), F.lit(""))).alias("line_name"),
        F.when(from_profile, non_blank("profile_city_name")).otherwise(
            F.when(c("context_source").startswith("request"), non_blank("city_name"))
        ).alias("city_name"),
        F.when(from_profile, non_blank("profile_prefecture_name")).otherwise(
            F.when(c("context_source").startswith("request"), non_blank("prefecture_name"))
        ).alias("prefecture_name"),
    )


def evidence_summary(ctx: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in EVIDENCE_KIND.items() for x in pair])
    some = F.col("context_source") != "default_safe_context"
    return ctx.select(
        "request_id",
        kind[F.col("context_source")].alias("primary_kind"),
        F.when(some, 1).otherwise(0).alias("evidence_count"),
        F.when(some, F.col("confidence")).otherwise(F.lit(0.0)).alias("strongest_strength"),
        (F.col("context_source") == "recent_search_context").alias("has_search_execute"),
    )


STATION = ["id", "name", "line_name", "line_id", "area_id", "latitude", "longitude"]


def _area_spots(schools: DataFrame, areas: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nearest linked station per (city, prefecture) and per single area name."""
    c = F.col
    cities = areas.where((c("country_code") == "JP") & (c("area_level") == "city"))
    city_pref = cities.select(F.lower("city_name").alias("_city"), F.lower("prefecture_name").alias("_ap"), "area_id")
    home = schools.select(c("id").alias("school_id"), F.lower("area").alias("_city"), F.lower("prefecture_name").alias("_pref"))
    best = F.min(F.struct("distance_meters", "walking_minutes", "station_id")).alias("best")
    near = links.groupBy("school_id").agg(best)
    own = home.where(c("_pref").isNotNull()).select("school_id", "_city", "_pref")
    via_area = home.where(c("_pref").isNull()).drop("_pref").join(city_pref.where(c("_ap").isNotNull()), "_city")
    pairs = own.unionByName(via_area.select("school_id", "_city", c("_ap").alias("_pref"))).distinct()
    by_pair = pairs.join(near, "school_id").groupBy("_city", "_pref").agg(F.min("best").alias("best"))
    first_area = city_pref.groupBy("_city").agg(F.min_by("_ap", "area_id").alias("_ap"))
    names = home.join(first_area, "_city", "left").select(
        "school_id", F.explode(F.array_distinct(F.array_compact(F.array("_city", "_pref", "_ap")))).alias("_name")
    )
    by_name = names.join(near, "school_id").groupBy("_name").agg(F.min("best").alias("best"))
    return by_pair, by_name


def station_for_context(ctx: DataFrame, stations: DataFrame, links: DataFrame, schools: DataFrame, areas: DataFrame) -> DataFrame:
    """Add the target station: by station, line, city, prefecture, else the first one."""
    c = F.col
    by_line = stations.where(c("line_id").isNotNull()).groupBy(c("line_id").alias("_l")).agg(F.min("id").alias("_s_line"))
    by_name = stations.groupBy(c("line_name").alias("_n")).agg(
        F.min("id").alias("_s_name"), F.min(F.when(c("line_id").isNull(), c("id"))).alias("_s_bare")
    )
    pair, single = _area_spots(schools, areas, links.join(stations.select(c("id").alias("station_id")), "station_id", "left_semi"))
    out = (
        ctx.withColumns({"_city": F.lower("city_name"), "_pref": F.lower("prefecture_name")})
        .join(by_line, c("line_id") == c("_l"), "left")
        .join(by_name, c("line_name") == c("_n"), "left")
        .join(pair.withColumnRenamed("best", "_b_pair"), ["_city", "_pref"], "left")
        .join(single.select(c("_name").alias("_city"), c("best").alias("_b_city")), "_city", "left")
        .join(single.select(c("_name").alias("_pref"), c("best").alias("_b_pref")), "_pref", "left")
    )
    first = stations.agg(F.min("id").alias("id")).scalar()
    on_line = F.when(c("line_id").isNotNull(), F.coalesce("_s_line", "_s_bare")).otherwise(c("_s_name"))
    in_city = F.when(c("_pref").isNotNull(), c("_b_pair.station_id")).otherwise(c("_b_city.station_id"))
    target = (
        F.when(c("ctx_station_id").isNotNull(), c("ctx_station_id"))
        .when(c("line_name").isNotNull(), on_line)
        .otherwise(F.coalesce(in_city, c("_b_pref.station_id"), first))
    )
    out = out.withColumn("target_station_id", F.when(c("error").isNull(), target))
    st = stations.select(c("id").alias("target_station_id"), *[c(n).alias(f"target_{n}") for n in STATION if n != "id"])
    keep = [*ctx.columns, "target_station_id"]
    return out.select(*keep).join(st, "target_station_id", "left")


def context_traces(ctx: DataFrame, areas: DataFrame, salt: str) -> DataFrame:
    """One audit row per resolved request; the user only as a salted hash."""
    found = lookup_area(ctx, areas, {n: n for n in HINT}, "_a")
    return found.where(F.col("error").isNull()).select(
        "request_id",
        user_hash(salt, F.col("user_id")).alias("user_id_hash"),
        "context_source",
        "confidence",
        F.col("_a.area_id").alias("area_id"),
        non_blank("line_id").alias("line_id"),
        F.col("ctx_station_id").alias("station_id"),
        F.array_sort("warnings").alias("warnings"),
    )


def session_issues(sessions: DataFrame) -> DataFrame:
    """Reject reason per session summary row; null when the row is sound."""
    reasons = [
        F.when(~truthy(F.col("session_id_hash").rlike("^[0-9A-Fa-f]{64}$")), F.lit("session_id_hash must be a 64-character hex digest"))
    ]
    for name in ("context_source", "privacy_level", "primary_kind"):
        reasons.append(F.when(non_blank(name).isNull(), F.lit(f"{name} must not be blank")))
    for name in ("confidence", "evidence_count", "search_execute_count", "warning_count"):
        reasons.append(F.when(F.coalesce(F.col(name) < 0, F.lit(True)), F.lit(f"{name} must not be negative")))
    for name in ("area_id", "line_id", "station_id"):
        reasons.append(F.when(F.col(name).isNotNull() & non_blank(name).isNull(), F.lit(f"{name} must not be blank")))
    return sessions.withColumn("reason", F.coalesce(*reasons))


def recent_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` sound session summaries."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    sound = session_issues(sessions).where(F.col("reason").isNull()).drop("reason")
    return sound.orderBy(F.col("last_seen_at").desc(), "session_id_hash").limit(n)


def context_shape_issues(ctx: DataFrame) -> DataFrame:
    """Contexts whose set of parts is not allowed for their source."""
    shape = F.concat_ws(
        "+",
        F.when(F.col("has_area"), F.lit("area")),
        F.when(F.col("has_line"), F.lit("line")),
        F.when(F.col("ctx_station_id").isNotNull(), F.lit("station")),
    )
    allowed = F.lit(False)
    for source, shapes in ALLOWED_SHAPES.items():
        if shapes:
            allowed = F.when(F.col("context_source") == source, shape.isin(*shapes)).otherwise(allowed)
    rows = ctx.withColumns({"shape": shape, "_ok": allowed})
    return rows.where(~F.col("_ok")).select("request_id", "context_source", "shape")

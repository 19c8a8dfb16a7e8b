"""Row normalisers, validators and projections.

Validators do not stop at the first bad row: they return the sound rows and
the rejected ones with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.config import EVENT_KINDS, PLACEMENTS
from wayside.functions.text import non_blank, stable_id, trimmed, truthy, user_hash
from wayside.functions.times import EPOCH, event_time, rfc3339_utc, utc_naive

# fixed values: forms of stored legacy time stamps
LEGACY_NAIVE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$"
LEGACY_ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)$"


def is_object(col) -> Column:
    """Whether JSON text is an object."""
    return truthy(F.schema_of_variant(F.try_parse_json(col)).startswith("OBJECT"))


def tags(col) -> Column:
    """Pipe text to trimmed, non-blank tags."""
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), r"\|"), trimmed), lambda t: t != "")


def split_rejected(df: DataFrame, *reasons: Column) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("reason", F.coalesce(*reasons))
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound and rejected event records.

    Repeated ids are found by a count per id joined back, so one id with very
    many copies is reduced before the shuffle.
    """
    c = F.col
    copies = df.groupBy("event_id").agg(F.count(F.lit(1)).alias("_copies"))
    rows = df.join(copies, "event_id", "left").withColumn("_tags", tags("placement_tags"))
    allowed = F.array(*[F.lit(p) for p in PLACEMENTS])
    ok, bad = split_rejected(
        rows,
        *[F.when(non_blank(n).isNull(), F.lit(f"{n} must not be empty")) for n in ("event_id", "school_id", "title")],
        F.when(c("_copies") > 1, F.lit("duplicate event_id")),
        F.when(non_blank("starts_at").isNotNull() & event_time("starts_at").isNull(), F.lit("starts_at must be a date or an RFC3339 time")),
        F.when(F.size(F.array_except("_tags", allowed)) > 0, F.lit("unsupported placement tag")),
        F.when(c("is_open_day").isNull() | c("is_featured").isNull() | c("priority_weight").isNull(), F.lit("a value could not be read")),
        F.when(~is_object("details"), F.lit("details must be a JSON object")),
    )
    return ok.drop("_copies", "_tags"), bad.drop("_copies", "_tags")


def to_events(df: DataFrame, source_type: Column, source_key: Column, updated_at: Column | None = None) -> DataFrame:
    """Validated records as rows of the events table."""
    stamp = updated_at if updated_at is not None else F.lit(None).cast("timestamp_ntz")
    return df.select(
        F.col("event_id").alias("id"), "school_id", "title", "event_category", "is_open_day", "is_featured", "priority_weight",
        event_time("starts_at").alias("starts_at"), tags("placement_tags").alias("placement_tags"), "details", F.lit(True).alias("is_active"),
        source_type.alias("source_type"), source_key.alias("source_key"), stamp.alias("updated_at"),
    )


def normalize_times(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Text times to UTC; unreadable text is rejected, blank text is null."""
    parsed = df.withColumn("_t", event_time(col))
    ok, bad = split_rejected(parsed, F.when(non_blank(col).isNotNull() & F.col("_t").isNull(), F.lit(f"{col} must be a date or an RFC3339 time")))
    return ok.withColumn(col, F.col("_t")).drop("_t"), bad.drop("_t")


def backfill_legacy_times(df: DataFrame, col: str, default: str | None = EPOCH) -> DataFrame:
    """Stored text times to UTC: naive text is UTC, other text the default."""
    text = F.nullif(F.col(col), F.lit(""))
    naive = F.when(text.rlike(LEGACY_NAIVE), text.try_cast("timestamp_ntz"))
    zoned = F.when(text.rlike(LEGACY_ZONED), utc_naive(F.try_to_timestamp(text)))
    return df.withColumn(col, F.coalesce(naive, zoned, F.lit(default).cast("timestamp_ntz")))


def with_stable_id(df: DataFrame, prefix: str, cols: list[str], out: str = "id") -> DataFrame:
    """Add a readable id made of the given columns."""
    return df.withColumn(out, stable_id(prefix, F.concat_ws(":", *[non_blank(n) for n in cols])))


def validate_track(df: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Sound and rejected behaviour events; a missing time is ``as_of``."""
    c = F.col
    needs_school = c("event_kind").isin("school_view", "school_save", "apply_click", "share")
    blank = {n: non_blank(n).isNull() for n in ("user_id", "school_id", "event_id", "target_station_id")}
    ok, bad = split_rejected(
        df,
        F.when(blank["user_id"], F.lit("user_id must not be empty")),
        F.when(~truthy(c("event_kind").isin(*EVENT_KINDS)), F.lit("unknown event_kind")),
        F.when(needs_school & blank["school_id"], F.concat(F.lit("school_id is required for "), "event_kind")),
        F.when((c("event_kind") == "search_execute") & blank["target_station_id"], F.lit("target_station_id is required for search_execute")),
        F.when((c("event_kind") == "event_view") & blank["event_id"] & blank["school_id"], F.lit("event_view requires event_id or school_id")),
        F.when(c("occurred_at").isNotNull() & rfc3339_utc("occurred_at").isNull(), F.lit("occurred_at must be RFC3339")),
    )
    return ok.withColumn("occurred_at", F.coalesce(rfc3339_utc("occurred_at"), as_of)), bad


def resolve_event_school(log: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill the school of an event; reject unknown events and mismatches."""
    c = F.col
    known = events.select(c("id").alias("event_id"), c("school_id").alias("_owner"))
    rows = log.join(known, "event_id", "left")
    ok, bad = split_rejected(
        rows,
        F.when(c("event_id").isNotNull() & c("_owner").isNull(), F.lit("unknown event_id")),
        F.when(c("_owner").isNotNull() & (c("school_id") != c("_owner")), F.lit("event belongs to another school")),
    )
    return ok.withColumn("school_id", F.coalesce("school_id", "_owner")).drop("_owner"), bad.drop("_owner")


def check_refs(log: DataFrame, schools: DataFrame, events: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reject rows that name an unknown school, event or station."""
    rows, reasons = log, []
    for col, dim in (("school_id", schools), ("event_id", events), ("target_station_id", stations)):
        known = dim.select(F.col("id").alias(col), F.lit(True).alias(f"_{col}"))
        rows = rows.join(known, col, "left")
        reasons.append(F.when(F.col(col).isNotNull() & F.col(f"_{col}").isNull(), F.lit(f"unknown {col}")))
    ok, bad = split_rejected(rows, *reasons)
    marks = ("_school_id", "_event_id", "_target_station_id")
    return ok.drop(*marks), bad.drop(*marks)


def _attributes(**values: Column) -> Column:
    entries = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def to_entity(schools: DataFrame) -> DataFrame:
    """Schools as generic entities."""
    attributes = _attributes(
        area=F.col("area"), group_id=F.col("group_id"), prefecture_name=F.col("prefecture_name"), school_type=F.col("school_type")
    )
    return schools.select("id", F.lit("school").alias("content_kind"), F.col("name").alias("display_name"), attributes.alias("attributes"))


def to_occurrence(events: DataFrame) -> DataFrame:
    """Events as generic occurrences; empty details are left out."""
    details = F.when(F.coalesce(F.regexp_replace("details", r"\s", ""), F.lit("{}")) != "{}", F.col("details"))
    attributes = _attributes(
        details=details, event_category=F.col("event_category"), is_featured=F.col("is_featured").cast("string"),
        is_open_day=F.col("is_open_day").cast("string"), priority_weight=F.col("priority_weight").cast("string"),
    )
    return events.select(
        "id", F.col("school_id").alias("entity_id"), F.lit("event").alias("content_kind"), F.col("event_category").alias("occurrence_kind"), "title",
        "starts_at", "placement_tags", "is_active", attributes.alias("attributes"),
    )


def to_canonical(entities: DataFrame, occurrences: DataFrame, evidence: DataFrame, profile_id: str, source_id: str) -> DataFrame:
    """Entities, occurrences and context evidence in one record shape.

    ``evidence``: record_id, entity_id, station_id, line_id, line_name.
    """
    none = F.lit(None).cast("string")
    lineage = F.struct(F.lit(source_id).alias("source_id"))
    place = F.struct(*[none.alias(n) for n in ("station_id", "line_id", "line_name")])

    def rows(df: DataFrame, kind: str, content: str, entity: Column, record: Column, title: Column, starts: Column, where: Column, attributes: Column):
        return df.select(
            F.lit(kind).alias("record_kind"), F.lit(profile_id).alias("profile_id"), F.lit(content).alias("content_kind"), entity.alias("entity_id"),
            record.alias("record_id"), title.alias("title"), starts.cast("timestamp_ntz").alias("starts_at"), where.alias("location_context"),
            lineage.alias("lineage"), attributes.alias("attributes"),
        )

    c = F.col
    no_place = F.when(F.lit(False), place)
    spot = F.struct("station_id", "line_id", "line_name")
    empty = F.create_map().cast("map<string,string>")
    return (
        rows(entities, "entity", "school", c("id"), c("id"), c("display_name"), none, no_place, c("attributes"))
        .unionByName(rows(occurrences, "occurrence", "event", c("entity_id"), c("id"), c("title"), c("starts_at"), no_place, c("attributes")))
        .unionByName(rows(evidence, "context_evidence", "school", c("entity_id"), c("record_id"), none, none, spot, empty))
    )


def hash_users(df: DataFrame, salt: str, col: str = "user_id") -> DataFrame:
    """Replace the user id by its salted hash."""
    return df.withColumn(f"{col}_hash", user_hash(salt, F.col(col))).drop(col)


def clean_text(col) -> Column:
    """White space of every kind collapsed to single blanks, ends trimmed."""
    return F.btrim(F.regexp_replace(col, r"(?U)[\s 　]+", " "))


def slash_date(col) -> Column:
    """`Y/M/D` to ISO; null unless there are exactly three numbers."""
    parts = F.split(trimmed(col), "/")
    numbers = F.transform(parts, lambda p: F.when(p.rlike(r"^\+?[0-9]+$"), p.try_cast("int")))
    whole = (F.size(parts) == 3) & F.forall(numbers, lambda n: n.isNotNull())
    return F.when(whole, F.format_string("%04d-%02d-%02d", *[F.get(numbers, F.lit(i)) for i in range(3)]))


def absolute_url(col, base: Column) -> Column:
    """A relative address put under its site; absolute ones stay."""
    url = trimmed(col)
    return F.when(url.startswith("https://") | url.startswith("http://"), url).otherwise(
        F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(url, "^/+", ""))
    )


def bool_text(col) -> Column:
    """true/1/yes and false/0/no in any case; null for other text."""
    text = F.lower(trimmed(col))
    return F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False)


def clean_extracted(rows: DataFrame, base_url: str) -> tuple[DataFrame, DataFrame]:
    """Clean title, date, address and flag text of extracted rows."""
    flags = [n for n in ("is_open_day", "is_featured") if n in rows.columns]
    out = rows.withColumns(
        {
            "title": clean_text("title"),
            "starts_at": F.when(F.col("starts_at").contains("/"), slash_date("starts_at")).otherwise(non_blank("starts_at")),
            "detail_url": absolute_url("detail_url", F.lit(base_url)),
            **{f"_{n}": bool_text(n) for n in flags},
        }
    )
    ok, bad = split_rejected(out, *[F.when(F.col(n).isNotNull() & F.col(f"_{n}").isNull(), F.lit(f"unsupported {n} value")) for n in flags], F.lit(None).cast("string"))
    ok = ok.withColumns({n: F.col(f"_{n}") for n in flags})
    return ok.drop(*[f"_{n}" for n in flags]), bad.drop(*[f"_{n}" for n in flags])

"""Readers for event feeds, reference tables and captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside import schemas
from wayside.functions.text import non_blank

CORRUPT = "_corrupt"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV with an explicit schema; unreadable lines keep their text."""
    return (
        spark.read.schema(f"{schema}, {CORRUPT} string")
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("enforceSchema", False)
        .csv(path)
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail the job when a feed is empty (checked on one row only)."""
    if df.isEmpty():
        raise ValueError(f"{what} did not contain any records")
    return df


def flag(col: str) -> Column:
    """`true` / `false` text; blank counts as false, other text as null."""
    text = F.lower(F.trim(col))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(False)).otherwise(text.try_cast("boolean"))


def event_defaults(df: DataFrame) -> DataFrame:
    """Give feed rows their defaults and types; values that do not parse become null."""
    weight = F.trim("priority_weight")
    return df.select(
        "event_id",
        "school_id",
        "title",
        F.coalesce(non_blank("event_category"), F.lit("general")).alias("event_category"),
        flag("is_open_day").alias("is_open_day"),
        flag("is_featured").alias("is_featured"),
        F.when(F.coalesce(weight, F.lit("")) == "", F.lit(0.0)).otherwise(weight.try_cast("double")).alias("priority_weight"),
        "starts_at",
        F.coalesce("placement_tags", F.lit("")).alias("placement_tags"),
        F.coalesce("details", F.lit("{}")).alias("details"),
    )


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """Event CSV; details are never read from CSV."""
    return event_defaults(_csv(spark, path, schemas.EVENT_FEED).withColumn("details", F.lit("{}")))


def parse_events_ndjson(lines: DataFrame) -> DataFrame:
    """Event records from a ``value`` column of JSON lines.

    Placement tags are a pipe text or a list of texts; both come out as a
    pipe text.  Blank lines are skipped.  A line that is no JSON object gives
    a row whose ids are null, which validation rejects.
    """
    c = F.col
    rows = lines.where(non_blank("value").isNotNull()).withColumn("v", F.try_parse_json("value"))

    def text(name: str) -> Column:
        return F.try_variant_get("v", f"$.{name}", "string")

    tags = F.try_variant_get("v", "$.placement_tags", "array<string>")
    details = F.try_variant_get("v", "$.details", "variant")
    named = rows.select(
        *[text(n).alias(n) for n in ("event_id", "school_id", "title", "event_category", "is_open_day", "is_featured", "priority_weight", "starts_at")],
        F.when(tags.isNotNull(), F.array_join(tags, "|")).otherwise(text("placement_tags")).alias("placement_tags"),
        F.when(details.isNull() | F.is_variant_null(details), F.lit("{}")).otherwise(F.to_json(details)).alias("details"),
    )
    return event_defaults(named.withColumn("details", c("details")))


def read_events_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Event NDJSON; an empty file is an error."""
    return require_rows(parse_events_ndjson(spark.read.text(path)), "event feed")


def rail_stations(raw: DataFrame) -> DataFrame:
    return raw.withColumn("station_id", F.concat(F.lit("jp_station_"), "station_code")).drop(CORRUPT)


def read_rail(spark: SparkSession, path: str) -> DataFrame:
    return rail_stations(require_rows(_csv(spark, path, schemas.RAIL), "rail stations"))


def read_postal(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.POSTAL).drop(CORRUPT)


def school_records(raw: DataFrame) -> DataFrame:
    return raw.withColumn("school_id", F.concat(F.lit("jp_school_"), "school_code")).drop(CORRUPT)


def read_school_codes(spark: SparkSession, path: str) -> DataFrame:
    return school_records(_csv(spark, path, schemas.SCHOOL_CODES))


def read_school_geodata(spark: SparkSession, path: str) -> DataFrame:
    return school_records(_csv(spark, path, schemas.SCHOOL_GEODATA))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages stored as Parquet."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_log_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Behaviour log lines; the payload stays JSON text."""
    return spark.read.schema(schemas.LOG).json(path)


def load_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five files of a seed bundle as model tables.

    Loading twice gives the same tables: dimensions are keyed and log rows
    that are equal, nulls included, count once.
    """
    from wayside.operators import dims, normalize

    stations = _csv(spark, f"{folder}/stations.csv", schemas.STATIONS).drop(CORRUPT).withColumnRenamed("station_id", "id")
    schools = _csv(spark, f"{folder}/schools.csv", schemas.SCHOOLS).drop(CORRUPT).withColumnRenamed("school_id", "id")
    links = _csv(spark, f"{folder}/school_station_links.csv", schemas.LINKS).drop(CORRUPT)
    events, _ = normalize.validate_events(read_events_csv(spark, f"{folder}/events.csv"))
    log = read_log_ndjson(spark, f"{folder}/user_events.ndjson")
    log = log.withColumn("occurred_at", normalize.rfc3339_utc("occurred_at")).withColumnRenamed("event_kind", "event_type")
    lines, stations = dims.build_lines(stations)
    return {
        "lines": lines,
        "stations": stations,
        "areas": dims.build_areas(schools),
        "schools": schools,
        "links": links.dropDuplicates(["school_id", "station_id"]),
        "events": normalize.to_events(events, F.lit("seed"), F.lit(None).cast("string")),
        "user_events": log.dropDuplicates(),
    }

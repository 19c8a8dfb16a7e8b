"""Building and merging dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.functions.text import non_blank, stable_id
from wayside.sources.sinks import upsert


def build_lines(stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines by name, and the stations with their line id."""
    line_id = stable_id("line", F.col("line_name"))
    lines = stations.select(line_id.alias("line_id"), "line_name").groupBy("line_id").agg(F.max("line_name").alias("line_name"))
    lines = lines.select("line_id", "line_name", F.lit(None).cast("string").alias("operator_name"), F.lit("JP").alias("country_code"))
    stations = stations.withColumn("line_id", line_id)
    if "area_id" not in stations.columns:
        stations = stations.withColumn("area_id", F.lit(None).cast("string"))
    return lines, stations


def build_areas(schools: DataFrame) -> DataFrame:
    """Prefecture and city areas named by schools.

    Ids that collide keep the last name in order, as keyed writes do.
    """
    none = F.lit(None).cast("string")
    named = schools.select("area", "prefecture_name").distinct()
    prefecture = non_blank("prefecture_name")
    prefectures = named.where(prefecture.isNotNull()).select(
        stable_id("area", prefecture).alias("area_id"), prefecture.alias("prefecture_name"), none.alias("city_name"), F.lit("prefecture").alias("area_level")
    )
    key = F.when(prefecture.isNotNull(), F.concat(prefecture, F.lit(":"), "area")).otherwise(F.col("area"))
    cities = named.select(
        stable_id("area", key).alias("area_id"), "prefecture_name", F.col("area").alias("city_name"), F.lit("city").alias("area_level")
    )
    rank = F.struct((F.col("area_level") == "city").alias("c"), "city_name", "prefecture_name")
    both = prefectures.unionByName(cities).groupBy("area_id").agg(
        F.max_by(F.struct("prefecture_name", "city_name", "area_level"), rank).alias("a")
    )
    return both.select(
        "area_id", F.lit("JP").alias("country_code"), none.alias("prefecture_code"), "a.prefecture_name", none.alias("city_code"), "a.city_name", "a.area_level"
    )


def merge_schools(current: DataFrame, codes: DataFrame) -> DataFrame:
    """School upsert; a stored group id stays, a missing one becomes the own id."""
    c = F.col
    new = codes.select(
        c("school_id").alias("id"), c("name").alias("n_name"), c("city_name").alias("n_area"), c("prefecture_name").alias("n_prefecture"),
        c("school_type").alias("n_type"), F.lit(True).alias("_new"),
    ).dropDuplicates(["id"])
    both = current.join(new, "id", "full")

    def pick(stored: str, fresh: str):
        return F.when(c("_new"), c(fresh)).otherwise(c(stored)).alias(stored)

    return both.select(
        "id", pick("name", "n_name"), pick("area", "n_area"), pick("prefecture_name", "n_prefecture"), pick("school_type", "n_type"),
        F.when(c("_new"), F.coalesce(F.nullif("group_id", F.lit("")), "id")).otherwise(c("group_id")).alias("group_id"),
    )


def merge_stations(current: DataFrame, rail: DataFrame) -> DataFrame:
    """Station upsert from rail rows; line and area ids stay as stored."""
    c = F.col
    new = rail.select(
        c("station_id").alias("id"), c("station_name").alias("n_name"), c("line_name").alias("n_line"), c("latitude").alias("n_lat"), c("longitude").alias("n_lon")
    ).dropDuplicates(["id"])
    both = current.join(new, "id", "full")
    return both.select(
        "id", F.coalesce("n_name", "name").alias("name"), F.coalesce("n_line", "line_name").alias("line_name"), "line_id", "area_id",
        F.coalesce("n_lat", "latitude").alias("latitude"), F.coalesce("n_lon", "longitude").alias("longitude"),
    )


def merge_postal(current: DataFrame, new: DataFrame) -> DataFrame:
    """Postal upsert on all four columns."""
    key = ["postal_code", "prefecture_name", "city_name", "town_name"]
    if set(current.columns) == set(key):
        return current.unionByName(new.select(*key)).dropDuplicates(key)
    return upsert(current, new, key)

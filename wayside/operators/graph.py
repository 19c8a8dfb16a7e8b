"""Adjacency edges of lines and areas, one hop at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayside.config import AREA_CONFLICT
from wayside.functions.text import non_blank, truthy
from wayside.operators.context import HINT, lookup_area


# fixed values: land borders of the 47 prefectures, plus the bridge 01-02; 47 has none
PREFECTURE_BORDERS = {
    "01": ("02",),
    "02": ("01", "03"),
    "03": ("02", "04", "05"),
    "04": ("03", "06", "07"),
    "05": ("03", "06"),
    "06": ("04", "05", "07", "15"),
    "07": ("04", "06", "08", "09", "10", "15"),
    "08": ("07", "09", "11", "12"),
    "09": ("07", "08", "10", "11"),
    "10": ("07", "09", "11", "15", "20"),
    "11": ("08", "09", "10", "12", "13", "19"),
    "12": ("08", "11", "13"),
    "13": ("11", "12", "14", "19"),
    "14": ("13", "19", "22"),
    "15": ("06", "07", "10", "16", "20"),
    "16": ("15", "17", "20", "21"),
    "17": ("16", "18", "21"),
    "18": ("17", "20", "21", "25", "26"),
    "19": ("11", "13", "14", "20", "22"),
    "20": ("10", "15", "16", "18", "19", "21", "22", "23"),
    "21": ("16", "17", "18", "20", "23", "24", "25"),
    "22": ("14", "19", "20", "23"),
    "23": ("20", "21", "22", "24"),
    "24": ("21", "23", "25", "26", "29", "30"),
    "25": ("18", "21", "24", "26"),
    "26": ("18", "24", "25", "27", "28", "29", "30"),
    "27": ("26", "28", "29"),
    "28": ("26", "27", "29", "31", "33"),
    "29": ("24", "26", "27", "28", "30"),
    "30": ("24", "26", "29"),
    "31": ("28", "32", "33", "34"),
    "32": ("31", "34", "35"),
    "33": ("28", "31", "34", "37"),
    "34": ("31", "32", "33", "35", "38"),
    "35": ("32", "34", "40"),
    "36": ("37", "38", "39"),
    "37": ("33", "36", "38"),
    "38": ("34", "36", "37", "39"),
    "39": ("36", "38"),
    "40": ("35", "41", "43", "44"),
    "41": ("40", "42"),
    "42": ("41",),
    "43": ("40", "44", "45", "46"),
    "44": ("40", "43", "45"),
    "45": ("43", "44", "46"),
    "46": ("43", "45"),
    "47": (),
}


def prefecture_edges(spark) -> DataFrame:
    """Listed borders and their reverse, as one small edge table."""
    rows = [(code, other) for code, others in PREFECTURE_BORDERS.items() for other in others]
    edges = spark.createDataFrame(rows, "prefecture_code string, neighbor_code string")
    back = edges.select(F.col("neighbor_code").alias("prefecture_code"), F.col("prefecture_code").alias("neighbor_code"))
    return edges.unionByName(back).distinct()


def prefecture_neighbors(df: DataFrame, code: str = "prefecture_code") -> DataFrame:
    """Rows repeated per neighbouring prefecture (the edge table is a constant of a few hundred rows)."""
    edges = prefecture_edges(df.sparkSession).withColumnRenamed("prefecture_code", code)
    return df.join(edges, code)


def area_origin(ctx: DataFrame, areas: DataFrame) -> DataFrame:
    """Add ``area_origin`` and how it was found."""
    found = lookup_area(ctx, areas, {n: n for n in HINT}, "_oa")
    conflict = F.exists("warnings", lambda w: w["code"] == AREA_CONFLICT)
    own = F.when(~conflict & F.col("has_area"), F.col("_oa.area_id"))
    return found.withColumns(
        {
            "conflict": truthy(conflict),
            "area_origin": F.coalesce(own, F.col("target_area_id")),
            "area_origin_source": F.when(own.isNotNull(), "context_area").when(F.col("target_area_id").isNotNull(), "target_station_area"),
        }
    ).drop("_oa")


def line_origin(ctx: DataFrame) -> DataFrame:
    """Add ``line_origin``: the context line, else the line of an explicit station."""
    own = non_blank("line_id")
    via = F.when(F.col("ctx_station_id").isNotNull(), non_blank("target_line_id"))
    return ctx.withColumns(
        {
            "line_origin": F.coalesce(own, via),
            "line_origin_source": F.when(own.isNotNull(), "context_line").when(via.isNotNull(), "target_station_line"),
        }
    )


def _neighbors(edges: DataFrame, source: str, target: str, out: str) -> DataFrame:
    to = non_blank(target)
    sound = edges.select(F.col(source).alias("_o"), to.alias("_t")).where(F.col("_t").isNotNull() & (F.col("_t") != F.col("_o")))
    return sound.groupBy("_o").agg(F.array_sort(F.collect_set("_t")).alias(out))


def expand_lines(requests: DataFrame, line_adj: DataFrame) -> DataFrame:
    """Add the sorted distinct neighbour lines of ``line_origin``."""
    near = _neighbors(line_adj, "from_line_id", "to_line_id", "adjacent_lines")
    return requests.join(near, F.col("line_origin") == F.col("_o"), "left").drop("_o")


def expand_areas(requests: DataFrame, area_adj: DataFrame) -> DataFrame:
    """Add the sorted distinct neighbour areas of ``area_origin``."""
    near = _neighbors(area_adj, "from_area_id", "to_area_id", "adjacent_areas")
    return requests.join(near, F.col("area_origin") == F.col("_o"), "left").drop("_o")


def _is_object(col) -> Column:
    return truthy(F.schema_of_variant(F.try_parse_json(col)).startswith("OBJECT"))


def validate_adjacency(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``reason``, null for sound edges (areas and lines share the rules)."""
    reasons = [F.when(non_blank(n).isNull(), F.lit(f"{n} must not be blank")) for n in (source, target)]
    reasons.append(F.when(F.trim(source) == F.trim(target), F.lit("adjacency must connect different ends")))
    reasons.append(F.when(non_blank("adjacency_kind").isNull(), F.lit("adjacency_kind must not be blank")))
    for name in ("distance_meters", "station_hop_count"):
        if name in edges.columns:
            reasons.append(F.when(F.col(name) < 0, F.lit(f"{name} must not be negative")))
    for name in ("area_cluster_id", "interchange_station_id", "source_id", "source_version"):
        if name in edges.columns:
            reasons.append(F.when(F.col(name).isNotNull() & non_blank(name).isNull(), F.lit(f"{name} must not be blank")))
    if "attributes" in edges.columns:
        reasons.append(F.when(~_is_object("attributes"), F.lit("attributes must be a JSON object")))
    return edges.withColumn("reason", F.coalesce(*reasons))


def _order(edges: DataFrame, origin: str, keys: list[Column]) -> DataFrame:
    rest = [F.col(n).asc_nulls_last() for n in ("source_id", "source_version") if n in edges.columns]
    return edges.withColumn("edge_order", F.row_number().over(W.partitionBy(origin).orderBy(*keys, *rest)))


def order_area_edges(edges: DataFrame) -> DataFrame:
    keys = [F.col("adjacency_kind"), F.col("distance_meters").asc_nulls_last(), F.col("to_area_id"), F.col("area_cluster_id").asc_nulls_last()]
    return _order(edges, "from_area_id", keys)


def order_line_edges(edges: DataFrame) -> DataFrame:
    keys = [
        F.col("adjacency_kind"),
        F.col("station_hop_count").asc_nulls_last(),
        F.col("interchange_station_id").asc_nulls_last(),
        F.col("to_line_id"),
        F.col("requires_transfer"),
    ]
    return _order(edges, "from_line_id", keys)


def area_clusters(area_adj: DataFrame) -> DataFrame:
    """Areas seen in each cluster of an origin's edges."""
    seen = area_adj.where(F.col("area_cluster_id").isNotNull()).select(
        F.col("from_area_id").alias("origin_area_id"), "area_cluster_id", F.explode(F.array("from_area_id", "to_area_id")).alias("a")
    )
    return seen.groupBy("origin_area_id", "area_cluster_id").agg(F.array_sort(F.collect_set("a")).alias("observed_area_ids"))


def station_hops(line_adj: DataFrame) -> DataFrame:
    return order_line_edges(line_adj).select(
        "from_line_id", "edge_order", "to_line_id", "adjacency_kind", "station_hop_count", "interchange_station_id", "requires_transfer"
    )


def interchanges(line_adj: DataFrame) -> DataFrame:
    return (
        line_adj.where(F.col("interchange_station_id").isNotNull())
        .groupBy("from_line_id", "interchange_station_id")
        .agg(
            F.array_sort(F.collect_set("to_line_id")).alias("to_line_ids"),
            F.array_sort(F.collect_set("adjacency_kind")).alias("adjacency_kinds"),
            F.bool_or("requires_transfer").alias("requires_transfer"),
            F.min("station_hop_count").alias("minimum_station_hop_count"),
        )
    )


def graph_diagnostics(origins: DataFrame, area_adj: DataFrame, line_adj: DataFrame, sample: int = 8) -> DataFrame:
    """Per request: graph origins, edge counts, samples of eight and warnings."""
    c = F.col
    area_side = (
        area_adj.groupBy(c("from_area_id").alias("area_origin"))
        .agg(F.count(F.lit(1)).alias("area_edges"), F.array_sort(F.collect_set("to_area_id")).alias("area_ids"))
        .join(area_clusters(area_adj).groupBy(c("origin_area_id").alias("area_origin")).agg(F.count(F.lit(1)).alias("clusters")), "area_origin", "left")
    )
    line_side = (
        line_adj.groupBy(c("from_line_id").alias("line_origin"))
        .agg(F.count(F.lit(1)).alias("line_edges"), F.array_sort(F.collect_set("to_line_id")).alias("line_ids"))
        .join(interchanges(line_adj).groupBy(c("from_line_id").alias("line_origin")).agg(F.count(F.lit(1)).alias("changes")), "line_origin", "left")
    )
    joined = origins.join(area_side, "area_origin", "left").join(line_side, "line_origin", "left")
    unresolved = ~c("conflict") & c("has_area") & (F.coalesce("area_origin_source", F.lit("")) != "context_area")
    warnings = F.array_compact(
        F.array(
            F.when(c("conflict"), F.lit("area_context_ignored_by_station_conflict")),
            F.when(unresolved, F.lit("context_area_id_unresolved")),
            F.when(c("area_origin").isNull(), F.lit("geo_graph_origin_unavailable")),
            F.when(c("line_origin").isNull(), F.lit("line_graph_origin_unavailable")),
        )
    )
    zero, empty = F.lit(0).cast("long"), F.array().cast("array<string>")

    def status(origin: str) -> Column:
        return F.when(c(origin).isNotNull(), F.lit("loaded")).otherwise(F.lit("origin_unavailable"))

    return joined.select(
        "request_id", "area_origin", "area_origin_source", "line_origin", "line_origin_source",
        status("area_origin").alias("geo_status"),
        F.coalesce("area_edges", zero).alias("area_edge_count"),
        F.coalesce(F.size("area_ids").cast("long"), zero).alias("adjacent_area_count"),
        F.coalesce(F.slice("area_ids", 1, sample), empty).alias("adjacent_area_sample"),
        F.coalesce("clusters", zero).alias("area_cluster_count"),
        status("line_origin").alias("line_status"),
        F.coalesce("line_edges", zero).alias("line_edge_count"),
        F.coalesce(F.slice("line_ids", 1, sample), empty).alias("adjacent_line_sample"),
        F.coalesce("changes", zero).alias("interchange_count"),
        F.array_sort(F.array_distinct(warnings)).alias("graph_warnings"),
    )

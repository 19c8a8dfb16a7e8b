"""The model tables as views over the driver's tables, in Spark and in SQL.

Each table is defined twice with the same rule: a DataFrame here and a CTE in
``ORACLE_TABLES``.  All rows of the source tables are used.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.functions.text import stable_id
from wayside.operators import links as link_ops
from wayside.session import settle, spread

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _text(prefix: str, col) -> F.Column:
    return F.concat(F.lit(prefix), F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


class Model:
    """Lazily built model tables for one folder of source tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _count(self, name: str):
        """Row count of a source table as a scalar subquery."""
        return self.source(name).agg(F.count(F.lit(1)).alias("n")).scalar()

    @cached_property
    def nations(self) -> DataFrame:
        """Nations with their region.  Joins carry a hint: the size of this join is estimated by a product, beyond that of a table in one small file, which would be broadcast instead."""
        region = self.source("region")
        return self.source("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))

    @cached_property
    def areas(self) -> DataFrame:
        cities = self.nations.select(
            stable_id("area", F.concat_ws(":", "r_name", "n_name")).alias("area_id"),
            F.lit("JP").alias("country_code"),
            F.lpad(F.col("r_regionkey").cast("string"), 2, "0").alias("prefecture_code"),
            F.col("r_name").alias("prefecture_name"),
            F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("city_code"),
            F.col("n_name").alias("city_name"),
            F.lit("city").alias("area_level"),
        )
        prefectures = self.source("region").select(
            stable_id("area", F.col("r_name")).alias("area_id"),
            F.lit("JP").alias("country_code"),
            F.lpad(F.col("r_regionkey").cast("string"), 2, "0").alias("prefecture_code"),
            F.col("r_name").alias("prefecture_name"),
            F.lit(None).cast("string").alias("city_code"),
            F.lit(None).cast("string").alias("city_name"),
            F.lit("prefecture").alias("area_level"),
        )
        return cities.unionByName(prefectures)

    @cached_property
    def schools(self) -> DataFrame:
        s = self.source("supplier").join(F.broadcast(self.nations), F.col("s_nationkey") == F.col("n_nationkey"))
        kind = F.element_at(F.array(F.lit("junior_high"), F.lit("high"), F.lit("combined")), F.col("s_suppkey").cast("int") % 3 + 1)
        return s.select(
            _text("s", "s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("area"),
            F.when(F.col("s_suppkey") % 11 != 0, F.col("r_name")).alias("prefecture_name"),
            kind.alias("school_type"),
            _text("g", F.col("s_suppkey") % 17).alias("group_id"),
        )

    def _place(self, key: str, a: int, b: int):
        k = F.col(key)
        lat = F.lit(35.5) + ((k * a) % 10007).cast("double") / F.lit(25000.0)
        lon = F.lit(139.5) + ((k * b) % 10007).cast("double") / F.lit(25000.0)
        return lat, lon

    @cached_property
    def school_geo(self) -> DataFrame:
        lat, lon = self._place("s_suppkey", 3571, 9241)
        return self.source("supplier").select(
            _text("s", "s_suppkey").alias("school_id"), lat.alias("latitude"), lon.alias("longitude")
        )

    @cached_property
    def customers(self) -> DataFrame:
        """Customers with their nation, spread because the table may be one file that a single task reads."""
        return spread(self.source("customer"), "c_custkey").join(F.broadcast(self.nations), F.col("c_nationkey") == F.col("n_nationkey"))

    @cached_property
    def stations(self) -> DataFrame:
        """Settled because many branches read it."""
        lat, lon = self._place("c_custkey", 7919, 5227)
        c = self.customers
        rows = c.select(
            _text("c", "c_custkey").alias("id"),
            _text("stn", F.col("c_custkey") % 40).alias("name"),
            F.col("c_mktsegment").alias("line_name"),
            F.when(F.col("c_custkey") % 7 != 0, stable_id("line", F.col("c_mktsegment"))).alias("line_id"),
            F.when(
                F.col("c_custkey") % 13 != 0, stable_id("area", F.concat_ws(":", "r_name", "n_name"))
            ).alias("area_id"),
            lat.alias("latitude"),
            lon.alias("longitude"),
        )
        return settle(rows)

    @cached_property
    def lines(self) -> DataFrame:
        return (
            self.source("customer")
            .select("c_mktsegment")
            .distinct()
            .select(
                stable_id("line", F.col("c_mktsegment")).alias("line_id"),
                F.col("c_mktsegment").alias("line_name"),
                F.lit(None).cast("string").alias("operator_name"),
            )
        )

    @cached_property
    def derived_links(self) -> DataFrame:
        return link_ops.derive_links(self.school_geo, self.stations.withColumnRenamed("id", "station_id"))

    @cached_property
    def links(self) -> DataFrame:
        """Derived links with a spread of hop distances; settled because many branches read it."""
        hops = (F.col("distance_meters") % 5).cast("short")
        return settle(self.derived_links.withColumn("hop_distance", hops))

    @cached_property
    def line_adjacencies(self) -> DataFrame:
        """Each line adjoins the next one by name, in both directions."""
        ordered = self.lines.agg(F.array_sort(F.collect_list(F.struct("line_name", "line_id"))).alias("l"))
        pairs = F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.struct(F.element_at("l", i)["line_id"].alias("a"), F.element_at("l", i + 1)["line_id"].alias("b")))
        forward = ordered.select(F.explode(pairs).alias("p")).select(F.col("p.a").alias("from_line_id"), F.col("p.b").alias("to_line_id"))
        backward = forward.select(F.col("to_line_id").alias("from_line_id"), F.col("from_line_id").alias("to_line_id"))
        edges = forward.withColumn("hops", F.lit(1)).unionByName(backward.withColumn("hops", F.lit(2)))
        return edges.select(
            "from_line_id",
            "to_line_id",
            F.lit("interchange").alias("adjacency_kind"),
            F.when(F.col("hops") == 1, F.lit("c1")).alias("interchange_station_id"),
            F.col("hops").alias("station_hop_count"),
            (F.col("hops") == 2).alias("requires_transfer"),
        )

    @cached_property
    def area_adjacencies(self) -> DataFrame:
        n = self.nations.select("n_nationkey", stable_id("area", F.concat_ws(":", "r_name", "n_name")).alias("area_id"), "n_regionkey")
        a, b = n.alias("a"), n.alias("b")
        pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey")))
        return pairs.select(
            F.col("a.area_id").alias("from_area_id"),
            F.col("b.area_id").alias("to_area_id"),
            F.lit("border").alias("adjacency_kind"),
            F.when(
                F.col("b.n_nationkey") % 3 != 0,
                F.abs(F.col("a.n_nationkey") - F.col("b.n_nationkey")).cast("double") * 1000.0,
            ).alias("distance_meters"),
            _text("cluster", F.col("a.n_regionkey")).alias("area_cluster_id"),
        )

    @cached_property
    def events(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        school = F.when(key % 4 == 0, F.lit("s7")).otherwise(_text("s", key % self._count("supplier")))
        tags = F.expr(
            "CASE p_size % 4 WHEN 0 THEN array() WHEN 1 THEN array('search')"
            " WHEN 2 THEN array('home', 'detail') ELSE array('search', 'mypage') END"
        )
        crawled = key % 5 == 0
        return self.source("part").select(
            _text("e", "p_partkey").alias("id"),
            school.alias("school_id"),
            F.col("p_name").alias("title"),
            F.lower("p_type").alias("event_category"),
            (size % 5 == 0).alias("is_open_day"),
            (size % 7 == 0).alias("is_featured"),
            ((size % 6).cast("double") / F.lit(10.0)).alias("priority_weight"),
            F.when(key % 9 != 0, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(p_partkey % 400 as int))")).alias("starts_at"),
            tags.alias("placement_tags"),
            F.concat(F.lit('{"brand":"'), F.col("p_brand"), F.lit('"}')).alias("details"),
            (key % 10 != 3).alias("is_active"),
            F.when(crawled, F.lit("crawl")).otherwise(F.lit("event_csv")).alias("source_type"),
            F.when(crawled & (key % 3 == 0), F.lit(None).cast("string")).otherwise(F.lower("p_type")).alias("source_key"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(p_partkey % 30 as int))").alias("updated_at"),
        )

    @cached_property
    def user_events(self) -> DataFrame:
        e, key = self.source("events"), F.col("event_id")
        kind = F.expr(
            "CASE event_type WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'share' ELSE 'school_view' END"
            " WHEN 'click' THEN 'event_view' WHEN 'signup' THEN 'school_save'"
            " WHEN 'purchase' THEN 'apply_click' ELSE 'search_execute' END"
        )
        school = F.when(key % 3 == 0, F.lit("s3")).otherwise(_text("s", (key * 7) % self._count("supplier")))
        search = F.col("event_type") == "error"
        return e.select(
            F.col("event_id").alias("id"),
            _text("u", "user_id").alias("user_id"),
            F.when(~search, school).alias("school_id"),
            kind.alias("event_type"),
            F.when(F.col("event_type") == "click", _text("e", key % self._count("part"))).alias("event_id"),
            F.when(search, _text("c", key % self._count("customer"))).alias("target_station_id"),
            F.col("ts").cast("timestamp_ntz").alias("occurred_at"),
            F.col("props").alias("payload"),
        )

    @cached_property
    def profiles(self) -> DataFrame:
        """A profile for each user seen in the log: by area, line, station or expired."""
        u = self.source("events").select("user_id").distinct()
        k = F.col("user_id")
        area = F.array_sort(F.collect_list("area_id"))
        cities = self.areas.where("area_level = 'city'").agg(area.alias("ids")).scalar()
        lines = self.lines.agg(F.array_sort(F.collect_list("line_id")).alias("ids")).scalar()
        return u.select(
            _text("u", "user_id").alias("user_id"),
            F.when(k % 4 == 0, F.get(cities, (k % 25).cast("int"))).alias("area_id"),
            F.when(k % 4 == 1, F.get(lines, (k % 5).cast("int"))).alias("line_id"),
            F.when(k % 4 == 2, _text("c", k % self._count("customer"))).alias("station_id"),
            (F.lit(0.4) + (k % 5).cast("double") / F.lit(10.0)).alias("confidence"),
            F.when(k % 6 == 0, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("retained_until"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        """One request per customer: by station, line, area, user only, or nothing."""
        c = self.customers
        k = F.col("c_custkey")
        none = F.lit(None).cast("string")
        placement = F.element_at(F.array(*[F.lit(p) for p in ("home", "search", "detail", "mypage")]), k.cast("int") % 4 + 1)
        hint = (k % 5 == 2) | (k % 20 == 0)
        return c.select(
            _text("r", "c_custkey").alias("request_id"),
            F.when(k % 5 == 0, _text("c", "c_custkey")).alias("target_station_id"),
            F.when(k % 3 == 0, F.lit(5)).alias("limit"),
            F.when((k % 5 == 3) | (k % 2 == 0), _text("u", k % 200)).alias("user_id"),
            placement.alias("placement"),
            F.lit(False).alias("debug"),
            none.alias("station_id"),
            F.when((k % 5 == 1) & (k % 2 == 0), stable_id("line", F.col("c_mktsegment"))).alias("line_id"),
            F.when((k % 5 == 1) & (k % 2 == 1), F.col("c_mktsegment")).alias("line_name"),
            none.alias("country"),
            none.alias("prefecture_code"),
            F.when(hint & (k % 3 != 1), F.col("r_name")).alias("prefecture_name"),
            F.when(hint & (k % 9 == 4), F.lpad(F.col("n_nationkey").cast("string"), 5, "0")).alias("city_code"),
            F.when(hint & (k % 3 != 0) & (k % 9 != 4), F.col("n_name")).alias("city_name"),
        )

    @cached_property
    def log_counts(self) -> DataFrame:
        """One scan of the log, for all snapshots."""
        from wayside.operators import snapshots

        return settle(snapshots.log_counts(self.user_events))

    @cached_property
    def popularity(self) -> DataFrame:
        from wayside.operators import snapshots

        return snapshots.popularity(self.schools, self.links, self.log_counts)

    @cached_property
    def area_affinity(self) -> DataFrame:
        from wayside.operators import snapshots

        return snapshots.area_affinity(self.schools, self.links, self.log_counts)

    @cached_property
    def user_affinity(self) -> DataFrame:
        from wayside.operators import snapshots

        return snapshots.user_affinity(self.log_counts)

    @cached_property
    def tables(self):
        from wayside.plans.recommend import Tables

        return Tables(
            schools=self.schools, stations=self.stations, lines=self.lines, areas=self.areas, links=self.links,
            line_adjacencies=self.line_adjacencies, area_adjacencies=self.area_adjacencies, events=self.events,
            user_events=self.user_events, profiles=self.profiles, popularity=self.popularity,
            area_affinity=self.area_affinity, user_affinity=self.user_affinity,
        )

    @cached_property
    def batch(self):
        from wayside.plans.recommend import Recommendation

        return Recommendation(self.requests, self.tables, as_of())


_SLUG = "trim(regexp_replace(lower({0}), '[^0-9a-z]+', '_', 'g'), '_')"


def _haversine(lat1, lon1, lat2, lon2, r="6371000.0e0"):
    """Central angle times radius, as SQL text."""
    h = (
        f"(pow(sin(({lat2}-{lat1})/2.0e0),2) + cos({lat1})*cos({lat2})*pow(sin(({lon2}-{lon1})/2.0e0),2))"
    )
    return f"({r} * 2.0e0 * atan2(sqrt({h}), sqrt(greatest(1.0e0-{h}, 0.0e0))))"


def sphere_sql(lat1, lon1, lat2, lon2):
    return _haversine(*(f"radians({c})" for c in (lat1, lon1, lat2, lon2)))


def ellipsoid_sql(lat1, lon1, lat2, lon2):
    f = "(1.0e0/298.257223563e0)"
    b1, b2 = (f"atan((1.0e0-{f})*tan(radians({c})))" for c in (lat1, lat2))
    sigma = _haversine(b1, f"radians({lon1})", b2, f"radians({lon2})", "1.0e0")
    p, q = f"(({b1}+{b2})/2.0e0)", f"(({b2}-{b1})/2.0e0)"
    x = f"(({sigma}-sin({sigma}))*pow(sin({p}),2)*pow(cos({q}),2)/pow(cos({sigma}/2.0e0),2))"
    y = f"(({sigma}+sin({sigma}))*pow(cos({p}),2)*pow(sin({q}),2)/pow(sin({sigma}/2.0e0),2))"
    return f"(CASE WHEN {sigma}=0 THEN 0.0e0 ELSE round(6378137.0e0*({sigma}-({f}/2.0e0)*({x}+{y})), 3) END)"


ORACLE_TABLES: dict[str, str] = {
    "m_nations": "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
    "m_areas": f"""SELECT 'area_' || {_SLUG.format("r_name || ':' || n_name")} AS area_id, 'JP' AS country_code,
            lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS prefecture_code, r_name AS prefecture_name,
            lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS city_code, n_name AS city_name, 'city' AS area_level
        FROM m_nations
        UNION ALL
        SELECT 'area_' || {_SLUG.format("r_name")}, 'JP', lpad(CAST(r_regionkey AS VARCHAR), 2, '0'), r_name, NULL, NULL, 'prefecture'
        FROM region""",
    "m_schools": """SELECT 's' || s_suppkey AS id, s_name AS name, n_name AS area,
            CASE WHEN s_suppkey % 11 <> 0 THEN r_name END AS prefecture_name,
            CASE s_suppkey % 3 WHEN 0 THEN 'junior_high' WHEN 1 THEN 'high' ELSE 'combined' END AS school_type,
            'g' || (s_suppkey % 17) AS group_id
        FROM supplier JOIN m_nations ON s_nationkey = n_nationkey""",
    "m_school_geo": """SELECT 's' || s_suppkey AS school_id,
            35.5e0 + CAST((s_suppkey * 3571) % 10007 AS DOUBLE) / 25000.0e0 AS latitude,
            139.5e0 + CAST((s_suppkey * 9241) % 10007 AS DOUBLE) / 25000.0e0 AS longitude
        FROM supplier""",
    "m_stations": f"""SELECT 'c' || c_custkey AS id, 'stn' || (c_custkey % 40) AS name, c_mktsegment AS line_name,
            CASE WHEN c_custkey % 7 <> 0 THEN 'line_' || {_SLUG.format("c_mktsegment")} END AS line_id,
            CASE WHEN c_custkey % 13 <> 0 THEN 'area_' || {_SLUG.format("r_name || ':' || n_name")} END AS area_id,
            35.5e0 + CAST((c_custkey * 7919) % 10007 AS DOUBLE) / 25000.0e0 AS latitude,
            139.5e0 + CAST((c_custkey * 5227) % 10007 AS DOUBLE) / 25000.0e0 AS longitude
        FROM customer JOIN m_nations ON c_nationkey = n_nationkey""",
    "m_lines": f"""SELECT DISTINCT 'line_' || {_SLUG.format("c_mktsegment")} AS line_id, c_mktsegment AS line_name,
            CAST(NULL AS VARCHAR) AS operator_name FROM customer""",
    "m_derived_links": f"""SELECT school_id, station_id, CAST(greatest(1, ceil(distance_meters / 80.0)) AS SMALLINT) AS walking_minutes,
            distance_meters, CAST(0 AS SMALLINT) AS hop_distance, line_name
        FROM (SELECT school_id, station_id, line_name, CAST(round_even(d, 0) AS INTEGER) AS distance_meters,
                row_number() OVER (PARTITION BY school_id ORDER BY d, station_id) AS rn
              FROM (SELECT g.school_id, s.id AS station_id, s.line_name,
                        {ellipsoid_sql("g.latitude", "g.longitude", "s.latitude", "s.longitude")} AS d
                    FROM m_school_geo g, m_stations s) WHERE d <= 2500) WHERE rn <= 3""",
    "m_links": """SELECT school_id, station_id, walking_minutes, distance_meters,
            CAST(distance_meters % 5 AS SMALLINT) AS hop_distance, line_name FROM m_derived_links""",
    "m_line_forward": """SELECT a.line_id AS from_line_id, min_by(b.line_id, b.line_name) AS to_line_id
        FROM m_lines a JOIN m_lines b ON b.line_name > a.line_name GROUP BY a.line_id""",
    "m_line_adjacencies": """SELECT from_line_id, to_line_id, 'interchange' AS adjacency_kind,
            CASE WHEN hops = 1 THEN 'c1' END AS interchange_station_id, hops AS station_hop_count, hops = 2 AS requires_transfer
        FROM (SELECT from_line_id, to_line_id, 1 AS hops FROM m_line_forward
              UNION ALL SELECT to_line_id, from_line_id, 2 FROM m_line_forward)""",
    "m_area_adjacencies": f"""SELECT 'area_' || {_SLUG.format("a.r_name || ':' || a.n_name")} AS from_area_id,
            'area_' || {_SLUG.format("b.r_name || ':' || b.n_name")} AS to_area_id, 'border' AS adjacency_kind,
            CASE WHEN b.n_nationkey % 3 <> 0 THEN CAST(abs(a.n_nationkey - b.n_nationkey) AS DOUBLE) * 1000.0e0 END AS distance_meters,
            'cluster' || a.n_regionkey AS area_cluster_id
        FROM m_nations a JOIN m_nations b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""",
    "m_events": """SELECT 'e' || p_partkey AS id,
            CASE WHEN p_partkey % 4 = 0 THEN 's7' ELSE 's' || (p_partkey % (SELECT count(*) FROM supplier)) END AS school_id,
            p_name AS title, lower(p_type) AS event_category, p_size % 5 = 0 AS is_open_day, p_size % 7 = 0 AS is_featured,
            CAST(p_size % 6 AS DOUBLE) / 10.0e0 AS priority_weight,
            CASE WHEN p_partkey % 9 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(p_partkey % 400 AS INTEGER)) END AS starts_at,
            CASE p_size % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['search'] WHEN 2 THEN ['home', 'detail'] ELSE ['search', 'mypage'] END AS placement_tags,
            '{"brand":"' || p_brand || '"}' AS details, p_partkey % 10 <> 3 AS is_active,
            CASE WHEN p_partkey % 5 = 0 THEN 'crawl' ELSE 'event_csv' END AS source_type,
            CASE WHEN p_partkey % 15 = 0 THEN NULL ELSE lower(p_type) END AS source_key,
            TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(p_partkey % 30 AS INTEGER)) AS updated_at
        FROM part""",
    "m_user_events": """SELECT event_id AS id, 'u' || user_id AS user_id,
            CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 3 = 0 THEN 's3'
                ELSE 's' || ((event_id * 7) % (SELECT count(*) FROM supplier)) END END AS school_id,
            CASE event_type WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'share' ELSE 'school_view' END
                WHEN 'click' THEN 'event_view' WHEN 'signup' THEN 'school_save'
                WHEN 'purchase' THEN 'apply_click' ELSE 'search_execute' END AS event_type,
            CASE WHEN event_type = 'click' THEN 'e' || (event_id % (SELECT count(*) FROM part)) END AS event_id,
            CASE WHEN event_type = 'error' THEN 'c' || (event_id % (SELECT count(*) FROM customer)) END AS target_station_id,
            ts AS occurred_at, props AS payload
        FROM events""",
    "m_profiles": """SELECT 'u' || user_id AS user_id,
            CASE WHEN user_id % 4 = 0 THEN (SELECT list_sort(list(area_id)) FROM m_areas WHERE area_level = 'city')[user_id % 25 + 1] END AS area_id,
            CASE WHEN user_id % 4 = 1 THEN (SELECT list_sort(list(line_id)) FROM m_lines)[user_id % 5 + 1] END AS line_id,
            CASE WHEN user_id % 4 = 2 THEN 'c' || (user_id % (SELECT count(*) FROM customer)) END AS station_id,
            0.4e0 + CAST(user_id % 5 AS DOUBLE) / 10.0e0 AS confidence,
            CASE WHEN user_id % 6 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS retained_until
        FROM (SELECT DISTINCT user_id FROM events)""",
    "m_requests": f"""SELECT 'r' || c_custkey AS request_id, CASE WHEN c_custkey % 5 = 0 THEN 'c' || c_custkey END AS target_station_id,
            CASE WHEN c_custkey % 3 = 0 THEN 5 END AS "limit",
            CASE WHEN c_custkey % 5 = 3 OR c_custkey % 2 = 0 THEN 'u' || (c_custkey % 200) END AS user_id,
            CASE c_custkey % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'search' WHEN 2 THEN 'detail' ELSE 'mypage' END AS placement,
            false AS debug, CAST(NULL AS VARCHAR) AS station_id,
            CASE WHEN c_custkey % 5 = 1 AND c_custkey % 2 = 0 THEN 'line_' || {_SLUG.format("c_mktsegment")} END AS line_id,
            CASE WHEN c_custkey % 5 = 1 AND c_custkey % 2 = 1 THEN c_mktsegment END AS line_name,
            CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS prefecture_code,
            CASE WHEN hint AND c_custkey % 3 <> 1 THEN r_name END AS prefecture_name,
            CASE WHEN hint AND c_custkey % 9 = 4 THEN lpad(CAST(n_nationkey AS VARCHAR), 5, '0') END AS city_code,
            CASE WHEN hint AND c_custkey % 3 <> 0 AND c_custkey % 9 <> 4 THEN n_name END AS city_name
        FROM (SELECT *, c_custkey % 5 = 2 OR c_custkey % 20 = 0 AS hint FROM customer) JOIN m_nations ON c_nationkey = n_nationkey""",
}


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the CTEs that ``body`` names, and those they name, in front of it."""
    tables = {**ORACLE_TABLES, **(extra or {})}
    order: list[str] = []

    def need(sql: str) -> None:
        for name in re.findall(r"\b[mx]_\w+\b", sql):
            if name in tables and name not in order:
                need(tables[name])
                order.append(name)

    need(body)
    if not order:
        return body
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({tables[name]})" for name in order)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes},\n{body.lstrip()[5:]}"
    return f"WITH {ctes}\n{body}"

"""Distance joins, nearest-k and the school-station links built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayside.functions.geo import CELL_SLACK, WGS84_A, add_direction, add_distance, axes, direction_columns, ellipsoid_m, sphere_m
from wayside.operators.topn import first_per_key
from wayside.session import settle, spread

EARTH_SPAN_M = 41_000_000.0


def with_distance(pairs: DataFrame, mode: str = "ellipsoid") -> DataFrame:
    """Add ``distance_m`` to rows that carry both ends of a pair."""
    return add_distance(pairs, mode, "from_latitude", "from_longitude", "to_latitude", "to_longitude", "distance_m")


CUBE = ["_x", "_y", "_z"]


def _cubes(df: DataFrame, lat: str, lon: str, size: float, around: bool = False) -> DataFrame:
    """Add the grid cube of each row; with ``around`` a row is repeated for its cube and the 26 that touch it."""
    out = df.withColumns({f"_{n}": F.floor(a / size).cast("int") for n, a in zip("xyz", axes(F.col(lat), F.col(lon)), strict=True)})
    if around:
        out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(26))))
        out = out.withColumns(
            {
                "_x": F.col("_x") + (F.col("_o") % 3) - 1,
                "_y": F.col("_y") + (F.floor(F.col("_o") / 3) % 3).cast("int") - 1,
                "_z": F.col("_z") + F.floor(F.col("_o") / 9).cast("int") - 1,
            }
        ).drop("_o")
    return out


def within_join(left: DataFrame, right: DataFrame, radius_m: float, mode: str = "ellipsoid") -> DataFrame:
    """All pairs within ``radius_m``; both sides need ``latitude`` and ``longitude``, which come out as ``from_*`` / ``to_*``.

    Rows at one coordinate share one search: distances are worked out once per
    pair of spots, and rows meet by the spots that are found.
    """
    spot = ["latitude", "longitude"]
    near = within_spots(spread(left.select(*spot).distinct(), *spot), right.select(*spot).distinct(), radius_m, mode)
    l = left.withColumnsRenamed({n: f"from_{n}" for n in spot})
    r = right.withColumnsRenamed({n: f"to_{n}" for n in spot})
    found, to = l.join(near, [f"from_{n}" for n in spot]), [f"to_{n}" for n in spot]
    return spread(found, *to).join(r, to).select(*l.columns, *r.columns, "distance_m")


def within_spots(left: DataFrame, right: DataFrame, radius_m: float, mode: str = "ellipsoid") -> DataFrame:
    """All pairs within ``radius_m`` of two tables without hot coordinates, joined on grid cubes.

    Both sides need ``latitude`` and ``longitude``; they come out as
    ``from_*`` / ``to_*``.  The left side is repeated for its 27 cubes, the
    right side is not, so the plan is one equi-join with a residual.
    """
    size = radius_m * CELL_SLACK
    l = left.withColumnsRenamed({"latitude": "from_latitude", "longitude": "from_longitude"})
    r = right.withColumnsRenamed({"latitude": "to_latitude", "longitude": "to_longitude"})
    l = add_direction(l, "from_latitude", "from_longitude", "_a")
    r = add_direction(r, "to_latitude", "to_longitude", "_b")
    pairs = _cubes(l, "from_latitude", "from_longitude", size, around=True).join(
        _cubes(r, "to_latitude", "to_longitude", size), CUBE
    )
    metres = ellipsoid_m("_a", "_b") if mode == "ellipsoid" else sphere_m("from_latitude", "from_longitude", "to_latitude", "to_longitude")
    near = pairs.withColumn("distance_m", metres).where(F.col("distance_m") <= radius_m)
    return near.drop(*CUBE, *direction_columns("_a"), *direction_columns("_b"))


def _levels(start_m: float, stop_m: float) -> list[float]:
    sizes = [stop_m]
    while sizes[0] / 4.0 >= start_m:
        sizes.insert(0, sizes[0] / 4.0)
    return sizes


def _blocks(points: DataFrame, spots: DataFrame, levels: list[int]) -> DataFrame:
    """Points with the spots in the 27 cubes around them, at each point's ``_level``; spots are listed at the given levels only."""
    cube = [F.expr(f"shiftright(_{c}, 2 * _level)") for c in "xyz"]
    around = [F.col("_o") % 3, F.floor(F.col("_o") / 3) % 3, F.floor(F.col("_o") / 9)]
    left = points.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(26)))).withColumns({f"_c{c}": (at + o - 1).cast("int") for c, at, o in zip("xyz", cube, around, strict=True)})
    right = spots.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in levels]))).withColumns({f"_c{c}": at for c, at in zip("xyz", cube, strict=True)})
    on = ["_level", "_cx", "_cy", "_cz"]
    return left.drop("_o", "_x", "_y", "_z").join(right.drop("_x", "_y", "_z"), on).drop(*on)


def nearest(
    points: DataFrame,
    places: DataFrame,
    k: int,
    tie_break: tuple[str, ...],
    radius_m: float | None = None,
    start_m: float = 150.0,
) -> DataFrame:
    """The ``k`` nearest places of every distinct point, exactly.

    ``points`` has distinct ``latitude``/``longitude``; ``places`` has the same
    names plus payload columns; ``tie_break`` must order them fully.  Result:
    ``from_*``, ``to_*``, the payload, ``distance_m`` and ``rank``.

    Of the places at one coordinate only the first ``k`` by the tie break can
    win, so a hot coordinate is cut before it meets any point.

    Cubes grow by a factor of four.  Places are counted in the smallest cubes
    and those counts added up to the larger ones; the counts around a point are
    looked up for each occupied cube once.  The smallest block of 27 cubes with
    ``k`` places gives a first ring, whose k-th distance bounds the search: the
    second ring is the block that reaches that far, and only spots within the
    bound are ranked and get their payload.  Spots are listed at the sizes that
    points have chosen, so dense towns are read with small cubes and only remote
    points look far.
    """
    c = F.col
    sizes = _levels(start_m, radius_m * CELL_SLACK if radius_m else EARTH_SPAN_M)
    last = len(sizes) - 1
    levels = F.array(*[F.lit(i) for i in range(len(sizes))])
    places = first_per_key(places, ["latitude", "longitude"], list(tie_break), k)

    def with_cube(df: DataFrame) -> DataFrame:
        return df.withColumns({f"_{n}": F.floor(a / sizes[0]).cast("int") for n, a in zip("xyz", axes(c("latitude"), c("longitude")), strict=True)})

    cube = ["_level", "_cx", "_cy", "_cz"]
    at_levels = {f"_c{n}": F.expr(f"shiftright(_{n}, 2 * _level)") for n in "xyz"}
    spots = settle(with_cube(places.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("_n"))))
    filled = spots.groupBy("_x", "_y", "_z").agg(F.sum("_n").alias("_n")).withColumn("_level", F.explode(levels)).withColumns(at_levels).groupBy(*cube).agg(F.sum("_n").alias("_n"))
    located = with_cube(points.select("latitude", "longitude"))
    asked = located.select("_x", "_y", "_z").distinct().withColumn("_level", F.explode(levels)).withColumns(at_levels)
    own = {f"_o{n}": c(f"_c{n}") for n in "xyz"}
    ring = asked.select(*cube).distinct().withColumns(own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(26)))).withColumns(
        {"_cx": (c("_cx") + c("_o") % 3 - 1).cast("int"), "_cy": (c("_cy") + F.floor(c("_o") / 3) % 3 - 1).cast("int"), "_cz": (c("_cz") + F.floor(c("_o") / 9) - 1).cast("int")}
    )
    full = ring.join(filled, cube).groupBy("_level", *own).agg(F.sum("_n").alias("_n")).where(c("_n") >= k).withColumnsRenamed({f"_o{n}": f"_c{n}" for n in "xyz"})
    first = asked.join(full.drop("_n"), cube, "left_semi").groupBy("_x", "_y", "_z").agg(F.min("_level").alias("_full"))
    chosen = settle(located.join(first, ["_x", "_y", "_z"], "left"))

    to = add_direction(spots.withColumnsRenamed({"latitude": "to_latitude", "longitude": "to_longitude"}), "to_latitude", "to_longitude", "_b")
    point = ["from_latitude", "from_longitude"]
    left = add_direction(chosen.withColumnsRenamed({"latitude": "from_latitude", "longitude": "from_longitude"}), "from_latitude", "from_longitude", "_a")
    found = {r["_full"] for r in chosen.select("_full").distinct().collect()}  # a row per cube size
    used = sorted(found - {None})
    reach = F.lit(None).cast("double")
    if used:
        inner = _blocks(left.where("_full IS NOT NULL").withColumn("_level", c("_full")), to, used).select(*point, ellipsoid_m("_a", "_b").alias("_d"), "_n")
        so_far = F.sum("_n").over(W.partitionBy(*point).orderBy("_d").rangeBetween(W.unboundedPreceding, W.currentRow))
        bounds = inner.withColumn("_n", so_far).where(c("_n") >= k).groupBy(*point).agg(F.min("_d").alias("_bound"))
        left, reach = left.join(bounds, point, "left"), c("_bound")
    size = F.get(F.array(*[F.lit(float(x)) for x in sizes]), c("_full"))
    second = F.when(reach * CELL_SLACK <= size, c("_full")).otherwise(F.least(c("_full") + 1, F.lit(last)))
    left = left.withColumns({"_reach": reach, "_level": F.coalesce(second, F.lit(last))}).drop("_full", "_bound")
    chord2 = sum((c(f"_a{n}") - c(f"_b{n}")) * (c(f"_a{n}") - c(f"_b{n}")) for n in "xyz")
    within = c("_reach").isNull() | (chord2 * WGS84_A**2 <= (c("_reach") * CELL_SLACK) * (c("_reach") * CELL_SLACK))
    sizes_used = sorted({min(i + j, last) for i in used for j in (0, 1)} | ({last} if None in found or not used else set()))
    pairs = _blocks(left, to, sizes_used).where(within).withColumn("distance_m", ellipsoid_m("_a", "_b"))
    pairs = pairs.where(c("_reach").isNull() | (c("distance_m") <= c("_reach")))
    pairs = (pairs.where(c("distance_m") <= radius_m) if radius_m else pairs).select(*point, "to_latitude", "to_longitude", "distance_m")
    named = places.withColumnsRenamed({"latitude": "to_latitude", "longitude": "to_longitude"})
    order = W.partitionBy(*point).orderBy("distance_m", *tie_break)
    return pairs.join(named, ["to_latitude", "to_longitude"]).withColumn("rank", F.row_number().over(order)).where(c("rank") <= k)


def derive_links(schools_geo: DataFrame, stations: DataFrame, radius_m: float = 2500.0, k: int = 3) -> DataFrame:
    """Link every school to its ``k`` nearest stations within the radius.

    Schools at one spot share one search, so a hot coordinate is searched once.
    """
    places = stations.select("station_id", "line_name", "latitude", "longitude")
    points = schools_geo.select("latitude", "longitude").distinct()
    found = nearest(points, places, k, ("station_id",), radius_m)
    metres = F.rint("distance_m").cast("int")
    linked = schools_geo.select(
        "school_id", F.col("latitude").alias("from_latitude"), F.col("longitude").alias("from_longitude")
    ).join(found, ["from_latitude", "from_longitude"])
    return linked.select(
        "school_id",
        "station_id",
        F.greatest(F.lit(1), F.ceil(metres / F.lit(80.0))).cast("short").alias("walking_minutes"),
        metres.alias("distance_meters"),
        F.lit(0).cast("short").alias("hop_distance"),
        "line_name",
    )


def refresh_links(current: DataFrame, derived: DataFrame, schools_geo: DataFrame) -> DataFrame:
    """Replace the links of located schools; links of other schools stay."""
    kept = current.join(schools_geo.select("school_id").distinct(), "school_id", "left_anti")
    return kept.unionByName(derived)


def unlinked_schools(schools_geo: DataFrame, links: DataFrame) -> DataFrame:
    return schools_geo.join(links.select("school_id").distinct(), "school_id", "left_anti")

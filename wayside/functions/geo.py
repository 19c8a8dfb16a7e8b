"""Distances and grid cells as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPHERE_RADIUS_M = 6_371_000.0
WGS84_A = 6_378_137.0
WGS84_F = 1.0 / 298.257223563


def _central_angle(phi1: Column, phi2: Column, dlam: Column) -> Column:
    half_phi = F.sin((phi2 - phi1) / 2.0)
    half_lam = F.sin(dlam / 2.0)
    a = half_phi * half_phi + F.cos(phi1) * F.cos(phi2) * (half_lam * half_lam)
    return 2.0 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1.0 - a, F.lit(0.0))))


def sphere_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres on a sphere; the ranking distance."""
    return SPHERE_RADIUS_M * _central_angle(F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1))


def add_direction(df: DataFrame, lat: str, lon: str, prefix: str) -> DataFrame:
    """Add the unit vector of a place on the auxiliary sphere of WGS84.

    It depends on one place only, so pairs pay no trigonometry for it.
    """
    beta, lam = F.col(f"{prefix}b"), F.radians(lon)
    out = df.withColumn(f"{prefix}b", F.atan((1.0 - WGS84_F) * F.tan(F.radians(lat))))
    out = out.withColumns({f"{prefix}z": F.sin(beta), f"{prefix}c": F.cos(beta)})
    xy = {f"{prefix}x": F.col(f"{prefix}c") * F.cos(lam), f"{prefix}y": F.col(f"{prefix}c") * F.sin(lam)}
    return out.withColumns(xy).drop(f"{prefix}b")


def direction_columns(prefix: str) -> list[str]:
    return [f"{prefix}{c}" for c in "zcxy"]


def ellipsoid_m(a: str, b: str) -> Column:
    """Geodesic metres on WGS84 by Lambert's closed form, to the millimetre.

    ``a`` and ``b`` are the prefixes of two directions.  The form is accurate
    to a few millimetres at link distances, so the value is rounded there.
    """
    c = F.col
    chord2 = sum(((c(a + k) - c(b + k)) * (c(a + k) - c(b + k)) for k in "yz"), (c(a + "x") - c(b + "x")) * (c(a + "x") - c(b + "x")))
    half = F.asin(F.least(F.sqrt(chord2) / 2.0, F.lit(1.0)))
    sin2 = chord2 / 4.0
    sin_sigma = F.sin(2.0 * half)
    prod_c, prod_s = c(a + "c") * c(b + "c"), c(a + "z") * c(b + "z")
    cos_sum, cos_diff = prod_c - prod_s, prod_c + prod_s
    x = (2.0 * half - sin_sigma) * ((1.0 - cos_sum) / 2.0) * ((1.0 + cos_diff) / 2.0) / (1.0 - sin2)
    y = (2.0 * half + sin_sigma) * ((1.0 + cos_sum) / 2.0) * ((1.0 - cos_diff) / 2.0) / sin2
    metres = F.round(WGS84_A * (2.0 * half - (WGS84_F / 2.0) * (x + y)), 3)
    return F.when(chord2 == 0.0, F.lit(0.0)).otherwise(metres)


def add_distance(df: DataFrame, mode: str, lat1: str, lon1: str, lat2: str, lon2: str, out: str) -> DataFrame:
    if mode == "sphere":
        return df.withColumn(out, sphere_m(lat1, lon1, lat2, lon2))
    if mode == "ellipsoid":
        both = add_direction(add_direction(df, lat1, lon1, "_a"), lat2, lon2, "_b")
        return both.withColumn(out, ellipsoid_m("_a", "_b")).drop(*direction_columns("_a"), *direction_columns("_b"))
    raise ValueError(f"unknown distance mode: {mode}")


def axes(lat, lon) -> tuple[Column, Column, Column]:
    """Geocentric x, y, z in metres on the mean sphere.

    Cutting this space into cubes gives the search grid.  A chord is never
    longer than its arc, so two points within a cube's side lie in the same
    cube or in touching ones: no special case at the poles or the date line.
    """
    phi, lam = F.radians(lat), F.radians(lon)
    return (
        SPHERE_RADIUS_M * F.cos(phi) * F.cos(lam),
        SPHERE_RADIUS_M * F.cos(phi) * F.sin(lam),
        SPHERE_RADIUS_M * F.sin(phi),
    )


# A geodesic can exceed the arc on the mean sphere by a little over half a percent.
CELL_SLACK = 1.01

"""Shadow of a lightning rod on a sensor, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunledger.functions.solar import sun_position
from sunledger.schema import micros

#: The sun's disk in degrees, and the share of it that counts as a shadow.
SUN_DIAMETER, THRESHOLD = 0.533, 0.01


@dataclass(frozen=True)
class Geometry:
    """Lengths in feet, boom azimuth in degrees from north."""

    tower_ht: float = 8.0
    rod_len: float = 1.5
    boom_len: float = 4.0
    boom_azimuth: float = 90.0
    sensor_ht: float | None = None  # None: at the top of the tower
    rod_diameter: float = 0.5 / 12
    sun_diameter: float = SUN_DIAMETER


def grazing_elevation(rod_len: float, boom_len: float) -> float:
    """Elevation in degrees up to which the rod's top can shade the sensor."""
    return math.degrees(math.atan2(rod_len, boom_len))


def sun_vector(elevation: Column, azimuth: Column) -> tuple[Column, Column, Column]:
    """East, north, up."""
    e, a = F.radians(elevation), F.radians(azimuth)
    return F.cos(e) * F.sin(a), F.cos(e) * F.cos(a), F.sin(e)


def angular_miss(df: DataFrame, sun: tuple[Column, Column, Column], offset: tuple[float, float, float], along: tuple[float, float, float]) -> DataFrame:
    """df with miss (radians between the sun and the nearest point of the segment) and distance (to that point).

    The segment is offset + t * along, 0 <= t <= 1. Where the cosine is stationary, and both ends, are tried;
    the first of the largest wins.
    """
    a = sum((sun[i] * offset[i] for i in range(1, 3)), sun[0] * offset[0])
    b = sum((sun[i] * along[i] for i in range(1, 3)), sun[0] * along[0])
    cc, e, g = (float(sum(x * y for x, y in zip(p, q, strict=True))) for p, q in ((offset, offset), (offset, along), (along, along)))
    df = df.withColumns({"__a": a, "__b": b})
    a, b = F.col("__a"), F.col("__b")
    below = b * e - a * g
    still = F.when(F.abs(below) > 1e-12, (a * e - b * cc) / below).otherwise(0.0)
    df = df.withColumn("__t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), still)))
    reach = lambda t: F.sqrt(F.greatest(F.lit(cc) + 2 * e * t + g * t * t, F.lit(1e-24)))
    cosine = lambda t: (a + b * t) / reach(t)
    df = df.withColumns({"__c0": cosine(F.col("__t")), "__c1": cosine(F.lit(0.0)), "__c2": cosine(F.lit(1.0))})
    t = F.when((F.col("__c1") <= F.col("__c0")) & (F.col("__c2") <= F.col("__c0")), F.col("__t")).when(F.col("__c2") <= F.col("__c1"), F.lit(0.0)).otherwise(F.lit(1.0))
    best = F.greatest("__c0", "__c1", "__c2")
    df = df.withColumns({"miss": F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), best))), "distance": reach(t)})
    return df.drop("__a", "__b", "__t", "__c0", "__c1", "__c2")


def disk_blocked(miss: Column, half_width: Column, radius: float) -> Column:
    """Share of a disk that a strip hides whose middle passes at `miss`."""
    r = F.lit(radius)
    cut = lambda x: F.greatest(-r, F.least(r, x))
    area = lambda x: x * F.sqrt(F.greatest(r * r - x * x, F.lit(0.0))) + r * r * F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / r)))
    share = (area(cut(miss + half_width)) - area(cut(miss - half_width))) / F.lit(math.pi * radius * radius)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def shade(df: DataFrame, us: Column, latitude: float, longitude: float, geometry: Geometry | None = None) -> DataFrame:
    """df with elevation, azimuth, miss and rod_width (degrees), reach (feet) and blocked (share of the disk)."""
    g = geometry or Geometry()
    if min(g.rod_len, g.boom_len, g.rod_diameter) <= 0:
        raise ValueError("rod, boom and rod diameter must be positive")
    beta = math.radians(g.boom_azimuth)
    offset = (-g.boom_len * math.sin(beta), -g.boom_len * math.cos(beta), 0.0 if g.sensor_ht is None else g.tower_ht - g.sensor_ht)
    df = sun_position(df, us, latitude, longitude, True, "__s_")
    elevation = F.col("__s_elevation")
    df = angular_miss(df, sun_vector(elevation, F.col("__s_azimuth")), offset, (0.0, 0.0, g.rod_len))
    half = F.atan(0.5 * g.rod_diameter / F.col("distance"))
    blocked = F.when(elevation > 0, disk_blocked(F.col("miss"), half, math.radians(g.sun_diameter / 2))).otherwise(0.0)
    reach = F.when(elevation > 0, F.lit(float(g.rod_len)) / F.tan(F.radians(elevation))).otherwise(F.lit(float("inf")))
    out = df.withColumns({"blocked": blocked, "rod_width": F.degrees(2 * half), "reach": reach}).withColumn("miss", F.degrees("miss"))
    return out.withColumnsRenamed({"__s_elevation": "elevation", "__s_azimuth": "azimuth"}).drop("__s_zenith", "distance")


def local_days(spark: SparkSession, start: str, end: str, tz: str, step_seconds: int) -> DataFrame:
    """series_id (local date), pos, ts and us of a grid over whole local days, DST included: from midnight up to the next one."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))
    return day_grid(days, tz, step_seconds)


def day_grid(days: DataFrame, tz: str, step_seconds: int) -> DataFrame:
    """The same for the local dates of days (column date, distinct): each date's grid is made where its row lies."""
    at = lambda d: F.to_utc_timestamp(d.cast("timestamp_ntz").cast("timestamp"), tz)
    step = F.expr(f"INTERVAL {int(step_seconds)} SECOND")
    grid = days.select("date", F.posexplode(F.sequence(at(F.col("date")), at(F.date_add("date", 1)) - step, step)).alias("pos", "ts"))
    return grid.select(F.col("date").cast("string").alias("series_id"), F.col("pos").cast("bigint").alias("pos"), F.col("ts").cast("timestamp_ntz").alias("ts"), micros(F.col("ts")).alias("us"))


def shadow_track(spark: SparkSession, date: str, latitude: float, longitude: float, tz: str, step_seconds: int = 10, geometry: Geometry | None = None) -> DataFrame:
    return shade(local_days(spark, date, date, tz, step_seconds), F.col("us"), latitude, longitude, geometry)


def shadow_season(spark: SparkSession, start: str, end: str, latitude: float, longitude: float, tz: str, step_seconds: int = 60, threshold: float = THRESHOLD, geometry: Geometry | None = None) -> DataFrame:
    """A row for each local date: peak, at (UTC), elevation and azimuth there, minutes over the threshold."""
    return season_of(shade(local_days(spark, start, end, tz, step_seconds), F.col("us"), latitude, longitude, geometry), step_seconds, threshold)


def season_of(track: DataFrame, step_seconds: int, threshold: float = THRESHOLD) -> DataFrame:
    """The same of a shaded track whose series_id is the local date."""
    best = F.struct("blocked", -F.col("us"))
    return track.groupBy(F.to_date("series_id").alias("date")).agg(
        F.max("blocked").alias("peak"), F.max_by("ts", best).alias("at"), F.max_by("elevation", best).alias("elevation"), F.max_by("azimuth", best).alias("azimuth"), (F.count_if(F.col("blocked") > threshold) * F.lit(step_seconds / 60.0)).alias("minutes")
    )

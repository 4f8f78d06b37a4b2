"""Recorded sun angles against computed ones: angle, timezone and clock findings, per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunledger.functions.solar import format_offset, format_skew, nearest_timezone, short_way, sun_position
from sunledger.operators.offset import infer_utc_offset

from sunledger.schema import ALL_SIGNALS, as_findings, clean, no_findings
from sunledger.stored import stored

CLOCK_TOLERANCE_US = 120_000_000


def _coordinate(frame: DataFrame, value: float | str, limit: float) -> DataFrame:
    """series_id and the one usable value, NULL where there is none."""
    if not isinstance(value, str):
        good = float(value) if abs(float(value)) <= limit else None
        return frame.groupBy("series_id").agg(F.lit(good).cast("double").alias("value"))
    x = clean(F.col(f"`{value}`").cast("string").try_cast("double"))
    one = frame.groupBy("series_id").agg(F.count_distinct(x).alias("kinds"), F.max(x).alias("value"))
    return one.select("series_id", F.when((F.col("kinds") == 1) & (F.abs("value") <= limit), F.col("value")).alias("value"))


def check_solar_angles(frame: DataFrame, angles) -> DataFrame:
    """One `solar` finding for each angle off by more than the tolerance; else `utc` and `clock` findings of an inferred offset.

    Coordinates must be constants, or columns with one value in each series; every series has its own position and offset.
    """
    named = angles.angles()
    if not named or any(c not in frame.columns for c in angles.columns()):
        return no_findings(frame)
    place = _coordinate(frame, angles.latitude, 90).withColumnRenamed("value", "lat").join(_coordinate(frame, angles.longitude, 180).withColumnRenamed("value", "lon"), "series_id")
    lost = as_findings(place.filter("lat IS NULL OR lon IS NULL").withColumns({"check": F.lit("solar"), "signal": F.lit(ALL_SIGNALS), "detail": F.lit("no usable site position"), "n_samples": F.lit(0)}))
    place = place.filter("lat IS NOT NULL AND lon IS NOT NULL")
    value = {k: clean(F.col(f"`{c}`").cast("double")) for k, c in named.items()}
    # own names only: the frame may have columns of these
    rows = frame.select("series_id", "pos", "ts", "us", *[v.alias(f"r_{k}") for k, v in value.items()]).join(place, "series_id")
    none = None
    if angles.utc_offset_us is not None:
        rows = rows.withColumn("offset_us", F.lit(angles.utc_offset_us).cast("bigint"))
    else:
        elevation = F.col("r_elevation") if "elevation" in named else (90.0 - F.col("r_zenith") if "zenith" in named else F.lit(None).cast("double"))
        source = rows.withColumns({"elevation": elevation, **({"azimuth": F.col("r_azimuth")} if "azimuth" in named else {})})
        offsets = stored(infer_utc_offset(source, F.col("lat"), F.col("lon"), "azimuth" in named, angles.refract), "utc-offsets")
        none = as_findings(place.join(offsets, "series_id", "left_anti").withColumns({"check": F.lit("solar"), "signal": F.lit(ALL_SIGNALS), "detail": F.lit("no UTC offset can be inferred"), "n_samples": F.lit(0)}))
        rows = rows.join(offsets, "series_id")
    rows = sun_position(rows, F.col("us") - F.col("offset_us"), F.col("lat"), F.col("lon"), angles.refract, "c_")

    def miss(k: str) -> Column:
        gap = F.col(f"c_{k}") - F.col(f"r_{k}")
        return F.abs(short_way(gap)) if k == "azimuth" else F.abs(gap)

    one = [F.struct(F.lit(k).alias("angle"), F.lit(c).alias("signal"), F.col(f"r_{k}").alias("value"), miss(k).alias("miss")) for k, c in named.items()]
    off = rows.select("series_id", "pos", "ts", "us", "offset_us", F.inline(F.array(*one))).filter(F.col("miss") > angles.tolerance)
    worst = F.struct(F.col("miss"), -F.col("pos"))
    found = off.groupBy("series_id", "angle", "signal").agg(F.max_by("value", worst).alias("value_num"), F.min_by("ts", "pos").alias("start_ts"), F.max_by("ts", "pos").alias("end_ts"), (F.max_by("us", "pos") - F.min_by("us", "pos")).alias("duration_us"), F.count("*").alias("n_samples"), F.max("miss").alias("most"), F.first("offset_us").alias("offset_us"))
    detail = F.concat(F.format_string("off computed %s by up to %.3f deg", "angle", "most"), F.lit(f" (tolerance {angles.tolerance}) at the best-fit "), format_offset(F.col("offset_us")))
    found = found.withColumns({"check": F.lit("solar"), "detail": detail})
    out = lost.unionByName(as_findings(found))
    if none is not None:
        out = out.unionByName(none)
    # stamps and clock are judged only where all angles agree
    whole = rows.groupBy("series_id").agg(F.first("offset_us").alias("offset_us"), F.min_by("ts", "pos").alias("start_ts"), F.max_by("ts", "pos").alias("end_ts"), (F.max_by("us", "pos") - F.min_by("us", "pos")).alias("duration_us"), F.count("*").alias("n_samples"))
    fine = whole.join(off.select("series_id").distinct(), "series_id", "left_anti").withColumn("zone", nearest_timezone(F.col("offset_us"))).withColumn("skew", F.col("offset_us") - F.col("zone"))
    fine = fine.withColumns({"signal": F.lit(ALL_SIGNALS), "astray": F.abs("skew") > CLOCK_TOLERANCE_US, "at": format_offset(F.col("offset_us")), "near": format_offset(F.col("zone")), "by": format_skew(F.col("skew"))})
    told = F.when(F.col("astray"), F.concat(F.lit("stamps are "), F.col("at"), F.lit(", not UTC"))).otherwise(F.concat(F.lit("stamps are "), F.col("near"), F.lit(", not UTC"), F.when(F.col("skew") != 0, F.concat(F.lit(" (clock "), F.col("by"), F.lit(")"))).otherwise("")))
    utc = fine.filter("offset_us <> 0").withColumns({"check": F.lit("utc"), "detail": told, "value_num": F.when(F.col("astray"), F.col("offset_us")).otherwise(F.col("zone")) / 1e6})
    wrong = F.concat(F.col("at"), F.lit(" is no timezone ("), F.col("near"), F.lit(" is nearest, "), F.col("by"), F.lit(" out); clock or position is wrong"))
    clock = fine.filter("astray").withColumns({"check": F.lit("clock"), "detail": wrong, "value_num": F.col("offset_us") / 1e6})
    return out.unionByName(as_findings(utc)).unionByName(as_findings(clock))

"""The UTC offset that a record's stamps were written at, from recorded sun angles, per series.

Staged aggregates over about SAMPLE to 2 * SAMPLE rows of each series, picked by hash of their place:
an estimate from hour angles (three rounds of a median), whole-day aliases, and a search around
each, by COARSE steps and then by second around the best. One row per series and stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunledger.functions.solar import DAY_US, deviation, ecliptic, hour_angle, refraction, sun_position
from sunledger.stored import stored

HOUR = 3_600_000_000
LEAST, MOST, SPAN = -12 * HOUR, 14 * HOUR, 300_000_000
SAMPLE, COARSE = 240, 30_000_000


def _estimates(rows: DataFrame, refract: bool, sign: Column) -> DataFrame:
    """series_id, side, estimate in microseconds. rows: series_id, side, us, elevation, azimuth, at_lat, at_lon."""
    true = F.col("elevation") - refraction(F.col("elevation")) if refract else F.col("elevation")
    source = rows.select("series_id", "side", "us", "at_lat", "at_lon", true.alias("e"), sign.alias("sign"))
    offsets = None
    for _ in range(3):
        now = source.withColumn("offset", F.lit(0.0)) if offsets is None else source.join(offsets, ["series_id", "side"])
        at = (F.col("us") - F.col("offset")).cast("bigint")
        now = ecliptic(now, at, "x_")
        dec, phi = F.col("x_declination"), F.radians("at_lat")
        share = (F.sin(F.radians("e")) - F.sin(phi) * F.sin(dec)) / (F.cos(phi) * F.cos(dec))
        recorded = F.when(F.abs(share) <= 1, F.acos(share) * F.col("sign"))
        delta = F.degrees(hour_angle(at, F.col("x_eot"), F.col("at_lon")) - recorded) / 15.0
        delta = F.pmod(delta + 12.0, F.lit(24.0)) - 12.0
        offsets = now.groupBy("series_id", "side").agg((F.first("offset") + F.median(delta) * HOUR).alias("offset"))  # NULL where nothing can be inverted
    return offsets.filter("offset IS NOT NULL").select("series_id", "side", (F.rint(F.col("offset") / 1e6) * 1_000_000).cast("bigint").alias("estimate"))


def infer_utc_offset(rows: DataFrame, latitude: float | Column, longitude: float | Column, has_azimuth: bool = True, refract: bool = True) -> DataFrame:
    """series_id, offset_us of each series in rows (series_id, pos, us, elevation[, azimuth]).

    latitude and longitude: constants, or columns of rows. No row for a series without a finite
    elevation. With elevations alone, morning and afternoon are both tried.
    """
    azimuth = F.col("azimuth").cast("double") if has_azimuth else F.lit(None).cast("double")
    place = [(x if isinstance(x, Column) else F.lit(float(x))).alias(n) for x, n in ((latitude, "at_lat"), (longitude, "at_lon"))]
    usable = rows.select("series_id", "pos", "us", F.col("elevation").cast("double").alias("elevation"), F.when(~F.isnan(azimuth), azimuth).alias("azimuth"), *place).filter(F.col("elevation").isNotNull() & ~F.isnan("elevation"))
    sizes = usable.groupBy("series_id").agg(F.count("*").alias("n"))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLE))
    sample = stored(usable.join(sizes, "series_id").filter(F.pmod(F.xxhash64("pos"), stride) == 0).drop("n", "pos"), "angle-sample")
    if has_azimuth:
        sided, sign = sample.withColumn("side", F.lit(0)), F.when(F.col("azimuth") > 180, 1.0).when(F.col("azimuth").isNotNull(), -1.0)
    else:
        sided, sign = sample.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))), F.col("side").cast("double")
    found = stored(_estimates(sided, refract, sign), "offset-estimates")

    def best(candidates: DataFrame) -> DataFrame:
        both = sun_position(candidates.join(sample, "series_id"), F.col("us") - F.col("candidate"), F.col("at_lat"), F.col("at_lon"), refract, "c_")
        miss = deviation(F.col("c_elevation") - F.col("elevation"), F.col("c_azimuth") - F.col("azimuth") if has_azimuth else None)
        scores = both.withColumn("miss", miss).groupBy("series_id", "candidate").agg(F.avg("miss").alias("score")).filter("score IS NOT NULL")
        return scores.groupBy("series_id").agg(F.min_by("candidate", F.struct("score", "candidate")).alias("best"))

    around = lambda span, step: F.explode(F.sequence(F.col("middle") - span, F.col("middle") + span, F.lit(step))).alias("candidate")
    # series that cannot be inverted: the best of a coarse grid
    rest = sample.select("series_id").distinct().join(found.select("series_id").distinct(), "series_id", "left_anti")
    grid = best(rest.select("series_id", F.explode(F.sequence(F.lit(LEAST), F.lit(MOST), F.lit(120_000_000))).alias("candidate")))
    estimates = found.select("series_id", "estimate").unionByName(grid.withColumnRenamed("best", "estimate"))
    aliases = estimates.select("series_id", F.explode(F.array(*[F.col("estimate") + k * DAY_US for k in (-1, 0, 1)])).alias("middle")).filter(F.col("middle").between(LEAST - SPAN, MOST + SPAN))
    coarse = best(aliases.select("series_id", around(SPAN, COARSE)).distinct()).withColumnRenamed("best", "middle")
    fine = best(coarse.select("series_id", around(COARSE, 1_000_000)))
    first = estimates.groupBy("series_id").agg(F.min("estimate").alias("estimate"))
    return first.join(fine, "series_id", "left").select("series_id", F.coalesce("best", "estimate").cast("bigint").alias("offset_us"))

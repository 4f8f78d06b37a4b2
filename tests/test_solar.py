import datetime as dt

import pytest
from pyspark.sql import functions as F

from sunledger.functions import shading, solar
from sunledger.operators.offset import infer_utc_offset
from sunledger.operators import runs

LAT, LON = 44.5, -73.2


def instants(spark, *stamps):
    us = [(i, int(dt.datetime.fromisoformat(s).replace(tzinfo=dt.UTC).timestamp() * 1e6)) for i, s in enumerate(stamps)]
    return spark.createDataFrame(us, "i int, us bigint")


def test_declination_at_equinox_and_solstice(spark):
    rows = solar.ecliptic(instants(spark, "2024-03-20T03:06", "2024-06-20T20:51", "2024-09-22T12:44", "2024-12-21T09:21"), F.col("us")).orderBy("i").collect()
    for row, want in zip(rows, (0, 23.4386, 0, -23.4386), strict=True):
        assert abs(row["sun_declination"] * 57.29577951 - want) < 0.01


def test_equation_of_time_extremes(spark):
    year = spark.range(366).select((F.lit(1_704_110_400_000_000) + F.col("id") * solar.DAY_US).alias("us"))
    least, most = solar.ecliptic(year, F.col("us")).agg(F.min("sun_eot"), F.max("sun_eot")).first()
    assert abs(least + 14.2) < 0.2 and abs(most - 16.4) < 0.2


def test_noon_height_is_ninety_less_latitude_plus_declination(spark):
    noon = solar.solar_noon(instants(spark, "2024-06-20", "2024-12-21"), F.col("us"), LON)
    rows = solar.ecliptic(solar.sun_position(noon, F.col("noon_us"), LAT, LON, refract=False), F.col("noon_us"), "e_").collect()
    for r in rows:
        assert abs(r["sun_elevation"] - (90 - LAT + r["e_declination"] * 57.29577951)) < 0.01 and abs(r["sun_azimuth"] - 180) < 0.1


def test_texts(spark):
    us = [(int(h * 3_600_000_000),) for h in (-5, 5.75, 0)] + [(-18_000_000,), (175_000_000,), (None,)]
    rows = spark.createDataFrame(us, "us bigint").select(solar.format_offset(F.col("us")).alias("o"), solar.format_skew(F.col("us")).alias("s"), solar.nearest_timezone(F.col("us")).alias("z")).collect()
    assert [r["o"] for r in rows] == ["UTC-05:00", "UTC+05:45", "UTC+00:00", "UTC-00:00:18", "UTC+00:02:55", "UTC?"]
    assert [r["s"] for r in rows][2:] == ["+0s", "-18s", "+2m55s", "?"] and rows[3]["z"] == 0


@pytest.mark.parametrize(("offset", "azimuth"), [(5.75, True), (-8.0, True), (0.0, False)])
def test_offset_round_trip(spark, offset, azimuth):
    shift = int(offset * 3_600_000_000)
    day = spark.range(0, 1440, 3).select(F.lit("s").alias("series_id"), F.col("id").alias("pos"), (F.lit(1_715_731_200_000_000) + F.col("id") * 60_000_000).alias("us"))
    sun = solar.sun_position(day, F.col("us"), LAT, LON)
    rows = sun.select("series_id", "pos", (F.col("us") + shift).alias("us"), F.col("sun_elevation").alias("elevation"), F.col("sun_azimuth").alias("azimuth"))
    found = infer_utc_offset(rows, LAT, LON, azimuth).collect()
    assert len(found) == 1 and abs(found[0]["offset_us"] - shift) <= (0 if azimuth else 60_000_000)


def test_no_elevation_no_offset(spark):
    rows = spark.createDataFrame([("s", 0, 0, float("nan"), 1.0)], "series_id string, pos bigint, us bigint, elevation double, azimuth double")
    assert infer_utc_offset(rows, LAT, LON).count() == 0


def test_disk_blocked_ends(spark):
    cases = spark.createDataFrame([(0.0, 2.0), (5.0, 1.0), (0.0, 0.0), (1.0, 1.0)], "miss double, half double")
    got = [r[0] for r in cases.select(shading.disk_blocked(F.col("miss"), F.col("half"), 1.0)).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0, 0.5])


def test_days_follow_daylight_saving(spark):
    count = lambda d: shading.local_days(spark, d, d, "America/New_York", 60).count()
    assert (count("2024-03-10"), count("2024-11-03"), count("2024-06-21")) == (1380, 1500, 1440)


def test_shadow_in_spring_and_none_at_midsummer(spark):
    track = shading.shadow_track(spark, "2024-04-01", LAT, LON, "America/New_York", 60)
    found = runs.windows_over(track, "blocked", shading.THRESHOLD, ["elevation", "azimuth"]).collect()
    assert len(found) == 1 and 0 < found[0]["peak"] <= 1 and found[0]["azimuth"] > 180
    assert shading.shadow_track(spark, "2024-06-21", LAT, LON, "America/New_York", 60).agg(F.max("blocked")).first()[0] < 0.01


def test_angular_miss_is_the_least_over_the_segment(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(float(e), float(a)) for e, a in zip(rng.uniform(0, 90, 40), rng.uniform(0, 360, 40), strict=True)]
    offset, along = (-4.0, 0.3, 0.0), (0.0, 0.0, 1.5)
    df = spark.createDataFrame(rows, "e double, a double")
    got = [r["miss"] for r in shading.angular_miss(df, shading.sun_vector(F.col("e"), F.col("a")), offset, along).collect()]
    t = np.linspace(0, 1, 4001)[:, None]
    points = np.array(offset) + t * np.array(along)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    for (e, a), g in zip(rows, got, strict=True):
        e, a = np.radians([e, a])
        sun = np.array([np.cos(e) * np.sin(a), np.cos(e) * np.cos(a), np.sin(e)])
        assert abs(np.arccos(np.clip(points @ sun, -1, 1)).min() - g) < 1e-5

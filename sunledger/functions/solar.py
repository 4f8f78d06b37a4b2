"""The sun's position as column expressions (NOAA's formulas after Meeus), and times of day.

Stages are named columns, so shared terms are computed once and stay in generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunledger.schema import from_micros

DAY_US = 86_400_000_000
#: Days from the Julian epoch to 1970, and to J2000.
UNIX_JD, J2000 = 2440587.5, 2451545.0


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def _poly(t: Column, *c: float) -> Column:
    out = F.lit(float(c[-1]))
    for a in reversed(c[:-1]):
        out = out * t + F.lit(float(a))
    return out


def ecliptic(df: DataFrame, us: Column, prefix: str = "sun_") -> DataFrame:
    """df with declination (radians) and equation of time (minutes) at instants in microseconds."""
    n = lambda x: f"__{prefix}{x}"
    c = lambda x: F.col(n(x))
    df = df.withColumn(n("t"), (us / F.lit(float(DAY_US)) + F.lit(UNIX_JD - J2000)) / 36525.0)
    t = c("t")
    df = df.withColumns({
        n("l"): F.radians(F.pmod(_poly(t, 280.46646, 36000.76983, 0.0003032), F.lit(360.0))),
        n("m"): F.radians(_poly(t, 357.52911, 35999.05029, -0.0001537)),
        n("e"): _poly(t, 0.016708634, -0.000042037, -0.0000001267),
        n("node"): F.radians(_poly(t, 125.04, -1934.136)),
    })
    m = c("m")
    center = F.sin(m) * _poly(t, 1.914602, -0.004817, -0.000014) + F.sin(2 * m) * _poly(t, 0.019993, -0.000101) + F.sin(3 * m) * 0.000289
    df = df.withColumns({
        n("long"): F.radians(F.degrees(c("l")) + center - 0.00569 - 0.00478 * F.sin(c("node"))),
        n("obl"): F.radians(23.0 + (26.0 + _poly(t, 21.448, -46.815, -0.00059, 0.001813) / 60.0) / 60.0 + 0.00256 * F.cos(c("node"))),
    })
    df = df.withColumn(n("y"), F.pow(F.tan(c("obl") / 2.0), F.lit(2.0)))
    y, e, l = c("y"), c("e"), c("l")  # noqa: E741
    eot = y * F.sin(2 * l) - 2 * e * F.sin(m) + 4 * e * y * F.sin(m) * F.cos(2 * l) - 0.5 * y * y * F.sin(4 * l) - 1.25 * e * e * F.sin(2 * m)
    df = df.withColumns({f"{prefix}declination": F.asin(F.sin(c("obl")) * F.sin(c("long"))), f"{prefix}eot": 4.0 * F.degrees(eot)})
    return df.drop(*[n(x) for x in ("t", "l", "m", "e", "node", "long", "obl", "y")])


def hour_angle(us: Column, eot: Column, longitude: Column) -> Column:
    """Radians, negative before solar noon."""
    minutes = F.pmod(us, F.lit(DAY_US)) / 6e7
    return F.radians(F.pmod(minutes + eot + 4.0 * longitude, F.lit(1440.0)) / 4.0 - 180.0)


def refraction(elevation: Column) -> Column:
    """Degrees by which air lifts the sun at a true elevation in degrees."""
    tan = F.tan(F.radians(F.when(F.abs(elevation) < 1e-9, 1e-9).otherwise(elevation)))
    seconds = (
        F.when(elevation > 85.0, F.lit(0.0))
        .when(elevation > 5.0, 58.1 / tan - 0.07 / F.pow(tan, F.lit(3.0)) + 0.000086 / F.pow(tan, F.lit(5.0)))
        .when(elevation > -0.575, _poly(elevation, 1735.0, -518.2, 103.4, -12.79, 0.711))
        .otherwise(-20.772 / tan)
    )
    return seconds / 3600.0


def _degrees(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def sun_position(df: DataFrame, us: Column, latitude: float | Column, longitude: float | Column, refract: bool = True, prefix: str = "sun_") -> DataFrame:
    """df with zenith, elevation and azimuth in degrees at instants in microseconds (UTC)."""
    lat, lon = F.radians(_degrees(latitude)), _degrees(longitude)
    n = lambda x: f"{prefix}{x}"
    df = ecliptic(df, us, prefix)
    df = df.withColumn(n("ha"), hour_angle(us, F.col(n("eot")), lon))
    dec, ha = F.col(n("declination")), F.col(n("ha"))
    df = df.withColumn(n("cosz"), _clip(F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(ha)))
    cosz = F.col(n("cosz"))
    df = df.withColumn(n("z"), F.acos(cosz))
    below = F.cos(lat) * F.sin(F.col(n("z")))
    share = F.when(F.abs(below) > 1e-12, (F.sin(lat) * cosz - F.sin(dec)) / below).otherwise(0.0)
    turn = F.degrees(F.acos(_clip(share)))
    elevation = 90.0 - F.degrees(F.col(n("z")))
    df = df.withColumns({n("turn"): turn, n("flat"): elevation})
    lifted = F.col(n("flat")) + refraction(F.col(n("flat"))) if refract else F.col(n("flat"))
    angle = F.when(ha > 0, F.pmod(F.col(n("turn")) + 180.0, F.lit(360.0))).otherwise(F.pmod(540.0 - F.col(n("turn")), F.lit(360.0)))
    own = {n(x) for x in ("declination", "eot", "ha", "cosz", "z", "turn", "flat")}
    # generated columns: a filter on them is not rewritten in terms of everything below
    out = F.inline(F.array(F.struct(angle.alias(n("azimuth")), lifted.alias(n("elevation")), (90.0 - lifted).alias(n("zenith")))))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in own], out)


def short_way(degrees: Column) -> Column:
    """A difference of angles, in -180 to 180."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def deviation(elevation_miss: Column | None, azimuth_miss: Column | None) -> Column:
    """Misses combined in quadrature; an angle that was not recorded takes no part."""
    squares = [m * m for m in (elevation_miss, None if azimuth_miss is None else short_way(azimuth_miss)) if m is not None]
    return F.sqrt(sum(squares[1:], squares[0]))


def daylight(frame: DataFrame, latitude: float, longitude: float, min_elevation: float = 10.0) -> DataFrame:
    """Rows with the refracted sun higher than min_elevation."""
    return sun_position(frame, F.col("us"), latitude, longitude, True, "__day_").filter(F.col("__day_elevation") > min_elevation).select(*frame.columns)


def solar_noon(df: DataFrame, midnight_us: Column, longitude: float | Column, name: str = "noon_us") -> DataFrame:
    """df with the sun's meridian crossing (to the second) on the UTC day that starts at midnight_us."""
    lon = _degrees(longitude)
    df = df.withColumn("__noon", midnight_us + F.lit(DAY_US // 2))
    for _ in range(2):  # the equation of time is read again at the first answer
        df = ecliptic(df, F.col("__noon"), "__noon_")
        df = df.withColumn("__noon", midnight_us + (720.0 - F.col("__noon_eot") - 4.0 * lon) * 6e7).drop("__noon_declination", "__noon_eot")
    return df.withColumn(name, (F.rint(F.col("__noon") / 1e6) * 1_000_000).cast("bigint")).drop("__noon")


def normalization_window(df: DataFrame, midnight_us: Column, longitude: float | Column, half_width_us: int = 7_200_000_000) -> DataFrame:
    """df with start_ts and end_ts: half_width either side of solar noon."""
    out = solar_noon(df, midnight_us, longitude, "__n")
    return out.withColumns({"start_ts": from_micros(F.col("__n") - half_width_us), "end_ts": from_micros(F.col("__n") + half_width_us)}).drop("__n")


def nearest_timezone(offset_us: Column) -> Column:
    """The nearest multiple of 15 minutes; halves go to the even one."""
    return (F.rint(offset_us / 9e8) * 900_000_000).cast("bigint")


def format_offset(offset_us: Column) -> Column:
    """UTC+HH:MM, with seconds where there are any; UTC? for NULL."""
    seconds = F.rint(offset_us / 1e6).cast("bigint")
    size = F.abs(seconds)
    text = F.concat(F.lit("UTC"), F.when(seconds < 0, "-").otherwise("+"), F.format_string("%02d:%02d", F.floor(size / 3600), F.floor(size / 60) % 60), F.when(size % 60 != 0, F.format_string(":%02d", size % 60)).otherwise(""))
    return F.when(offset_us.isNull(), "UTC?").otherwise(text)


def format_skew(skew_us: Column) -> Column:
    """-18s, +2m55s, +1h00m05s; ? for NULL."""
    seconds = F.rint(skew_us / 1e6).cast("bigint")
    size = F.abs(seconds)
    hours, minutes, rest = F.floor(size / 3600), F.floor(size / 60) % 60, size % 60
    body = F.when(hours > 0, F.format_string("%dh%02dm%02ds", hours, minutes, rest)).when(minutes > 0, F.format_string("%dm%02ds", minutes, rest)).otherwise(F.format_string("%ds", rest))
    return F.when(skew_us.isNull(), "?").otherwise(F.concat(F.when(seconds < 0, "-").otherwise("+"), body))


def is_position(latitude: float, longitude: float) -> bool:
    return all(map(math.isfinite, (latitude, longitude))) and abs(latitude) <= 90 and abs(longitude) <= 180

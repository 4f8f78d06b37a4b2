"""Queries over the library's own operators, and their SQL.

Tables stand in for logger records: events are irregular readings of one signal for each event
type, the daily statistics of lineitem a statistical file, conversations header blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunledger.frame import signal_frame
from sunledger.functions import shading, solar
from sunledger.operators import checks, runs, status_table
from sunledger.operators.angles import check_solar_angles
from sunledger.operators.intervals import interval_join, within
from sunledger.operators.offset import infer_utc_offset
from sunledger.plans.spec import SolarAngles, Spec
from sunledger.plans.specs import DIAGNOSTIC, MODBUS, is_measured
from sunledger.schema import CHECK_ORDER, from_micros, micros, number
from sunledger.sources import channels, findings, logger
from sunledger.stored import shared_dir
from sunledger.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LAT, LON = 44.5, -73.2
#: The month that the events cover, in microseconds.
START_US, END_US, TEN_MINUTES = 1_704_067_200_000_000, 1_706_572_800_000_000, 600_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_frame(_read(spark, sf_dir, "events"), "ts", "event_id", ["value"], "event_type")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of lineitem by day, as a statistical file."""
    day = F.to_date("l_shipdate")
    stats = [f(F.col(f"l_{c}")).alias(f"{c}_{s}") for c in ("quantity", "discount", "tax") for s, f in (("Avg", F.avg), ("Min", F.min), ("Max", F.max))]
    table = _read(spark, sf_dir, "lineitem").groupBy(day.alias("day")).agg(*stats)
    table = table.withColumn("pos", F.date_diff("day", F.lit("1970-01-01").cast("date")))
    return signal_frame(table, F.col("day"), "pos", [c for c in table.columns if c not in ("day", "pos")], F.lit("daily"))


DAILY = """WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS quantity_Avg, min(l_quantity) AS quantity_Min, max(l_quantity) AS quantity_Max,
  avg(l_discount) AS discount_Avg, min(l_discount) AS discount_Min, max(l_discount) AS discount_Max, avg(l_tax) AS tax_Avg FROM lineitem GROUP BY 1) """


def _shown(found: DataFrame) -> DataFrame:
    return found.select("series_id", "check", "signal", "detail", F.round("value_num", 6).alias("value_num"), "start_ts", "end_ts", "duration_us", "n_samples")


RANGE_SQL = """SELECT event_type AS series_id, 'range' AS "check", 'value' AS signal, 'outside [0.0, 150.0]' AS detail, round(arg_min(v, event_id), 6) AS value_num,
  arg_min(ts, event_id) AS start_ts, arg_max(ts, event_id) AS end_ts, date_diff('microsecond', arg_min(ts, event_id), arg_max(ts, event_id)) AS duration_us, count(*) AS n_samples
FROM (SELECT *, {v} AS v FROM events) WHERE {bad} GROUP BY event_type"""


@query(RANGE_SQL.format(v="value", bad="NOT (v BETWEEN 0 AND 150)"))
def range_findings(spark, sf_dir):
    return _shown(checks.check_ranges(events(spark, sf_dir), {"value": (0, 150), "absent": (0, 1)}))


@query("""SELECT event_type AS series_id, 'range' AS "check", 'value' AS signal, 'outside [0.0, 150.0]' AS detail, round(arg_min_null(v, event_id), 6) AS value_num,
  arg_min(ts, event_id) AS start_ts, arg_max(ts, event_id) AS end_ts, date_diff('microsecond', arg_min(ts, event_id), arg_max(ts, event_id)) AS duration_us, count(*) AS n_samples
FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS v FROM events) WHERE v IS NULL OR NOT (v BETWEEN 0 AND 150) GROUP BY event_type""")
def range_with_nulls(spark, sf_dir):
    table = _read(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return _shown(checks.check_ranges(signal_frame(table, "ts", "event_id", ["value"], "event_type"), {"value": (0, 150)}))


PAIR_SQL = DAILY + """SELECT 'daily' AS series_id, '{check}' AS "check", '{l} vs {r}' AS signal, {detail} AS detail, round(arg_min({l}, day) FILTER ({bad}), 6) AS value_num,
  CAST(min(day) FILTER ({bad}) AS TIMESTAMP) AS start_ts, CAST(max(day) FILTER ({bad}) AS TIMESTAMP) AS end_ts,
  date_diff('microsecond', CAST(min(day) FILTER ({bad}) AS TIMESTAMP), CAST(max(day) FILTER ({bad}) AS TIMESTAMP)) AS duration_us, count(*) FILTER ({bad}) AS n_samples FROM d HAVING count(*) FILTER ({bad}) > 0"""


@query(PAIR_SQL.format(check="equivalent", l="discount_Min", r="discount_Max", bad="discount_Min IS DISTINCT FROM discount_Max", detail="concat(count(*) FILTER (discount_Min IS DISTINCT FROM discount_Max), ' of ', count(*), ' rows differ')"))
def equivalent_findings(spark, sf_dir):
    return _shown(checks.check_equivalent(daily(spark, sf_dir), [("discount_Min", "discount_Max"), ("discount_Min", "absent")]))


@query(PAIR_SQL.format(check="lesser", l="discount_Avg", r="tax_Avg", bad="discount_Avg > tax_Avg", detail="concat('discount_Avg exceeds tax_Avg in ', count(*) FILTER (discount_Avg > tax_Avg), ' of ', count(*), ' rows')"))
def lesser_findings(spark, sf_dir):
    return _shown(checks.check_lesser(daily(spark, sf_dir), [("discount_Avg", "tax_Avg"), ("quantity_Min", "quantity_Avg")]))


@query("SELECT event_type AS series_id, CAST(median(step) AS DOUBLE) AS interval_us FROM (SELECT event_type, date_diff('microsecond', lag(ts) OVER (PARTITION BY event_type ORDER BY event_id), ts) AS step FROM events) GROUP BY 1")
def sampling_interval(spark, sf_dir):
    return runs.sampling_interval(events(spark, sf_dir))


GAPS = """WITH s AS (SELECT event_type, ts, lag(ts) OVER w AS prev, date_diff('microsecond', lag(ts) OVER w, ts) AS step FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
m AS (SELECT event_type, median(step) AS med FROM s GROUP BY 1)
"""


@query(GAPS + "SELECT event_type AS series_id, prev AS start_ts, ts AS end_ts, step AS duration_us, CAST(round_even(step / med, 0) - 1 AS BIGINT) AS n_missing FROM s JOIN m USING (event_type) WHERE med > 0 AND step > 8 * med")
def gap_runs(spark, sf_dir):
    return runs.gap_runs(events(spark, sf_dir), 8)


@query(GAPS + """SELECT event_type AS series_id, 'gap' AS "check", '(all signals)' AS signal, CAST(round_even(step / med, 0) - 1 AS DOUBLE) AS value_num, prev AS start_ts, ts AS end_ts, step AS duration_us, CAST(0 AS BIGINT) AS n_samples FROM s JOIN m USING (event_type) WHERE med > 0 AND step > 8 * med""")
def gap_findings(spark, sf_dir):
    return _shown(runs.gap_findings(events(spark, sf_dir), 8)).drop("detail")


SLOTS = """WITH p AS (SELECT DISTINCT event_type, CAST(round_even(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 600000000.0, 0) AS BIGINT) AS slot FROM events),
q AS (SELECT * FROM p WHERE slot BETWEEN 0 AND 4319), t AS (SELECT DISTINCT event_type FROM events)
"""


@query(SLOTS + "SELECT t.event_type AS series_id, CAST(4320 AS BIGINT) AS n_expected, count(slot) AS n_present, round(count(slot) * 100.0 / 4320, 6) AS percent FROM t LEFT JOIN q USING (event_type) GROUP BY 1")
def availability_percent(spark, sf_dir):
    share, _ = runs.availability(events(spark, sf_dir), START_US, END_US, TEN_MINUTES)
    return share.withColumn("percent", F.round("percent", 6))


@query(SLOTS + """, f AS (SELECT * FROM q UNION ALL SELECT event_type, x FROM t, (VALUES (-1), (4320)) AS v(x)), g AS (SELECT event_type, slot, lag(slot) OVER (PARTITION BY event_type ORDER BY slot) AS before FROM f)
SELECT event_type AS series_id, TIMESTAMP '2024-01-01' + to_minutes(10 * (before + 1)) AS start_ts, TIMESTAMP '2024-01-01' + to_minutes(10 * slot) AS end_ts, slot - before - 1 AS n_missing FROM g WHERE slot - before > 1""")
def availability_missing(spark, sf_dir):
    return runs.availability(events(spark, sf_dir), START_US, END_US, TEN_MINUTES)[1]


STALLS = GAPS.replace("SELECT event_type, ts, lag", "SELECT event_type, event_id, value, ts, lag") + """, r AS (SELECT s.*, med, round_even(value / 50, 0) AS rv, COALESCE(step > 8 * med, FALSE) AS gap FROM s JOIN m USING (event_type)),
c AS (SELECT *, CASE WHEN prev IS NULL OR gap OR rv IS DISTINCT FROM lag(rv) OVER (PARTITION BY event_type ORDER BY ts, event_id) THEN 1 ELSE 0 END AS changed FROM r),
n AS (SELECT *, sum(changed) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run, sum(CAST(gap AS INT)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seg FROM c),
g AS (SELECT event_type, seg, run, arg_min(value / 50, event_id) AS value, min(ts) AS first, max(ts) AS last, count(*) AS n_samples, any_value(med) AS med FROM n GROUP BY 1, 2, 3),
e AS (SELECT *, COALESCE(lead(first) OVER (PARTITION BY event_type, seg ORDER BY run), last) AS til FROM g)
"""


def _scaled(spark, sf_dir):
    table = _read(spark, sf_dir, "events").withColumn("value", F.col("value") / 50)
    return signal_frame(table, "ts", "event_id", ["value"], "event_type")


@query(STALLS + "SELECT event_type AS series_id, 'value' AS signal, round(value, 6) AS value, first AS start_ts, til AS end_ts, date_diff('microsecond', first, til) AS duration_us, n_samples FROM e WHERE value IS NOT NULL AND date_diff('microsecond', first, til) > 10 * med")
def stall_runs(spark, sf_dir):
    return runs.stall_runs(_scaled(spark, sf_dir), ["value"], max_stall_us=10, decimals=0, gap_factor=8, in_medians=True).withColumn("value", F.round("value", 6))


@query(STALLS + """SELECT event_type AS series_id, 'stall' AS "check", 'value' AS signal, round(value, 6) AS value_num, first AS start_ts, til AS end_ts, date_diff('microsecond', first, til) AS duration_us, n_samples FROM e WHERE value IS NOT NULL AND date_diff('microsecond', first, til) > 10 * med""")
def stall_findings(spark, sf_dir):
    return _shown(runs.stall_findings(_scaled(spark, sf_dir), ["value"], max_stall_us=10, decimals=0, gap_factor=8, in_medians=True)).drop("detail")


def _orders(spark, sf_dir):
    table = _read(spark, sf_dir, "orders").withColumn("unused", F.when(F.col("o_orderkey") % 5 == 0, 1.0 + F.col("o_orderkey") % 3).otherwise(F.lit(-99.0)))
    return signal_frame(table, "o_orderdate", "o_orderkey", ["o_orderstatus", "o_custkey", "unused"], "o_orderpriority")


SPAN = "arg_min(o_orderdate, o_orderkey) AS start_ts, arg_max(o_orderdate, o_orderkey) AS end_ts, date_diff('microsecond', arg_min(o_orderdate, o_orderkey), arg_max(o_orderdate, o_orderkey)) AS duration_us"


@query(f"""SELECT o_orderpriority AS series_id, 'constant' AS "check", 'o_orderstatus' AS signal, 'changes' AS detail, CAST(NULL AS DOUBLE) AS value_num, {SPAN}, count(DISTINCT o_orderstatus) AS n_samples FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1
UNION ALL SELECT o_orderpriority, 'constant', 'o_custkey', CASE WHEN min(o_custkey) = 0 THEN 'changes; zero/blank' ELSE 'changes' END, CAST(arg_min(o_custkey, o_orderkey) AS DOUBLE), {SPAN}, count(DISTINCT o_custkey) FROM orders GROUP BY 1 HAVING max(o_custkey) > min(o_custkey)""")
def constant_findings(spark, sf_dir):
    return _shown(checks.check_constants(_orders(spark, sf_dir), ["o_orderstatus", "o_custkey"]))


@query(f"""SELECT o_orderpriority AS series_id, 'expected' AS "check", 'o_orderstatus' AS signal, concat(count(*), ' value(s) != F (saw [', array_to_string(list_sort(list(DISTINCT o_orderstatus))[1:5], ', '), '])') AS detail, arg_min(o_orderstatus, o_orderkey) AS value_text, {SPAN}, count(*) AS n_samples FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def expected_findings(spark, sf_dir):
    return checks.check_expected(_orders(spark, sf_dir), {"o_orderstatus": "F"}).drop("value_num")


@query(f"""SELECT o_orderpriority AS series_id, 'sentinel' AS "check", 'unused' AS signal, concat(count(*), ' value(s) != -99.0 (saw [', array_to_string(list_sort(list(DISTINCT CAST(1.0 + o_orderkey % 3 AS DOUBLE))), ', '), '])') AS detail, CAST(min(1.0 + o_orderkey % 3) AS DOUBLE) AS value_num, {SPAN}, count(*) AS n_samples FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1""")
def sentinel_findings(spark, sf_dir):
    return _shown(checks.check_sentinel(_orders(spark, sf_dir), ["unused"]))


SPEC = Spec(ranges={"value": (0, 150)}, dynamic=("value",), stall_windows={"value": 86_400_000_000}, constant=("value",), unused=("absent",), lesser=(("value", "gone"),), gap_factor=8)


@query("""SELECT '' AS series_id, 'missing' AS "check", s AS signal, 'not present in file' AS detail, CAST(0 AS BIGINT) AS n_samples FROM (VALUES ('absent'), ('gone')) AS v(s)""")
def missing_signals(spark, sf_dir):
    return checks.missing_signals(events(spark, sf_dir), SPEC).select("series_id", "check", "signal", "detail", "n_samples")


@query(GAPS + """SELECT '' AS series_id, 'missing' AS "check", s AS signal, 'not present in file' AS detail, CAST(NULL AS DOUBLE) AS value_num, CAST(NULL AS VARCHAR) AS value_text, CAST(NULL AS TIMESTAMP) AS start_ts, CAST(NULL AS TIMESTAMP) AS end_ts, CAST(NULL AS BIGINT) AS duration_us, CAST(0 AS BIGINT) AS n_samples, 0 AS check_order FROM (VALUES ('absent'), ('gone')) AS v(s)
UNION ALL SELECT event_type, 'gap', '(all signals)', concat('no data for ', step // 86400000000, ' days ', printf('%02d:%02d:%02d', step // 3600000000 % 24, step // 60000000 % 60, step // 1000000 % 60), ' (~', CAST(round_even(step / med, 0) - 1 AS BIGINT), ' samples missing)'), CAST(round_even(step / med, 0) - 1 AS DOUBLE), NULL, prev, ts, step, 0, 1 FROM s JOIN m USING (event_type) WHERE med > 0 AND step > 8 * med
UNION ALL SELECT event_type, 'range', 'value', 'outside [0.0, 150.0]', arg_min(value, event_id), NULL, arg_min(ts, event_id), arg_max(ts, event_id), date_diff('microsecond', arg_min(ts, event_id), arg_max(ts, event_id)), count(*), 2 FROM events WHERE NOT (value BETWEEN 0 AND 150) GROUP BY event_type
UNION ALL SELECT event_type, 'constant', 'value', CASE WHEN min(abs(value)) <= 1e-9 THEN 'changes; zero/blank' ELSE 'changes' END, arg_min(value, event_id), NULL, arg_min(ts, event_id), arg_max(ts, event_id), date_diff('microsecond', arg_min(ts, event_id), arg_max(ts, event_id)), count(DISTINCT value), 6 FROM events GROUP BY event_type HAVING max(value) > min(value)""")
def validate_events(spark, sf_dir):
    return checks.validate(events(spark, sf_dir), SPEC)


@query(GAPS + """, n AS (SELECT 'gap' AS c, '(all signals)' AS s, count(*) AS n FROM s JOIN m USING (event_type) WHERE step > 8 * med
UNION ALL SELECT 'range', 'value', count(DISTINCT event_type) FROM events WHERE NOT (value BETWEEN 0 AND 150)
UNION ALL SELECT 'constant', 'value', count(*) FROM (SELECT 1 FROM events GROUP BY event_type HAVING max(value) > min(value) OR min(abs(value)) <= 1e-9)
UNION ALL SELECT 'lesser', 'value vs gone', 0 UNION ALL SELECT 'sentinel', 'absent', 0 UNION ALL SELECT 'stall', 'value', 0)
SELECT c AS "check", s AS signal, n AS n_findings, n = 0 AS "pass" FROM n""")
def summary_events(spark, sf_dir):
    return checks.summarize(validate_events(spark, sf_dir), SPEC)


def ecliptic_sql(rows: str, us: str, tag: str = "") -> str:
    """CTEs that add dec and eot at the instant us to the CTE rows; the last one is called {tag}f."""
    return f"""{tag}a AS (SELECT *, ({us} / 8.64e10 + 2440587.5 - 2451545.0) / 36525.0 AS t FROM {rows}),
{tag}b AS (SELECT *, radians(280.46646 + t * (36000.76983 + t * 0.0003032) - 360.0 * floor((280.46646 + t * (36000.76983 + t * 0.0003032)) / 360.0)) AS l, radians(357.52911 + t * (35999.05029 - 0.0001537 * t)) AS m, 0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS e, radians(125.04 - 1934.136 * t) AS o FROM {tag}a),
{tag}c AS (SELECT *, radians(degrees(l) + sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289 - 0.00569 - 0.00478 * sin(o)) AS lam, radians(23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0 + 0.00256 * cos(o)) AS eps FROM {tag}b),
{tag}d AS (SELECT *, asin(sin(eps) * sin(lam)) AS dec, tan(eps / 2) * tan(eps / 2) AS y FROM {tag}c),
{tag}f AS (SELECT * EXCLUDE (t, l, m, e, o, lam, eps, y), 4.0 * degrees(y * sin(2 * l) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * l) - 0.5 * y * y * sin(4 * l) - 1.25 * e * e * sin(2 * m)) AS eot FROM {tag}d)"""


def sun_sql(rows: str) -> str:
    """A WITH clause whose CTE k has the rows of a query (with us) and the refracted elevation and azimuth at the site."""
    return f"""WITH q AS ({rows}), {ecliptic_sql("q", "us")},
g AS (SELECT *, (us % 86400000000) / 6e7 + eot + 4.0 * -73.2 AS tst FROM f),
h AS (SELECT *, radians((tst - 1440.0 * floor(tst / 1440.0)) / 4.0 - 180.0) AS ha FROM g),
i AS (SELECT *, greatest(-1.0, least(1.0, sin(radians(44.5)) * sin(dec) + cos(radians(44.5)) * cos(dec) * cos(ha))) AS cz FROM h),
j AS (SELECT *, 90.0 - degrees(acos(cz)) AS e0, degrees(acos(greatest(-1.0, least(1.0, (sin(radians(44.5)) * cz - sin(dec)) / (cos(radians(44.5)) * sin(acos(cz))))))) AS az FROM i),
k AS (SELECT *, CASE WHEN ha > 0 THEN az + 180.0 - 360.0 * floor((az + 180.0) / 360.0) ELSE 540.0 - az - 360.0 * floor((540.0 - az) / 360.0) END AS azimuth,
  e0 + CASE WHEN e0 > 85 THEN 0 WHEN e0 > 5 THEN 58.1 / tan(radians(e0)) - 0.07 / pow(tan(radians(e0)), 3) + 0.000086 / pow(tan(radians(e0)), 5) WHEN e0 > -0.575 THEN 1735.0 + e0 * (-518.2 + e0 * (103.4 + e0 * (-12.79 + e0 * 0.711))) ELSE -20.772 / tan(radians(e0)) END / 3600.0 AS elevation FROM j)
"""


SUN = sun_sql("SELECT event_id, ts, epoch_us(ts) AS us FROM events")


def shade_sql(rows: str) -> str:
    """As sun_sql; the CTE shade has miss and rod_width (degrees) and blocked of the usual rod, too."""
    area = "({x} * sqrt(greatest(r * r - {x} * {x}, 0.0)) + r * r * asin(greatest(-1.0, least(1.0, {x} / r))))"
    cut = "greatest(-r, least(r, miss_rad {sign} half))"
    strip = f"({area.format(x=cut.format(sign='+'))} - {area.format(x=cut.format(sign='-'))}) / (pi() * r * r)"
    return sun_sql(rows) + f""", s1 AS (SELECT *, cos(radians(elevation)) * sin(radians(azimuth)) * -4.0 * sin(radians(90.0)) + cos(radians(elevation)) * cos(radians(azimuth)) * -4.0 * cos(radians(90.0)) AS a, sin(radians(elevation)) * 1.5 AS b, radians(0.533 / 2) AS r FROM k),
s2 AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN abs(a * 2.25) > 1e-12 THEN b * 16.0 / (a * 2.25) ELSE 0.0 END)) AS t FROM s1),
s3 AS (SELECT *, (a + b * t) / sqrt(16.0 + 2.25 * t * t) AS c0, a / 4.0 AS c1, (a + b) / sqrt(18.25) AS c2 FROM s2),
s4 AS (SELECT *, acos(greatest(-1.0, least(1.0, greatest(c0, c1, c2)))) AS miss_rad, atan(0.5 * (0.5 / 12) / CASE WHEN c1 <= c0 AND c2 <= c0 THEN sqrt(16.0 + 2.25 * t * t) WHEN c2 <= c1 THEN 4.0 ELSE sqrt(18.25) END) AS half FROM s3),
shade AS (SELECT *, degrees(miss_rad) AS miss, degrees(2 * half) AS rod_width, CASE WHEN elevation > 0 THEN greatest(0.0, least(1.0, {strip})) ELSE 0.0 END AS blocked FROM s4)
"""


SHADED = shade_sql("SELECT event_id, ts, epoch_us(ts) AS us FROM events")
#: The local days of orders, each from midnight to the next by ten minutes; the clock changed on the first Sunday of April and the last of October.
SEASON_ROWS = """SELECT date, midnight + to_minutes(CAST(10 * i AS INTEGER)) AS ts, epoch_us(midnight) + 600000000 * i AS us FROM (SELECT date, midnight, unnest(range(date_diff('minute', midnight, until) // 10)) AS i FROM (
  SELECT date, CAST(date AS TIMESTAMP) + CASE WHEN date > april AND date <= october THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS midnight, CAST(date + 1 AS TIMESTAMP) + CASE WHEN date + 1 > april AND date + 1 <= october THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS until FROM (
  SELECT date, april + CAST((7 - dayofweek(april)) % 7 AS INTEGER) AS april, october - CAST(dayofweek(october) AS INTEGER) AS october FROM (
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, make_date(year(o_orderdate), 4, 1) AS april, make_date(year(o_orderdate), 10, 31) AS october FROM orders WHERE o_orderdate IS NOT NULL))))"""


@query(SUN + "SELECT event_id, round(elevation, 6) AS elevation, round(90.0 - elevation, 6) AS zenith, round(azimuth, 6) AS azimuth FROM k")
def sun_position(spark, sf_dir):
    sun = solar.sun_position(events(spark, sf_dir), F.col("us"), LAT, LON)
    return sun.select(F.col("pos").alias("event_id"), *[F.round(f"sun_{c}", 6).alias(c) for c in ("elevation", "zenith", "azimuth")])


@query(SUN + "SELECT event_id, ts FROM k WHERE elevation > 10")
def daylight_rows(spark, sf_dir):
    return solar.daylight(events(spark, sf_dir), LAT, LON).select(F.col("pos").alias("event_id"), "ts")


@query(SUN + "SELECT event_id, round(sqrt((elevation - value / 10) * (elevation - value / 10) + pow(azimuth - value + 180.0 - 360.0 * floor((azimuth - value + 180.0) / 360.0) - 180.0, 2)), 6) AS miss FROM k JOIN (SELECT event_id, value FROM events) USING (event_id)")
def angle_deviation(spark, sf_dir):
    sun = solar.sun_position(events(spark, sf_dir), F.col("us"), LAT, LON)
    miss = solar.deviation(F.col("sun_elevation") - F.col("value") / 10, F.col("sun_azimuth") - F.col("value"))
    return sun.select(F.col("pos").alias("event_id"), F.round(miss, 6).alias("miss"))


@query("SELECT event_id, round(CASE WHEN e > 85 THEN 0 WHEN e > 5 THEN 58.1 / tan(radians(e)) - 0.07 / pow(tan(radians(e)), 3) + 0.000086 / pow(tan(radians(e)), 5) WHEN e > -0.575 THEN 1735.0 + e * (-518.2 + e * (103.4 + e * (-12.79 + e * 0.711))) ELSE -20.772 / tan(radians(e)) END / 3600.0, 6) AS refraction FROM (SELECT event_id, value / 10 - 5.00001 AS e FROM events)")
def refraction(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.round(solar.refraction(F.col("value") / 10 - 5.00001), 6).alias("refraction"))


@query(f"""WITH q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS midnight FROM orders WHERE o_orderdate IS NOT NULL),
{ecliptic_sql("q", "(midnight + 43200000000)")}, n1 AS (SELECT date, midnight, midnight + (720.0 - eot - 4.0 * -73.2) * 6e7 AS us FROM f), {ecliptic_sql("n1", "CAST(us AS BIGINT)", "z")},
n2 AS (SELECT date, CAST(round_even((midnight + (720.0 - eot - 4.0 * -73.2) * 6e7) / 1e6, 0) * 1000000 AS BIGINT) AS noon FROM zf)
SELECT date, make_timestamp(noon - 7200000000) AS start_ts, make_timestamp(noon + 7200000000) AS end_ts FROM n2""")
def solar_noon_window(spark, sf_dir):
    days = _read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    midnight = F.date_diff("date", F.lit("1970-01-01").cast("date")).cast("bigint") * solar.DAY_US
    return solar.normalization_window(days, midnight, LON).select("date", "start_ts", "end_ts")


@query("""SELECT event_id, CAST(round_even(us / 9e8, 0) * 900000000 AS BIGINT) AS zone_us,
  concat('UTC', CASE WHEN s < 0 THEN '-' ELSE '+' END, printf('%02d:%02d', abs(s) // 3600, abs(s) // 60 % 60), CASE WHEN abs(s) % 60 <> 0 THEN printf(':%02d', abs(s) % 60) ELSE '' END) AS offset_text,
  concat(CASE WHEN s < 0 THEN '-' ELSE '+' END, CASE WHEN abs(s) >= 3600 THEN printf('%dh%02dm%02ds', abs(s) // 3600, abs(s) // 60 % 60, abs(s) % 60) WHEN abs(s) >= 60 THEN printf('%dm%02ds', abs(s) // 60, abs(s) % 60) ELSE printf('%ds', abs(s)) END) AS skew_text
FROM (SELECT event_id, us, CAST(round_even(us / 1e6, 0) AS BIGINT) AS s FROM (SELECT event_id, CAST(round((value - 100) * 6e7) AS BIGINT) AS us FROM events))""")
def offset_texts(spark, sf_dir):
    us = F.round((F.col("value") - 100) * 6e7).cast("bigint")
    return _read(spark, sf_dir, "events").select("event_id", solar.nearest_timezone(us).alias("zone_us"), solar.format_offset(us).alias("offset_text"), solar.format_skew(us).alias("skew_text"))


def _recorded(spark, sf_dir, offset_us: int) -> DataFrame:
    """Angles as a logger would have recorded them, stamped offset_us ahead of UTC."""
    sun = solar.sun_position(events(spark, sf_dir), F.col("us"), LAT, LON)
    shifted = F.col("us") + F.lit(offset_us)
    return sun.select("series_id", "pos", from_micros(shifted).alias("ts"), shifted.alias("us"), F.col("sun_elevation").alias("elevation"), F.col("sun_azimuth").alias("azimuth"))


@query("SELECT DISTINCT event_type AS series_id, CAST(-18000000000 AS BIGINT) AS offset_us FROM events")
def inferred_offset(spark, sf_dir):
    return infer_utc_offset(_recorded(spark, sf_dir, -18_000_000_000), LAT, LON)


@query("""SELECT event_type AS series_id, 'utc' AS "check", '(all signals)' AS signal, 'stamps are UTC-05:00, not UTC' AS detail, count(*) AS n_samples FROM events GROUP BY 1""")
def solar_angle_findings(spark, sf_dir):
    angles = SolarAngles(LAT, LON, elevation="elevation", azimuth="azimuth")
    return check_solar_angles(_recorded(spark, sf_dir, -18_000_000_000), angles).select("series_id", "check", "signal", "detail", "n_samples")


@query(SHADED + "SELECT event_id, round(elevation, 4) AS elevation, round(azimuth, 4) AS azimuth, round(miss, 4) AS miss, round(rod_width, 6) AS rod_width, round(blocked, 4) AS blocked FROM shade")
def shade_track(spark, sf_dir):
    """The rod's shadow at the stamps of events."""
    track = shading.shade(events(spark, sf_dir), F.col("us"), LAT, LON)
    return track.select(F.col("pos").alias("event_id"), *[F.round(c, n).alias(c) for c, n in (("elevation", 4), ("azimuth", 4), ("miss", 4), ("rod_width", 6), ("blocked", 4))])


def _shaded_days(spark, sf_dir):
    """Shade of every local day on which something was ordered, by ten minutes."""
    days = _read(spark, sf_dir, "orders").filter("o_orderdate IS NOT NULL").select(F.to_date("o_orderdate").alias("date")).distinct()
    return shading.shade(shading.day_grid(days, "America/New_York", 600), F.col("us"), LAT, LON)


@query(shade_sql(SEASON_ROWS) + """, o AS (SELECT *, coalesce(blocked > 0.01, FALSE) AS over, lag(coalesce(blocked > 0.01, FALSE)) OVER (PARTITION BY date ORDER BY us) AS was FROM shade),
u AS (SELECT *, sum(CASE WHEN over AND NOT coalesce(was, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY date ORDER BY us) AS run FROM o)
SELECT CAST(date AS VARCHAR) AS series_id, min(ts) AS start_ts, max(ts) + INTERVAL 10 MINUTE AS end_ts, max(us) + 600000000 - min(us) AS duration_us, round(max(blocked), 4) AS peak, round(arg_max(elevation, {'b': blocked, 'u': -us}), 4) AS elevation FROM u WHERE over GROUP BY date, run""")
def shadow_windows(spark, sf_dir):
    found = runs.windows_over(_shaded_days(spark, sf_dir), "blocked", shading.THRESHOLD, ["elevation", "azimuth"])
    return found.select("series_id", "start_ts", "end_ts", "duration_us", F.round("peak", 4).alias("peak"), F.round("elevation", 4).alias("elevation"))


def _season(spark, sf_dir):
    return shading.season_of(_shaded_days(spark, sf_dir), 600)


@query(shade_sql(SEASON_ROWS) + "SELECT date, round(max(blocked), 4) AS peak, arg_max(ts, {'b': blocked, 'u': -us}) AS at, 10.0 * count(*) FILTER (blocked > 0.01) AS minutes FROM shade GROUP BY 1".replace("10.0 * count(*) FILTER (blocked > 0.01)", "CAST(10 * count(*) FILTER (blocked > 0.01) AS DOUBLE)"))
def shadow_season(spark, sf_dir):
    return _season(spark, sf_dir).select("date", F.round("peak", 4).alias("peak"), "at", "minutes")


@query(shade_sql(SEASON_ROWS) + "SELECT date, CAST(10 * count(*) FILTER (blocked > 0.01) AS DOUBLE) AS minutes FROM shade GROUP BY 1 HAVING count(*) FILTER (blocked > 0.01) > 0")
def shadow_days(spark, sf_dir):
    return _season(spark, sf_dir).filter("minutes > 0").select("date", "minutes")


@query("""WITH r AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS b FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS file, b AS block_no, count(DISTINCT role) AS n_labels, arg_min(text, turn) FILTER (role = 'user') AS opened FROM r WHERE b > 0 GROUP BY 1, 2""")
def channel_blocks(spark, sf_dir):
    table = _read(spark, sf_dir, "conversations")
    key = F.when(F.col("role") == "user", "Channel").otherwise(F.col("role"))
    header = table.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("pos"), key.alias("key"), F.col("text").alias("value"))
    blocks = channels.channel_blocks(header)
    return blocks.select("file", "block_no", F.size("fields").cast("bigint").alias("n_labels"), F.element_at("fields", "Channel").alias("opened"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 10 AND contains(lower(p_type), 'brass') THEN 'small brass' WHEN contains(lower(p_name), 'a') AND (contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin')) THEN 'metal' WHEN p_size <= 10 THEN 'small' END AS kind FROM part""")
def classified_parts(spark, sf_dir):
    rules = (("small brass", ("small",), (("brass",),)), ("metal", (), (("steel", "tin"), ("name:a",))), ("small", ("small",), ()))
    text = F.concat(F.lower("p_type"), F.when(F.lower("p_name").contains("a"), " name:a").otherwise(""))
    return _read(spark, sf_dir, "part").select("p_partkey", channels.kind_of(F.when(F.col("p_size") <= 10, "small").otherwise(""), text, rules).alias("kind"))


#: Parts as columns of a file for each brand: a channel, a statistic (or none), words, and sometimes another statistic.
STATS_OF = ("Avg", "Min", "Max", "SD", "Samples", "Gust", "NotUsed", "Total")
PART_COLUMNS = f"""WITH n AS (SELECT p_brand AS file, p_partkey AS pos, p_type, CASE WHEN p_partkey % 11 = 0 THEN p_name ELSE concat('Ch', p_partkey % 50, '_', {list(STATS_OF)}[p_size % 8 + 1], '_', p_type, CASE WHEN p_partkey % 3 = 0 THEN concat('_', {list(STATS_OF)}[p_partkey % 4 + 1]) ELSE '' END) END AS name FROM part)
"""


def _part_columns(spark, sf_dir):
    key = F.col("p_partkey")
    stat = lambda i: F.get(F.array(*map(F.lit, STATS_OF)), i.cast("int"))
    name = F.concat(F.lit("Ch"), (key % 50).cast("string"), F.lit("_"), stat(F.col("p_size") % 8), F.lit("_"), "p_type", F.when(key % 3 == 0, F.concat(F.lit("_"), stat(key % 4))).otherwise(""))
    return _read(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), key.alias("pos"), F.when(key % 11 == 0, F.col("p_name")).otherwise(name).alias("name"))


@query(PART_COLUMNS + r"""SELECT pos, name, CAST(CASE WHEN regexp_matches(name, '^Ch[0-9]+_') THEN regexp_extract(name, '^Ch([0-9]+)_', 1) ELSE '-1' END AS INTEGER) AS channel, CASE WHEN s IN ('Avg', 'Min', 'Max', 'SD', 'Gust', 'NotUsed', 'Total') THEN s ELSE '' END AS next_statistic,
  CASE WHEN regexp_matches(name, '^Ch[0-9]+_') THEN coalesce(list_filter(string_split(regexp_replace(name, '^Ch[0-9]+_', ''), '_'), lambda x: x IN ('Avg', 'Min', 'Max', 'SD', 'Gust', 'NotUsed', 'Total'))[-1], '') ELSE '' END AS last_statistic FROM (SELECT *, regexp_extract(name, '^Ch[0-9]+_([^_]+)', 1) AS s FROM n)""")
def column_grammar(spark, sf_dir):
    return channels.column_grammar(_part_columns(spark, sf_dir).select("pos", "name")).withColumn("channel", F.coalesce("channel", F.lit(-1)))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM documents),
k AS (SELECT doc_id, nr, len(string_split(line, ' ')) AS n FROM l WHERE trim(line) <> '') SELECT k.doc_id, k.nr - 1 AS pos, k.n AS fields, f.n AS expected FROM k JOIN (SELECT doc_id, arg_min(n, nr) AS n FROM k GROUP BY 1) f USING (doc_id) WHERE k.n <> f.n""")
def malformed_lines(spark, sf_dir):
    """Documents as files: their first line's words are the columns, every line of another size is malformed."""
    lines = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter(F.trim("line") != "")
    wrong = logger.misfits(logger.sized(lines.select("file", "pos", F.split("line", " ", -1).alias("fields"))))
    return wrong.select(F.col("file").cast("bigint").alias("doc_id"), *[F.col(c).cast("bigint").alias(c) for c in ("pos", "fields", "expected")])


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS o FROM events WHERE event_type IN ('error', 'view')),
l AS (SELECT *, COALESCE(lag(o) OVER (PARTITION BY user_id ORDER BY ts, event_id), FALSE) AS was FROM e), d AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS til FROM l WHERE o <> was)
SELECT CAST(user_id AS VARCHAR) AS series_id, ts AS start_ts, COALESCE(til, (SELECT max(ts) FROM e)) AS end_ts, round(date_diff('microsecond', ts, COALESCE(til, (SELECT max(ts) FROM e))) / 1e6, 6) AS seconds FROM d WHERE o""")
def fault_intervals(spark, sf_dir):
    table = _read(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "view"))
    frame = signal_frame(table, "ts", "event_id", ["event_type"], "user_id")
    return runs.fault_intervals(frame, F.col("event_type") == "error").withColumn("seconds", F.round("seconds", 6))


@query(ORACLE_SQL["fault_intervals"].replace("SELECT CAST(user_id AS VARCHAR) AS series_id", "SELECT e.event_id, e.event_type, f.start_ts, f.seconds FROM events e JOIN (SELECT user_id", 1) + ") f ON e.user_id = f.user_id AND e.ts >= f.start_ts AND e.ts < f.end_ts")
def readings_in_faults(spark, sf_dir):
    """Events of every type in the fault intervals of their user."""
    frame = signal_frame(_read(spark, sf_dir, "events"), "ts", "event_id", ["event_type"], "user_id")
    return within(frame, fault_intervals(spark, sf_dir), 86_400_000_000).select(F.col("pos").alias("event_id"), "event_type", "start_ts", "seconds")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'low' WHEN p_size < 30 THEN 'middle' ELSE 'high' END AS band FROM part WHERE p_size >= 0 AND p_size < 1000")
def size_bands(spark, sf_dir):
    bands = spark.createDataFrame([("low", 0, 10), ("middle", 10, 30), ("high", 30, 1000)], "band string, lo int, hi int")
    return interval_join(_read(spark, sf_dir, "part"), F.col("p_size"), bands, "lo", "hi", 10).select("p_partkey", "band")


@query("""WITH d AS (SELECT DISTINCT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS date FROM orders), i AS (SELECT p, date, date - CAST(row_number() OVER (PARTITION BY p ORDER BY date) AS INTEGER) AS k FROM d)
SELECT p AS series_id, min(date) AS start_date, max(date) AS end_date, count(*) AS n_days FROM i GROUP BY p, k""")
def date_bands(spark, sf_dir):
    days = _read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")).distinct()
    return runs.date_bands(days)


@query("SELECT event_id, CAST(regexp_extract(props, ':\\s*([-0-9.]+)', 1) AS DOUBLE) AS k FROM events")
def props_number(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", number(F.get_json_object("props", "$.k")).alias("k"))


@query(DAILY + "SELECT 'daily' AS series_id, 'quantity' AS signal, s AS statistic, 'value' AS panel, o AS draw_order, CAST(day AS TIMESTAMP) AS ts, round(CASE s WHEN 'Avg' THEN quantity_Avg WHEN 'Min' THEN quantity_Min ELSE quantity_Max END, 6) AS value FROM d, (VALUES ('Avg', 0), ('Min', 1), ('Max', 2)) AS v(s, o)")
def chart_rows(spark, sf_dir):
    return channels.chart_data(daily(spark, sf_dir), ["quantity_Avg", "quantity_Min", "quantity_Max"]).withColumn("value", F.round("value", 6))


@query("""SELECT CAST(d AS DATE) AS date FROM generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 DAY) AS g(d) WHERE CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderdate IS NOT NULL)""")
def export_days_left(spark, sf_dir):
    return logger.export_days("1992-01-01", "1998-12-31", _read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")))


@query(DAILY.replace("avg(l_tax) AS tax_Avg", "stddev_pop(l_quantity) AS quantity_SD") + """, v AS (SELECT day, quantity_Avg / 5 AS a, quantity_Min / 5 AS lo, quantity_Max / 5 AS hi, quantity_SD / 150 AS sd FROM d),
t AS (SELECT day, unnest(['5V_V_Avg', '5V_V_Min', '5V_V_Max', '5V_V_SD']) AS signal, unnest([a, lo, hi, sd]) AS x, unnest([4.75, 4.75, 4.75, 0.0]) AS l, unnest([5.25, 5.25, 5.25, 0.1]) AS h FROM v)
SELECT 'range' AS "check", signal, count(*) AS n_samples FROM t WHERE NOT (x BETWEEN l AND h) GROUP BY signal UNION ALL SELECT 'lesser', '5V_V_Min vs 5V_V_Avg', count(*) FROM v WHERE lo > a HAVING count(*) > 0 UNION ALL SELECT 'lesser', '5V_V_Avg vs 5V_V_Max', count(*) FROM v WHERE a > hi HAVING count(*) > 0""")
def diagnostic_spec(spark, sf_dir):
    """The spec of diagnostic files, held against daily statistics as one rail's."""
    quantity = F.col("l_quantity")
    day = _read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg((F.avg(quantity) / 5).alias("5V_V_Avg"), (F.min(quantity) / 5).alias("5V_V_Min"), (F.max(quantity) / 5).alias("5V_V_Max"), (F.stddev_pop(quantity) / 150).alias("5V_V_SD"))
    frame = signal_frame(day, F.col("day"), F.date_diff("day", F.lit("1970-01-01").cast("date")), ["5V_V_Avg", "5V_V_Min", "5V_V_Max", "5V_V_SD"], F.lit("daily"))
    return checks.validate(frame, DIAGNOSTIC.override(gaps=False)).filter("check <> 'missing'").select("check", "signal", "n_samples")


def _region_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nr, line: a logger file for each region, its nations as rows, every seventh with a field too many."""
    key, line = F.col("n_nationkey"), lambda *x: F.concat_ws("\t", *x)
    rows = _read(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("region"), (key + 100).alias("nr"),
        line(F.format_string("2024-01-01T00:%02d:00Z", key), (key * 1.5).cast("double").cast("string"), key.cast("string"), F.lit("2"), F.col("n_name"), F.when(key % 7 == 3, "over")).alias("line"),
    )
    region = F.col("r_regionkey")
    head = [line(F.lit("Site Name:"), F.col("r_name")), line(F.lit("Latitude:"), F.concat((region + 40).cast("string"), F.lit(".5"))), "Site Longitude\t-73.2", "Channel\t1", "Description\tAir Temp", "Units\tdeg_C", "Channel\t2", "Type\tGauge", "Units\tmm", "Data", "Timestamp\tCh1_Avg_deg_C\tCh1_Min_deg_C\tCh2_Total_mm\tname"]
    top = _read(spark, sf_dir, "region").select(region.alias("region"), F.posexplode(F.array(*[F.lit(x) if isinstance(x, str) else x for x in head])).alias("nr", "line"))
    return top.unionByName(rows)


def _region_files(spark: SparkSession, sf_dir: str, packed: bool = False, start: int = 0) -> str:
    """A folder with those files, from line `start` on."""
    lines = _region_lines(spark, sf_dir).filter(F.col("nr") >= start)
    file = F.concat(F.lit("site"), F.col("region").cast("string"), F.lit("_log.dat.gz" if packed else "_log.dat"))
    return logger.write_files(lines.select(file.alias("file"), F.col("nr").alias("pos"), "line"), f"{shared_dir(spark)}/logger-{uuid.uuid4().hex}")


@query("""SELECT concat('site', n_regionkey, '_log.dat') AS file, printf('2024-01-01T00:%02d:00Z', n_nationkey) AS "Timestamp", CAST(CAST(n_nationkey * 1.5 AS DOUBLE) AS VARCHAR) AS avg, n_name AS name FROM nation WHERE n_nationkey % 7 <> 3""")
def logger_rows(spark, sf_dir):
    data, _, _ = logger.read_files(spark, _region_files(spark, sf_dir))
    return data.select("file", "Timestamp", F.col("Ch1_Avg_deg_C").alias("avg"), "name")


@query("""SELECT concat('site', n_regionkey, '_log.dat') AS file, printf('2024-01-01T00:%02d:00Z', n_nationkey) AS "timestamp", CAST(6 AS INTEGER) AS fields, CAST(5 AS INTEGER) AS expected FROM nation WHERE n_nationkey % 7 = 3""")
def logger_malformed(spark, sf_dir):
    return logger.malformed_rows(logger.read_lines(spark, _region_files(spark, sf_dir)))


@query("""SELECT concat('site', n_regionkey, '_log.dat') AS file, TIMESTAMP '2024-01-01' + to_minutes(CAST(n_nationkey AS INTEGER)) AS ts, CAST(n_nationkey * 1.5 AS DOUBLE) AS Ch1_Avg_Air_Temp_deg_C, CAST(n_nationkey AS DOUBLE) AS Ch1_Min_Air_Temp_deg_C, CAST(2 AS DOUBLE) AS Ch2_Gauge_mm FROM nation WHERE n_nationkey % 7 <> 3""")
def logger_indexed(spark, sf_dir):
    data, header, _ = logger.read_files(spark, _region_files(spark, sf_dir))
    names = {r["channel"]: r["name"] for r in channels.channel_names(channels.channel_blocks(header)).filter("file = 'site0_log.dat'").collect()}  # two channels
    frame = logger.indexed(data, "Timestamp", names)
    return frame.select("file", "ts", *[number(F.col(c)).alias(c) for c in ("Ch1_Avg_Air_Temp_deg_C", "Ch1_Min_Air_Temp_deg_C", "Ch2_Gauge_mm")])


@query("""SELECT concat('site', r_regionkey, '_log.dat') AS file, r_name AS site, CAST(40.5 + r_regionkey AS DOUBLE) AS latitude, CAST(-73.2 AS DOUBLE) AS longitude FROM region""")
def site_positions(spark, sf_dir):
    _, header, _ = logger.read_files(spark, _region_files(spark, sf_dir))
    return channels.site_positions(channels.site_fields(header)).select("file", F.element_at("fields", "Site Name").alias("site"), "latitude", "longitude")


@query("""SELECT concat('site', n_regionkey, '_log.dat') AS file, CAST(13 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 2 AS INTEGER) AS pos, n_name AS name, TIMESTAMP '2024-01-01' + to_minutes(CAST(n_nationkey AS INTEGER)) AS ts FROM nation""")
def capture_rows(spark, sf_dir):
    """From the column names on, the files are captures without a header of their own."""
    data = logger.read_tsv(spark, _region_files(spark, sf_dir, start=10) + "/*.dat", "Timestamp")
    return data.select("file", (F.col("pos") + 11).cast("int").alias("pos"), "name", F.to_timestamp_ntz("Timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ssX")).alias("ts"))


@query("""SELECT concat('site', n_regionkey, '_log.dat.gz') AS file, CAST(n_nationkey AS VARCHAR) AS least, n_name AS name FROM nation""")
def logger_packed(spark, sf_dir):
    """Packed files, malformed rows kept: fields beyond the names are left out."""
    data, _, _ = logger.read_files(spark, _region_files(spark, sf_dir, packed=True), malformed="keep")
    return data.select("file", F.col("Ch1_Min_deg_C").alias("least"), "name")


@query("""SELECT concat('d', date_part('year', o_orderdate), '_log.dat') AS file, CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN date_part('year', o_orderdate) % 2 = 0 THEN o_orderstatus END AS status, CASE WHEN date_part('year', o_orderdate) % 2 = 1 THEN o_orderpriority END AS priority FROM orders""")
def logger_mixed_columns(spark, sf_dir):
    """A file for each year of orders, even years with other columns than odd ones, read as one table."""
    year = F.year("o_orderdate")
    even = year % 2 == 0
    file = F.concat(F.lit("d"), year.cast("string"), F.lit("_log.dat"))
    rows = _read(spark, sf_dir, "orders").filter("o_orderdate IS NOT NULL").select(file.alias("file"), F.col("o_orderkey").alias("pos"), F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.when(even, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority"))).alias("line"), even.alias("even"))
    head = rows.select("file", "even").distinct().select("file", F.posexplode(F.array(F.lit("Data"), F.when(F.col("even"), "key\tstatus").otherwise("key\tpriority"))).alias("pos", "line"))
    folder = logger.write_files(head.withColumn("pos", F.col("pos") - 2).unionByName(rows.drop("even")), f"{shared_dir(spark)}/logger-{uuid.uuid4().hex}")
    return logger.read_files(spark, folder, columns=["key", "status", "priority"])[0].drop("pos")


#: Parts as channels: 50 to a brand, of which the last block counts.
UNITS_OF = ("W/m^2", "deg_C", "m/s", "%", "mm", "hPa", "V", "deg", "NA")
PREFIX_OF = ("Soiling ", "Tilt GHI ", "Zenith ", "RHI ", "")
PART_CHANNELS = f"""WITH p AS (SELECT p_brand AS file, CAST(p_partkey % 50 AS INTEGER) AS channel, p_partkey, concat({list(PREFIX_OF)}[p_partkey % 5 + 1], p_name) AS description, p_type AS measurand, {list(UNITS_OF)}[p_size % 9 + 1] AS units FROM part),
l AS (SELECT file, channel, arg_max(p, p_partkey) AS b FROM p GROUP BY 1, 2), c AS (SELECT file, channel, b.description AS description, b.measurand AS measurand, b.units AS units, lower(b.units) AS u, lower(concat(b.description, ' ', b.measurand)) AS x FROM l),
k AS (SELECT * EXCLUDE (u, x), CASE {" ".join("WHEN " + " AND ".join([f"u IN ({', '.join(repr(u) for u in units)})", *("(" + " OR ".join(f"contains(x, {w!r})" for w in any_of) + ")" for any_of in words)]) + f" THEN {kind!r}" for kind, units, words in channels.RULES)} END AS kind FROM c)
"""


def _part_blocks(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    description = F.concat(F.get(F.array(*map(F.lit, PREFIX_OF)), F.col("p_partkey") % 5), "p_name")
    lines = [("Channel", (F.col("p_partkey") % 50).cast("string")), ("Description:", description), ("Measurand", F.col("p_type")), ("Units", F.get(F.array(*map(F.lit, UNITS_OF)), F.col("p_size") % 9))]
    header = part.select(F.col("p_brand").alias("file"), F.inline(F.array(*[F.struct((F.col("p_partkey") * 10 + i).alias("pos"), F.lit(k).alias("key"), v.alias("value")) for i, (k, v) in enumerate(lines)])))
    return channels.channel_blocks(header)


@query(PART_CHANNELS + r"SELECT file, channel, concat_ws('_', concat('Ch', channel), regexp_replace(description, '\s+', '_', 'g'), regexp_replace(measurand, '\s+', '_', 'g'), regexp_replace(units, '\s+', '_', 'g')) AS name FROM k")
def channel_labels(spark, sf_dir):
    return channels.channel_names(_part_blocks(spark, sf_dir))


@query(PART_CHANNELS + "SELECT file, channel, kind FROM k")
def channel_kinds(spark, sf_dir):
    return channels.channel_kinds(_part_blocks(spark, sf_dir))


@query(PART_CHANNELS + "SELECT file, channel, kind FROM k")
def channel_kinds_by_rules(spark, sf_dir):
    """The same through one automaton over all words of all rules."""
    return channels.channel_kinds(_part_blocks(spark, sf_dir), as_data=True)


LISTED = ["Timestamp", "Ch1_Avg_deg_C", "Ch1_Min_deg_C", "Ch1_SD_deg_C", "Ch2_Total_mm", "Ch3_deg", "Ch3_NotUsed"]
LISTING = PART_CHANNELS + f""", n AS (SELECT * FROM (VALUES (1, 'Avg Min SD'), (2, 'Total'), (3, 'NotUsed')) AS v(channel, statistics)), b AS (SELECT * FROM (VALUES {", ".join(f"({k!r}, CAST({v.lo} AS DOUBLE), CAST({v.hi} AS DOUBLE), {v.dynamic})" for k, v in channels.KINDS.items())}) AS v(kind, lo, hi, dynamic))
SELECT file, n.channel AS channel, description, measurand, units, statistics, coalesce(k.kind, '') AS kind, lo, hi, coalesce(dynamic, FALSE) AS dynamic FROM n LEFT JOIN k USING (channel) LEFT JOIN b ON k.kind = b.kind"""


@query(LISTING)
def channel_listing(spark, sf_dir):
    return channels.channels(LISTED, _part_blocks(spark, sf_dir))


@query(f"SELECT * FROM ({LISTING}) WHERE kind = ''")
def channels_unclassified(spark, sf_dir):
    return channels.unclassified(channels.channels(LISTED, _part_blocks(spark, sf_dir)))


@query(PART_CHANNELS + """, d AS (SELECT sum(l_quantity) AS a, max(l_quantity) AS b, sum(l_tax) AS c FROM lineitem), x AS (SELECT channel, concat_ws('_', regexp_replace(description, '\\s+', '_', 'g'), regexp_replace(measurand, '\\s+', '_', 'g'), regexp_replace(units, '\\s+', '_', 'g')) AS rest FROM k WHERE (file, channel) IN (SELECT p_brand, p_partkey FROM part WHERE p_partkey IN (1, 2)))
SELECT concat('Ch1_Avg_', rest) AS name, round(a, 4) AS total FROM x, d WHERE channel = 1 UNION ALL SELECT concat('Ch1_Max_', rest), round(b, 4) FROM x, d WHERE channel = 1 UNION ALL SELECT concat('Ch2_', rest), round(c, 4) FROM x, d WHERE channel = 2""")
def renamed_channels(spark, sf_dir):
    """Columns named by the headers of the first two parts; the unused one is dropped."""
    blocks = _part_blocks(spark, sf_dir)
    own = _read(spark, sf_dir, "part").filter("p_partkey IN (1, 2)").select(F.col("p_brand").alias("file"), F.col("p_partkey").cast("int").alias("channel"))
    names = {r["channel"]: r["name"] for r in channels.channel_names(blocks).join(own, ["file", "channel"]).collect()}  # two channels
    table = _read(spark, sf_dir, "lineitem").agg(F.sum("l_quantity").alias("Ch1_Avg_x"), F.max("l_quantity").alias("Ch1_Max_x"), F.sum("l_tax").alias("Ch2_Total_x"), F.count("*").alias("Ch9_NotUsed"))
    new = channels.rename_channels(table.columns, names)
    return table.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.round(F.col(c).cast("double"), 4).alias("total")) for c, n in new.items()])))


@query(PART_COLUMNS + r"""SELECT file, signal, string_agg(name, ' | ' ORDER BY pos, name) AS columns FROM (SELECT *, CASE WHEN regexp_matches(name, '^.+_(Avg|Min|Max|SD)$') THEN regexp_extract(name, '^(.+)_[^_]*$', 1) ELSE name END AS signal FROM n) GROUP BY 1, 2""")
def signal_groups(spark, sf_dir):
    groups = channels.grouped_signals(_part_columns(spark, sf_dir))
    return groups.select("file", "signal", F.array_join("columns", " | ").alias("columns"))


@query("""WITH g AS (SELECT p_brand, list_sort(list(DISTINCT CASE p_size % 4 WHEN 0 THEN 'Avg' WHEN 1 THEN 'Max' WHEN 2 THEN '' ELSE 'SD' END)) AS s FROM part WHERE p_size % 50 < p_partkey % 3 GROUP BY 1)
SELECT p_brand, CASE WHEN list_contains(s, 'Max') THEN 'Max' WHEN s = [''] THEN '' END AS named, CASE WHEN list_contains(s, 'Avg') THEN 'Avg' WHEN list_contains(s, '') THEN '' ELSE s[1] END AS usual FROM g""")
def chosen_statistics(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("Avg", "Max", "", "SD"))), (F.col("p_size") % 4 + 1).cast("int"))
    groups = _read(spark, sf_dir, "part").filter("p_size % 50 < p_partkey % 3").groupBy("p_brand").agg(F.array_sort(F.collect_set(kind)).alias("s"))
    return groups.select("p_brand", channels.choose_statistic(F.col("s"), "Max").alias("named"), channels.choose_statistic(F.col("s")).alias("usual"))


@query(f"""WITH e AS (SELECT event_type, value * 10 AS g, value * 9 + event_id % 40 AS d, CASE WHEN event_id % 10 = 0 THEN -99.0 ELSE value - 20 END AS r, event_id % 3 AS w FROM events),
f AS (SELECT 'range' AS "check", 'GHI' AS signal, event_type, count(*) AS n FROM e WHERE NOT (g BETWEEN {MODBUS.ranges["GHI"][0]} AND {MODBUS.ranges["GHI"][1]}) GROUP BY 3 UNION ALL SELECT 'range', 'DHI', event_type, count(*) FROM e WHERE NOT (d BETWEEN {MODBUS.ranges["DHI"][0]} AND {MODBUS.ranges["DHI"][1]}) GROUP BY 3
UNION ALL SELECT 'range', 'RH', event_type, count(*) FROM e WHERE NOT (r BETWEEN 0 AND 50) GROUP BY 3 UNION ALL SELECT 'lesser', 'DHI vs GHI', event_type, count(*) FROM e WHERE d > g GROUP BY 3 UNION ALL SELECT 'sentinel', 'Wind_Quality', event_type, count(*) FROM e WHERE w <> -99 GROUP BY 3)
SELECT event_type AS series_id, "check", signal, n AS n_samples FROM f""")
def modbus_checks(spark, sf_dir):
    """The gateway's spec, with limits of one signal overridden, held against events as four of its signals."""
    value, key = F.col("value"), F.col("event_id")
    table = _read(spark, sf_dir, "events").withColumns({"GHI": value * 10, "DHI": value * 9 + key % 40, "RH": F.when(key % 10 == 0, -99.0).otherwise(value - 20), "Wind_Quality": (key % 3).cast("double")})
    frame = signal_frame(table, "ts", "event_id", ["GHI", "DHI", "RH", "Wind_Quality"], "event_type")
    spec = MODBUS.override(ranges={"RH": (0, 50)}, dynamic=(), gaps=False, solar=None)
    return checks.validate(frame, spec).filter("check <> 'missing'").select("series_id", "check", "signal", "n_samples")


@query("""SELECT p_partkey, name FROM (SELECT p_partkey, concat(['reserved_', 'ProtoNode.', 'Unnamed: ', '__', '', 'no '][p_partkey % 6 + 1], p_name) AS name FROM part) WHERE NOT (starts_with(name, 'reserved') OR starts_with(name, 'ProtoNode') OR starts_with(name, 'Unnamed') OR starts_with(name, '__'))""")
def measured_columns(spark, sf_dir):
    prefix = F.get(F.array(*map(F.lit, ("reserved_", "ProtoNode.", "Unnamed: ", "__", "", "no "))), (F.col("p_partkey") % 6).cast("int"))
    names = _read(spark, sf_dir, "part").select("p_partkey", F.concat(prefix, "p_name").alias("name"))
    return names.filter(is_measured(F.col("name")))


#: What each file's own header and columns say it must keep to.
KIND_ROWS = ", ".join(f"({k!r}, CAST({v.lo} AS DOUBLE), CAST({v.hi} AS DOUBLE), {v.dynamic}, {'range' in v.sunlit}, {'stall' in v.sunlit}, {v.extremes}, {int(v.stall_hours * 3_600_000_000)})" for k, v in channels.KINDS.items())
SPEC_ROWS = PART_CHANNELS + f""", n AS {PART_COLUMNS.strip().removeprefix("WITH n AS ")}, b AS (SELECT * FROM (VALUES {KIND_ROWS}) AS v(kind, lo, hi, dynamic, s_range, s_stall, extremes, win)),
g AS (SELECT file, channel, stat, max(name) AS name FROM (SELECT file, name, CAST(regexp_extract(name, '^Ch([0-9]+)_', 1) AS INTEGER) AS channel, CASE WHEN t IN ('Avg', 'Min', 'Max', 'SD', 'Gust', 'NotUsed', 'Total') THEN t ELSE '' END AS stat FROM (SELECT *, regexp_extract(name, '^Ch[0-9]+_([^_]+)', 1) AS t FROM n) WHERE t <> '') GROUP BY 1, 2, 3),
w AS (SELECT g.*, lo, hi, dynamic, s_range, s_stall, extremes, win, max(CASE WHEN stat = 'Total' THEN 1 ELSE 0 END) OVER c AS summed, max(CASE WHEN stat = '' THEN name END) OVER c AS plain, max(CASE WHEN stat = 'Avg' THEN name END) OVER c AS average, max(CASE WHEN stat = 'Min' THEN name END) OVER c AS least, max(CASE WHEN stat = 'Max' THEN name END) OVER c AS most, max(CASE WHEN stat = 'Gust' THEN name END) OVER c AS gust, row_number() OVER (PARTITION BY file, channel ORDER BY stat) AS nr
  FROM g JOIN k USING (file, channel) JOIN b ON b.kind = k.kind WINDOW c AS (PARTITION BY file, channel))
"""


@query(SPEC_ROWS + """SELECT file, 'range' AS "check", name AS signal, lo, hi, CAST(NULL AS BIGINT) AS window_us FROM w WHERE NOT s_range AND stat IN ('', 'Avg', 'Min', 'Max', 'Gust') AND (stat NOT IN ('Min', 'Max') OR (extremes AND summed = 0))
UNION ALL SELECT file, 'range', name, 0.0, hi - lo, NULL FROM w WHERE NOT s_range AND stat = 'SD' UNION ALL SELECT file, 'stall', coalesce(average, plain), NULL, NULL, win FROM w WHERE nr = 1 AND dynamic AND NOT s_stall AND coalesce(average, plain) IS NOT NULL
UNION ALL SELECT file, 'lesser', concat(least, ' vs ', average), NULL, NULL, NULL FROM w WHERE nr = 1 AND extremes AND least IS NOT NULL AND average IS NOT NULL AND most IS NOT NULL UNION ALL SELECT file, 'lesser', concat(average, ' vs ', most), NULL, NULL, NULL FROM w WHERE nr = 1 AND extremes AND least IS NOT NULL AND average IS NOT NULL AND most IS NOT NULL
UNION ALL SELECT file, 'lesser', concat(gust, ' vs ', most), NULL, NULL, NULL FROM w WHERE nr = 1 AND gust IS NOT NULL AND most IS NOT NULL""")
def header_spec(spark, sf_dir):
    return channels.spec_rows(_part_columns(spark, sf_dir), channels.channel_kinds(_part_blocks(spark, sf_dir)))


@query(SPEC_ROWS + """SELECT file, 'range' AS "check", name AS signal, lo, hi, CAST(NULL AS BIGINT) AS window_us FROM w WHERE s_range AND stat IN ('', 'Avg', 'Min', 'Max', 'Gust') AND (stat NOT IN ('Min', 'Max') OR (extremes AND summed = 0))
UNION ALL SELECT file, 'range', name, 0.0, hi - lo, NULL FROM w WHERE s_range AND stat = 'SD' UNION ALL SELECT file, 'stall', coalesce(average, plain), NULL, NULL, win FROM w WHERE nr = 1 AND dynamic AND s_stall AND coalesce(average, plain) IS NOT NULL""")
def sunlit_spec(spark, sf_dir):
    return channels.spec_rows(_part_columns(spark, sf_dir), channels.channel_kinds(_part_blocks(spark, sf_dir)), sunlit=True)


@query("""SELECT event_type AS series_id, 'range' AS "check", 'value' AS signal, 'outside [20.0, 120.0]' AS detail, count(*) AS n_samples FROM events WHERE NOT (value BETWEEN 20 AND 120) GROUP BY 1""")
def overridden_spec(spark, sf_dir):
    """validate_events' spec with other limits; whatever else it checks is taken out."""
    spec = SPEC.override(ranges={"value": (20, 120)}, dynamic=(), constant=(), unused=(), lesser=(), gaps=False)
    return checks.validate(events(spark, sf_dir), spec).select("series_id", "check", "signal", "detail", "n_samples")


@query("""SELECT o_orderpriority AS series_id, o_orderkey AS pos, 'o_orderstatus' AS signal, o_orderstatus AS value_text FROM orders WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL""")
def expected_rows(spark, sf_dir):
    return checks.expected_deviations(_orders(spark, sf_dir), {"o_orderstatus": "F"}).select("series_id", "pos", "signal", "value_text")


@query("""SELECT o_orderpriority AS series_id, o_orderkey AS pos, CAST(1.0 + o_orderkey % 3 AS DOUBLE) AS value_num FROM orders WHERE o_orderkey % 5 = 0""")
def sentinel_rows(spark, sf_dir):
    return checks.sentinel_deviations(_orders(spark, sf_dir), ["unused"]).select("series_id", "pos", "value_num")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'")
def sliced_rows(spark, sf_dir):
    return runs.time_slice(events(spark, sf_dir), 1_704_844_800_000_000, 1_705_060_800_000_000).select(F.col("pos").alias("event_id"), "ts")


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' AND contains(props, '7') AND starts_with(props, '{')")
def fault_messages(spark, sf_dir):
    table = _read(spark, sf_dir, "events")
    return runs.messages(table, "event_type", "props", kind="error", starts="{", holds=["7"]).select("event_id", "ts")


@query(ORACLE_SQL["fault_intervals"].replace("SELECT CAST(user_id", "SELECT series_id, count(*) AS n_spans, round(sum(seconds), 4) AS seconds FROM (SELECT CAST(user_id") + ") GROUP BY 1")
def fault_totals(spark, sf_dir):
    return runs.fault_totals(fault_intervals(spark, sf_dir)).withColumn("seconds", F.round("seconds", 4))


@query("""SELECT event_type AS series_id, 'utc' AS "check", CASE WHEN event_type < 'd' THEN 'stamps are UTC-05:00, not UTC' ELSE 'stamps are UTC+10:00, not UTC' END AS detail, count(*) AS n_samples FROM events GROUP BY event_type""")
def solar_two_sites(spark, sf_dir):
    """Series at two places, each with stamps of its own zone; the frame has columns called lat and lon."""
    near = F.col("series_id") < "d"
    place = {"lat": F.when(near, 44.5).otherwise(-33.9), "lon": F.when(near, -73.2).otherwise(151.2)}
    sun = solar.sun_position(events(spark, sf_dir).withColumns(place), F.col("us"), F.col("lat"), F.col("lon"))
    shifted = F.col("us") + F.when(near, -18_000_000_000).otherwise(36_000_000_000)
    frame = sun.select("series_id", "pos", from_micros(shifted).alias("ts"), shifted.alias("us"), "lat", "lon", F.col("sun_elevation").alias("elevation"), F.col("sun_azimuth").alias("azimuth"))
    return check_solar_angles(frame, SolarAngles("lat", "lon", elevation="elevation", azimuth="azimuth")).select("series_id", "check", "detail", "n_samples")


def _page_words(spark, sf_dir):
    """A picture for each region: a header row, and a row of words for each nation."""
    nation = _read(spark, sf_dir, "nation")
    key, image = F.col("n_nationkey"), F.col("n_regionkey").cast("string").alias("image")
    unit = F.when(key % 4 == 0, "bogus").when(key % 4 == 1, "w/sqm").otherwise("deg_C")
    value = F.when(key % 6 == 5, "n/a").otherwise((key + 0.5).cast("double").cast("string"))
    words = [(key.cast("string"), 5), (F.lit("PV"), 105), (F.lit("IEC"), 125), (F.col("n_name"), 205), (value, 405), (unit, 440)]
    y = key * 20 + 40
    body = nation.select(image, F.inline(F.array(*[F.struct(w.alias("text"), F.lit(float(x)).alias("x"), (y + F.lit(i % 3)).cast("double").alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h")) for i, (w, x) in enumerate(words)])))
    head = [("Channel", 0.0), ("Number", 20.0), ("Type", 100.0), ("Description:", 200.0), ("Data", 400.0)]
    top = nation.select(image).distinct().select("image", F.inline(F.array(*[F.struct(F.lit(w).alias("text"), F.lit(x).alias("x"), F.lit(10.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h")) for w, x in head])))
    return body.unionByName(top)


PAGE = """WITH p AS (SELECT CAST(n_regionkey AS VARCHAR) AS image, CAST(n_nationkey AS INTEGER) AS channel, n_name AS description, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE CAST(n_nationkey + 0.5 AS DOUBLE) END AS value,
  concat(CASE WHEN n_nationkey % 6 = 5 THEN 'n/a ' ELSE '' END, CASE n_nationkey % 4 WHEN 0 THEN 'bogus' WHEN 1 THEN 'w/sqm' ELSE 'deg_C' END) AS units_raw FROM nation),
c AS (SELECT image, channel, 'PV_IEC' AS type, description, value, CASE units_raw WHEN 'w/sqm' THEN 'W/Sqm' ELSE units_raw END AS units, units_raw FROM p)
"""


@query(PAGE + "SELECT * FROM c")
def status_cells(spark, sf_dir):
    return status_table.channel_table(_page_words(spark, sf_dir))


@query(PAGE + """SELECT image, channel, 'no numeric value' AS note FROM c WHERE value IS NULL UNION ALL SELECT image, channel, 'units read as w/sqm, taken as W/Sqm' FROM c WHERE units <> units_raw
UNION ALL SELECT image, channel, concat('unknown units ', units) FROM c WHERE units NOT IN ('W/Sqm', 'deg_C')
UNION ALL SELECT image, CAST(unnest(range(before + 1, channel)) AS INTEGER), 'channel is absent' FROM (SELECT image, channel, lag(channel) OVER (PARTITION BY image ORDER BY channel) AS before FROM c) WHERE channel - before > 1""")
def status_suspects(spark, sf_dir):
    return status_table.suspect_cells(status_table.channel_table(_page_words(spark, sf_dir)))


@query(ORACLE_SQL["validate_events"])
def stored_findings(spark, sf_dir):
    """validate_events written twice over, the first time with findings that are gone the second time, and read back."""
    frame = events(spark, sf_dir)
    folder, covered = f"{shared_dir(spark)}/findings-{uuid.uuid4().hex}", findings.looked_at(frame)
    findings.write_findings(checks.check_ranges(frame, {"value": (40, 60)}), folder, covered)
    for _ in range(2):
        findings.write_findings(checks.validate(frame, SPEC), folder, covered)
    order = F.create_map(*[F.lit(x) for i, c in enumerate(CHECK_ORDER) for x in (c, i)])
    return findings.read_findings(spark, folder).drop("series", "day").withColumn("check_order", F.element_at(order, F.col("check")))


@query("""SELECT event_type AS series_id, epoch_us(prev) AS start_us, epoch_us(ts) AS end_us FROM (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events)
WHERE date_diff('microsecond', prev, ts) > 7200000000 AND epoch_us(ts) <= (SELECT max(epoch_ms(ts)) * 1000 FROM events)""")
def live_gaps(spark, sf_dir):
    """events replayed as a stream; what its watermark has passed gives the batch's gaps for a cadence of half an hour."""
    session = spark.newSession()
    live.use_rocksdb(session)
    stream = session.readStream.schema(_read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may be one file
    readings = stream.select(F.col("event_type").alias("series_id"), F.lit("value").alias("signal"), F.timestamp_micros(micros(F.col("ts"))).alias("ts"), F.col("event_id").alias("pos"), "value")
    folder = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    found = live.runs(readings, 1_800_000_000, 86_400_000_000, 4, "0 seconds")
    found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(live.RUN).parquet(f"{folder}/out").filter("kind = 'gap'").select("series_id", "start_us", "end_us")

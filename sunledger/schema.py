"""Fixed shapes and the normalisations every operator relies on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALL_SIGNALS = "(all signals)"
#: One row per distinct problem. value is text or number; the other one is null.
FINDING = "series_id string, check string, signal string, detail string, value_num double, value_text string, start_ts timestamp_ntz, end_ts timestamp_ntz, duration_us bigint, n_samples bigint"
FINDING_COLUMNS = [part.strip().split(" ")[0] for part in FINDING.split(",")]
#: Order in which validate() lists its checks.
CHECK_ORDER = ("missing", "gap", "range", "equivalent", "lesser", "stall", "constant", "expected", "sentinel", "solar", "utc", "clock")


def clean(x: Column) -> Column:
    """A missing reading is NULL: Spark's NaN equals itself and is larger than all numbers."""
    return F.when(~F.isnan(x), x)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of an instant in UTC, with or without a zone."""
    return F.timestamp_diff("microsecond", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def from_micros(us: Column) -> Column:
    return F.timestamp_add("microsecond", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def number(text: Column) -> Column:
    """Text as a number, NULL where it is none."""
    return clean(text.cast("string").try_cast("double"))


def number_text(x: Column) -> Column:
    """A number's text with at least one decimal, as 1.0 or 0.25."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e16)
    return F.when(whole, F.concat(x.cast("bigint").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def span_text(us: Column) -> Column:
    """A duration as `2 days 03:04:05`."""
    seconds = F.floor(us / 1_000_000)
    return F.format_string("%d days %02d:%02d:%02d", F.floor(seconds / 86400), F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60, seconds % 60)


def as_findings(rows: DataFrame) -> DataFrame:
    """rows with whatever finding columns they lack as NULL, in the fixed order and types."""
    kinds = dict(part.strip().split(" ") for part in FINDING.split(","))
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in FINDING_COLUMNS])


def no_findings(like: DataFrame) -> DataFrame:
    """An empty findings table in the same session."""
    return like.sparkSession.createDataFrame([], T._parse_datatype_string(FINDING))

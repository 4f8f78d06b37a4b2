"""The signal frame: one row per reading time, wide signals, file order kept.

series_id: whose record it is; pos: place in the file (positional first and last rely on it);
ts: the reading's time in UTC; us: the same in microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunledger.schema import clean, micros, number

KEYS = ["series_id", "pos", "ts", "us"]


def signal_frame(df: DataFrame, ts: str | Column, pos: str | Column, signals: Sequence[str] | None = None, series_id: str | Column | None = None) -> DataFrame:
    """df as a signal frame; numeric signals have NaN as NULL."""
    col = lambda x: F.col(f"`{x}`") if isinstance(x, str) else x
    kinds = dict(df.dtypes)
    signals = list(signals) if signals is not None else [c for c in df.columns if c not in {x for x in (ts, pos, series_id) if isinstance(x, str)}]
    keep = [(clean(col(s)) if kinds[s] in ("double", "float") else col(s)).alias(s) for s in signals]
    stamp = col(ts).cast("timestamp_ntz")
    return df.select((col(series_id) if series_id is not None else F.lit("")).cast("string").alias("series_id"), col(pos).cast("bigint").alias("pos"), stamp.alias("ts"), micros(stamp).alias("us"), *keep)


def signals_of(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in KEYS]


def reading(frame: DataFrame, signal: str) -> tuple[Column, Column]:
    """A signal's reading as text and as a number (NULL where it is none)."""
    x, kind = F.col(f"`{signal}`"), dict(frame.dtypes)[signal]
    plain = kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal")
    return x.cast("string"), clean(x.cast("double")) if plain else number(x)


def long(frame: DataFrame, signals: Sequence[str], **extra: dict) -> DataFrame:
    """A row for each reading of each signal that the frame has: KEYS, signal, value_text, value_num.

    extra: name -> {signal: constant}, carried along as columns. One pass, no join.
    """
    there = [s for s in signals if s in frame.columns]

    def one(s: str) -> Column:
        text, numeric = reading(frame, s)
        return F.struct(F.lit(s).alias("signal"), text.alias("value_text"), numeric.alias("value_num"), *[F.lit(v.get(s)).alias(k) for k, v in extra.items()])

    if not there:
        return frame.select(*KEYS, F.lit("").alias("signal"), F.lit("").alias("value_text"), F.lit(0.0).alias("value_num"), *[F.lit(None).alias(k) for k in extra]).filter("false")
    return frame.select(*KEYS, F.inline(F.array(*map(one, there))))

"""Points in intervals: an equality join on bins, whatever the sizes of both sides.

The line is cut into bins of one width. An interval is split into a piece for each bin that it touches, a point lies in
one bin, so the join has keys to be dealt by, each pair is met once, and a long interval is spread over many tasks. A bin that
many points share is split by the planner, as both sides of the join are plain shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunledger.operators.runs import series_key

HOUR_US = 3_600_000_000


def interval_join(points: DataFrame, at: Column, intervals: DataFrame, lo: str, hi: str, width: float, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """points with the columns of every interval [lo, hi) that they lie in; keys: columns of both that must be equal (NULL equals NULL).

    Intervals' columns that are keys, or called as one of points', are not in the result. Intervals that are empty or have
    no ends hold nothing. how: inner, left (points in no interval stay) or left_semi. width: of a bin; the usual length of an interval is a good one.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"no such join: {how}")
    keys = keys or []
    bin_of = lambda x: F.floor(x / F.lit(width))
    whole = lambda c: series_key(F.col(f"`{c}`").cast("string"))
    last = F.greatest(bin_of(F.col("__lo")), F.ceil(F.col("__hi") / F.lit(width)) - 1)
    kept = [c for c in intervals.columns if c not in keys and c not in points.columns]
    pieces = intervals.select(F.col(f"`{lo}`").alias("__lo"), F.col(f"`{hi}`").alias("__hi"), *[whole(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in kept])
    pieces = pieces.filter("__hi > __lo").withColumn("__bin", F.explode(F.sequence(bin_of(F.col("__lo")), last)))
    rows = points.withColumns({"__at": at, "__bin": bin_of(at), **{f"__k{i}": whole(k) for i, k in enumerate(keys)}})
    left, right = rows.alias("l"), pieces.alias("r")
    on = (F.col("l.__bin") == F.col("r.__bin")) & (F.col("l.__at") >= F.col("r.__lo")) & (F.col("l.__at") < F.col("r.__hi"))
    for i in range(len(keys)):
        on = on & (F.col(f"l.__k{i}") == F.col(f"r.__k{i}"))
    joined = left.join(right, on, how)
    own = [F.col(f"l.`{c}`") for c in points.columns]
    return joined.select(*own) if how == "left_semi" else joined.select(*own, *[F.col(f"r.`{c}`") for c in kept])


def within(frame: DataFrame, intervals: DataFrame, width_us: int = HOUR_US, how: str = "inner") -> DataFrame:
    """Readings of a signal frame in the intervals (series_id, start_ts, end_ts, and what else) of their own series, ends not included."""
    from sunledger.schema import micros

    placed = intervals.withColumns({"start_us": micros(F.col("start_ts")), "end_us": micros(F.col("end_ts"))})
    return interval_join(frame, F.col("us"), placed, "start_us", "end_us", width_us, ["series_id"], how)

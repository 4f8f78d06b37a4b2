"""Runs over time: cadence, gaps, stalls, availability, windows, intervals and date bands.

Cadence, gaps and stalls read their frame once: readings are dealt by series and day, each day sends a summary (its
steps by value, first stamp, last reading), and gets back one row: the reading before it and the series' median step.
The other windows are partitioned by series and see few rows of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunledger.frame import reading
from sunledger.schema import ALL_SIGNALS, as_findings, from_micros, number_text, span_text

GAP_FACTOR = 1.5
MAX_STALL_US = 20_000_000


DAY_US, BUCKET_ROWS = 86_400_000_000, 1 << 16


def _summaries(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row for each bucket of each series in rows (__s, __bucket, us, __own and the order's columns).

    __before: __own of the last reading before the bucket; __offset: number of readings before it;
    interval: exact median of the series' steps; last_us and rows of the whole series.

    A bucket sends its steps, counted by value, its first stamp and its last reading. Over a whole series, windows see
    these, not readings; they are sorted by Spark, which spills, so no buffer grows with a series' distinct steps.
    """
    inside = Window.partitionBy("__s", "__bucket").orderBy(*order)
    step = F.col("us") - F.lag("us").over(inside)
    last = F.when(F.lead("us").over(inside).isNull(), F.col("__own"))
    # a bucket's first reading is the only one without a step, its last reading the only one with __last
    counted = rows.withColumns({"__step": step, "__last": last}).groupBy("__s", "__bucket", "__step").agg(F.count("*").alias("__n"), F.min("us").alias("__first"), F.first("__last", ignorenulls=True).alias("__last"))
    by_bucket = Window.partitionBy("__s").orderBy("__bucket")
    earlier, whole = by_bucket.rangeBetween(Window.unboundedPreceding, -1), Window.partitionBy("__s")
    counted = counted.withColumns({
        "__before": F.last("__last", ignorenulls=True).over(earlier), "__offset": F.coalesce(F.sum("__n").over(earlier), F.lit(0)),
        "rows": F.sum("__n").over(whole), "last_us": F.last("__last.us", ignorenulls=True).over(by_bucket.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    is_first = F.col("__step").isNull()
    counted = counted.withColumn("__is_first", is_first).withColumn("__step", F.when(is_first, F.col("__first") - F.col("__before.us")).otherwise(F.col("__step")))
    # ranks of steps; the very first reading has none, and NULL sorts before them
    up_to = F.sum(F.when(F.col("__step").isNotNull(), F.col("__n"))).over(Window.partitionBy("__s").orderBy("__step", "__bucket", "__is_first").rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("__to", up_to)
    steps = F.col("rows") - 1
    at = lambda rank: F.max(F.when((F.col("__to") >= rank) & (F.col("__to") - F.col("__n") < rank), F.col("__step"))).over(whole)
    median = (at(F.floor((steps + 1) / 2)) + at(F.ceil((steps + 1) / 2))) / 2
    return counted.withColumn("interval", median.cast("double")).filter("__is_first").select("__s", "__bucket", "__before", "__offset", "interval", "last_us", "rows")


def series_of(key: Column) -> Column:
    return F.when(key != "", F.substring(key, 2, 1 << 30)).alias("series_id")


def series_key(series_id: Column) -> Column:
    """A key that is never NULL, so that series without an id meet their own numbers in joins."""
    return F.coalesce(F.concat(F.lit("="), series_id), F.lit(""))


def _bucketed(frame: DataFrame, by_time: bool, carried: list[str]) -> tuple[DataFrame, list[str]]:
    bucket = F.floor(F.col("us") / DAY_US) if by_time else F.floor(F.col("pos") / BUCKET_ROWS)
    keyed = frame.withColumns({"__s": series_key(F.col("series_id")), "__bucket": bucket, "__own": F.struct("us", *carried)})
    # summaries and readings need the same columns under the same filter, so Spark deals them once for both: series_id is in __s
    rows = keyed.filter("us IS NOT NULL AND __bucket IS NOT NULL").drop("series_id")
    return rows, (["us", "pos"] if by_time else ["pos"])


def paced(frame: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """frame's readings by time, with `own` and `before` (structs of us and carried, of the reading and of the one before; NULL for a series' first), `nr` (from 1),
    interval (exact median step of the series, NULL with less than two readings), last_us and rows of the series.

    Readings are dealt by series and day, once; windows run inside a day, and what a day needs to know of the others is one row.
    Readings without a stamp have no place in time and are left out. __s and __bucket say how the rows are dealt.
    """
    rows, order = _bucketed(frame, True, carried or [])
    inside = F.lag("__own").over(Window.partitionBy("__s", "__bucket").orderBy(*order))
    nr = F.row_number().over(Window.partitionBy("__s", "__bucket").orderBy(*order))
    placed = rows.withColumns({"__inside": inside, "__nr": nr}).join(_summaries(rows, order), ["__s", "__bucket"])
    return placed.withColumns({"series_id": series_of(F.col("__s")), "before": F.coalesce("__inside", "__before"), "nr": F.col("__offset") + F.col("__nr")}).drop("__inside", "__before", "__nr", "__offset").withColumnRenamed("__own", "own")


def sampling_interval(frame: DataFrame, in_time_order: bool = False) -> DataFrame:
    """series_id, interval_us: exact median of consecutive steps, in file order unless told otherwise."""
    rows, order = _bucketed(frame.select("series_id", "pos", "us"), in_time_order, [])
    return _summaries(rows, order).filter("__before IS NULL").select(series_of(F.col("__s")), F.col("interval").alias("interval_us"))


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and median of value: equal values are counted first, then ranked by Spark's sort, so no buffer grows with them.

    The average of the middle two of an even number; NULL and NaN do not count. Keys may be NULL.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*keys)
    counted = counted.withColumns({"__to": F.sum("__n").over(whole.orderBy(value)), "__all": F.sum("__n").over(whole)})
    low, high = F.floor((F.col("__all") + 1) / 2), F.ceil((F.col("__all") + 1) / 2)
    middle = counted.filter((F.col("__to") >= low) & (F.col("__to") - F.col("__n") < high))
    return middle.groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).cast("double").alias("median"))


def _is_gap(gap_factor: float) -> Column:
    return F.coalesce((F.col("interval") > 0) & (F.col("us") - F.col("before.us") > gap_factor * F.col("interval")), F.lit(False))


def _missing_in_gap() -> Column:
    return (F.rint((F.col("us") - F.col("before.us")) / F.col("interval")) - 1).cast("bigint")


def gap_runs(frame: DataFrame, gap_factor: float = GAP_FACTOR) -> DataFrame:
    """Steps wider than gap_factor medians: series_id, start_ts, end_ts, duration_us, n_missing."""
    wide = paced(frame.select("series_id", "pos", "us")).filter(_is_gap(gap_factor))
    before = F.col("before.us")
    return wide.select("series_id", from_micros(before).alias("start_ts"), from_micros(F.col("us")).alias("end_ts"), (F.col("us") - before).alias("duration_us"), _missing_in_gap().alias("n_missing"))


def _held_runs(frame: DataFrame, signals: list[str], gaps: bool, max_stall_us: float | Column, windows: dict[str, float] | None, decimals: int | None, gap_factor: float, in_medians: bool) -> DataFrame:
    """Stalls of signals, and gaps where asked for (signal NULL): series_id, signal, value, us, end, n (a gap's: missing samples).

    A day hands on one row for each signal: the runs that it could finish, its first start and its last, open one.
    """
    seen = lambda x: F.bround(x, decimals) if decimals is not None else x
    there = [s for s in signals if s in frame.columns]
    values = F.array(*[reading(frame, s)[1] for s in there]) if there else F.array().cast("array<double>")
    rows = paced(frame.select("series_id", "pos", "us", values.alias("__v")), ["__v"]).withColumn("gap", _is_gap(gap_factor))

    def one(i: int, s: str) -> Column:
        window = max_stall_us if isinstance(max_stall_us, Column) else F.lit(float((windows or {}).get(s, max_stall_us)))
        limit = window * F.col("interval") if in_medians else window
        refused = F.when(limit < F.col("interval"), F.raise_error(F.lit(f"max_stall is below the sampling interval of {s}"))).otherwise(limit)
        value = F.col("own.__v")[i]  # not the column itself: see _bucketed
        starts = F.col("interval").isNotNull() & (F.col("before").isNull() | F.col("gap") | ~seen(value).eqNullSafe(seen(F.col("before.__v")[i])))
        return F.struct(F.lit(s).alias("signal"), value.alias("value"), refused.cast("double").alias("limit"), starts.alias("starts"))

    tests = [one(i, s) for i, s in enumerate(there)]
    if gaps:
        tests.append(F.struct(F.lit(None).cast("string").alias("signal"), F.lit(None).cast("double").alias("value"), F.lit(0.0).alias("limit"), F.col("gap").alias("starts")))
    keys = ["__s", "__bucket", "signal"]
    starts = rows.select("__s", "__bucket", "us", "pos", "nr", "gap", F.col("before.us").alias("prev_us"), "interval", "last_us", "rows", F.inline(F.array(*tests))).filter("starts")
    following = F.lead(F.struct("us", "gap", "prev_us", "nr")).over(Window.partitionBy(*keys).orderBy("us", "pos"))
    starts = starts.withColumn("following", following)

    def run(of: str, end: Column, n: Column) -> Column:
        return F.struct(F.col(f"{of}value").alias("value"), F.col(f"{of}us").alias("us"), end.alias("end"), n.cast("bigint").alias("n"))

    def until(what: str) -> Column:
        return F.when(F.col(f"{what}.gap"), F.col(f"{what}.prev_us")).otherwise(F.col(f"{what}.us"))

    is_gap = F.col("signal").isNull()
    missing = (F.rint((F.col("us") - F.col("prev_us")) / F.col("interval")) - 1).cast("bigint")
    gap_run = F.struct(F.lit(None).cast("double").alias("value"), F.col("prev_us").alias("us"), F.col("us").alias("end"), missing.alias("n"))
    held = F.col("following").isNotNull() & F.col("value").isNotNull() & (until("following") - F.col("us") > F.col("limit"))
    done = F.when(is_gap, gap_run).when(held, run("", until("following"), F.col("following.nr") - F.col("nr")))
    place = F.struct("us", "pos")
    days = starts.groupBy(*keys).agg(
        F.collect_list(done).alias("done"), F.min_by(F.struct("us", "gap", "prev_us", "nr"), place).alias("first"),
        F.max_by(F.struct("us", "value", "limit", "nr"), place).alias("open"), F.first("last_us").alias("last_us"), F.first("rows").alias("rows"),
    )
    days = days.withColumn("after", F.lead("first").over(Window.partitionBy("__s", "signal").orderBy("__bucket")))
    end = F.when(F.col("after").isNull(), F.col("last_us")).otherwise(until("after"))
    n = F.coalesce(F.col("after.nr"), F.col("rows") + 1) - F.col("open.nr")
    outlasts = F.col("signal").isNotNull() & F.col("open.value").isNotNull() & (end - F.col("open.us") > F.col("open.limit"))
    last = F.when(outlasts, F.array(run("open.", end, n))).otherwise(F.array())
    return days.select(series_of(F.col("__s")), "signal", F.inline(F.concat("done", last)))


def stall_runs(frame: DataFrame, signals: list[str], max_stall_us: float | Column = MAX_STALL_US, windows: dict[str, float] | None = None, decimals: int | None = None, gap_factor: float = GAP_FACTOR, in_medians: bool = False) -> DataFrame:
    """Runs of one value that outlast their window, never joined across a gap.

    series_id, signal, value (unrounded, of the first reading), start_ts, end_ts, duration_us, n_samples.
    A run ends where the next of its segment starts; the last at its segment's last reading.
    in_medians: windows are multiples of the series' median step. A window below the median step is refused.
    """
    held = _held_runs(frame, signals, False, max_stall_us, windows, decimals, gap_factor, in_medians)
    return held.select("series_id", "signal", "value", from_micros(F.col("us")).alias("start_ts"), from_micros(F.col("end")).alias("end_ts"), (F.col("end") - F.col("us")).alias("duration_us"), F.col("n").alias("n_samples"))


def expected_periods(start_us: int, end_us: int, interval_us: int) -> int:
    """Slots of whole days from start to end (UTC microseconds)."""
    if interval_us <= 0:
        raise ValueError("the interval must be positive")
    if end_us < start_us:
        raise ValueError("the end is before the start")
    day = 86_400_000_000
    return (end_us // day * day + day - start_us // day * day) // interval_us


def _presence(frame: DataFrame, n: int, origin: int, interval_us: int) -> DataFrame:
    """series_id, block and bits of each block of slots with a reading; a row with neither for a series without any in 0..n-1."""
    slot = F.rint((F.col("us") - F.lit(origin)) / F.lit(interval_us)).cast("bigint")
    kept = F.when(slot.between(0, n - 1), slot + 1)
    return frame.groupBy("series_id", F.bitmap_bucket_number(kept).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(kept)).alias("bits"))


BLOCK_SLOTS = 32768  # of a bitmap of Spark's
ABSENT = "series_id string, block long, least long, most long, runs array<struct<before:long,after:long>>"


def _absent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block of presence: its first and last slot with a reading, and pairs of such slots with none between them."""
    for batch in batches:
        least, most, runs = [], [], []
        for block, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            there = np.flatnonzero(np.unpackbits(np.frombuffer(bits or b"", np.uint8), bitorder="little")) + ((block or 1) - 1) * BLOCK_SLOTS
            wide = np.flatnonzero(np.diff(there) > 1)
            least.append(int(there[0]) if len(there) else None)
            most.append(int(there[-1]) if len(there) else None)
            runs.append([{"before": int(a), "after": int(b)} for a, b in zip(there[wide], there[wide + 1], strict=True)])
        kind = pa.list_(pa.struct([("before", pa.int64()), ("after", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("series_id"), batch.column("block"), pa.array(least, pa.int64()), pa.array(most, pa.int64()), pa.array(runs, kind)], ["series_id", "block", "least", "most", "runs"])


def availability(frame: DataFrame, start_us: int, end_us: int, interval_us: int) -> tuple[DataFrame, DataFrame]:
    """Share of expected slots with a reading (series_id, n_expected, n_present, percent), and the runs of empty ones.

    Readings become a bit each in bitmaps of 32768 slots, before they are shuffled; a window over a series sees a row for each bitmap.
    """
    n = expected_periods(start_us, end_us, interval_us)
    origin = start_us // 86_400_000_000 * 86_400_000_000
    presence = _presence(frame, n, origin, interval_us)
    share = presence.groupBy("series_id").agg(F.lit(n).cast("bigint").alias("n_expected"), F.coalesce(F.sum(F.when(F.col("block").isNotNull(), F.bitmap_count("bits"))), F.lit(0)).cast("bigint").alias("n_present"))
    share = share.withColumn("percent", F.col("n_present") * 100.0 / F.col("n_expected"))
    blocks = presence.mapInArrow(_absent, ABSENT)
    by_block = Window.partitionBy("series_id").orderBy("block")
    before = F.coalesce(F.last("most", ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1).cast("long"))
    pair = lambda a, b: F.struct(a.alias("before"), b.alias("after"))
    blocks = blocks.withColumns({"before": before, "is_last": F.lead(F.lit(1)).over(by_block).isNull()})
    to_first = F.when(F.col("least").isNotNull(), F.array(pair(F.col("before"), F.col("least")))).otherwise(F.array())
    to_end = F.when(F.col("is_last"), F.array(pair(F.coalesce("most", F.col("before")), F.lit(n).cast("long")))).otherwise(F.array())
    runs = blocks.select("series_id", F.inline(F.concat(to_first, "runs", to_end))).filter("after - before > 1")
    at = lambda c: from_micros(F.lit(origin) + c * F.lit(interval_us))
    missing = runs.select("series_id", at(F.col("before") + 1).alias("start_ts"), at(F.col("after")).alias("end_ts"), (F.col("after") - F.col("before") - 1).alias("n_missing"))
    return share, missing


def windows_over(track: DataFrame, value: str, threshold: float, peak_columns: list[str]) -> DataFrame:
    """Runs of readings over a threshold: start_ts, end_ts (last plus the median step), duration_us, peak and columns at the (first) peak."""
    w = Window.partitionBy("series_id").orderBy("us", "pos")
    over = F.coalesce(F.col(value) > threshold, F.lit(False))
    rows = track.withColumns({"over": over, "step": F.col("us") - F.lag("us").over(w)})
    rows = rows.withColumn("run", F.sum((F.col("over") & ~F.coalesce(F.lag("over").over(w), F.lit(False))).cast("int")).over(w))
    step = exact_median(rows, ["series_id"], "step").withColumn("median", F.col("median").cast("bigint"))
    best = F.struct(F.col(value), -F.col("us"))
    runs = rows.filter("over").groupBy("series_id", "run").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.max(value).alias("peak"), *[F.max_by(c, best).alias(c) for c in peak_columns])
    keyed = lambda df: df.withColumn("__s", series_key(F.col("series_id")))
    runs = keyed(runs).join(keyed(step).drop("series_id"), "__s").withColumn("end", F.col("last") + F.coalesce("median", F.lit(0)))
    return runs.select("series_id", from_micros(F.col("first")).alias("start_ts"), from_micros(F.col("end")).alias("end_ts"), (F.col("end") - F.col("first")).alias("duration_us"), "peak", *peak_columns)


def fault_intervals(events: DataFrame, on: Column) -> DataFrame:
    """Intervals from the first event that is on after one that is off to the next that is off.

    events: series_id, pos, ts, us. An open interval ends at the log's last event, whatever the series.
    """
    w = Window.partitionBy("series_id").orderBy("us", "pos")
    rows = events.withColumn("on", on).withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False)))
    edges = rows.filter("on <> was").withColumn("until", F.lead("us").over(w))
    last = events.agg(F.max("us").alias("log_end"))
    out = edges.filter("on").crossJoin(F.broadcast(last)).withColumn("end", F.coalesce("until", "log_end"))  # one row
    return out.select("series_id", F.col("ts").alias("start_ts"), from_micros(F.col("end")).alias("end_ts"), ((F.col("end") - F.col("us")) / 1e6).alias("seconds"))


def messages(log: DataFrame, kind_column: str, text_column: str, kind: str | None = None, starts: str | None = None, holds: list[str] | None = None) -> DataFrame:
    """Rows of a log of one kind whose text starts with `starts` and has all of `holds` in it, as they stand; what is None is not asked for."""
    kind_of, text = F.col(f"`{kind_column}`"), F.col(f"`{text_column}`")
    asked = [kind_of == kind] if kind is not None else []
    asked += [text.startswith(starts)] if starts is not None else []
    asked += [text.contains(x) for x in holds or []]
    for one in asked:
        log = log.filter(one)
    return log


def fault_totals(intervals: DataFrame) -> DataFrame:
    """series_id, n_spans, seconds: how often and how long a series was on. intervals: as of fault_intervals."""
    return intervals.groupBy("series_id").agg(F.count("*").alias("n_spans"), F.sum("seconds").alias("seconds"))


def time_slice(frame: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Readings from start to end, both ends included."""
    return frame.filter(F.col("us").between(F.lit(start_us), F.lit(end_us)))


def date_bands(dates: DataFrame) -> DataFrame:
    """Runs of consecutive dates: series_id, start_date, end_date, n_days. dates: series_id, date (distinct)."""
    w = Window.partitionBy("series_id").orderBy("date")
    island = F.date_sub("date", F.row_number().over(w))
    return dates.withColumn("island", island).groupBy("series_id", "island").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n_days")).drop("island")


def _as_gaps(runs: DataFrame) -> DataFrame:
    """runs: series_id, start_ts, end_ts, duration_us, n_missing."""
    detail = F.concat(F.lit("no data for "), span_text(F.col("duration_us")), F.lit(" (~"), F.col("n_missing").cast("string"), F.lit(" samples missing)"))
    return as_findings(runs.withColumns({"check": F.lit("gap"), "signal": F.lit(ALL_SIGNALS), "detail": detail, "value_num": F.col("n_missing"), "n_samples": F.lit(0)}))


def gap_findings(frame: DataFrame, gap_factor: float = GAP_FACTOR) -> DataFrame:
    return _as_gaps(gap_runs(frame, gap_factor))


def stall_findings(frame: DataFrame, signals: list[str], **options) -> DataFrame:
    runs = stall_runs(frame, signals, **options)
    detail = F.concat(F.lit("held "), number_text(F.col("value")), F.lit(" for "), span_text(F.col("duration_us")))
    return as_findings(runs.withColumns({"check": F.lit("stall"), "detail": detail, "value_num": F.col("value")}))


def run_findings(frame: DataFrame, signals: list[str], max_stall_us: float | Column = MAX_STALL_US, windows: dict[str, float] | None = None, decimals: int | None = None, gap_factor: float = GAP_FACTOR) -> DataFrame:
    """gap_findings and stall_findings together, from one pass over the frame."""
    runs = _held_runs(frame, signals, True, max_stall_us, windows, decimals, gap_factor, False).withColumn("took", F.col("end") - F.col("us"))
    is_gap = F.col("signal").isNull()
    gap = F.concat(F.lit("no data for "), span_text(F.col("took")), F.lit(" (~"), F.col("n").cast("string"), F.lit(" samples missing)"))
    stall = F.concat(F.lit("held "), number_text(F.col("value")), F.lit(" for "), span_text(F.col("took")))
    return as_findings(runs.select(
        "series_id", F.when(is_gap, F.lit("gap")).otherwise("stall").alias("check"), F.coalesce("signal", F.lit(ALL_SIGNALS)).alias("signal"), F.when(is_gap, gap).otherwise(stall).alias("detail"), F.when(is_gap, F.col("n")).otherwise(F.col("value")).alias("value_num"),
        from_micros(F.col("us")).alias("start_ts"), from_micros(F.col("end")).alias("end_ts"), F.col("took").alias("duration_us"), F.when(is_gap, F.lit(0)).otherwise(F.col("n")).alias("n_samples"),
    ))

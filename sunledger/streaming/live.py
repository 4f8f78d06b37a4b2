"""Checks of a live stream: range counts by window, sessions that end at gaps, and stalls as they happen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from sunledger.operators.runs import GAP_FACTOR

STALL = "series_id string, signal string, value double, start_us bigint, end_us bigint, n_samples bigint"
DAY_US = 86_400_000_000
#: Readings that a task sorts together, and most of them in one pack.
GATHERED, PACK = 1 << 18, 1 << 13
RUN = "series_id string, signal string, kind string, value double, start_us bigint, end_us bigint, n_samples bigint"


def range_counts(readings: DataFrame, lo: float, hi: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """readings: series_id, signal, ts (TIMESTAMP), value. Rows and rows outside [lo, hi] of each window; later rows are dropped."""
    bad = ~F.coalesce(F.col("value").between(lo, hi), F.lit(False))
    grouped = readings.withWatermark("ts", late).groupBy(F.window("ts", window), "series_id", "signal")
    return grouped.agg(F.count("*").alias("rows"), F.count_if(bad).alias("n_samples")).select(F.col("window.start").alias("start_ts"), F.col("window.end").alias("end_ts"), "series_id", "signal", "rows", "n_samples")


def sessions(readings: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Gap-free stretches of each series: a new one starts after no reading for `gap`."""
    return readings.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "series_id").agg(F.count("*").alias("n_samples")).select(F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "series_id", "n_samples")


def stalls(readings: DataFrame, max_stall_us: int) -> DataFrame:
    """Runs of one value that have ended and outlasted max_stall_us. State: value, start, last reading and count of each signal.

    For readings that come in order: each is judged as it comes, gaps do not end a run, and no state expires (see runs).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else None
        out = []
        for batch in batches:
            for us, value in batch.sort_values("us")[["us", "value"]].itertuples(index=False):
                value = None if pd.isna(value) else float(value)
                if held and held[0] == value:
                    held[2], held[3] = int(us), held[3] + 1
                    continue
                if held and held[0] is not None and us - held[1] > max_stall_us:
                    out.append((*key, held[0], held[1], int(us), held[3]))
                held = [value, int(us), int(us), 1]
        if held:
            state.update(tuple(held))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STALL.split(", ")])

    rows = readings.select("series_id", "signal", F.unix_micros("ts").alias("us"), "value")
    return rows.groupBy("series_id", "signal").applyInPandasWithState(step, STALL, "value double, start_us bigint, last_us bigint, n bigint", "append", GroupStateTimeout.NoTimeout)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Readings of a task, by series and signal and in order of time: one row holds up to PACK of GATHERED readings read together."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= GATHERED:
            yield _packed(pa.Table.from_batches(waiting))
            waiting = []
    if sum(map(len, waiting)):
        yield _packed(pa.Table.from_batches(waiting))


def _packed(rows: pa.Table) -> pa.RecordBatch:
    series, signal = (rows[c].combine_chunks().dictionary_encode("encode") for c in ("series_id", "signal"))
    us, pos = rows["us"].to_numpy(), pc.fill_null(rows["pos"], 0).to_numpy()
    value = pc.fill_null(rows["value"], float("nan")).to_numpy()
    keys = [np.asarray(series.indices), np.asarray(signal.indices)]
    order = np.lexsort((us, *keys))
    new = _starts([k[order] for k in keys])
    nr = np.arange(len(order))
    new = np.flatnonzero((nr - np.repeat(new, np.diff(np.append(new, len(order))))) % PACK == 0)
    table = np.stack([us, pos, value.view(np.int64)])[:, order]
    parts = [table[:, a:b].tobytes() for a, b in zip(new, np.append(new[1:], len(order)), strict=True)]
    last = us[order][np.append(new[1:], len(order)) - 1]
    heads = pa.array(order[new])
    return pa.record_batch([series.dictionary.take(series.indices.take(heads)), signal.dictionary.take(signal.indices.take(heads)), pa.array(last).cast(pa.timestamp("us", "UTC")), pa.array(parts, pa.binary())], names=["series_id", "signal", "ts", "readings"])


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where any of the keys differs from the row before."""
    return np.flatnonzero(np.concatenate([[True], np.any([np.diff(k) != 0 for k in keys], axis=0)]))


def _unpacked(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """us, pos and value (NaN: none) in order of time."""
    us, pos, value = np.concatenate([np.frombuffer(p, np.int64).reshape(3, -1) for p in parts], axis=1)
    order = np.lexsort((pos, us))
    return us[order], pos[order], value.view(np.float64)[order]


class _Runs(StatefulProcessor):
    """Readings wait until the watermark has passed them, and are then taken in order of time: late ones fall into place.

    State of a key: the readings that wait, packed by day (so one day of a series is in memory at a time), and the run that
    is open (value, start, last reading, count) with the time up to which readings have been taken.
    """

    def __init__(self, interval_us: int, gap_factor: float, max_stall_us: int, forget_us: int) -> None:
        self.gap_us, self.max_stall_us, self.forget_us = interval_us * gap_factor, max_stall_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day bigint, nr bigint", "readings binary")
        self.packs = handle.getValueState("packs", "n bigint")
        self.open = handle.getValueState("open", "value double, start_us bigint, last_us bigint, n bigint, taken_us bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        ends: list[int] = []
        taken = self.open.get()[4] if self.open.exists() else None
        tables: list[np.ndarray] = []
        for batch in rows:
            for pack in batch["readings"]:
                table = np.frombuffer(pack, np.int64).reshape(3, -1)
                if taken is not None:
                    table = table[:, table[0] > taken]  # the others come too late
                if table.size:
                    ends = [min([int(table[0].min()), *ends]), max([int(table[0].max()), *ends])]
                    tables.append(table)
                if sum(t.shape[1] for t in tables) >= 4 * GATHERED:
                    self._wait(tables)
                    tables = []
        if tables:
            self._wait(tables)
        for us in set(ends):  # at the first, what the watermark has passed by then is taken
            self.handle.registerTimer(us // 1000 + 1)
        yield _rows(key, [])

    def _wait(self, tables: list[np.ndarray]) -> None:
        n = self.packs.get()[0] if self.packs.exists() else 0
        table = np.concatenate(tables, axis=1)
        table = table[:, np.argsort(table[0], kind="stable")]
        day = table[0] // DAY_US
        at = _starts([day])
        for a, b in zip(at, np.append(at[1:], len(day)), strict=True):
            self.waiting.updateValue((int(day[a]), n), (table[:, a:b].tobytes(),))
        self.packs.update((n + 1,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.open.get())[:4] if self.open.exists() else None
        packs: dict[int, list[int]] = {}
        for day, nr in list(self.waiting.keys()):
            packs.setdefault(day, []).append(nr)
        n = sum(map(len, packs.values()))
        for day in sorted(packs):
            if day * DAY_US > passed:
                break
            nrs = sorted(packs.pop(day))
            us, pos, value = _unpacked([self.waiting.getValue((day, nr))[0] for nr in nrs])
            ready = int(np.searchsorted(us, passed, side="right"))
            for nr in nrs[ready < len(us) :]:
                self.waiting.removeKey((day, nr))
            if ready < len(us):
                packs[day] = nrs[:1]
                self.waiting.updateValue((day, nrs[0]), (np.stack([us, pos, value.view(np.int64)])[:, ready:].tobytes(),))
            if ready:
                held, out = self._taken(key, held, us[:ready], value[:ready])
                yield out
        rest = bool(packs)
        if n and not rest:
            self.packs.clear()
        out = []
        forgotten = held is not None and passed - held[2] > self.forget_us
        if held is not None and held[1] is not None and (forgotten or (not rest and passed - held[2] > self.gap_us)):
            if held[0] is not None and held[2] - held[1] > self.max_stall_us:
                out.append(("stall", held[0], held[1], held[2], held[3]))  # whatever comes next comes after a gap, so this run is over
            if not rest:
                out.append(("silence", None, held[2], None, 0))
            held = [None, None, held[2], 0]
        if forgotten:
            held = None
            self.open.clear()
        if held is not None:
            self.open.update((*held, passed))
            if not rest:
                wait = self.gap_us if held[1] is not None else self.forget_us
                self.handle.registerTimer(int((held[2] + wait) // 1000) + 1)
        yield _rows(key, out)

    def _taken(self, key: tuple, held: list | None, us: np.ndarray, value: np.ndarray) -> tuple[list, pd.DataFrame]:
        """The run that is open after these readings, and what has ended with them."""
        last, before = (us[0], np.nan) if held is None else (held[2], np.nan if held[0] is None else held[0])
        prev, prev_value = np.append(last, us[:-1]), np.append(before, value[:-1])
        gap = us - prev > self.gap_us
        starts = gap | ~((value == prev_value) | (np.isnan(value) & np.isnan(prev_value)))
        starts[0] |= held is None or held[1] is None
        at = np.flatnonzero(starts)
        # runs that were open before each start; the first is the held one, perhaps of no reading
        open_us = np.append(-1 if held is None or held[1] is None else held[1], us[at])
        open_n = np.diff(np.concatenate([[0], at, [len(us)]]))
        open_n[0] += 0 if held is None else held[3]
        ends = np.where(gap, prev, us)[at]
        there = np.full(len(at), True)
        there[:1] = held is not None and held[1] is not None
        stall = there & ~np.isnan(prev_value[at]) & (ends - open_us[:-1] > self.max_stall_us)
        wide = gap[at]
        found = [pd.DataFrame({"kind": "stall", "value": prev_value[at][stall], "start_us": open_us[:-1][stall], "end_us": ends[stall], "n_samples": open_n[:-1][stall]}),
                 pd.DataFrame({"kind": "gap", "value": np.nan, "start_us": prev[at][wide], "end_us": us[at][wide], "n_samples": 0})]
        held = [None if np.isnan(value[-1]) else float(value[-1]), int(open_us[-1]), int(us[-1]), int(open_n[-1])]
        return held, _rows(key, pd.concat(found))

    def close(self) -> None:
        pass


def _rows(key: tuple, found: list[tuple] | pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in RUN.split(", ")]
    frame = pd.DataFrame(found, columns=names[2:]).assign(series_id=key[0], signal=key[1])[names]
    return frame.astype({"start_us": "Int64", "end_us": "Int64", "n_samples": "int64", "value": "float64"})


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that `runs` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def runs(readings: DataFrame, interval_us: int, max_stall_us: int, gap_factor: float = GAP_FACTOR, late: str = "10 minutes", forget_us: int = 86_400_000_000) -> DataFrame:
    """Gaps and stalls as they end, and silences as they begin: series_id, signal, kind, value, start_us, end_us, n_samples.

    readings: series_id, signal, ts (TIMESTAMP), pos, value; those without a stamp are left out. A reading may come up to `late` after a
    younger one; what comes later is dropped once its series has been judged past it. Gaps and stalls are those of the batch operators for
    a cadence of interval_us. A series is silent once it has sent nothing for gap_factor intervals (by the watermark): its open run
    ends, and forget_us later its state goes; a reading after that begins anew, without a gap. Needs the RocksDB state store (see use_rocksdb).
    """
    rows = readings.filter("ts IS NOT NULL").select("series_id", "signal", F.unix_micros("ts").alias("us"), "pos", "value")
    packs = rows.mapInArrow(_pack, "series_id string, signal string, ts timestamp, readings binary").withWatermark("ts", late)
    keyed = packs.groupBy("series_id", "signal")
    return keyed.transformWithStateInPandas(statefulProcessor=_Runs(interval_us, gap_factor, max_stall_us, forget_us), outputStructType=RUN, outputMode="Append", timeMode="EventTime")

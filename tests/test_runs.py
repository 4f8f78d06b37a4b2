import datetime as dt

import pytest
from pyspark.sql import functions as F

from sunledger.frame import signal_frame
from sunledger.operators import runs

START = dt.datetime(2024, 5, 1)
MINUTE = 60_000_000


def frame(spark, values, minutes=None, step=1):
    minutes = list(minutes) if minutes is not None else [i * step for i in range(len(values))]
    rows = [(i, START + dt.timedelta(minutes=m), None if v is None else float(v)) for i, (m, v) in enumerate(zip(minutes, values, strict=True))]
    return signal_frame(spark.createDataFrame(rows, "pos bigint, ts timestamp_ntz, x double"), "ts", "pos", ["x"])


def day(spark, keep):
    """Ten-minute readings of one day, those of `keep`."""
    return frame(spark, [float(i) for i in keep], [10 * i for i in keep])


def held(f, **options):
    return sorted((r["value"], r["duration_us"] // MINUTE, r["n_samples"]) for r in runs.stall_runs(f, ["x"], **options).collect())


def test_two_runs_end_where_the_next_starts(spark):
    assert held(frame(spark, [1.0] * 30 + [2.0] * 30), max_stall_us=10 * MINUTE) == [(1.0, 30, 30), (2.0, 29, 30)]


def test_a_hold_is_not_joined_across_a_gap(spark):
    minutes = [*range(20), *range(360, 380)]
    assert held(frame(spark, [5.0] * 40, minutes), max_stall_us=10 * MINUTE) == [(5.0, 19, 20), (5.0, 19, 20)]


def test_missing_readings_are_no_stall(spark):
    assert held(frame(spark, [None] * 40), max_stall_us=10 * MINUTE) == []
    assert held(frame(spark, [float("nan")] * 40), max_stall_us=10 * MINUTE) == []


def test_rounding_decides_but_the_raw_value_is_shown(spark):
    dither = frame(spark, [1 + i * 1e-6 for i in range(40)])
    assert held(dither, max_stall_us=10 * MINUTE) == []
    assert held(dither, max_stall_us=10 * MINUTE, decimals=3) == [(1.0, 39, 40)]
    assert held(frame(spark, [1.23456] * 40), max_stall_us=10 * MINUTE, decimals=2)[0][0] == 1.23456


def test_a_window_below_the_cadence_is_refused(spark):
    with pytest.raises(Exception, match="sampling interval"):
        held(frame(spark, [1.0] * 10), max_stall_us=1_000_000)


def test_one_row_has_no_stall_and_no_gap(spark):
    one = frame(spark, [1.0])
    assert held(one, max_stall_us=MINUTE) == [] and runs.gap_runs(one).count() == 0


def test_a_hole_is_one_gap_and_one_run_of_missing_slots(spark):
    hole = day(spark, [i for i in range(144) if not 72 <= i <= 77])
    gap = runs.gap_runs(hole).collect()
    assert len(gap) == 1 and gap[0]["n_missing"] == 6
    us = hole.agg(F.min("us")).first()[0]
    share, missing = runs.availability(hole, us, us, 10 * MINUTE)
    assert share.first()["n_present"] == 138 and share.first()["n_expected"] == 144
    run = missing.collect()
    assert len(run) == 1 and run[0]["n_missing"] == 6 and (run[0]["end_ts"] - run[0]["start_ts"]).total_seconds() == 3600


def test_a_late_start_is_missing_but_no_gap(spark):
    late = day(spark, range(36, 144))
    us = late.agg(F.min("us")).first()[0]
    share, missing = runs.availability(late, us, us, 10 * MINUTE)
    assert runs.gap_runs(late).count() == 0 and share.first()["percent"] == 75 and missing.count() == 1


def test_availability_refuses_bad_arguments(spark):
    with pytest.raises(ValueError):
        runs.expected_periods(0, 1, 0)
    with pytest.raises(ValueError):
        runs.expected_periods(10, 1, 5)


def test_windows_over_a_threshold(spark):
    track = frame(spark, [0.5, 0, 0, 0.5, 0.7, 0, 0.5])
    found = sorted((r["start_ts"].minute, r["duration_us"] // MINUTE, r["peak"]) for r in runs.windows_over(track, "x", 0.01, []).collect())
    assert found == [(0, 1, 0.5), (3, 2, 0.7), (6, 1, 0.5)]
    assert runs.windows_over(frame(spark, [0.0, 0.0]), "x", 0.01, []).count() == 0


def test_an_open_fault_ends_with_the_log(spark):
    events = frame(spark, [0, 1, 1, 0, 1, 0.0])
    found = sorted((r["start_ts"].minute, r["seconds"]) for r in runs.fault_intervals(events, F.col("x") == 1).collect())
    assert found == [(1, 120.0), (4, 60.0)]
    assert [r["seconds"] for r in runs.fault_intervals(frame(spark, [0, 1, 1]), F.col("x") == 1).collect()] == [60.0]


def by_hand(rows, factor, window, decimals):
    """Gaps and stalls of one series' (us, pos, value) rows."""
    rows = sorted(rows)
    steps = sorted(b[0] - a[0] for a, b in zip(rows, rows[1:], strict=False))
    if not steps:
        return [], []
    median = (steps[(len(steps) - 1) // 2] + steps[len(steps) // 2]) / 2
    gaps, runs = [], []
    segments = [[rows[0]]]
    for a, b in zip(rows, rows[1:], strict=False):
        if median > 0 and b[0] - a[0] > factor * median:
            gaps.append((a[0], b[0]))
            segments.append([])
        segments[-1].append(b)
    for segment in segments:
        starts = [i for i, r in enumerate(segment) if not i or seen(r[2], decimals) != seen(segment[i - 1][2], decimals)]
        for i, j in zip(starts, [*starts[1:], None], strict=True):
            end = segment[j][0] if j is not None else segment[-1][0]
            if segment[i][2] is not None and end - segment[i][0] > window:
                runs.append((segment[i][2], segment[i][0], end, (j if j is not None else len(segment)) - i))
    return gaps, runs


def seen(value, decimals):
    return None if value is None else round(value, decimals)


def test_runs_of_many_days_series_and_signals_against_brute_force(spark):
    import random

    rnd = random.Random(4)
    rows, pos = [], 0
    for series in ("a", "b", None, "", "one"):
        us, held = 1_700_000_000_000_000, [1.0, 2.0]
        for _ in range(1 if series == "one" else 1500):
            us += rnd.choice([60, 60, 60, 61, 75, 0]) * 1_000_000 + rnd.choice([0, 0, rnd.randrange(999_999)]) + (rnd.random() < 0.01) * rnd.randrange(20 * 86_400_000_000)
            held = [rnd.choice([None, 0.5, 1.04, 1.06]) if rnd.random() < 0.03 else v for v in held]
            rows.append((series, pos := pos + 1, us, *held))
    rnd.shuffle(rows)
    rows.append(("a", 0, None, 9.0, 9.0))  # no stamp, no place in time
    df = spark.createDataFrame(rows, "s string, pos bigint, us bigint, x double, y double").withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))
    f = signal_frame(df.drop("us"), "ts", "pos", ["x", "y"], "s").repartition(7)
    gaps = sorted(((r["series_id"], r["start_ts"], r["end_ts"]) for r in runs.gap_runs(f, 3).collect()), key=str)
    stalls = sorted(((r["series_id"], r["signal"], r["value"], r["start_ts"], r["end_ts"], r["n_samples"]) for r in runs.stall_runs(f, ["x", "y", "absent"], max_stall_us=20 * MINUTE, decimals=1, gap_factor=3).collect()), key=str)
    both = sorted(((r["series_id"], r["check"], r["signal"], r["start_ts"], r["end_ts"]) for r in runs.run_findings(f, ["x", "y"], max_stall_us=20 * MINUTE, decimals=1, gap_factor=3).collect()), key=str)
    stamp = lambda us: dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)
    want_gaps, want_stalls = [], []
    for series in ("a", "b", None, ""):
        for signal in (3, 4):
            g, r = by_hand([(row[2], row[1], row[signal]) for row in rows if row[0] == series and row[2] is not None], 3, 20 * MINUTE, 1)
            want_gaps += [(series, stamp(a), stamp(b)) for a, b in g] if signal == 3 else []
            want_stalls += [(series, "xy"[signal - 3], v, stamp(a), stamp(b), n) for v, a, b, n in r]
    assert len(want_gaps) > 20 and len(want_stalls) > 50
    assert gaps == sorted(want_gaps, key=str)
    assert stalls == sorted(want_stalls, key=str)
    assert both == sorted([(s, "gap", "(all signals)", a, b) for s, a, b in want_gaps] + [(s, "stall", x, a, b) for s, x, _, a, b, _ in want_stalls], key=str)


def test_median_of_distinct_steps(spark):
    steps = [3, 1, 10, 7, 2, 40]
    minutes = [sum(steps[:i]) for i in range(len(steps) + 1)]
    assert runs.sampling_interval(frame(spark, [0.0] * 7, minutes)).first()["interval_us"] == 5 * MINUTE
    assert runs.sampling_interval(frame(spark, [0.0] * 6, minutes[:6])).first()["interval_us"] == 3 * MINUTE
    assert runs.sampling_interval(frame(spark, [0.0])).first()["interval_us"] is None
    df = spark.createDataFrame([(None, 4.0), (None, 1.0), ("k", None), ("k", 2.0), ("k", 2.0), ("k", 9.0)], "k string, v double")
    assert {(r["k"], r["median"]) for r in runs.exact_median(df, ["k"], "v").collect()} == {(None, 2.5), ("k", 2.0)}


def test_readings_are_scanned_once(spark, sf_dir):
    from sunledger.plans import queries as Q

    for name, scans in (("gap_runs", 1), ("stall_runs", 1), ("validate_events", 2), ("expected_findings", 1)):
        df = Q.QUERIES[name](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan") == scans, name


def test_missing_slots_over_many_bitmaps_against_a_grid(spark):
    import random

    rnd = random.Random(8)
    origin, n = 1_700_006_400_000_000, 86400  # a day of seconds: three bitmaps
    rows = []
    for series, slots in (("a", sorted(rnd.sample(range(n), 2000))), (None, [0, n - 1]), ("", [40000]), ("none", [-5, n + 3]), ("all of the second block", list(range(32768, 65536)))):
        rows += [(series, i, origin + s * 1_000_000 + rnd.randrange(-400_000, 400_000) * (0 < s < n - 1)) for i, s in enumerate(slots)]
    df = spark.createDataFrame(rows, "s string, pos bigint, us bigint").withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")).withColumn("x", F.lit(1.0)).drop("us")
    share, missing = runs.availability(signal_frame(df, "ts", "pos", ["x"], "s"), origin, origin, 1_000_000)
    got = {r["series_id"]: r["n_present"] for r in share.collect()}
    assert got == {"a": 2000, None: 2, "": 1, "none": 0, "all of the second block": 32768}
    found = {}
    for r in missing.collect():
        start = int((r["start_ts"] - dt.datetime(1970, 1, 1)).total_seconds()) - origin // 1_000_000
        found.setdefault(r["series_id"], []).append((start, r["n_missing"]))
    assert sorted(found["none"]) == [(0, n)] and sorted(found[""]) == [(0, 40000), (40001, n - 40001)] and found[None] == [(1, n - 2)]
    assert sorted(found["all of the second block"]) == [(0, 32768), (65536, n - 65536)]
    there = sorted({round((r[2] - origin) / 1_000_000) for r in rows if r[0] == "a"})
    fence = [-1, *there, n]
    assert sorted(found["a"]) == [(a + 1, b - a - 1) for a, b in zip(fence, fence[1:], strict=False) if b - a > 1]

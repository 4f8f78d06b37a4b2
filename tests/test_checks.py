import datetime as dt

from sunledger.frame import signal_frame
from sunledger.operators import checks
from sunledger.plans.spec import SolarAngles, Spec
from sunledger.plans.specs import DIAGNOSTIC, MODBUS

NAN = float("nan")


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    kinds = ", ".join(f"{k} {'string' if isinstance(next((x for x in v if x is not None), 0.0), str) else 'double'}" for k, v in columns.items())
    rows = [(i, dt.datetime(2024, 5, 1) + dt.timedelta(minutes=i), *(float(v[i]) if isinstance(v[i], int) else v[i] for v in columns.values())) for i in range(n)]
    return signal_frame(spark.createDataFrame(rows, f"pos bigint, ts timestamp_ntz, {kinds}"), "ts", "pos", list(columns))


def only(found):
    rows = found.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_range_counts_missing_and_reports_the_first_by_position(spark):
    r = only(checks.check_ranges(frame(spark, x=[5, 101, NAN, -1]), {"x": (0, 100)}))
    assert (r["value_num"], r["n_samples"], r["detail"], r["start_ts"].minute, r["end_ts"].minute) == (101.0, 3, "outside [0.0, 100.0]", 1, 3)
    assert checks.check_ranges(frame(spark, x=[0, 100]), {"x": (0, 100), "y": (0, 1)}).count() == 0


def test_pairs(spark):
    two = frame(spark, a=[1, 2, NAN], b=[1, 1, 1])
    assert only(checks.check_equivalent(two, [("a", "b"), ("a", "c")]))["detail"] == "2 of 3 rows differ"
    assert only(checks.check_lesser(two, [("a", "b")]))["detail"] == "a exceeds b in 1 of 3 rows"


def test_constants(spark):
    cases = {"changes": [12, 12, 13], "zero/blank": [0, 0, 0], "all NaN": [NAN] * 3, "1 NaN": [12, NAN, 12], "changes; 1 NaN": [1, NAN, 2]}
    for detail, values in cases.items():
        assert only(checks.check_constants(frame(spark, x=values), ["x"]))["detail"] == detail
    assert checks.check_constants(frame(spark, x=["Pecos"] * 3), ["x"]).count() == 0
    assert only(checks.check_constants(frame(spark, x=["None"] * 3), ["x"]))["detail"] == "zero/blank"
    assert only(checks.check_constants(frame(spark, x=["a", "b", "b"]), ["x"]))["n_samples"] == 2


def test_expected(spark):
    assert only(checks.check_expected(frame(spark, fan=[1, NAN, 1]), {"fan": 1}))["detail"] == "1 missing"
    r = only(checks.check_expected(frame(spark, fan=[1, 0, 1, 0]), {"fan": 1}))
    assert (r["value_num"], r["n_samples"]) == (0.0, 2)
    assert checks.check_expected(frame(spark, fan=[1.0, 1.001]), {"fan": 1}, eps=0.01).count() == 0
    assert only(checks.check_expected(frame(spark, s=["on", "off"]), {"s": "on"}))["value_text"] == "off"


def test_sentinel(spark):
    r = only(checks.check_sentinel(frame(spark, u=[-99, 4.2, -99]), ["u"]))
    assert (r["value_num"], r["n_samples"]) == (4.2, 1)
    r = only(checks.check_sentinel(frame(spark, u=[-99, NAN]), ["u"]))
    assert (r["detail"], r["n_samples"], r["start_ts"]) == ("1 NaN/non-numeric", 1, None)
    assert checks.check_sentinel(frame(spark, u=[-999, -999]), ["u"], {"u": -999.0}).count() == 0


def test_validate_and_summary(spark):
    spec = Spec(ranges={"x": (0, 1)}, unused=("gone",))
    found = checks.validate(frame(spark, x=[0, 2, 0]), spec)
    assert {(r["check"], r["signal"]) for r in found.collect()} == {("missing", "gone"), ("range", "x")}
    summary = {(r["check"], r["signal"]): r["pass"] for r in checks.summarize(found, spec).collect()}
    assert summary == {("range", "x"): False, ("gap", "(all signals)"): True, ("sentinel", "gone"): True}


def test_specs():
    assert len(MODBUS.ranges) == 43 and len(MODBUS.dynamic) == 30 and len(MODBUS.constant) == 11
    assert len(DIAGNOSTIC.ranges) == 68 and len(DIAGNOSTIC.lesser) == 34 and len(DIAGNOSTIC.dynamic) == 10
    assert DIAGNOSTIC.ranges["13_3V_V_Avg"] == (12.635, 13.965) and DIAGNOSTIC.ranges["-VIN_RP_V_Min"] == (-25.0, -22.0)
    one = MODBUS.override(stall_windows={"BP": 1}, ranges={"BP": (0, 1)})
    assert one.ranges["BP"] == (0, 1) and one.ranges["RH"] == (0, 100) and MODBUS.ranges["BP"] == (800, 1200)
    assert ("utc", "(all signals)") in MODBUS.tested()
    assert SolarAngles(1, 2, utc_offset_us=0).override(tolerance=2).tolerance == 2


def test_many_tests_are_one_aggregation_and_series_keep_apart(spark):
    rows = [("a", i, dt.datetime(2024, 5, 1) + dt.timedelta(minutes=i), float(i), str(i % 7), None if i % 3 else 1.0) for i in range(20)]
    rows += [(None, i, dt.datetime(2024, 5, 1), 1.0, "on", 1.0) for i in range(5)]
    f = signal_frame(spark.createDataFrame(rows, "s string, pos bigint, ts timestamp_ntz, x double, t string, z double"), "ts", "pos", ["x", "t", "z"], "s")
    spec = Spec(ranges={"x": (0, 10), "z": (0, 2)}, lesser=(("x", "z"),), equivalent=(("x", "z"),), constant=("t", "x", "z"), expected={"t": "3", "z": 1}, unused=("x",), sentinel=1.0, gaps=False)
    got = {(r["series_id"], r["check"], r["signal"]): (r["detail"], r["value_num"], r["value_text"], r["n_samples"]) for r in checks.validate(f, spec).collect()}
    assert got == {
        ("a", "range", "x"): ("outside [0.0, 10.0]", 11.0, None, 9), ("a", "range", "z"): ("outside [0.0, 2.0]", None, None, 13), ("a", "lesser", "x vs z"): ("x exceeds z in 6 of 20 rows", 3.0, None, 6),
        ("a", "equivalent", "x vs z"): ("20 of 20 rows differ", 0.0, None, 20), ("a", "constant", "t"): ("changes; zero/blank", 0.0, None, 7), ("a", "constant", "x"): ("changes; zero/blank", 0.0, None, 20),
        ("a", "constant", "z"): ("13 NaN", 1.0, None, 1), ("a", "expected", "t"): ("17 value(s) != 3 (saw [0, 1, 2, 4, 5])", 0.0, None, 17), ("a", "expected", "z"): ("13 missing", None, None, 13),
        ("a", "sentinel", "x"): ("19 value(s) != 1.0 (saw [0.0, 2.0, 3.0, 4.0, 5.0])", 0.0, None, 19), (None, "expected", "t"): ("5 value(s) != 3 (saw [on])", None, "on", 5),
    }
    assert checks.expected_deviations(f, {"t": "3", "z": 1}).count() == 17 + 13 + 5
    assert checks.sentinel_deviations(f, ["x"], 1.0).count() == 19

"""Checks of signal frames: all checks of rows are tests of one fused aggregation, however many there are.

The first step groups readings by series, test and what is told apart (the verdict of ranges and pairs, the distinct
reading of constants, expected values and sentinels), with sums before the shuffle. The second one looks at these
groups only, so numbers that need a whole series (does any reading parse, which five values are least) cost no pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunledger.frame import KEYS, long, reading, signals_of
from sunledger.operators.runs import run_findings, series_key, stall_findings
from sunledger.schema import ALL_SIGNALS, CHECK_ORDER, as_findings, clean, no_findings, number_text

ZERO = 1e-9


@dataclass(frozen=True)
class Test:
    """One check of one signal (or pair), as the fused aggregation sees it.

    text and number: the reading; bad: whether it fails, where that can be told row by row. Readings of `by_value` tests
    are grouped by their text, so what depends on a value is decided once for each distinct one.
    """

    check: str
    signal: str
    text: Column
    number: Column
    bad: Column
    by_value: bool = False
    want_num: float | None = None
    want_text: str | None = None
    eps: float = 0.0
    zero_tol: float = 0.0
    note: str = ""


LITERALS = ("check", "signal", "want_num", "want_text", "eps", "zero_tol", "note")


def _number_or_none(v: float | str) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def range_tests(frame: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> list[Test]:
    """Readings outside [lo, hi]; a missing one is outside."""
    out = []
    for s, (lo, hi) in ranges.items():
        if s in frame.columns:
            text, x = reading(frame, s)
            out.append(Test("range", s, text, x, ~F.coalesce(x.between(float(lo), float(hi)), F.lit(False)), note=f"outside [{float(lo)}, {float(hi)}]"))
    return out


def _pair_tests(frame: DataFrame, check: str, pairs: Sequence[tuple[str, str]], bad: Callable[[Column, Column], Column], note: str) -> list[Test]:
    value = lambda s: clean(F.col(f"`{s}`").cast("double"))
    there = [(a, b) for a, b in pairs if a in frame.columns and b in frame.columns]
    return [Test(check, f"{a} vs {b}", F.lit(None).cast("string"), value(a), bad(value(a), value(b)), note=note.format(a, b)) for a, b in there]


def equivalent_tests(frame: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[Test]:
    """Pairs that must be equal; missing on either side is a difference."""
    return _pair_tests(frame, "equivalent", pairs, lambda a, b: ~F.coalesce(a == b, F.lit(False)), "")


def lesser_tests(frame: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[Test]:
    """Pairs whose left must not exceed its right; missing and equal ones are fine."""
    return _pair_tests(frame, "lesser", pairs, lambda a, b: F.coalesce(a > b, F.lit(False)), "{} exceeds {}")


def _value_tests(frame: DataFrame, check: str, signals: Sequence[str], **of: Callable[[str], object]) -> list[Test]:
    there = [s for s in signals if s in frame.columns]
    return [Test(check, s, *reading(frame, s), F.lit(True), by_value=True, **{k: f(s) for k, f in of.items()}) for s in there]


def constant_tests(frame: DataFrame, signals: Sequence[str], zero_tol: float = ZERO, eps: float = 0.0) -> list[Test]:
    """Signals that must hold one value other than zero or blank."""
    return _value_tests(frame, "constant", signals, eps=lambda s: float(eps), zero_tol=lambda s: float(zero_tol))


def expected_tests(frame: DataFrame, expected: Mapping[str, float | str], eps: float = 0.0) -> list[Test]:
    """Signals that must always show one value; compared as numbers if the value and any reading are."""
    return _value_tests(frame, "expected", list(expected), want_num=lambda s: _number_or_none(expected[s]), want_text=lambda s: str(expected[s]), eps=lambda s: float(eps))


def sentinel_tests(frame: DataFrame, signals: Sequence[str], sentinel: float | Mapping[str, float] = -99.0, eps: float = 0.0) -> list[Test]:
    """Unused signals that must show their sentinel."""
    want = lambda s: float(sentinel.get(s, -99.0) if isinstance(sentinel, Mapping) else sentinel)
    return _value_tests(frame, "sentinel", signals, want_num=want, eps=lambda s: float(eps))


def _off(numeric: Column) -> Column:
    """Whether a row's reading fails its test; numeric: whether `expected` compares numbers."""
    near = F.abs(F.col("value") - F.col("want_num")) <= F.col("eps")
    by_number, by_text = ~F.coalesce(near, F.lit(False)), ~F.coalesce(F.col("text") == F.col("want_text"), F.lit(False))
    return (
        F.when(F.col("check") == "expected", F.when(numeric, by_number).otherwise(by_text)).when(F.col("check") == "sentinel", F.coalesce(~near, F.lit(False))).otherwise(F.col("bad"))
    )


def _groups(frame: DataFrame, tests: Sequence[Test]) -> DataFrame:
    """By series, test and distinct reading (of by_value tests) or verdict (of the others): how often, and the first and last place.

    One pass over the frame with partial sums before the shuffle, whatever the number of tests.
    """
    known = lambda x: F.when(~F.lower(x).eqNullSafe("nan"), x)
    one = [F.struct(F.lit(i).alias("test"), t.bad.alias("bad"), (known(t.text) if t.by_value else F.lit(None).cast("string")).alias("text"), t.number.alias("x")) for i, t in enumerate(tests)]
    rows = frame.select("series_id", "pos", "ts", F.inline(F.array(*one)))
    groups = rows.groupBy("series_id", "test", "bad", "text").agg(
        F.count("*").alias("n"), F.min_by("x", "pos").alias("value"), F.min("pos").alias("p0"), F.min_by("ts", "pos").alias("t0"), F.max("pos").alias("p1"), F.max_by("ts", "pos").alias("t1"),
    )
    kinds = "struct<check:string,signal:string,want_num:double,want_text:string,eps:double,zero_tol:double,note:string>"
    said = F.array(*[F.struct(*[F.lit(getattr(t, k)).alias(k) for k in LITERALS]).cast(kinds) for t in tests])
    return groups.withColumn("said", F.element_at(said, F.col("test") + 1)).select("series_id", "test", "bad", "text", "n", "value", "p0", "t0", "p1", "t1", "said.*")


def row_findings(frame: DataFrame, tests: Sequence[Test]) -> DataFrame:
    """Findings of tests: the readings are aggregated once, then the distinct readings of each series and test."""
    if not tests:
        return no_findings(frame)
    by_test = Window.partitionBy("series_id", "test")
    groups = _groups(frame, tests)
    by_value = any(t.by_value for t in tests)  # ranges and pairs need neither whether any reading parses nor the least readings
    groups = groups.withColumn("numeric", F.max(F.col("value").isNotNull()).over(by_test) & F.col("want_num").isNotNull() if by_value else F.lit(False))
    groups = groups.withColumn("off", _off(F.col("numeric"))).withColumn("known", F.col("text").isNotNull())
    # the five least distinct readings that are off: numbers by size, others by their text
    shown = F.col("off") & F.col("known")
    least = by_test.orderBy(F.when(shown, 0).otherwise(1), F.when(F.col("check") == "sentinel", F.col("value")), "text")
    groups = groups.withColumn("nr", F.row_number().over(least) if by_value else F.lit(1))
    off, off_known, lost = F.col("off"), F.col("off") & F.col("known"), F.col("value").isNull()
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    span_of = F.when(F.col("check") == "constant", F.lit(True)).otherwise(off)
    found = groups.groupBy("series_id", "test", "check", "signal", "want_num", "want_text", "eps", "zero_tol", "note").agg(
        F.sum("n").alias("rows"), total(off).alias("n_off"), total(off_known).alias("differ"), total(off & ~F.col("known")).alias("missing"), total(lost).alias("lost"),
        total(F.col("known")).alias("n_known"), total(~lost).alias("n_numeric"), F.count_if("known").alias("kinds"), F.min("value").alias("least"), F.max("value").alias("most"), F.min(F.abs("value")).alias("near_zero"),
        F.min_by("value", F.when(off, F.col("p0"))).alias("first_off"), F.min_by("value", F.when(off_known, F.col("p0"))).alias("first_differing"), F.min_by("text", F.when(off_known, F.col("p0"))).alias("first_differing_text"),
        F.min_by("text", F.when(F.col("known"), F.col("p0"))).alias("first_text"), F.min_by("value", F.when(~lost, F.col("p0"))).alias("first_num"), F.min(F.when(off, F.col("value"))).alias("least_off"),
        F.min_by("t0", F.when(span_of, F.col("p0"))).alias("start_ts"), F.max_by("t1", F.when(span_of, F.col("p1"))).alias("end_ts"),
        F.array_sort(F.collect_list(F.when(shown & (F.col("nr") <= 5), F.struct("nr", "text", "value")))).alias("seen"),
    )
    return as_findings(_told(found).filter("detail <> ''"))


def _told(found: DataFrame) -> DataFrame:
    """detail, value_num, value_text, n_samples and duration_us of each test's numbers; an empty detail where all is well."""
    is_ = lambda c: F.col("check") == c
    count = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    saw = lambda f: F.concat(F.lit(" (saw ["), F.array_join(F.transform("seen", f), ", "), F.lit("])"))
    # constant
    is_number, none = F.col("n_numeric") == F.col("n_known"), F.col("n_known") == 0
    changes = F.when(is_number, F.col("most") - F.col("least") > F.col("eps")).otherwise(F.col("kinds") > 1)
    blank = F.when(is_number, F.col("near_zero") <= F.col("zero_tol")).otherwise(F.trim("first_text").isin("", "0", "0.0", "None", "nan"))
    unknown = F.col("rows") - F.col("n_known")
    constant = F.when(none, F.lit("all NaN")).otherwise(F.concat_ws("; ", F.when(changes, "changes"), F.when(blank, "zero/blank"), F.when(unknown > 0, F.concat(unknown.cast("string"), F.lit(" NaN")))))
    # expected
    wrong = F.when(F.col("differ") > 0, F.concat(F.col("differ").cast("string"), F.lit(" value(s) != "), F.col("want_text"), saw(lambda x: x["text"])))
    expected = F.concat_ws("; ", wrong, count("missing", " missing"))
    # sentinel
    sentinel = F.concat_ws("; ", F.when(F.col("n_off") > 0, F.concat(F.col("n_off").cast("string"), F.lit(" value(s) != "), number_text(F.col("want_num")))), count("lost", " NaN/non-numeric"))
    sentinel = F.concat(sentinel, F.when(F.col("n_off") > 0, saw(lambda x: number_text(x["value"]))).otherwise(""))
    pair = F.when(is_("equivalent"), F.format_string("%d of %d rows differ", "n_off", "rows")).otherwise(F.format_string("%s in %d of %d rows", "note", "n_off", "rows"))
    detail = F.when(is_("constant"), constant).when(is_("expected"), expected).when(is_("sentinel"), sentinel).when(F.col("n_off") > 0, F.when(is_("range"), F.col("note")).otherwise(pair)).otherwise("")
    number = F.when(is_("constant"), F.when(is_number, F.col("first_num"))).when(is_("expected"), F.col("first_differing")).when(is_("sentinel"), F.col("least_off")).otherwise(F.col("first_off"))
    text = F.when(is_("constant") & ~is_number, F.col("first_text")).when(is_("expected") & F.col("first_differing").isNull(), F.col("first_differing_text"))
    n = F.when(is_("constant"), F.when(none, F.col("rows")).otherwise(F.col("kinds"))).when(is_("sentinel"), F.col("n_off") + F.col("lost")).otherwise(F.col("n_off"))
    shown = ~(is_("constant") & none)
    found = found.withColumns({"detail": detail, "value_num": number, "value_text": text, "n_samples": n, "start_ts": F.when(shown, F.col("start_ts")), "end_ts": F.when(shown, F.col("end_ts"))})
    return found.withColumn("duration_us", F.timestamp_diff("microsecond", F.col("start_ts"), F.col("end_ts")))


def check_ranges(frame: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Readings outside [lo, hi]; a missing one is outside."""
    return row_findings(frame, range_tests(frame, ranges))


def check_equivalent(frame: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pairs that must be equal; missing on either side is a difference."""
    return row_findings(frame, equivalent_tests(frame, pairs))


def check_lesser(frame: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pairs whose left must not exceed its right; missing and equal ones are fine."""
    return row_findings(frame, lesser_tests(frame, pairs))


def check_constants(frame: DataFrame, signals: Sequence[str], zero_tol: float = ZERO, eps: float = 0.0) -> DataFrame:
    """Signals that must hold one value other than zero or blank. n_samples counts distinct values (all missing: rows)."""
    return row_findings(frame, constant_tests(frame, signals, zero_tol, eps))


def check_expected(frame: DataFrame, expected: Mapping[str, float | str], eps: float = 0.0) -> DataFrame:
    """Signals that must always show one value; the comparison is numeric if the value and any reading are."""
    return row_findings(frame, expected_tests(frame, expected, eps))


def check_sentinel(frame: DataFrame, signals: Sequence[str], sentinel: float | Mapping[str, float] = -99.0, eps: float = 0.0) -> DataFrame:
    """Unused signals that must show their sentinel; missing readings are counted apart. value: least deviating number."""
    return row_findings(frame, sentinel_tests(frame, signals, sentinel, eps))


def expected_deviations(frame: DataFrame, expected: Mapping[str, float | str], eps: float = 0.0) -> DataFrame:
    """Readings that do not show the signal's expected value, missing ones too: KEYS, signal, value_text, value_num."""
    there = {s: v for s, v in expected.items() if s in frame.columns}
    rows = long(frame, list(there), want_num={s: _number_or_none(v) for s, v in there.items()}, want_text={s: str(v) for s, v in there.items()})
    rows = rows.withColumns({"text": F.when(~F.lower("value_text").eqNullSafe("nan"), F.col("value_text")), "want_num": F.col("want_num").cast("double")})
    # numbers are compared where the wanted value and any reading of the series are; a row for each series and signal
    numeric = rows.groupBy("series_id", "signal").agg((F.count("value_num") > 0).alias("any_number")).withColumn("k", series_key(F.col("series_id"))).drop("series_id")
    near = F.coalesce(F.abs(F.col("value_num") - F.col("want_num")) <= eps, F.lit(False))
    same = F.coalesce(F.col("text") == F.col("want_text"), F.lit(False))
    fine = F.when(F.col("any_number") & F.col("want_num").isNotNull(), near).otherwise(same)
    return rows.withColumn("k", series_key(F.col("series_id"))).join(numeric, ["k", "signal"]).filter(~fine).select(*KEYS, "signal", "value_text", "value_num")


def sentinel_deviations(frame: DataFrame, signals: Sequence[str], sentinel: float | Mapping[str, float] = -99.0, eps: float = 0.0) -> DataFrame:
    """Readings of unused signals that are not their sentinel, missing ones too: KEYS, signal, value_text, value_num."""
    want = {s: float(sentinel.get(s, -99.0) if isinstance(sentinel, Mapping) else sentinel) for s in signals}
    rows = long(frame, list(signals), want=want)
    bad = F.coalesce(F.abs(F.col("value_num") - F.col("want").cast("double")) > eps, F.lit(True))
    return rows.filter(bad).select(*KEYS, "signal", "value_text", "value_num")


def missing_signals(frame: DataFrame, spec) -> DataFrame:
    """Signals that the spec names and the frame lacks, sorted; decided from the schema alone."""
    names = sorted(spec.required() - set(signals_of(frame)))
    rows = [("", "missing", s, "not present in file", 0) for s in names]
    return as_findings(frame.sparkSession.createDataFrame(rows, "series_id string, check string, signal string, detail string, n_samples bigint"))


def spec_tests(frame: DataFrame, spec) -> list[Test]:
    """All row checks of a spec, for one aggregation."""
    return [
        *range_tests(frame, spec.ranges), *equivalent_tests(frame, spec.equivalent), *lesser_tests(frame, spec.lesser), *constant_tests(frame, spec.constant),
        *expected_tests(frame, spec.expected, spec.eps), *sentinel_tests(frame, spec.unused, spec.sentinel, spec.eps),
    ]


def validate(frame: DataFrame, spec) -> DataFrame:
    """All findings of all checks of a spec, with check_order for sorting.

    The frame is read twice: once for all checks of rows, once for gaps and stalls. Sun angles read it again.
    """
    from sunledger.operators.angles import check_solar_angles

    parts = [missing_signals(frame, spec), row_findings(frame, spec_tests(frame, spec))]
    dynamic = [s for s in spec.dynamic if s in frame.columns]
    options = {"max_stall_us": spec.max_stall_us, "windows": spec.stall_windows, "decimals": spec.stall_decimals, "gap_factor": spec.gap_factor}
    if spec.gaps:
        parts.append(run_findings(frame, dynamic, **options))
    elif dynamic:
        parts.append(stall_findings(frame, dynamic, **options))
    if spec.solar is not None:
        parts.append(check_solar_angles(frame, spec.solar))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    order = F.create_map(*[F.lit(x) for i, c in enumerate(CHECK_ORDER) for x in (c, i)])
    return out.withColumn("check_order", F.element_at(order, F.col("check")))


def summarize(findings: DataFrame, spec) -> DataFrame:
    """check, signal, n_findings, pass for everything that the spec tests, failures first."""
    tested = findings.sparkSession.createDataFrame(spec.tested(), "check string, signal string")
    counts = findings.groupBy("check", "signal").agg(F.count("*").alias("n"))
    out = tested.join(counts, ["check", "signal"], "left").select("check", "signal", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_findings"))
    return out.withColumn("pass", F.col("n_findings") == 0).orderBy("pass", "check", "signal")


__all__ = ["ALL_SIGNALS", "check_constants", "check_equivalent", "check_expected", "check_lesser", "check_ranges", "check_sentinel", "expected_deviations", "missing_signals", "row_findings", "sentinel_deviations", "summarize", "validate"]

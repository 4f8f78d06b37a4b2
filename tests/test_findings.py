import datetime as dt

import pytest
from pyspark.sql import functions as F

from sunledger.frame import signal_frame
from sunledger.operators import checks
from sunledger.plans.spec import Spec
from sunledger.sources import findings


def frame(spark, values, series):
    rows = [(s, i, dt.datetime(2024, 5, 1) + dt.timedelta(hours=i), float(v)) for s in series for i, v in enumerate(values)]
    return signal_frame(spark.createDataFrame(rows, "s string, pos bigint, ts timestamp_ntz, x double"), "ts", "pos", ["x"], "s")


def rows(spark, folder):
    return sorted((tuple(r) for r in findings.read_findings(spark, folder).collect()), key=str)


def test_writing_again_changes_nothing_and_replaces_what_it_covers(spark, tmp_path):
    folder = str(tmp_path / "found")
    with pytest.raises(findings.UnfinishedWrite):
        findings.read_findings(spark, folder)
    series = ["a", None, "", "b/ c"]
    bad = frame(spark, [1, 9, 1, *[1] * 30, 9], series)
    spec = Spec(ranges={"x": (0, 5)}, unused=("gone",), gaps=False)
    found = checks.validate(bad, spec)
    assert findings.write_findings(found, folder, findings.looked_at(bad)) == 1
    first = rows(spark, folder)
    assert len(first) == 5 and {r[0] for r in first} == {"a", None, "", "b/ c"}
    assert findings.write_findings(found, folder, findings.looked_at(bad)) == 2
    assert rows(spark, folder) == first and findings.commits(spark, folder) == [1, 2]
    # series a is well now; the others' partitions stay as they are
    well = frame(spark, [1] * 34, ["a"])
    findings.write_findings(checks.validate(well, Spec(ranges={"x": (0, 5)}, gaps=False)), folder, findings.looked_at(well))
    assert rows(spark, folder) == [r for r in first if r[0] != "a"]
    covered = {(r["series_id"], r["day"]): r["n_findings"] for r in findings.read_coverage(spark, folder).collect()}
    assert covered["a", "2024-05-01"] == 0 and covered["b/ c", "2024-05-01"] == 1 and covered["a", "none"] == 0


def test_a_write_that_did_not_end_is_refused_until_it_is_done_again(spark, tmp_path):
    folder = str(tmp_path / "found")
    good = checks.check_ranges(frame(spark, [1, 9], ["a"]), {"x": (0, 5)})
    findings.write_findings(good, folder)
    with pytest.raises(Exception, match="stopped"):
        findings.write_findings(good.withColumn("detail", F.when(F.col("n_samples") > 0, F.raise_error(F.lit("stopped"))).cast("string")), folder)
    with pytest.raises(findings.UnfinishedWrite):
        findings.read_findings(spark, folder)
    assert findings.write_findings(good, folder) == 2 and len(rows(spark, folder)) == 1

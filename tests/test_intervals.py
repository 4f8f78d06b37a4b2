import random

import pytest
from pyspark.sql import functions as F

from sunledger.operators.intervals import interval_join


def test_points_in_intervals_against_all_pairs(spark):
    rnd = random.Random(3)
    points = [(i, rnd.choice(["a", None, "b"]), rnd.randrange(-500, 500)) for i in range(400)] + [(900, "a", None)]
    spans = [(i, rnd.choice(["a", None, "c"]), lo := rnd.randrange(-600, 600), lo + rnd.choice([0, 1, 10, 33, 400, -5])) for i in range(60)] + [(99, "a", None, 5)]
    p = spark.createDataFrame(points, "id int, k string, at bigint").repartition(3)
    s = spark.createDataFrame(spans, "span int, k string, lo bigint, hi bigint")
    pairs = [(i, n) for i, k, at in points for n, ks, lo, hi in spans if k == ks and at is not None and lo is not None and lo <= at < hi]
    for width in (10, 33, 1000):
        got = interval_join(p, F.col("at"), s, "lo", "hi", width, ["k"])
        assert got.columns == ["id", "k", "at", "span", "lo", "hi"]
        assert sorted((r["id"], r["span"]) for r in got.collect()) == sorted(pairs)
    left = interval_join(p, F.col("at"), s, "lo", "hi", 50, ["k"], "left")
    assert left.filter("span IS NULL").count() == len(points) - len({i for i, _ in pairs})
    assert interval_join(p, F.col("at"), s, "lo", "hi", 50, ["k"], "left_semi").count() == len({i for i, _ in pairs})
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        interval_join(p, F.col("at"), s, "lo", "hi", 50, ["k"], "outer")


def test_numbers_with_fractions_and_no_keys(spark):
    p = spark.createDataFrame([(0.0,), (0.99,), (1.0,), (2.5,), (float("nan"),)], "x double")
    s = spark.createDataFrame([("low", 0.0, 1.0), ("high", 1.0, 2.5)], "band string, lo double, hi double")
    assert sorted((r["x"], r["band"]) for r in interval_join(p, F.col("x"), s, "lo", "hi", 0.4).collect()) == [(0.0, "low"), (0.99, "low"), (1.0, "high")]

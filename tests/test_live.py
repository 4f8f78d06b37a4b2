import datetime as dt
import random

from pyspark.sql import functions as F

from sunledger.frame import signal_frame
from sunledger.operators import runs
from sunledger.streaming import live

MINUTE = 60_000_000
START = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)
SCHEMA = "series_id string, signal string, ts timestamp, pos bigint, value double"


def replay(spark, tmp_path, batches, **options):
    """Files of readings, one to a micro-batch; what the stream says of them."""
    live.use_rocksdb(spark)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / f"in/{i:03d}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    name = f"live_{random.randrange(1 << 30)}"
    found = live.runs(source, **options)
    query = found.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(600)
    return [r.asDict() for r in spark.table(name).collect()]


def test_late_and_unordered_readings_give_the_batch_operators_rows(spark, tmp_path):
    rnd = random.Random(6)
    rows = []
    for series in ("a", "b"):
        minute, value = 0, 1.0
        for pos in range(400):
            minute += 1 + (rnd.random() < 0.02) * rnd.randrange(2, 60)
            value = rnd.choice([1.0, 2.0, None]) if rnd.random() < 0.08 else value
            rows.append((series, "x", START + dt.timedelta(minutes=minute), pos, value))
    # each reading comes up to eight minutes after its time; a batch is an hour of arrivals
    arrived = sorted((r[2] + dt.timedelta(minutes=rnd.random() * 8), i) for i, r in enumerate(rows))
    batches = {}
    for at, i in arrived:
        batches.setdefault(at.strftime("%d%H"), []).append(rows[i])
    batches = [batches[k] for k in sorted(batches)]
    assert any(b[i][2] > b[i + 1][2] for b in batches for i in range(len(b) - 1))
    flush = [("end", "x", START + dt.timedelta(days=30), 0, 0.0)]
    got = replay(spark, tmp_path, [*batches, flush], interval_us=MINUTE, max_stall_us=10 * MINUTE, late="10 minutes")
    frame = signal_frame(spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumnRenamed("value", "x"), "ts", "pos", ["x"], "series_id")
    us = lambda t: int((t.replace(tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds() * 1e6)
    stalls = {(r["series_id"], r["value"], us(r["start_ts"]), us(r["end_ts"]), r["n_samples"]) for r in runs.stall_runs(frame, ["x"], max_stall_us=10 * MINUTE).collect()}
    gaps = {(r["series_id"], us(r["start_ts"]), us(r["end_ts"])) for r in runs.gap_runs(frame).collect()}
    assert len(stalls) > 10 and len(gaps) > 5
    of = lambda kind: [r for r in got if r["kind"] == kind and r["series_id"] != "end"]
    assert sorted((r["series_id"], r["value"], r["start_us"], r["end_us"], r["n_samples"]) for r in of("stall")) == sorted(stalls)
    assert sorted((r["series_id"], r["start_us"], r["end_us"]) for r in of("gap")) == sorted(gaps)


def test_silence_is_told_once_and_state_is_forgotten(spark, tmp_path):
    one = lambda m, v: ("a", "x", START + dt.timedelta(minutes=m), m, v)
    clock = lambda m: ("clock", "x", START + dt.timedelta(minutes=m), m, 0.0)
    batches = [[one(0, 1.0), one(1, 1.0), one(20, 1.0)], [clock(60)], [clock(61)], [one(90, 5.0), clock(95)], [clock(200)], [clock(5000)], [one(5001, 1.0), clock(5010)], [clock(6000)]]
    got = [r for r in replay(spark, tmp_path, batches, interval_us=10 * MINUTE, max_stall_us=5 * MINUTE, late="1 minute", forget_us=1000 * MINUTE) if r["series_id"] == "a"]
    base = int(START.timestamp() * 1e6)
    told = sorted((r["kind"], (r["start_us"] - base) // MINUTE, None if r["end_us"] is None else (r["end_us"] - base) // MINUTE) for r in got)
    assert [t for t in told if t[0] == "gap"] == [("gap", 1, 20), ("gap", 20, 90)]  # none to 5001: what was before is forgotten
    assert [t[1] for t in told if t[0] == "silence"] == [20, 90, 5001]


def test_readings_reach_the_state_in_packs(spark):
    rows = spark.range(0, 50000, 1, 1).selectExpr("if(id % 2 = 0, 'a', null) AS series_id", "'x' AS signal", "(id * 7919) % 50000 * 60000000 AS us", "id AS pos", "if(id % 3 = 0, null, id / 8) AS value")
    packs = rows.mapInArrow(live._pack, "series_id string, signal string, ts timestamp, readings binary").collect()
    assert len(packs) <= 10 and {p["series_id"] for p in packs} == {"a", None}
    got = []
    for p in packs:
        us, pos, value = live._unpacked([bytes(p["readings"])])
        assert int(p["ts"].timestamp() * 1e6) == us[-1]
        got += [(p["series_id"], u, n, None if v != v else v) for u, n, v in zip(us.tolist(), pos.tolist(), value.tolist(), strict=True)]
    assert sorted(got, key=lambda r: r[2]) == [tuple(r) for r in rows.drop("signal").orderBy("pos").collect()]


def test_what_comes_too_late_is_dropped_from_a_pack(spark, tmp_path):
    one = lambda m: ("a", "x", START + dt.timedelta(minutes=m), m, 1.0)
    clock = lambda m: ("clock", "x", START + dt.timedelta(minutes=m), m, 0.0)
    batches = [[one(0), one(1), clock(500)], [clock(501)], [one(2), one(600), clock(600)], [clock(4000)]]
    got = [r for r in replay(spark, tmp_path, batches, interval_us=10 * MINUTE, max_stall_us=5 * MINUTE, late="1 minute", forget_us=9000 * MINUTE) if r["series_id"] == "a"]
    base = int(START.timestamp() * 1e6)
    assert sorted((r["kind"], (r["start_us"] - base) // MINUTE, r["end_us"] and (r["end_us"] - base) // MINUTE) for r in got) == [("gap", 1, 600), ("silence", 1, None), ("silence", 600, None)]

import gzip

import pytest
from pyspark.sql import functions as F

from sunledger.operators.status_table import channel_table, suspect_cells
from sunledger.sources import channels, logger

HEADER = [
    ("Site Number:", "100777"), ("Latitude:", "51.2"), ("Longitude:", "6.8"), ("Serial Number:", "Q-11"), ("Channel:", "1"), ("Description:", "Thermo A"), ("Units:", "deg_C"),
    ("Serial Number:", "T-5"), ("Channel:", "21"), ("Sensor Type:", "Acme P7"), ("Description:", "Acme P7 tilted"), ("Measurand:", "Irradiance"), ("Units:", "W/m^2"), ("Serial Number:", "P-77"),
]


@pytest.fixture
def header(spark):
    return spark.createDataFrame([("f", i, k, v) for i, (k, v) in enumerate(HEADER)], "file string, pos int, key string, value string")


def write(path, rows, data="Data"):
    text = "\n".join(["Site Number:\t100777", data, "Timestamp\tCh1_Avg\tCh2_Avg", *rows]) + "\n\n"
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)


def test_header(header):
    fields = channels.site_fields(header).first()["fields"]
    assert fields["Serial Number"] == "P-77" and channels.site_coordinates(fields) == (51.2, 6.8)
    names = {r["channel"]: r["name"] for r in channels.channel_names(channels.channel_blocks(header)).collect()}
    assert names == {1: "Ch1_Thermo_A_deg_C", 21: "Ch21_Acme_P7_tilted_Irradiance_W/m^2"}
    kinds = {r["channel"]: r["kind"] for r in channels.channel_kinds(channels.channel_blocks(header)).collect()}
    assert kinds == {1: "temperature", 21: "irradiance"}


def test_coordinates_must_be_a_position():
    with pytest.raises(KeyError):
        channels.site_coordinates({"Latitude": "1"})
    with pytest.raises(ValueError):
        channels.site_coordinates({"site_latitude": "95", "Longitude:": "1"})


def test_renaming():
    names = {1: "Ch1_Thermo_A_deg_C", 4: "Ch4_Rain_mm"}
    assert channels.rename_channels(["Timestamp", "Ch1_Avg_deg_C", "Ch1_Min_deg_C", "Ch1_NotUsed"], names) == {"Timestamp": "Timestamp", "Ch1_Avg_deg_C": "Ch1_Avg_Thermo_A_deg_C", "Ch1_Min_deg_C": "Ch1_Min_Thermo_A_deg_C"}
    assert channels.rename_channels(["Ch4_Total_low_B_Sum_mm", "Ch4_Total_low_B_Avg_mm"], names) == {"Ch4_Total_low_B_Sum_mm": "Ch4_Sum_Rain_mm", "Ch4_Total_low_B_Avg_mm": "Ch4_Avg_Rain_mm"}
    assert channels.rename_channels(["Ch1_Samples_deg_C"], names) == {"Ch1_Samples_deg_C": "Ch1_Thermo_A_deg_C"}
    with pytest.raises(ValueError):
        channels.rename_channels(["Ch1_Bogus_deg_C", "Ch1_Other_deg_C"], names)


def test_spec_for():
    columns = ["Ch1_Avg_x", "Ch1_Min_x", "Ch1_Max_x", "Ch1_SD_x", "Ch2_Avg_y", "Ch2_Min_y"]
    night = channels.spec_for(columns, {1: "temperature", 2: "irradiance"})
    assert night.ranges["Ch1_SD_x"] == (0, 110) and night.dynamic == ("Ch1_Avg_x",) and len(night.lesser) == 2 and "Ch2_Avg_y" in night.ranges
    day = channels.spec_for(columns, {1: "temperature", 2: "irradiance"}, sunlit=True)
    assert day.ranges == {} and day.dynamic == ("Ch2_Avg_y",) and not day.gaps


def test_listing(spark, header):
    listed = channels.channels(["Ch1_Avg_a", "Ch1_SD_a", "Ch21_Avg_b", "Ch7_Avg_c"], channels.channel_blocks(header))
    rows = {r["units"]: r for r in listed.collect()}
    assert rows["deg_C"]["statistics"] == "Avg SD" and rows["W/m^2"]["hi"] == 1200 and channels.unclassified(listed).count() == 1


def test_files(spark, tmp_path):
    write(tmp_path / "a_log10.dat", ["2023-11-07 00:00:00\t1.0\t2.0", "2023-11-07 00:01:00\t1.1", "2023-11-07 00:02:00\t1\t2\t3"])
    write(tmp_path / "b_log10.dat.gz", ["2023-11-07 00:03:00\t1.0\t2.0"])
    write(tmp_path / "c_log10.dat", ["x"], data="nothing")
    data, header, bad = logger.read_files(spark, str(tmp_path), "log10")
    assert data.count() == 2 and header.filter("key = 'Site Number:'").count() == 3
    assert sorted(bad.select("timestamp", "fields", "expected").collect()) == [("2023-11-07 00:01:00", 2, 3), ("2023-11-07 00:02:00", 4, 3)]
    assert logger.read_files(spark, str(tmp_path), "log10", "keep")[0].count() == 4
    assert logger.time_axis(data, "Timestamp").filter("ts is null").count() == 0
    with pytest.raises(ValueError):
        logger.read_files(spark, str(tmp_path), "log10", "raise")
    with pytest.raises(ValueError):
        logger.read_files(spark, str(tmp_path), "log10", "other")
    with pytest.raises(FileNotFoundError):
        logger.read_files(spark, str(tmp_path), "diag9")
    with pytest.raises(NotADirectoryError):
        logger.read_files(spark, str(tmp_path / "gone"))


def test_tsv(spark, tmp_path):
    (tmp_path / "m.txt").write_text("ProtoNode.Modbus_Poll_Timestamp\tGHI\n2023-11-07 00:00:01\t5\n2023-11-07 00:00:00\t6\n")
    rows = logger.read_tsv(spark, str(tmp_path / "m.txt"), "ProtoNode.Modbus_Poll_Timestamp").orderBy("pos").collect()
    assert [r["GHI"] for r in rows] == ["5", "6"] and rows[0]["ts"].second == 1


def test_status_table(spark):
    line = lambda y, *cells: [("p", t, float(x), float(y), 30.0, 10.0) for x, t in cells]
    words = line(0, (0, "Status"), (10, "page")) + line(20, (0, "Channel"), (100, "Type"), (200, "Description"), (300, "Data")) + line(41, (0, "1"), (100, "PV"), (130, "IEC"), (200, "S0il"), (300, "12.5"), (330, "degC")) + line(60, (0, "3"), (200, "x"), (300, "volts"))
    table = channel_table(spark.createDataFrame(words, "image string, text string, x double, y double, w double, h double"))
    rows = table.orderBy("channel").collect()
    assert (rows[0]["channel"], rows[0]["type"], rows[0]["description"], rows[0]["value"], rows[0]["units"]) == (1, "PV_IEC", "Soil", 12.5, "deg_C")
    notes = {(r["channel"], r["note"]) for r in suspect_cells(table).collect()}
    assert (2, "channel is absent") in notes and (3, "no numeric value") in notes


def test_streams(spark, tmp_path):
    from sunledger.streaming import live

    source = spark.range(0, 30).select(F.lit("s").alias("series_id"), F.lit("x").alias("signal"), (F.lit(1_700_000_000) + F.col("id") * 60).cast("timestamp").alias("ts"), F.when(F.col("id") < 20, 1.0).otherwise(F.col("id").cast("double")).alias("value"))
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))

    def out(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.sql(f"SELECT * FROM {name}").collect()

    assert sum(r["rows"] for r in out(live.range_counts(stream(), 0, 5), "ranges", "complete")) == 30
    assert len(out(live.sessions(stream(), "5 minutes"), "parts", "complete")) == 1
    held = out(live.stalls(stream(), 600_000_000), "held", "append")
    assert len(held) == 1 and held[0]["n_samples"] == 20


def test_a_file_is_read_by_several_tasks_and_lines_keep_their_place(spark, tmp_path):
    (tmp_path / "big_log.dat").write_text("Site\tx\n\nData\n\nTimestamp\tCh1_Avg\n" + "".join(f"2024-05-01 00:00:00\t{i}\n" for i in range(20000)))
    (tmp_path / "b_log.dat").write_bytes(b"k\tv\r\nData\r\nTimestamp\tother\r\nt\t1\r\nshort\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        tasks = spark.read.text(str(tmp_path / "big_log.dat")).select(F.spark_partition_id()).distinct().count()
        data, header, bad = logger.read_files(spark, str(tmp_path))
        got = data.filter("file = 'big_log.dat'").select(F.count("*"), F.min(F.col("pos") - F.col("Ch1_Avg")), F.max(F.col("pos") - F.col("Ch1_Avg"))).first()
        small = data.filter("file = 'b_log.dat'").collect()
        heads, wrong = sorted(map(tuple, header.collect())), [tuple(r) for r in bad.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 5 and tuple(got) == (20000, 5, 5)
    assert [(r["pos"], r["Timestamp"], r["other"], r["Ch1_Avg"]) for r in small] == [(3, "t", "1", None)]
    assert heads == [("b_log.dat", 0, "k", "v"), ("big_log.dat", 0, "Site", "x")] and wrong == [("b_log.dat", "short", 1, 2)]


def test_records_of_files_with_different_and_odd_columns(spark, tmp_path):
    (tmp_path / "a_log.dat").write_text("Data\nt\tit's\tsame\tsame\n1\tx\ty\tz\n2\tshort\n")
    (tmp_path / "b_log.dat").write_text("Data\nt\tsay \"it's\"\n3\tq\textra\n")
    records = logger.read_records(spark, str(tmp_path), malformed="keep")
    assert dict(records.dtypes)["record"] == "variant"
    got = logger.columns_of(records, ["t", "it's", "same", "say \"it's\"", "absent"]).orderBy("t").collect()
    assert [tuple(r)[2:] for r in got] == [("1", "x", "y", None, None), ("2", "short", None, None, None), ("3", None, None, "q", None)]
    assert logger.read_records(spark, str(tmp_path)).count() == 1


def test_files_written_by_tasks_are_read_back(spark, tmp_path):
    lines = spark.createDataFrame([(f"f {i % 3}=x_log.dat.gz", i, f"{i}\tv" if i > 5 else ("Data" if i < 3 else "a\tb")) for i in range(60)], "file string, pos int, line string")
    folder = logger.write_files(lines.repartition(5), str(tmp_path / "out"))
    data, _, bad = logger.read_files(spark, folder)
    assert sorted(int(r["a"]) for r in data.collect()) == list(range(6, 60)) and bad.count() == 0
    assert {r["file"] for r in data.select("file").distinct().collect()} == {f"f {i}=x_log.dat.gz" for i in range(3)}


def test_positions_of_many_headers(spark):
    fields = [{"Latitude:": "44.5", "site_longitude": "-73.2"}, {"Site Latitude": "1", "LONGITUDE": "2"}]
    sites = spark.createDataFrame([(str(i), f) for i, f in enumerate(fields)], "file string, fields map<string,string>")
    assert sorted((r["latitude"], r["longitude"]) for r in channels.site_positions(sites).collect()) == [(1.0, 2.0), (44.5, -73.2)]
    for bad, said in (({"Latitude": "100", "Longitude": "1"}, "no position"), ({"Latitude": "x", "Longitude": "1"}, "no position"), ({"Latitude": "1"}, "no longitude")):
        with pytest.raises(Exception, match=said):
            channels.site_positions(spark.createDataFrame([("f", bad)], "file string, fields map<string,string>")).collect()


def test_spec_rows_say_what_spec_for_says(spark):
    columns = ["Ch1_Avg_deg_C", "Ch1_Min_deg_C", "Ch1_Max_deg_C", "Ch1_SD_deg_C", "Ch1_Gust_x", "Ch2_Avg_deg", "Ch3_Avg_x", "Ch4_Avg_W", "Ch5_W", "Ch6_Total_mm", "Ch6_Min_mm", "Ch7_Avg_x", "Ch8_NotUsed", "plain"]
    kinds = {1: "temperature", 2: "solar zenith", 4: "albedo", 5: "irradiance", 6: "precipitation", 7: None, 8: "soiling"}
    names = spark.createDataFrame([("f", c) for c in columns] + [("g", "Ch1_Avg_x")], "file string, name string")
    known = spark.createDataFrame([("f", k, v) for k, v in kinds.items()] + [("g", 1, "wind direction")], "file string, channel int, kind string")
    for sunlit in (False, True):
        spec = channels.spec_for(columns, {k: v for k, v in kinds.items() if v}, sunlit=sunlit)
        want = [("range", s, float(lo), float(hi), None) for s, (lo, hi) in spec.ranges.items()] + [("stall", s, None, None, spec.stall_windows[s]) for s in spec.dynamic] + [("lesser", f"{a} vs {b}", None, None, None) for a, b in spec.lesser]
        got = [tuple(r)[1:] for r in channels.spec_rows(names, known, sunlit=sunlit).filter("file = 'f'").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    groups = channels.grouped_signals(spark.createDataFrame([("f", i, c) for i, c in enumerate(["Wind_Avg", "Wind_Gust", "plain", "Wind_Max", "_Avg"])], "file string, pos int, name string"))
    assert {r["signal"]: r["columns"] for r in groups.collect()} == channels.signal_groups(["Wind_Avg", "Wind_Gust", "plain", "Wind_Max", "_Avg"])


def test_thousands_of_rules_are_one_automaton(spark):
    import random

    rnd = random.Random(2)
    letters = "abc"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 7)))
    rules = tuple((f"kind {i}", tuple({rnd.choice(["v", "a", "mm", ""]) for _ in range(rnd.randrange(3))}), tuple(tuple(word() for _ in range(rnd.randrange(1, 3))) for _ in range(rnd.randrange(1, 4)))) for i in range(5000))
    rules = (*rules[:4000], ("no words", ("hpa",), ()), ("empty word", ("w",), (("",),)), *rules[4000:], ("anything", (), ()))
    rows = [(i, rnd.choice(["v", "a", "mm", "", "hpa", "w", "other"]), "".join(rnd.choice(letters + "  xyz") for _ in range(rnd.randrange(0, 14)))) for i in range(400)] + [(900, None, "abc"), (901, "v", None)]

    def by_hand(unit, text):
        if unit is None or text is None:
            return None
        return next((k for k, units, words in rules if (not units or unit in units) and all(any(w in text for w in g) for g in words)), None)

    df = spark.createDataFrame(rows, "i int, unit string, text string")
    got = {r["i"]: r["kind"] for r in df.select("i", channels.kind_by_rules(F.col("unit"), F.col("text"), rules).alias("kind")).collect()}
    assert got == {i: by_hand(u, t) for i, u, t in rows}
    assert len(set(got.values())) > 10
    usual = df.select(channels.kind_of(F.col("unit"), F.col("text")).alias("a"), channels.kind_by_rules(F.col("unit"), F.col("text")).alias("b"))
    assert usual.filter("a IS DISTINCT FROM b").count() == 0

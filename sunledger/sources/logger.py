"""Logger text files: a header of key/value lines, a line `Data`, column names, rows; tab-separated.

Files are read as lines by Spark's text source, so a plain file of any size is split over many tasks (a compressed one
is one task's, line by line). Where a line lies in its file, pos, follows from the lines of the splits before its own.
A row is kept as its fields; the columns asked for are taken out of a VARIANT of names and fields, so files in one
folder may have different columns.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunledger.sources.channels import rename_channels

#: Suffixes of logger files, and what to do with malformed rows.
SUFFIXES = (".dat", ".log", ".diag", ".dat.gz", ".log.gz", ".diag.gz")
ACTIONS = ("drop", "raise", "keep")


def _files(spark: SparkSession, directory: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(directory)
    return {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(path) if s.isFile()}


def read_lines(spark: SparkSession, directory: str, file_type: str = "log", malformed: str = "drop") -> DataFrame:
    """file, pos, line of every line of files whose name contains file_type and ends in a known suffix; blank lines left out."""
    if malformed not in ACTIONS:
        raise ValueError(f"malformed must be one of {ACTIONS}, not {malformed!r}")
    names = _files(spark, directory)
    paths = [path for n, path in names.items() if file_type in n and n.endswith(SUFFIXES)]
    if not paths:
        counts = {s: sum(n.endswith(s) for n in names) for s in SUFFIXES}
        raise FileNotFoundError(f"no {file_type!r} file in {directory}; files by suffix: {counts}")
    return numbered_lines(spark, paths).filter(F.trim("line") != "")


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, pos (from 0, blank lines count), line of every line of text files.

    One pass counts the lines of each split, another one reads them; a split's rows meet its one count, so no file is a hot key.
    """
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # Spark says it as in a URL
    split = {"file": name, "path": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start")}
    lines = spark.read.text(paths).select(F.col("value").alias("line"), *[c.alias(k) for k, c in split.items()], F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    placed = lines.join(splits, ["path", "block"])
    return placed.select("file", (F.col("at") + F.col("shift")).cast("int").alias("pos"), "line")


def parts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header: file, pos, key, value), (rows: file, pos, fields, names): a file without a Data line has no rows."""
    found = lines.groupBy("file").agg(F.min(F.when(F.trim("line") == "Data", F.col("pos"))).alias("data"))
    placed = lines.join(found, "file")
    head = placed.filter((F.col("pos") < F.col("data")) | F.col("data").isNull())
    pair = F.split("line", "\t")
    header = head.select("file", "pos", pair[0].alias("key"), F.get(pair, F.lit(1)).alias("value"))
    body = placed.filter(F.col("pos") > F.col("data"))
    names = body.groupBy("file").agg(F.min_by("line", "pos").alias("names"), F.min("pos").alias("first"))
    rows = body.join(names, "file").filter(F.col("pos") > F.col("first"))
    return header, rows.select("file", "pos", F.split("line", "\t", -1).alias("fields"), F.split("names", "\t", -1).alias("names"))


def sized(rows: DataFrame) -> DataFrame:
    """rows (file, pos, fields) with expected, the number of fields of their file's first one."""
    first = rows.groupBy("file").agg(F.min_by(F.size("fields"), "pos").alias("expected"))
    return rows.join(first, "file")


def misfits(rows: DataFrame) -> DataFrame:
    """file, pos, fields (their number), expected of the sized rows whose number of fields is not the expected one."""
    return rows.filter(F.size("fields") != F.col("expected")).select("file", "pos", F.size("fields").alias("fields"), "expected")


def malformed_rows(lines: DataFrame) -> DataFrame:
    """file, timestamp, fields, expected of rows whose number of fields is not their file's."""
    _, rows = parts(lines)
    bad = rows.filter(F.size("fields") != F.size("names"))
    return bad.select("file", F.col("fields")[0].alias("timestamp"), F.size("fields").alias("fields"), F.size("names").alias("expected"))


def as_records(rows: DataFrame) -> DataFrame:
    """rows (file, pos, fields, names) as file, pos, record: a VARIANT object of each name's field (of equal names the first's).

    Fields that a short row lacks are not in its record, and fields beyond the names are left out.
    """
    place = F.filter(F.sequence(F.lit(1), F.size("names")), lambda i: (F.array_position("names", F.get("names", i - 1)) == i) & (i <= F.size("fields")))
    entries = F.transform(place, lambda i: F.struct(F.get("names", i - 1).alias("k"), F.get("fields", i - 1).alias("v")))
    return rows.select("file", "pos", F.to_variant_object(F.map_from_entries(F.when(F.size("names") > 0, entries))).alias("record"))


def columns_of(records: DataFrame, names: list[str]) -> DataFrame:
    """file, pos and a text column for each of names, NULL where a record has none of that name."""
    def one(n: str) -> Column:
        if "'" in n and '"' in n:  # no path can say that
            return F.col("record").cast("map<string,string>")[n]
        quote = '"' if "'" in n else "'"
        return F.try_variant_get("record", f"$[{quote}{n}{quote}]", "string")

    return records.select("file", "pos", *[one(n).alias(n) for n in names])


def column_names(rows: DataFrame) -> DataFrame:
    """name, at (least place), files of every column name in rows' files."""
    return rows.select("file", "names").distinct().select("file", F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"), F.count_distinct("file").alias("files"))


def _kept(rows: DataFrame, bad: DataFrame, malformed: str) -> DataFrame:
    if malformed == "raise":
        found = bad.groupBy("expected", "fields").count().orderBy("expected", "fields").limit(20).collect()
        if found:
            raise ValueError("malformed rows: " + "; ".join(f"{r['count']} with {r['fields']} of {r['expected']} fields" for r in found))
    return rows.filter(F.size("fields") == F.size("names")) if malformed == "drop" else rows


def read_records(spark: SparkSession, directory: str, file_type: str = "log", malformed: str = "drop") -> DataFrame:
    """file, pos, record (VARIANT) of all rows of a folder's files, whatever columns each file has."""
    lines = read_lines(spark, directory, file_type, malformed)
    return as_records(_kept(parts(lines)[1], malformed_rows(lines), malformed))


def read_files(spark: SparkSession, directory: str, file_type: str = "log", malformed: str = "drop", columns: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(data: file, pos and a text column for each of columns, header, malformed). Malformed rows are dropped by place in their file.

    Without columns, the names of all files are looked up first and every one becomes a column.
    """
    lines = read_lines(spark, directory, file_type, malformed)
    header, rows = parts(lines)
    bad = malformed_rows(lines)
    if columns is None:
        columns = [r["name"] for r in column_names(rows).orderBy("at", "name").collect()]  # column names only
    return columns_of(as_records(_kept(rows, bad, malformed)), columns), header, bad


def read_tsv(spark: SparkSession, path: str, timestamp: str) -> DataFrame:
    """Tab-separated captures with one header, in file order: file, pos, ts and all columns as text. path: a file, folder or pattern."""
    lines = numbered_lines(spark, path).filter("line <> ''")
    names = spark.read.option("sep", "\t").option("header", True).csv(path).columns
    fields = lines.filter("pos > 0").select("file", "pos", F.split("line", "\t", -1).alias("f"))
    out = fields.select("file", "pos", *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return out.withColumn("ts", F.col(f"`{timestamp}`").try_cast("timestamp_ntz"))


def write_files(lines: DataFrame, directory: str) -> str:
    """A text file for each `file` of lines (file, pos, line), in order of pos, packed where its name ends in .gz; returns the directory.

    Each file is written by a task; the driver only moves them to their names. All names must be packed, or none.
    """
    spark = lines.sparkSession
    packed = lines.select(F.endswith(F.col("file"), F.lit(".gz")).alias("gz")).distinct().collect()  # two rows at most
    if len(packed) > 1:
        raise ValueError("some names end in .gz and some do not")
    kind = "gzip" if packed and packed[0]["gz"] else "none"
    rows = lines.repartition("file").sortWithinPartitions("file", "pos").select("file", "line")
    rows.write.partitionBy("file").option("compression", kind).text(directory)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(directory).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in fs.globStatus(path(f"{directory}/file=*/part-*")) or []:
        name = unquote(part.getPath().getParent().getName().split("=", 1)[1])
        fs.rename(part.getPath(), path(f"{directory}/{name}"))
        fs.delete(part.getPath().getParent(), True)
    return directory


def time_axis(data: DataFrame, timestamp: str) -> DataFrame:
    """data with ts parsed from a column (with or without Z), as UTC."""
    return data.withColumn("ts", F.coalesce(F.try_to_timestamp(F.col(f"`{timestamp}`")).cast("timestamp_ntz"), F.col(f"`{timestamp}`").try_cast("timestamp_ntz")))


def indexed(data: DataFrame, timestamp: str, names: dict[int, str] | None = None, drop_unused: bool = True) -> DataFrame:
    """data with its channels renamed (see rename_channels), ts parsed from a column, in time order."""
    keys = [c for c in ("file", "pos", timestamp) if c in data.columns]
    new = rename_channels([c for c in data.columns if c not in keys], names or {}, drop_unused)
    renamed = data.select(*[F.col(f"`{c}`") for c in keys], *[F.col(f"`{old}`").alias(name) for old, name in new.items()])
    return time_axis(renamed, timestamp).orderBy("ts", *[c for c in ("file", "pos") if c in keys])


def export_days(start: str, end: str, present: DataFrame) -> DataFrame:
    """Calendar days from start to end that present (column date) lacks: what an export still has to fetch."""
    spark = present.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))
    return days.join(present.select("date").distinct(), "date", "left_anti")

"""Findings kept in a folder, by series and day; writing the same ones again changes nothing.

A write replaces the partitions (series, day) that it covers, and no others: those that have findings, and those it is
told were looked at, which get a row saying so. A run that finds nothing any more so takes the old findings away.

Each write leaves a commit marker with its number; while it is under way there is a marker `pending`. Readers refuse a
folder whose last write did not end. Writing again, by the same or another run, puts it right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunledger.operators.runs import series_key
from sunledger.schema import FINDING, FINDING_COLUMNS, as_findings

#: A hidden folder, which Spark's readers pass over.
MARKERS = "_commits"


class UnfinishedWrite(RuntimeError):
    """The folder's last write did not end."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def commits(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the writes that ended, oldest first."""
    fs, path = _fs(spark, f"{folder}/{MARKERS}")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []


def _partition(series_id: Column, date: Column) -> list[Column]:
    return [F.concat(F.lit("s"), series_key(series_id)).alias("series"), F.coalesce(date.cast("string"), F.lit("none")).alias("day")]


def looked_at(frame: DataFrame) -> DataFrame:
    """series_id and date of all days that a frame has readings of, and of each series as a whole (date NULL)."""
    return frame.select("series_id", F.explode(F.array(F.to_date("ts"), F.lit(None).cast("date"))).alias("date")).distinct()


def write_findings(findings: DataFrame, folder: str, covered: DataFrame | None = None) -> int:
    """Write findings (as of validate); covered: series_id and date that were looked at (see looked_at). Returns the commit's number.

    A finding belongs to the day it starts on; those without a start (missing signals) to no day of their series.
    """
    spark = findings.sparkSession
    rows = as_findings(findings)
    rows = rows.select(*FINDING_COLUMNS, *_partition(F.col("series_id"), F.to_date("start_ts")))
    if covered is not None:
        seen = covered.select("series_id", "date").distinct()
        rows = rows.unionByName(seen.select("series_id", *_partition(F.col("series_id"), F.col("date"))), allowMissingColumns=True)
    fs, pending = _fs(spark, f"{folder}/{MARKERS}/pending")
    number = (commits(spark, folder) or [0])[-1] + 1
    fs.create(pending, True).close()
    rows.repartition("series", "day").write.partitionBy("series", "day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)
    fs.create(_fs(spark, f"{folder}/{MARKERS}/{number}")[1], True).close()
    fs.delete(pending, False)
    return number


def _committed(spark: SparkSession, folder: str) -> DataFrame:
    fs, pending = _fs(spark, f"{folder}/{MARKERS}/pending")
    if fs.exists(pending) or not commits(spark, folder):
        raise UnfinishedWrite(folder)
    return spark.read.schema(f"{FINDING}, series string, day string").parquet(folder)


def read_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of a folder; series and day, if filtered, choose its partitions."""
    return _committed(spark, folder).filter("check IS NOT NULL")


def read_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """series_id, day, n_findings of all that was looked at or has findings."""
    return _committed(spark, folder).groupBy("series_id", "day").agg(F.count("check").alias("n_findings"))

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunledger.llm.common import discard, materialize

#: Rounds after which it is an error not to have ended (each round at least halves the longest path or so).
MOST_ROUNDS = 40


#: Parts that the rows of one node are dealt into where they meet a number of that node; the planner may split them further.
SALTS = 16


def with_number(rows: DataFrame, numbers: DataFrame, key: str, other: str) -> DataFrame:
    """rows joined with numbers (one row for each key), so that the rows of a frequent key lie in many tasks, dealt by `other`."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    copies = numbers.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "__salt"]).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b); root is the least node of its component.

    Edges stay distributed: each round groups them by node twice, and ends when nothing changes.
    A node's neighbours are only reduced to their least, never gathered.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        if now.isEmpty():
            break
        # large star: neighbours above a node go to the least of its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = with_number(both, least, "a", "b").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: neighbours below a node, and it, go to the least of them
        down = large.filter("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = with_number(down, low, "a", "b")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        old, now = now, materialize(small.filter("a <> b").distinct(), "edges")
        discard(old)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if mark == before and mark[0] == mark[2]:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

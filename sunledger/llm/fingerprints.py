"""Document fingerprints: a sketch of every shingle hash under a fixed fraction of all hashes.

Whether a hash is kept depends on nothing but the hash, so a sketch grows with its text, the sketch of a union is
the union of the sketches, and the share of one sketch that lies in another estimates containment, however unequal
the two are in length. DataFrame functions only.

A shingle is five words `[^\\x20\\x09-\\x0D]+` (all words, where a text has one to four); a text without words has
an empty sketch. Where no hash is under the fraction, the least one is kept, so a short text has a sketch too; a
union drops such a hash as soon as the other side has one under the fraction. Null texts count as empty. Two empty
sketches are alike (1), an empty and another one are not (0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunledger.llm.common import materialize

SHINGLE = 5
#: Hashes are 16 hex digits; those under this are kept: 1/16 of all.
BELOW = "1"
DIGITS = 16


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sketch(text: Column, shingle: int = SHINGLE, below: str = BELOW) -> Column:
    """Sorted distinct hashes (hex) of text's shingles under the fraction; else the least one."""

    def hashes(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - shingle, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.left(F.md5(F.concat_ws(" ", *[F.get(words, i + k) for k in range(shingle)])), F.lit(DIGITS)))

    def kept(found: Column) -> Column:
        under = F.sort_array(F.array_distinct(F.filter(found, lambda h: h < below)))
        return _let(under, lambda u: F.when((F.size(u) > 0) | (F.size(found) == 0), u).otherwise(F.array(F.array_min(found))))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _let(_let(words, hashes), kept)


def merged(a: Column, b: Column, below: str = BELOW) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""

    def kept(both: Column) -> Column:
        return _let(F.filter(both, lambda h: h < below), lambda u: F.when((F.size(u) > 0) | (F.size(both) == 0), u).otherwise(F.array(F.array_min(both))))

    return _let(F.sort_array(F.array_union(a, b)), kept)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(1.0))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of both, 0 to 1."""
    return _share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a lies in an empty b only."""
    return F.when((F.size(a) == 0) & (F.size(b) > 0), 0.0).otherwise(_share(F.size(F.array_intersect(a, b)), F.size(a)))


def as_text(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _followers(classes: DataFrame) -> DataFrame:
    """k, to_k, half: k follows to_k in descending order, half: how much to_k takes of it. classes: k, doc_id, half.

    The order is cut into ranges; windows run inside one, and over one row for each range.
    """
    placed = classes.repartitionByRange(F.col("doc_id").desc_nulls_last(), F.col("k")).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "k")
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()), "order")
    placed = placed.select("k", "at", F.shiftright("at", 33).alias("range"), F.struct(F.col("k").alias("to_k"), "half").alias("own"))
    ranges = placed.groupBy("range").agg(F.max_by("own", "at").alias("own"))
    by_range = Window.orderBy("range")
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("range", F.coalesce(F.lag("own").over(by_range), F.last("own").over(whole)).alias("before"))
    inside = F.lag("own").over(Window.partitionBy("range").orderBy("at"))
    linked = placed.withColumn("inside", inside).join(ranges, "range")
    return linked.select("k", F.inline(F.array(F.coalesce("inside", "before"))))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, and that of its text with the last half replaced by the next document's beginning.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_edited,
    contained_next, next_id. docs: doc_id, text; other columns are not looked at. The next document has the next smaller
    doc_id (null: least of all), of one doc_id that with the next larger hash of its text; the last one's next is the
    first. Rows alike in both are one document, and each of them gets its results. An empty table has an empty result.

    Copies are dropped before anything else is moved; every text is shuffled once, and half as much again goes to the
    document before it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "text"), 256)
    rows = rows.withColumn("k", key)
    size = F.length("text")
    classes = rows.select("k", "doc_id", (size - F.ceil(size / 2)).cast("int").alias("half")).groupBy("k", "doc_id", "half").agg(F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    once = F.row_number().over(Window.partitionBy("k").orderBy("doc_id"))
    texts = rows.withColumn("nr", once).filter("nr = 1").select("k", "doc_id", "text", sketch(F.col("text")).alias("s"))
    sent = texts.join(_followers(classes.drop("copies")), "k").select(
        F.col("to_k").alias("k"), F.col("doc_id").alias("next_id"), F.substring("text", F.lit(1), F.col("half")).alias("start"), F.col("s").alias("next_s")
    )
    both = texts.join(sent, "k").withColumn("edited", F.concat(F.substring("text", F.lit(1), F.ceil(F.length("text") / 2).cast("int")), "start"))
    both = both.withColumn("edited_s", sketch(F.col("edited"))).join(classes.select("k", "copies"), "k")
    out = both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("s")).alias("fingerprint"), as_text(F.col("edited_s")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("edited_s")).alias("near_edited"), resemblance(F.col("s"), F.col("next_s")).alias("near_next"),
        containment(F.col("s"), F.col("edited_s")).alias("contained_edited"), containment(F.col("s"), F.col("next_s")).alias("contained_next"), "next_id", "copies",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")

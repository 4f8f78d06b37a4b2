"""Repeated stretches across a corpus, from winnowed anchors.

A document is a sequence of units (bytes, or words). Every window of `window` units picks
its anchor: the least hash among the grams of `gram` units inside it, the first of equal ones.
Windows that share an anchor position form one context, so equal windows always pick equal
anchors at the same place, and only rows per anchor are shuffled, about 2 / (window - gram + 2) of the units.

1. Occurrences of contexts are dealt by the anchor's hash. Inside a task, contexts met more
   than once are first reduced to one row each (their occurrences are known repeats).
2. Contexts whose whole content occurs again are settled: all their windows repeat.
   Contexts alone with their anchor are settled too: none does.
3. What is left are edges of repeats: distinct contexts that share an anchor. Only their
   content is looked at (see suffix_dedup and extension).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunledger.llm.common import NULL_IDS, Rolling, U, byte_values, chunks, mix, row_id, row_key, separators, signed, sliding_min, word_hashes, word_spans

#: Bits of an anchor's hash that are shuffled; a chance clash only adds work.
ANCHOR_BITS = 48
#: Low bits of a hash that are not compared when anchors are picked, whatever the chunk's size.
PLACE_BITS = 24
LOW = (1 << PLACE_BITS) - 1
#: Rows that a task gathers before it reduces them.
REDUCE_ROWS = 1_500_000


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value of every `width` neighbours, whatever lies around them."""
    at = np.arange(len(values))
    size = 1
    while size * 2 <= width:
        left, right = at[:-size], at[size:]
        at = np.where(values[right] < values[left], right, left)
        size *= 2
    if size < width:
        left, right = at[: len(at) - (width - size)], at[width - size :]
        at = np.where(values[right] < values[left], right, left)
    return at


class Sequences:
    """Units of a chunk of texts: values to hash, offset of each row's first unit, and places in the bytes."""

    def __init__(self, unit: str) -> None:
        self.unit, self.values, self.is_sep, self.roll = unit, byte_values(), separators(), Rolling()

    def load(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Fill the rolling hash and return the bounds in units."""
        if self.unit == "word":
            self.start, self.end, word_bounds = word_spans(data, bounds, self.is_sep)
            units, bounds = word_hashes(self.roll, self.values, data, self.start, self.end), word_bounds
        else:
            units = self.values[data]
        self.roll.load(units)
        self.units = units
        return bounds

    def contexts(self, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
        """Anchor hash, row, first and last window of each context."""
        grams = self.roll.grams(gram)
        width = window - gram + 1
        first, last = bounds[:-1], bounds[1:] - window
        if len(grams) < width or not (last >= first).any():
            none = np.zeros(0, np.int64)
            return none.view(U), none, none, none
        if len(grams) <= LOW:  # places fit under the bits that are compared
            picked = (sliding_min((grams & ~U(LOW)) | np.arange(len(grams), dtype=U), width) & U(LOW)).astype(np.int64)
        else:
            picked = first_least(grams >> U(PLACE_BITS), width)
        has = np.flatnonzero(last >= first)
        starts = np.zeros(len(picked) + 1, np.int32)
        np.add.at(starts, first[has], 1)
        np.add.at(starts, last[has] + 1, -1)
        at = np.flatnonzero(np.cumsum(starts)[:-1] > 0)
        row = np.searchsorted(bounds, at, side="right") - 1
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(picked[at]) != 0) | (np.diff(row) != 0)]))
        lo, hi = at[cut], np.concatenate([at[cut[1:] - 1], at[-1:]])
        return grams[picked[lo]] >> U(64 - ANCHOR_BITS), row[cut], lo, hi


OCCURRENCES = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("place", pa.int64()), ("times", pa.int32())])


def _reduce(rows: list[tuple[np.ndarray, ...]], earliest: bool) -> pa.RecordBatch:
    """times 0: known repeat, only for its place. Others: one for each context; times is how often it was met."""
    anchor, context, doc, th, place = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((place, th, doc, context, anchor))
    anchor, context, doc, th, place = (x[order] for x in (anchor, context, doc, th, place))
    new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(context) != 0)])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(new)))[group].astype(np.int32)
    if earliest:  # only documents after the first one repeat it
        known = doc > np.maximum(doc[first[group]], NULL_IDS)
        keep_rep, times = np.flatnonzero(~known), np.ones(len(new), np.int32)
    else:
        known, keep_rep = times > 1, first
    take = np.concatenate([keep_rep, np.flatnonzero(known)])
    is_known = np.arange(len(take)) >= len(keep_rep)
    # a known repeat needs no partner: it goes wherever its document's hash sends it
    far = signed(mix(doc[take].astype(U)) >> U(64 - ANCHOR_BITS)) | (1 << 62)
    return pa.record_batch([np.where(is_known, far, anchor[take]), np.where(is_known, 0, context[take]), doc[take], th[take], place[take], np.where(is_known, 0, times[take]).astype(np.int32)], schema=OCCURRENCES)


def pack_place(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First window and number of windows in one number."""
    return lo * 65536 + count


def occurrences(docs: DataFrame, unit: str, window: int, gram: int, earliest: bool) -> DataFrame:
    """docs: doc_id, th, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = Sequences(unit)
        rows: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            ids, th = batch["doc_id"].to_numpy(zero_copy_only=False), batch["th"].to_numpy(zero_copy_only=False)
            for i, j, data, bounds in chunks(batch["text"]):
                bounds = seq.load(data, bounds)
                anchor, row, lo, hi = seq.contexts(bounds, window, gram)
                if len(anchor):
                    rows.append((signed(anchor), signed(seq.roll.slices(lo, hi + window)), ids[i:j][row], th[i:j][row], pack_place(lo - bounds[row], hi - lo + 1)))
                    n += len(anchor)
            if n >= REDUCE_ROWS:
                yield _reduce(rows, earliest)
                rows, n = [], 0
        if rows:
            yield _reduce(rows, earliest)

    return docs.mapInArrow(run, "anchor long, context long, doc_id long, th long, place long, times int")


def settle(found: DataFrame, earliest: bool) -> DataFrame:
    """Rows (doc_id, th, anchor, place, kind, alone, partners): kind 2 repeats as a whole, 1 must be looked at.

    alone: a row of kind 1 whose own windows are in question (others only serve as partners).
    earliest: only a document with a smaller doc_id makes a repeat.
    """
    same = Window.partitionBy("anchor", "context")
    group = Window.partitionBy("anchor")
    rows = found.repartition("anchor")  # the windows below need no further shuffle
    rows = rows.withColumns({"nr": F.row_number().over(same.orderBy("doc_id", "th", "place")), "total": F.sum("times").over(same), "least": F.min("doc_id").over(same)})
    rows = rows.withColumns({"partners": F.count_if(F.col("nr") == 1).over(group), "group_least": F.min("doc_id").over(group)})
    known = F.col("times") == 0
    if earliest:
        whole = known | (F.col("doc_id") > F.greatest("least", F.lit(NULL_IDS)))
        alone = ~whole & (F.col("doc_id") > F.greatest("group_least", F.lit(NULL_IDS)))
    else:
        whole = known | (F.col("total") > 1)
        alone = ~whole
    rows = rows.withColumns({"whole": whole, "alone": alone & (F.col("partners") > 1) & ~known})
    rows = rows.withColumn("any_alone", F.max("alone").over(group))
    # a context that is met more than once is a partner through its first row only
    partner = ~known & F.col("any_alone") & ((F.col("nr") == 1) | F.col("alone"))
    # where a task reduced a context, its occurrences came as known repeats of their own
    reduced = (F.col("times") > 1) & F.lit(not earliest)
    rows = rows.withColumn("kind", F.explode(F.array_compact(F.array(F.when(F.col("whole") & ~reduced, F.lit(2)), F.when(partner, F.lit(1))))))
    return rows.select("doc_id", "th", F.when(F.col("kind") == 1, F.col("anchor")).alias("anchor"), "place", "kind", F.when(F.col("kind") == 1, F.col("alone")).alias("alone"), F.when(F.col("kind") == 1, F.col("partners")).alias("partners"))


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, th, text of documents; null ids are told apart by text and count as the least id."""
    return documents.select(row_id(F.col("doc_id"), F.col("text")), row_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))


def per_document(settled: DataFrame, kind: int) -> DataFrame:
    """One row for each document with its places of one kind (bounded by the document's length)."""
    rows = settled.filter(F.col("kind") == kind)
    items = F.struct("place", "anchor", "alone", "partners") if kind == 1 else F.col("place")
    return rows.groupBy("doc_id", "th").agg(F.collect_list(items).alias("found"))


def ranges_mask(n: int, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n units lie in any of the ranges."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.minimum(lo, n), 1)
    np.add.at(change, np.minimum(end, n), -1)
    return np.cumsum(change)[:n] > 0


def list_rows(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list column, null as empty."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]), column.flatten()


def unite(docs: DataFrame, *places: DataFrame) -> DataFrame:
    """docs with column found: places of repeated windows of each document, or null."""
    every = places[0]
    for more in places[1:]:
        every = every.unionByName(more)
    lists = every.groupBy("doc_id", "th").agg(F.collect_list("place").alias("found"))
    return docs.join(lists, ["doc_id", "th"], "left")


def covered(place: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n units the windows at these places cover."""
    lo = place >> 16
    return ranges_mask(n, lo, lo + (place & 65535) - 1 + window)

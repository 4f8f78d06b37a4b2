"""Extension of seeds to both sides, for substring_dedup.

A member is a seed in a document with its surroundings: the words before it (nearest first) and the words from its
start on, as far as the windows in question reach. Members are joined on their seed (`key`). All
members of a seed are extended together, one word at a time: those that share the next word go on as one class, a member
that nobody shares it with stops. A window with l words before the seed repeats where one other member shares
these l words and the rest after it, so where both classes of a member coincide with another's.

Members of one seed are gathered in one task up to a limit. A seed with more is lengthened first: each window lacks
`free` words beside the seed, so it has at least half of them before it or at least half after it. A member is dealt
again under the seed lengthened to the left, for its windows of the first sort, and under the seed lengthened
to the right, for the others, until a seed is rare enough or as long as a window. Then all its members are equal,
and the least document decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunledger.llm.common import NULL_IDS, U, chunks, materialize, signed
from sunledger.llm.repeats import ANCHOR_BITS, Sequences, list_rows, pack_place

#: Members of one seed that one task may gather.
SEED_MEMBERS = 50_000
#: Members that a task extends together (whole seeds).
TASK_MEMBERS = 50_000

MEMBERS = "key long, doc_id long, th long, first long, windows long, seed long, alone boolean, before array<long>, after array<long>"
FIELDS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("windows", pa.int64()), ("seed", pa.int64()), ("alone", pa.bool_()), ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))])


def _lists(values: np.ndarray, start: np.ndarray, length: np.ndarray, step: int) -> pa.Array:
    """values[start], values[start + step] ... for each start."""
    ends = np.cumsum(length)
    at = np.repeat(start - step * (ends - length), length) + step * np.arange(ends[-1] if len(ends) else 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values[at]))


def members(docs: DataFrame, edges: DataFrame, window: int, gram: int) -> DataFrame:
    """docs: doc_id, th, text; edges: found, the contexts of each document that must be looked at."""
    free = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = Sequences("word")
        for batch in batches:
            ids, th = batch["doc_id"].to_numpy(), batch["th"].to_numpy()
            cuts, items = list_rows(batch["found"])
            place, anchor, alone = (np.asarray(items.field(x)) for x in ("place", "anchor", "alone"))
            for i, j, data, bounds in chunks(batch["text"]):
                own = slice(cuts[i], cuts[j])
                if own.start == own.stop:
                    continue
                bounds = seq.load(data, bounds)
                row = np.repeat(np.arange(i, j), np.diff(cuts[i : j + 1]))
                base, lo, count = bounds[row - i], place[own] >> 16, place[own] & 65535
                seeds = signed(seq.roll.grams(gram) >> U(64 - ANCHOR_BITS))
                seed = lo.copy()
                for k in range(free, -1, -1):  # the first gram of the first window that is the anchor
                    seed = np.where(seeds[base + lo + k] == anchor[own], lo + k, seed)
                units = signed(seq.units)
                before = _lists(units, base + seed - 1, seed - lo, -1)
                after = _lists(units, base + seed, lo + count - 1 + window - seed, 1)
                columns = (anchor[own], ids[row], th[row], lo, count, seed, alone[own].astype(bool))
                yield pa.record_batch([*(pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=False)), before, after], schema=FIELDS)

    return docs.join(edges, ["doc_id", "th"]).select("doc_id", "th", "text", "found").mapInArrow(run, MEMBERS)


def _shared(of: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members `of` that share all keys with another one, sorted by them, and their class (a number from 0)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= np.diff(key[order]) != 0
    again = np.flatnonzero(~(new & np.append(new[1:], True)))
    return of[order[again]], np.cumsum(new)[again] - 1


def _extend_side(key: np.ndarray, words: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Class of each member after 0, 1, ... words to one side (rows); -1 from where it ends or nobody shares the next word."""
    out = np.full((words.shape[1] + 1, len(key)), -1, np.int64)
    at, found = _shared(np.arange(len(key)), key)
    out[0, at] = found
    for k in range(words.shape[1]):
        at = np.flatnonzero((out[k] >= 0) & (length > k))
        if not len(at):
            break
        at, found = _shared(at, out[k, at], words[at, k])
        out[k + 1, at] = found
    return out


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of a matrix, and their lengths."""
    cuts, values = list_rows(column)
    length = np.diff(cuts)
    out = np.zeros((len(length), width), np.int64)
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(row)) - cuts[row]] = values.to_numpy(zero_copy_only=False)
    return out, length


def extend(rows: pa.Table, window: int, gram: int) -> pa.RecordBatch:
    """doc_id, th, place of the windows that repeat, as maximal runs inside each member; rows: all members of some seeds."""
    free = window - gram
    rows = rows.combine_chunks()
    key, doc, th, first, windows, seed = (rows[c].to_numpy() for c in ("key", "doc_id", "th", "first", "windows", "seed"))
    alone = rows["alone"].to_numpy()
    left = _extend_side(key, *_padded(rows["before"].combine_chunks(), free))
    right = _extend_side(key, *_padded(rows["after"].combine_chunks(), window))
    again = np.zeros((len(key), free + 2), bool)  # column c: the window with free - c words before the seed
    for words in range(free + 1):
        start = seed - words
        at = np.flatnonzero((left[words] >= 0) & (right[window - words] >= 0) & (start >= first) & (start < first + windows))
        at, found = _shared(at, left[words, at], right[window - words, at])
        if len(at):
            heads = np.flatnonzero(np.concatenate([[True], np.diff(found) != 0]))
            least = np.repeat(np.minimum.reduceat(doc[at], heads), np.diff(np.append(heads, len(at))))
            again[at, free - words] = alone[at] & (doc[at] > np.maximum(least, NULL_IDS))
    change = np.diff(again.astype(np.int8), axis=1, prepend=np.int8(0))
    row, begin = np.nonzero(change == 1)
    end = np.nonzero(change == -1)[1]
    return pa.record_batch([doc[row], th[row], pack_place(seed[row] - free + begin, end - begin)], names=["doc_id", "th", "place"])


def extend_sorted(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, th, place of repeated windows of members, a bounded number of whole seeds at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not len(batch):
                continue
            waiting.append(batch)
            n += len(batch)
            if n >= TASK_MEMBERS:
                table = pa.Table.from_batches(waiting)
                key = table["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last seed may go on
                if cut:
                    yield extend(table.slice(0, cut), window, gram)
                waiting, n = table.slice(cut).to_batches(), len(key) - cut
        if n:
            yield extend(pa.Table.from_batches(waiting), window, gram)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, th long, place long")


def lengthen(rows: DataFrame, gram: int) -> DataFrame:
    """Members under seeds lengthened to the left and to the right; rows: members with `have_left` and `have_right`, the
    words that their key already holds beside the gram, and `lacks`, the words it lacks to a window (not 0)."""
    more = F.floor((F.col("lacks") + 1) / 2).cast("int")
    last = F.col("first") + F.col("windows") - 1
    to_left, to_right = F.col("have_left") + more, F.col("have_right") + F.col("lacks") - more + 1
    left = rows.withColumns({
        "windows": F.least(last, F.col("seed") - to_left) - F.col("first") + 1,
        "key": F.xxhash64("key", F.lit("left"), F.slice("before", F.col("have_left") + 1, more)),
        "have_left": to_left, "lacks": F.col("lacks") - more,
    })
    start = F.greatest(F.col("first"), F.col("seed") - to_left + 1)
    right = rows.withColumns({
        "first": start, "windows": last - start + 1, "before": F.slice("before", F.lit(1), (F.col("seed") - start).cast("int")),
        "key": F.xxhash64("key", F.lit("right"), F.slice("after", F.col("have_right") + gram + 1, to_right - F.col("have_right"))),
        "have_right": to_right, "lacks": more - 1,
    })
    return left.unionByName(right).filter("windows > 0")


def repeated_windows(docs: DataFrame, edges: DataFrame, seeds: DataFrame, window: int, gram: int, limit: int = SEED_MEMBERS) -> DataFrame:
    """doc_id, th, place of the windows of edges that also start in a document with a smaller id.

    seeds: anchor of each context to be looked at, one row each.
    """
    free = window - gram
    rows = members(docs, edges, window, gram)
    often = seeds.groupBy("anchor").count().filter(F.col("count") > limit).select(F.col("anchor").alias("key"))
    if often.isEmpty():
        return extend_sorted(rows, window, gram)
    rows = materialize(rows, "members")
    rare = [rows.join(often, "key", "left_anti")]
    rows = rows.join(often, "key", "left_semi").withColumns({"have_left": F.lit(0), "have_right": F.lit(0), "lacks": F.lit(free)})
    whole = []
    while True:
        whole.append(rows.filter("lacks = 0"))
        rows = materialize(lengthen(rows.filter("lacks > 0"), gram), "members")
        often = rows.groupBy("key").count().filter(F.col("count") > limit).select("key")
        if often.isEmpty():
            rare.append(rows)
            break
        rare.append(rows.join(often, "key", "left_anti"))
        rows = rows.join(often, "key", "left_semi")
    names = FIELDS.names
    every = rare[0].select(names)
    for part in rare[1:]:
        every = every.unionByName(part.select(names))
    same = whole[0].select(names)
    for part in whole[1:]:
        same = same.unionByName(part.select(names))
    least = same.groupBy("key").agg(F.min("doc_id").alias("least"))
    equal = same.filter("alone").join(least, "key").filter(F.col("doc_id") > F.greatest("least", F.lit(NULL_IDS)))
    return extend_sorted(every, window, gram).unionByName(equal.select("doc_id", "th", (F.col("first") * 65536 + F.col("windows")).alias("place")))

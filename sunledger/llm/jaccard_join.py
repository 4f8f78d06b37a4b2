"""N-gram Jaccard join with adaptive multi-match prefixes.

1. Each document becomes the set of hashes of its word shingles; equal sets are one node.
2. A sketch of fixed size counts shingles by hash slot over all documents. Its order, rare
   first, is the order of all sets, and of each set only a prefix is dealt by shingle: two
   sets over the threshold must share a shingle of both prefixes.
3. Sets that meet on a shingle are compared by size and by parity bitmaps, whose differing
   bits are at most the differing shingles, so no link is lost. What is left are edges of a
   forest, whose components (see components) hold all links in small groups of sets.
4. Each group is joined exactly. Shingles are ordered by their frequency in the group, and
   every set lengthens its prefix while the candidates that a longer prefix with one more
   required match would save cost more than its lists: with l - 1 more shingles, l common
   ones are required before a candidate is verified by its whole intersection.

Lists over BLOCK and groups over SET_BLOCK members are split into pairs of blocks, so no task holds more.

Defined cases: null texts and texts without words have no shingles and no links; with fewer
words than a shingle the whole sequence is the only one; repeated rows and equal sets are
linked; a null doc_id counts as larger than all; a very long text is read whole by one worker, and its
set must fit there; other columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunledger.llm.common import Rolling, U, byte_values, chunks, lowered, materialize, mix, own_id, row_id, row_key, separators, signed, word_hashes, word_spans, worker_cache
from sunledger.llm.components import components, with_number

#: Slots of the frequency sketch, and least length of a set's parity bitmap.
SKETCH_SLOTS, BITMAP_BITS = 1 << 20, 1024
#: Members of a list (by bitmap), and of a group (by whole sets), that are compared in one task with as many others.
BLOCK, SET_BLOCK = 1024, 512
#: Longest prefix that is tried: shares of required matches.
MOST_MATCHES = 8


class Shingles:
    """Distinct shingle hashes of each row of a chunk, sorted within the row."""

    def __init__(self, k: int) -> None:
        worker_cache().clear()
        self.k, self.values, self.is_sep, self.low, self.roll = k, byte_values(), separators(), lowered(), Rolling()

    def load(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = self.low[data]
        start, end, first = word_spans(data, bounds, self.is_sep)
        self.roll.load(word_hashes(self.roll, self.values, data, start, end))
        words = np.diff(first)
        count = np.where(words > 0, np.maximum(words - self.k + 1, 1), 0)
        row = np.repeat(np.arange(len(words)), count)
        at = first[:-1][row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
        h = self.roll.slices(at, np.minimum(at + self.k, first[1:][row]))
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.concatenate([[True], (np.diff(row) != 0) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
        row, h = row[new], h[new]
        return h, np.searchsorted(row, np.arange(len(words) + 1))


def set_ids(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    total = np.concatenate([[U(0)], np.cumsum(mix(h), dtype=U)])
    return signed(mix((total[at[1:]] - total[at[:-1]]) + np.diff(at).astype(U) * U(0x9E3779B97F4A7C15)))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any set over the threshold."""
    return -(-percent * n // 100)


def bitmap_bits(n: np.ndarray) -> np.ndarray:
    """Length of the parity bitmap of a set of n: a power of two, at least BITMAP_BITS and half of n."""
    return BITMAP_BITS << np.ceil(np.log2(np.maximum(n / (2 * BITMAP_BITS), 1))).astype(np.int64)


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Logarithm (in eighths) of the number of sets in each slot. Each task sends its non-zero slots in 64 packed parts."""
    step = SKETCH_SLOTS // 64
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts = Shingles(k), np.zeros(SKETCH_SLOTS, np.int64)
        for batch in batches:
            for _, _, data, bounds in chunks(batch["text"]):
                h, _ = reader.load(data, bounds)
                counts += np.bincount((h >> U(44)).astype(np.int64), minlength=SKETCH_SLOTS)
        if counts.any():
            packed = np.minimum(counts, 2**32 - 1).astype("<u4")
            yield pa.record_batch([pa.array(range(64), pa.int32()), pa.array([packed[i * step : (i + 1) * step].tobytes() for i in range(64)], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch["part"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                one = np.frombuffer(raw, "<u4" if len(raw) == 4 * step else "<i8")
                sums[part] = sums.get(part, 0) + one.astype(np.int64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], schema=schema)

    parts = docs.select("text").mapInArrow(run, "part int, counts binary").repartition("part").mapInArrow(add, "part int, counts binary")
    total = np.zeros(SKETCH_SLOTS, np.int64)
    for r in parts.collect():  # 64 parts of a fixed size
        total[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["counts"], "<i8")
    return np.rint(8 * np.log2(1 + total)).astype(np.uint16)


def _members(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th, the set's id and size, and its parity bitmap, of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("bitmap", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Shingles(k)
        for batch in batches:
            for i, j, data, bounds in chunks(batch["text"]):
                h, at = reader.load(data, bounds)
                bitmaps: list[bytes] = []
                for a in range(0, j - i, 256):  # short texts make many rows
                    own = at[a : a + 257]
                    bits = bitmap_bits(np.diff(own))
                    head = np.concatenate([[0], np.cumsum(bits)])
                    bit = (h[own[0] : own[-1]] & (np.repeat(bits, np.diff(own)) - 1).astype(U)).astype(np.int64) + np.repeat(head[:-1], np.diff(own))
                    packed = np.packbits((np.bincount(bit, minlength=int(head[-1])) & 1).astype(np.uint8))
                    bitmaps += [packed[x // 8 : y // 8].tobytes() for x, y in zip(head[:-1].tolist(), head[1:].tolist(), strict=True)]
                yield pa.record_batch([batch["doc_id"][i:j], batch["th"][i:j], set_ids(h, at), np.diff(at), pa.array(bitmaps, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, th long, sid long, n long, bitmap binary")


def _prefixes(docs: DataFrame, k: int, percent: int, order) -> DataFrame:
    """sid, n and a shingle of its prefix, for each set that a task meets."""
    schema = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("shingle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sketch = Shingles(k), order.value
        met: set[int] = set()
        for batch in batches:
            for _, _, data, bounds in chunks(batch["text"]):
                h, at = reader.load(data, bounds)
                n = np.diff(at)
                sid = set_ids(h, at)
                fresh = np.zeros(len(n), bool)
                for row, s in enumerate(sid.tolist()):
                    if s not in met and n[row]:
                        fresh[row] = True
                        met.add(s)
                row = np.repeat(np.arange(len(n)), n)
                mine = fresh[row]
                row, h = row[mine], h[mine]
                by = np.lexsort((h, sketch[(h >> U(44)).astype(np.int64)], row))
                row, h = row[by], h[by]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                take = place < (n - needed(n, percent) + 1)[row]
                row, h = row[take], h[take]
                yield pa.record_batch([sid[row], n[row], signed(h)], schema=schema)

    return docs.select("text").mapInArrow(run, "sid long, n long, shingle long")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """rows (sid, root, size, text) with the whole set of the text: root, size, sid, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Shingles(k)
        for batch in batches:
            for i, j, data, bounds in chunks(batch["text"]):
                h, at = reader.load(data, bounds)
                sets = [h[a:b].astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[c][i:j] for c in ("root", "size", "sid")), pa.array(sets, pa.binary())], names=["root", "size", "sid", "whole"])

    return rows.mapInArrow(run, "root long, size long, sid long, whole binary")


def _in_blocks(rows: DataFrame, member: str, size: str, block: int) -> DataFrame:
    """rows with columns left and right: the pair of blocks that a row belongs to; both 0 for keys of up to block members."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    return rows.withColumns({"own": own, "other": other}).withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")})


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, as Python objects are made of them."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def _forest(percent: int):
    """Edges of a forest over the sets of each list that may be linked, by size and bitmaps."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(sid: np.ndarray, n: np.ndarray, bitmaps: list[bytes]) -> list[tuple[int, int]]:
        by = np.lexsort((sid, n))
        sid, n, bitmaps = sid[by], n[by], [bitmaps[i] for i in by]
        width = np.fromiter(map(len, bitmaps), np.int64, len(bitmaps))
        whole: dict[int, np.ndarray] = {}
        place = np.zeros(len(sid), np.int64)
        for w in np.unique(width).tolist():
            of = np.flatnonzero(width == w)
            whole[w] = np.frombuffer(b"".join([bitmaps[i] for i in of]), "<u8").reshape(len(of), -1)
            place[of] = np.arange(len(of))
        # a bitmap twice as long, folded: parity at half the length
        folded = {w: m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :] for w, m in whole.items()}
        label = np.arange(len(sid))
        edges = []
        for i in range(len(sid) - 1):
            last = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
            rest = i + 1 + np.flatnonzero(label[i + 1 : last] != label[i])
            if not len(rest):
                continue
            w = int(width[i])
            mine = whole[w][place[i]]
            differ = np.zeros(len(rest), np.int64)
            for longer, maps in ((w, whole), (2 * w, folded)):
                which = np.flatnonzero(width[rest] == longer)
                if len(which):
                    differ[which] = np.bitwise_count(maps[longer][place[rest[which]]] ^ mine).sum(axis=1, dtype=np.int64)
            both = n[rest] + n[i]
            # overlap >= percent / (100 + percent) of both sizes, so they differ in at most the rest
            may = rest[differ * (100 + percent) <= both * (100 - percent)]
            for j in may.tolist():
                if label[j] != label[i]:
                    edges.append((int(sid[i]), int(sid[j])))
                    label[label == label[j]] = label[i]
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple] = []
        key = None

        def out(rows: list[tuple]) -> list[tuple[int, int]]:
            if len(rows) < 2:
                return []
            sid = np.array([r[0] for r in rows], np.int64)
            _, first = np.unique(sid, return_index=True)
            return solve(sid[first], np.array([rows[i][1] for i in first], np.int64), [rows[i][2] for i in first])

        for batch in _slices(batches):
            found: list[tuple[int, int]] = []
            for *at, sid, n, bitmap in zip(*(batch[c].to_pylist() for c in ("shingle", "left", "right", "sid", "n", "bitmap")), strict=True):
                if at != key:
                    found += out(held)
                    held, key = [], at
                held.append((sid, n, bitmap))
            fresh = [e for e in dict.fromkeys(found) if e not in seen]
            if len(seen) < 100_000:
                seen.update(fresh)
            if fresh:
                yield pa.record_batch(list(zip(*fresh, strict=True)), schema=schema)
        fresh = [e for e in dict.fromkeys(out(held)) if e not in seen]
        if fresh:
            yield pa.record_batch(list(zip(*fresh, strict=True)), schema=schema)

    return run


def links(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of a group, by the adaptive multi-match join (see the module)."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    by = np.argsort(n, kind="stable")
    _, code, df = np.unique(np.concatenate([sets[i] for i in by]), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int32)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df), dtype=np.int32)
    code = rank[code]
    cut = np.concatenate([[0], np.cumsum(n[by])])
    for i in range(len(by)):
        code[cut[i] : cut[i + 1]].sort()
    ordered = [code[cut[i] : cut[i + 1]] for i in range(len(by))]  # views
    n = n[by]
    base = n - needed(n, percent) + 1
    # lists by shingle: (set, required matches from which the shingle is in its prefix)
    longest = np.minimum(base + MOST_MATCHES - 1, n)
    owner = np.repeat(np.arange(len(n), dtype=np.int32), longest)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(longest) - longest, longest)
    token = np.concatenate([o[:m] for o, m in zip(ordered, longest, strict=True)])
    level = np.maximum(place - base[owner] + 2, 1).astype(np.int32)
    sort = np.lexsort((owner, token))
    token, owner, level = token[sort], owner[sort], level[sort]
    begin = np.searchsorted(token, np.arange(len(df) + 1))
    label = np.arange(len(n)) if label is None else label
    out = []
    mark = np.zeros(len(df), bool)
    for x in range(1, len(n)):
        counts = np.zeros(x, np.int32)
        low = int(np.searchsorted(n[:x], needed(n[x : x + 1], percent)[0]))
        if low == x:
            continue
        best = None
        fewest = int(needed(needed(n[x : x + 1], percent), percent)[0])  # common shingles with the smallest partner
        for matches in range(1, MOST_MATCHES + 1):
            if matches > 1 and matches > fewest:
                break
            end = min(base[x] + matches - 1, n[x])
            counts[:] = 0
            scanned = 0
            for t in ordered[x][:end].tolist():
                a, b = begin[t], begin[t + 1]
                if b - a > 1:
                    mine = owner[a:b][(owner[a:b] < x) & (level[a:b] <= matches)]
                    counts[mine] += 1
                    scanned += b - a
            found = low + np.flatnonzero(counts[low:] >= matches)
            found = found[label[found] != label[x]]
            cost = int(n[found].sum())
            if best is None or len(found) < len(best):
                best = found
            if cost <= scanned + int(n[x]):  # a longer prefix costs more than it can save
                break
        best = best if best is not None else np.zeros(0, np.int64)
        if not len(best):
            continue
        mark[ordered[x]] = True
        for y in best.tolist():
            if label[y] != label[x]:
                both = int(np.count_nonzero(mark[ordered[y]]))
                if 100 * both >= percent * (n[x] + n[y] - both):
                    out.append((int(by[y]), int(by[x])))
                    label[label == label[x]] = label[y]
        mark[ordered[x]] = False
    return out


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        key = None

        def out(rows: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
            sid = sorted(dict(rows))
            raw = dict(rows)
            return [(sid[a], sid[b]) for a, b in links([np.frombuffer(raw[s], "<u8") for s in sid], percent)] if len(sid) > 1 else []

        for batch in _slices(batches):
            found: list[tuple[int, int]] = []
            for *at, sid, whole in zip(*(batch[c].to_pylist() for c in ("root", "left", "right", "sid", "whole")), strict=True):
                if at != key:
                    found += out(held)
                    held, key = [], at
                held.append((sid, whole))
            if found:
                yield pa.record_batch(list(zip(*found, strict=True)), schema=schema)
        found = out(held)
        if found:
            yield pa.record_batch(list(zip(*found, strict=True)), schema=schema)

    return run


def jaccard_components(documents: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, row and th (see row_id and row_key), n_shingles, component_id (the least doc_id that links reach) and group (a number for it) of each row."""
    spark = documents.sparkSession
    docs = documents.select(row_id(F.col("doc_id"), F.col("text")), row_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    order = spark.sparkContext.broadcast(_sketch(docs, shingle))  # 2 MB, whatever the corpus
    members = materialize(_members(docs, shingle), "members")
    least = F.min(F.coalesce(own_id(F.col("doc_id")), F.lit((1 << 63) - 1)))
    by_list = Window.partitionBy("shingle")
    lists = _prefixes(docs, shingle, percent, order).repartition("shingle").dropDuplicates(["shingle", "sid"])  # one shuffle serves all three
    lists = materialize(lists.withColumn("length", F.count("*").over(by_list)).filter("length > 1"), "lists")
    bitmaps = members.filter("n > 0").groupBy("sid").agg(F.first("bitmap").alias("bitmap"))
    near = _in_blocks(lists.join(bitmaps, "sid"), "sid", "length", BLOCK).select("shingle", "left", "right", "sid", "n", "bitmap")
    near = near.repartition("shingle", "left", "right").sortWithinPartitions("shingle", "left", "right")
    groups = materialize(components(near.mapInArrow(_forest(percent), "a long, b long")), "groups")
    groups = with_number(groups, groups.groupBy("root").agg(F.count("*").alias("size")), "root", "node").withColumnRenamed("node", "sid")
    # only sets that may have a link are needed whole; one document stands for each, and is read and shuffled once
    stands = members.filter("n > 0").groupBy("sid").agg(F.min(F.struct("doc_id", "th")).alias("d")).join(groups, "sid").select("sid", "root", "size", F.col("d.doc_id").alias("of"), F.col("d.th").alias("of_th"))
    texts = docs.join(stands, (F.col("doc_id") == F.col("of")) & (F.col("th") == F.col("of_th")))
    whole = _in_blocks(_sets(texts.select("sid", "root", "size", "text"), shingle), "sid", "size", SET_BLOCK).select("root", "left", "right", "sid", "whole")
    whole = whole.repartition("root", "left", "right").sortWithinPartitions("root", "left", "right")
    linked = components(whole.mapInArrow(_verify(percent), "a long, b long"))
    # rows of equal sets are made one before sets meet, so neither a frequent set nor a large component fills a task
    linked = materialize(linked.withColumnRenamed("node", "sid"), "linked")
    ids = members.filter("n > 0").groupBy("sid").agg(least.alias("own")).join(linked, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    ids = materialize(ids, "set-ids")
    ids = with_number(ids, ids.groupBy("root").agg(F.min("own").alias("least")), "root", "sid").select("sid", "root", "least")
    rows = members.select("doc_id", "th", "sid", "n")
    nothing = rows.filter("n = 0").withColumns({"root": F.col("sid"), "least": F.lit(None).cast("long")})
    out = with_number(rows.filter("n > 0"), ids, "sid", "doc_id").unionByName(nothing)
    component = F.when(F.col("n") > 0, F.when(F.col("least") < (1 << 63) - 1, F.col("least"))).otherwise(own_id(F.col("doc_id")))
    return out.select(own_id(F.col("doc_id")), F.col("doc_id").alias("row"), "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("root").alias("group"))


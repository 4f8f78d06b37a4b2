"""Suffix-array dedup: removal of bytes that a repeated string of at least `window` bytes covers.

Winnowed anchors settle the inside of long repeats and everything without a partner by hashes of whole contexts (see
repeats); to sort all suffixes of a corpus would shuffle every byte 200 times. What is left, the edges of
repeats, is dealt by anchor; a task sorts the suffixes of bounded runs of whole anchor groups, takes
the Burrows-Wheeler transform and expands intervals breadth-first by backward extension: common
prefixes of neighbours come out by increasing value, and the expansion stops at `window`. Rows
whose common prefix was not found below it start a repeated window.

An anchor with more than MAX_PARTNERS contexts is not gathered in one task: it is lengthened. Each window lacks
`window - gram` bytes beside the anchor and has at least half of them before it or at least half after it; so a
context is dealt again under the anchor lengthened to the left, for its windows of the first sort, and to the right, for
the others, until an anchor is rare enough to be sorted, or is a whole window. Then all its contexts are equal.

Defined cases: null and empty texts have no bytes; matches never cross documents; texts
shorter than a window lose nothing; repeated rows repeat each other; null ids are rows of their own; a
very long text is read whole by one worker; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunledger.llm.common import U, chunks, materialize, own_id, signed
from sunledger.llm.repeats import ANCHOR_BITS, Sequences, covered, keyed, list_rows, occurrences, pack_place, per_document, settle, unite

WINDOW = 200
GRAM = 64
#: Contexts of one anchor that one task may gather (each up to 2 * WINDOW bytes).
MAX_PARTNERS = 4000
#: Bytes of contexts that are sorted together.
SORT_BYTES = 1 << 18
END = 0xFF  # no byte of UTF-8
#: Contexts whose anchors are looked up together.
SEED_ROWS = 1000


def suffix_rows(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the rotations of text, sorted by their first `depth` bytes at least (prefix doubling)."""
    n = len(text)
    padded = np.concatenate([text, np.resize(text, 8)]).astype(U)
    key = np.zeros(n, U)
    for j in range(8):
        key |= padded[j : j + n] << U(56 - 8 * j)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    have = 8
    rank = np.empty(n, np.int64)
    head = np.flatnonzero(new)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    while have < depth:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of two and more
        if not len(tied):
            break
        rows = order[tied]
        key2 = rank[rows] * n + rank[(rows + have) % n]
        by = np.argsort(key2, kind="stable")
        rows, key2 = rows[by], key2[by]
        order[tied] = rows
        new[tied] = np.concatenate([[True], key2[1:] != key2[:-1]])
        head = np.flatnonzero(new)
        rank[order] = np.repeat(head, np.diff(np.append(head, n)))
        have *= 2
    return order


def long_prefix_rows(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each row of the sorted rotations: is its common prefix with the row above at least `length` long?

    A boundary of value v between two rows becomes known in round v. Row i is c + row j, the row
    above it is c + row j', with j' and j neighbouring rows that c precedes; so a boundary
    anywhere in (j', j] of value v puts one of value v + 1 above row i: backward extension of all
    intervals of one round together.
    """
    n = len(order)
    before = text[order - 1]
    rows = np.argsort(before, kind="stable").astype(np.int32)  # row i of the next column comes from rows[i]
    char = before[rows]
    bound = np.zeros(n, np.int32)
    bound[0] = 1
    bound[1:] = char[1:] != char[:-1]  # value 0
    at = np.flatnonzero(bound == 0)
    low, high = rows[at - 1], rows[at]
    for _ in range(1, length):
        seen = np.cumsum(bound, dtype=np.int32)
        hit = seen[high] != seen[low]
        if not hit.any():
            break
        bound[at[hit]] = 1
        left = ~hit
        at, low, high = at[left], low[left], high[left]
    return bound == 0


def repeated_starts(contents: list[bytes], counts: np.ndarray, window: int) -> list[np.ndarray]:
    """For each context, which of its first counts windows occur elsewhere in these contexts."""
    text = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8)
    order = suffix_rows(text, window)
    joined = long_prefix_rows(text, order, window)
    joined[: len(joined) - 1] |= joined[1:]
    repeated = np.zeros(len(text), bool)
    repeated[order[joined]] = True
    out, at = [], 0
    for content, count in zip(contents, counts.tolist(), strict=True):
        out.append(np.flatnonzero(repeated[at : at + count]))
        at += len(content) + 1
    return out


EDGES = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("place", pa.int64()), ("alone", pa.bool_()), ("content", pa.binary()), ("partners", pa.int64())])

#: Columns of an edge that is sorted with its anchor's others.
SORTED = EDGES.names[:-1]


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Content of each edge."""
    for batch in batches:
        ids, th = batch["doc_id"].to_numpy(), batch["th"].to_numpy()
        cuts, items = list_rows(batch["found"])
        place, anchor, alone, partners = (np.asarray(items.field(x)) for x in ("place", "anchor", "alone", "partners"))
        row = np.repeat(np.arange(len(ids)), np.diff(cuts))
        for i, j, data, bounds in chunks(batch["text"]):
            raw = data.tobytes()
            own = slice(cuts[i], cuts[j])
            lo = (place[own] >> 16) + bounds[row[own] - i]
            content = [raw[a:b] for a, b in zip(lo.tolist(), (lo + (place[own] & 65535) - 1 + window).tolist(), strict=True)]
            yield pa.record_batch([anchor[own], ids[row[own]], th[row[own]], place[own], alone[own].astype(bool), pa.array(content, pa.binary()), partners[own]], schema=EDGES)


def _with_seed(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """EDGES with the place of the anchor in the content."""
    seq = Sequences("byte")
    for batch in batches:
        for i in range(0, len(batch), SEED_ROWS):
            part = batch.slice(i, SEED_ROWS)
            contents = part["content"].to_pylist()
            bounds = seq.load(np.frombuffer(b"".join(contents), np.uint8), np.cumsum([0, *map(len, contents)]))
            seeds = signed(seq.roll.grams(gram) >> U(64 - ANCHOR_BITS))
            row = np.searchsorted(bounds, np.arange(len(seeds)), side="right") - 1
            hit = np.flatnonzero(seeds == part["anchor"].to_numpy()[row])
            rows, first = np.unique(row[hit], return_index=True)  # every content holds its anchor
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hit[first] - bounds[rows])], names=[*EDGES.names, "seed"])


def lengthen(rows: DataFrame, window: int) -> DataFrame:
    """Contexts under anchors lengthened to the left and to the right.

    rows: EDGES with seed (place of the anchor in content), have_left and have_right (bytes that the key already holds beside the
    gram), lacks (bytes it lacks to a window, not 0) and gram.
    """
    more = F.floor((F.col("lacks") + 1) / 2).cast("int")
    first, windows = F.shiftright("place", 16), F.col("place").bitwiseAND(65535)
    to_left, to_right = F.col("have_left") + more, F.col("have_right") + F.col("lacks") - more + 1
    start = F.greatest(F.lit(0).cast("long"), F.col("seed") - to_left + 1)

    def part(side: str, begin: Column, n: Column, beside: Column, length: Column) -> dict[str, Column]:
        return {
            "windows": n, "place": (first + begin) * 65536 + n, "content": F.substring("content", (begin + 1).cast("int"), (n - 1 + window).cast("int")), "seed": F.col("seed") - begin,
            "anchor": F.xxhash64("anchor", F.lit(side), F.substring("content", (beside + 1).cast("int"), length.cast("int"))),
        }

    left = rows.withColumns({**part("left", F.lit(0).cast("long"), F.least(windows, F.col("seed") - to_left + 1), F.col("seed") - to_left, more), "have_left": to_left, "lacks": F.col("lacks") - more})
    right = rows.withColumns({**part("right", start, windows - start, F.col("seed") + F.col("gram") + F.col("have_right"), to_right - F.col("have_right")), "have_right": to_right, "lacks": more - 1})
    return left.unionByName(right).filter("windows > 0").drop("windows")


def lengthened(rows: DataFrame, window: int, gram: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Frequent anchors' contexts (EDGES with seed) under anchors of at most `limit` contexts, and under whole windows."""
    rows = rows.withColumns({"have_left": F.lit(0), "have_right": F.lit(0), "lacks": F.lit(window - gram), "gram": F.lit(gram)})
    rare, whole = [], [rows.filter("lacks = 0")]
    while True:
        rows = materialize(lengthen(rows.filter("lacks > 0"), window), "lengthened")
        often = rows.groupBy("anchor").count().filter(F.col("count") > limit).select("anchor")
        if often.isEmpty():
            rare.append(rows)
            break
        often = F.broadcast(often)  # less than one for `limit` contexts; contents are not shuffled for it
        rare.append(rows.join(often, "anchor", "left_anti"))
        rows = rows.join(often, "anchor", "left_semi")
        whole.append(rows.filter("lacks = 0"))
    unite_all = lambda parts: reduce(DataFrame.unionByName, (p.select(SORTED) for p in parts))
    return unite_all(rare), unite_all(whole)


def _expand(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole anchor groups are sorted together."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("place", pa.int64())])

    def solve(rows: pa.Table) -> pa.RecordBatch:
        place = rows["place"].to_numpy()
        found = repeated_starts(rows["content"].to_pylist(), place & 65535, window)
        alone = rows["alone"].to_numpy()
        at = [np.zeros(0, np.int64), *(np.full(len(x), i) for i, x in enumerate(found) if alone[i])]
        start = [np.zeros(0, np.int64), *(x + (place[i] >> 16) for i, x in enumerate(found) if alone[i])]
        at, start = np.concatenate(at), np.concatenate(start)
        # neighbouring starts as one place
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(start) != 1)])) if len(at) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(at)))
        return pa.record_batch([rows["doc_id"].to_numpy()[at[new]], rows["th"].to_numpy()[at[new]], pack_place(start[new], count)], schema=schema)

    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        anchor = batch["anchor"].to_numpy()
        lengths = np.diff(np.frombuffer(batch["content"].buffers()[1], np.int32)[batch["content"].offset :][: len(batch) + 1])
        start = 0
        total = np.cumsum(lengths)
        heads = np.flatnonzero(np.concatenate([[True], np.diff(anchor) != 0]))
        for head in heads.tolist():
            if head == 0 and waiting and waiting[-1]["anchor"][-1].as_py() == anchor[0]:
                continue
            if size + total[head - 1] - (total[start - 1] if start else 0) >= SORT_BYTES if head else size >= SORT_BYTES:
                if head > start:
                    waiting.append(batch.slice(start, head - start))
                yield solve(pa.Table.from_batches(waiting))
                waiting, size, start = [], 0, head
        if start < len(batch):
            waiting.append(batch.slice(start))
            size += int(total[-1] - (total[start - 1] if start else 0))
    if waiting:
        yield solve(pa.Table.from_batches(waiting))


def suffix_dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, max_partners: int = MAX_PARTNERS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (offsets and ends of removed runs), kept (bytes), kept_sha256."""
    docs = keyed(documents)
    texts = docs.select("doc_id", "th", "text")
    settled = materialize(settle(occurrences(texts, "byte", window, gram, False), False), "repeats")
    # rare and frequent anchors' contexts are cut from the texts at once: so texts are shuffled twice, whether any anchor is frequent or not
    edges = texts.join(per_document(settled, 1), ["doc_id", "th"]).select("doc_id", "th", "text", "found")
    fields = "anchor long, doc_id long, th long, place long, alone boolean, content binary, partners long"
    cut = materialize(edges.mapInArrow(lambda b: _cut(b, window), fields), "edges")
    edges, frequent = cut.filter(F.col("partners") <= max_partners).select(SORTED), cut.filter(F.col("partners") > max_partners)
    places = [settled.filter("kind = 2").select("doc_id", "th", "place")]
    if not frequent.isEmpty():
        rare, whole = lengthened(frequent.mapInArrow(lambda b: _with_seed(b, gram), f"{fields}, seed long"), window, gram, max_partners)
        edges = edges.unionByName(rare)
        often = whole.groupBy("anchor").count().filter("count > 1").select("anchor")
        places.append(whole.filter("alone").join(often, "anchor", "left_semi").select("doc_id", "th", "place"))
    starts = edges.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _expand(b, window), "doc_id long, th long, place long")
    places.append(starts)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, items = list_rows(batch["found"])
            place = np.asarray(items)
            for i, j, data, bounds in chunks(batch["text"]):
                out: list[list] = [[], [], [], [], [], []]
                for row in range(i, j):
                    own = data[bounds[row - i] : bounds[row - i + 1]]
                    mask = covered(place[cuts[row] : cuts[row + 1]], len(own), window)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                    left = own[~mask].tobytes()
                    for k, v in enumerate((len(own), int(mask.sum()), len(edge) // 2, edge.reshape(-1, 2).tolist(), left, hashlib.sha256(left).hexdigest())):
                        out[k].append(v)
                yield pa.record_batch([batch["doc_id"][i:j], *(pa.array(x, schema.field(k + 1).type) for k, x in enumerate(out))], schema=schema)

    rows = unite(docs, *places).select("doc_id", "text", "found")
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary, kept_sha256 string")
    return out.select(own_id(F.col("doc_id")), "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")

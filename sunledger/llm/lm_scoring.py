"""Language-model scoring by context-tree weighting over bytes.

The text that is modelled: words, A-Z lower-cased, with one space between them and a newline
at the end; before a text stand newlines. Every byte is coded by eight binary decisions, top
bit first, each with contexts of the last 0 to DEPTH bytes. Every context and decision keeps a
Krichevsky-Trofimov estimate, and context-tree weighting mixes those of all depths by how
well each subtree codes the training text; what training has not met counts 0 to 0.

1. Documents are put into blocks of about BLOCK_BYTES. A block has a row for each distinct
   word and each distinct run of DEPTH + 1 bytes, with how often training texts have it.
2. Runs are summed over all blocks and dealt by their last two context bytes (at most 2**24
   runs share them, whatever the corpus). Each group weighs its depths 2 to DEPTH from the leaves up; depth 1 and the root (255 decisions in
   256 contexts, whatever the corpus) are weighed by the driver and sent back down, which
   gives the code length of each run's last byte.
3. Word counts and code lengths go to the blocks that asked for them, and each block adds
   up its texts. A word or run is one row for each block, so no key is hot, and nothing that
   grows with the corpus is broadcast or collected.

Defined cases: null and empty texts hold only the end; a null doc_id counts as training;
repeated rows count and are scored each; other columns are ignored; a text longer than a
block is a block of its own and must fit into a worker. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunledger.llm.common import Rolling, byte_values, chunks, lowered, materialize, separators, signed, word_hashes, word_spans

#: Bytes of the longest context.
DEPTH = 4
#: Bytes of text whose words and runs are looked up together.
BLOCK_BYTES = 32 << 20
#: Runs of a group of the tree, about; those with the same last two context bytes are never parted.
GROUP_RUNS = 100_000
WORD, RUN, TEXT = 0, 1, 2


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0, by Stirling's series above 8."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * np.where(x < 8, x + i, 1.0)
    y = np.where(x < 8, x + 8, x)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ln of the weighted probability, the share of the own estimate in it, and that estimate's chance of a one.

    below: sum over the children of their ln weighted probabilities; None at the greatest depth.
    """
    own = log_kt(zeros, ones)
    chance = (ones + 0.5) / (zeros + ones + 1.0)
    if below is None:
        return own, np.ones_like(own), chance
    total = np.logaddexp(own, below) - math.log(2)
    return total, np.exp(own - math.log(2) - total), chance


class Tree:
    """Depths `top` to `depth` of the context tree over distinct runs (context bytes, then the byte) with counts."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray, depth: int, top: int) -> None:
        self.runs, self.depth, self.top = runs, depth, top
        self.byte, context = runs & 255, runs >> 8
        counts = counts.astype(np.float64)
        # decisions[k][d]: node of each run, and each node's (weighted, share, chance)
        self.decisions: list[dict[int, tuple]] = []
        for k in range(8):
            prefix, bit = (1 << k) | (self.byte >> (8 - k)), (self.byte >> (7 - k)) & 1
            levels: dict[int, tuple] = {}
            for d in range(depth, top - 1, -1):
                key = ((context & ((1 << 8 * d) - 1)) << 8) | prefix
                _, first, node = np.unique(key, return_index=True, return_inverse=True)
                ones = np.bincount(node, counts * bit, len(first))
                zeros = np.bincount(node, counts * (1 - bit), len(first))
                below = None
                if d < depth:
                    child_first, child = levels[d + 1][0], levels[d + 1][2][0]
                    below = np.bincount(node[child_first], child, len(first))
                levels[d] = (first, node, weigh(zeros, ones, below), zeros, ones)
            self.decisions.append(levels)

    def at_top(self) -> tuple[np.ndarray, ...]:
        """Of each node of depth `top`: context, decision (1 to 255), zeros, ones, ln weighted probability."""
        parts = []
        for k, levels in enumerate(self.decisions):
            first, _, (weighted, _, _), zeros, ones = levels[self.top]
            parts.append(((self.runs[first] >> 8) & ((1 << 8 * self.top) - 1), (1 << k) | (self.byte[first] >> (8 - k)), zeros, ones, weighted))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def logs(self, above) -> np.ndarray:
        """log10 of each run's last byte. above(run, decision, chance so far): chance of a one after mixing in what lies above `top`."""
        out = np.zeros(len(self.runs))
        for k, levels in enumerate(self.decisions):
            chance = np.zeros(len(self.runs))
            for d in range(self.depth, self.top - 1, -1):
                _, node, (_, share, own), _, _ = levels[d]
                chance = share[node] * own[node] + (1 - share[node]) * chance
            chance = above(self.runs, (1 << k) | (self.byte >> (8 - k)), chance)
            out += np.log10(np.where((self.byte >> (7 - k)) & 1 == 1, chance, 1 - chance))
        return out


def held_out(doc_id: Column, parts: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == 1, F.lit(False))


def _normal(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, bounds: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The modelled text of a lower-cased chunk, and where each row's ends."""
    words = np.diff(first)
    last = np.zeros(len(start), bool)
    last[first[1:][words > 0] - 1] = True
    empty = bounds[:-1][words == 0]
    at = np.concatenate([end, empty])
    value = np.concatenate([np.where(last, 10, 32), np.full(len(empty), 10)]).astype(np.uint8)
    order = np.argsort(at, kind="stable")
    at, value = at[order], value[order]
    kept = np.insert(~is_sep[data], at, True)
    text = np.insert(data, at, value)[kept]
    return text, np.flatnonzero(text == 10) + 1


def runs_of(text: np.ndarray, ends: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each byte the `depth` bytes before it (newlines before the start of its row) and itself, in one number."""
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(text)) - np.repeat(starts, np.diff(np.append(starts, len(text))))
    out = text.astype(np.int64)
    for back in range(1, depth + 1):
        seen = np.full(len(text), 10, np.int64)
        seen[back:] = np.where(place[back:] >= back, text[: len(text) - back], 10)
        out |= seen << (8 * back)
    return out


class _Words:
    """Hashes of the lower-cased words of a chunk, and the runs of the modelled text."""

    def __init__(self, depth: int) -> None:
        self.values, self.is_sep, self.low, self.roll, self.depth = byte_values(), separators(), lowered(), Rolling(), depth

    def load(self, data: np.ndarray, bounds: np.ndarray) -> None:
        data = self.low[data]
        start, end, self.first = word_spans(data, bounds, self.is_sep)
        self.hashes = signed(word_hashes(self.roll, self.values, data, start, end))
        text, self.ends = _normal(data, start, end, self.first, bounds, self.is_sep)
        self.runs = runs_of(text, self.ends, self.depth)


BLOCKS = "block long, kind byte, key long, count long, doc_id long, held_out boolean, text string"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int8()), ("key", pa.int64()), ("count", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    head = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
    return key[head], np.add.reduceat(count, head)


def in_blocks(documents: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of documents (doc_id, held_out, text) with their block, and a row for each word and run of each block: its count in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = _Words(depth)
        number, size = TaskContext.get().partitionId() << 32, 0
        held: dict[int, tuple[list, list]] = {WORD: ([], []), RUN: ([], [])}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, (keys, counts) in held.items():
                if keys:
                    key, count = _summed(keys, counts)
                    n = len(key)
                    yield pa.record_batch([np.full(n, number), np.full(n, kind, np.int8), key, count, pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())], schema=BLOCK_SCHEMA)
                held[kind] = ([], [])

        for batch in batches:
            learns = ~batch["held_out"].to_numpy(zero_copy_only=False)
            for i, j, data, bounds in chunks(batch["text"]):
                if size and size + len(data) > block_bytes:
                    yield from flush()
                    number, size = number + 1, 0
                seq.load(data, bounds)
                for kind, keys, per_row in ((WORD, seq.hashes, np.diff(seq.first)), (RUN, seq.runs, np.diff(seq.ends, prepend=0))):
                    mine = np.repeat(learns[i:j], per_row)
                    for part, known in ((keys[mine], True), (keys[~mine], False)):
                        if len(part):
                            key, count = np.unique(part, return_counts=True)
                            held[kind][0].append(key)
                            held[kind][1].append(count * known)
                n, size = j - i, size + len(data)
                yield pa.record_batch([np.full(n, number), np.full(n, TEXT, np.int8), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), batch["doc_id"][i:j], batch["held_out"][i:j], batch["text"][i:j]], schema=BLOCK_SCHEMA)
                if sum(map(len, held[RUN][0])) > 1 << 22:  # reduced in steps
                    for kind in held:
                        key, count = _summed(*held[kind])
                        held[kind] = ([key], [count])
        yield from flush()

    return documents.mapInArrow(run, BLOCKS)


def code_lengths(runs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key and value (log10 of the last byte's probability) of each distinct run (key, count), by context-tree weighting."""
    groups = min(1 << 16, max(1, -(-runs.count() // GROUP_RUNS)))
    near = runs.withColumn("near", F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(0xFFFF)), F.lit(groups)))

    def up(group: pa.Table) -> pa.Table:
        context, decision, zeros, ones, weighted = Tree(group["key"].to_numpy(), group["count"].to_numpy(), depth, 2).at_top()
        return pa.table({"last": context & 255, "decision": decision, "zeros": zeros, "ones": ones, "below": weighted})

    tops = near.groupBy("near").applyInArrow(up, "last long, decision long, zeros double, ones double, below double")
    shares, chances = np.full((257, 256), 0.5), np.full((257, 256), 0.5)  # by last byte and decision; the root comes last
    counts, below = np.zeros((257, 256, 2)), np.zeros((257, 256))
    for r in tops.groupBy("last", "decision").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toLocalIterator():  # at most 256 * 255 rows
        counts[r["last"], r["decision"]], below[r["last"], r["decision"]] = (r["zeros"], r["ones"]), r["below"]
    weighted, shares[:256], chances[:256] = weigh(counts[:256, :, 0], counts[:256, :, 1], below[:256])
    root = counts[:256].sum(axis=0)
    _, shares[256], chances[256] = weigh(root[:, 0], root[:, 1], weighted.sum(axis=0))
    shared = runs.sparkSession.sparkContext.broadcast((shares, chances))  # 1 MB, whatever the corpus

    def down(group: pa.Table) -> pa.Table:
        share, own = shared.value

        def above(run: np.ndarray, decision: np.ndarray, chance: np.ndarray) -> np.ndarray:
            last = (run >> 8) & 255
            chance = share[last, decision] * own[last, decision] + (1 - share[last, decision]) * chance
            return share[256, decision] * own[256, decision] + (1 - share[256, decision]) * chance

        keys = group["key"].to_numpy()
        return pa.table({"key": keys, "value": Tree(keys, group["count"].to_numpy(), depth, 2).logs(above)})

    return near.groupBy("near").applyInArrow(down, "key long, value double")


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])


def score(documents: DataFrame, parts: int = 5, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (of the modelled text) of each row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), parts).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = materialize(in_blocks(docs, depth, block_bytes), "lm-blocks")
    keys = blocks.filter(F.col("kind") < TEXT).select("block", "kind", "key", "count")
    known = materialize(keys.groupBy("kind", "key").agg(F.sum("count").alias("count")), "lm-counts")
    words = known.filter(F.col("kind") == WORD).select("key", F.col("count").cast("double").alias("value"))
    n_words, distinct = words.agg(F.sum("value"), F.count_if(F.col("value") > 0)).first()
    ends = docs.agg(F.count_if(~F.col("held_out"))).first()[0]
    total, distinct = int(n_words or 0) + ends, distinct + (ends > 0)
    whole = total + 0.5 * (distinct + 1)
    end_log = math.log10((ends + 0.5) / whole)
    lengths = code_lengths(known.filter(F.col("kind") == RUN).select("key", "count"), depth)
    values = words.withColumn("kind", F.lit(WORD).cast("byte")).unionByName(lengths.withColumn("kind", F.lit(RUN).cast("byte")))
    found = keys.select("block", "kind", "key").join(values, ["kind", "key"]).select(F.col("block").alias("of"), "kind", "key", "value")

    def add_up(texts: pa.Table, entries: pa.Table) -> pa.Table:
        kind, key, value = (entries[c].to_numpy() for c in ("kind", "key", "value"))
        order = np.lexsort((key, kind))
        cut = int(np.count_nonzero(kind == WORD))
        tables = [(key[x], value[x]) for x in (order[:cut], order[cut:])]
        seq, out = _Words(depth), []
        for batch in texts.to_batches():
            for i, j, data, bounds in chunks(batch["text"]):
                seq.load(data, bounds)
                count, size = np.diff(seq.first), np.diff(seq.ends, prepend=0)
                c, log = (v[np.searchsorted(k, x)] if len(x) else np.zeros(0) for (k, v), x in zip(tables, (seq.hashes, seq.runs), strict=True))
                row, rows = np.repeat(np.arange(j - i), count), j - i
                base = np.bincount(row, np.log10((c + 0.5) / whole), rows) + end_log
                seen = np.bincount(row, c > 0, rows).astype(np.int64) + (ends > 0)
                score = np.bincount(np.repeat(np.arange(rows), size), log, rows)
                out.append(pa.record_batch([batch["doc_id"][i:j], batch["held_out"][i:j], count + 1, seen, base, score, size], schema=SCORED))
        return pa.Table.from_batches(out, SCORED)

    texts = blocks.filter(F.col("kind") == TEXT).select("block", "doc_id", "held_out", "text")
    out = texts.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", (F.col("score") * -math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))

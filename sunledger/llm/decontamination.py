"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into passages of 2 * HALF words that overlap by half.
TF-IDF weights (over the words of the benchmark; document frequencies from all passages of the
corpus) make passages sparse vectors. A randomised SVD of all passages that could hold
enough of an item, and of the items, is computed in one distributed pass: every task adds its
part of A'(A Omega), a matrix of fixed size, and the Nystroem formula gives the right
singular vectors. An idf-weighted longest common subsequence of an item's words with those of a region
(four half passages), and how much of the item's answer is there, decide. Candidates follow from the share that
must be common: the products of regions and items in the latent space and what lies outside of it bound the
share from above, so no pair that reaches it is left out, however long the region's other text.

The benchmark is worked through in blocks of at most BLOCK_WORDS words, so that what is
broadcast is bounded however large it is (BLOCK_WORDS words, or one item if it is longer).

Defined cases: null and empty texts and items match nothing; the answer of an item of up to two halves is its
last sentence, or its whole text if it has one only, that of a passage of a longer item its last HALF / 2
words; repeated rows are judged each; null ids are rows of their own; very long texts are read whole; items
with equal words are all reported; rows of documents are told apart by doc_id and text.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunledger.llm.common import Rolling, byte_values, chunks, lowered, materialize, own_id, row_id, row_key, signed, word_hashes, word_spans

HALF = 32
#: Words of a chunk whose sums are a matrix product.
MATRIX_WORDS = 512
#: Dimensions of the latent space (hardly more than the block has passages), and random ones besides.
RANK, OVERSAMPLED = 256, 32
#: Weight of the items in the decomposed matrix, as a multiple of the corpus's: their own directions come first.
ITEMS_WEIGHT = 100.0
#: Share of an item's weight that must be a common subsequence; the second is enough with its answer.
COMMON, COMMON_WITH_ANSWER, ANSWER = 0.6, 0.45, 0.8
BLOCK_WORDS = 200_000
#: For sums of 32-bit numbers: bounds are compared with a little less than what is needed.
SLACK = 1 - 1e-3
#: Words in more than this share of passages are looked up one by one, not by the latent space; their weights stay.
MOST_FREQUENT = 0.15


def word_ends() -> np.ndarray:
    """Bytes that are no part of a word: ASCII other than letters and digits."""
    out = np.zeros(256, bool)
    out[:128] = True
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        out[lo:hi] = False
    return out


class Words:
    """Hashes of the lower-cased words of a chunk, and the offset of each row's first."""

    def __init__(self) -> None:
        self.values, self.is_end, self.low, self.roll = byte_values(), word_ends(), lowered(), Rolling()

    def load(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = self.low[data]
        start, end, first = word_spans(data, bounds, self.is_end)
        return signed(word_hashes(self.roll, self.values, data, start, end)), first


class Items:
    """Passages of a block of benchmark items: words as numbers in the block's vocabulary."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        reader = Words()
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        self.answer: list[np.ndarray] = []
        for item, text in rows:
            column = pa.array([text, [p for p in text.replace("\n", " ").split(".") if p.strip()][-1] if text.replace(".", "").strip() else text])
            ((_, _, data, bounds),) = chunks(column, 1 << 40)
            hashes, first = reader.load(data, bounds)
            words, answer = hashes[: first[1]], hashes[first[1] :]
            for at in range(0, max(1, len(words) - HALF), HALF):
                part = words[at : at + 2 * HALF]
                if len(part):
                    self.ids.append(item)
                    self.words.append(part)
                    self.answer.append(answer if len(words) <= 2 * HALF else part[-HALF // 2 :])
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.int64)
        self.slots = np.zeros(1 << 20, bool)  # a quick no
        self.slots[self.vocabulary & (len(self.slots) - 1)] = True
        self.words = [np.searchsorted(self.vocabulary, w) for w in self.words]
        self.answer = [np.searchsorted(self.vocabulary, w) for w in self.answer]

    def plain(self) -> dict:
        """What is broadcast: lists and arrays only."""
        return dict(self.__dict__)

    @classmethod
    def of(cls, plain: dict) -> Items:
        out = cls([])
        out.__dict__.update(plain)
        return out

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the vocabulary, or -1."""
        maybe = np.flatnonzero(self.slots[hashes & (len(self.slots) - 1)])
        out = np.full(len(hashes), -1, np.int64)
        found = hashes[maybe]
        at = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == found, at, -1)
        return out

    def without(self, which: np.ndarray) -> Items:
        """The same, but most of these words of the vocabulary are not told from others."""
        out = copy.copy(self)
        out.slots = np.zeros_like(self.slots)
        out.slots[self.vocabulary[~which] & (len(self.slots) - 1)] = True
        return out


def _halves(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words in the vocabulary: their half passage and number; and the offset of each row's first half."""
    count = -(-np.diff(first) // HALF)
    head = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(count)), np.diff(first))
    half = head[row] + (np.arange(len(numbers)) - first[row]) // HALF
    known = numbers >= 0
    return half[known], numbers[known], head


def _frequencies(docs: DataFrame, items) -> tuple[np.ndarray, int]:
    """Number of half passages with each word of the vocabulary, and of all."""
    schema = pa.schema([("word", pa.int64()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, own = Words(), Items.of(items.value)
        counts, total = np.zeros(len(own.vocabulary), np.int64), 0
        for batch in batches:
            for _, _, data, bounds in chunks(batch["text"]):
                hashes, first = reader.load(data, bounds)
                half, number, head = _halves(own.numbers(hashes), first)
                total += int(head[-1])
                pairs = np.unique(half * len(counts) + number)
                counts += np.bincount(pairs % len(counts), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.record_batch([np.append(used, -1), np.append(counts[used], total)], schema=schema)

    size = len(items.value["vocabulary"])
    counts, total = np.zeros(size, np.int64), 0
    for r in docs.select("text").mapInArrow(run, "word long, count long").groupBy("word").agg(F.sum("count").alias("n")).collect():  # the block's vocabulary
        if r["word"] < 0:
            total = r["n"]
        else:
            counts[r["word"]] = r["n"]
    return counts, total


def _weights(counts: np.ndarray, total: int) -> np.ndarray:
    """Inverse document frequency of each word of the vocabulary, over 0 also for words of every passage."""
    return np.log((2 + total) / (1 + counts))


def _project(half: np.ndarray, number: np.ndarray, n: int, scaled: np.ndarray) -> np.ndarray:
    """Row of each half passage times a basis whose rows are scaled by the words' weights."""
    out = np.zeros((n, scaled.shape[1]), np.float32)
    place = np.arange(len(half)) - np.searchsorted(half, half)
    for k in range(int(place.max(initial=-1)) + 1):  # the first word of each half, then the second, and so on
        which = np.flatnonzero(place == k)
        out[half[which]] += scaled[number[which]]
    return out


def _add_by_word(total: np.ndarray, half: np.ndarray, number: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> None:
    """total[word] += weight of the word * rows[half] for each word of each half."""
    count = np.bincount(number, minlength=len(total))
    often = np.argsort(-count, kind="stable")[:MATRIX_WORDS]
    place = np.full(len(total), -1)
    place[often] = np.arange(len(often))
    column = place[number]
    for lo in range(0, len(rows), 1024):  # the frequent words: a matrix product
        mine = np.flatnonzero((half >= lo) & (half < lo + 1024) & (column >= 0))
        dense = np.zeros((min(1024, len(rows) - lo), len(often)), np.float32)
        np.add.at(dense, (half[mine] - lo, column[mine]), weights[number[mine]])
        total[often] += dense.T @ rows[lo : lo + 1024]
    half, number = half[column < 0], number[column < 0]
    by = np.argsort(number, kind="stable")
    half, number = half[by], number[by]
    nth = np.arange(len(number)) - np.searchsorted(number, number)
    for k in range(int(nth.max(initial=-1)) + 1):  # the first place of each of the others, then the second, and so on
        which = np.flatnonzero(nth == k)
        total[number[which]] += rows[half[which]] * weights[number[which]][:, None]


def _latent(docs: DataFrame, items: Items, weights: np.ndarray, least: float) -> np.ndarray:
    """Right singular vectors (vocabulary, RANK) of the passages' matrix, by a randomised SVD in one pass."""
    size, rank = len(weights), min(RANK, len(items.words) + 8)
    width = rank + OVERSAMPLED
    omega = np.random.default_rng(7).standard_normal((size, width)).astype(np.float32)
    schema = pa.schema([("part", pa.int32()), ("sums", pa.binary())])
    step = 128  # words of the vocabulary in a part: the sums of all tasks meet in many small ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, (own, w, test) = Words(), shared.value
        own = Items.of(own)
        total, scaled = np.zeros((size, width), np.float32), test * w[:, None]
        for batch in batches:
            for _, _, data, bounds in chunks(batch["text"]):
                hashes, first = reader.load(data, bounds)
                half, number, head = _halves(own.numbers(hashes), first)
                mass = np.bincount(half, w[number], minlength=int(head[-1]))
                keep = (mass >= least)[half]
                half, number = half[keep], number[keep]
                if not len(half):
                    continue
                _, half = np.unique(half, return_inverse=True)
                rows = _project(half, number, int(half[-1]) + 1, scaled)
                _add_by_word(total, half, number, w, rows)
        yield pa.record_batch([pa.array(range(0, size, step), pa.int32()), pa.array([total[i : i + step].astype("<f4").tobytes() for i in range(0, size, step)], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch["part"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(raw, "<f4").astype(np.float64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.astype("<f4").tobytes() for x in sums.values()], pa.binary())], schema=schema)

    shared = docs.sparkSession.sparkContext.broadcast((items.plain(), weights.astype(np.float32), omega))
    image = np.zeros((size, width))
    parts = docs.select("text").mapInArrow(run, "part int, sums binary").repartition("part").mapInArrow(add, "part int, sums binary")
    for r in parts.collect():  # the block's vocabulary times RANK + OVERSAMPLED numbers
        part = np.frombuffer(r["sums"], "<f4").reshape(-1, width)
        image[r["part"] : r["part"] + len(part)] = part
    # the items, with ITEMS_WEIGHT times the weight that the corpus has in all
    half = np.repeat(np.arange(len(items.words)), list(map(len, items.words)))
    number = np.concatenate(items.words)
    rows = _project(half, number, len(items.words), omega * weights.astype(np.float32)[:, None])
    mine = np.zeros((size, width))
    np.add.at(mine, number, rows[half] * weights[number][:, None])
    image = image + mine * max(1.0, ITEMS_WEIGHT * np.abs(image).sum() / max(np.abs(mine).sum(), 1e-9))
    if not image.any():
        return np.zeros((size, 1), np.float32)
    shift = 1e-6 * np.linalg.norm(image)
    image = image + shift * omega
    core = omega.T.astype(np.float64) @ image
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values[-1] * 1e-10
    left, _, _ = np.linalg.svd(image @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return left[:, :rank].astype(np.float32)


def weighted_lcs(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Greatest total weight of a common subsequence of each row of a with the same row of b; numbers under 0 fit nothing."""
    best = np.zeros((len(a), b.shape[1] + 1))
    for k in range(a.shape[1]):
        word = a[:, k : k + 1]
        take = np.where((b == word) & (word >= 0), best[:, :-1] + weights[word], 0)
        np.maximum.accumulate(np.maximum(best[:, 1:], take), axis=1, out=best[:, 1:])
    return best[:, -1]


def padded(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of one length, filled up with -1."""
    out = np.full((len(rows), max(map(len, rows), default=0)), -1, np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class Bounds:
    """What the items of a block can have in common with a region, at most; never less than the weighted LCS.

    The words of a region that are not frequent are a vector p, a half passage's words counted
    once; an item's are q. Of p'q the latent space gives a part, and the norms of what lies outside
    of it give the most that the rest can be (Cauchy-Schwarz). Words matched one to one
    add no more than p'q in squared weights, so n of them weigh sqrt(n p'q) at most. Frequent words
    are looked up one by one.
    """

    def __init__(self, items: Items, weights: np.ndarray, frequent: np.ndarray, basis: np.ndarray) -> None:
        self.weights, self.frequent, self.scaled = weights, frequent, basis * weights[:, None].astype(np.float32)
        self.place = np.cumsum(frequent) - 1
        self.often = np.zeros((int(frequent.sum()), len(items.words)), np.float32)
        self.wanted = np.zeros((len(items.words), basis.shape[1]), np.float32)
        self.outside, self.rare = np.zeros(len(items.words)), np.zeros(len(items.words))
        for i, words in enumerate(items.words):
            number, count = np.unique(words, return_counts=True)
            w, often = count * weights[number], frequent[number]
            self.often[self.place[number[often]], i] = w[often]
            self.wanted[i] = w[~often] @ basis[number[~often]]
            self.outside[i] = np.sqrt(max(0.0, (w[~often] ** 2).sum() - float(self.wanted[i] @ self.wanted[i])))
            self.rare[i] = count[~often].sum()
        self.length = np.maximum(np.linalg.norm(self.wanted, axis=1), 1e-9)

    def load(self, half: np.ndarray, number: np.ndarray, head: np.ndarray) -> None:
        """Of a chunk: a region is a half passage, the one before it and two after it, of the same row."""
        n, size = int(head[-1]), len(self.weights)
        row = np.repeat(np.arange(len(head) - 1), np.diff(head))
        near = {}  # from region to half
        for d in REGION:
            to = np.arange(n) + d
            fits = (to >= 0) & (to < n)
            fits[fits] = row[to[fits]] == row[fits]
            near[d] = fits
        sums = lambda x: sum_near(x, near)
        self.mass = sums(np.bincount(half, self.weights[number], minlength=n))
        pairs = np.unique(half * size + number)
        half, number = pairs // size, pairs % size
        often = self.frequent[number]
        there = np.zeros((n, len(self.often)), np.float32)
        there[half[often], self.place[number[often]]] = 1
        self.there = np.minimum(sums(there), 1)
        half, number = half[~often], number[~often]
        self.rows = sums(_project(half, number, n, self.scaled))
        square = self.weights.astype(np.float64) ** 2
        norm = sums(np.bincount(half, square[number], minlength=n))
        by = np.sort(number * n + half)
        number, half = by // max(n, 1), by % max(n, 1)
        for k in range(1, len(REGION)):  # words in two halves
            step = np.where(number[k:] == number[:-k], half[k:] - half[:-k], len(REGION))
            for d in range(k, len(REGION)):
                both = np.bincount(half[:-k][step == d], square[number[:-k][step == d]], minlength=n)
                for i in REGION[: len(REGION) - d]:
                    fits = np.flatnonzero(near[i] & near[i + d])
                    norm[fits] += 2 * both[fits + i]
        self.beyond = np.sqrt(np.maximum(0, norm - (self.rows.astype(np.float64) ** 2).sum(axis=1)))

    def most(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each region of at and item: the bound, and the cosine in the latent space."""
        along = self.rows[at] @ self.wanted.T
        inner = along + self.beyond[at, None].astype(np.float32) * self.outside.astype(np.float32)
        bound = self.there[at] @ self.often + np.sqrt(self.rare.astype(np.float32) * np.maximum(inner, 0))
        cosine = along / self.length.astype(np.float32) / np.maximum(np.linalg.norm(self.rows[at], axis=1, keepdims=True), 1e-9)
        return bound, cosine


#: Half passages of a region, from the one that it is named after.
REGION = (-1, 0, 1, 2)


def sum_near(x: np.ndarray, near: dict[int, np.ndarray]) -> np.ndarray:
    """Sums over the halves of each region."""
    out = np.zeros_like(x)
    for d, fits in near.items():
        at = np.flatnonzero(fits)
        out[at] += x[at + d]
    return out


MATCH = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.float64())])


def _search(docs: DataFrame, shared, common: float, with_answer: float, answer: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, (own, weights, frequent, basis) = Words(), shared.value
        own = Items.of(own)
        bounds_of = Bounds(own, weights, frequent, basis)
        words, goals = padded(own.words), padded(own.answer)
        heavy = np.append(weights, 0).astype(np.float64)  # the last one is what -1 weighs
        mass, goal_mass = heavy[words].sum(axis=1), np.maximum(heavy[goals].sum(axis=1), 1e-9)
        least = min(common, with_answer) * mass
        present = np.zeros((256, len(weights) + 1), bool)
        for batch in batches:
            ids, th = batch["doc_id"].to_pylist(), batch["th"].to_pylist()
            out: list[tuple] = []
            for i, j, data, bounds in chunks(batch["text"]):
                hashes, first = reader.load(data, bounds)
                numbers = own.numbers(hashes)
                half, number, head = _halves(numbers, first)
                if not len(half):
                    continue
                bounds_of.load(half, number, head)
                may = np.flatnonzero(bounds_of.mass >= least.min() * SLACK)
                best: dict[tuple[int, int], tuple] = {}
                for step in range(0, len(may), 256):
                    at = may[step : step + 256]
                    bound, cosines = bounds_of.most(at)
                    p, item = np.nonzero(bound >= least * SLACK)
                    if not len(p):
                        continue
                    # the words of each region
                    r = np.searchsorted(head, at, side="right") - 1
                    lo = first[r] + (at - head[r]) * HALF
                    a, b = np.maximum(first[r], lo - HALF), np.minimum(first[r + 1], lo + 3 * HALF)
                    own_words = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
                    present[:] = False
                    present[np.repeat(np.arange(len(at)), b - a), numbers[own_words]] = True  # the last column is for -1
                    present[:, -1] = False
                    pairs: list[tuple[int, int, float, float]] = []
                    for k in range(0, len(p), 8192):  # what words are there bounds the subsequence from above
                        u, t = p[k : k + 8192], item[k : k + 8192]
                        there = (heavy[words[t]] * present[u[:, None], words[t]]).sum(axis=1)
                        found = (heavy[goals[t]] * present[u[:, None], goals[t]]).sum(axis=1) / goal_mass[t]
                        need = np.where(found >= answer, min(common, with_answer), common) * mass[t]
                        fine = np.flatnonzero(there >= need * SLACK)
                        pairs += zip(u[fine].tolist(), t[fine].tolist(), found[fine].tolist(), need[fine].tolist(), strict=True)
                    for k in range(0, len(pairs), 512):
                        some = pairs[k : k + 512]
                        regions = [x[x >= 0] for x in (numbers[a[u] : b[u]] for u, *_ in some)]
                        weight = weighted_lcs(words[[x[1] for x in some]], padded(regions), heavy)
                        for (u, t, goal, need), w in zip(some, weight.tolist(), strict=True):
                            key = (int(r[u]), own.ids[t])
                            if w >= need * (1 - 1e-9) and (key not in best or best[key][3] < w / mass[t]):
                                best[key] = (int(a[u] - first[r[u]]), int(b[u] - first[r[u]]), float(cosines[u, t]), w / float(mass[t]), goal)
                out += [(ids[i + r], th[i + r], t, *x) for (r, t), x in best.items()]
            if out:
                yield pa.record_batch([pa.array(x, MATCH.field(k).type) for k, x in enumerate(zip(*out, strict=True))], schema=MATCH)

    return docs.mapInArrow(run, "doc_id long, th long, item_id long, start_word long, end_word long, cosine double, common double, answer double")


def matches(documents: DataFrame, benchmark: DataFrame, common: float = COMMON, with_answer: float = COMMON_WITH_ANSWER, answer: float = ANSWER) -> DataFrame:
    """A row for each document and item (item_id, text) that it gives away: where, and how surely."""
    spark = documents.sparkSession
    docs = documents.select(row_id(F.col("doc_id"), F.col("text")), row_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    rows = benchmark.filter(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).select(F.col("item_id").cast("long").alias("item_id"), "text")
    words = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    found = None
    blocks = max(1, -(-2 * words // BLOCK_WORDS))
    for block in range(blocks if words else 0):
        mine = [(r["item_id"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()]  # bounded by BLOCK_WORDS
        if not mine:
            continue
        items = Items(mine)
        counts, total = _frequencies(docs, spark.sparkContext.broadcast(items.plain()))
        weights = _weights(counts, total)
        frequent = counts > MOST_FREQUENT * total
        # the space may be any: the bounds hold in each, and only get closer
        rare = np.where(frequent, 0.0, weights)
        mass = np.array([rare[w].sum() for w in items.words])
        least = float(np.median(mass[mass > 0])) * min(common, with_answer) / 2 if (mass > 0).any() else np.inf  # halves that could hold enough of a middle item
        basis = _latent(docs, items.without(frequent), rare, least)
        shared = spark.sparkContext.broadcast((items.plain(), weights.astype(np.float32), frequent, basis))
        one = _search(docs, shared, common, with_answer, answer)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "doc_id long, th long, item_id long, start_word long, end_word long, cosine double, common double, answer double")
    return found.select(own_id(F.col("doc_id")), F.col("doc_id").alias("row"), *found.columns[1:])


def clean(documents: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """documents without the rows that give away an item."""
    bad = materialize(matches(documents, benchmark, **limits).select(F.col("row").alias("__id"), F.col("th").alias("__th")).distinct(), "leaks")
    rows = documents.withColumns({"__id": row_id(F.col("doc_id"), F.col("text")), "__th": row_key(F.col("text"))})
    return rows.join(bad, ["__id", "__th"], "left_anti").select(*documents.columns)

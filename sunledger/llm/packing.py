"""Best-fit packing of tokenized documents, certified by dual-feasible-function bounds.

Pieces (documents, cut only where longer than a sequence) are dealt into partitions of
bounded size and packed there by best-fit decreasing. A dual feasible function maps lengths
so that no sequence can hold more than 1 of it; the best of two families gives a lower
bound of each partition's number of sequences. A partition that meets its bound is final.
Partitions with gaps give up their emptiest sequences; these documents are exchanged between
such partitions, packed anew, and the new packing is taken where it needs fewer sequences.

Exchanges end when one saves nothing; `certified` marks the sequences of groups that met their bound,
and certificate() compares the whole packing with the bound of all pieces together.

Defined cases: null and empty texts are one piece of the end id alone; ties of length are
packed by crc and id; repeated rows are packed each; null ids are kept as null; a very long text is
tokenized whole by one worker and cut into pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunledger.llm.common import chunks, lowered, materialize, separators, word_spans, worker_cache

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs.
PARTITION_PIECES = 50_000
#: Words whose ids a Python worker remembers.
REMEMBERED_WORDS = 300_000
#: Emptiest sequences that a partition gives up for each one above its bound; it doubles with each exchange.
RELEASED = 48


class WordTokenizer:
    """Ids of texts by a tokenizer that never joins characters across white space, nor ASCII letters with
    other ASCII signs: each such unit is encoded once, and those met again are remembered.
    """

    def __init__(self, definition: str, remembered: int = REMEMBERED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.remembered = remembered
        self.is_sep, self.low = separators(), lowered()
        self.letter, self.sign = np.zeros(256, bool), np.zeros(256, bool)
        self.letter[65:91] = self.letter[97:123] = True
        self.sign[33:48] = self.sign[58:65] = self.sign[91:97] = self.sign[123:127] = True
        self.sign[[ord(c) for c in "'<|>"]] = False  # contractions and special ids keep their signs
        self.index: dict[bytes, int] = {}
        self.start, self.size, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def forget(self) -> None:
        """Keep what was met more than once, and halve how often."""
        kept = np.flatnonzero(self.seen > 1)
        if len(kept) > self.remembered // 2:
            kept = kept[np.argsort(-self.seen[kept], kind="stable")[: self.remembered // 2]]
        number = np.full(len(self.seen), -1)
        number[kept] = np.arange(len(kept))
        self.index = {w: n for w, i in self.index.items() if (n := int(number[i])) >= 0}
        size = self.size[kept]
        end = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.start[kept] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]
        self.start, self.size, self.seen = end - size, size, self.seen[kept] // 2

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        one = [t.isalpha() for t in texts]
        plain = [i for i, x in enumerate(one) if x]
        other = [i for i, x in enumerate(one) if not x]
        (joined,) = self.tokenizer.encode_batch_fast(["\n".join([texts[i] for i in plain])], add_special_tokens=False)
        flat = np.array(joined.ids, np.uint32)
        end = np.flatnonzero(self.last[flat]) + 1  # a run of letters is one word of the tokenizer
        if len(end) != len(plain):
            other, plain, flat, end = list(range(len(texts))), [], flat[:0], end[:0]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)]
        size = np.concatenate([np.diff(end, prepend=0), np.fromiter(map(len, ids), np.int64, len(ids))])
        flat = np.concatenate([flat, np.fromiter((i for x in ids for i in x), np.uint32, sum(map(len, ids)))])
        n = len(self.start)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int64)])
        self.index.update(zip([words[i] for i in plain + other], range(n, n + len(words)), strict=True))

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a chunk, and where each row's begin and end."""
        start, end, _ = word_spans(data, bounds, self.is_sep)
        small = self.low[data]
        for at in np.unique(np.searchsorted(end, np.flatnonzero(data == ord("<")), side="right")).tolist():
            small[start[at] : end[at]] = data[start[at] : end[at]]  # special ids are told by case
        letter, sign = self.letter[small], self.sign[small]
        cut = np.flatnonzero((letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])) + 1
        cut = np.setdiff1d(cut, start, assume_unique=True)  # row bounds may lie there
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        raw = small.tobytes()
        words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        new = list(set(words).difference(self.index))
        if len(self.index) + len(new) > self.remembered and self.index:
            self.forget()
            new = list(set(words).difference(self.index))
        if new:
            self.learn(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        self.seen += np.bincount(at, minlength=len(self.seen))
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, bounds)]


def tokenize(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of at most capacity ids."""
    definition = documents.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))  # a fixed vocabulary
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = worker_cache()
        if tokenizer_path not in kept:
            kept[tokenizer_path] = WordTokenizer(definition.value)
        encoder = kept[tokenizer_path]
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for i, j, data, bounds in chunks(batch["text"]):
                tokens, at = encoder.encode(data, bounds)
                out: list[list] = [[], [], [], [], []]
                for row in range(i, j):
                    own = np.append(tokens[at[row - i] : at[row - i + 1]], end_id).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        cut = own[start : start + capacity]
                        for k, v in enumerate((ids[row], piece, start, len(cut), zlib.crc32(cut))):
                            out[k].append(v)
                yield pa.record_batch([pa.array(x, schema.field(k).type) for k, x in enumerate(out)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, counts: np.ndarray | None = None) -> int:
    """Least number of sequences, by two families of dual feasible functions. counts: how often each length is there (once)."""
    if not len(lengths):
        return 0
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, lengths, 1 if counts is None else counts)
    size = np.arange(capacity + 1)
    number, weight = np.cumsum(count), np.cumsum(count * size)
    cut = np.arange(capacity // 2 + 1)  # lengths over capacity - cut count as 1, those under cut as 0
    large = number[capacity] - number[capacity - cut]
    middle = weight[capacity - cut] - np.where(cut > 0, weight[cut - 1], 0)
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, given longest first."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_: list[tuple[int, int]] = []  # (room, sequence), sorted
    used = 0
    for i, n in enumerate(lengths.tolist()):
        at = bisect.bisect_left(open_, (n, -1))
        if at < len(open_):
            room, s = open_.pop(at)
        else:
            room, s, used = capacity, used, used + 1
        sequence[i], offset[i] = s, capacity - room
        if room > n:
            bisect.insort(open_, (room - n, s))
    return sequence, offset


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, sequence_id long, offset long, certified boolean, released boolean"


def _pack(base: int, again: bool, capacity: int, release: int):
    """Pack one group. again: rows have a packing already, which stays unless fewer sequences are enough.

    certified: the sequences that the group keeps are as many as the bound of what is in them.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        lengths = rows["length"].to_numpy()
        sequence, offset = best_fit_decreasing(lengths, capacity)
        bins = int(sequence.max()) + 1
        if again and bins >= rows["sequence_id"].nunique():
            _, sequence = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
            offset, bins = rows["offset"].to_numpy(), int(sequence.max()) + 1
        fill = np.bincount(sequence, weights=lengths, minlength=bins).astype(np.int64)
        gap = bins - lower_bound(lengths, capacity)
        freed = np.zeros(bins, bool)
        if gap > 0:
            emptiest = np.argsort(fill, kind="stable")[: gap * release]
            freed[emptiest[fill[emptiest] < capacity]] = True
        part = int(rows["part"].iloc[0])
        certified = bins - int(freed.sum()) == lower_bound(lengths[~freed[sequence]], capacity)
        return rows.assign(part=part, sequence_id=(np.int64(base + part) << 32) + sequence, offset=offset, certified=~freed[sequence] & certified, released=freed[sequence])[[x.split()[0] for x in PACKED.split(", ")]]

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, exchange: bool = True) -> DataFrame:
    """pieces with sequence_id, offset and certified. sequence_id is unique over all partitions and exchanges.

    Exchanges go on as long as one saves a sequence.
    """
    groups = max(1, math.ceil(pieces.count() / partition_pieces))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    kept = materialize(dealt.groupBy("part").applyInPandas(_pack(0, False, capacity, RELEASED), PACKED), "packed")
    base, release, before = groups, RELEASED, None
    while exchange:
        now = kept.select("sequence_id").distinct().count()
        n, parts = kept.filter("released").agg(F.count("*"), F.count_distinct("part")).first()
        if n == 0 or (before is None and parts < 2) or (before is not None and now >= before):
            break
        groups, release, before = max(1, math.ceil(n / partition_pieces)), 2 * release, now
        moved = kept.filter("released").withColumn("part", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
        packed = moved.groupBy("part").applyInPandas(_pack(base, True, capacity, release), PACKED)
        base += groups
        kept = materialize(kept.filter("not released").unionByName(packed), "packed")
    return kept


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Number of sequences, and the bound of any packing of all the pieces; from one row for each length."""
    counts = packed.groupBy("length").agg(F.count("*").alias("n")).toPandas()  # at most capacity rows
    return packed.select("sequence_id").distinct().count(), lower_bound(counts["length"].to_numpy(), capacity, counts["n"].to_numpy())


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and certified of every piece of every row of documents."""
    pieces = materialize(tokenize(documents, tokenizer_path, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")

"""Language identification with a bit-sliced Bloom filter of n-grams.

Training reads the byte n-grams (3 to 5 bytes of lower-cased letter runs with their word ends)
of a bounded sample of labelled documents: about SAMPLE_DOCS whole documents of each
language, picked by hash. All of them go into one Bloom filter whose slots hold a bit for each
language: the AND of an n-gram's slots is the mask of all languages that contain it. Tasks fill
filters of their own, whose slots are then joined by OR. A text's hits are counted for each
language by population counts of its masks, corrected for the filter's false positives, and
the largest count decides; the score is that count as a share of the text's n-grams.

Defined cases: null texts and texts without a letter are `und` with score 0, as is everything
if nothing was learned; ties go to the language with more training documents, then by name;
null labels teach nothing; a null doc_id counts as training; repeated rows get equal results;
very long texts are read whole, so one text must fit into a worker; other columns are kept,
but for columns named lang_pred and score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunledger.llm.common import U, Rolling, byte_values, chunks, mix, signed, worker_cache

SIZES = (3, 4, 5)
SAMPLE_DOCS = 5000
SLOT_BITS = 21
HASHES = 3


class _Grams:
    """Hashes of the n-grams of each row of a chunk."""

    def __init__(self) -> None:
        worker_cache().clear()
        self.values, self.roll = byte_values(), Rolling()
        self.letters = np.full(256, 32, np.uint8)
        self.letters[0x80:] = np.arange(0x80, 0x100)
        self.letters[97:123] = self.letters[65:91] = np.arange(97, 123)

    def load(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size: hashes, and the bounds of rows in them. Rows are set apart by spaces; runs of spaces are one."""
        text = np.insert(self.letters[data], np.concatenate([bounds[:-1], bounds[1:]]), 32)
        own = bounds + 2 * np.arange(len(bounds))
        keep = np.ones(len(text), bool)
        keep[1:] = (text[1:] != 32) | (text[:-1] != 32)
        keep[own[:-1]] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        text, own = text[keep], at[own]
        self.roll.load(self.values[text])
        out = []
        for n in SIZES:
            grams = self.roll.grams(n)
            inside = np.zeros(len(grams) + 1, np.int32)
            first, last = own[:-1], np.maximum(own[1:] - n + 1, own[:-1])
            np.add.at(inside, np.minimum(first, len(grams)), 1)
            np.add.at(inside, np.minimum(last, len(grams)), -1)
            fine = np.cumsum(inside)[:-1] > 0
            # a space inside an n-gram joins words: only at its ends
            blank = np.concatenate([[0], np.cumsum(text == 32)])
            if n > 2:
                fine &= (blank[n - 1 : n - 1 + len(grams)] - blank[1 : 1 + len(grams)]) == 0
            at = np.concatenate([[0], np.cumsum(fine)])
            out.append((grams[fine], at[np.minimum(own, len(grams))]))
        return out


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(training: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the filter's slots (2**SLOT_BITS, words of 64 languages) and each language's false-positive rate."""
    known = training.filter(has_letter(F.col("text")) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    words = max(1, -(-len(languages) // 64))
    slots = np.zeros((1 << SLOT_BITS, words), U)
    if not languages:
        return [], slots, np.zeros(0)
    numbers = training.sparkSession.createDataFrame([(k, i, sample_docs / sizes[k]) for i, k in enumerate(languages)], "lang string, number int, share double")
    sample = known.select("lang", "text", F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)).alias("draw")).join(numbers, "lang").filter(F.col("draw") < F.col("share") * (1 << 20)).select("number", "text")
    schema = pa.schema([("slot", pa.int64()), ("mask", pa.int64())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, own = _Grams(), None
        for batch in batches:
            number = np.asarray(batch["number"]).astype(np.int64)
            own = np.zeros((1 << SLOT_BITS, words), U) if own is None else own
            for i, j, data, bounds in chunks(batch["text"]):
                for grams, at in reader.load(data, bounds):
                    of = np.repeat(number[i:j], np.diff(at))
                    for k in np.unique(of).tolist():
                        for slot in _slots(np.unique(grams[of == k])):
                            own[slot, k // 64] |= U(1 << (k % 64))  # slots of equal n-grams were made one
        if own is not None:
            flat = own.reshape(-1)
            used = np.flatnonzero(flat)
            yield pa.record_batch([used, signed(flat[used])], schema=schema)

    filled = sample.mapInArrow(fill, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    flat = slots.reshape(-1)
    for r in filled.toArrow().to_batches():  # the filter, whatever the sample
        flat[np.asarray(r["slot"])] = np.asarray(r["mask"]).view(U)
    rate = np.array([np.count_nonzero(slots[:, k // 64] & U(1 << (k % 64))) for k in range(len(languages))]) / len(slots)
    return languages, slots, rate**HASHES


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    h = mix(grams)
    return [((h >> U(k * SLOT_BITS)) & U((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(HASHES)]


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """documents with lang_pred and score; the prediction reads the text alone."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # the filter's size is fixed
    names = documents.columns
    source = documents.withColumn("__letter", has_letter(F.col("text")))
    fields = [f for f in documents.schema.fields if f.name not in ("lang_pred", "score")]
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, slots, false_rate = held.value
        reader = _Grams()
        for batch in batches:
            letter = batch["__letter"].to_numpy(zero_copy_only=False)
            found: list[str] = []
            scores: list[float] = []
            for i, j, data, bounds in chunks(batch["text"]):
                hits, total = np.zeros((j - i, len(languages))), np.zeros(j - i)
                for grams, at in reader.load(data, bounds) if languages else []:
                    a, b, c = _slots(grams)
                    total += np.diff(at)
                    for word in range(slots.shape[1]):
                        mask = slots[a, word] & slots[b, word] & slots[c, word]
                        for k in range(64 * word, min(len(languages), 64 * word + 64)):
                            hits[:, k] += np.diff(np.concatenate([[0], np.cumsum((mask >> U(k % 64)) & U(1), dtype=np.int64)])[at])
                fixed = np.maximum(0, hits - total[:, None] * false_rate) / (1 - np.minimum(false_rate, 0.999)) if languages else hits
                for row in range(j - i):
                    if not letter[i + row] or not languages:
                        found.append("und")
                        scores.append(0.0)
                    else:
                        best = int(fixed[row].argmax())
                        found.append(languages[best])
                        scores.append(float(min(1.0, fixed[row, best] / max(1.0, total[row]))))
            columns = [batch[f.name] for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in fields), "lang_pred", "score"])

    out = source.mapInArrow(run, out_schema)
    return out.select(*[n for n in names if n not in ("lang_pred", "score")], "lang_pred", "score")

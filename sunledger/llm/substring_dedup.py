"""Substring dedup by seed and extend on words.

Seeds are winnowed anchors of `gram` words; every window of `window` words holds the one that it picked. Documents
are joined on their seeds. A seed whose surroundings (all windows that picked it) occur as a whole in a
document with a smaller doc_id is settled by a hash of them. The others, the edges of repeats, are extended word by word
to the left and to the right, all members of a seed together (see extension). Runs of repeated
windows that touch or overlap join to the maximal repeats of at least `window` words (column repeats), and their
words are removed.

Defined cases: null or empty texts have no words; texts shorter than a window lose nothing; rows that share
a doc_id never repeat each other; null ids count as one least id; a very long text is read whole by one
worker; other columns are ignored. Words are compared by 64-bit hashes, one by one in extensions; settled surroundings by
one 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunledger.llm.common import chunks, materialize, own_id, separators, word_spans
from sunledger.llm.extension import SEED_MEMBERS, repeated_windows
from sunledger.llm.repeats import covered, keyed, list_rows, occurrences, per_document, settle, unite

WINDOW = 13
GRAM = 4


def substring_dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, seed_members: int = SEED_MEMBERS) -> DataFrame:
    """doc_id, n_words, n_removed, repeats (first and end word of each maximal repeat), kept (kept words, joined by one space), kept_sha256.

    seed_members: members of one seed that one task may gather; a seed with more is lengthened, with the same rows.
    """
    docs = keyed(documents)
    settled = materialize(settle(occurrences(docs.select("doc_id", "th", "text"), "word", window, gram, True), True), "repeats")
    seeds = settled.filter("kind = 1").select("anchor")
    edges = repeated_windows(docs.select("doc_id", "th", "text"), per_document(settled, 1), seeds, window, gram, seed_members)
    whole = settled.filter("kind = 2").select("doc_id", "th", "place")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("repeats", pa.list_(pa.list_(pa.int64()))), ("kept", pa.string()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_sep = separators()
        for batch in batches:
            cuts, items = list_rows(batch["found"])
            place = np.asarray(items)
            ids = batch["doc_id"]
            for i, j, data, bounds in chunks(batch["text"]):
                raw = data.tobytes()
                start, end, first = word_spans(data, bounds, is_sep)
                n, removed, repeats, kept, sha = [], [], [], [], []
                for row in range(i, j):
                    lo, hi = first[row - i], first[row - i + 1]
                    mask = covered(place[cuts[row] : cuts[row + 1]], hi - lo, window)
                    left = np.flatnonzero(~mask) + lo
                    text = b" ".join([raw[a:b] for a, b in zip(start[left].tolist(), end[left].tolist(), strict=True)])
                    n.append(hi - lo)
                    removed.append(int(mask.sum()))
                    repeats.append(np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).reshape(-1, 2).tolist())
                    kept.append(text.decode())
                    sha.append(hashlib.sha256(text).hexdigest())
                yield pa.record_batch([ids[i:j], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(repeats, schema.field("repeats").type), pa.array(kept, pa.string()), pa.array(sha, pa.string())], schema=schema)

    rows = unite(docs, whole, edges).select("doc_id", "text", "found")
    out = rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, repeats array<array<long>>, kept string, kept_sha256 string")
    return out.select(own_id(F.col("doc_id")), "n_words", "n_removed", "repeats", "kept", "kept_sha256")

"""Seeds are extended to the windows that brute force finds, however many members a seed has."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, key string, before string, after string"


def crowded():
    """Texts of few words: frequent seeds with many surroundings, copies, boundaries inside texts, odd rows."""
    rng = np.random.default_rng(11)
    phrase = [f"p{i}" for i in range(30)]
    rows = [(0, None), (1, ""), (2, "one two"), (None, " ".join(phrase)), (None, " ".join(phrase))]
    for d in range(3, 60):
        words = list(rng.choice(["a", "b", "c"], 40))
        at = int(rng.integers(0, 40))
        words[at:at] = phrase[int(rng.integers(0, 12)) : int(rng.integers(13, 31))]
        rows.append((d, " ".join(words)))
    rows += [(7, rows[9][1]), (60, " ".join(["a"] * 120)), (61, " ".join(["a"] * 90) + " b " + " ".join(["a"] * 90))]
    return rows


def brute_force(rows, window):
    words = [(d, (t or "").split(" ") if t else []) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, float("inf")), -1 if d is None else d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((-1 if d is None else d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("seed_members", "window", "gram"), [(50_000, 13, 4), (20, 13, 4), (1, 13, 4), (1, 6, 6), (2, 7, 2)])
def test_all_sizes_of_seeds_give_the_rows_of_brute_force(spark, seed_members, window, gram):
    from sunledger.llm.substring_dedup import substring_dedup

    rows = crowded()
    docs = spark.createDataFrame([(d, t, "k", "b", "a") for d, t in rows], SCHEMA)
    got = substring_dedup(docs, window, gram, seed_members).select(F.coalesce("doc_id", F.lit(-1)), "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute_force(rows, window)


def member(key, doc, first, windows, seed, before, after, alone=True):
    return {"key": key, "doc_id": doc, "th": 0, "first": first, "windows": windows, "seed": seed, "alone": alone, "before": before, "after": after}


def runs(rows, window=5, gram=2):
    from sunledger.llm.extension import FIELDS, extend

    found = extend(pa.Table.from_pylist(rows, schema=FIELDS), window, gram)
    return sorted((r["doc_id"], r["place"] >> 16, r["place"] & 65535) for r in found.to_pylist())


def test_both_sides_must_agree_with_the_same_member():
    # words before the seed, nearest first; 3 words are lacking beside a seed of 2
    whole = member(1, 9, 10, 4, 13, [1, 2, 3], [50, 51, 6, 7, 8])
    left = member(1, 2, 0, 4, 3, [1, 2, 3], [50, 51, 90, 91, 92])
    right = member(1, 3, 0, 4, 3, [80, 81, 82], [50, 51, 6, 7, 8])
    assert runs([whole, left, right]) == [(9, 10, 1), (9, 13, 1)]  # all on the left, or all on the right
    middle = member(1, 4, 0, 4, 3, [1, 70, 71], [50, 51, 6, 7, 60])
    assert runs([whole, left, right, middle]) == [(9, 10, 1), (9, 12, 2)]  # and one before the seed, two after it


def test_only_smaller_documents_and_equal_seeds_count():
    a = member(1, 5, 0, 1, 0, [], [50, 51, 6, 7, 8])
    assert runs([a, member(1, 5, 20, 1, 20, [], [50, 51, 6, 7, 8])]) == []
    assert runs([a, member(2, 4, 0, 1, 0, [], [50, 51, 6, 7, 8])]) == []
    assert runs([a, member(1, 4, 0, 1, 0, [], [50, 52, 6, 7, 8])]) == []
    assert runs([a, member(1, 4, 0, 1, 0, [], [50, 51, 6, 7, 8], alone=False)]) == [(5, 0, 1)]
    assert runs([{**a, "alone": False}, member(1, 4, 0, 1, 0, [], [50, 51, 6, 7, 8])]) == []


def test_frequent_seeds_become_longer_until_they_are_windows(spark):
    from sunledger.llm.extension import MEMBERS, lengthen

    rows = [(1, 1, 0, 0, 10, 9, True, list(range(9)), list(range(20, 33)))]
    todo = spark.createDataFrame(rows, MEMBERS).withColumns({"have_left": F.lit(0), "have_right": F.lit(0), "lacks": F.lit(9)})
    starts = []
    for _ in range(5):
        todo = lengthen(todo, 4)
        assert todo.filter("have_left + have_right + lacks <> 9 or size(before) <> seed - first").count() == 0
        starts += [r["first"] for r in todo.filter("lacks = 0 and windows = 1").collect()]
        todo = todo.filter("lacks > 0")
    assert todo.count() == 0 and sorted(starts) == list(range(10))


@pytest.mark.parametrize("most", [4000, 3, 1])
def test_suffix_dedup_lengthens_frequent_anchors(spark, most):
    """Near copies whose anchors have many surroundings; the windows are those of brute force."""
    from sunledger.llm.suffix_dedup import suffix_dedup

    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefgh é"), 330))
    texts = []
    for _ in range(12):
        a, b = sorted(rng.integers(0, 330, 2).tolist())
        texts.append(base[:a] + "#" + base[a:b] + str(rng.integers(0, 99)) + base[b:])
    texts += ["ab" * 300, "ab" * 150 + "c" + "ab" * 150, "x" * 199, None]
    raw = [(t or "").encode() for t in texts]
    count = {}
    for t in raw:
        for i in range(len(t) - 199):
            count[t[i : i + 200]] = count.get(t[i : i + 200], 0) + 1
    want = []
    for d, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        want.append((d, len(t), int(gone.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    docs = spark.createDataFrame([(d, t, "k", "b", "a") for d, t in enumerate(texts)], SCHEMA)
    got = suffix_dedup(docs, max_partners=most).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want

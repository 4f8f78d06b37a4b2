"""Merkle manifest, centroid clustering and document fingerprints against brute force, on odd tables."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest

pytestmark = pytest.mark.filterwarnings("ignore")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, place int, k string, tree int, idx int, range int, half string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def docs(spark, rows):
    """rows: (doc_id, text, source); extra columns have names that the operators use inside."""
    return spark.createDataFrame([(d, t, None if d == 3 else "en", s, None if d == 4 else len(t or ""), 1, "k", 2, 3, 4, "h") for d, t, s in rows], SCHEMA)


# Merkle manifest


def leaf(r, text):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(one(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def levels(leaves, arity):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def siblings(tree, i, arity):
    out = []
    for level in tree[:-1]:
        run = i // arity * arity
        out.append((i % arity, [x for j, x in enumerate(level[run : run + arity]) if j != i % arity]))
        i //= arity
    return out


def manifest_by_hand(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = levels([leaf(r, r["text"]) for r in groups[s]], arity)
    top = levels([trees[s][-1][0] for s in order], arity)
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            proof = siblings(trees[s], i, arity) + siblings(top, k, arity)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            now = leaf(r, r["text"].replace("\n", "") if tampered else r["text"])
            for own, others in proof:
                now = sha("".join([*others[:own], now, *others[own:]]))
            flat = "".join(x for _, others in proof for x in others)
            out.append((r["doc_id"], trees[s][0][i], trees[s][-1][0], top[-1][0], sha(flat), now, now == top[-1][0], flat))
    return sorted(out, key=str)


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i, "line\n" * int(rng.integers(0, 4)) + f"text {i}", "hot") for i in range(60)]
    rows += [(100 + i, f"a\nb{i}", f"s{i:02d}") for i in range(11)]
    rows += [(200, "x\ny", None), (201, None, None), (202, "", None), (203, "é\nß 😀", "ünï"), (204, "z\n", "")]
    rows += [(None, "no id\n", "hot"), (None, "no id\n", "hot"), (7, "tie\n", "hot"), (7, "line\ntext", "hot"), (8, "again\n", "s03"), (8, "again\n", "s03"), (300, "long\n" * 50000, "s04")]
    return rows


@pytest.mark.parametrize(("arity", "step"), [(3, 7), (3, 1), (3, 2), (2, 3)])
def test_manifest_against_brute_force(spark, arity, step):
    from pyspark.sql import functions as F

    from sunledger.llm import merkle as M

    table = docs(spark, odd_rows()).repartition(5)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    claimed = F.when(even, M.leaf_digest([*fields, F.replace("text", F.lit("\n"), F.lit(""))]))
    rows = table.select(F.col("doc_id").alias("id"), F.col("source").alias("grouping"), M.leaf_digest([*fields, F.col("text")]).alias("leaf"), claimed.alias("claimed"))
    got = M.manifest(rows, arity=arity, step=step)
    want = manifest_by_hand([r.asDict() for r in table.collect()], arity)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {r[6] for r in want} == {True, False}


def test_document_manifest(spark):
    from sunledger.llm.merkle import document_manifest

    table = docs(spark, odd_rows())
    want = [r[:7] for r in manifest_by_hand([r.asDict() for r in table.collect()], 3)]
    assert sorted((tuple(r) for r in document_manifest(table).collect()), key=str) == sorted(want, key=str)
    one = document_manifest(docs(spark, [(1, "alone", "s")])).collect()
    assert [(r.subroot, r.root, r.proof_sha256, r.verified) for r in one] == [(one[0].leaf, one[0].leaf, sha(""), True)]
    assert document_manifest(docs(spark, [])).collect() == []


def test_children_that_never_come_are_an_error():
    import pyarrow as pa

    from sunledger.llm.merkle import _climb

    batch = pa.RecordBatch.from_pydict({"tree": [0, 0], "n": [3, 3], "idx": [0, 2], "digest": [b"a", b"c"]})
    with pytest.raises(RuntimeError, match="missing"):
        list(_climb(0, 3, 7)(iter([batch])))


# Centroid clustering


def kmeans_by_hand(rows, k, rounds, size, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda i: sha(f"1:{'-' if i is None else i}")
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        means = [[v for (_, v), c in zip(kept, own, strict=True) if c == j] for j in range(len(centroids))]
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(means, centroids, strict=True)]
    out = [(i, c := nearest(v), far(v, centroids[c])) for i, v in kept]
    each = {c: sum(d for _, x, d in out if x == c) for c in range(len(centroids))}
    short = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, short(d), short(each[c]), short(sum(each.values())), sha(",".join(map(str, centroids[c])))) for i, c, d in out), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2.0, 3) for i, e in rows], "vec_id bigint, embedding array<double>, cluster int, upper double, n int")


def cluster_rows(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "k", "size", "rounds", "spread"), [(300, 16, 8, 3, 1.0), (200, 5, 3, 6, 0.05), (9, 16, 4, 3, 1.0), (120, 1, 4, 2, 1.0), (150, 4, 2, 3, 1e7), (60, 3, 2, 2, 1e12)])
def test_clusters_against_brute_force(spark, n, k, size, rounds, spread):
    from sunledger.llm.centroids import cluster_vectors

    rng = np.random.default_rng(n)
    centers = rng.normal(size=(5, size))
    rows = [(i, [float(x) for x in (centers[i % 5] + rng.normal(size=size) * 0.3) * spread]) for i in range(n)]
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1]), (None, rows[6][1])]
    rows += [(900, None), (901, [1.0] * (size - 1)), (902, []), (903, [None] + [1.0] * (size - 1)), (904, [float("nan")] * size), (905, [float("inf")] * size)]
    got = cluster_vectors(vectors(spark, rows).repartition(3), k=k, size=size, rounds=rounds)
    assert cluster_rows(got) == kmeans_by_hand(rows, k, rounds, size, 64)


def test_ties_go_to_the_smaller_number_and_bounds_skip_scans(spark):
    from sunledger.llm.centroids import cluster_vectors

    grid = [(i, [x / 64, y / 64]) for i, (x, y) in enumerate(itertools.product(range(12), repeat=2))]
    assert cluster_rows(cluster_vectors(vectors(spark, grid), k=6, size=2, rounds=4)) == kmeans_by_hand(grid, 6, 4, 2, 64)
    apart = [(i, [100.0 * (i % 4) + (i % 7) / 64, 0.0]) for i in range(400)]
    assert cluster_vectors(vectors(spark, apart), k=4, size=2, rounds=8).filter("scanned").count() < 400
    assert cluster_vectors(vectors(spark, []), size=2).collect() == []
    same = [(i, [1.0, 2.0]) for i in range(50)]
    assert cluster_rows(cluster_vectors(vectors(spark, same), k=4, size=2)) == kmeans_by_hand(same, 4, 3, 2, 64)


# Document fingerprints


def sketch_by_hand(text, below="1"):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = {hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(len(words) - 4, 1))} if words else set()
    return {h for h in hashes if h < below} or set(sorted(hashes)[:1])


def near(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_brute_force(spark):
    from sunledger.llm.fingerprints import edited_fingerprints

    rng = np.random.default_rng(2)
    words = ["ab", "cde", "Élan", "fox", "😀", "of", "stone", "river"]
    text = lambda n: " ".join(rng.choice(words, n))
    long = text(4000)
    rows = [(i, text(int(rng.integers(1, 300)))) for i in range(40)] + [(50, None), (51, ""), (52, " \n\t"), (53, "one"), (54, "a b c d"), (55, long), (56, long), (57, long + " tail"), (58, "x" * 200000), (-3, "minus\x0bone")]
    rows += [(5, "same id, other text"), rows[6], rows[6], (None, "no id"), (None, None), (None, None)]
    table = docs(spark, [(d, t, "s") for d, t in rows]).repartition(4)
    got = edited_fingerprints(table).collect()
    classes = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, [255 - x for x in bytes.fromhex(sha(f"{'-' if r[0] is None else r[0]}:{r[1]}"))]), reverse=True)
    want = []
    for i, (d, t) in enumerate(classes):
        nid, nt = classes[(i + 1) % len(classes)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nt[:half]
        s, e, n = sketch_by_hand(t), sketch_by_hand(edited), sketch_by_hand(nt)
        inside = lambda a, b: len(a & b) / len(a) if a else float(not b)
        row = (d, len(t), sha(edited), "".join(sorted(s)), "".join(sorted(e)), near(s, e), near(s, n), inside(s, e), inside(s, n), nid)
        want += [row] * sum((x, y or "") == (d, t) for x, y in rows)
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert edited_fingerprints(docs(spark, [])).collect() == []
    assert [r.near_next for r in edited_fingerprints(docs(spark, [(1, "only one here", "s")])).collect()] == [1.0]


def test_sketches_merge_and_estimate_containment(spark):
    from pyspark.sql import functions as F

    from sunledger.llm import fingerprints as P

    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(5000)]
    long = [str(x) for x in rng.choice(words, 30000)]
    a, b = " ".join(long), " ".join(long[4000:7000] + [str(x) for x in rng.choice(words, 3000)])
    df = spark.createDataFrame([(a, b)], "a string, b string").select(P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b"))
    row = df.select(P.containment(F.col("b"), F.col("a")).alias("in"), P.resemblance(F.col("a"), F.col("b")).alias("near"), P.merged(F.col("a"), F.col("b")).alias("m"), "a", "b").first()
    assert abs(row["in"] - 0.5) < 0.1
    assert abs(row["near"] - 3000 / 33000) < 0.03
    assert set(row["m"]) == set(row["a"]) | set(row["b"])
    # a short text's only hash leaves a union that has hashes under the fraction
    short = spark.createDataFrame([("one two", a), ("", "one two"), ("", "")], "a string, b string").select(P.merged(P.sketch(F.col("a")), P.sketch(F.col("b"))).alias("m")).collect()
    assert set(short[0]["m"]) == {h for h in sketch_by_hand("one two") if h < "1"} | sketch_by_hand(a)
    assert set(short[1]["m"]) == sketch_by_hand("one two")
    assert short[2]["m"] == []

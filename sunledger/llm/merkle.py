"""A Merkle manifest of a dataset: a root over all rows, and for each row a proof that leads to it.

Rows are leaves of one tree for each group, ordered by id; the groups' roots are leaves of a top tree, ordered by group
(null first, then by UTF-8 bytes). While a level has several nodes, each run of ARITY consecutive ones has a parent,
the SHA-256 of their digests (lowercase hex) joined; a last run may be shorter, down to one node. Every level's size
follows from the number of leaves, and so does how many children a parent waits for.

Upwards, a task holds partial parents by (tree, level, place), each with its children by their place in the run. A
child's arrival completes its parent as soon as that many are there; the parent is then let go and arrives itself one
level up. A task gets whole blocks of ARITY**STEP neighbours, so its partial parents are few, and a group of any size
is spread over many tasks. What a block cannot complete, its topmost node, is the frontier that is shuffled into the
blocks of the next round. Downwards, each round's nodes meet what the round above found for their block (the reverse
link), and take along the siblings on their way.

Rows alike in group, id and content are leaves of their own, equal ones. Among equal ids the smaller digest comes
first; null ids come before all others. An empty table has an empty manifest; a single row is subroot and root, and its
proof is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunledger.llm.common import discard, materialize

ARITY = 3
#: Levels that one round climbs: a block has ARITY**STEP nodes at most.
STEP = 7
RESULT = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof string"


def field_text(value: Column) -> Column:
    """A field as it goes into a leaf: its length in UTF-8 bytes, a colon and the value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)), 256)


@lru_cache(maxsize=1 << 16)
def level_sizes(n: int, arity: int = ARITY) -> tuple[int, ...]:
    """Number of nodes of each level over n leaves, the last one 1."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return tuple(out)


def parent_digest(children: list[bytes]) -> bytes:
    """Digest (hex) of a run of digests (hex)."""
    return sha256(b"".join(children)).hexdigest().encode()


def fold(digest: bytes, proof: bytes, places: list[tuple[int, int]], arity: int = ARITY) -> bytes:
    """The root that follows from a leaf's digest and its proof. places: (index, number of leaves) in each tree on the way."""
    at = 0
    for index, n in places:
        for size in level_sizes(n, arity)[:-1]:
            index, own = divmod(index, arity)
            end = at + 64 * (min(arity, size - index * arity) - 1)
            left = at + 64 * own
            digest = parent_digest([proof[at:left], digest, proof[left:end]])
            at = end
    return digest


def _placed(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df, stored, with `place` (from 0) in the given order, which may have ties, and `range`, the part of the order a row lies in."""
    cut = df.withColumn("__tie", F.monotonically_increasing_id())
    cut = cut.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    rows = materialize(cut.withColumn("__at", F.monotonically_increasing_id()), name).withColumn("range", F.shiftright("__at", 33))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("__start"))
    # a row for each range partition, as many as the session's shuffle partitions at most
    return rows.join(F.broadcast(starts), "range").withColumn("place", F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__start")


def _climb(base: int, arity: int, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(tree, n, idx, digest) of level base to (tree, n, idx, digest, done) of the highest nodes that follow, base + step at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int, int], dict[int, bytes]] = {}
        for batch in batches:
            out: list[tuple] = []
            for tree, n, idx, digest in zip(*[batch.column(c).to_pylist() for c in ("tree", "n", "idx", "digest")], strict=True):
                sizes, level = level_sizes(n, arity), base
                while sizes[level] > 1 and level < base + step:
                    parent, own = divmod(idx, arity)
                    children = waiting.setdefault((tree, level, parent), {})
                    children[own] = digest
                    if len(children) < min(arity, sizes[level] - parent * arity):
                        break
                    del waiting[tree, level, parent]
                    digest, idx, level = parent_digest([children[i] for i in range(len(children))]), parent, level + 1
                else:
                    out.append((tree, n, idx, digest, sizes[level] == 1))
            if out:
                tree, n, idx, digest, done = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), pa.array(n, pa.int64()), pa.array(idx, pa.int64()), pa.array(digest, pa.binary()), pa.array(done)], ["tree", "n", "idx", "digest", "done"])
        if waiting:
            raise RuntimeError("children are missing: the places of the leaves have holes")

    return run


def _rounds(leaves: DataFrame, arity: int, step: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes each round begins with, and the roots: tree, n, digest, round. leaves: tree, n, idx, digest, and what else."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    count = max(1, -(-(len(level_sizes(most, arity)) - 1) // step)) if most else 1
    nodes, rounds, roots = leaves, [], None
    for r in range(count):
        rounds.append(nodes)
        blocks = nodes.select("tree", "n", "idx", "digest", F.floor(F.col("idx") / arity**step).alias("block"))
        blocks = blocks.repartition("tree", "block").sortWithinPartitions("tree", "idx").drop("block")
        up = materialize(blocks.mapInArrow(_climb(r * step, arity, step), "tree long, n long, idx long, digest binary, done boolean"), "nodes")
        ended = up.filter("done").select("tree", "n", "digest", F.lit(r).alias("round"))
        roots = ended if roots is None else roots.unionByName(ended)
        nodes = up.filter("not done").drop("done")
    return rounds, roots


def _blocks_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[dict]]:
    """Rows of one (tree, block) after the other; a block has size nodes at most and a row of its reverse link, idx -1."""
    block: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if block and (row["tree"], row["block"]) != (block[0]["tree"], block[0]["block"]):
                yield block
                block = []
            block.append(row)
            if len(block) > size + 1:
                raise RuntimeError("a block has more nodes than it can have")
    if block:
        yield block


def _descend(base: int, arity: int, step: int, finish: Callable[[dict, bytes, dict], tuple], names: list[str], kinds: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Proof of each node of a block, from its siblings inside and the proof of the block's topmost node; finish makes a row of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for link, *nodes in _blocks_of(batches, arity**step):
            if link["idx"] != -1:
                raise RuntimeError("a block without a link from above")
            sizes, levels, level = level_sizes(nodes[0]["n"], arity), [[x["digest"] for x in nodes]], base
            while sizes[level] > 1 and level < base + step:
                below = levels[-1]
                levels.append([parent_digest(below[i : i + arity]) for i in range(0, len(below), arity)])
                level += 1
            proofs = [link["upper"]]
            for below in reversed(levels[:-1]):
                runs = [below[i // arity * arity : i // arity * arity + arity] for i in range(len(below))]
                proofs = [b"".join([*run[: i % arity], *run[i % arity + 1 :], proofs[i // arity]]) for i, run in enumerate(runs)]
            out = [finish(node, proof, link) for node, proof in zip(nodes, proofs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(k).type) for k, c in zip(names, zip(*out, strict=True), strict=True)], names)

    return run


LINK = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("upper", pa.binary()), ("subroot", pa.binary())])


def _proofs(rounds: list[DataFrame], ends: DataFrame, arity: int, step: int, finish: Callable[[dict, bytes, dict], tuple] | None = None, kinds: pa.Schema = LINK, schema: str = "") -> DataFrame:
    """Goes down the rounds. ends: tree, round, upper, subroot of each root. Without finish, a row (tree, block, upper, subroot) for each leaf, block its place."""
    link = lambda node, proof, above: (node["tree"], node["idx"], proof, above["subroot"])
    above = None
    for r in reversed(range(len(rounds))):
        links = ends.filter(F.col("round") == r).select("tree", F.lit(0).cast("long").alias("block"), "upper", "subroot")
        links = links if above is None else links.unionByName(above)
        nodes = rounds[r].withColumn("block", F.floor(F.col("idx") / arity**step))
        rows = nodes.unionByName(links.withColumn("idx", F.lit(-1).cast("long")), allowMissingColumns=True)
        rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        last = r == 0 and finish is not None
        use, of, out = (finish, kinds, schema) if last else (link, LINK, "tree long, block long, upper binary, subroot binary")
        above = rows.mapInArrow(_descend(r * step, arity, step, use, of.names, of), out)
        if not last:
            above = materialize(above, "links")
    return above


def manifest(rows: DataFrame, arity: int = ARITY, step: int = STEP, with_proof: bool = True) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified, proof of every row.

    rows: id (long), grouping (string), leaf (digest, hex), claimed (another digest to be checked by the row's proof, or
    null: leaf itself). proof: the siblings' digests joined, lowest level first, left to right, null unless asked for.
    folded_root follows from claimed and the proof; verified says whether it is the root.
    """
    spark = rows.sparkSession
    # '' for null comes first, and the order of the others is that of their bytes
    keyed = rows.select("id", F.coalesce(F.concat(F.lit("="), "grouping"), F.lit("")).alias("g"), F.encode("leaf", "utf-8").alias("digest"), F.encode("claimed", "utf-8").alias("claimed"))
    placed = _placed(keyed, ["g", F.col("id").asc_nulls_first(), "digest"], "leaves")
    groups = placed.groupBy("g").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    groups = _placed(groups, ["first"], "groups").select("g", "first", "n", F.col("place").alias("tree"))
    n_groups = groups.count()
    # a group's rows meet its numbers range by range, so a large group is no single key
    parts = placed.select("range", "g").distinct().join(groups, "g")
    leaves = placed.join(parts, ["range", "g"]).select("tree", "n", (F.col("place") - F.col("first")).alias("idx"), "digest", "claimed", "id")
    leaves = materialize(leaves, "leaves")
    discard(placed)
    rounds, roots = _rounds(leaves, arity, step)
    top = roots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("n"), F.col("tree").alias("idx"), "digest")
    top_rounds, top_root = _rounds(materialize(top, "subroots"), arity, step)
    found = top_root.first()  # one row: the root of all
    if found is None:
        return spark.createDataFrame([], RESULT)
    root = bytes(found["digest"])
    end = spark.createDataFrame([(0, found["round"], bytearray(), None)], "tree long, round int, upper binary, subroot binary")
    over = _proofs(top_rounds, end, arity, step).select(F.col("block").alias("tree"), "upper")
    ends = roots.select("tree", "round", F.col("digest").alias("subroot")).join(over, "tree")

    def result(node: dict, proof: bytes, link: dict) -> tuple:
        leaf, claimed = node["digest"], node["claimed"]
        folded = fold(leaf if claimed is None else claimed, proof, [(node["idx"], node["n"]), (node["tree"], n_groups)], arity)
        return node["id"], leaf, link["subroot"], root, sha256(proof).hexdigest(), folded, folded == root, proof if with_proof else None

    text = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "proof"]
    kinds = pa.schema([("id", pa.int64()), *[(c, pa.string()) for c in text[:5]], ("verified", pa.bool_()), ("proof", pa.string())])
    return _proofs(rounds, ends, arity, step, result, kinds, RESULT)


def document_manifest(docs: DataFrame, with_proof: bool = False) -> DataFrame:
    """Manifest of documents grouped by source: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf covers doc_id, source, lang, n_chars and text; other columns are not looked at. To show what the proofs are
    for, rows whose doc_id has an even CRC-32 claim a text without its line feeds (null ids and null texts claim what they are).
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    claimed = F.when(even & F.contains("text", F.lit("\n")), leaf_digest([*fields, F.replace("text", F.lit("\n"), F.lit(""))]))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("grouping"), leaf_digest([*fields, F.col("text")]).alias("leaf"), claimed.alias("claimed"))
    out = manifest(rows, with_proof=with_proof).withColumnRenamed("id", "doc_id")
    return out if with_proof else out.drop("proof")

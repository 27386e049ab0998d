"""Merkle manifest whose nodes keep the hash state before each child.

Every row is a leaf of the tree of its group; the roots of the groups are the leaves of one
tree above. Sixteen consecutive nodes (fewer at the end of a level) become one, until one is
left; a node is the hash of its children's hex digests. Each node keeps, next to its digest,
the state of the hash before every child. To check a leaf against the root, a fold resumes the
state before its slot with the leaf's digest and the siblings to its right only, level by
level; what stands to the left is in the state.

Trees are built level by level as grouped tables, so no group meets in one task whatever share
of the rows it holds: positions come from a range sort, a run never has more than 16 nodes.
The driver learns the size of the largest group, no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtally.llm import sha_states as sha
from voxtally.session import cut_lineage

FANOUT = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOP = "top"


def leaf_digest(*columns: Column) -> Column:
    """Hash of the columns in order: ``-`` where missing, else UTF-8 byte count, ``:``, value."""
    parts = [
        F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
        for c in columns]
    return F.sha2(F.concat(*parts), 256)


def lower_letters(text: Column) -> Column:
    """A-Z in lower case, everything else as it was."""
    return F.translate(text, UPPER, UPPER.lower())


def group_key(group: Column) -> Column:
    """A key without nulls that keeps their order: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` (tree, digest, ...) with ``pos`` from 0 and ``size`` of its tree.

    Order is by ``order``, nulls first, then by digest; rows equal in both are alike.
    """
    keys = ["tree", *order, "digest"]
    rows = cut_lineage(
        leaves.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("__at", F.monotonically_increasing_id()))
    # The upper bits of the id name the range, the lower ones count its rows.
    rows = rows.withColumn("__range", F.shiftright("__at", 33))
    starts = rows.groupBy("tree", "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    of_tree = W.partitionBy("tree").orderBy("__range")
    starts = starts.select(
        "tree", "__range", "__first",
        F.coalesce(F.sum("__n").over(of_tree.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(W.partitionBy("tree")).alias("size"))
    return rows.join(starts, ["tree", "__range"]).withColumn(
        "pos", F.col("__at") - F.col("__first") + F.col("__before")
    ).drop("__at", "__range", "__first", "__before")


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Counts and values of a list column."""
    return np.diff(column.offsets.to_numpy()), column.flatten()


def _text_words(column: pa.Array) -> np.ndarray:
    """Hex digests as blocks, one row each."""
    return sha.words("".join(column.to_pylist()).encode(), 16)


def _texts(digests: np.ndarray) -> pa.Array:
    text = sha.hex_text(digests).tobytes()
    offsets = pa.py_buffer(np.arange(len(digests) + 1, dtype=np.int32) * sha.BLOCK)
    return pa.StringArray.from_buffers(len(digests), offsets, pa.py_buffer(text))


def _padded(counts: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Blocks of each node in rows of ``FANOUT``, zeros beyond the last."""
    at = np.arange(len(blocks)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros((len(counts), FANOUT, 16), np.uint32)
    out[np.repeat(np.arange(len(counts)), counts), at] = blocks
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``digest`` and ``states``, the state before each child, to rows with ``kids``."""
    for batch in batches:
        counts, kids = _flat(batch.column("kids"))
        blocks = _padded(counts, _text_words(kids))
        state, before = sha.start(len(counts)), np.zeros((len(counts), FANOUT, 8), np.uint32)
        for slot in range(int(counts.max(initial=0))):
            live = counts > slot
            before[live, slot] = state[live]
            state[live] = sha.resume(state[live], blocks[live, slot])
        states = [sha.as_bytes(before[i, :n]) for i, n in enumerate(counts)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, _texts(sha.finish(state, counts)), pa.array(states, pa.binary())],
            [*batch.schema.names, "digest", "states"])


def _with_digests(runs: DataFrame) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields)
    return runs.mapInArrow(_hashed, f"{fields}, digest string, states binary")


@dataclass
class Forest:
    """``levels[k]``: the nodes of height k + 1 of every tree, as tree, idx, n (nodes of that
    height in the tree), kids, digest, states; the lowest also carries ``entries``.
    ``lone``: trees of one leaf only. ``roots``: tree and digest of every root."""

    levels: list[DataFrame]
    lone: DataFrame
    roots: DataFrame


def grow(leaves: DataFrame, carried: Sequence[str] = ()) -> Forest:
    """All trees over ``leaves`` (tree, pos, size, digest and the columns to carry)."""
    entry = F.struct("pos", "digest", *carried)
    lone = cut_lineage(
        leaves.where("size = 1").select("tree", F.array(entry).alias("entries"), "digest"))
    runs = leaves.where("size > 1").groupBy("tree", F.expr(f"pos div {FANOUT}").alias("idx")).agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), F.max("size").alias("n"))
    runs = runs.withColumn("kids", F.transform("entries", lambda e: e["digest"]))
    above = F.ceil(F.col("n") / F.lit(FANOUT)).cast("long")
    levels: list[DataFrame] = []
    roots = lone.select("tree", "digest")
    widest = 2
    while widest > 1:
        level = cut_lineage(_with_digests(runs.withColumn("n", above)))
        widest = level.agg(F.max("n")).first()[0] or 0
        if not widest:
            break
        levels.append(level)
        roots = roots.unionByName(level.where("n = 1").select("tree", "digest"))
        runs = level.where("n > 1").groupBy("tree", F.expr(f"idx div {FANOUT}").alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("__kids"), F.max("n").alias("n"))
        runs = runs.select(
            "tree", F.col("up").alias("idx"), "n", F.transform("__kids", lambda e: e["digest"]).alias("kids"))
    return Forest(levels, lone, cut_lineage(roots))


PATH = "array<struct<slot:int,kids:array<string>,state:binary>>"


def _steps_down(level: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of the children of a level's nodes, from the paths of the nodes."""
    kids = level.join(paths, ["tree", "idx"]).select(
        "tree", "idx", "kids", "states", "path", F.posexplode("kids").alias("slot", "__kid"))
    step = F.struct(
        F.col("slot").cast("int").alias("slot"), "kids",
        F.substring("states", F.col("slot") * 32 + 1, F.lit(32)).alias("state"))
    return kids.select(
        "tree", (F.col("idx") * FANOUT + F.col("slot")).alias("idx"),
        F.concat(F.array(step), "path").cast(PATH).alias("path"))


def paths_above(forest: Forest, of_roots: DataFrame) -> DataFrame:
    """Per lowest node (tree, idx): the steps from it up, ending with those ``of_roots`` has
    for its tree (tree, path)."""
    below = None
    for level in reversed(forest.levels):
        tops = level.where("n = 1").select("tree", "idx").join(of_roots, "tree")
        paths = tops if below is None else tops.unionByName(below)
        if level is forest.levels[0]:
            return paths
        below = _steps_down(level, paths)
    return of_roots.where(F.lit(False)).select("tree", F.lit(0).cast("long").alias("idx"), "path")


OUT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _climb(current: np.ndarray, states: np.ndarray, kids: np.ndarray, slots: np.ndarray, counts: np.ndarray,
           node: np.ndarray) -> np.ndarray:
    """Digests of the nodes, with ``current`` (blocks) in the place of one child each."""
    state = sha.resume(states, current)
    for right in range(1, int((counts - slots).max(initial=1))):
        live = np.flatnonzero(slots + right < counts)
        state[live] = sha.resume(state[live], kids[node[live], slots[live] + right])
    return sha.finish(state, counts)


def _folded(batches: Iterator[pa.RecordBatch], carried: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, entries = _flat(batch.column("entries"))
        n = len(counts)
        if not len(entries):
            continue
        run = np.repeat(np.arange(n), counts)
        slot = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        leaves = entries.field("digest")
        blocks = _text_words(leaves)
        current = _text_words(pa.compute.coalesce(entries.field("changed"), leaves))

        # The run's own step differs by row; a tree of one leaf has none.
        states = [s and sha.words(s, 8) for s in batch.column("states").to_pylist()]
        own = np.array([s is not None for s in states])
        rows = np.flatnonzero(own[run])
        digest = np.zeros((len(run), 8), np.uint32)
        if len(rows):
            before = np.concatenate([s for s in states if s is not None])
            digest[rows] = _climb(current[rows], before, _padded(counts, blocks), slot[rows], counts[run[rows]], run[rows])
            current[rows] = sha.hex_blocks(digest[rows])

        paths = batch.column("path").to_pylist()
        others = ["".join(k for step in path for i, k in enumerate(step["kids"]) if i != step["slot"]).encode()
                  for path in paths]
        for height in range(max(map(len, paths), default=0)):
            steps = [path[height] if len(path) > height else None for path in paths]
            has = np.array([s is not None for s in steps])
            rows = np.flatnonzero(has[run])
            n_kids = np.array([len(s["kids"]) if s else 0 for s in steps])
            kids = _padded(n_kids, _text_words(pa.array([k for s in steps if s for k in s["kids"]], pa.string())))
            at = np.array([s["slot"] if s else 0 for s in steps])
            state = np.concatenate([sha.words(s["state"] if s else bytes(32), 8) for s in steps])
            # Leaves of a run that were left alone come to the same digest: folded once.
            same, where = np.unique(
                np.concatenate([run[rows, None].astype(np.uint32), current[rows]], axis=1), axis=0, return_inverse=True)
            node, value = same[:, 0].astype(np.int64), np.ascontiguousarray(same[:, 1:])
            new = _climb(value, state[node], kids, at[node], n_kids[node], node)
            current[rows] = sha.hex_blocks(new)[where.ravel()]

        text = [bytes(x) for x in blocks.astype(">u4").view(np.uint8).reshape(-1, sha.BLOCK)]
        proofs, start = [], 0
        for i, count in enumerate(counts):
            mine = b"".join(text[start:start + count])
            for k in range(count):
                left, right = mine[:k * sha.BLOCK], mine[(k + 1) * sha.BLOCK:]
                proofs.append(hashlib.sha256(left + right + others[i]).hexdigest())
            start += count
        folded = current.astype(">u4").tobytes()
        offsets = pa.py_buffer(np.arange(len(run) + 1, dtype=np.int32) * sha.BLOCK)
        of_run = pa.array(run)
        yield pa.RecordBatch.from_arrays(
            [*(entries.field(c) for c in carried), leaves, batch.column("subroot").take(of_run),
             batch.column("root").take(of_run), pa.array(proofs, pa.string()),
             pa.StringArray.from_buffers(len(run), offsets, pa.py_buffer(folded))],
            [*carried, "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def manifest(leaves: DataFrame, group: str, order: Sequence[str], *, carried: Sequence[str] = ()) -> DataFrame:
    """Roots, proofs and folds of every leaf.

    ``leaves`` has ``digest`` (lowercase hex), ``changed`` (the digest to fold in its place,
    null for its own), ``group``, the columns of ``order`` (ascending, nulls first) and those to
    carry along. Returns one row per leaf: the carried columns, leaf, subroot (the group's root),
    root, proof_sha256 (hash of all siblings, level by level, left to right), folded_root and
    verified. A null group is a group of its own and comes first; rows equal in the order are
    taken by digest; repeated rows are leaves like others; no leaves give no rows. Further
    columns are ignored. The names tree, pos, size, digest and changed are the operator's.
    """
    carried = list(carried)
    kept = [f"__c{i}" for i in range(len(carried))]
    rows = cut_lineage(leaves.select(
        group_key(F.col(group)).alias("tree"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)],
        "digest", "changed", *[F.col(c).alias(k) for c, k in zip(carried, kept)]))
    at = numbered(rows, [f"__o{i}" for i in range(len(order))])
    forest = grow(at, ["changed", *kept])
    above = grow(numbered(forest.roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("__o"), "digest"), ["__o"]),
                 ["__o"])

    # From the one root down to the roots of the groups, then down to the lowest nodes.
    end = F.array().cast(PATH).alias("path")
    tops = above.roots.select("tree", end)
    lowest = above.lone.select(F.element_at("entries", 1)["__o"].alias("tree"), end)
    if above.levels:
        step = above.levels[0].join(paths_above(above, tops), ["tree", "idx"])
        kids = step.select("kids", "states", "path", F.posexplode("entries").alias("slot", "e"))
        lowest = lowest.unionByName(kids.select(
            F.col("e.__o").alias("tree"),
            F.concat(F.array(F.struct(
                F.col("slot").cast("int").alias("slot"), "kids",
                F.substring("states", F.col("slot") * 32 + 1, F.lit(32)).alias("state"))), "path").cast(PATH).alias("path")))
    lowest = cut_lineage(
        lowest.join(forest.roots.withColumnRenamed("digest", "subroot"), "tree")
        .withColumn("root", above.roots.select("digest").scalar()))
    of_trees = lowest.select("tree", "subroot", "root")
    runs = forest.lone.join(lowest, "tree").select(
        "entries", F.lit(None).cast("binary").alias("states"), "path", "subroot", "root")
    if forest.levels:
        base = forest.levels[0].select("tree", "idx", "entries", "states")
        runs = runs.unionByName(
            base.join(paths_above(forest, lowest.select("tree", "path")), ["tree", "idx"]).join(of_trees, "tree")
            .select("entries", "states", "path", "subroot", "root"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fields = "".join(f"{k} {types[k]}, " for k in kept) + OUT
    out = runs.mapInArrow(lambda batches: _folded(batches, kept), fields)
    return out.withColumnsRenamed(dict(zip(kept, carried))).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def document_leaves(documents: DataFrame) -> DataFrame:
    """Leaves of documents; where 5 divides the checksum of the id, the digest to fold is that
    of the text with A-Z in lower case. A null id is never tampered with."""
    fields = ["doc_id", "source", "lang", "n_chars"]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    head = [F.col(c) for c in fields]
    return documents.select(
        "doc_id", "source", leaf_digest(*head, F.col("text")).alias("digest"),
        F.when(hit, leaf_digest(*head, lower_letters(F.col("text")))).alias("changed"))

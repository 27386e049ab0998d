"""Near-copies by a chosen-path set similarity join.

A document is the set of its five-word shingles, stood for by ``TOKENS`` minwise tokens and a
finer sketch that estimates similarities.
Several independent trees branch the sets: at each node ``BRANCHES`` token positions not yet
used on its path are chosen, and sets with the same token there go on together. One position
over the similarity sought would only just keep a pair at the threshold and lose more with
every level; three keep it on ever more paths.
Candidates are confirmed on full sets.

Only components are asked for, so a node needs no further work once its sets are in one
component. A node of up to ``WHOLE`` times ``NODE`` sets gives the likeliest tree of its
candidate pairs, found in one task: where each edge holds, or its ends are linked elsewhere, no
candidate pair of the node is left. Only nodes with an edge that failed are compared
exhaustively. A larger node first links its sets to one pivot; while that leaves more apart than
a node may compare, sets outside the largest component try further pivots, round by round, until
a round gains little. Only then is what is left compared across components, or branches. That keeps thousands
of copies of one text linear, also where few of them are close to any one. Where many are
apart, bounded tiles of a node are compared in Arrow batches: tokens alone first, which most
sets of a node formed by chance do not pass, then whole sets of up to ``SMALL`` shingles. Links
merge components as they are found, so a tile gives fewer links than it has sets, and pairs
just below the threshold, which the sketch cannot tell from links, never become rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.llm import shingles
from voxtally.llm.common import empty, row_key
from voxtally.llm.components import components
from voxtally.session import cut_lineage, drop_folders, folders_made, folders_since

PERCENT = 75
TOKENS = 32
TREES = 8
NODE = 1024  # sets outside a node's largest component that are compared exhaustively
WHOLE = 8  # times ``NODE``: sets of a node that one task compares by their sketches
DEPTH = 16
BRANCHES = 3
AGREE = 13  # of 32 tokens; a pair at 0.75 has fewer in one of 100,000 cases
LIKELY = 61  # percent of 252 hash ranges; 5 standard deviations below a pair at 0.75
APART = 16  # sets outside a node's largest component from which it is compared in tiles
TILE = 4096  # sets of a node that up to ``NODE`` others are compared with in one task
PIVOTS = 4  # a node and round, half of them of its largest component
GAIN = 0.75  # a node goes on while a round leaves at most this share of them apart
SMALL = 1024  # shingles, 8 KB a set
BROADCAST_IDS = 1_000_000  # 8 MB of ids
BATCH_BYTES = 4_000_000

SIGNED = "doc_id bigint, key binary, n bigint, tokens array<int>, sketch array<bigint>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = shingles.multipliers(TOKENS)
    for batch in batches:
        keys, sizes, tokens, sketches = [], [], [], []
        for text in batch.column("text").cast(pa.large_binary()):
            found = shingles.shingle_set(text.as_py())
            sizes.append(len(found))
            keys.append(shingles.set_key(found) if len(found) else None)
            tokens.append(shingles.minwise(found, factors) if len(found) else None)
            sketches.append(shingles.sketch(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
             pa.array(tokens, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64()))],
            names=["doc_id", "key", "n", "tokens", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, members, size = [], [], 0
        for text in batch.column("text").cast(pa.large_binary()):
            found = shingles.shingle_set(text.as_py())
            if len(found):
                keys.append(shingles.set_key(found))
                members.append(found.tobytes())
                size += len(members[-1])
            if size > BATCH_BYTES:
                yield _set_batch(keys, members)
                keys, members, size = [], [], 0
        if keys:
            yield _set_batch(keys, members)


def _set_batch(keys: list[bytes], members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(members, pa.binary())], names=["key", "members"])


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().astype(kind).reshape(len(column), -1)


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of ``x`` and each of ``y`` whether at least ``AGREE`` tokens are equal."""
    count = np.zeros((len(x), len(y)), np.uint8)
    for i in range(TOKENS):
        count += x[:, i, None] == y[None, :, i]
    return count >= AGREE


def _partners(tile: pa.Table) -> pa.Table:
    """The sets of a tile that may have a link into another component, by sizes and low bits of
    tokens, which agree at least as often as whole ones."""
    few = tile.column("few").to_numpy()
    low, n = _matrix(tile.column("low"), np.uint8), tile.column("n").to_numpy()
    root = tile.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
    all_, few = np.flatnonzero(~few), np.flatnonzero(few)
    found = np.zeros(len(n), bool)
    step = max(1, (1 << 22) // max(1, len(all_)))
    for part in range(0, len(few), step):
        own = few[part : part + step]
        x, y = n[own, None], n[None, all_]
        meet = _agreeing(low[own], low[all_]) & (root[own, None] != root[None, all_])
        meet &= 100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y)
        found[own] |= meet.any(axis=1)
        found[all_] |= meet.any(axis=0)
    return tile.select(["node", "key"]).filter(pa.array(found))


def _links(tile: pa.Table) -> pa.Table:
    """Links of a tile between components, as many as merge them (``sure``), and pairs that the
    sketch admits where a whole set is missing."""
    keys, roots = tile.column("key").to_pylist(), tile.column("root").to_pylist()
    major = np.array([r == m for r, m in zip(roots, tile.column("major").to_pylist())])
    _, code = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)
    _, rank = np.unique(np.array([k.hex() for k in keys]), return_inverse=True)
    component = np.arange(code.max() + 1)
    n, place, branching = (tile.column(c).to_numpy() for c in ("n", "place", "branching"))
    tokens = _matrix(tile.column("tokens"), np.int32)
    cells = _matrix(tile.column("sketch"), np.int64).view(np.uint8)
    sets = [None if x is None else np.frombuffer(x, np.uint64) for x in tile.column("members").to_pylist()]
    few = tile.column("few").to_numpy()
    all_ = np.flatnonzero(~few)
    out = []
    for b in np.flatnonzero(few).tolist():
        may = (component[code[all_]] != component[code[b]]) & (major[all_] | (rank[all_] < rank[b]))
        may &= 100 * np.minimum(n[all_], n[b]) >= PERCENT * np.maximum(n[all_], n[b])
        near = all_[may]
        near = near[_agreeing(tokens[near], tokens[b][None])[:, 0]]
        # A pair meets in every node it shares; at the roots only the first that is compared counts.
        for i, (_, position) in enumerate(_root_positions()[: place[b]]):
            if not branching[b] >> i & 1:
                near = near[tokens[near, position] != tokens[b, position]]
        if not len(near):
            continue
        union = np.count_nonzero(cells[near] | cells[b], axis=1)
        like = 100.0 * (union - np.count_nonzero(cells[near] ^ cells[b], axis=1)) / union
        for k in np.argsort(-like, kind="stable").tolist():
            a = int(near[k])
            if component[code[a]] == component[code[b]]:
                continue
            sure = sets[a] is not None and sets[b] is not None
            if shingles.similar(sets[a], sets[b], PERCENT) if sure else like[k] >= LIKELY:
                out.append((*sorted((keys[a], keys[b])), float(like[k]), sure))
                if sure:
                    component[component == component[code[a]]] = component[code[b]]
    columns = list(zip(*out)) or [[]] * 4
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.binary(), pa.float64(), pa.bool_()))],
                    names=["a", "b", "like", "sure"])


def _equal_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes of each row of ``x`` and of ``y`` are equal; a row is whole words, fewer than 2048 bytes."""
    return _ones(x == y)


def _ones(held: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(held).view(np.uint64)
    lanes = words.sum(axis=1, dtype=np.uint64)
    lanes = (lanes & _LANES) + ((lanes >> np.uint64(8)) & _LANES)
    return ((lanes * _LANE_ONES) >> np.uint64(48)).astype(np.int64)


_LANES, _LANE_ONES = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)


def _alike(low: np.ndarray, cells: np.ndarray, n: np.ndarray, own: tuple) -> np.ndarray:
    """Estimated similarity in percent of each set with its own one, 0 for what is no candidate."""
    out = np.zeros(len(n))
    may = 100 * np.minimum(n, own[2]) >= PERCENT * np.maximum(n, own[2])
    at = np.flatnonzero(may & (_equal_bytes(low, own[0]) >= AGREE))
    if len(at):
        x, y = cells[at], own[1][at] if own[1].ndim == 2 else own[1]
        union = _ones((x | y) != 0)
        out[at] = 100.0 * (union - _ones(x != y)) / union
        out[out < LIKELY] = 0
    return out


def _tree(low: np.ndarray, cells: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """The likeliest forest of the candidate pairs of one node: (i, j, like), one edge at most a set.

    Of any two sets joined by a chain of candidate pairs, it holds a chain. The sets not yet in
    it stand first in the arrays, which are used up.
    """
    left = len(n)
    place, best, other = np.arange(left), np.zeros(left), np.zeros(left, np.int64)
    pick = 0
    while True:
        taken, own = int(place[pick]), (low[pick].copy(), cells[pick].copy(), n[pick])
        if best[pick]:
            yield int(other[pick]), taken, float(best[pick])
        left -= 1
        for x in (low, cells, n, place, best, other):
            x[pick] = x[left]
        if not left:
            return
        like = _alike(low[:left], cells[:left], n[:left], own)
        closer = np.flatnonzero(like > best[:left])
        best[closer], other[closer] = like[closer], taken
        pick = int(best[:left].argmax())


def _trees(rows: pa.Table) -> pa.RecordBatch:
    """The forests of whole nodes, whose rows lie together."""
    node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy().copy()
    low = _matrix(rows.column("low"), np.uint8)
    cells = _matrix(rows.column("sketch"), np.int64).view(np.uint8)
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    size = np.diff(np.r_[start, len(node)])
    a = start[size == 2]
    like = _alike(low[a], cells[a], n[a], (low[a + 1], cells[a + 1], n[a + 1]))
    edges = [np.column_stack((a, a + 1, like))[like > 0]]
    for at, many in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        part = slice(at, at + many)
        if found := list(_tree(low[part], cells[part], n[part])):
            edges.append(np.array(found) + (at, at, 0))
    found = np.concatenate(edges)
    i, j = found[:, :2].astype(np.int64).T
    keys = rows.column("key").combine_chunks()
    return pa.RecordBatch.from_arrays(
        [pa.array(node[i]), keys.take(pa.array(np.minimum(i, j))), keys.take(pa.array(np.maximum(i, j))), pa.array(found[:, 2])],
        names=["node", "a", "b", "like"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forests of nodes that follow one another; the last of a batch waits for the rest of its rows."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        node = batch.column("node").to_numpy()
        if not len(node):
            continue
        last = int(np.searchsorted(node, node[-1]))
        if last or waiting and waiting[-1].column("node")[-1].as_py() != node[0]:
            if len(whole := pa.Table.from_batches([*waiting, batch.slice(0, last)])):
                yield _trees(whole)
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield _trees(pa.Table.from_batches(waiting))


def _tiles(members: DataFrame) -> DataFrame:
    """Members of nodes dealt to tiles (node, m, f): of those outside the largest component
    (``few``) some, to be compared with some of all."""
    chunks = members.withColumns({
        "ms": F.ceil(F.col("minor") / NODE), "fs": F.ceil(F.col("total") / TILE)})
    own_m, own_f = F.pmod(F.xxhash64("key"), F.col("ms")), F.pmod(F.xxhash64(F.lit(1), "key"), F.col("fs"))
    all_ = chunks.withColumns({
        "m": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ms") - 1)), "f": own_f, "few": F.lit(False)})
    few = chunks.where(F.col("root") != F.col("major")).withColumns({
        "m": own_m, "f": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("fs") - 1)), "few": F.lit(True)})
    return all_.unionByName(few).drop("ms", "fs", "minor", "total")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [
            shingles.similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), PERCENT)
            for x, y in zip(batch.column("x"), batch.column("y"))
        ]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _agreement(x: Column, y: Column) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda same: same))


def _filled(x: Column) -> Column:
    """How many of the seven low bytes of a long are not zero."""
    low, high = F.lit(0x7F7F7F7F7F7F7F), F.lit(0x80808080808080)
    return F.bit_count((x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseAND(high))


def _likeness(x: Column, y: Column) -> Column:
    """Estimated similarity in percent: equal hash ranges among those either set fills."""
    def total(cells: Column) -> Column:
        return F.aggregate(cells, F.lit(0), lambda n, cell: n + cell)

    union = total(F.zip_with(x, y, lambda a, b: _filled(a.bitwiseOR(b))))
    apart = total(F.zip_with(x, y, lambda a, b: _filled(a.bitwiseXOR(b))))
    return 100 * (union - apart) / union


def _root_positions() -> list[tuple[int, int]]:
    """(tree, position): one or two positions per tree, 4/3 on average, none twice."""
    draw, free, out = random.Random(4), list(range(TOKENS)), []
    draw.shuffle(free)
    for tree in range(TREES):
        out += [(tree, free.pop()) for _ in range(2 if tree % 3 == 0 else 1)]
    return out


def _root_token(tokens: str, i: Column) -> Column:
    return F.get(tokens, F.get(F.array(*[F.lit(p) for _, p in _root_positions()]), i))


class _Join:
    """State of one join: the classes of equal sets and the components found so far."""

    def __init__(self, documents: DataFrame):
        self.documents = documents
        signed, folders = _staged(documents.select("doc_id", "text").mapInArrow(_sign, SIGNED))
        self.classes = cut_lineage(
            signed.where("n > 0").groupBy("key").agg(
                F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"),
                F.first("sketch").alias("sketch")))
        self.low = cut_lineage(self.classes.select("key", "n", _low("tokens")))
        # The sketches are kept once, by class.
        self.signed = cut_lineage(signed.select("doc_id", "key", "n"))
        spark = documents.sparkSession
        drop_folders(spark, folders)
        self.labels = empty(spark, "key binary, root binary")
        self.tested = empty(spark, "a binary, b binary")
        self.sets = empty(spark, "key binary, members binary")

    def estimate(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and sketches allow the similarity, with ``like``.

        Sizes and low bits of tokens decide first, so that few sketches travel.
        """
        low = {x: self.low.select(*[F.col(c).alias(f"{x}_{c}" if c != "key" else x) for c in ("key", "n", "low")])
               for x in ("a", "b")}
        pairs = pairs.select("a", "b").join(low["a"], "a").join(low["b"], "b").where(
            _may(F.col("a_n"), F.col("b_n")) & (_agreement(F.col("a_low"), F.col("b_low")) >= AGREE)).select("a", "b")
        left, right = self.side("a"), self.side("b")
        like = _likeness(F.col("a_sketch"), F.col("b_sketch"))
        return (
            pairs.join(left, "a").join(right, "b")
            .where(_may(F.col("a_n"), F.col("b_n"))
                   & (_agreement(F.col("a_tokens"), F.col("b_tokens")) >= AGREE))
            .select("a", "b", like.alias("like")).where(F.col("like") >= LIKELY)
        )

    def side(self, name: str) -> DataFrame:
        return self.classes.select(
            F.col("key").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "tokens", "sketch")])

    def fetch(self, keys: DataFrame) -> None:
        """Reads the full sets of the classes that were not needed before."""
        ids = cut_lineage(
            keys.join(self.sets, "key", "left_anti").join(self.classes, "key")
            .select(F.col("rep").alias("__rep")).distinct())
        if not (n := ids.count()):
            return
        side = F.broadcast(ids) if n <= BROADCAST_IDS else ids
        texts = self.documents.join(side, F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi")
        found = cut_lineage(texts.select("text").mapInArrow(_sets, "key binary, members binary"))
        self.sets = self.sets.union(found)

    def label(self, held: DataFrame) -> None:
        """Takes in new links: components of the components they connect."""
        roots = self.labels
        ends = held
        for side in ("a", "b"):
            ends = ends.join(roots.select(F.col("key").alias(side), F.col("root").alias(f"r{side}")), side, "left")
        ends = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
        merged = components(ends)
        moved = roots.join(merged.select(F.col("key").alias("root"), F.col("root").alias("to")), "root", "left")
        added = merged.join(roots, "key", "left_anti")
        self.labels = cut_lineage(
            moved.select("key", F.coalesce("to", "root").alias("root")).union(added.select("key", "root")))

    def confirm(self, pairs: DataFrame) -> None:
        """Tests staged pairs on full sets and takes in what holds."""
        if pairs.isEmpty():
            return
        keys = cut_lineage(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
        self.fetch(keys)
        sets = self.sets.join(keys, "key", "left_semi")  # the others do not travel
        full = (
            pairs.select("a", "b")
            .join(sets.select(F.col("key").alias("a"), F.col("members").alias("x")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("members").alias("y")), "b")
        )
        held = cut_lineage(full.mapInArrow(_confirm, "a binary, b binary"))
        self.tested = self.tested.union(pairs.select("a", "b"))
        if not held.isEmpty():
            self.label(held)

    def labelled(self, members: DataFrame) -> DataFrame:
        """Members of nodes with their component; nodes that lie in one component go."""
        known = members.join(self.labels, "key", "left").withColumn("root", F.coalesce("root", "key"))
        sizes = known.groupBy("node", "root").agg(F.count("*").alias("c"))
        nodes = sizes.groupBy("node").agg(
            F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("total"), F.count("*").alias("roots")
        ).where("roots > 1").select(
            "node", F.col("top.root").alias("major"), (F.col("total") - F.col("top.c")).alias("minor"), "total")
        return known.join(nodes, "node")

    def settle(self, members: DataFrame) -> DataFrame:
        """``labelled`` members after further pivots, tried where more than ``NODE`` sets are apart.

        A round costs ``PIVOTS`` rows a set that is apart. It changes which pairs are tried
        first and no result: what stays apart is compared or branches as before.
        """
        mixed, folders = _staged(self.labelled(members))
        busy = mixed.where(F.col("minor") > NODE)
        turn = 0
        while not busy.isEmpty():
            turn += 1
            drawn = [F.struct(F.xxhash64(F.lit(turn), F.lit(j), "key").alias("at"), "key", "root")
                     for j in range(PIVOTS)]
            pivots = busy.groupBy("node").agg(*[
                F.min(F.when(F.col("root") == F.col("major"), x) if j % 2 == 0 else x).alias(f"p{j}")
                for j, x in enumerate(drawn)
            ]).select("node", F.explode(F.array(*[f"p{j}" for j in range(PIVOTS)])).alias("p"))
            tried = busy.where("root <> major").join(pivots, "node").where(F.col("root") != F.col("p.root")).select(
                F.col("p.key").alias("a"), F.col("key").alias("b")).distinct()
            best = self.estimate(tried.join(self.tested, ["a", "b"], "left_anti")).groupBy("b").agg(
                F.max_by("a", F.struct("like", "a")).alias("a"))
            self.confirm(cut_lineage(best.select("a", "b")))
            before = busy.groupBy("node").agg(F.first("minor").alias("before"))
            busy = cut_lineage(
                self.labelled(busy.select("node", "key", "place", "used")).join(before, "node")
                .where((F.col("minor") <= GAIN * F.col("before")) & (F.col("minor") > NODE)).drop("before"))
        if not turn:
            return mixed
        settled = cut_lineage(self.labelled(mixed.select("node", "key", "place", "used")))
        drop_folders(members.sparkSession, folders)
        return settled

    def apart(self, pairs: DataFrame, *more: str) -> DataFrame:
        """``pairs`` with the present components of both ends, those within one left out."""
        out = pairs.select("a", "b", "like", *more)
        for side in ("a", "b"):
            out = out.join(self.labels.select(F.col("key").alias(side), F.col("root").alias(f"r{side}")), side, "left")
        return out.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra <> rb")

    def branching(self, large: DataFrame) -> DataFrame:
        """``key``, ``branching``: the places at which a set's root node branches, as bits."""
        return large.groupBy("key").agg(F.bit_or(_bit(F.col("place"))).alias("branching"))

    def meet(self, busy: DataFrame, large: DataFrame) -> DataFrame:
        """Compares the members of nodes with many apart in tiles and takes in their links. Returns
        pairs (a, b, like) that await confirmation, of sets above ``SMALL`` shingles."""
        tiled = _tiles(busy.join(self.low, "key"))
        near, folders = _staged(
            tiled.groupBy("node", "m", "f").applyInArrow(_partners, "node bigint, key binary").distinct())
        keys = cut_lineage(
            near.select("key").distinct().join(self.classes.where(F.col("n") <= SMALL).select("key"), "key"))
        self.fetch(keys)
        whole = self.sets.join(keys, "key", "left_semi")
        rows = (
            busy.join(near, ["node", "key"]).join(self.classes.drop("rep"), "key").join(whole, "key", "left")
            .join(self.branching(large), "key", "left").withColumn("branching", F.coalesce("branching", F.lit(0)))
        )
        found = cut_lineage(_tiles(rows).groupBy("node", "m", "f").applyInArrow(
            _links, "a binary, b binary, like double, sure boolean"))
        drop_folders(self.documents.sparkSession, folders)
        held = found.where("sure").select("a", "b").distinct()
        if not held.isEmpty():
            self.label(held)
        return found.where("NOT sure").select("a", "b", "like")

    def across(self, mixed: DataFrame, large: DataFrame) -> DataFrame:
        """Candidate pairs of different components within nodes: each set outside the node's
        largest component with every set of another component. ``large``: nodes that branch."""
        full = mixed.withColumnRenamed("key", "a").join(self.side("a"), "a")
        few = mixed.where(F.col("root") != F.col("major")).select(
            "node", F.col("key").alias("b"), F.col("root").alias("rb")).join(self.side("b"), "b")
        # A pair meets in every node it shares; at the roots only the first of them that is
        # compared counts. One that branches is not, and a set has the same one at its place.
        few = few.join(self.branching(large).withColumnRenamed("key", "b"), "b", "left")
        again = F.exists(
            F.sequence(F.lit(0), F.lit(len(_root_positions()) - 1)),
            lambda i: (i < F.col("place")) & (_root_token("a_tokens", i) == _root_token("b_tokens", i))
            & (F.getbit(F.coalesce("branching", F.lit(0)), i) == 0))
        one_way = (F.col("root") == F.col("major")) | (F.col("a") < F.col("b"))
        met = full.join(few, "node").where(
            (F.col("root") != F.col("rb")) & one_way & _may(F.col("a_n"), F.col("b_n")) & ~again
            & (_agreement(F.col("a_tokens"), F.col("b_tokens")) >= AGREE)
            & (_likeness(F.col("a_sketch"), F.col("b_sketch")) >= LIKELY))
        return met.select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
            _likeness(F.col("a_sketch"), F.col("b_sketch")).alias("like")).distinct()

    def span(self, members: DataFrame) -> DataFrame:
        """Takes in what holds of the likeliest forest of each node. Returns the members of the
        nodes of which an edge failed and its ends are still apart; in all others every
        candidate pair lies in one component.
        """
        rows = members.select("node", "key").join(
            self.classes.select("key", "n", _low("tokens"), "sketch"), "key")
        edges, folders = _staged(rows.select("node", "key", "n", "low", "sketch").repartition("node")
                                 .sortWithinPartitions("node", "key")
                                 .mapInArrow(_forest, "node bigint, a binary, b binary, like double"))
        pairs = edges.select("a", "b", "like").distinct().join(self.tested, ["a", "b"], "left_anti")
        # The likeliest edge of each set first; the others where their ends are still apart.
        best = pairs.select("a", "b", "like", F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(
            F.max_by(F.struct("a", "b"), F.struct("like", "a", "b")).alias("p"))
        best = cut_lineage(best.select("p.a", "p.b").distinct())
        self.confirm(best)
        self.confirm(cut_lineage(self.apart(pairs.join(best, ["a", "b"], "left_anti")).select("a", "b")))
        failed = self.apart(edges, "node").select("node").distinct()
        out = cut_lineage(members.join(failed, "node", "left_semi").select("node", "key", "place", "used"))
        drop_folders(members.sparkSession, folders)
        return out

    def star(self, members: DataFrame) -> None:
        """One link to a pivot settles most of a large node: each set tries the pivot most like it."""
        # The pivot is the set that shares its tokens with most others: of many edited copies
        # that is the text they were made from, or one close to it.
        central = members.groupBy("key").agg(F.sum("c").alias("score"))
        pivots = members.join(central, "key").groupBy("node").agg(
            F.max(F.struct("score", "key")).alias("top")).select("node", F.col("top.key").alias("pivot"))
        tried = members.join(pivots, "node").where("key <> pivot").select(
            F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
        best = self.estimate(tried).groupBy("b").agg(F.max_by("a", F.struct("like", "a")).alias("a"))
        self.confirm(cut_lineage(best.select("a", "b").join(self.tested, ["a", "b"], "left_anti")))

    def compare(self, ready: DataFrame, large: DataFrame) -> None:
        """Compares labelled nodes across their components. ``large``: nodes that may branch."""
        busy = cut_lineage(ready.where(F.col("minor") > APART).select(
            "node", "key", "place", "root", "major", "minor", "total"))
        pairs = self.across(ready.where(F.col("minor") <= APART), large)
        if not busy.isEmpty():
            pairs = pairs.union(self.meet(busy, large)).groupBy("a", "b").agg(F.max("like").alias("like"))
        pairs = cut_lineage(self.apart(pairs.join(self.tested, ["a", "b"], "left_anti")))
        if not pairs.isEmpty():
            # The likeliest pair of each component first, then that of any two components;
            # the rest only where those failed.
            for ends in (F.explode(F.array("ra", "rb")), F.struct(F.least("ra", "rb"), F.greatest("ra", "rb"))):
                first = pairs.select("a", "b", "like", ends.alias("ends")).groupBy("ends").agg(
                    F.max_by(F.struct("a", "b"), F.struct("like", "a", "b")).alias("p"))
                first = cut_lineage(first.select("p.a", "p.b").distinct())
                self.confirm(first)
                pairs = cut_lineage(self.apart(pairs.join(first, ["a", "b"], "left_anti")))
            self.confirm(pairs)

    def level(self, nodes: DataFrame, last: bool) -> DataFrame | None:
        """Works off one level of ``nodes`` (node, key, place, used); returns what has to branch."""
        shared = nodes.groupBy("node").agg(F.count("*").alias("c")).where("c > 1")
        members, folders = _staged(nodes.join(shared, "node").select("node", "key", "place", "used", "c"))
        huge = members.where(F.col("c") > WHOLE * NODE)
        open_ = self.span(members.where(F.col("c") <= WHOLE * NODE))
        large = None
        if huge.isEmpty():
            ready = None if open_.isEmpty() else cut_lineage(self.labelled(open_))
        else:
            self.star(huge)
            mixed = self.settle(huge.select("node", "key", "place", "used"))
            ready = cut_lineage(self.labelled(open_)).unionByName(
                mixed if last else mixed.where(F.col("minor") <= NODE))
            if not last:
                large = cut_lineage(mixed.where(F.col("minor") > NODE).select("node", "key", "used"))
        # A huge node branches or not; that its sets also meet elsewhere is left to each node.
        if ready is not None:
            self.compare(ready, huge)
        drop_folders(members.sparkSession, folders)
        return None if large is None or large.isEmpty() else large


def _low(tokens: str) -> Column:
    return F.transform(tokens, lambda t: t.bitwiseAND(0x7F).cast("byte")).alias("low")


def _staged(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """A written table with its folder, to be dropped when the table has been read for the last time."""
    mark = folders_made()
    return cut_lineage(df), folders_since(mark)


def _may(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _children(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Each node chooses ``BRANCHES`` positions by a hash of its path, which has used none."""
    free = F.filter(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda p: F.getbit("used", p) == 0)

    drawn = F.transform(free, lambda p: F.struct(F.xxhash64("node", p).alias("at"), p.alias("p")))
    chosen = F.slice(F.array_sort(drawn), 1, BRANCHES)
    return (
        nodes.withColumn("chosen", chosen["p"])
        .join(classes.select("key", "tokens"), "key")
        .withColumn("p", F.explode("chosen"))
        .select(F.xxhash64("node", "p", F.get("tokens", F.col("p"))).alias("node"), "key", F.lit(0).alias("place"),
                F.col("used").bitwiseOR(_bit(F.col("p"))).alias("used"))
    )


def _bit(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), p)


def near_copies(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept``: one row per row of ``documents``.

    Linked are documents with 100 * intersection >= 75 * union of their shingle sets;
    ``component_id`` is the smallest doc_id reachable. Equal sets are one class and need no
    pairs. A null or empty text has no shingle and is linked with nothing: its component is
    itself. Rows with the same id and text are the same document and both kept; a null id
    gives way to any other in its component. An empty table gives an empty one.

    Recall: a pair at 0.75 is missed by all root tokens with probability below 1e-6, by
    ``AGREE`` below 1e-5 and by ``LIKELY``, 5 standard deviations away, in about 1e-6;
    all shrink fast above the threshold. If each root node it shares has to branch (more than
    ``NODE`` sets outside the largest component), it is lost in about 2e-5 after 4 levels,
    7e-5 after 8, 3e-4 after 12 and 2e-3 after 15, simulated with 32 positions.
    """
    join = _Join(documents)
    roots = F.array(*[
        F.struct(F.xxhash64(F.lit(tree), F.lit(p), F.get("tokens", F.lit(p))).alias("node"), F.lit(i).alias("place"),
                 F.lit(1 << p).cast("bigint").alias("used"))
        for i, (tree, p) in enumerate(_root_positions())
    ])
    nodes: DataFrame | None = join.classes.select(F.inline(roots), "key")
    for depth in range(1, DEPTH + 1):
        nodes = join.level(nodes, last=depth == DEPTH)
        if nodes is None:
            break
        nodes = _children(nodes, join.classes)

    rooted = join.labels.join(join.classes.select("key", "rep"), "key")
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    linked = join.labels.join(smallest, "root").select("key", "component")
    classes = join.classes.join(linked, "key", "left").select(
        "key", F.coalesce("component", "rep").alias("component"))
    out = join.signed.join(classes, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` without all but one document of each component.

    Rows that share an id stay or go together; rows alike in id and text come out once.
    """
    gone = cut_lineage(
        near_copies(documents).groupBy(F.col("doc_id").alias("__gone"))
        .agg(F.max("kept").alias("stays")).where("NOT stays").select("__gone"))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = documents.join(side, F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")
    again = documents.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if again:
        keys = dict(zip(("__k0", "__k1", "__k2"), row_key(kept)))
        kept = kept.withColumns(keys).dropDuplicates([*keys]).drop(*keys)
    return kept

"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search over it.

Vectors with the same components are one node of the graph. NN-descent starts from the cells of random-projection
trees, which are split at medians, and joins, round by round, the neighbours of each node's neighbours, keeping those that are
nearer than what a node has. A query starts from its own node and a few common ones and follows the graph: each round
joins the lists of its nearest nodes not yet followed, until none is left among the best ``beam``.

All rounds are joins on partitions of a bounded number of bytes: a row holds a node's whole list, packed, and a vector
travels once to a partition, however many pairs there need it. Pivots are dealt to partitions by the leaves of a tree, so
that what meets at near pivots meets in few partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, remove, store, table

#: Neighbours in a node's list, and of those pointing back at it how many take part in a join.
DEGREE = 40
REVERSE = 40
#: Nodes a cell has at most, however many there are in all, and independent sets of cells.
CELL = 128
CELL_SETS = 4
#: NN-descent ends with the round that changed a smaller share of the entries of all lists.
DELTA = 0.05
#: Pivots of a partition's join, and partitions at least, for every core to have work.
PIVOTS_TOGETHER = 2048
LEAST_PARTS = 32
#: Bytes of vectors that a cell has at most, for long vectors.
CELL_BYTES = 32 << 20
#: Levels of a tree that are worked out at once, and nodes of a sample that each of their leaves gets for its bounds.
LEVELS_AT_ONCE = 6
LEAF_SAMPLE = 64
#: Finds that a partition holds before it keeps only each node's best.
FINDS_TOGETHER = 2_000_000
#: Share of a vector's length by which its projection is moved by its id, to part vectors that are nearly equal.
NUDGE = 1e-6
#: Longest nodes, and nodes by a hash, from which each search starts besides its own.
ENTRIES = 16
#: Queries of a partition's join, and partitions at least. A partition's vectors are no more than its queries times those
#: followed in a round times the links of each.
QUERIES_TOGETHER = 384
LEAST_QUERY_PARTS = 8
#: Nodes among which a search goes on, and those it follows in a round.
BEAM = 200
FOLLOW = 48
SEED = 20

#: nbrs and sims are packed 64-bit ids and 32-bit floats, vec 32-bit floats; part is the partition of the node's join.
GRAPH = "node long, part int, vec binary, nbrs binary, sims binary, worst float"
FOUND = "node long, nbrs binary, sims binary"


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary rows of ``counts`` values each."""
    offsets = np.concatenate(([0], np.cumsum(counts * values.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _flat(column: pa.ChunkedArray | pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed rows, and how many each row has; null rows have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    data = b"".join(v for v in column.to_pylist() if v is not None) if column.null_count else b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=dtype), sizes // np.dtype(dtype).itemsize


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat, counts = _flat(column, "<f4")
    return flat.reshape(len(counts), -1) if len(counts) else np.empty((0, 0), np.float32)


def _best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's ``keep`` nearest others, once each, sorted by owner and then nearest first."""
    order = np.lexsort((sim, other, owner))[::-1]
    owner, other, sim = owner[order], other[order], sim[order]
    once = np.ones(len(owner), dtype=bool)
    once[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, sim = owner[once], other[once], sim[once]
    order = np.lexsort((other, -sim, owner))
    owner, other, sim = owner[order], other[order], sim[order]
    firsts = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(firsts, np.arange(len(owner)), 0)) if len(owner) else np.empty(0, int)
    top = np.arange(len(owner)) - start < keep
    return owner[top], other[top], sim[top]


def _found_rows(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, keep: int) -> pa.Table:
    owner, other, sim = _best(owner, other, sim.astype("<f4"), keep)
    nodes, counts = np.unique(owner, return_counts=True)
    return pa.table({"node": pa.array(nodes, pa.int64()), "nbrs": _packed(other.astype("<i8"), counts), "sims": _packed(sim, counts)})


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that two sides of one origin can be told apart."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _part(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def vector_lengths(vectors: DataFrame, id_col: str, vector_col: str) -> list[int]:
    """The lengths that occur, the commonest first; of a few kinds of vectors there are a few."""
    v = F.col(vector_col)
    sized = vectors.where(F.col(id_col).isNotNull() & (F.size(v) > 0)).groupBy(F.size(v).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return [r["size"] for r in sized.orderBy(F.desc("n"), F.desc("size")).collect()]


def sound_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> DataFrame:
    """(vec_id, print, exact, vec) of the rows that take part: a digest of the components in double precision, and
    the components packed as 64-bit and 32-bit floats.

    Of rows with one id that of the smallest print counts. Vectors of ``dim`` components take part, by default of the commonest length.
    """
    v = F.col(vector_col)
    dim = dim or next(iter(vector_lengths(vectors, id_col, vector_col)), 1)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) + 0.0
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = x[good]
            prints = [hashlib.sha256(row.tobytes()).digest()[:16] for row in x]
            sizes = np.full(len(x), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(prints, pa.binary()), _packed(x.astype("<f8").ravel(), sizes), _packed(x.astype("<f4").ravel(), sizes)], names=["vec_id", "print", "exact", "vec"])

    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(v) == dim)).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    sound = rows.mapInArrow(run, "vec_id long, print binary, exact binary, vec binary")
    return sound.groupBy("vec_id").agg(F.min(F.struct("print", "exact", "vec")).alias("x")).select("vec_id", "x.*")


def distinct_vectors(sound: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): (node, vec) of the distinct vectors, and (print, node, vec_id) of each
    node's ``keep`` smallest ids. A node is named by its smallest id.

    Numbering goes over salted parts first, so that copies of one vector are many tasks' work.
    """
    salted = sound.select("print", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("print", "salt").orderBy("vec_id"))).where(F.col("r") <= keep)
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("print").orderBy("vec_id"))).where(F.col("r") <= keep)
    members = some.select("print", "vec_id", F.min("vec_id").over(Window.partitionBy("print")).alias("node"))
    nodes = members.where("vec_id = node").select("node").join(sound.select(F.col("vec_id").alias("node"), "vec"), "node")
    return nodes.select("node", "vec"), members.select("print", "node", "vec_id")


def _projection(ids: np.ndarray, x: np.ndarray, s: int, level: int) -> np.ndarray:
    """Places on the line that a level of set ``s`` splits; equal ones are told apart by the id."""
    normal = np.random.default_rng([SEED, s, level]).standard_normal(x.shape[1])
    x = x.astype(np.float64)
    spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) / (1 << 24)
    return (x * normal).sum(axis=1) + NUDGE * np.sqrt((x * x).sum(axis=1)) * spread


def _deeper(leaves: DataFrame, n: int, at: int, levels: int) -> DataFrame:
    """Leaves (node, vec, s, leaf) of trees of ``at`` levels split by ``levels`` more.

    Bounds are medians of a sample of each leaf's nodes; neither they nor the sample pass through the driver.
    """
    share = max(1, (n >> at) // (LEAF_SAMPLE << levels))

    def bounds(group: pa.Table) -> pa.Table:
        ids, x, s = group["node"].to_numpy(), _matrix(group["vec"]), group["s"][0].as_py()
        leaf, out = np.zeros(len(ids), np.int64), []
        for level in range(levels):
            p = _projection(ids, x, s, at + level)
            median = np.array([np.median(p[leaf == k]) if (leaf == k).any() else 0.0 for k in range(1 << level)])
            out.append(median)
            leaf = leaf * 2 + (p > median[leaf])
        return pa.table({"s": pa.array([s], pa.int32()), "leaf": group["leaf"][:1], "bounds": pa.array([np.concatenate(out).tobytes()], pa.binary())})

    sample = leaves.where(F.pmod(F.xxhash64("node", F.lit(at)), F.lit(share)) == 0)
    made = store(sample.groupBy("s", "leaf").applyInArrow(bounds, "s int, leaf long, bounds binary"), fresh_path(leaves.sparkSession, "bounds"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, x, s, old = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            leaf = old.copy()
            packed = batch.column(4)
            for key in np.unique(np.stack((s, old)), axis=1).T:
                here = np.flatnonzero((s == key[0]) & (old == key[1]))
                cut = packed[int(here[0])].as_py()  # a leaf that no sampled node is in isn't split
                medians, inner = np.frombuffer(cut) if cut else np.zeros((1 << levels) - 1), np.zeros(len(here), np.int64)
                for level in range(levels):
                    inner = inner * 2 + (_projection(ids[here], x[here], int(key[0]), at + level) > medians[(1 << level) - 1 + inner])
                leaf[here] = (old[here] << levels) + inner
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(leaf, pa.int64())], names=["node", "vec", "s", "leaf"])

    return leaves.join(made, ["s", "leaf"], "left").select("node", "vec", "s", "leaf", "bounds").mapInArrow(run, "node long, vec binary, s int, leaf long")


def tree_leaves(nodes: DataFrame, n: int, sets: int, levels: int) -> DataFrame:
    """(node, vec, s, leaf): each node in one leaf of every set's tree of ``levels`` levels, split at medians of random projections."""
    leaves, at = nodes.select("node", "vec", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("s"), F.lit(0).cast("long").alias("leaf")), 0
    while at < levels:
        step = min(LEVELS_AT_ONCE, levels - at)
        leaves, at = _deeper(leaves, n, at, step), at + step
    return leaves


def entry_nodes(nodes: DataFrame, count: int = ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the ``count`` longest nodes and of ``count`` by a hash."""

    def lengths(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x = _matrix(batch.column(1)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x * x).sum(axis=1), pa.float64())], names=["node", "vec", "length"])

    sized = nodes.select("node", "vec").mapInArrow(lengths, "node long, vec binary, length double")
    rows = {r["node"]: np.frombuffer(r["vec"], "<f4") for order in (F.desc("length"), F.xxhash64("node")) for r in sized.orderBy(order, "node").limit(count).collect()}
    return np.array(list(rows), np.int64), np.array(list(rows.values()), np.float32)


def first_lists(leaves: DataFrame, degree: int, cell: int, levels: int, entries: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Each node's nearest nodes in its leaf of each set.

    A leaf of more than ``cell`` nodes is split on at exact medians, so a crowded direction costs no more than others.
    A node that is alone in a leaf is compared with ``entries``.
    """
    most = max(cell, 3)  # halves have two nodes at least

    def within(group: pa.Table) -> pa.Table:
        ids, x, s = group["node"].to_numpy(), _matrix(group["vec"]), group["s"][0].as_py()
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        if len(ids) == 1:
            other = entries[0] != ids[0]
            return _found_rows(np.repeat(ids, other.sum()), entries[0][other], entries[1][other] @ x[0], degree)
        owners, others, sims = [], [], []
        parts = [(np.arange(len(ids)), levels)]
        while parts:
            at, level = parts.pop()
            if len(at) > most:
                half = len(at) // 2
                split = np.argpartition(_projection(ids[at], x[at], s, level), half)
                parts += [(at[split[:half]], level + 1), (at[split[half:]], level + 1)]
                continue
            part, px = ids[at], x[at]
            k = min(degree, len(part) - 1)
            for i in range(0, len(part), 512):
                sim = px[i : i + 512] @ px.T
                rows = np.arange(len(sim))
                sim[rows, i + rows] = -np.inf
                top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                owners.append(np.repeat(part[i : i + 512], k))
                others.append(part[top].ravel())
                sims.append(np.take_along_axis(sim, top, axis=1).ravel())
        return _found_rows(np.concatenate(owners), np.concatenate(others), np.concatenate(sims), degree)

    return leaves.groupBy("s", "leaf").applyInArrow(within, FOUND)


def _merge(homes: DataFrame, found: DataFrame, parts: int, degree: int) -> DataFrame:
    """The graph of ``homes`` (node, part, vec, nbrs, sims), with the finds that are nearer in the lists."""

    def run(group: pa.Table) -> pa.Table:
        given = group.filter(group["vec"].is_valid())
        (nbrs, counts), (sims, _) = _flat(group["nbrs"], "<i8"), _flat(group["sims"], "<f4")
        owner, other, sim = _best(np.repeat(group["node"].to_numpy(), counts), nbrs, sims, degree)
        nodes = given["node"].to_numpy()
        order = np.argsort(nodes)
        sizes = np.bincount(np.searchsorted(nodes[order], owner), minlength=len(nodes))
        ends = np.cumsum(sizes)
        full = sizes >= degree
        worst = np.full(len(nodes), -np.inf, np.float32)
        worst[full] = sim[ends[full] - 1]
        given = given.take(pa.array(order))
        return pa.table({"node": given["node"], "part": given["part"], "vec": given["vec"], "nbrs": _packed(other, sizes), "sims": _packed(sim, sizes), "worst": pa.array(worst, pa.float32())})

    both = homes.select("node", "part", "vec", "nbrs", "sims").union(found.select("node", F.lit(None).cast("int"), F.lit(None).cast("binary"), "nbrs", "sims"))
    return both.withColumn("home", _part("node", parts)).groupBy("home").applyInArrow(run, GRAPH)


def _links(graph: DataFrame, reverse: int) -> DataFrame:
    """(node, part, nbrs, back): a node's list and its ``reverse`` nearest that point at it, ranked before they come together."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            (nbrs, counts), (sims, _) = _flat(batch.column(1), "<i8"), _flat(batch.column(2), "<f4")
            yield pa.RecordBatch.from_arrays([pa.array(nbrs, pa.int64()), pa.array(np.repeat(batch.column(0).to_numpy(), counts)), pa.array(sims, pa.float32())], names=["node", "nbr", "sim"])

    edges = graph.select("node", "nbrs", "sims").mapInArrow(run, "node long, nbr long, sim float")
    ranked = edges.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))).where(F.col("r") <= reverse)
    return graph.select("node", "part", "nbrs").join(ranked.groupBy("node").agg(F.collect_list("nbr").alias("back")), "node", "left")


def _link_arrays(nbrs: pa.ChunkedArray | pa.Array, back: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The ids that each row links to, once each."""
    if isinstance(back, pa.ChunkedArray):
        back = back.combine_chunks()
    flat, counts = _flat(nbrs, "<i8")
    cuts = np.concatenate(([0], np.cumsum(counts)))
    more = pc.fill_null(pc.list_value_length(back), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(more)))
    ids = back.flatten().to_numpy(zero_copy_only=False)
    return [np.unique(np.concatenate((flat[cuts[i] : cuts[i + 1]], ids[ends[i] : ends[i + 1]]))) for i in range(len(counts))]


def descend(graph: DataFrame, parts: int, degree: int, reverse: int) -> DataFrame:
    """One round of NN-descent: the pairs that meet at a pivot, where they are nearer than what a node has.

    At a pivot its list meets, and of the nodes that point at it the ``reverse`` nearest. A node takes from a pivot as
    much as its list has room for. The result is a graph.
    """
    meets = store(_links(graph, reverse), fresh_path(graph.sparkSession, "links"))

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            links = _link_arrays(batch.column(1), batch.column(2))
            pairs = np.unique(np.stack((np.repeat(batch.column(0).to_numpy(), [len(b) for b in links]), np.concatenate(links))), axis=1) if links else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int32()), pa.array(pairs[1], pa.int64())], names=["part", "u"])

    asked = meets.select("part", "nbrs", "back").mapInArrow(ask, "part int, u long").distinct()
    needed = asked.join(graph.select(F.col("node").alias("u"), "vec", "worst"), "u")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x, least = right["u"].to_numpy(), _matrix(right["vec"]), right["worst"].to_numpy()
        order = np.argsort(ids)
        ids, x, least = ids[order], x[order], least[order]
        owners, others, sims, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)], 0
        for links in _link_arrays(left["nbrs"], left["back"]):
            b = np.searchsorted(ids, links)
            s = x[b] @ x[b].T
            np.fill_diagonal(s, -np.inf)
            r, c = np.nonzero(s > least[b][:, None])
            owners.append(b[r])
            others.append(b[c])
            sims.append(s[r, c])
            held += len(r)
            if held > FINDS_TOGETHER:
                best = _best(np.concatenate(owners), np.concatenate(others), np.concatenate(sims), degree)
                (owners, others, sims), held = ([v] for v in best), 0
        return _found_rows(ids[np.concatenate(owners)], ids[np.concatenate(others)], np.concatenate(sims), degree)

    found = _fresh(meets.select("part", "nbrs", "back")).groupBy("part").cogroup(_fresh(needed).groupBy("part")).applyInArrow(run, FOUND)
    return _merge(graph, found, parts, degree)


def changed_share(old: DataFrame, new: DataFrame) -> float:
    """The share of the entries of ``new``'s lists that ``old``'s don't have."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            changed = whole = 0
            for now, was in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now, was = np.frombuffer(now, "<i8"), np.frombuffer(was or b"", "<i8")
                changed, whole = changed + len(np.setdiff1d(now, was, assume_unique=True)), whole + len(now)
            yield pa.RecordBatch.from_arrays([pa.array([changed], pa.int64()), pa.array([whole], pa.int64())], names=["changed", "whole"])

    both = new.select("node", "nbrs").join(old.select("node", F.col("nbrs").alias("was")), "node", "left").select("nbrs", "was")
    one = both.mapInArrow(run, "changed long, whole long").agg(F.sum("changed").alias("changed"), F.sum("whole").alias("whole")).first()
    return (one["changed"] or 0) / (one["whole"] or 1)


def build_graph(nodes: DataFrame, degree: int = DEGREE, reverse: int = REVERSE, rounds: int | None = None, cell: int = CELL, sets: int = CELL_SETS, together: int = PIVOTS_TOGETHER, delta: float = DELTA) -> DataFrame:
    """The graph of (node, vec): every node's ``degree`` nearest found, nearest first.

    Rounds go on until one changes less than ``delta`` of the entries, or to ``rounds`` if that is given.
    """
    spark = nodes.sparkSession
    counted = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vec")).alias("bytes")).first()
    n = counted["n"]
    cell = max(3, min(cell, CELL_BYTES // (counted["bytes"] or 1)))
    levels = max(0, math.ceil(math.log2(max(1, n) / cell)))
    deep = max(levels, math.ceil(math.log2(max(LEAST_PARTS, n / together))))
    parts = 1 << deep
    entries = entry_nodes(nodes)
    leaves = store(tree_leaves(nodes, n, sets, levels), fresh_path(spark, "leaves"))
    homes = leaves.where("s = 0").select("node", "vec", "s", "leaf")
    homes = (_deeper(homes, n, levels, deep - levels) if deep > levels else homes).select("node", F.col("leaf").cast("int").alias("part"), "vec", F.expr("X''").alias("nbrs"), F.expr("X''").alias("sims"))
    path = fresh_path(spark, "graph")
    graph = store(_merge(homes, first_lists(leaves, degree, cell, levels, entries), parts, degree), path)
    share, k = 1.0, 0
    while k < rounds if rounds is not None else share >= delta:
        following = fresh_path(spark, "graph")
        better = store(descend(graph, parts, degree, reverse), following)
        share, k = changed_share(graph, better), k + 1
        remove(spark, path)
        graph, path = better, following
    return graph


STATE = "q long, vec binary, nodes binary, sims binary, followed binary, next array<long>"


def greedy_search(queries: DataFrame, graph: DataFrame, entries: np.ndarray, beam: int = BEAM, follow: int = FOLLOW, reverse: int = REVERSE, together: int = QUERIES_TOGETHER, keep: int = 64) -> DataFrame:
    """(q, node): the best ``keep`` nodes found for each query node, itself included.

    A search starts from its own node's list and from a few nodes that are the same for all, so that a part
    of the graph to which no way leads from the query's can be entered.
    ``queries`` has a column q of nodes. A round follows each query's nearest ``follow`` nodes among its best
    ``beam`` that haven't been followed; a query of which all have is done and leaves the rounds, which end with the
    last. Nodes that fell out of a beam can't come back, as what it takes only rises, so none need be remembered.
    """
    spark = queries.sparkSession

    def join_links(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            links = _link_arrays(batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in links], pa.binary())], names=["node", "links"])

    links = store(_links(graph, reverse).select("node", "nbrs", "back").mapInArrow(join_links, "node long, links binary"), fresh_path(spark, "links"))
    vectors = graph.select("node", "vec")
    parts = max(LEAST_QUERY_PARTS, math.ceil(queries.count() / together))
    none = F.lit(None).cast("binary")
    state = queries.join(vectors.withColumnRenamed("node", "q"), "q").select("q", "vec", none.alias("nodes"), none.alias("sims"), none.alias("followed"), F.array("q").alias("next"))
    common = np.unique(entries)

    def reach(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            flat, counts = _flat(batch.column(1), "<i8")
            part = batch.column(0).to_numpy()
            pairs = np.stack((np.concatenate((np.repeat(part, counts), np.repeat(np.unique(part), len(common)))), np.concatenate((flat, np.tile(common, len(np.unique(part)))))))
            pairs = np.unique(pairs, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int32()), pa.array(pairs[1], pa.int64())], names=["part", "node"])

    def run(states: pa.Table, data: pa.Table) -> pa.Table:
        is_vector = data["vec"].is_valid()
        listed, near = data.filter(pc.invert(is_vector)), data.filter(is_vector)
        met, counts = _flat(listed["links"], "<i8")
        ends = np.concatenate(([0], np.cumsum(counts)))
        spans = {v: (ends[i], ends[i + 1]) for i, v in enumerate(listed["node"].to_pylist())}
        ids, x = near["node"].to_numpy(), _matrix(near["vec"])
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        out: dict[str, list] = {c: [] for c in ("q", "vec", "nodes", "sims", "followed", "next")}
        for row in states.to_pylist():
            q, first = row["q"], row["nodes"] is None
            held = np.array([q]) if first else np.frombuffer(row["nodes"], np.int64)
            sims = np.array([np.inf]) if first else np.frombuffer(row["sims"], np.float64)
            followed = np.zeros(1, bool) if first else np.frombuffer(row["followed"], bool)
            asked = np.array(row["next"], dtype=np.int64)
            followed = followed | np.isin(held, asked)
            found = [met[slice(*spans[v])] for v in asked.tolist() if v in spans] + [common] * first
            new = np.setdiff1d(np.concatenate(found), held) if found else np.empty(0, np.int64)
            if len(new):
                s = x[np.searchsorted(ids, new)].astype(np.float64) @ np.frombuffer(row["vec"], "<f4").astype(np.float64)
                held, sims, followed = np.concatenate((held, new)), np.concatenate((sims, s)), np.concatenate((followed, np.zeros(len(new), bool)))
                best = np.lexsort((held, -sims))[:beam]
                held, sims, followed = held[best], sims[best], followed[best]
            for c, v in zip(out, (q, row["vec"], held.astype(np.int64).tobytes(), sims.tobytes(), followed.tobytes(), held[~followed][:follow].tolist()), strict=True):
                out[c].append(v)
        return pa.table(out, schema=pa.schema([("q", pa.int64()), *[(c, pa.binary()) for c in ("vec", "nodes", "sims", "followed")], ("next", pa.list_(pa.int64()))]))

    done: list[DataFrame] = []
    while True:
        state = state.withColumn("part", _part("q", parts))
        asked = state.select("part", F.explode("next").alias("node")).distinct()
        lists = store(asked.join(links, "node").select("part", "node", "links"), fresh_path(spark, "lists"))
        near = lists.select("part", "links").mapInArrow(reach, "part int, node long").distinct().join(vectors, "node")
        right = lists.select("part", "node", "links", none.alias("vec")).union(near.select("part", "node", none.alias("links"), "vec"))
        moved = store(_fresh(state).groupBy("part").cogroup(_fresh(right).groupBy("part")).applyInArrow(run, STATE), fresh_path(spark, "beams"))
        done.append(moved.where(F.size("next") == 0).select("q", "nodes"))
        state = moved.where(F.size("next") > 0)
        if state.isEmpty():
            break
    found = done[0]
    for d in done[1:]:
        found = found.union(d)

    def spell(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            best = [np.frombuffer(b, np.int64)[:keep] for b in batch.column(1).to_pylist()]
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(b) for b in best])), pa.array(np.concatenate(best))], names=["q", "node"])

    return found.mapInArrow(spell, "q long, node long")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **options: float) -> DataFrame:
    """(query_id, rank, ``id_col``, score): each query's ``k`` nearest other rows by inner product.

    Queries are the rows whose id is divisible by ``every``. Scores are sums in double precision over the
    original components in order; ties go to the smaller id. Rows with a null id or a vector that is
    null, empty, zero or holds nulls or non-finite values take no part. Vectors are searched among those of their own length; an id with
    rows of several lengths counts with its longest, and of rows with equal ids one counts (see :func:`sound_vectors`). Copies of a vector are
    one node, of which the ``k + 1`` smallest ids can be results; no table row is lost by this, as no list has room for more. An empty
    table gives no rows. Further columns are ignored.

    ``options``: degree, reverse, rounds, cell, sets and delta for the graph, beam and follow for the search.
    """
    lengths = vector_lengths(vectors, id_col, vector_col)
    rows = vectors.select(id_col, vector_col)
    if len(lengths) > 1:
        longest = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.size(vector_col)).alias("__size"))
        rows = rows.join(longest, (F.col(id_col) == F.col("__id")) & (F.size(vector_col) == F.col("__size"))).select(id_col, vector_col)
    found = [_nearest_of(rows, dim, every, k, id_col, vector_col, options) for dim in lengths or [1]]
    whole = found[0]
    for other in found[1:]:
        whole = whole.unionByName(other)
    return whole


def _nearest_of(vectors: DataFrame, dim: int, every: int, k: int, id_col: str, vector_col: str, options: dict) -> DataFrame:
    """:func:`nearest` for the vectors of one length."""
    spark = vectors.sparkSession
    sound = store(sound_vectors(vectors, id_col, vector_col, dim), fresh_path(spark, "sound"))
    nodes, members = distinct_vectors(sound, k + 1)
    nodes, members = store(nodes, fresh_path(spark, "nodes")), store(members, fresh_path(spark, "members"))
    graph_options = {o: options[o] for o in ("degree", "reverse", "rounds", "cell", "sets", "delta") if o in options}
    search_options = {o: options[o] for o in ("beam", "follow", "reverse") if o in options}

    firsts = members.where("vec_id = node").select("print", "node")
    query_nodes = store(sound.where(F.col("vec_id") % every == 0).join(firsts, "print").select(F.col("vec_id").alias("query_id"), "node"), fresh_path(spark, "asked"))
    graph = build_graph(nodes, **graph_options)
    found = store(greedy_search(query_nodes.select(F.col("node").alias("q")).distinct(), graph, entry_nodes(nodes)[0], keep=2 * k + 1, **search_options), fresh_path(spark, "found"))
    pairs = query_nodes.join(found.select(F.col("q").alias("query_node"), F.col("node").alias("hit")), F.col("node") == F.col("query_node")).select("query_id", "hit")

    def product(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x, y = (_flat(batch.column(i), "<f8")[0].reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0)) for i in (2, 3))
            total = np.zeros(batch.num_rows)
            for i in range(x.shape[1]):  # one component after the other, as a plain sum goes
                total += x[:, i] * y[:, i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.float64())], names=["query_id", "hit", "score"])

    both = pairs.join(sound.select(F.col("vec_id").alias("hit"), F.col("exact").alias("y")), "hit").join(sound.select(F.col("vec_id").alias("query_id"), F.col("exact").alias("x")), "query_id")
    scored = both.select("query_id", "hit", "x", "y").mapInArrow(product, "query_id long, hit long, score double")
    expanded = scored.join(members.select(F.col("node").alias("hit"), "vec_id"), "hit").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return expanded.select("query_id", rank.alias("rank"), F.col("vec_id").alias(id_col), "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))

"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, best bin first.

The tree is fitted on at most FIT_ROWS vectors, picked by hash, with as many leaves as give LEAF_ROWS vectors of the
whole table to a leaf; then every vector is filed under its leaf. A query walks the tree through a priority queue,
always opening the node whose centre has the largest inner product with it, and so has an order of leaves. How many
leaves it visits is calibrated: for CALIBRATION_QUERIES vectors the true neighbours are found against the whole table,
and visits are widened until the recall over these reaches RECALL. Neighbouring leaves lie in one block of at most
BLOCK_ROWS vectors, queries meet the blocks of the leaves they visit in a join, and each block gives a query its best;
inner products are taken in double precision over the original vectors.

Equal vectors are one entry of the tree with their TOP + 1 least ids, which is all of them that any answer can hold, so
a vector that a third of the rows share is one entry. Large leaves, and the queries of a crowded block, are dealt in
chunks, so that no task holds more than BLOCK_ROWS vectors and CHUNK queries or so.
The tree is what is broadcast: at most FIT_ROWS centres, whatever the table holds.

Whatever the calibrated number, a query goes on until the leaves visited hold enough candidates for a whole answer.

Defined results: vectors that are null, zero, or hold null or non-finite parts take no part; vectors of one length are
searched among themselves, as others have no inner product with them, by a tree for each length; elements may be of any
number type, and are kept in double precision unless they are floats; ties go to the smaller vec_id; a vec_id with
several vectors is one candidate, by the nearest of them, and asks with the least; a row without a vec_id takes no part;
with fewer than TOP candidates all are given; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalane.llm.common import shipped
from stratalane.session import written

TOP = 20
FIT_ROWS = 40_000
LEAF_ROWS = 150
BRANCH = 10
RECALL = 0.94
CALIBRATION_QUERIES = 96
BLOCK_ROWS = 4096
CHUNK = 4096


class Tree:
    """Nodes by number, 0 the root; a leaf has no children."""

    def __init__(self, sample: np.ndarray, leaf: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.children: list[np.ndarray] = []
        self.centres: list[np.ndarray] = []
        self._grow(sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1]), sample, leaf, rng)
        self.centre = np.stack(self.centres)
        self.leaves = [i for i, c in enumerate(self.children) if not len(c)]

    def _grow(self, centre: np.ndarray, rows: np.ndarray, leaf: float, rng) -> int:
        me = len(self.children)
        self.children.append(np.zeros(0, dtype=np.int64))
        self.centres.append(centre)
        if len(rows) > max(leaf, 1):
            centres, of = _kmeans(rows, min(BRANCH, int(np.ceil(len(rows) / max(leaf, 1)))), rng)
            if len(centres) > 1:
                self.children[me] = np.array([self._grow(c, rows[of == i], leaf, rng) for i, c in enumerate(centres)])
        return me

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), dtype=np.int64)
        todo = {0: np.arange(len(rows))}
        while todo:
            node, own = todo.popitem()
            below = self.children[node]
            if not len(below):
                at[own] = node
                continue
            c = self.centre[below]
            nearest = (rows[own] @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
            todo |= {int(below[i]): own[nearest == i] for i in np.unique(nearest)}
        return at

    def best_first(self, query: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """Leaves in the order of visiting: `most` of them, or more until their sizes come to `least`."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held < least):
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not len(below):
                out.append(node)
                held += sizes.get(node, 0) if sizes else 0
                continue
            for score, child in zip((self.centre[below] @ query).tolist(), below.tolist()):
                heapq.heappush(queue, (-score, child))
        return out


def _kmeans(rows: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    centres = np.unique(centres, axis=0)
    for _ in range(rounds):
        of = (rows @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
        used, of = np.unique(of, return_inverse=True)
        counts = np.bincount(of)
        centres = np.stack([np.bincount(of, rows[:, d]) for d in range(rows.shape[1])], axis=1) / counts[:, None]
    of = (rows @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
    used, of = np.unique(of, return_inverse=True)
    return centres[used], of


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def inner(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so that equal vectors get equal values wherever they lie."""
    return (rows * query).sum(axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part; embeddings are arrays of floats if they were, else of doubles."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    v = F.col("embedding")
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & ok)


def nearest(vectors: DataFrame, is_query, top: int = TOP, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query picks, its nearest other rows found."""
    rows = usable(vectors)
    widths = sorted(r.n for r in rows.select(F.size("embedding").alias("n")).distinct().collect())
    found = [_nearest(rows.where(F.size("embedding") == w) if len(widths) > 1 else rows, w, is_query, top, recall) for w in widths]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if len(found) < 2:
        return found[0] if found else empty
    # A vec_id that has vectors of several lengths asks with the least of them all, as it does within one length.
    asks = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min_by(F.size("embedding"), F.col("embedding")).alias("w"))
    return reduce(DataFrame.unionByName, (f.join(asks.where(F.col("w") == w).select("query_id"), "query_id", "left_semi") for w, f in zip(widths, found)))


def _nearest(rows: DataFrame, width: int, is_query, top: int, recall: float) -> DataFrame:
    spark, kind = rows.sparkSession, rows.schema["embedding"].dataType.simpleString()
    order = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    least = rows.distinct().withColumn("r", order).where(F.col("r") <= top + 1)
    entries = written(least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    n = entries.count()
    place = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30))
    share = lambda k: place < int(min(1.0, k / n) * (1 << 30)) + (k >= n)
    sample = _matrix(entries.where(share(FIT_ROWS)).limit(2 * FIT_ROWS).select("embedding").toArrow().column(0).combine_chunks(), width)
    tree = Tree(sample, LEAF_ROWS * len(sample) / n)
    planted = shipped(spark, "tree", tree)

    def file(batches):
        for batch in batches:
            leaf = planted().leaf_of(_matrix(batch.column("embedding"), width))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", *batch.schema.names])

    filed = written(entries.mapInArrow(file, f"leaf long, embedding {kind}, ids array<bigint>"), "filed")
    visits = _calibrated(filed, tree, width, top, recall, n)
    # Neighbouring leaves share a block; a leaf larger than a block has several of its own. No more rows than leaves.
    counted = filed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()
    blocks, held = _blocks({r.leaf: r.n for r in counted}, tree.leaves), {r.leaf: r.ids for r in counted}
    enough = (top + 1) * rows_of_one_id(rows)
    placed = spark.createDataFrame([(leaf, *b) for leaf, b in blocks.items()], "leaf long, first int, number int")
    block = (F.col("first") + F.pmod(F.xxhash64("embedding"), "number")).cast("int")
    filed = filed.join(F.broadcast(placed), "leaf").select(block.alias("block"), "leaf", "embedding", "ids")

    def walk(batches):
        for batch in batches:
            at, visited = [], []
            for i, q in enumerate(_matrix(batch.column("embedding"), width)):
                by_block: dict[int, list[int]] = {}
                for leaf in planted().best_first(q, visits, held, enough):
                    first, number = blocks.get(leaf, (0, 0))
                    for k in range(first, first + number):
                        by_block.setdefault(k, []).append(leaf)
                at += [i] * len(by_block)
                visited += by_block.items()
            at = pa.array(at, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in visited], type=pa.int32()), pa.array([x for _, x in visited], type=pa.list_(pa.int64())), batch.column("vec_id").take(at), batch.column("embedding").take(at)],
                names=["block", "leaves", "query_id", "query"],
            )

    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    spread = queries.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "vec_id")
    asked = written(spread.mapInArrow(walk, f"block int, leaves array<bigint>, query_id long, query {kind}"), "visits")
    # A block that more than CHUNK queries visit meets them in chunks.
    chunks = asked.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    left = filed.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    right = asked.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int")).drop("chunks")
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(
        lambda _, mine, theirs: _matched(mine, theirs, width, top), "query_id long, best array<struct<i:bigint,s:double>>"
    )
    # Sorted by id, then score: of the places that an id has, the first is the nearest. Bound once, as the lambda looks back.
    first = lambda a: F.filter(a, lambda x, k: F.coalesce(F.get(a, k - 1)["i"] != x["i"], F.lit(True)))
    once = F.get(F.transform(F.array(F.array_sort(F.flatten(F.collect_list("best")))), first), F.lit(0))
    near = F.slice(F.array_sort(F.transform(once, lambda x: F.struct(x["s"].alias("s"), x["i"].alias("i")))), 1, top)
    best = found.groupBy("query_id").agg(near.alias("best"))
    return best.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score"))


def rows_of_one_id(rows: DataFrame) -> int:
    """How many different vectors a vec_id has at most."""
    return rows.groupBy("vec_id").agg(F.count_distinct(F.xxhash64("embedding")).alias("n")).agg(F.max("n").alias("n")).first().n


def _blocks(sizes: dict[int, int], leaves: list[int], most: int = BLOCK_ROWS) -> dict[int, tuple[int, int]]:
    """Each leaf's first block and number of blocks."""
    out, block, held = {}, -1, most
    for leaf in leaves:
        if size := sizes.get(leaf, 0):
            if size > most:
                number = -(-size // most)
                out[leaf], block, held = (block + 1, number), block + number, most
                continue
            if held + size > most:
                block, held = block + 1, 0
            held += size
            out[leaf] = block, 1
    return out


def _matched(entries: pa.Table, asked: pa.Table, width: int, top: int) -> pa.Table:
    """The best entries of one block for each query, among those in the leaves that the query visits."""
    kind = pa.list_(pa.struct([("i", pa.int64()), ("s", pa.float64())]))
    found: list[tuple[int, list]] = []
    if entries.num_rows and asked.num_rows:
        ids, body = entries.column("ids").to_pylist(), _matrix(entries.column("embedding").combine_chunks(), width)
        numbers, leaf_of = np.unique(entries.column("leaf").to_numpy(), return_inverse=True)
        every = [x for some in ids for x in some]
        # As many entries as may be needed for top ids besides the query's own; an id may stand in several.
        most = top + 1 + len(every) - len(set(every))
        for at in range(0, asked.num_rows, 256):
            part = asked.slice(at, 256)
            queries = _matrix(part.column("query").combine_chunks(), width)
            open_ = np.stack([np.isin(numbers, leaves) for leaves in part.column("leaves").to_pylist()])
            rough = np.where(open_[:, leaf_of], queries @ body.T, -np.inf)
            cut = np.partition(rough, -most, axis=1)[:, -most] if len(body) > most else np.full(len(queries), -np.inf)
            # A matrix product rounds by its shape, so what it puts near the cut is measured again.
            slack = 1e-9 * np.abs(queries).sum(axis=1) * np.abs(body).max()
            for query_id, q, row, least in zip(part.column("query_id").to_pylist(), queries, rough, cut - slack):
                near = np.flatnonzero((row >= least) & (row > -np.inf))
                best: dict[int, float] = {}
                for s, x in sorted((-s, x) for s, k in zip(inner(q, body[near]).tolist(), near.tolist()) for x in ids[k] if x != query_id):
                    best.setdefault(x, s)
                    if len(best) == top:
                        break
                found.append((query_id, [{"i": x, "s": s} for x, s in best.items()]))
    return pa.table([pa.array([q for q, _ in found], type=pa.int64()), pa.array([b for _, b in found], type=kind)], names=["query_id", "best"])


def _calibrated(filed: DataFrame, tree: Tree, width: int, top: int, recall: float, n: int) -> int:
    """Leaf visits with which the calibration queries find `recall` of their true neighbours among the entries."""
    place = F.pmod(F.xxhash64("embedding", F.lit("calibration")), F.lit(1 << 30))
    cut = int(min(1.0, 2 * CALIBRATION_QUERIES / n) * (1 << 30)) + 1
    asked = np.array([r.embedding for r in filed.where(place < cut).select("embedding").limit(CALIBRATION_QUERIES).collect()], dtype=np.float64).reshape(-1, width)
    if not len(asked):
        return len(tree.leaves)

    def run(batches):
        held = np.zeros((len(asked), 0)), np.zeros((len(asked), 0), dtype=np.int64)
        for batch in batches:
            score = np.concatenate([held[0], asked @ _matrix(batch.column("embedding"), width).T], axis=1)
            leaf = np.concatenate([held[1], np.tile(batch.column("leaf").to_numpy(), (len(asked), 1))], axis=1)
            keep = np.argsort(-score, axis=1, kind="stable")[:, : top + 1]
            held = np.take_along_axis(score, keep, axis=1), np.take_along_axis(leaf, keep, axis=1)
        q = np.repeat(np.arange(len(asked)), held[0].shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(held[0].ravel()), pa.array(held[1].ravel())], names=["q", "score", "leaf"])

    ranked = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    true = filed.select("leaf", "embedding").mapInArrow(run, "q long, score double, leaf long").withColumn("r", ranked).where(F.col("r") <= top + 1)
    place_of, misses = [{leaf: i for i, leaf in enumerate(tree.best_first(q, len(tree.leaves)))} for q in asked], []
    for r in true.collect():  # CALIBRATION_QUERIES times TOP + 1 rows; the first of a query is itself
        if r.r > 1:
            misses.append(place_of[r.q][r.leaf])
    if not misses:
        return len(tree.leaves)
    return int(np.sort(misses)[min(len(misses) - 1, int(np.ceil(recall * len(misses))) - 1)]) + 1

"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distance, connected classes.

Fingerprints are cut into six blocks. Two that differ in at most three bits agree in at least three blocks, so each
fingerprint is filed under its twenty triples of blocks, about 32 bits a key, and compared only with those filed under
the same key. Equal fingerprints are one node throughout, however many documents hold them, so groups of exact copies
cost nothing. Of what is compared under one key only a spanning forest of the links is emitted, which keeps output in
proportion to the input and loses no class. Keys that hold more than CHUNK fingerprints are dealt to pairs of chunks,
so no task ever holds more than two chunks of one key.

Defined results: null and empty texts have fingerprint zero and are linked like any other; equal rows share a class;
texts are read whole at any length; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalane.llm.common import text_slices
from stratalane.session import dropped, written

BLOCKS = (11, 11, 11, 11, 10, 10)
NEAR_BITS = 3
SHINGLE = 3
CHUNK = 4096


def _masks() -> list[int]:
    edges = np.concatenate([[0], np.cumsum(BLOCKS)])
    block = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(block[i] for i in some) for some in combinations(range(len(BLOCKS)), len(BLOCKS) - NEAR_BITS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is one if it is set in over half of the shingles' hashes, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxh64_intdigest(x, 42) for x in parts), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 255 * 256):
        ones = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(ones) // 255 * 255  # sums of 255 ones fit a byte
        counts += ones[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + ones[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): one row per row of docs."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                bodies = part.column("text").cast(pa.large_binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([_signed(fingerprint(x, shingle)) for x in bodies], type=pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and for each of them the least node of its class."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = both[: len(a)], both[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _linked(key: np.ndarray, fp: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among rows of equal key; rows come sorted by key."""
    run = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    left, right, d = [], [], 1
    at = np.arange(len(key) - 1)
    ends = np.searchsorted(run, run, side="right")
    while len(at := at[at + d < ends[at]]):
        hit = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= near]
        if len(hit):
            left.append(hit)
            right.append(hit + d)
        d += 1
        if len(left) >= 64:  # what is held stays in proportion to the rows
            nodes, root = _forest(np.concatenate(left), np.concatenate(right))
            other = nodes != root
            left, right = [root[other]], [nodes[other]]
    if not left:
        return fp[:0], fp[:0]
    nodes, root = _forest(np.concatenate(left), np.concatenate(right))
    other = nodes != root
    return fp[nodes[other]], fp[root[other]]


def near_links(nodes: DataFrame, near: int = NEAR_BITS, chunk: int = CHUNK) -> DataFrame:
    """(a long, b long): links between the distinct fingerprints `fp` of nodes that join up every class."""
    masks = F.array(*(F.lit(_signed(m)) for m in _masks()))
    filed = nodes.select("fp", F.posexplode(masks).alias("band", "mask")).select("fp", "band", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    crowded = filed.groupBy("band", "key").count().where(F.col("count") > chunk)
    crowded = crowded.select("band", "key", F.ceil(F.col("count") / chunk * 2).cast("int").alias("chunks"))
    own = F.when(F.col("chunks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    others = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = filed.join(crowded, ["band", "key"], "left").withColumn("own", own).select("fp", "band", "key", "own", F.explode(others).alias("other"))
    dealt = dealt.select("fp", F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))

    def run(batches):
        keys, fps, held = [], [], 0

        def flush(more: bool):
            nonlocal keys, fps, held
            key, fp = np.concatenate(keys), np.concatenate(fps)
            cut = int(np.searchsorted(key, key[-1])) if more else len(key)
            out = _linked(key[:cut], fp[:cut], near) if cut > 1 else (fp[:0], fp[:0])
            keys, fps, held = [key[cut:]], [fp[cut:]], len(key) - cut
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in out], names=["a", "b"])

        for batch in batches:
            keys.append(batch.column("key").to_numpy(zero_copy_only=False))
            fps.append(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            held += batch.num_rows
            if held >= 100_000:
                yield flush(True)
        if held:
            yield flush(False)

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def classes(links: DataFrame) -> DataFrame:
    """(node long, root long) for every node of links; root is the least node of its class.

    Each round hangs every node on its least neighbour below it, follows these to the roots, and goes on with the links
    between roots; at least half of what is still linked goes each round. All of it is joins and sums over tables.
    """
    done: DataFrame | None = None
    left = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not left.isEmpty():
        up = table = written(left.groupBy("a").agg(F.min("b").alias("b")), "parents")
        while True:
            over = up.select(F.col("a").alias("m"), F.col("b").alias("r"))
            jumped = written(up.join(over, F.col("b") == F.col("m"), "left").select("a", F.coalesce("r", "b").alias("b"), F.col("r").isNotNull().alias("moved")), "parents")
            dropped(table)
            table, up = jumped, jumped.select("a", "b")
            if jumped.where("moved").isEmpty():
                break
        root = lambda df, c: df.join(up.select(F.col("a").alias("m"), F.col("b").alias("r")), F.col(c) == F.col("m"), "left").withColumn(c, F.coalesce("r", c)).drop("m", "r")
        if done is None:
            done = up.select(F.col("a").alias("node"), F.col("b").alias("root"))
        else:
            done = written(root(done, "root").unionByName(up.select(F.col("a").alias("node"), F.col("b").alias("root")).join(done.select("node"), "node", "left_anti")), "classes")
        moved = root(root(left, "a"), "b").where("a != b")
        over = left
        left = written(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        dropped(over)
    if done is None:
        return links.sparkSession.createDataFrame([], "node long, root long")
    return done


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the least doc_id that links lead to."""
    fps = written(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = classes(near_links(nodes))
    of = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = of.select("fp", "root").join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the least doc_id; of rows that share even that, one (any of equal texts).

    Documents without a doc_id can't be named as copies of any other, and stay.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.where("doc_id IS NOT NULL")
    # Ids of most documents outgrow any broadcast; planned as a merge join, small inputs take the way of large ones.
    kept = written(near_duplicates(named).where("doc_id = component_id").groupBy("doc_id").count(), "kept").hint("merge")
    once = named.join(kept.where("count = 1").select("doc_id"), "doc_id", "left_semi").select(own)
    rank = next(n for n in map("__rank{}".format, range(len(own) + 1)) if n not in docs.columns)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    tied = named.join(kept.where("count > 1").select("doc_id"), "doc_id", "left_semi").withColumn(rank, order).where(F.col(rank) == 1).select(own)
    return once.unionByName(tied).unionByName(docs.where("doc_id IS NULL"))

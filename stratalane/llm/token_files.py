"""Token ids as Arrow files of fixed-size lists, for zero-copy random access to equal-length sequences and their masks.

A part of the corpus is one Arrow file whose every record batch holds `BATCH` sequences (the last one fewer) of two
fixed-size-list columns: ids (of 16 bits where the vocabulary allows) and a mask of bits, unset on the padding of the
last sequence. Sequence k is row k % BATCH of
batch k // BATCH, so a memory-mapped reader finds it without reading anything else. A second file lists the documents:
where each begins among the part's ids and how many it has. Parts are written by the executors straight into the shared
folder; a manifest written by Spark names the file of the attempt that won, so that retried or speculative tasks leave
at worst an unread file, and the totals in it give each part its place in the whole corpus.

Texts are encoded where they lie, and only ids are shuffled and sorted, by stretches of keys that a sample of SAMPLE keys a
part divides; keys are doc_id, length and hash of a text, so a doc_id that many rows share is spread over files like any
other. A part holds the ids of about FILE_TEXT bytes of text at most, so the number of files grows with the corpus.

Defined results: a null text counts as empty (its document is its end id alone); a null doc_id comes first; rows of one
doc_id are laid down by length of their text in bytes, then by its hash; texts are written whole at any length; an empty table gives a manifest without rows; other columns of the
input are not read.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalane.llm.common import text_slices, worker_state
from stratalane.llm.tokens import SLICE, WordEncoder, default_tokenizer
from stratalane.session import fresh_path, passing, written

LENGTH = 2048
BATCH = 64
END = 1
FILE_TEXT = 256 << 20
SAMPLE = 100
MANIFEST = "part long, file string, n_docs long, n_tokens long"


def _fixed(flat: np.ndarray, length: int) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(pa.array(flat), length)


class SequenceWriter:
    """Writes a stream of ids as sequences of equal length; holds one record batch at a time."""

    def __init__(self, sink, length: int = LENGTH, batch: int = BATCH, ids=np.uint32):
        self.length, self.batch, self.held, self.n, self.ids = length, batch, [], 0, ids
        schema = pa.schema([pa.field("ids", pa.list_(pa.from_numpy_dtype(ids), length)), pa.field("mask", pa.list_(pa.bool_(), length))])
        self.out, self.schema = pa.ipc.new_file(sink, schema), schema

    def write(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.ids, copy=False))
        self.n += len(ids)
        size = self.length * self.batch
        if self.n >= size:
            flat = np.concatenate(self.held)
            whole = len(flat) // size * size
            for at in range(0, whole, size):
                self._put(flat[at : at + size], np.ones(size, dtype=bool))
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def _put(self, flat: np.ndarray, mask: np.ndarray) -> None:
        self.out.write_batch(pa.record_batch([_fixed(flat, self.length), _fixed(mask, self.length)], schema=self.schema))

    def close(self) -> None:
        if self.n:
            pad = -self.n % self.length
            self._put(np.concatenate([*self.held, np.zeros(pad, dtype=self.ids)]), np.repeat([True, False], [self.n, pad]))
        self.out.close()


class SequenceFile:
    """Random access to the sequences of a file, without copies where the file can be memory-mapped."""

    def __init__(self, uri: str, batch: int = BATCH):
        store, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.reader, self.batch = pa.ipc.open_file(self.source), batch
        self.length = self.reader.schema.field("ids").type.list_size
        self.at, self.current = -1, None

    def _of(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.current = k, self.reader.get_batch(k)
        return self.current

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids and mask of sequence k, as views of the file."""
        got, row = self._of(k // self.batch), k % self.batch
        ids, mask = (got.column(c).values.slice(row * self.length, self.length) for c in ("ids", "mask"))
        return ids.to_numpy(), mask

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the file."""
        size, parts = self.length * self.batch, []
        while n > 0:
            k, at = divmod(start, size)
            took = min(n, size - at)
            parts.append(self._of(k).column("ids").values.to_numpy()[at : at + took])
            start, n = start + took, n - took
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, dtype=np.uint32)])

    def close(self) -> None:
        self.source.close()


DOC_COLUMNS = ("doc_id", "start", "n_tokens")


def _width(encoder: WordEncoder, end: int):
    return np.dtype("<u2" if max(encoder.largest, end) < 1 << 16 else "<u4")


ORDER = ("doc_id", "size", "hash")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("hash"), "text")


def _place(key: tuple) -> tuple:
    """A key of ORDER in a form that compares, nulls first."""
    return (key[0] is not None, *key) if key[0] is not None else (False, 0, *key[1:])


def _bounds(keyed: DataFrame, parts: int) -> list[tuple]:
    """Keys that divide the rows in about equal parts by size, from a sample of SAMPLE keys a part."""
    keys = keyed.select(*ORDER)
    taken = keys.sample(min(1.0, SAMPLE * parts / max(1, keys.count())), seed=11).limit(2 * SAMPLE * parts).collect()
    found = sorted((_place(tuple(r)), r["size"] + 64) for r in taken)
    run, total = 0, sum(n for _, n in found)
    out = []
    for key, n in found:
        if run * parts >= total * (len(out) + 1):
            out.append(key)
        run += n
    return out


def _part(bounds: list[tuple], key: tuple, turn: int) -> int:
    """The part of a key; rows equal in a key that bounds several parts take turns among these."""
    low, high = bisect_left(bounds, key), bisect_right(bounds, key)
    return low + turn % (high - low + 1)


def _encoded(keyed: DataFrame, path: str, end: int, bounds: list[tuple]) -> DataFrame:
    """(part, doc_id, size, hash, n_tokens, ids): what is shuffled and sorted afterwards is ids, a fraction of the text."""

    def run(batches):
        encoder = worker_state(f"words:{path}", lambda: WordEncoder(path))
        kind = _width(encoder, end)
        for batch in batches:
            for piece in text_slices(batch, "text", SLICE):
                ids, ends = encoder.encode(piece.column("text"))
                flat = np.insert(ids.astype(kind), ends[1:], end)
                counts = np.diff(ends) + 1
                places = np.concatenate([[0], np.cumsum(counts)])
                body = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(places * kind.itemsize), pa.py_buffer(flat)])
                keys = [piece.column(c) for c in ORDER]
                part = [_part(bounds, _place(k), i) for i, k in enumerate(zip(*(c.to_pylist() for c in keys)))]
                yield pa.RecordBatch.from_arrays([pa.array(part, type=pa.int32()), *keys, pa.array(counts), body.cast(pa.binary())], names=["part", *ORDER, "n_tokens", "ids"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"part int, doc_id {kind}, size long, hash long, n_tokens long, ids binary")


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end: int = END, length: int = LENGTH) -> DataFrame:
    """Writes the ids of docs in ascending doc_id order; returns the manifest, one row a file in that order."""
    spark, own = docs.sparkSession, folder is None
    path, folder = tokenizer or default_tokenizer(), (folder or fresh_path(spark, "tokens")).rstrip("/")
    folder = folder if ":" in folder.split("/")[0] else f"file://{folder}"
    kind = np.dtype(_width(WordEncoder(path), end))

    def run(batches):
        part, ids_out, n_docs, n_tokens = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = pa.schema(zip(DOC_COLUMNS, (batch.schema.field("doc_id").type, pa.int64(), pa.int64())))
            if ids_out is None:
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                store, at = fs.FileSystem.from_uri(folder)
                store.create_dir(at, recursive=True)
                sinks = [store.open_output_stream(f"{at}/{name}.{x}") for x in ("ids", "docs")]
                ids_out, docs_out = SequenceWriter(sinks[0], length, ids=kind.type), pa.ipc.new_file(sinks[1], schema)
            counts = batch.column("n_tokens").to_numpy()
            starts = n_tokens + np.cumsum(counts) - counts
            docs_out.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(starts), pa.array(counts)], schema=schema))
            for body in batch.column("ids"):
                ids_out.write(np.frombuffer(body.as_buffer(), dtype=kind))
            n_docs, n_tokens = n_docs + len(counts), n_tokens + int(counts.sum())
        if ids_out is not None:
            for x in (ids_out, docs_out, *sinks):
                x.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{folder}/{name}"]), pa.array([n_docs]), pa.array([n_tokens])], names=["part", "file", "n_docs", "n_tokens"])

    keyed = _keyed(docs)
    size = keyed.agg(F.sum("size").alias("n")).first().n or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_TEXT))
    dealt = _encoded(keyed, path, end, _bounds(keyed, parts)).repartitionById(parts, "part")
    manifest = written(dealt.sortWithinPartitions(*ORDER).select("doc_id", "n_tokens", "ids").mapInArrow(run, MANIFEST), "manifest")
    if own and not manifest.isEmpty():
        passing(spark, folder)
    return manifest


def read_documents(manifest: DataFrame, doc_kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; start counts from the first file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                store, at = fs.FileSystem.from_uri(f"{name}.docs")
                held = SequenceFile(f"{name}.ids")
                with store.open_input_file(at) as source:
                    reader = pa.ipc.open_file(source)
                    for k in range(reader.num_record_batches):
                        listed = reader.get_batch(k)
                        start, n = listed.column("start").to_numpy(), listed.column("n_tokens").to_numpy()
                        crc = [zlib.crc32(held.tokens(a, b).astype("<u4", copy=False)) for a, b in zip(start.tolist(), n.tolist())]
                        yield pa.RecordBatch.from_arrays([listed.column("doc_id"), pa.array(start + base), listed.column("n_tokens"), pa.array(crc, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                held.close()

    spread = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(spread, "file").mapInArrow(run, f"doc_id {doc_kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    return read_documents(write_tokens(docs), docs.schema["doc_id"].dataType.simpleString())

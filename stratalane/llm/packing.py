"""Mixture-controlled packing of documents into windows of equal length.

Each source is a queue of tokens, and every window is filled from the queues by deficit round-robin (`DeficitRound`). On
its visit a queue's deficit counter grows by its quantum, its target share of a window; it sends whole tokens only, as
many as its counter and the credit that the visits before it in the round left over allow, and what it is short or over
stays in its counter for the next window. Counters stay within one token. `Schedule` gives the state of the counters at
any window without running the rounds before it, so a partition starts where its documents lie, with the deficits that
all windows before leave. A queue that runs dry ends a phase; the targets of the others are scaled up and the round goes on.

Sources entitled to less than LEAST tokens of a window (at most length / LEAST are entitled to more) are served by a round
of their own, which one queue stands for: there the packets are whole documents, and a source sends its next one when
its deficit has grown to the document's size. That order is the order of `tokens so far / target`, had by a range sort, so
any number of small sources keep their own targets, with nothing about them collected or broadcast.

Without targets these are the corpus's own proportions, with which all queues end together; a temperature under 1 takes
small sources oftener, by powers of their sizes.

Defined results: a null text counts as empty (its document is its end token alone), a null source is a queue of its
own, apart from that of an empty name; equal rows are packed each for itself; texts are packed whole at any length, cut
where a window ends; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalane.llm.common import text_slices, worker_state
from stratalane.llm.tokens import SLICE, WordEncoder, default_tokenizer
from stratalane.session import written

LENGTH = 4096
END = 2
#: Tokens of a window from which on a source is a queue of its own.
LEAST = 16
SMALL = 100_000
REST = "rest"


def _scaled(x: np.ndarray, by: int, over: int) -> np.ndarray:
    """floor(x * by / over), exactly."""
    if len(x) and int(x.max()) * max(by, 1) >= 1 << 62:
        return np.array([int(v) * by // over for v in x], dtype=np.int64)
    return x * by // over


class DeficitRound:
    """Deficit round-robin as it runs, a window at a time. Counters are in 1 / sum(weights) of a token."""

    def __init__(self, weights: list[int], length: int = LENGTH):
        self.unit, self.quantum = sum(weights), [w * length for w in weights]
        self.deficit = [0] * len(weights)

    def window(self) -> list[int]:
        """The tokens that each queue sends to the next window."""
        sent, credit = [], 0
        for k, quantum in enumerate(self.quantum):
            self.deficit[k] += quantum
            credit += self.deficit[k]
            sent.append(credit // self.unit)
            self.deficit[k] -= sent[k] * self.unit
            credit -= sent[k] * self.unit
        return sent


class Schedule:
    """The state of a deficit round-robin over finite queues: what each has sent when x tokens are out.

    In a phase, queues 0 to s have together sent floor(x * W_s / W), W_s the sum of their weights: so says DeficitRound,
    as the credit that a visit leaves over is under one token. A queue's deficit is its entitlement less what it sent.
    """

    def __init__(self, sizes: list[int], weights: list[int] | None = None, length: int = LENGTH):
        weights = list(sizes if weights is None else weights)
        if any(w <= 0 for w in weights):
            raise ValueError("every queue needs a positive target")
        self.length, self.total, n = length, sum(sizes), len(sizes)
        sent, x = [0] * n, 0
        #: Per phase: its first x, what each queue had sent before it, and what it sends within it.
        self.phases: list[tuple[int, list[int], list[int]]] = []
        while x < self.total:
            live = [i for i in range(n) if sent[i] < sizes[i]]
            first = min(live, key=lambda i: ((sizes[i] - sent[i]) / weights[i], i))
            num, den = sizes[first] - sent[first], weights[first]
            quota = [0] * n
            for i in live:
                quota[i] = min(sizes[i] - sent[i], max(weights[i] * num // den, int(i == first)))
            self.phases.append((x, list(sent), quota))
            sent = [a + b for a, b in zip(sent, quota)]
            x += sum(quota)
        self.firsts = [p[0] for p in self.phases]

    def sent(self, queue: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending x: tokens sent by `queue`, and by all queues before it."""
        own, before = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        at = 0
        k = max(bisect_right(self.firsts, int(x[0])) - 1, 0) if len(x) else 0
        while at < len(x) and k < len(self.phases):
            first, sent, quota = self.phases[k]
            stop = len(x) if k + 1 == len(self.phases) else int(np.searchsorted(x, self.firsts[k + 1]))
            if stop > at:
                low, high, all_ = sum(quota[:queue]), sum(quota[: queue + 1]), sum(quota)
                into = np.minimum(x[at:stop] - first, all_)
                a, b = _scaled(into, low, all_), _scaled(into, high, all_)
                own[at:stop], before[at:stop] = sent[queue] + b - a, sum(sent[:queue]) + a
            at, k = max(at, stop), k + 1
        return own, before

    def windows(self, queue: int, low: int, high: int) -> np.ndarray:
        """The first x of every window that may hold tokens low to high of a queue, and of the one after."""
        ends = []
        for token in (low, high):
            k = max(bisect_right([p[1][queue] for p in self.phases], token) - 1, 0)
            while self.phases[k][2][queue] == 0 and k:
                k -= 1
            first, sent, quota = self.phases[k]
            ends.append(first + (token - sent[queue]) * sum(quota) // max(quota[queue], 1))
        slack = 2 + len(self.phases)
        least = max(ends[0] // self.length - slack, 0)
        return np.arange(least, ends[1] // self.length + slack + 2, dtype=np.int64) * self.length


def encoded(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """A written table (doc_id, source, part, local_start, n_tokens, ids): ids as 32-bit little-endian integers.

    local_start counts the tokens of the same source before it in the same part, so positions need no global sort.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        encoder = worker_state(f"words:{path}", lambda: WordEncoder(path))
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            for piece in text_slices(batch, "text", SLICE):
                ids, ends = encoder.encode(piece.column("text"))
                starts, bodies, counts = [], [], np.diff(ends) + 1
                for source, n, a, b in zip(piece.column("source").to_pylist(), counts.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                    starts.append(seen.get(source, 0))
                    seen[source] = starts[-1] + n
                    bodies.append(ids[a:b].astype("<u4").tobytes() + end.to_bytes(4, "little"))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("source"), pa.array([part] * len(starts), type=pa.int32()), pa.array(starts, type=pa.int64()), pa.array(counts, type=pa.int64()), pa.array(bodies, type=pa.binary())],
                    names=["doc_id", "source", "part", "local_start", "n_tokens", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    # "=" before names keeps a null source, and the queue of small ones, apart from any of them.
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select("doc_id", name.alias("source"), "text")
    return written(rows.mapInArrow(run, f"doc_id {kind}, source string, part int, local_start long, n_tokens long, ids binary"), "encoded")


def _by_due(rows: DataFrame, due: Column) -> DataFrame:
    """Rows of encoded() as one queue in the order of due, placed in parts anew."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            starts = seen + np.cumsum(n) - n
            seen += int(n.sum())
            at = [batch.schema.get_field_index(c) for c in ("part", "local_start")]
            batch = batch.set_column(at[0], "part", pa.array(np.full(len(n), part, dtype=np.int32))).set_column(at[1], "local_start", pa.array(starts))
            yield batch

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = [c for c in rows.columns if c not in ("base", "target")]
    keyed = rows.withColumn("__due", due).repartitionByRange(parts, "__due", "source", "local_start").sortWithinPartitions("__due", "source", "part", "local_start")
    placed = keyed.select(own).withColumn("source", F.lit(REST))
    return written(placed.mapInArrow(run, placed.schema), "rest")


def packed(docs: DataFrame, tokenizer: str | None = None, weights: dict[str | None, float] | None = None, length: int = LENGTH, temperature: float = 1.0) -> DataFrame:
    """One row per piece: where it lies in its document (start, length) and in the packed corpus (sequence_id, offset).

    weights: target shares by source; others have their share of the corpus (to the power of temperature), and all are
    scaled to one.
    """
    spark, table = docs.sparkSession, encoded(docs, tokenizer)
    by_part = written(table.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")), "parts")
    total = by_part.agg(F.sum("n").alias("t")).first().t or 0
    target = F.pow(F.col("n") / F.lit(max(total, 1)), F.lit(temperature))
    if weights:
        given = F.create_map(*(F.lit(x) for k, v in weights.items() for x in ("" if k is None else f"={k}", float(v))))
        target = F.coalesce(given[F.col("source")], target)
    sizes = written(by_part.groupBy("source").agg(F.sum("n").alias("n")).withColumn("target", target), "sources")
    whole = sizes.agg(F.sum("target").alias("t")).first().t or 1.0
    large = F.col("target") * (length / LEAST) >= whole
    queues = sizes.where(large).orderBy("source").collect()  # length / LEAST rows at most
    names, amounts, shares = [r.source for r in queues], [r.n for r in queues], [r.target / whole for r in queues]
    rest = total - sum(amounts)
    if rest:
        before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        places = by_part.join(sizes.where(~large).select("source", "target"), "source").select("source", "part", "target", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        middle = F.col("base") + F.col("local_start") + F.col("n_tokens") / 2
        small = _by_due(table.join(places, ["source", "part"]), middle / F.col("target"))
        # First in the round, as its quantum may be under a token, which would disturb queues behind it otherwise.
        names, amounts, shares = [REST, *names], [rest, *amounts], [1 - sum(shares), *shares]
        table = table.join(F.broadcast(sizes.where(large).select("source")), "source", "left_semi").select(small.columns).unionByName(small)
        by_part = table.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    schedule = Schedule(amounts, amounts if temperature == 1 and not weights else [max(1, round(x * (1 << 30))) for x in shares], length)
    listed = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "source string, queue int")
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.join(F.broadcast(listed), "source").select("source", "part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row a queue and part of the input; beyond SMALL of them, both sides are shuffled instead.
    offsets = written(offsets, "offsets")
    if offsets.count() <= SMALL:
        offsets = F.broadcast(offsets)
    placed = table.join(offsets, ["source", "part"]).select("doc_id", "queue", (F.col("base") + F.col("local_start")).alias("at"), "n_tokens", "ids")

    def run(batches):
        for batch in batches:
            queues, at, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("queue", "at", "n_tokens"))
            for q in np.unique(queues):
                rows = np.flatnonzero(queues == q)
                yield _pieces(batch, rows[np.argsort(at[rows], kind="stable")], int(q), at, n, schedule)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int")


def _pieces(batch: pa.RecordBatch, rows: np.ndarray, queue: int, at: np.ndarray, n: np.ndarray, schedule: Schedule) -> pa.RecordBatch:
    """The pieces of some documents of one queue, ordered by their place in it."""
    first, last = at[rows], at[rows] + n[rows]
    # Documents of a batch may lie far apart in the queue; windows are laid out for each stretch of near ones.
    out: list[list[np.ndarray]] = []
    cuts = np.flatnonzero(first[1:] - last[:-1] > 64 * schedule.length) + 1
    for part in np.split(np.arange(len(rows)), cuts):
        a, b = first[part], last[part]
        x = schedule.windows(queue, int(a[0]), int(b[-1]))
        sent, before = schedule.sent(queue, np.minimum(x, schedule.total))
        i0, i1 = np.searchsorted(sent, a, side="right") - 1, np.searchsorted(sent, b, side="left")
        count = i1 - i0
        doc = np.repeat(part, count)
        w = np.repeat(i0, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        lo, hi = np.maximum(sent[w], first[doc]), np.minimum(sent[w + 1], last[doc])
        real = hi > lo
        doc, w, lo, hi = doc[real], w[real], lo[real], hi[real]
        out.append([doc, lo - first[doc], hi - lo, x[w] // schedule.length, before[w + 1] - before[w] + lo - sent[w]])
    doc, start, size, window, offset = (np.concatenate(c) for c in zip(*out))
    bodies = batch.column("ids")
    views = [memoryview(bodies[int(r)].as_buffer()) for r in rows]
    crc = [zlib.crc32(views[d][4 * s : 4 * (s + m)]) for d, s, m in zip(doc.tolist(), start.tolist(), size.tolist())]
    took = pa.array(rows[doc])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(took), *(pa.array(c, type=pa.int64()) for c in (start, size, crc, n[rows[doc]], window, offset)), pa.array(np.full(len(doc), queue), type=pa.int32())],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
    )

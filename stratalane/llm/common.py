"""What the corpus operators share: what workers keep, batches and words."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import SparkSession

WS = r"[\x20\x09-\x0D]+"


def worker_state(name: str, make, key: str = ""):
    """A value that a Python worker keeps from task to task; make() builds it. One is kept: that of the last name and key."""
    home = sys.modules.setdefault("_stratalane_state", types.ModuleType("_stratalane_state"))
    if getattr(home, "of", None) != (name, key):
        home.of = home.value = None
        home.value = make()
        home.of = name, key
    return home.value


def shipped(spark: SparkSession, name: str, value):
    """A function that gives value on any worker. Its classes go along, so workers need no copy of this package."""
    sent, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex
    return lambda: worker_state(name, lambda: cloudpickle.loads(sent.value), key)


def _returned() -> None:
    """Gives memory that is free back to the system: workers idle on while others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text (a longer text is a slice of its own), nulls as empty."""
    at = batch.schema.get_field_index(column)
    lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        part = batch.slice(start, stop - start)
        yield part.set_column(at, pa.field(column, pa.large_string()), pc.fill_null(part.column(at).cast(pa.large_string()), ""))
        start = stop
    _returned()


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word codes of all texts in a row, and where each text begins in them (one more at the end).

    Words are split at ASCII white space; an empty word may stand for white space at the ends of a text.
    """
    lists = pc.ascii_split_whitespace(text)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets, zero for empty stretches."""
    run = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=values.dtype), np.cumsum(values, axis=0)])
    return run[offsets[1:]] - run[offsets[:-1]]


class Words:
    """Numbers for distinct words, remembered up to a bound; where that is reached, half of it stays, the words seen most.

    A subclass says what is known of a word: learn() appends it for new words, keep() picks those that stay. What is
    forgotten is learned anew when it comes again, so the bound changes no result.
    """

    def __init__(self, most: int):
        self.most, self.slots, self.seen = most, {}, np.zeros(0, dtype=np.int32)

    def learn(self, words: list[str]) -> None:
        raise NotImplementedError

    def keep(self, at: np.ndarray) -> None:
        raise NotImplementedError

    def of(self, words: list[str]) -> np.ndarray:
        at = self._found(words)
        if len(new := np.flatnonzero(at < 0)):
            if self.slots and len(self.slots) + len(new) > self.most:
                self._shrink()
                at = self._found(words)
                new = np.flatnonzero(at < 0)
            fresh = list(dict.fromkeys([words[i] for i in new]))
            for k in range(0, len(fresh), 20_000):
                self.learn(fresh[k : k + 20_000])
            self.slots.update(zip(fresh, range(len(self.slots), len(self.slots) + len(fresh))))
            self.seen = np.concatenate([self.seen, np.zeros(len(fresh), dtype=np.int32)])
            at[new] = self._found([words[i] for i in new])
        self.seen[at] += 1
        return at

    def _found(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.slots.get, words, repeat(-1)), dtype=np.int32, count=len(words))

    def _shrink(self) -> None:
        often = np.argsort(-self.seen, kind="stable")[: self.most // 2]
        stay = np.sort(often[self.seen[often] > 1])
        self.keep(stay)
        names = list(self.slots)
        self.slots = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.seen = self.seen[stay] // 2

"""SentencePiece encoding by streaming Viterbi, and decoding.

Encoding walks through the characters of a whole text and keeps, for each place, the best score and the piece that ends
there. Only the last `longest` places can still begin a piece, and only these are held: from time to time the paths back
from them are followed to where they meet; what lies before that place can no longer change, so its ids are committed and
its places forgotten. In a vocabulary without pieces across words all paths meet before a word's blank, which needs no
following. There the state is empty, so what is committed from one such place to the next depends on the characters
between alone, and a worker remembers up to MAX_WORDS of these runs instead of walking through them again. With pieces
across words every text is walked through as it is.

Defined results: a null text counts as empty, an empty text has no ids and decodes to itself; texts are encoded whole
at any length, in memory that does not grow with it but for the ids; among segmentations of equal score the one whose
last piece is longest is taken, and so on to the front; equal rows give equal rows; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratalane.llm.common import text_slices, worker_state
from stratalane.llm.pieces import SPACE, Pieces, default_pieces, segments_of
from stratalane.llm.tokens import MAX_WORDS, WordEncoder, WordIds, laid


def stream(chars: Iterable[str], pieces: Pieces) -> Iterator[list[int]]:
    """The ids of a stream of characters, in runs as they are committed."""
    held: list[str] = []  # the characters since the last commitment
    best: list[float] = [0.0]
    back: list[int] = [0]
    piece: list[int] = [-1]  # -1: the character's own bytes

    def path(to: int) -> list[int]:
        out: list[int] = []
        while to:
            out += reversed(pieces.spelled(held[to - 1])) if piece[to] < 0 else [piece[to]]
            to = back[to]
        return out[::-1]

    due = 2 * pieces.longest
    for c in chars:
        if c == SPACE and held and pieces.splits and held[-1] != SPACE:
            yield path(len(held))
            held, best, back, piece, due = [], [0.0], [0], [-1], 2 * pieces.longest
        held.append(c)
        j = len(held)
        score, start, which = (best[j - 1] + pieces.unknown_score, j - 1, -1) if not pieces.single(c) else (-np.inf, j - 1, -1)
        node, k = pieces.trie, j
        while k > 0 and (node := node.get(held[k - 1])) is not None:
            k -= 1
            if (end := node.get("")) and best[k] + end[0] >= score:
                score, start, which = best[k] + end[0], k, end[1]
        best.append(score)
        back.append(start)
        piece.append(which)
        if j >= due:
            live = set(range(max(0, j - pieces.longest + 1), j + 1))
            while len(live) > 1:
                live.add(back[top := max(live)])
                live.discard(top)
            meet = live.pop()
            if meet:
                yield path(meet)
                zero = best[meet]
                held, best = held[meet:], [x - zero for x in best[meet:]]
                back, piece = [max(0, x - meet) for x in back[meet:]], piece[meet:]
            due = len(held) + pieces.longest
    if held:
        yield path(len(held))


def encode_word(word: str, pieces: Pieces) -> list[int]:
    return [i for run in stream(word, pieces) for i in run]


class SentenceEncoder(WordEncoder):
    """Encodes whole texts; runs between places where all paths meet are walked through once."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        self.pieces, self.known = Pieces(path), WordIds(self._ids, max_words)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.pieces.splits:
            return super().encode(text)
        ids = [encode_word(SPACE + t.replace(" ", SPACE) if t else "", self.pieces) for t in text.to_pylist()]
        return np.array([i for x in ids for i in x], dtype=np.int32), np.cumsum([0, *map(len, ids)])

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return laid([encode_word(w, self.pieces) for w in words])

    def _split(self, text: pa.Array):
        words, codes, offsets = segments_of(text)
        return words, np.arange(len(words))[:, None], codes, offsets


def coded(docs: DataFrame, pieces: str | None = None, keep_ids: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32, decodes) of every whole text; decodes: whether its ids give the text again."""
    path = pieces or default_pieces()

    def run(batches):
        encoder = worker_state(f"pieces:{path}", lambda: SentenceEncoder(path))
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, ends = encoder.encode(part.column("text"))
                bodies = part.column("text").cast(pa.large_binary()).to_pylist()
                small, ok, crc = ids.astype("<u4"), [], []
                for a, b, body in zip(ends[:-1].tolist(), ends[1:].tolist(), bodies):
                    crc.append(zlib.crc32(small[a:b]))
                    ok.append(encoder.pieces.decode(ids[a:b]) == body)
                lists = [pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(ids, type=pa.int32()))] if keep_ids else []
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *lists, pa.array(np.diff(ends), type=pa.int64()), pa.array(crc, type=pa.int64()), pa.array(ok, type=pa.bool_())],
                    names=["doc_id", *["ids"] * keep_ids, "n_tokens", "ids_crc32", "decodes"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}{', ids array<int>' * keep_ids}, n_tokens long, ids_crc32 long, decodes boolean")


def decoded(rows: DataFrame, pieces: str | None = None) -> DataFrame:
    """(doc_id, text) from rows of (doc_id, ids); bytes that are no UTF-8 become U+FFFD, null ids a null text."""
    path = pieces or default_pieces()

    def run(batches):
        table = worker_state(f"table:{path}", lambda: Pieces(path))
        for batch in batches:
            text = [None if x is None else table.decode(np.array(x, dtype=np.int64)).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, type=pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")

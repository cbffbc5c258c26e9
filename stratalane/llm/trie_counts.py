"""Token counts by trie-shared dynamic programming.

Distinct pre-tokens are inserted in a trie. A node stands for a prefix and holds its forward score (the best unigram
score of any segmentation of the prefix, with the number of tokens that takes), worked out once, when the node is made,
from the scores on the path to it; so whatever shares the prefix, in this batch or a later one, finds it done. A pre-token's
count is what its terminal node holds. The trie grows to MAX_NODES nodes and then begins anew; the counts of up to
MAX_WORDS pre-tokens are kept beside it, and a text's count is the sum over its pre-tokens.

Defined results: a null text counts as empty, an empty text has no tokens; texts are counted whole at any length; among
segmentations of equal score the one whose last piece is longest counts, and so on to the front; equal rows give equal
rows; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratalane.llm.common import Words, text_slices, totals, worker_state
from stratalane.llm.pieces import Pieces, default_pieces, segments_of
from stratalane.llm.viterbi import stream

MAX_WORDS = 600_000
MAX_NODES = 1_000_000
#: Longer pre-tokens share next to nothing, and are counted by a walk that holds a window instead of nodes.
LONG = 256


class Trie:
    """Prefixes of pre-tokens with their forward scores. Nodes are numbers, 0 the empty prefix."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        #: A node's children under (node << 21) + character; all other figures of a node lie in arrays.
        self.child: dict[int, int] = {}
        self.score, self.tokens, self.terminal = array("d", [0.0]), array("l", [0]), bytearray(1)

    def __len__(self) -> int:
        return len(self.score)

    def insert(self, words: list[str]) -> list[int]:
        """The terminal nodes of words, whose tokens are the words' own. Sorted words walk their common paths once."""
        child, pieces, score, tokens = self.child, self.pieces, self.score, self.tokens
        single, unknown, ends = pieces.single, pieces.unknown_score, []
        last, path, best, number = "", [0], [0.0], [0]
        for word in words:
            shared, top = 0, min(len(word), len(last))
            while shared < top and word[shared] == last[shared]:
                shared += 1
            del path[shared + 1 :], best[shared + 1 :], number[shared + 1 :]
            for j in range(shared, len(word)):
                key = (path[j] << 21) + ord(word[j])
                after = child.get(key)
                if after is None:
                    if single(word[j]):
                        most, count = -np.inf, 0
                    else:
                        most, count = best[j] + unknown, number[j] + len(pieces.spelled(word[j]))
                    piece, k = pieces.trie, j
                    while k >= 0 and (piece := piece.get(word[k])) is not None:
                        if (end := piece.get("")) and (reached := best[k] + end[0]) >= most:
                            most, count = reached, number[k] + 1
                        k -= 1
                    child[key] = after = len(score)
                    score.append(most)
                    tokens.append(count)
                    self.terminal.append(0)
                else:
                    most, count = score[after], tokens[after]
                path.append(after)
                best.append(most)
                number.append(count)
            self.terminal[path[-1]] = 1
            ends.append(path[-1])
            last = word
        return ends


class TrieCounter(Words):
    """Token counts of words."""

    def __init__(self, path: str, most: int = MAX_WORDS, nodes: int = MAX_NODES):
        super().__init__(most)
        self.pieces, self.nodes, self.counts = Pieces(path), nodes, np.zeros(0, dtype=np.int64)
        self.trie = Trie(self.pieces)

    def learn(self, words: list[str]) -> None:
        order = sorted(range(len(words)), key=words.__getitem__)
        counts = np.empty(len(words), dtype=np.int64)
        for at in range(0, len(order), 5000):
            if len(self.trie) > self.nodes:
                self.trie = Trie(self.pieces)
            some = [i for i in order[at : at + 5000] if len(words[i]) <= LONG]
            counts[some] = [self.trie.tokens[end] for end in self.trie.insert([words[i] for i in some])]
        for i in order:
            if len(words[i]) > LONG:
                counts[i] = sum(map(len, stream(words[i], self.pieces)))
        self.counts = np.concatenate([self.counts, counts])

    def keep(self, at: np.ndarray) -> None:
        self.counts = self.counts[at]

    def count(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and pre-tokens of each text."""
        words, codes, offsets = segments_of(text)
        at = self.of(words)
        return totals(self.counts[at[codes]] if len(codes) else np.zeros(0, dtype=np.int64), offsets), np.diff(offsets)


def token_counts(docs: DataFrame, pieces: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) of every whole text."""
    path = pieces or default_pieces()

    def run(batches):
        counter = worker_state(f"trie:{path}", lambda: TrieCounter(path))
        for batch in batches:
            for part in text_slices(batch, "text"):
                tokens, words = counter.count(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens, type=pa.int64()), pa.array(words, type=pa.int64())], names=["doc_id", "n_tokens", "n_pretokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pretokens long")

"""Whole texts to token ids with a public tokenizer, a distinct word at a time."""

from __future__ import annotations

import json
import os
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stratalane.llm.common import Words, words_of

MAX_WORDS = 500_000
#: Bytes of text encoded at once: each slice looks its distinct words up again, so larger ones are cheaper.
SLICE = 4 << 20
#: Pre-tokens of letters, of single digits and of other marks: a mark behind a letter or digit begins one of its own.
APART = r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_END = "\u0250"
#: Marks at the end of a word that are cut off: those of ASCII but for the one in which special tokens end.
TAIL = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "|")
#: Plain words that the library is given at a time, as one text.
ROW = 512


def laid(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some words in a row, and how many each has."""
    lengths = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
    return np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(lengths.sum())), lengths


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _last_bytes(words: pa.Array, at: np.ndarray, n: np.ndarray) -> pa.Array:
    """The last n bytes of the words at some places; at least one place."""
    _, offsets, data = words.cast(pa.large_string()).buffers()
    stops, run = np.frombuffer(offsets, dtype=np.int64)[words.offset + 1 + at], np.cumsum(n, dtype=np.int64)
    held = np.frombuffer(data, dtype=np.uint8)[np.repeat(stops - run, n) + np.arange(run[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.concatenate([[0], run])), pa.py_buffer(held)])


class WordIds(Words):
    """The ids of distinct words, laid in a pool; ids_of gives the ids of new words in a row and how many each has."""

    def __init__(self, ids_of, most: int):
        super().__init__(most)
        self.ids_of = ids_of
        self.pool, self.used = np.empty(1 << 16, dtype=np.int32), 0
        self.starts, self.lengths = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def learn(self, words: list[str]) -> None:
        ids, lengths = self.ids_of(words)
        need = self.used + int(lengths.sum())
        while need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : need] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths, dtype=np.int64) - lengths])
        self.lengths, self.used = np.concatenate([self.lengths, lengths]), need

    def keep(self, at: np.ndarray) -> None:
        starts, lengths = self.starts[at], self.lengths[at]
        ends = np.cumsum(lengths, dtype=np.int64)
        pool = self.pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        self.pool, self.used = np.concatenate([pool, np.empty(1 << 16, dtype=np.int32)]), len(pool)
        self.starts, self.lengths = ends - lengths, lengths


class WordEncoder:
    """Encodes texts by a tokenizers file that drops white space and never joins across it.

    Then a text's ids are the ids of its words in a row, and each distinct word is encoded by the library once and kept.
    Where the file folds case and sets marks apart from letters, so do we beforehand, which leaves fewer distinct words.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), WordIds(self._ids, max_words)
        self.largest = max(self.tokenizer.get_vocab().values(), default=0)
        self.apart: dict[str, bool] = {}
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        parts = lambda x: [p for y in x["pretokenizers" if "pretokenizers" in x else "normalizers"] for p in [y]] if x and x["type"] == "Sequence" else [x or {}]
        lowers = any(p.get("type") == "Lowercase" for p in parts(said["normalizer"]))
        self.folds = lowers and any(str(p.get("pattern", {}).get("Regex", "")).endswith(APART) for p in parts(said["pre_tokenizer"]))

        # Words of small Latin letters are one pre-token as they stand, so for these the file's own preparation is left out.
        # Where words end in tokens of their own, many are encoded as one text and told apart by these.
        if self.folds:
            own = [p for p in parts(said["pre_tokenizer"]) if p.get("type") != "Split"]
            said["normalizer"], said["pre_tokenizer"] = None, {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *own]}
            self.bare, suffix = Tokenizer.from_str(json.dumps(said)), said["model"].get("end_of_word_suffix")
            self.ends = np.zeros(self.largest + 1, dtype=bool)
            self.ends[[i for token, i in self.bare.get_vocab().items() if suffix and token.endswith(suffix)]] = True

    def _every(self, tokenizer, words: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As laid(); words of small Latin letters only."""
        rows = self._every(self.bare, [" ".join(words[k : k + ROW]) for k in range(0, len(words), ROW)])
        ids = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=sum(map(len, rows)))
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words) or len(last) and last[-1] + 1 != len(ids):
            return laid(self._every(self.bare, words))
        return ids, np.diff(last, prepend=-1).astype(np.int32)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.folds:
            return laid(self._every(self.tokenizer, words))
        plain = np.array([w.islower() and w.isalpha() and (w.isascii() or max(w) < LATIN_END and w == w.lower()) for w in words], dtype=bool)
        one, other = self._plain(list(compress(words, plain))), laid(self._every(self.tokenizer, list(compress(words, ~plain))))
        lengths = np.empty(len(words), dtype=np.int32)
        lengths[plain], lengths[~plain] = one[1], other[1]
        ids = np.empty(len(one[0]) + len(other[0]), dtype=np.int32)
        at = np.repeat(plain, lengths)
        ids[at], ids[~at] = one[0], other[0]
        return ids, lengths

    def _apart(self, letter: str) -> bool:
        """Whether the file sets marks apart from this letter: not where its normal form ends in a mark, as that of İ does."""
        if letter not in self.apart:
            held = self.tokenizer.normalizer.normalize_str(letter + ".")
            self.apart[letter] = self.tokenizer.pre_tokenizer.pre_tokenize_str(held)[-1][0] == "."
        return self.apart[letter]

    def _split(self, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct parts of words, the parts of each distinct word, the word codes of all texts and where each begins."""
        distinct, codes, offsets = words_of(text)
        if not self.folds:
            return distinct.to_pylist(), np.arange(len(distinct))[:, None], codes, offsets
        # Letters with marks to combine may compose by case, and special tokens have theirs; none is cut, as these end in "|>".
        fixed = pc.match_substring_regex(distinct, r"\pM|<\|")
        low = pc.if_else(fixed, distinct, pc.ascii_lower(distinct))
        core = pc.ascii_rtrim(low, TAIL)
        size, whole = (pc.binary_length(x).to_numpy() for x in (core, low))
        cut = np.flatnonzero((size < whole) & (size > 0))
        last = pc.utf8_slice_codeunits(core.take(pa.array(cut)), -1).dictionary_encode()
        cut = cut[np.array([self._apart(c) for c in last.dictionary.to_pylist()], dtype=bool)[last.indices.to_numpy()]]
        apart = np.zeros(len(low), dtype=bool)
        apart[cut] = True
        core = pc.if_else(pa.array(apart), core, low).dictionary_encode()
        tails, tail = [""], np.zeros(len(low), dtype=np.int64)
        if len(cut):
            found = _last_bytes(low, cut, (whole - size)[cut]).dictionary_encode()
            tails, tail[cut] = [*tails, *found.dictionary.to_pylist()], found.indices.to_numpy() + 1
        parts = np.stack([core.indices.to_numpy(), tail + len(core.dictionary)], axis=1)
        return core.dictionary.to_pylist() + tails, parts, codes, offsets

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text begins in them (one more at the end)."""
        words, parts, codes, offsets = self._split(text)
        known = self.known
        of = known.of(words)[parts.astype(np.int32)][codes].ravel() if len(codes) else np.zeros(0, dtype=np.int32)
        lengths = known.lengths[of]
        ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(lengths, dtype=np.int64)])
        kind = np.int32 if max(known.used, ends[-1]) < 1 << 30 else np.int64  # halves what one text's places take
        at = np.repeat((known.starts[of] - ends[:-1]).astype(kind), lengths)
        at += np.arange(len(at), dtype=kind)
        return known.pool[at], ends[offsets * parts.shape[1]]

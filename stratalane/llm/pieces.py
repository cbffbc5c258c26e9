"""A SentencePiece vocabulary as a table of pieces and scores for unigram segmentation."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces with their scores, as a trie over their characters from last to first.

    The scores of the file are taken as unigram log-scores whatever model it was made for. A character that is no piece
    itself costs the least score less a penalty, and stands for its UTF-8 bytes (or the unknown id without such pieces).
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.trie: dict = {}
        self.unknown, self.bytes, least, self.longest, inner = sp.unk_id(), {}, 0.0, 1, False
        self.text: list[bytes] = [b""] * size
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.text[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                score = float(sp.get_score(i))
                least, self.longest = min(least, score), max(self.longest, len(piece))
                inner |= SPACE in piece.lstrip(SPACE)
                self.text[i] = piece.replace(SPACE, " ").encode()
                node = self.trie
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[""] = (score, i)
        #: Whether every path passes the place before a word's blank, so that words can be cut apart beforehand.
        self.splits = not inner
        self.unknown_score = least - UNKNOWN_PENALTY
        self.lengths = np.array([len(t) for t in self.text], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(self.text), dtype=np.uint8)

    def spelled(self, char: str) -> list[int]:
        """The ids of a character that is no piece."""
        found = [self.bytes.get(b) for b in char.encode()]
        return [self.unknown] if None in found else found

    def single(self, char: str) -> bool:
        return "" in self.trie.get(char, ())

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the blank that encoding puts first."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        out = self.pool[at].tobytes()
        return out[1:] if out[:1] == b" " else out


def segments(text: str) -> list[str]:
    """A text's words as SentencePiece has them: a blank is put first, and words begin with their blanks."""
    return _SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []


def segments_of(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the word codes of all texts in a row, and where each text begins in them (one more at the end)."""
    odd = pc.or_(pc.or_(pc.match_substring(text, "  "), pc.match_substring(text, SPACE)), pc.or_(pc.starts_with(text, " "), pc.equal(pc.binary_length(text), 0)))
    odd = odd.to_numpy(zero_copy_only=False)
    if odd.any():
        lists = [segments(t) if o else [SPACE + w for w in t.split(" ")] for t, o in zip(text.to_pylist(), odd)]
        words, codes = {}, []
        for found in lists:
            codes += [words.setdefault(w, len(words)) for w in found]
        return list(words), np.array(codes, dtype=np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    lists = pc.split_pattern(text, " ")
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    return [SPACE + w for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]

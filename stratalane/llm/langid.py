"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

One model per language over the letters of lower-cased words, each word between blanks. For every order up to ORDER a
model has the n-grams it saw, with their interpolated probability worked out, and the back-off weights of the contexts.
All languages share one sorted array of 64-bit n-gram hashes an order, with one column of values a language (NaN where
a language has not seen the n-gram), so that one binary search serves all of them. A text goes to the language of least
cross-entropy per character. Cross-entropies of labelled texts that the models have not seen set a temperature, which
turns differences into the score, and when a text is rejected as none of the languages: its cross-entropy is measured
from the language's median, in units of the language's own spread for a text of that length, and rejected beyond what a
share FALSE_REJECTION of all calibration texts exceed. As that cut is taken over all languages together, one odd or
mislabelled text can't move it for its language.

Learning takes at most TRAIN_ROWS passages a language of at most TRAIN_CHARS characters each (less where there are so many
languages that all of them would hold more than SAMPLE_CHARS), and as many again for calibration. Texts are cut into such
passages, and these are picked by hash, so any part of any text may be learned from. These bounds hold at any size of the
corpus. Prediction reads every whole text. Distinct words are scored once per batch and remembered by a worker, up to MAX_WORDS of them.

Defined results: a null text or one without letters is `und` with score 0; texts of any length are read whole; equal
rows get equal rows; ties between languages go to the first by name; without any labelled text all is `und`; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalane.llm.common import shipped, text_slices, totals, words_of

ORDER = 5
TRAIN_ROWS = 400
TRAIN_CHARS = 8_000
SAMPLE_CHARS = 64_000_000
FALSE_REJECTION = 0.002
#: The variance of a text's cross-entropy is taken to be in proportion to 1 / characters + 1 / LENGTH_SCALE.
LENGTH_SCALE = 300
MAX_WORDS = 250_000
UND = "und"
PUNCTUATION = ".,;:!?\"'()[]{}|$%&*#<>-+=/\\_@~^`0123456789"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ' w1 w2 w3 ', where each word's blank is, and of each position how far back its word's blank lies."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    begins = np.cumsum(lengths) - lengths
    back = np.arange(1, len(points)) - np.repeat(begins, lengths)
    return points, lengths, back


def _grams(points: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams that end at each position; meaningless where they reach before the word."""
    h = np.full(len(points), order, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order - 1, -1, -1):
            moved = np.zeros(len(points), dtype=np.uint64)
            moved[k:] = points[: len(points) - k]
            h = (h ^ moved) * _STEP
            h ^= h >> np.uint64(29)
    return h


class CharModel:
    """An interpolated Kneser-Ney model of one language: per order, sorted hashes of n-grams and of contexts."""

    def __init__(self, words: list[str], order: int = ORDER):
        self.order = order
        points, _, back = _laid_out(words)
        self.size = len(np.unique(points)) + 1
        grams, contexts, logp, keys, logs = {}, {}, None, [], []
        full = {}
        for k in range(1, order + 1):
            ok = back >= k - 1
            g, shorter = _grams(points, k)[1:][ok], _grams(points, k - 1)
            # The context is the same n-gram without its last character, the tail is it without its first.
            c, t = shorter[:-1][ok], shorter[1:][ok]
            unique, first, counts = np.unique(g, return_index=True, return_counts=True)
            full[k] = (unique, c[first], t[first], counts, back[ok][first] == k - 1)
        for k in range(1, order + 1):
            unique, c, t, counts, edge = full[k]
            if k < order:  # continuation counts: how many characters precede it; at a word's blank nothing can, so the count stays
                up = full[k + 1]
                at = np.searchsorted(unique, up[2])
                preceding = np.bincount(at, minlength=len(unique))
                counts = np.where(edge & (preceding == 0), counts, np.maximum(preceding, 1))
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            cs, inverse = np.unique(c, return_inverse=True)
            total, kinds = np.bincount(inverse, counts), np.bincount(inverse)
            lam = d * kinds / total
            if k == 1:
                lower = np.full(len(unique), 1 / self.size)
            else:
                lower = np.exp(logp[np.searchsorted(keys[-1], t)])
            p = np.maximum(counts - d, 0) / total[inverse] + lam[inverse] * lower
            logp = np.log(p)
            keys.append(unique)
            logs.append(logp.astype(np.float32))
            contexts[k] = (cs, np.log(lam).astype(np.float32))
        self.grams, self.contexts = list(zip(keys, logs)), [contexts[k] for k in range(1, order + 1)]
        self.unseen = float(contexts[1][1][0]) - math.log(self.size)


class Identifier:
    """Models of several languages with their arrays merged by order, and what calibration has set."""

    def __init__(self, models: dict[str, CharModel]):
        self.languages = sorted(models)
        every = [models[x] for x in self.languages]
        self.order = every[0].order if every else 0
        merge = lambda parts: (keys := np.unique(np.concatenate([k for k, _ in parts])), self._spread(keys, parts))
        self.grams = [merge([m.grams[k] for m in every]) for k in range(self.order)]
        self.contexts = [merge([m.contexts[k] for m in every]) for k in range(self.order)]
        self.unseen = np.array([m.unseen for m in every], dtype=np.float32)
        self.temperature, self.cut = 1.0, np.inf
        self.centre, self.spread = np.zeros(len(every)), np.ones(len(every))

    @staticmethod
    def _spread(keys: np.ndarray, parts) -> np.ndarray:
        out = np.full((len(keys), len(parts)), np.nan, dtype=np.float32)
        for i, (k, v) in enumerate(parts):
            out[np.searchsorted(keys, k), i] = v
        return out

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each word and the blank after it in each language, and how many characters that is."""
        points, lengths, back = _laid_out(words)
        n = len(back)
        score = np.zeros((n, len(self.languages)), dtype=np.float32)
        open_ = np.ones((n, len(self.languages)), dtype=bool)
        for k in range(self.order, 0, -1):
            some = np.flatnonzero((back >= k - 1) & open_.any(axis=1))
            if not len(some):
                continue
            hashes = _grams(points, k)[1:][some]
            keys, values = self.grams[k - 1]
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            found = values[at]
            found[keys[at] != hashes] = np.nan
            seen = ~np.isnan(found) & open_[some]
            keys, values = self.contexts[k - 1]
            if k > 1:
                before = _grams(points, k - 1)[:-1][some]
                at = np.minimum(np.searchsorted(keys, before), len(keys) - 1)
                weight = values[at]
                weight[(keys[at] != before)] = 0
                weight = np.nan_to_num(weight, nan=0.0)
            else:
                weight = np.broadcast_to(self.unseen, seen.shape)
            score[some] += np.where(seen, np.nan_to_num(found), np.where(open_[some], weight, 0))
            open_[some] &= ~seen
        run = np.concatenate([np.zeros((1, score.shape[1])), np.cumsum(score, axis=0, dtype=np.float64)])
        ends = np.cumsum(lengths)
        return run[ends] - run[ends - lengths], lengths

    def cross_entropies(self, text: pa.Array, kept: "WordScores | None" = None) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text in each language, and its characters in words with letters."""
        kept = kept or WordScores(self)
        distinct, codes, offsets = words_of(text)
        scores, lengths = kept.of(distinct)
        n = totals(lengths[codes], offsets)
        total = np.stack([totals(scores[codes, i], offsets) for i in range(len(self.languages))], axis=1)
        return -total / np.maximum(n, 1)[:, None], n

    def calibrate(self, text: pa.Array, labels: list[str]) -> None:
        """Sets the temperature of least log-loss and when to reject, from texts not learned from."""
        h, n = self.cross_entropies(text)
        truth = np.array([self.languages.index(x) for x in labels], dtype=np.int64)
        ok = n > 0
        h, n, truth = h[ok], n[ok], truth[ok]
        if not len(h):
            return
        losses = {t: -np.log(np.maximum(_softmax(h, n, t)[np.arange(len(h)), truth], 1e-12)).mean() for t in (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)}
        self.temperature = min(losses, key=lambda t: (losses[t], t))
        own = h[np.arange(len(h)), truth]
        scale = np.sqrt(1 / n + 1 / LENGTH_SCALE)
        for i in np.unique(truth):
            mine = truth == i
            self.centre[i] = np.median(own[mine])
            self.spread[i] = max(1.4826 * np.median(np.abs(own[mine] - self.centre[i]) / scale[mine]), 0.05)
        self.cut = float(np.quantile(self._excess(own, n, truth), 1 - FALSE_REJECTION, method="higher"))

    def _excess(self, h: np.ndarray, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        """How far a cross-entropy lies above what language `of` has, in spreads for a text of n characters."""
        return (h - self.centre[of]) / (self.spread[of] * np.sqrt(1 / np.maximum(n, 1) + 1 / LENGTH_SCALE))

    def predict(self, text: pa.Array, kept: "WordScores | None" = None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Per text: language, score, nats per character, and whether it is rejected."""
        if not self.languages:
            n = len(text)
            return [UND] * n, np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
        h, n = self.cross_entropies(text, kept)
        best, rows = h.argmin(axis=1), np.arange(len(h))
        some = n > 0
        score = np.where(some, np.clip(_softmax(h, n, self.temperature)[rows, best], 0, 1), 0.0)
        least = h[rows, best]
        return [self.languages[i] if s else UND for i, s in zip(best, some)], score, least, ~some | (self._excess(least, n, best) > self.cut)


def _softmax(h: np.ndarray, n: np.ndarray, t: float) -> np.ndarray:
    x = -h * (np.minimum(n, 200) * t)[:, None]
    x = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return x / x.sum(axis=1, keepdims=True)


class WordScores:
    """Scores of distinct words, remembered up to a bound."""

    def __init__(self, identifier: Identifier, most: int = MAX_WORDS):
        self.identifier, self.most = identifier, most
        self._forget()

    def _forget(self) -> None:
        self.slots = {"": 0}
        self.scores, self.lengths = np.zeros((1, len(self.identifier.languages)), dtype=np.float32), np.zeros(1, dtype=np.int64)

    def of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.utf8_lower(pc.ascii_trim(distinct, characters=PUNCTUATION)).to_pylist()
        new = list(dict.fromkeys(w for w in words if w not in self.slots))
        if len(self.slots) + len(new) > self.most:
            self._forget()
            new = list(dict.fromkeys(w for w in words if w))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            scores, lengths = self.identifier.word_scores(part)
            letters = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in part), dtype=bool, count=len(part))
            known = len(self.slots)
            self.scores = np.concatenate([self.scores, np.where(letters[:, None], scores, 0).astype(np.float32)])
            self.lengths = np.concatenate([self.lengths, np.where(letters, lengths, 0)])
            self.slots.update(zip(part, range(known, known + len(part))))
        at = np.fromiter((self.slots[w] for w in words), dtype=np.int64, count=len(words))
        return self.scores[at].astype(np.float64), self.lengths[at]


def train(rows: list[tuple[str, str]], held: list[tuple[str, str]] = (), order: int = ORDER) -> Identifier:
    """An identifier from (text, language) rows, calibrated on others."""
    words: dict[str, list[str]] = {}
    for text, lang in rows:
        trimmed = (w.strip(PUNCTUATION) for w in text.lower().split())
        words.setdefault(lang, []).extend(w for w in trimmed if any(map(str.isalpha, w)))
    made = Identifier({lang: CharModel(w, order) for lang, w in words.items() if w})
    held = [(t, lang) for t, lang in held if lang in made.languages]
    if held:
        made.calibrate(pa.array([t for t, _ in held], type=pa.large_string()), [lang for _, lang in held])
    return made


def fitted(docs: DataFrame, usable: Column | None = None) -> Identifier:
    """An identifier learned from the labelled rows of docs (text, lang, doc_id) that are usable."""
    rows = docs.where("lang IS NOT NULL AND text <> ''")
    rows = rows if usable is None else rows.where(usable)
    passages = F.ceil(F.length("text") / TRAIN_CHARS)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum(passages).alias("n")).collect()}
    if not counts:
        return train([])
    wanted = 2 * max(10, min(TRAIN_ROWS, SAMPLE_CHARS // (2 * TRAIN_CHARS * len(counts))))
    # A share of the hash range stands for a number of passages; the limit is what bounds the sample for sure.
    place = lambda i: F.pmod(F.xxhash64(F.col("doc_id").cast("string"), i, F.lit("langid")), F.lit(1 << 30))
    cut = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, wanted / n) * (1 << 30))))))[F.col("lang")]
    listed = F.filter(F.sequence(F.lit(0), passages.cast("int") - 1), lambda i: place(i) < cut)
    picked = rows.select("text", "lang", "doc_id", F.explode(listed).alias("i"))
    picked = picked.select(F.substring(F.col("text"), F.col("i") * TRAIN_CHARS + 1, F.lit(TRAIN_CHARS)).alias("text"), "lang", place(F.col("i")).alias("place"))
    sample = sorted(picked.limit(2 * wanted * len(counts)).collect(), key=lambda r: (r.lang, r.place, r.text))
    learn, held, taken = [], [], {}
    for r in sample:
        k = taken[r.lang] = taken.get(r.lang, -1) + 1
        (held if k % 2 else learn).append((r.text, r.lang))
    return train(learn, held)


def identified(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of every whole text."""
    scores = shipped(docs.sparkSession, "langid", WordScores(identifier))

    def run(batches):
        kept = scores()
        model = kept.identifier
        for batch in batches:
            for part in text_slices(batch, "text"):
                lang, score, nats, rejected = model.predict(part.column("text"), kept)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, type=pa.string()), pa.array(score, type=pa.float64()), pa.array(nats, type=pa.float64()), pa.array(rejected, type=pa.bool_())], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")


def remainder() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def predictions(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those whose crc32(doc_id) mod 4 is not 2."""
    found = identified(docs, fitted(docs, remainder() != 2))
    return found.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns; the text decides, so any copy is treated alike."""
    identifier = fitted(docs, remainder() != 2)
    scores = shipped(docs.sparkSession, "langid", WordScores(identifier))

    def run(batches):
        kept = scores()
        model = kept.identifier
        for batch in batches:
            for part in text_slices(batch, name):
                rejected = model.predict(part.column(name), kept)[3]
                part = part.set_column(at, batch.schema.field(at), part.column(name).cast(batch.schema.field(at).type))
                yield part.filter(pa.array(~rejected))

    # Columns go by their places, as their names may hold dots.
    at = docs.columns.index("text")
    name, placed = f"c{at}", docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return placed.mapInArrow(run, placed.schema).toDF(*docs.columns)

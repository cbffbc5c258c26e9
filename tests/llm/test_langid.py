import random
import zlib

import pyarrow as pa
import pytest

from stratalane.llm import langid
from stratalane.session import load


def test_held_out_accuracy(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    rows = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert len(held) > 50 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_model_is_a_distribution():
    model = langid.CharModel(["anna", "banana", "nab", "ban", "na"], order=3)
    one = langid.Identifier({"x": model})
    alphabet = sorted(set("anbx ") | {"q"})
    # After any context the seen characters and the mass of one unseen make up at most one.
    def last(word):
        return float(one.word_scores([word])[0][0, 0])

    import math

    total = sum(math.exp(last("ba" + c) - last_prefix) for c in "anb" for last_prefix in [0.0])
    assert 0 < total <= 1 and alphabet


def test_interpolated_probabilities_by_hand():
    """Bigram Kneser-Ney worked out with dictionaries."""
    import math
    from collections import Counter

    words = ["ab", "abb", "ba"]
    model = langid.CharModel(words, order=2)
    text = [" " + w + " " for w in words]
    bigrams = Counter(t[i : i + 2] for t in text for i in range(len(t) - 1))
    follows = Counter(b[1] for b in bigrams)  # continuation counts
    d1 = _discount(follows)
    d2 = _discount(bigrams)
    size = len(set("".join(text))) + 1

    def p1(c):
        n = sum(follows.values())
        return max(follows[c] - d1, 0) / n + d1 * len(follows) / n / size

    def p2(a, c):
        of = {b: n for b, n in bigrams.items() if b[0] == a}
        n = sum(of.values())
        return max(of.get(a + c, 0) - d2, 0) / n + d2 * len(of) / n * p1(c)

    one = langid.Identifier({"x": model})
    for word in ("ab", "bb", "ba"):
        want = sum(math.log(p2(x, y)) for x, y in zip(" " + word, word + " "))
        assert one.word_scores([word])[0][0, 0] == pytest.approx(want, abs=1e-4)


def _discount(counts):
    n1, n2 = (sum(n == k for n in counts.values()) for k in (1, 2))
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def test_rejects_what_no_language_explains():
    learn = [("the cat sat on the mat and the dog ran to the house", "en"), ("le chat est sur la table et le chien dans la maison", "fr")] * 20
    made = langid.train(learn, learn)
    lang, score, _, rejected = made.predict(pa.array(["the dog sat on the house", "le chien sur la maison", "жщюъ эыф шчэ", "", "12 34"], type=pa.large_string()))
    assert lang == ["en", "fr", lang[2], "und", "und"] and list(score[3:]) == [0, 0]
    assert list(rejected) == [False, False, True, True, True]


def test_odd_and_empty(spark, odd_docs, no_docs):
    rows = langid.predictions(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (0, 1, 2))
    assert langid.predictions(no_docs).collect() == []
    assert all(r.lang_pred == "und" for r in langid.predictions(odd_docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect())
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and {0, 1, 2}.isdisjoint(r.doc_id for r in kept.collect())


def test_false_rejections_are_few_and_foreign_texts_are_caught(spark):
    """A left-out language is foreign to the models of the others."""
    docs = load(spark, "/root/testdata/sf0.1", "documents")
    rows = langid.predictions(docs).select("rejected").collect()
    assert sum(r.rejected for r in rows) <= 3 * langid.FALSE_REJECTION * len(rows)
    for lang in ("de", "en", "es", "fr"):
        made = langid.fitted(docs.where(f"lang <> '{lang}'"))
        found = langid.identified(docs.where(f"lang = '{lang}'"), made).select("rejected").collect()
        assert sum(r.rejected for r in found) >= 0.8 * len(found), lang


def test_one_odd_text_does_not_switch_rejection_off():
    rng = random.Random(3)
    words = {"en": "the cat sat on mat and dog ran to house".split(), "fr": "le chat est sur la table et chien dans maison".split()}
    learn = [(" ".join(rng.choices(words[lang], k=rng.randrange(4, 30))), lang) for lang in ("en", "fr") for _ in range(400)]
    made = langid.train(learn, [*learn, ("жщюъ эыф шчэ", "en")])
    assert made.predict(pa.array(["жщюъ эыф шчэ", "the dog sat on the mat"], type=pa.large_string()))[3].tolist() == [True, False]


def test_long_texts_are_learned_from(spark):
    rows = [(i, "plain words of english prose in the house " * 5, "en") for i in range(20)] + [(100 + i, "langer satz auf deutsch mit vielen worten " * 600, "long") for i in range(3)]
    made = langid.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert made.languages == ["en", "long"]

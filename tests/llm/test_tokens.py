import random
import unicodedata

import numpy as np
import pyarrow as pa

from stratalane.llm import tokens
from tests.llm.test_packing import tokenizer

TEXTS = [
    "", "Plain words, and MORE words.", "don't can't I'LL we've 's 't.", "a.b,c;d!?.. ...x ,,y", "H̱ ẖ É é Éa. ñ. Ǆ İ ß ſ", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>.", "1234. 5,6 ½. ²! Ⅷ?",
    "日本語。 テキスト, 한국어. 각", "é. é, combining̸. a̸! 🙂. 🙂🙂!?", "no\x1cbreak\x85here and\xa0there.", "tab\there\x0bline\x0c\r\nend.", "“quoted,” she said: (so) [there]!", "a_b-c.d/e:f;", "\x00nul. ​zero,",
]


def test_words_one_by_one_are_the_text():
    want = [x.ids for x in tokenizer().encode_batch(TEXTS, add_special_tokens=False)]
    for most in (10, 1000):
        encoder = tokens.WordEncoder(tokens.default_tokenizer(), most)
        assert encoder.folds
        for _ in range(3):
            ids, ends = encoder.encode(pa.array(TEXTS, type=pa.large_string()))
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
            more = [f"word{i} Word{i}." for i in range(40)]
            ids, ends = encoder.encode(pa.array(more, type=pa.large_string()))
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [x.ids for x in tokenizer().encode_batch(more, add_special_tokens=False)]


def test_what_is_seen_most_stays():
    encoder = tokens.WordEncoder(tokens.default_tokenizer(), 20)
    for i in range(30):
        encoder.encode(pa.array([f"often always w{i} v{i} u{i}"], type=pa.large_string()))
    assert {"often", "always"} <= set(encoder.known.slots) and len(encoder.known.slots) <= 20
    assert np.array_equal(encoder.encode(pa.array(["often"], type=pa.large_string()))[0], tokenizer().encode("often", add_special_tokens=False).ids)


ODD = "İıſKÅßẞΣςŉǰ\u0958\ufb2aﬁ\u0301\u0307\u0327\xa0\u2028\u200baBzéÉ19٣½日한한.,:;!?\n\t -_()😀𝒜\x85\x1cªºµǄǅΐ①"


def test_texts_of_odd_letters_are_as_the_library_has_them():
    rng = random.Random(5)
    parts = [*ODD, "<|endoftext|>", "<|startoftext|>", "<|", "|>", "'s", "'S", "don't", "...", "!?", "  ", "***", ",$$$", "'", "\"", "`", "|", "<", ">", "=", "~", "#", "%&", "/", "\\", "[", "]", "{", "}", "^", "+", "@"]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.8 else chr(rng.randrange(0x20, 0x3100)) for _ in range(rng.randrange(25))) for _ in range(20_000)]
    # Every letter and digit before a mark, as some have normal forms that end in one.
    letters = [chr(c) for c in range(0x80, 0x3100) if unicodedata.category(chr(c))[0] in "LN"]
    texts += [f"x{c}. {c}!? a" for c in letters]
    ids, ends = tokens.WordEncoder(tokens.default_tokenizer()).encode(pa.array(texts, type=pa.large_string()))
    want = [x.ids for x in tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want

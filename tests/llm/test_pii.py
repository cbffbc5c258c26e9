import hashlib
import re

import pytest

from stratalane.llm import pii
from stratalane.session import load

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    def passes(kind, m):
        digits = [int(c) for c in m if "0" <= c <= "9"]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), list(PATTERNS).index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]
    return sorted(found)


def said(spans):
    return ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in spans)


TRICKY = [
    "a@b.c@d.e and x@y then z@w.org.", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3.256", "4111 1111 1111 1111 4111-1111-1111-1112 79927398713",
    "+1 (555) 123-4567 +44 20 7946 0958. +1-", "@@@ a@@b.c +@ ....1.2.3..4", "é@b.co ünïcode a@b.cö 12345678901234567890123", "me@host.a-b.c--d", "+12345678901234567 4242 4242 4242 4242.",
]


def test_base_spans_of_tricky_texts():
    for text in TRICKY:
        assert [tuple(x) for x in pii.base_spans(text)] == brute(text), text


def test_documents_against_brute_force(spark, odd_docs, no_docs):
    for docs in (load(spark, "/root/testdata/sf0.01", "documents"), odd_docs):
        texts = {(r.doc_id, r.text) for r in docs.collect()}
        want = sorted(((d, hashlib.sha256(said(brute(t)).encode()).hexdigest()) for d, t in texts), key=repr)
        rows = pii.digests(docs.select("doc_id", "text").distinct()).collect()
        assert sorted(((r.doc_id, r.base_sha256) for r in rows), key=repr) == want
        by = {d: t for d, t in texts}
        for r in rows:
            spans = set(r.spans.split(",")) - {""}
            assert spans >= set(said(brute(by[r.doc_id])).split(",")) - {""}
            assert [sum(x.startswith(k + ":") for x in spans) for k in PATTERNS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
            assert r.n_spans == len(spans)
    assert pii.digests(no_docs).collect() == []


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("write to jane [at] mail (dot) org now", "email", "jane [at] mail (dot) org"),
        ("write to jane.doe at mail dot org now", "email", "jane.doe at mail dot org"),
        ("jаne@mаil.org", "email", "jаne@mаil.org"),  # Cyrillic а
        ("call plus one five five five one two three four five six seven today", "phone", "plus one five five five one two three four five six seven"),
        ("host 10 dot 0 dot 0 dot 7!", "ip", "10 dot 0 dot 0 dot 7"),
        ("card ４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("j​ane@ma​il.org", "email", "j​ane@ma​il.org"),
        ("mail to jane dot doe at mail dot org now", "email", "jane dot doe at mail dot org"),
        ("ask jane.doe at mail.org now", "email", "jane.doe at mail.org"),
        ("you can email john at example.com", "email", "john at example.com"),
        ("Contacts:\njohn at example.com\n", "email", "john at example.com"),
        ("card 4111 llll 1111 1111.", "card", "4111 llll 1111 1111"),
        ("card 41I1 1111 1111 l11l.", "card", "41I1 1111 1111 l11l"),
        ("host l92.168.O.1!", "ip", "l92.168.O.1"),
        ("host 192[.]168[.]0[.]1!", "ip", "192[.]168[.]0[.]1"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, spans = pii.all_spans(text)
    assert set(base) <= set(spans)
    assert found in [text[s:e] for s, k, e in spans if pii.KINDS[k] == kind]
    assert found not in pii.masked(text, spans)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("call four one five 555 0100 or plus one 415 five five five 0100 now", "phone", "plus one 415 five five five 0100"),
        ("card 4111 1111 1111 one one one one.", "card", "4111 1111 1111 one one one one"),
        ("card 4111 one, one one one 1111, one one one one.", "card", "4111 one, one one one 1111, one one one one"),
        ("host one nine two dot one six eight dot zero dot one!", "ip", "one nine two dot one six eight dot zero dot one"),
        ("host 192.168.zero.one!", "ip", "192.168.zero.one"),
        ("call +1 415 555 four four two two!", "phone", "+1 415 555 four four two two"),
        ("one ４１１１ １１１１ １１１１ １１１１ one", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_digits_spelled_in_part(text, kind, found):
    base, spans = pii.all_spans(text)
    assert found in [text[s:e] for s, k, e in spans if pii.KINDS[k] == kind]
    assert found not in pii.masked(text, spans)


@pytest.mark.parametrize(
    "text, kind",
    [
        ("jаne.doe@mail.org", "email"),  # Cyrillic а
        ("jane.doe@mail.exаmple.org", "email"),
        ("jane@mail.example [dot] org", "email"),
        ("+44 20 7946 095８", "phone"),
        ("+1 415 555 0100 four four", "phone"),
    ],
)
def test_a_fragment_does_not_stand_for_the_whole(text, kind):
    base, spans = pii.all_spans(text)
    assert set(base) <= set(spans) and (0, pii.KINDS.index(kind), len(text)) in spans
    assert pii.masked(f"a {text} b", pii.all_spans(f"a {text} b")[1]) == f"a {pii.MASKS[kind]} b"


@pytest.mark.parametrize("text", ["meet me at noon", "look at example dots", "one two three", "the dot com era at large", "version 1.2.3 at 10", "five six seven eight at nine", "look at example.com for more", "we met at home.", "Il a 10 lots", "in 1990 I saw 20 of 300"])
def test_clean_prose_has_no_spans(text):
    assert pii.all_spans(text) == ([], [])


def test_masking_keeps_the_rest(odd_docs):
    out = pii.mask_documents(odd_docs)
    assert out.columns == odd_docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, odd_docs.collect()))
    assert pii.masked("a x@y.zz b 1.2.3.4", pii.base_spans("a x@y.zz b 1.2.3.4")) == "a [EMAIL] b [IP]"


def test_memory_goes_by_disguises_not_by_characters():
    import tracemalloc

    text = "plain words – and no more\xa0of them " * 60_000 + "jane [at] mail [dot] org"
    tracemalloc.start()
    base, spans = pii.all_spans(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [text[s:e] for s, _, e in spans] == ["jane [at] mail [dot] org"] and peak < 20 * len(text)


def test_maps_follow_characters_back():
    """Every character of a normal form against a list of source stretches kept by character."""
    import random

    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("ab\u200bc") for _ in range(30))
        normal, kept = pii.Normal(text), [(i, i + 1) for i in range(30)]
        for _ in range(3):
            edits, at = [], 0
            while (at := at + rng.randrange(4)) < len(normal.text):
                stop = min(len(normal.text), at + 1 + rng.randrange(3))
                edits.append((at, stop, "xyz"[: rng.randrange(4)]))
                at = stop
            new, at = [], 0
            for s, e, put in edits:
                new += kept[at:s] + [(kept[s][0], kept[e - 1][1])] * len(put)
                at = e
            kept = new + kept[at:]
            normal.through(edits)
        assert len(kept) == len(normal.text) and all(normal.source(i, j) == (kept[i][0], kept[j - 1][1]) for i in range(len(kept)) for j in range(i + 1, len(kept) + 1))

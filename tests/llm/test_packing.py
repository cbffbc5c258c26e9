import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest

from stratalane.llm import packing
from stratalane.session import load


@cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text, end):
    return np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def checked(docs, length, **how):
    """Holds a packing against the documents; gives its rows by sequence."""
    rows = packing.packed(docs, length=length, **how).collect()
    sequences, of = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        of[r.doc_id].append(r)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(ids_of(r.text, 2))
    assert set(of) == set(texts)
    for doc, pieces in of.items():
        want = sorted((p[a:b].tobytes(), a) for p in texts[doc][:1] for a, b in [(r.start, r.start + r.length) for r in pieces]) if len(texts[doc]) == 1 else None
        assert sum(r.length for r in pieces) == sum(map(len, texts[doc]))
        if want:
            ids = texts[doc][0]
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for k, pieces in sequences.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or k == max(sequences) and at < length
    return sequences


@pytest.mark.parametrize("length", [64, 4096])
def test_every_id_lies_in_one_piece(odd_docs, length):
    checked(odd_docs, length)


def test_windows_keep_the_proportions(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents").repartition(5)
    sequences = checked(docs, 512)
    total = defaultdict(int)
    for pieces in sequences.values():
        for r in pieces:
            total[r.queue] += r.length
    whole = sum(total.values())
    for k, pieces in sequences.items():
        if k < len(sequences) - 1:
            for q, n in total.items():
                assert abs(sum(r.length for r in pieces if r.queue == q) - 512 * n / whole) < 2


def test_given_weights_hold_until_a_queue_is_dry(spark):
    rows = [(i, "word " * 99, "a" if i % 2 else "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sequences = checked(docs, 100, weights={"a": 0.8, "b": 0.2})
    for k in range(20):
        assert abs(sum(r.length for r in sequences[k] if r.queue == 0) - 80) <= 1
    assert {r.queue for r in sequences[len(sequences) - 1]} == {1}


@pytest.mark.parametrize("weights", [[300, 17, 1200, 64], [5, 999, 16, 16, 16], [1, 4000, 95], [1]])
def test_schedule_is_deficit_round_robin(weights):
    """A partition may start at any window with the counters that the rounds before it leave."""
    length, rounds = 1 << 7, 400
    scale = length * rounds
    plan = packing.Schedule([w * scale for w in weights], None, length)
    round_, sent = packing.DeficitRound(weights, length), np.zeros(len(weights), dtype=np.int64)
    for k in range(1, rounds + 1):
        now = round_.window()
        assert sum(now) == length and min(now) >= 0
        sent += now
        at = np.array([k * length])
        assert sent.tolist() == [int(plan.sent(q, at)[0][0]) for q in range(len(weights))]
        # The counters are entitlement less what was sent, and within one token.
        owed = [k * length * w - int(s) * sum(weights) for w, s in zip(weights, sent)]
        assert owed == round_.deficit and max(map(abs, owed)) < sum(weights)


def test_small_sources_keep_their_targets(spark):
    rows = [(i, "one two three", "large") for i in range(3000)] + [(3000 + i, "one two", f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sequences = checked(docs, 256)
    small = sorted(r.sequence_id for pieces in sequences.values() for r in pieces if r.doc_id >= 3000)
    assert len(set(small)) >= 40  # 180 of 12,180 tokens: all the way through, not at one end
    for k in range(3):
        at = sorted(r.sequence_id for pieces in sequences.values() for r in pieces if r.doc_id >= 3000 and r.doc_id % 3 == k)
        assert at[0] < 6 and at[-1] > len(sequences) - 7


def test_temperature_raises_small_sources(spark):
    rows = [(i, "word " * 99, "a" if i < 10 else "b") for i in range(100)]
    sequences = checked(spark.createDataFrame(rows, "doc_id long, text string, source string"), 100, temperature=0.5)
    assert abs(sum(r.length for r in sequences[0] if r.queue == 0) - 25) <= 1


def test_null_and_empty_source_are_two_queues(spark):
    rows = [(i, "word " * 99, (None, "")[i % 2]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert len({r.queue for pieces in checked(docs, 100).values() for r in pieces}) == 2
    checked(docs, 100, weights={None: 0.9, "": 0.1})


def test_schedule_step_by_step():
    for sizes, weights in (([7, 100, 31], None), ([50, 3, 20], [1, 5, 2]), ([1], None)):
        plan = packing.Schedule(sizes, weights, 8)
        x = np.arange(sum(sizes) + 1)
        sent = np.stack([plan.sent(q, x)[0] for q in range(len(sizes))])
        assert (sent.sum(axis=0) == x).all() and (np.diff(sent, axis=1) >= 0).all() and list(sent[:, -1]) == sizes


def test_many_small_sources_and_empty(spark, no_docs):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i}") for i in range(300)], "doc_id long, text string, source string")
    checked(docs, 64)
    assert packing.packed(no_docs).collect() == []

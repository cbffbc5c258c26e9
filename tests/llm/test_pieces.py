import random
from functools import cache

import numpy as np
import pyarrow as pa

from stratalane.llm import trie_counts, viterbi
from stratalane.llm.pieces import SPACE, Pieces, default_pieces, segments
from stratalane.session import load


@cache
def pieces():
    return Pieces(default_pieces())


def found_piece(word):
    node = pieces().trie
    for c in reversed(word):
        node = node.get(c)
        if node is None:
            return None
    return node.get("")


def brute(text):
    """Best segmentation of a whole text by quadratic dynamic programming, without cutting it into words."""
    chars = SPACE + text.replace(" ", SPACE) if text else ""
    best = [(0.0, [])]
    for j in range(1, len(chars) + 1):
        score, ids = -np.inf, None
        if not found_piece(chars[j - 1]):
            score, ids = best[j - 1][0] + pieces().unknown_score, best[j - 1][1] + pieces().spelled(chars[j - 1])
        for i in range(j - 1, max(-1, j - pieces().longest - 1), -1):
            if (hit := found_piece(chars[i:j])) and best[i][0] + hit[0] >= score:
                score, ids = best[i][0] + hit[0], best[i][1] + [hit[1]]
        best.append((score, ids))
    return best[-1][1]


TEXTS = ["", " ", "  two  blanks ", "hello world", "naïve café 日本語 🙂 end", "tab\there\nline", f"literal {SPACE} mark{SPACE}{SPACE}", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x", "internationalisation of misunderstandings", "endless" * 80]


def test_encoding_against_brute_force():
    encoder = viterbi.SentenceEncoder(default_pieces())
    ids, ends = encoder.encode(pa.array(TEXTS, type=pa.large_string()))
    for text, a, b in zip(TEXTS, ends, ends[1:]):
        assert ids[a:b].tolist() == brute(text), text
        if SPACE not in text:
            assert encoder.pieces.decode(ids[a:b]).decode() == text


def test_counts_agree_with_encoding():
    counter = trie_counts.TrieCounter(default_pieces())
    counts, words = counter.count(pa.array(TEXTS, type=pa.large_string()))
    assert counts.tolist() == [len(brute(t)) for t in TEXTS] and words.tolist() == [len(segments(t)) for t in TEXTS]
    small = trie_counts.TrieCounter(default_pieces(), most=5, nodes=20)  # what is forgotten changes nothing
    for _ in range(2):
        assert small.count(pa.array(TEXTS, type=pa.large_string()))[0].tolist() == counts.tolist()


def test_stream_commits_early_and_holds_a_window():
    rng = random.Random(3)
    text = SPACE + "".join(rng.choice("abcdeinorst") for _ in range(6000))
    taken, committed, most = 0, [], 0

    def chars():
        nonlocal taken
        for c in text:
            taken += 1
            yield c

    done = 0
    for run in viterbi.stream(chars(), pieces()):
        committed += run
        done += sum(len(pieces().text[i].decode().replace(" ", SPACE)) for i in run)
        most = max(most, taken - done)
    assert most <= 6 * pieces().longest
    assert committed == brute_word(text)


def brute_word(word):
    best = [(0.0, None, -1)]
    for j in range(1, len(word) + 1):
        top = (-np.inf, None, -1) if found_piece(word[j - 1]) else (best[j - 1][0] + pieces().unknown_score, j - 1, -1)
        for i in range(j - 1, max(-1, j - pieces().longest - 1), -1):
            if (hit := found_piece(word[i:j])) and best[i][0] + hit[0] >= top[0] - 1e-9:
                top = (best[i][0] + hit[0], i, hit[1])
        best.append(top)
    out, j = [], len(word)
    while j:
        out.append(best[j][2])
        j = best[j][1]
    return out[::-1]


def test_tables(spark, odd_docs, no_docs):
    for docs in (load(spark, "/root/testdata/sf0.001", "documents"), odd_docs):
        rows = viterbi.coded(docs).collect()
        counts = sorted(((r.doc_id, r.n_tokens) for r in trie_counts.token_counts(docs).collect()), key=repr)
        assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=repr) == counts and all(r.decodes for r in rows)
        back = viterbi.decoded(viterbi.coded(docs).select("doc_id", "ids"))
        assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    assert viterbi.coded(no_docs).collect() == [] and trie_counts.token_counts(no_docs).collect() == []


def test_trie_holds_each_prefix_once():
    trie = trie_counts.Trie(pieces())
    words = [SPACE + w for w in ("token", "tokens", "tokenize", "to", "tokens", "other")]
    ends = trie.insert(words)
    assert len(trie) == len({w[:k] for w in words for k in range(len(w) + 1)}) and ends[1] == ends[4]
    assert sorted(np.flatnonzero(list(trie.terminal))) == sorted(set(ends))
    assert [trie.tokens[e] for e in ends] == [len(brute(w[1:])) for w in words]


def test_whole_texts_through_the_stream():
    encoder, across = viterbi.SentenceEncoder(default_pieces()), viterbi.SentenceEncoder(default_pieces())
    across.pieces.splits = False  # as if pieces could lie across words: nothing is cut beforehand
    texts = [*TEXTS, "a long text of many words, " * 40]
    for made in (encoder, across):
        ids, ends = made.encode(pa.array(texts, type=pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [brute(t) for t in texts]
    for t in texts:
        runs = list(viterbi.stream(SPACE + t.replace(" ", SPACE) if t else "", pieces()))
        assert [i for run in runs for i in run] == brute(t)

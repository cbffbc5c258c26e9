import random
import re

import pytest
import xxhash

from stratalane.llm import simhash
from stratalane.session import load

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def components(rows):
    """rows: (doc_id, fp)."""
    root, least = brute_roots({f for _, f in rows}), {}
    for doc, fp in rows:
        if doc is not None:
            least[root[fp]] = min(doc, least.get(root[fp], doc))
    return sorted(((d, f"{f:016x}", least.get(root[f])) for d, f in rows), key=repr)


def found(docs):
    out = simhash.near_duplicates(docs)
    return sorted((tuple(r) for r in out.select("doc_id", simhash.hex16(out.fp), "component_id").collect()), key=repr)


def test_against_brute_force(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    want = components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
    assert len({c for *_, c in want}) < len(want)
    assert found(docs) == want


def test_odd_and_empty(odd_docs, no_docs):
    assert found(odd_docs) == components([(r.doc_id, brute_fingerprint(r.text)) for r in odd_docs.collect()])
    assert found(no_docs) == []
    kept = simhash.keep_one(odd_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd_docs.columns and len(ids) == len(set(ids)) and None in ids
    assert simhash.keep_one(no_docs).collect() == []


@pytest.mark.parametrize("chunk", [4096, 7])
def test_links_of_chains_and_crowds(spark, chunk):
    """Chains of near fingerprints and crowds that share most blocks, dealt in large and in tiny chunks."""
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(30):
            fps.add(at)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                at ^= 1 << b
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(30, 38)}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    nodes = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    got = {r.node: r.root for r in simhash.classes(simhash.near_links(nodes, chunk=chunk)).collect()}
    want = brute_roots(fps)
    same = lambda root: sorted(sorted(f for f in fps if root(f) == r) for r in {root(f) for f in fps})
    assert same(lambda f: got.get(signed[f], signed[f])) == same(want.get)


def test_classes_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1002), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.classes(links).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1001] == got[1002] == 1000

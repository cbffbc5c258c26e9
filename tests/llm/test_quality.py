import re
from collections import Counter

import duckdb

from stratalane.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_against_brute_force(odd_docs):
    want = Counter((r.doc_id, *measured(r.text)) for r in odd_docs.collect())
    rows = quality.verdicts(odd_docs).collect()
    assert want == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_sql(spark, odd_docs, same_as_sql):
    same_as_sql(lambda s, d: quality.verdicts(s.read.parquet(f"{d}/documents.parquet")), quality.SQL)
    db = duckdb.connect()
    db.register("documents", odd_docs.toArrow())
    want = Counter(db.execute(quality.SQL).fetchall())
    assert want == Counter(tuple(r) for r in quality.verdicts(odd_docs).collect())


def test_policies_and_ablation(odd_docs):
    rows = quality.ledger(odd_docs.select("doc_id", "text"))
    ledger = rows.collect()
    mask = quality.POLICIES["v2"]
    found = {r.rule: r for r in quality.ablation(rows, "v2").collect()}
    for k, (name, _) in enumerate(quality.RULES):
        if mask >> k & 1:
            bits = [r.fail_bits & mask for r in ledger]
            assert found[name].n_failed == sum(b >> k & 1 for b in bits)
            assert found[name].n_only_this == sum(b == 1 << k for b in bits)
            assert found[name].n_rejected_without == sum(b & ~(1 << k) != 0 for b in bits)
            assert found[name].n_kept_without == sum(b & ~(1 << k) == 0 for b in bits)
        else:
            assert name not in found
    kept = quality.keep(odd_docs, "v1")
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(not r.fail_bits & quality.POLICIES["v1"] for r in ledger)


def test_empty(no_docs):
    assert quality.verdicts(no_docs).collect() == [] and quality.keep(no_docs).collect() == []
    assert quality.ablation(quality.ledger(no_docs.select("doc_id", "text"))).collect() == []


def test_no_python_on_executors(odd_docs):
    plan = quality.verdicts(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan.split("Scan")[0].replace("Exchange RoundRobin", "")

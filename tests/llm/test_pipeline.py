import corpus_pipeline
from pyspark.sql import functions as F

from stratalane.llm import langid, pii, quality
from stratalane.session import load
from tests.llm.test_quality import measured
from tests.llm.test_simhash import brute_fingerprint, brute_roots

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = load(spark, SF, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        before, after = ({r.doc_id: r for r in df.collect()} for df in (docs, out))
        gone = set(before) - set(after)
        if name == "quality rules":
            n = {d: measured(r.text) for d, r in before.items()}
            assert gone >= {d for d, m in n.items() if m[0] < 20 or 100 * m[4] > 30 * m[0]}
        elif name == "SimHash near-dedup":
            fps = {d: brute_fingerprint(r.text) for d, r in before.items()}
            root = brute_roots(set(fps.values()))
            least = {}
            for d, f in fps.items():
                least[root[f]] = min(d, least.get(root[f], d))
            assert set(after) == set(least.values())
        elif name == "PII":
            assert not gone and all(r.text == pii.masked(before[d].text, pii.all_spans(before[d].text)[1]) for d, r in after.items())
        elif name == "language ID":
            made = {r.doc_id for r in langid.identified(docs, langid.fitted(docs, langid.remainder() != 2)).where("rejected").collect()}
            assert gone == made
        seen.append(len(gone))
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    assert seen[0] and seen[2]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    kept = quality.keep(load(spark, SF, "documents"))
    found = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert found and found <= {r.doc_id for r in kept.select("doc_id").collect()}
    assert rows.agg(F.max(F.col("offset") + F.col("length"))).first()[0] == 4096


def test_odd_and_empty(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()

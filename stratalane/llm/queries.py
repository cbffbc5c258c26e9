"""The registered queries of the corpus operators, each over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalane.llm import ann, langid, packing, pii, quality, simhash, token_files, trie_counts, viterbi, warc
from stratalane.session import load

#: Sources are mixed by this power of their sizes.
MIXTURE = 0.7


def op1_language_id(spark, sf_dir):
    return langid.predictions(load(spark, sf_dir, "documents"))


def op2_quality_ledger(spark, sf_dir):
    return quality.verdicts(load(spark, sf_dir, "documents"))


def op3_kmeans_tree(spark, sf_dir):
    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_simhash_components(spark, sf_dir):
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(found.fp).alias("fingerprint"), "component_id")


def op5_warc_revisits(spark, sf_dir):
    return warc.digest(load(spark, sf_dir, "pages"))


def op6_trie_token_counts(spark, sf_dir):
    return trie_counts.token_counts(load(spark, sf_dir, "documents"))


def op7_sentencepiece_viterbi(spark, sf_dir):
    return viterbi.coded(load(spark, sf_dir, "documents"), keep_ids=False)


def op8_pii_spans(spark, sf_dir):
    return pii.digests(load(spark, sf_dir, "documents"))


def op9_mixture_packing(spark, sf_dir):
    return packing.packed(load(spark, sf_dir, "documents"), temperature=MIXTURE)


def op10_token_files(spark, sf_dir):
    return token_files.round_trip(load(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_quality_ledger, op3_kmeans_tree, op4_simhash_components, op5_warc_revisits,
        op6_trie_token_counts, op7_sentencepiece_viterbi, op8_pii_spans, op9_mixture_packing, op10_token_files,
    )
}

ORACLE = {"op2_quality_ledger": quality.SQL, "op5_warc_revisits": warc.SQL}

"""Genotypes and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalane.functions import sequences as seqs
from stratalane.session import written


def genotype_matrix(calls: DataFrame, variant: str, sample: str, genotype: str) -> DataFrame:
    """(a, b, n) for samples a <= b: heterozygous calls where a = b, differing genotypes otherwise.

    Pairs are made within a variant's own array of samples, so nothing is joined and sums are combined map-side.
    """
    g = F.array_sort(seqs.alleles(genotype))
    one = calls.groupBy(variant).agg(F.sort_array(F.collect_list(F.struct(F.col(sample).alias("s"), g.alias("g")))).alias("x"))
    pairs = one.select(F.posexplode("x").alias("i", "p"), "x").select("p", F.explode(F.filter("x", lambda q, k: k >= F.col("i"))).alias("q"))
    het = F.size(F.array_distinct(F.col("p.g"))) > 1
    n = F.when(F.col("p.s") == F.col("q.s"), het).otherwise(F.col("p.g") != F.col("q.g"))
    return pairs.groupBy(F.col("p.s").alias("a"), F.col("q.s").alias("b")).agg(F.sum(n.cast("int")).alias("n"))


def calls(table: DataFrame, variant: str, sample: str, genotype: str, bases: Column) -> DataFrame:
    """(sample, calls): a sample's ambiguity codes in variant order as one string; bases are the alleles by number."""
    code = seqs.iupac(F.transform(seqs.alleles(genotype), lambda a: F.get(bases, a)))
    rows = table.select(sample, F.struct(F.col(variant).alias("v"), code.alias("c")).alias("x"))
    return rows.groupBy(sample).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["c"]), "").alias("calls"))


def _first_of(genes: DataFrame) -> DataFrame:
    """(chrom, s, e, gene, gs): disjoint stretches and the first gene, by (gs, gene), of those (chrom, s, e, gs, gene) over each.

    Starts rise with gs, so a gene is the first one exactly where it goes on beyond the ends of all before it.
    """
    from stratalane.operators.intervals import running

    rows = running(genes.where("s <= e"), ("chrom",), ("s", "gene"), {"__far": ("max", "e")})
    return rows.where("__far IS NULL OR e > __far").select("chrom", F.greatest(F.col("s"), F.coalesce(F.col("__far") + 1, F.col("s"))).alias("s"), "e", "gs", "gene")


def annotated(variants: DataFrame, genes: DataFrame, promoter: int = 500) -> DataFrame:
    """(id, gene, place) of point variants (id, chrom, pos): in the first gene that holds them, else in a promoter, else null.

    Asked of distinct places: genes are reduced to disjoint stretches of which one at most holds a place, promoters to one
    a stretch, and those are asked only of places in no gene, so that work grows with genes and places, not their pairs.
    """
    from stratalane.operators.intervals import overlap_join

    plus = F.coalesce(F.col("strand") == "+", F.lit(False))
    body = genes.where("chrom IS NOT NULL").select("chrom", "s", "e", F.col("s").alias("gs"), "gene").groupBy("chrom", "s", "e", "gs").agg(F.min("gene").alias("gene"))
    before = (F.col("s") - promoter, F.least(F.col("s") - 1, F.col("e")))
    after = (F.greatest(F.col("s"), F.col("e") + 1), F.col("e") + promoter)
    side = genes.where("chrom IS NOT NULL").select("chrom", F.when(plus, before[0]).otherwise(after[0]).alias("s"), F.when(plus, before[1]).otherwise(after[1]).alias("e"), F.struct(F.col("s").alias("gs"), "gene").alias("g"))
    side = side.where("s <= e").groupBy("chrom", "s", "e").agg(F.min("g").alias("g")).select("chrom", "s", "e", "g.gs", "g.gene")
    places = variants.select("chrom", F.col("pos").alias("s"), F.col("pos").alias("e")).where("chrom IS NOT NULL AND s IS NOT NULL").distinct()
    answer = lambda hits, k: hits.groupBy(F.col("chrom1").alias("chrom"), F.col("s1").alias("pos")).agg(F.min(F.struct(F.lit(k).alias("k"), F.col("gs2").alias("gs"), F.col("gene2").alias("gene"))).alias("b"))
    inside = written(answer(overlap_join(places, _first_of(body)), 0), "inside")
    rest = places.join(inside.select("chrom", F.col("pos").alias("s")), ["chrom", "s"], "left_anti").select("chrom", "s", "e")
    best = inside.unionByName(answer(overlap_join(rest, side), 1))
    found = variants.join(best, ["chrom", "pos"]).groupBy("id").agg(F.min("b").alias("b"))
    return variants.select("id").join(found, "id", "left").select("id", F.col("b.gene").alias("gene"), F.when(F.col("b.k") == 0, "gene").when(F.col("b.k") == 1, "promoter").alias("place"))

"""Reads and sequences as tables: trimming, demultiplexing, pairing, approximate search, primers, statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import gcd

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalane.functions import sequences as seqs


def quality_trimmed(reads: DataFrame, shortest: int = 1, longest: int | None = None, drop_cut: bool = False, no_gaps: bool = False, **rule) -> DataFrame:
    """reads (seq, qual) cut to what their qualities allow; drop_cut drops reads that lose anything, no_gaps those with an N."""
    n = F.col("__n") if longest is None else F.least(F.col("__n"), F.lit(longest))
    rows = reads.withColumn("__n", seqs.kept_length("qual", **rule)).withColumn("__n", n).where(F.col("__n") >= shortest)
    if drop_cut:
        rows = rows.where(F.col("__n") == F.length("seq"))
    rows = rows.withColumns({c: F.substr(F.col(c), F.lit(1), F.col("__n")) for c in ("seq", "qual")}).drop("__n")
    return rows.where(~F.col("seq").contains("N")) if no_gaps else rows


def pair_trimmed(reads: DataFrame, pair: str, **how) -> DataFrame:
    """Trimmed reads of pairs of which both mates pass; mates are counted by pair, not matched by their place."""
    rows = quality_trimmed(reads, **how)
    both = rows.groupBy(pair).count().where("count = 2").select(pair)
    return rows.join(both, pair, "left_semi").select(reads.columns)


def closest_barcodes(barcodes: DataFrame, name: str = "name", code: str = "code") -> DataFrame:
    """For each barcode the least distance to another one, and which that is. A list of barcodes is small by its nature."""
    a, b = barcodes.select(F.col(name).alias("name"), F.col(code).alias("code")), barcodes.select(F.col(name).alias("other"), F.col(code).alias("__code"))
    pairs = a.join(F.broadcast(b), F.col("name") != F.col("other")).withColumn("d", seqs.hamming("code", "__code"))
    return pairs.groupBy("name").agg(F.min("d").alias("distance"), F.min_by("other", F.struct("d", "other")).alias("closest"))


def demultiplexed(reads: DataFrame, barcodes: Sequence[tuple[str, str, int]], mismatches: int = 1) -> DataFrame:
    """reads with `sample` (null if their beginning matches no barcode or several) and the barcode's trim taken off.

    barcodes: (code, sample, bases to trim), all codes of one length. A sample sheet is an argument, not a table, so each
    read is compared with all of it in place.
    """
    size = len(barcodes[0][0])
    head = F.substr(F.col("seq"), F.lit(1), F.lit(size))
    listed = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(s).alias("sample"), F.lit(t).alias("trim")) for c, s, t in barcodes))
    rows = reads.withColumn("__hits", F.filter(listed, lambda b: (F.length("seq") > size) & (seqs.hamming(head, b["code"]) <= mismatches)))
    one = (F.size("__hits") == 1) & (F.length("seq") > F.get("__hits", F.lit(0))["trim"])
    hit = F.get("__hits", F.lit(0))
    out = {c: F.when(one, F.substr(F.col(c), hit["trim"] + 1)).otherwise(F.col(c)) for c in ("seq", "qual") if c in reads.columns}
    return rows.withColumn("sample", F.when(one, hit["sample"])).withColumns(out).drop("__hits")


def approximate_distance(texts: pd.Series, pattern: str) -> pd.Series:
    """Least edit distance of the pattern to any stretch of each text, by dynamic programming over all texts at once."""
    import numpy as np

    n = len(texts)
    lengths = texts.str.len().fillna(0).astype(int).to_numpy()
    most = int(lengths.max()) if n else 0
    chars = np.zeros((most, n), dtype=np.uint32)
    for i, t in enumerate(texts):
        if t:
            chars[: len(t), i] = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
    column = np.repeat(np.arange(len(pattern) + 1)[:, None], n, axis=1)
    best = np.full(n, len(pattern))
    codes = [ord(c) for c in pattern]
    for j in range(most):
        before = column[0].copy()
        column[0] = 0
        for i, code in enumerate(codes, 1):
            kept = column[i].copy()
            column[i] = np.minimum(np.minimum(column[i], column[i - 1]) + 1, before + (chars[j] != code))
            before = kept
        best = np.where(j < lengths, np.minimum(best, column[-1]), best)
    return pd.Series(best, index=texts.index)


def containing(reads: DataFrame, pattern: str, edits: int = 0, either_strand: bool = False, without: bool = False, seq: str = "seq", substitutions: bool = False) -> DataFrame:
    """Reads with a stretch within `edits` edits of the pattern, in either case; with `substitutions` no other edits count.
    Exact search and substitutions are built-in expressions."""
    turned = pattern[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
    wanted = [pattern.lower()] + [turned.lower()] * either_strand
    text = F.lower(seq)
    if edits == 0:
        hit = F.lit(False)
        for p in wanted:
            hit = hit | F.coalesce(F.contains(text, F.lit(p)), F.lit(False))
    elif substitutions:
        last = F.length(text) - len(pattern)
        starts = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
        hit = F.lit(False)
        for p in wanted:
            near = lambda i: seqs.hamming(F.substr(text, i, F.lit(len(pattern))), F.lit(p)) <= edits  # noqa: B023, E731
            hit = hit | F.coalesce(F.exists(starts, near), F.lit(False))
    else:

        @F.pandas_udf("boolean")
        def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                found = pd.Series(False, index=s.index)
                for p in wanted:
                    found |= approximate_distance(s, p) <= edits
                yield found

        hit = near(text)
    return reads.where(~hit if without else hit)


def primer_products(primers: DataFrame, library: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """(primer, match_id, fragment): where primers (primer, fwd, rev) amplify a library sequence (id, seq), on either strand.

    A primer list is small, so it goes along with the library, which is read once and never multiplied by a shuffle.
    Primers without a product have one row of nulls.
    """
    lib = library if isinstance(library, DataFrame) else primers.sparkSession.createDataFrame(list(library), "id string, seq string")
    ends = primers.select("primer", F.upper("fwd").alias("f"), seqs.reverse_complement(F.upper("rev")).alias("r"))
    met = lib.select("id", F.upper("seq").alias("w")).withColumn("c", seqs.reverse_complement("w")).join(F.broadcast(ends), (F.col("w").contains(F.col("f")) & F.col("w").contains(F.col("r"))) | (F.col("c").contains(F.col("f")) & F.col("c").contains(F.col("r"))))

    def places(s: str):
        first = F.instr(F.col(s), F.col("f"))
        back = F.instr(F.reverse(F.col(s)), F.reverse(F.col("r")))
        return first, F.when(back > 0, F.length(s) - back - F.length("r") + 2).otherwise(0)

    wf, wr = places("w")
    cf, cr = places("c")
    on_w = (wf > 0) & (wr > 0)
    first, last = F.when(on_w, wf).otherwise(cf), F.when(on_w, wr).otherwise(cr)
    hits = met.select("primer", F.col("id").alias("match_id"), first.alias("a"), last.alias("b"), F.length("f").alias("nf"), F.length("r").alias("nr")).where("a > 0 AND b > 0 AND a < b")
    found = hits.select("primer", "match_id", (F.col("b") + F.col("nr") - F.col("a")).alias("fragment"))
    return primers.select("primer").join(found, "primer", "left")


def pairing(first: DataFrame, second: DataFrame, name: str = "name") -> DataFrame:
    """(pair, state): paired, or which mate stands alone; names are compared without their mate numbers."""
    a = first.select(seqs.standard_header(name).alias("pair"), F.lit(1).alias("one"))
    b = second.select(seqs.standard_header(name).alias("pair"), F.lit(1).alias("two"))
    state = F.when(F.col("one").isNotNull() & F.col("two").isNotNull(), "paired").when(F.col("one").isNotNull(), "only_first").otherwise("only_second")
    return a.join(b, "pair", "full").select("pair", state.alias("state"))


def insert_sizes(mates: DataFrame, name: str, pos: str, length: str) -> DataFrame:
    """(name, size) of reads with two mates: distance of their starts plus the read length."""
    return mates.groupBy(name).agg(F.count("*").alias("__n"), (F.max(pos) - F.min(pos) + F.max(length)).alias("size")).where("__n = 2").drop("__n")


def pieces(df: DataFrame, key: str, seq: str, size: int, overlap: int, at_gaps: bool = False) -> DataFrame:
    """(key, fragment, start, stop, piece): overlapping pieces of each sequence, or of its contigs apart at runs of N."""
    unit, contigs = gcd(size, size - overlap), F.split(F.col(seq), "[nN]+") if at_gaps else F.array(F.col(seq))
    rows = df.select(key, F.posexplode(contigs).alias("fragment", "__s"))
    cut = lambda parts: F.transform(seqs.shreds("__s", size, overlap), lambda s: F.struct(s.alias("at"), F.array_join(F.slice(parts, (s / unit).cast("int") + 1, size // unit), "").alias("piece")))
    rows = rows.select(key, "fragment", F.length("__s").alias("__n"), F.explode(F.flatten(F.transform(F.array(seqs.chunks("__s", unit)), cut))).alias("x"))
    return rows.select(key, "fragment", (F.col("x.at") + 1).alias("start"), F.least(F.col("x.at") + size, "__n").alias("stop"), F.col("x.piece").alias("piece"))


def length_statistics(df: DataFrame, length: str, least: int = 150, shares: dict[str, float] | None = None) -> DataFrame:
    """One row: count, total, min, max, mean, median, and the lengths at which the ascending running total is closest to a share.

    Lengths are first counted, so that the running total is over distinct lengths only.
    """
    shares = shares or {"n90": 0.1, "n50": 0.5, "n10": 0.9}
    counts = df.where(F.col(length) >= least).groupBy(F.col(length).cast("long").alias("n")).agg(F.count("*").alias("k"))
    rows = counts.withColumn("upto", F.sum(F.col("n") * F.col("k")).over(Window.orderBy("n"))).withColumn("all", F.sum(F.col("n") * F.col("k")).over(Window.partitionBy()))
    # The closest running total within a run of equal lengths is the nearest multiple to the target.
    before = F.col("upto") - F.col("n") * F.col("k")

    def off(share: float):
        target = F.col("all") * share
        step = F.greatest(F.lit(1), F.least(F.col("k"), F.round((target - before) / F.col("n"))))
        return F.abs(before + step * F.col("n") - target)

    total, many = F.sum(F.col("n") * F.col("k")), F.sum("k")
    return rows.agg(many.alias("count"), total.alias("total"), F.min("n").alias("min"), F.max("n").alias("max"), (total / many).alias("mean"), F.expr("percentile(n, 0.5, k)").alias("median"), *(F.min_by("n", F.struct(off(s), F.col("n"))).alias(name) for name, s in shares.items()))

"""Annotations: attribute bags, gene and transcript rows, blocks, flanks, and conversions between their layouts.

A bag is kept as array<struct<k, v>> in its own order, with one entry a value, so that it can be written back as it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalane.operators.intervals import subtract

BAG = "array<struct<k:string,v:string>>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parsed(attrs: Column | str) -> Column:
    """A bag from `key "value"; ...` or `key=value;...`."""
    entry = F.lit(r'([^\s;="]+)(?:[\s=]+("[^"]*"|[^;"]*))?')
    keys, said = (F.regexp_extract_all(_c(attrs), entry, F.lit(i)) for i in (1, 2))
    # A value in quotes has none within, and one without quotes has none at all.
    return F.zip_with(keys, said, lambda k, v: F.struct(k.alias("k"), F.replace(F.trim(v), F.lit('"'), F.lit("")).alias("v")))


def written_bag(bag: Column | str, bare: Sequence[str] = ("exon_number",)) -> Column:
    """A bag as `key "value"; ...` with empty values left out."""
    some = F.filter(_c(bag), lambda x: x["v"] != "")
    return F.array_join(F.transform(some, lambda x: F.concat(x["k"], F.lit(" "), F.when(x["k"].isin(*bare), x["v"]).otherwise(F.concat(F.lit('"'), x["v"], F.lit('"'))), F.lit(";"))), " ")


def values(bag: Column | str, key: str) -> Column:
    return F.transform(F.filter(_c(bag), lambda x: x["k"] == key), lambda x: x["v"])


def value(bag: Column | str, key: str) -> Column:
    return F.get(values(bag, key), F.lit(0))


def counted(rows: DataFrame, bag: str, keys: Sequence[str], gene: str = "gene_id", transcript: str = "transcript_id") -> DataFrame:
    """Rows, distinct transcripts and distinct genes by the (joined) values of some attributes."""
    by = [F.array_join(values(bag, k), ",").alias(k) for k in keys]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(value(bag, transcript)).alias("transcripts"), F.count_distinct(value(bag, gene)).alias("genes"))


def filtered(rows: DataFrame, bag: str, key: str, ids: DataFrame, id_column: str, anti: bool = False) -> DataFrame:
    """Rows with an attribute among the ids; those without the attribute count as not among them."""
    id = F.col(id_column).cast("string")
    # A struct is never null, so that no filter on the value makes Spark parse the bag a second time.
    wanted = ids.where(id.isNotNull()).select(F.struct(id.alias("id")).alias("__id")).distinct()
    return rows.withColumn("__id", F.struct(value(bag, key).alias("id"))).join(wanted, "__id", "left_anti" if anti else "left_semi").select(rows.columns)


def set_attribute(rows: DataFrame, bag: str, match: str, table: DataFrame, key: str, new: str, target: str, default: str | None = None) -> DataFrame:
    """Sets `target` from a table by the value of `match`; rows without a match keep theirs, or get the default if they have none."""
    lut = table.select(F.col(key).cast("string").alias("__m"), F.col(new).cast("string").alias("__new"))
    met = rows.withColumn("__m", value(bag, match)).join(lut, "__m", "left")
    has = F.exists(bag, lambda x: x["k"] == target)
    set_ = F.coalesce("__new", F.when(~has, F.lit(default)) if default is not None else F.lit(None).cast("string"))
    entry = F.array(F.struct(F.lit(target).alias("k"), set_.alias("v")))
    first = F.array_position(F.transform(bag, lambda x: x["k"]), target)
    others = F.filter(bag, lambda x: x["k"] != target)
    # A replaced attribute stays in its place, an added one comes last.
    before = F.filter(bag, lambda x, i: (i < first - 1) & (x["k"] != target))
    after = F.filter(bag, lambda x, i: (i > first - 1) & (x["k"] != target))
    changed = F.when(set_.isNull(), F.col(bag)).when(has, F.concat(before, entry, after)).otherwise(F.concat(others, entry))
    return met.withColumn(bag, changed.cast(BAG)).select(rows.columns)


def compound_id(bag: Column | str, keys: Sequence[str], sep: str = "|") -> Column:
    """The first values of some attributes joined; null where all are missing."""
    parts = F.array_compact(F.array(*(value(bag, k) for k in keys)))
    return F.when(F.size(parts) > 0, F.array_join(parts, sep))


def transcripts(exons: DataFrame, by: str = "tx") -> DataFrame:
    """(by, chrom, strand, s, e, n, sizes, starts) from exon rows: one row a transcript with its blocks in order; half-open."""
    blocks = F.sort_array(F.collect_set(F.struct("s", "e")))
    rows = exons.groupBy(by, "chrom", "strand").agg(F.min("s").alias("s"), F.max("e").alias("e"), blocks.alias("b"))
    return rows.select(by, "chrom", "strand", "s", "e", F.size("b").alias("n"), F.transform("b", lambda x: x["e"] - x["s"]).alias("sizes"), F.transform("b", lambda x: x["s"] - F.col("s")).alias("starts"))


def exons(rows: DataFrame, keep: Sequence[str] = ("tx", "chrom", "strand")) -> DataFrame:
    """The blocks of transcript rows again, with their ordinal in the direction of transcription."""
    out = rows.select(*keep, "n", F.col("s").alias("__s"), F.posexplode(F.arrays_zip("starts", "sizes")).alias("i", "b"))
    ordinal = F.when(F.col("strand") == "-", F.col("n") - F.col("i")).otherwise(F.col("i") + 1)
    return out.select(*keep, (F.col("__s") + F.col("b.starts")).alias("s"), (F.col("__s") + F.col("b.starts") + F.col("b.sizes")).alias("e"), ordinal.alias("ordinal"))


def introns(rows: DataFrame, keep: Sequence[str] = ("tx", "chrom", "strand")) -> DataFrame:
    """What lies between neighbouring blocks."""
    stop = F.transform(F.arrays_zip("starts", "sizes"), lambda b: F.col("s") + b["starts"] + b["sizes"])
    start = F.transform("starts", lambda b: F.col("s") + b)
    pairs = F.zip_with(F.slice(stop, 1, F.greatest(F.col("n") - 1, F.lit(0))), F.slice(start, 2, F.greatest(F.col("n") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("s"), b.alias("e")))
    return rows.select(*keep, F.posexplode(pairs).alias("i", "x")).select(*keep, (F.col("i") + 1).alias("ordinal"), "x.s", "x.e")


def coding(rows: DataFrame, keep: Sequence[str] = ("tx", "chrom", "strand")) -> DataFrame:
    """Coding pieces between thick_start and thick_end with their reading frames: (3 - bases before mod 3) mod 3."""
    pieces = F.filter(
        F.transform(F.arrays_zip("starts", "sizes"), lambda b: F.struct(F.greatest(F.col("s") + b["starts"], F.col("thick_start")).alias("s"), F.least(F.col("s") + b["starts"] + b["sizes"], F.col("thick_end")).alias("e"))),
        lambda p: p["e"] > p["s"],
    )
    walk = F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("done"), F.array().cast("array<struct<s:bigint,e:bigint,frame:int>>").alias("out")), lambda a, p: F.struct(
        (a["done"] + p["e"] - p["s"]).alias("done"), F.concat(a["out"], F.array(F.struct(p["s"].alias("s"), p["e"].alias("e"), ((3 - a["done"] % 3) % 3).cast("int").alias("frame")))).alias("out")))
    return rows.select(*keep, F.posexplode(walk["out"]).alias("i", "p")).select(*keep, "i", "p.s", "p.e", "p.frame")


def without_stop(cds: DataFrame, by: str = "tx") -> DataFrame:
    """Coding pieces less the last three bases of each transcript, which may reach into the piece before."""
    order = Window.partitionBy(by).orderBy(F.when(F.col("strand") == "-", F.col("s")).otherwise(-F.col("e")))
    width = F.col("e") - F.col("s")
    rows = cds.withColumn("__before", F.coalesce(F.sum(width).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    take = F.greatest(F.lit(0), F.least(3 - F.col("__before"), width))
    minus = F.col("strand") == "-"
    return rows.withColumns({"s": F.when(minus, F.col("s") + take).otherwise(F.col("s")), "e": F.when(minus, F.col("e")).otherwise(F.col("e") - take)}).where("e > s").drop("__before")


def splice_chains(rows: DataFrame, name: str = "tx") -> DataFrame:
    """(chain, n, names): transcripts of one chain of introns; those of one exon have none."""
    ends = F.flatten(F.transform(F.arrays_zip("starts", "sizes"), lambda b: F.array(F.col("s") + b["starts"], F.col("s") + b["starts"] + b["sizes"])))
    chain = F.concat_ws(":", F.col("chrom").cast("string"), F.array_join(F.slice(ends, 2, F.size(ends) - 2), "-"), "strand")
    return rows.where("n > 1").groupBy(chain.alias("chain")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col(name).cast("string"))), ",").alias("names"))


def terminal_exons(table: DataFrame, by: str = "tx", last: bool = False) -> DataFrame:
    """The first (or last) exon of each feature in the direction of transcription, the longest of several; none for those of one exon."""
    left = (F.col("strand") == "+") != F.lit(last)
    place = F.when(left, F.struct(F.col("s").alias("a"), (-F.col("e")).alias("b"))).otherwise(F.struct((-F.col("e")).alias("a"), F.col("s").alias("b")))
    out = table.groupBy(by).agg(F.count_distinct("s", "e").alias("__n"), F.min_by(F.struct("chrom", "s", "e", "strand"), place).alias("x"))
    return out.where("__n > 1").select(by, "x.*")


def gene_regions(table: DataFrame, gene: str = "gene", tx: str = "tx", trim5: int = 0, trim3: int = 0, least: int = 500) -> DataFrame:
    """(gene, chrom, strand, s, e, exons): outer bounds, trimmed by strand, with the most exons of any transcript; of at least `least` bases."""
    per = table.groupBy(gene, tx, "chrom", "strand").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"))
    rows = per.groupBy(gene, "chrom", "strand").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("exons"))
    plus = F.col("strand") == "+"
    rows = rows.withColumns({"s": F.col("s") + F.when(plus, trim5).otherwise(trim3), "e": F.col("e") - F.when(plus, trim3).otherwise(trim5)})
    return rows.where(F.col("e") - F.col("s") >= least)


def merged_features(table: DataFrame, name: str, strict: bool = True) -> DataFrame:
    """(name, chrom, strand, s, e, score) of features by name; with strict, a name on two strands or chromosomes is an error."""
    out = table.groupBy(name).agg(F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("score").alias("score"), ((F.min("chrom") != F.max("chrom")) | (F.min("strand") != F.max("strand"))).alias("__torn"))
    if strict and (torn := out.where("__torn").limit(3).collect()):
        raise ValueError(f"on several strands or chromosomes: {[r[0] for r in torn]}")
    return out.drop("__torn")


def gene_flanks(genes: DataFrame, flank: int, buffer: int = 0) -> DataFrame:
    """(gene, chrom, strand, side, s, e): the stretches 5' and 3' of genes, half-open and clamped to 0."""
    plus = F.col("strand") == "+"
    side = F.explode(F.array(
        F.struct(F.when(plus, "5").otherwise("3").alias("side"), F.greatest(F.lit(0), F.col("s") - buffer - flank).alias("s"), F.greatest(F.lit(0), F.col("s") - buffer).alias("e")),
        F.struct(F.when(plus, "3").otherwise("5").alias("side"), (F.col("e") + buffer).alias("s"), (F.col("e") + buffer + flank).alias("e")),
    ))
    return genes.select("gene", "chrom", "strand", side.alias("x")).select("gene", "chrom", "strand", "x.*").where("e > s")


def flanks_kept(genes: DataFrame, side: str, size: int, buffer: int = 0, least: int = 1, blockers: DataFrame | None = None, same_strand: bool = False) -> DataFrame:
    """(gene, chrom, strand, s, e): what genes, or other blockers as exons, leave of one flank (5 or 3) of each gene.

    Coordinates are inclusive; a flank runs from buffer + 1 to size + 1 positions off the gene, and pieces span `least` at least.
    """
    after = (F.col("strand") == "+") == F.lit(side == "3")
    s = F.when(after, F.col("e") + 1 + buffer).otherwise(F.col("s") - size - 1)
    e = F.when(after, F.col("e") + size + 1).otherwise(F.col("s") - 1 - buffer)
    rows = genes.select("gene", "chrom", "strand", F.greatest(s, F.lit(1)).alias("s"), F.greatest(e, F.lit(1)).alias("e")).where(F.col("e") - F.col("s") >= least)
    by = ["chrom", "strand"] if same_strand else ["chrom"]
    taken = (genes if blockers is None else blockers).select(*by, (F.col("s") - 1).alias("s"), "e")
    return subtract(rows.withColumn("s", F.col("s") - 1), taken, by, "gene", least + 1).withColumn("s", F.col("s") + 1)


def transcript_ends(table: DataFrame, pad: int = 0) -> DataFrame:
    """table (chrom, s, e, strand, score) with the first and last base by strand, padded and clamped, and a score of 0 to 1000."""
    plus = F.col("strand") == "+"
    tss, tts = F.when(plus, F.col("s")).otherwise(F.col("e")), F.when(plus, F.col("e")).otherwise(F.col("s"))
    around = lambda x: F.struct(F.greatest(F.lit(0), x - pad).alias("s"), (x + pad + 1).alias("e"))
    return table.withColumns({"tss": around(tss), "tts": around(tts), "score": F.least(F.lit(1000), F.greatest(F.lit(0), F.col("score")))})


def bed_violations(bed: DataFrame) -> DataFrame:
    """(row columns, problem): a row for each rule that a BED row breaks."""
    num = lambda c: F.expr(f"try_cast({c} AS bigint)")
    s, e = num("start"), num("end")
    rules = [
        (s.isNull() | e.isNull(), "start or end is no number"), (s > e, "start exceeds end"), (~F.col("strand").isin("+", "-", "."), "unknown strand"),
        (num("thick_start").isNotNull() & ((num("thick_start") < s) | (num("thick_end") > e)), "thick part out of bounds"),
        (num("block_count").isNotNull() & ((F.size(F.filter(F.split("block_sizes", ","), lambda x: x != "")) != num("block_count")) | (F.size(F.filter(F.split("block_starts", ","), lambda x: x != "")) != num("block_count"))), "block count"),
        (num("block_count").isNotNull() & (s + F.try_element_at(F.filter(F.split("block_starts", ","), lambda x: x != ""), F.lit(-1)).try_cast("bigint") + F.try_element_at(F.filter(F.split("block_sizes", ","), lambda x: x != ""), F.lit(-1)).try_cast("bigint") != e), "blocks end elsewhere"),
    ]
    return bed.withColumn("problem", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in rules)))))


def collapsed(transcripts_: DataFrame, name: str = "tx") -> DataFrame:
    """collapsed_exons() of transcript rows with their blocks."""
    return collapsed_exons(exons(transcripts_, (name, "chrom", "strand")), name)


def collapsed_exons(parts: DataFrame, name: str = "tx") -> DataFrame:
    """Transcripts that share exons, directly or through others, as one: (chrom, strand, s, e, starts, ends, names).

    parts are half-open exon rows (name, chrom, strand, s, e), repeated or not. Islands are made of one row a start, not of
    exons, and it is islands that are linked by the names they share: classes are sought among islands of which a name has
    several, so that names are in no round of joins. Rows without a name are left out.
    """
    from stratalane.operators.graphs import components
    from stratalane.operators.intervals import islands
    from stratalane.session import written

    place = ("chrom", "strand")
    parts = parts.where(F.col(name).isNotNull()).select(name, *place, "s", "e")
    starts = parts.groupBy(*place, "s").agg(F.max("e").alias("e")).withColumn("__last", F.col("e") - 1)
    spots = written(islands(starts, place, "s", "__last").select(*place, "s", "e", "island"), "spots")
    runs = written(spots.groupBy(*place, "island").agg(F.max("e").alias("e")).withColumn("no", F.monotonically_increasing_id()), "runs")

    def met(rows: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
        own, other = rows.alias("own"), table.select(*(F.col(c).alias(f"__{c}") for c in on), *(c for c in table.columns if c not in on))
        return own.join(other, [F.col(f"own.{c}").eqNullSafe(F.col(f"__{c}")) for c in on])

    numbered = met(spots.select(*place, "s", "island"), runs.select(*place, "island", "no"), (*place, "island")).select(*place, "s", "no")
    members = written(met(parts.select(name, *place, "s"), numbered, (*place, "s")).select(name, "no").distinct(), "members")
    several = members.groupBy(name).agg(F.min("no").alias("b"), F.max("no").alias("__far")).where("b < __far").select(name, "b")
    root = components(members.join(several, name).where("no > b").select(F.col("no").alias("a"), "b").distinct())
    classes = runs.join(root.withColumnRenamed("node", "no"), "no", "left").select("no", F.coalesce("root", "no").alias("root"), *place, "island", "e")
    blocks = classes.groupBy("root", *place).agg(F.sort_array(F.collect_list(F.struct(F.col("island").alias("s"), "e"))).alias("b"))
    names = members.join(classes.select("no", "root", *place), "no").groupBy("root", *place).agg(F.collect_list(F.col(name).cast("string")).alias("t"))
    names = names.select("root", *(F.col(c).alias(f"__{c}") for c in place), F.array_join(F.array_distinct(F.sort_array("t")), "|").alias("names"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in place]
    return blocks.join(names.withColumnRenamed("root", "__root"), [F.col("root") == F.col("__root"), *same]).select(
        *place, F.col("b")[0]["s"].alias("s"), F.array_max(F.transform("b", lambda x: x["e"])).alias("e"), F.transform("b", lambda x: x["s"]).alias("starts"), F.transform("b", lambda x: x["e"]).alias("ends"), "names")

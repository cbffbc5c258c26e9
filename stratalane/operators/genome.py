"""Sequences of features, gene hierarchies, scaffolds, syntenic positions, taxonomy and ontology, footprints, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalane.functions import sequences as seqs
from stratalane.operators import tiles
from stratalane.operators.intervals import islands, overlap_join
from stratalane.session import written

CHUNK = 1 << 16
#: Columns of a piece of an alignment, and positions of the bins in which pieces meet probes; at most 127.
PIECE = 64


def extracted(bed: DataFrame, genome: DataFrame, size: int = CHUNK) -> DataFrame:
    """(name, seq) of features (chrom, s, e half-open, name, strand, starts, sizes) from a genome (chrom, seq).

    Blocks are put together in order, and complemented backwards on the minus strand; features that leave their
    chromosome are left out. Blocks meet chunks of the genome by number, so no chromosome is copied for each feature.
    """
    known = genome.select("chrom", F.length("seq").alias("__length"))
    inside = bed.join(known, "chrom").where("s >= 0 AND e > s AND e <= __length")
    blocks = inside.select("name", "chrom", "s", "strand", F.posexplode(F.arrays_zip("starts", "sizes")).alias("__k", "__b"))
    blocks = blocks.withColumn("__a", F.col("s") + F.col("__b.starts")).withColumn("__z", F.col("__a") + F.col("__b.sizes")).where("__z > __a")
    number = F.sequence(*(F.floor(x / size).cast("int") for x in (F.col("__a"), F.col("__z") - 1)))
    pieces = genome.select("chrom", F.posexplode(seqs.chunks("seq", size)).alias("__chunk", "__piece"))
    met = blocks.withColumn("__chunk", F.explode(number)).join(pieces, ["chrom", "__chunk"])
    base = F.col("__chunk").cast("long") * size
    first = F.greatest(F.col("__a") - base, F.lit(0))
    part = F.substr("__piece", (first + 1).cast("int"), (F.least(F.col("__z") - base, F.lit(size)) - first).cast("int"))
    gathered = met.groupBy("name", "chrom", "s", "strand").agg(F.sort_array(F.collect_list(F.struct("__k", "__chunk", part.alias("part")))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    return gathered.select("name", F.when(F.col("strand") == "-", seqs.reverse_complement(whole)).otherwise(whole).alias("seq"))


def genes_added(rows: DataFrame, gene: str = "gene") -> DataFrame:
    """Annotation rows and one row of feature `gene` for each gene of a chromosome and strand, from its first place to its last."""
    bounds = rows.groupBy("chrom", "strand", gene).agg(F.min("s").alias("s"), F.max("e").alias("e")).withColumn("feature", F.lit("gene"))
    return rows.select("chrom", "s", "e", "strand", "feature", gene).unionByName(bounds.select("chrom", "s", "e", "strand", "feature", gene))


def hierarchy(rows: DataFrame) -> DataFrame:
    """gene, mRNA and exon rows (and CDS rows of a CDS) for the first place of each id, with ids and parents."""
    first = rows.groupBy("id").agg(F.min(F.struct("s", "e", "chrom", "strand", "feature")).alias("x")).select("id", "x.*")
    row = lambda kind, parent: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(kind + "|"), "id").alias("row_id"), (F.concat(F.lit(parent + "|"), "id") if parent else F.lit(None).cast("string")).alias("parent"))
    made = F.array(row("gene", None), row("mRNA", "gene"), row("exon", "mRNA"))
    made = F.when(F.col("feature") == "CDS", F.concat(made, F.array(row("CDS", "mRNA")))).otherwise(made)
    return first.withColumn("r", F.explode(made)).select("chrom", "s", "e", "strand", "r.type", "r.row_id", "r.parent")


def scaffold_parts(scaffolds: DataFrame, least: int, gap: int) -> DataFrame:
    """The contigs (W) and gaps (N) of scaffolds (id, seq) of at least `least` bases, in coordinates of the object they make.

    Contigs under `least` bases belong to the gaps beside them, gaps at the ends go, and short gaps count `gap` bases.
    """
    runs = scaffolds.where(F.length("seq") >= least).select("id", F.posexplode(F.regexp_extract_all("seq", F.lit("[Nn]+|[^Nn]+"), F.lit(0))).alias("k", "run"))
    runs = runs.select("id", "k", F.length("run").alias("n"), (F.col("run").rlike("^[Nn]") | (F.length("run") < least)).alias("is_gap"))
    order = Window.partitionBy("id").orderBy("k")
    same = F.col("is_gap") & F.coalesce(F.lag("is_gap").over(order), F.lit(False))
    grouped = runs.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("g", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = grouped.groupBy("id", "g").agg(F.sum("n").alias("n"), F.max("is_gap").alias("is_gap"))
    last = F.max("g").over(Window.partitionBy("id"))
    kept = parts.withColumn("__last", last).where("NOT is_gap OR (g > 1 AND g < __last)").withColumn("n", F.when(F.col("is_gap"), F.greatest("n", F.lit(gap))).otherwise(F.col("n")))
    run = Window.partitionBy("id").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    stop, contig = F.sum("n").over(run), F.sum(F.when(F.col("is_gap"), 0).otherwise(1)).over(run)
    name = F.when(~F.col("is_gap"), F.concat_ws("_", F.col("id").cast("string"), contig.cast("string")))
    return kept.select("id", (stop - F.col("n") + 1).alias("object_start"), stop.alias("object_end"), F.count("*").over(run).alias("part"), F.when(F.col("is_gap"), "N").otherwise("W").alias("kind"), name.alias("contig"), F.col("n").alias("length"))


def _aligned_pieces(blocks: DataFrame, size: int = PIECE) -> DataFrame:
    """(block, syn_chrom, syn_at, ref_chrom, ref_at, steps): pieces of alignment blocks of so many columns each.

    A piece has a step for each residue of its second sequence: how many of the first one lie before it in the piece.
    """
    cut = lambda c: F.regexp_extract_all(c, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    letters = lambda x: F.length(F.translate(x, "-", ""))
    pairs = F.filter(F.arrays_zip(cut("ref_aln").alias("r"), cut("syn_aln").alias("q")), lambda x: x["r"].isNotNull() & x["q"].isNotNull())
    start = lambda c: F.lit(0).cast("long").alias(c)
    before = F.aggregate(pairs, F.struct(start("r"), start("q"), F.array().cast("array<struct<r:bigint,q:bigint>>").alias("all")), lambda a, x: F.struct((a["r"] + letters(x["r"])).alias("r"), (a["q"] + letters(x["q"])).alias("q"), F.concat(a["all"], F.array(F.struct(a["r"].alias("r"), a["q"].alias("q")))).alias("all")))["all"]
    rows = blocks.select("block", "ref_chrom", "ref_start", "syn_chrom", "syn_start", F.explode(F.arrays_zip(pairs.alias("x"), before.alias("b"))).alias("__p"))
    r, q = F.col("__p.x.r"), F.col("__p.x.q")
    columns = F.filter(F.sequence(F.lit(1), F.least(F.length(r), F.length(q))), lambda i: F.substr(q, i, F.lit(1)) != "-")
    steps = F.transform(columns, lambda i: letters(F.substr(r, F.lit(1), i - 1)).cast("tinyint"))
    return rows.select("block", "syn_chrom", (F.col("syn_start") + F.col("__p.b.q")).alias("syn_at"), "ref_chrom", (F.col("ref_start") + F.col("__p.b.r")).alias("ref_at"), steps.alias("steps"))


def aligned_positions(blocks: DataFrame) -> DataFrame:
    """(block, syn_chrom, syn_pos, ref_chrom, ref_pos) of each aligned residue of the second sequence of alignment blocks.

    Blocks have ref_chrom, ref_start, ref_aln, syn_chrom, syn_start, syn_aln, with gaps as "-".
    """
    rows = _aligned_pieces(blocks).select("*", F.posexplode("steps").alias("__i", "__step"))
    return rows.select("block", "syn_chrom", (F.col("syn_at") + F.col("__i")).alias("syn_pos"), "ref_chrom", (F.col("ref_at") + F.col("__step")).alias("ref_pos"))


def probes_across(blocks: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (syn_chrom, syn_pos and more) with block, ref_chrom and ref_pos of each residue of aligned_positions() at their place.

    Pieces of blocks and probes meet in bins; residues are no rows before they are met.
    """
    last = F.col("syn_at") + F.size("steps") - 1
    filed = _aligned_pieces(blocks).where("size(steps) > 0").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("syn_at") / PIECE), F.floor(last / PIECE))))
    met = filed.join(probes.withColumn("__bin", F.floor(F.col("syn_pos") / PIECE)), ["syn_chrom", "__bin"]).where(F.col("syn_pos").between(F.col("syn_at"), last))
    step = F.get("steps", (F.col("syn_pos") - F.col("syn_at")).cast("int"))
    return met.select(*probes.columns, "block", "ref_chrom", (F.col("ref_at") + step).alias("ref_pos"))


def first_seen_scores(blocks: DataFrame, name: str, order: str, step: int = 40, base: int = 0) -> DataFrame:
    """blocks with a score by name: base for the name seen first, `step` more for each one seen later."""
    names = blocks.groupBy(name).agg(F.min(order).alias("__first"))
    scores = names.select(name, (base + step * (F.dense_rank().over(Window.orderBy("__first")) - 1)).alias("score"))  # one row a name
    return blocks.join(scores, name)


def probe_tracks(matrix: DataFrame, places: DataFrame, probe: str, samples: Sequence[str]) -> DataFrame:
    """(sample, chrom, pos, v): measurements of probes at the middles of all their places."""
    long = matrix.unpivot([probe], list(samples), "sample", "v")
    middle = F.col("s") + F.floor((F.col("e") - F.col("s")) / 2)
    return long.join(places.select(probe, "chrom", middle.alias("pos")), probe).select("sample", "chrom", "pos", "v")


def probe_copies(hits: DataFrame, probe: str, order: Sequence[str], most: int) -> DataFrame:
    """Hits of probes with at most `most` places, scored by 1000 / places, named apart where there are several."""
    counted = hits.join(hits.groupBy(probe).agg(F.count("*").alias("copies")).where(F.col("copies") <= most), probe)
    k = F.row_number().over(Window.partitionBy(probe).orderBy(*order))
    name = F.when(F.col("copies") > 1, F.concat_ws(":", F.col(probe).cast("string"), k.cast("string"))).otherwise(F.col(probe).cast("string"))
    return counted.withColumn("name", name).withColumn("score", F.floor(F.lit(1000) / F.col("copies")).cast("long"))


def placed_probes(probes: DataFrame, hits: DataFrame, reach: int = 10, slack: int = 200) -> DataFrame:
    """(n, key, new_chrom, new_pos, new_strand, score): probes (n, key, old_chrom, old_pos), numbered without gaps, on a new genome.

    hits (key, j, chrom, pos, strand) are the places of each probe in order j. A single place scores 1, none is Unknown and
    scores 0. A probe of several gets that whose distance to a placed neighbour (n - reach up to n + reach - 1) differs least
    from the old one, if it is at most `slack` longer: 0.5, in the order of n and then, for those left, against it. The
    rest are guessed (0.2): the place nearest the old one on its chromosome, with the strand of the first there, else the first.
    Passes depend on what they placed before only through probes within reach, so runs of such probes are worked out apart.
    """
    listed = hits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("j", "chrom", "pos", "strand"))).alias("hits"))
    rows = probes.join(listed, "key", "left").withColumn("copies", F.coalesce(F.size("hits"), F.lit(0)))
    first = F.get("hits", F.lit(0))
    clear = rows.where("copies < 2").select("n", "key", F.coalesce(first["chrom"], F.lit("Unknown")).alias("new_chrom"), F.coalesce(first["pos"], F.lit(0)).cast("long").alias("new_pos"), F.coalesce(first["strand"], F.lit("+")).alias("new_strand"), F.col("copies").cast("double").alias("score"))
    several = islands(rows.where("copies > 1").withColumns({"__all": F.lit(0), "__end": F.col("n")}), ["__all"], "n", "__end", gap=reach)
    around = several.select("island", F.explode(F.sequence(F.col("n") - reach, F.col("n") + reach - 1)).alias("n")).distinct()
    fixed = around.join(clear.where("new_chrom <> 'Unknown'").select("n", "new_chrom", "new_pos"), "n").join(probes.select("n", "old_pos"), "n")
    to_place = several.select("island", "n", F.col("key").cast("string").alias("key"), "old_chrom", "old_pos", "hits", F.lit(None).cast("string").alias("new_chrom"), F.lit(None).cast("long").alias("new_pos"))
    given = fixed.select("island", "n", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("old_chrom"), "old_pos", F.lit(None).alias("hits"), "new_chrom", "new_pos")
    together = to_place.unionByName(given)

    together = together.withColumns({"new_strand": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    # Each turn walks through a run in its order and holds no more of it than is within reach.
    once = written(_turn(together, 1, reach, slack), "probes")
    placed = _turn(once, -1, reach, slack).where("key IS NOT NULL").select("n", "key", "new_chrom", "new_pos", "new_strand", "score")
    return clear.withColumn("key", F.col("key").cast("string")).unionByName(placed)


def _turn(rows: DataFrame, turn: int, reach: int, slack: int) -> DataFrame:
    """rows of placed_probes with what is placed in a walk along n (against it, if turn is -1); what is left after that one is guessed."""
    order = F.col("n") if turn == 1 else F.desc("n")
    ordered = rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "island").sortWithinPartitions("island", order)

    def best_of(row, near):
        best, chrom, at, places = None, row["old_chrom"].lower(), row["old_pos"], row["hits"]
        for other in near:
            on = other["new_chrom"]
            if on is not None and on.lower() == chrom:
                before, there = abs(at - other["old_pos"]), other["new_pos"]
                for h in places:
                    now = abs(there - h["pos"])
                    if h["chrom"] == on and now <= before + slack and (best is None or abs(before - now) < best[0]):
                        best = (abs(before - now), h)
        return best and best[1]

    def guess(row):
        chrom, at, places = row["old_chrom"].lower(), row["old_pos"], row["hits"]
        here = [h for h in places if h["chrom"].lower() == chrom] or places[:1]
        nearest = min(reversed(here), key=lambda h: abs(h["pos"] - at))
        return here[0]["chrom"], nearest["pos"], here[0]["strand"]

    def settled(row, around):
        n = row["n"]
        if row["key"] is not None and row["new_chrom"] is None:
            near = sorted((r for r in around if n - reach <= r["n"] < n + reach and r is not row), key=lambda r: r["n"])
            hit = best_of(row, near)
            if hit is not None:
                row["new_chrom"], row["new_pos"], row["new_strand"], row["score"] = hit["chrom"], hit["pos"], hit["strand"], 0.5
        return row

    def run(batches):
        from collections import deque

        import pyarrow as pa

        around, at, schema, island, out = deque(), 0, None, None, []  # around[at] is the next row to settle

        def settle(upto):
            """Settles what has all it can reach: rows up to `upto`, or all. A guess is made when a row leaves, as it is no neighbour's knowledge."""
            nonlocal at
            while at < len(around) and (upto is None or abs(upto - around[at]["n"]) > reach):
                settled(around[at], around)
                at += 1
                while at and (at == len(around) or abs(around[at]["n"] - around[0]["n"]) > reach):
                    leave()
            while upto is None and around:
                leave()

        def leave():
            nonlocal at
            row = around.popleft()
            at -= 1
            if turn == -1 and row["key"] is not None and row["new_chrom"] is None:
                row["new_chrom"], row["new_pos"], row["new_strand"] = guess(row)
                row["score"] = 0.2
            out.append(row)

        for batch in batches:
            schema = batch.schema
            for row in batch.to_pylist():
                if row["island"] != island:
                    settle(None)
                    island = row["island"]
                around.append(row)
                settle(row["n"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        settle(None)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return ordered.mapInArrow(run, rows.schema)


def predictions_to_bed(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Gene predictions (contig, a, b, frame, score) as half-open features within their contigs (contig, length)."""
    low, high = F.least("a", "b") - 1, F.greatest("a", "b")
    minus = F.col("frame") < 0
    name = F.concat_ws("_", F.col("contig").cast("string"), F.concat_ws("-", low.cast("string"), high.cast("string")), F.when(minus, "1").otherwise("0"))
    return rows.join(lengths, "contig").select("contig", F.greatest(low, F.lit(0)).alias("s"), F.least(high, F.col("length")).alias("e"), name.alias("name"), "score", F.when(minus, "-").otherwise("+").alias("strand"))


def at_rank(paths: DataFrame, names: DataFrame, nodes: DataFrame, rank: str) -> DataFrame:
    """(read, name): of the steps (read, pos, name, score) of each read's path, the best one of a taxonomic rank, the last on ties.

    names: name to taxid, nodes: taxid to rank; reads without such a step have a null.
    """
    ranked = paths.join(names, "name").join(nodes.where(F.col("rank") == rank).select("taxid"), "taxid")
    best = ranked.groupBy("read").agg(F.max_by("name", F.struct("score", "pos")).alias("name"))
    return paths.select("read").distinct().join(best, "read", "left")


def ontology_rows(genes: DataFrame, hits: DataFrame, terms: DataFrame, roots: Mapping[str, str]) -> DataFrame:
    """(gene, term, ontology, evidence): the terms of genes, and the root term of each ontology that a gene has none of."""
    listed = genes.select("gene").distinct()
    found = listed.join(hits.select("gene", "term").distinct(), "gene").join(terms, "term").select("gene", "term", "ontology", F.lit("IEA").alias("evidence"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("ontology"), F.lit(t).alias("term")) for k, t in roots.items())))
    absent = listed.select("gene", kinds.alias("x")).select("gene", "x.term", "x.ontology").join(found.select("gene", "ontology").distinct(), ["gene", "ontology"], "left_anti")
    return found.unionByName(absent.select("gene", "term", "ontology", F.lit("ND").alias("evidence")))


def shifted_tracks(track: DataFrame, transcripts: DataFrame, offset: int, least: int) -> DataFrame:
    """A track (tx, s, e, n) in places relative to the coding start, shifted by offset, for transcripts of at least `least` bases."""
    long = transcripts.where(F.col("length") >= least).select("tx", (F.lit(offset) - F.col("utr")).alias("__by"))
    return track.join(long, "tx").select("tx", (F.col("s") + F.col("__by")).alias("s"), (F.col("e") + F.col("__by")).alias("e"), "n")


def footprint_density(reads: DataFrame, transcripts: DataFrame, offset: int, average: int | None = None) -> DataFrame:
    """(tx, pos, n, density): footprints of unspliced reads (tx, s, length, strand, blocks) on the plus strand by place.

    Reads longer than the average are shifted by one more; densities are over the transcript's reads per base.
    """
    kept = reads.where("strand = '+' AND blocks = 1").join(transcripts.select("tx", "utr", F.col("length").alias("__size")), "tx")
    more = F.lit(0) if average is None else F.when(F.col("length") > average, 1).otherwise(0)
    counts = kept.groupBy("tx", (F.col("s") - F.col("utr") + offset + more).alias("pos"), "__size").agg(F.count("*").alias("n"))
    total = counts.groupBy("tx").agg(F.sum("n").alias("__total"))
    return counts.join(total, "tx").select("tx", "pos", "n", (F.col("n") * F.col("__size") / F.col("__total")).alias("density"))


def primed_events(reads: DataFrame, events: Mapping[str, str], host: str, not_at: str, tail: str = "AAAAAAAA") -> DataFrame:
    """(id, event, seq, host_length): reads that hold an event's pattern, cut at the tail, unless they begin with not_at."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("event"), F.lit(p).alias("pattern")) for k, p in events.items())))
    cut = reads.withColumn("__e", kinds).where(F.expr("rlike(seq, __e.pattern)")).withColumn("seq", F.regexp_replace("seq", f"{tail}.*$", "")).where(~F.col("seq").rlike(f"^{not_at}"))
    return cut.select("id", "__e.event", "seq", F.length(F.regexp_replace("seq", f".{host}.*", "")).alias("host_length"))


def repeats(df: DataFrame, **keys: Sequence[str]) -> DataFrame:
    """For each named key: rows beyond the first of a value, values that repeat, and values."""
    rows = []
    for name, columns in keys.items():
        counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
        rows.append(counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"), F.count_if(F.col("n") > 1).alias("repeated"), F.count("*").alias("values")).select(F.lit(name).alias("key"), "*"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def travelling_ratios(counts: DataFrame, least: int, background: bool = False) -> DataFrame:
    """(gene, ratio): log10 of promoter over body density per kb of active genes.

    counts: gene, p_size, p_count, g_size, g_count (b_size, b_count for a background to subtract). A gene is active with a
    positive body density, at least `least` reads in its promoter, and its greater density over the median of all.
    """
    per_kb = lambda x: F.col(f"{x}_count") / F.col(f"{x}_size") * 1000
    less = per_kb("b") if background else F.lit(0.0)
    dense = counts.select("gene", "p_count", (per_kb("p") - less).alias("p"), (per_kb("g") - less).alias("g"))
    middle = dense.select(F.explode(F.array("p", "g")).alias("x")).agg(F.median("x").alias("__median"))  # one row
    active = dense.crossJoin(middle).where((F.col("g") > 0) & (F.col("p") >= 0) & (F.greatest("p", "g") > F.col("__median")) & (F.col("p_count") >= least))
    return active.select("gene", F.log10(F.try_divide("p", "g")).alias("ratio"))


def p_matrix(pairs: DataFrame, row: str, column: str, p: str, names: Sequence, most: float | None = None) -> DataFrame:
    """-log10 of p by row and column, 0 where there is none, at most `most`."""
    score = -F.log10(p) if most is None else F.least(-F.log10(p), F.lit(float(most)))
    return pairs.groupBy(row).pivot(column, list(names)).agg(F.max(score)).na.fill(0.0)


def shares_melted(df: DataFrame, key: str, shares: Mapping[str, Column]) -> DataFrame:
    """(key, measure, part, value): each share and what it leaves of the whole."""
    parts = [F.struct(F.lit(n).alias("measure"), F.lit(t).alias("part"), v.alias("value")) for n, x in shares.items() for t, v in (("on", x), ("off", 1 - x))]
    return df.select(key, F.explode(F.array(*parts)).alias("x")).select(key, "x.*")


def synced(matrix: DataFrame, like: DataFrame, key: str) -> DataFrame:
    """The rows and columns of a matrix that another one has too, rows with the other's `ordinal`, columns in its order."""
    columns = [c for c in like.columns if c in matrix.columns and c not in (key, "ordinal")]
    return matrix.select(key, *columns).join(like.select(key, "ordinal"), key).select("ordinal", key, *columns)


def layout_errors(tiles: DataFrame, reads: DataFrame) -> DataFrame:
    """(contig, read, error): what is wrong with tiles (contig, read, t1, t2) against reads (read, c1, c2, n_seq, n_qual)."""
    met = tiles.join(reads.withColumn("__known", F.lit(True)), "read", "left")
    known, over = F.col("__known").isNotNull(), F.greatest("t1", "t2", "c1", "c2") >= F.col("n_seq")
    said = F.array_compact(F.array(
        F.when(~known, "missing read"), F.when(known & (F.col("n_seq") != F.col("n_qual")), "sequence and quality differ"),
        F.when(known & (F.abs(F.col("t1") - F.col("t2")) != F.abs(F.col("c1") - F.col("c2"))), "offsets differ"), F.when(known & over, "out of range"),
    ))
    return met.select("contig", "read", F.explode(said).alias("error"))


def parted(df: DataFrame, key: str, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not among the failed ones, and those whose key is."""
    keys = failed.select(key).distinct()
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi")


def drawn(key: Column, seed: int) -> Column:
    """A number below 2^32 by key and seed, the same on every run."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long")


def dealt(df: DataFrame, key: str, parts: int, seed: int = 0) -> DataFrame:
    """df with `part`, one of `parts` by a draw of the key, and `place`, the draw to shuffle by; mates share a key."""
    return df.withColumn("place", drawn(F.col(key), seed)).withColumn("part", F.pmod("place", F.lit(parts)))


def grouped_lines(df: DataFrame, group: str, order: Sequence[str], header: Column, line: Column) -> DataFrame:
    """(group, ordinal, line): lines under a header for each group, ordinal 0 the header's."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    heads = df.select(group).distinct().select(group, F.lit(0).alias("ordinal"), header.alias("line"))
    return heads.unionByName(df.select(group, place.alias("ordinal"), line.alias("line")))


def described(df: DataFrame) -> DataFrame:
    """(position, name, values, empty): the columns of a table by number, with their non-null and null rows."""
    counts = df.agg(F.count("*").alias("__n"), *(F.count(F.col(f"`{c}`")).alias(f"__{i}") for i, c in enumerate(df.columns, 1)))
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(f"__{i}").alias("values"), (F.col("__n") - F.col(f"__{i}")).alias("empty")) for i, c in enumerate(df.columns, 1))))
    return counts.select(rows.alias("x")).select("x.*")


def insert_sizes(alignments: DataFrame, name: str) -> DataFrame:
    """(name, chrom, insert): from the first base to the last of the two mates of a name on one chromosome."""
    pairs = alignments.groupBy(name).agg(F.count("*").alias("__n"), F.min("chrom").alias("chrom"), F.max("chrom").alias("__other"), F.min("s").alias("s"), F.max("e").alias("e"))
    return pairs.where("__n = 2 AND chrom = __other").select(name, "chrom", (F.col("e") - F.col("s") + 1).alias("insert"))


def region_values(regions: DataFrame, track: DataFrame) -> DataFrame:
    """(id, values): what a track (chrom, s, e, v) has at each place of regions, 0 where it has nothing, turned on the minus strand.

    Coordinates are inclusive; where pieces of the track overlap the greatest value counts. Regions that fit a tile meet the
    track's places there; longer ones are joined with it.
    """
    kind = track.schema["v"].dataType
    points = track.select("chrom", F.explode(F.sequence("s", "e")).alias("pos"), "v").where("v IS NOT NULL AND s <= e").groupBy("chrom", "pos").agg(F.max("v").alias("v"))
    once = regions.groupBy("id").agg(F.count("*").alias("__n"), F.first(F.struct("chrom", "s", "e", "strand")).alias("x"))
    fits = F.coalesce((F.col("__n") == 1) & F.col("x.chrom").isNotNull() & (F.col("x.e") >= F.col("x.s")) & (F.col("x.e") - F.col("x.s") < tiles.TILE), F.lit(False))
    short = once.where(fits).select("id", "x.*")
    payload = F.struct("id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.coalesce(F.col("strand") == "-", F.lit(False)).alias("minus"))

    def work(rows, places, values):
        import numpy as np
        import pyarrow as pa

        s, e, minus = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("s", "e", "minus"))
        v = values.to_numpy(zero_copy_only=False)
        for a, z in tiles.chunks(e - s + 1):
            first, last, n = s[a:z], e[a:z], e[a:z] - s[a:z] + 1
            starts = np.cumsum(n) - n
            out = np.zeros(int(n.sum()), v.dtype if len(v) else "i8")
            k, i = tiles.met(places, first, last)
            out[starts[k] + np.where(minus[a:z][k], last[k] - places[i], places[i] - first[k])] = v[i]
            listed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(out)), pa.int32()), pa.array(out).cast(values.type))
            yield pa.RecordBatch.from_arrays([rows.field("id").slice(a, z - a), listed], ["id", "values"])

    schema = f"id {regions.schema['id'].dataType.simpleString()}, values array<{kind.simpleString()}>"
    found = tiles.beside(short.select("chrom", F.col("s").alias("first"), F.col("e").alias("last"), payload.alias("payload")), points, work, schema)
    ids = once.where(~fits).select("id")
    if ids.isEmpty():
        return found
    return found.unionByName(_long_region_values(regions.join(ids.withColumnRenamed("id", "__id"), F.col("id").eqNullSafe(F.col("__id")), "left_semi"), track))


def _long_region_values(regions: DataFrame, track: DataFrame) -> DataFrame:
    met = overlap_join(regions.select("id", "chrom", "s", "e"), track.select("chrom", "s", "e", "v"))
    at = F.explode(F.sequence(F.greatest("s1", "s2"), F.least("e1", "e2")))
    found = met.select(F.col("id1").alias("id"), at.alias("p"), F.col("v2").alias("v")).groupBy("id", "p").agg(F.max("v").alias("v"))
    have = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("m"))
    values = F.transform(F.sequence("s", "e"), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0).cast(track.schema["v"].dataType)))
    rows = regions.join(have, "id", "left").withColumn("values", values)
    return rows.select("id", F.when(F.col("strand") == "-", F.reverse("values")).otherwise(F.col("values")).alias("values"))

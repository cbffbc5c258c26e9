"""Older dialects written to the shared folder and read back, limits of averages, flanks that neighbours leave, probes on a new genome."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalane.functions.statistics import t_quantile
from stratalane.operators import annotation, bins, genome, matrices, reads
from stratalane.plans.catalog import query
from stratalane.plans.format_queries import _line, _put
from stratalane.plans.sequence_queries import READS, read_table
from stratalane.plans.views import FEAT, SIG, features, signal
from stratalane.session import load
from stratalane.sources import dialects, writers

_SCORE = "chr(CAST(floor(33.499 + 10 * log10(1 + pow(10, (id % 40 - 5) / 10.0))) AS INT))"


def _scored(spark, sf_dir):
    """Reads with a Solexa score of their own, the same at each base."""
    return read_table(spark, sf_dir).withColumn("q", (F.col("id") % 40 - 5).cast("string"))


@query(f"WITH {READS} SELECT 'm_1_' || id % 8 || '_2_' || id AS name, seq, repeat({_SCORE}, 32) AS qual FROM reads")
def scarf_read(spark, sf_dir):
    k = F.col("id")
    rows = _scored(spark, sf_dir).select(_line("m", "1", k % 8, "2", k, F.col("seq"), F.array_join(F.array_repeat("q", 32), " "), sep=":"))
    return dialects.scarf(spark, _put(spark, rows, "scarf"))


@query(f"WITH {READS} SELECT id % 4 || ':7:1:' || id AS name, translate(seq, 'T', 'N') AS seq, repeat({_SCORE}, 32) AS qual FROM reads")
def scores_beside_sequences(spark, sf_dir):
    """Reads in one folder and scores in another, a file a lane, in one order."""
    k = F.col("id")
    rows = _scored(spark, sf_dir).withColumn("lane", k % 4).repartition("lane").sortWithinPartitions("lane", "id")
    four = F.concat_ws(" ", F.lit("-40"), F.col("q"), F.lit("-40"), F.lit("-40"))
    put = lambda df, path: writers.text(df, path, by="lane")
    seq = _put(spark, rows.select("lane", _line(k % 4, "7", "1", k, F.translate("seq", "T", "."))), "seq", put)
    prb = _put(spark, rows.select("lane", F.array_join(F.array_repeat(four, 32), "\t").alias("value")), "prb", put)
    return dialects.sequences_with_scores(spark, seq, prb, r"lane=(\d+)/")


@query(f"WITH {READS} SELECT CASE WHEN id % 3 = 0 THEN 'HX9_12' ELSE 'unit_' || id % 7 || '_5' END || ':1:2:3:' || id || CASE WHEN id % 2 = 0 THEN '/1' ELSE '' END AS name, seq, repeat({_SCORE}, 32) AS qual, id % 5 <> 0 AS passed FROM reads")
def exports_read(spark, sf_dir):
    k = F.col("id")
    machine = F.when(k % 3 == 0, "SLXA-HX9_12_R1").otherwise(F.concat(F.lit("unit_"), (k % 7).cast("string"), F.lit("_human")))
    qual = F.repeat(F.char(F.col("q").cast("long") + 64), F.lit(32))
    rows = _scored(spark, sf_dir).select(_line(machine, "5", "1", "2", "3", k, "0", F.when(k % 2 == 0, "1").otherwise(""), F.col("seq"), qual, *["x"] * 11, F.when(k % 5 == 0, "N").otherwise("Y")))
    return dialects.exported(spark, _put(spark, rows, "export"))


@query(f"WITH {READS} SELECT 'r' || id AS name, seq, repeat({_SCORE}, 32) AS qual FROM reads")
def numbered_fastq_read(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(_line(F.concat(F.lit("@r"), F.col("id").cast("string")), F.col("seq"), "+", F.array_join(F.array_repeat("q", 32), " "), sep="\n"))
    return dialects.numbered_fastq(spark, _put(spark, rows, "fqint"))


@query(f"WITH {READS} SELECT id || CASE WHEN id % 2 = 0 THEN '/1' ELSE '/2' END AS name, seq, repeat(chr(CAST(33 + id % 40 AS INT)), 32) AS qual FROM reads")
def colours_read(spark, sf_dir):
    k = F.col("id")
    name = F.concat(F.lit(">"), k.cast("string"), F.when(k % 2 == 0, "_F3").otherwise("_R3"))
    rows = read_table(spark, sf_dir)
    path = _put(spark, rows.select(_line(name, F.concat(F.lit("T2"), F.translate("seq", "ACGT", "0123")), sep="\n")), "colours")
    quals = _put(spark, rows.select(_line(name, F.array_join(F.array_repeat((k % 40).cast("string"), 33), " "), sep="\n")), "scores")
    return dialects.colours(spark, path, quals)


def _genbank(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    minus = F.col("p_partkey") % 2 == 0
    place = F.when(minus, F.concat(F.lit("complement(join("), F.col("p_size").cast("string"), F.lit("..90,100..200))"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("..200")))
    deep = " " * 21
    text = F.concat(F.lit("LOCUS       c"), k, F.lit(" 99 bp DNA\nFEATURES             Location/Qualifiers\n     source          1..99\n     CDS             "), place, F.lit(f'\n{deep}/locus_tag="t'), k, F.lit(f'"\n{deep}/inference="similar to AA sequence:UniProtKB:P'), k, F.lit(f'"\n{deep}/product="some\n{deep}'), F.col("p_brand"), F.lit(f'"\n{deep}/translation="MK\n{deep}LV"\n     gene            1..2\nORIGIN\n        1 acgt acgt\n       61 '), F.translate(F.col("p_size").cast("string"), "0123456789", "acgtacgtac"), F.lit("\n//"))
    return _put(spark, load(spark, sf_dir, "part").select(text.alias("value")), "genbank")


@query("SELECT 'c' || p_partkey AS contig, CAST(p_size AS BIGINT) AS start, 200::BIGINT AS \"end\", CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '+' END AS strand, CAST(NULL AS VARCHAR) AS gene, 't' || p_partkey AS locus_tag, 'some ' || p_brand AS product, 'P' || p_partkey AS uniprot, 'MKLV' AS translation FROM part")
def genbank_genes_read(spark, sf_dir):
    return dialects.genbank_genes(spark, _genbank(spark, sf_dir))


@query("SELECT 'c' || p_partkey AS contig, 'acgtacgt' || translate(CAST(p_size AS VARCHAR), '0123456789', 'acgtacgtac') AS seq FROM part")
def genbank_sequences_read(spark, sf_dir):
    return dialects.genbank_sequences(spark, _genbank(spark, sf_dir))


@query(f"WITH {READS} SELECT 's' || id AS id, seq || 'N' AS seq FROM reads")
def embedded_sequences_read(spark, sf_dir):
    k = F.col("id").cast("string")
    row = F.concat_ws("\t", F.lit("c"), F.lit("p"), F.lit("CDS"), k, k, F.lit("."), F.lit("+"), F.lit("0"), F.lit("Name=x"))
    rows = read_table(spark, sf_dir).withColumn("part", F.col("id") % 4).repartition("part")
    head = rows.select("id", "part", F.lit(0).alias("o"), row.alias("value"))
    body = rows.select("id", "part", F.lit(1).alias("o"), F.concat(F.lit(">s"), k, F.lit(" x\n"), F.col("seq"), F.lit("\nN")).alias("value"))
    both = head.unionByName(body).repartition("part").sortWithinPartitions("part", "o", "id").select("part", "value")
    return dialects.embedded_sequences(spark, _put(spark, both, "embedded", lambda df, p: writers.text(df, p, by="part")))


@query("SELECT 'GENE' || p_partkey || 'X' AS gid, CAST(p_partkey AS VARCHAR) AS id, p_brand AS name, CAST(i AS INT) AS ix, 'a' || i AS \"array\", 'ARRY' || i || 'X' AS aid, CASE WHEN i < 2 THEN CAST(p_size + i AS DOUBLE) END AS v FROM part, range(0, 3) r(i)")
def cluster_diagram_read(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(_line(F.concat(F.lit("GENE"), F.col("p_partkey").cast("string"), F.lit("X")), F.col("p_partkey"), F.col("p_brand"), "1", F.col("p_size"), F.col("p_size") + 1, ""))
    head = spark.createDataFrame([("GID\tYORF\tNAME\tGWEIGHT\ta0\ta1\ta2",), ("AID\t\t\t\tARRY0X\tARRY1X\tARRY2X",), ("EWEIGHT\t\t\t\t1\t1\t1",)], "value string")
    return dialects.cluster_diagram(spark, _put(spark, rows.unionByName(head), "cdt"))


@query("SELECT 'S ' || p_partkey AS sample, k AS peak, p_size + k AS size, 1.5::DOUBLE AS amount, CAST(p_size AS DOUBLE) AS molarity FROM part, range(1, 3) r(k)")
def peak_tables_read(spark, sf_dir):
    size = F.col("p_size")
    peak = lambda k: F.concat_ws(" ", F.lit(str(k)), (size + k).cast("string"), F.lit("1.5"), size.cast("string"))
    rows = load(spark, sf_dir, "part").select(_line(F.concat(F.lit("Peak table for sample 3 :  S "), F.col("p_partkey").cast("string")), "Peak Size", peak(1), peak(2), sep="\n"))
    return dialects.peak_tables(spark, _put(spark, rows, "peaks")).select("sample", "peak", F.col("size").cast("int").alias("size"), "amount", "molarity").withColumn("size", F.col("size").cast("long"))


@query(f"WITH {SIG} SELECT 'c' || chrom AS chrom, pos, CAST(floor(v) AS DOUBLE) AS v FROM sig")
def binary_track_written_and_read(spark, sf_dir):
    track = signal(spark, sf_dir).select(F.concat(F.lit("c"), F.col("chrom").cast("string")).alias("chrom"), "pos", F.floor("v").alias("v"))
    return dialects.bar(spark, _put(spark, track, "bar", dialects.write_bar))


_T = "[" + ", ".join(repr(t_quantile(k)) for k in range(1, 31)) + "]"
_Z = 1.959963984540054
_FAR = " + ".join(f"({g!r}) / pow(n - 1, {i})" for i, g in enumerate(((_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384, (79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160), 1))


def _limits(by: str) -> str:
    """Of lists a: what _summary gives, to four digits."""
    q = ", ".join(f"round(list_aggregate(a, 'quantile_cont', {p}), 4) AS {name}" for p, name in ((0.25, "low"), (0.5, "median"), (0.75, "high")))
    return f"SELECT {by}, n, round(list_avg(a), 4) AS mean, CASE WHEN n > 1 THEN round(CASE WHEN n <= 31 THEN ({_T})[n - 1] ELSE {_Z} + {_FAR} END * list_stddev_samp(a) / sqrt(n), 4) END AS error, {q}"


def _rounded(df, by):
    return df.select(*by, "n", *(F.round(c, 4).alias(c) for c in ("mean", "error", "low", "median", "high")))


@query(f"""WITH {SIG}, g AS (SELECT chrom, x * 5000 AS x, CAST(floor(v / 100) AS DOUBLE) AS v FROM sig, unnest(range(CAST(ceil((pos - 2000) / 5000) AS BIGINT), CAST(floor((pos + 2000) / 5000) AS BIGINT) + 1)) AS u(x)),
l AS (SELECT chrom, x, list_concat(list(v), list_transform(range(greatest(0, 40 - count(*))), lambda i: 0.0::DOUBLE)) AS a, greatest(40, count(*)) AS n FROM g GROUP BY ALL) {_limits("chrom, x")} FROM l""")
def moving_limits(spark, sf_dir):
    track = signal(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 100))
    return _rounded(bins.moving_limits(track, ["chrom"], "pos", "v", 2000, 5000, 40), ["chrom", "x"])


@query(f"""WITH m AS (SELECT round(unnest(embedding) * 1000)::DOUBLE AS v, unnest(range(len(embedding))) AS ix FROM embeddings), x AS (SELECT DISTINCT ix FROM m),
l AS (SELECT CAST(x.ix AS INTEGER) AS ix, list(v) AS a, count(v) AS n FROM x JOIN m ON m.ix BETWEEN x.ix - 2 AND x.ix + 2 WHERE v IS NOT NULL GROUP BY x.ix) {_limits("ix")} FROM l""")
def profile_limits(spark, sf_dir):
    long = matrices.melted(load(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("value", F.round(F.col("value").cast("double") * 1000))
    return _rounded(bins.profile(long, "ix", "value", 3), ["ix"])


@query(f"WITH {READS}, w AS (SELECT id, substr(seq, CAST(k AS INT), 8) AS s FROM reads, range(1, 26) r(k)) SELECT DISTINCT id FROM w WHERE hamming(s, 'ACGTTGCA') <= 2")
def reads_within_substitutions(spark, sf_dir):
    return reads.containing(read_table(spark, sf_dir), "acgttgca", 2, substitutions=True).select("id")


def _kept(strand: str) -> str:
    on, by = ("AND u.strand = f.strand", "chrom, strand") if strand else ("", "chrom")
    return f"""WITH {FEAT}, k AS (SELECT * FROM feat WHERE id % 7 = 0), f AS (SELECT id, chrom, strand, greatest(1, CASE WHEN strand = '+' THEN e + 21 ELSE s - 401 END) - 1 AS s, greatest(1, CASE WHEN strand = '+' THEN e + 401 ELSE s - 21 END) AS e FROM k),
o AS (SELECT {by}, s - 1 AS s, e, max(e) OVER (PARTITION BY {by} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM k), i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o),
u AS (SELECT {by}, min(s) AS s, max(e) AS e FROM i GROUP BY {by}, g), c AS (SELECT f.id, f.chrom, f.strand, f.s, f.e, coalesce(list(u.s ORDER BY u.s) FILTER (u.s IS NOT NULL), []) AS us, coalesce(list(u.e ORDER BY u.s) FILTER (u.s IS NOT NULL), []) AS ue FROM f LEFT JOIN u ON u.chrom = f.chrom {on} AND u.s < f.e AND u.e > f.s WHERE f.e - f.s - 1 >= 30 GROUP BY ALL),
p AS (SELECT id AS gene, chrom, strand, unnest(list_prepend(s, ue)) AS a, unnest(list_append(us, e)) AS b FROM c) SELECT gene, chrom, strand, a + 1 AS s, b AS e FROM p WHERE b - a >= 31"""


def _flanks(spark, sf_dir, **how):
    genes = features(spark, sf_dir).where("id % 7 = 0").withColumnRenamed("id", "gene")
    return annotation.flanks_kept(genes, "3", 400, 20, 30, **how).select("gene", "chrom", "strand", "s", "e")


@query(_kept(""))
def flanks_without_genes(spark, sf_dir):
    """Features of every seventh order stand for genes, so that flanks remain between them."""
    return _flanks(spark, sf_dir)


@query(_kept("strand"))
def flanks_without_genes_of_strand(spark, sf_dir):
    return _flanks(spark, sf_dir, same_strand=True)


@query()
def probes_placed(spark, sf_dir):
    """Orders as probes in the order of their keys, with up to three places each; held against a plain walk in the tests."""
    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(k.alias("key"), F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string")).alias("old_chrom"), (k * 30).alias("old_pos"))
    probes = writers.chunk_by_count(rows, "key", 1).withColumnRenamed("chunk", "n")
    hits = rows.select("key", F.explode(F.sequence(F.lit(0), (F.col("key") % 4).cast("int"))).alias("j"), "old_chrom", "old_pos").where("j > 0")
    place = F.concat(F.lit("c"), ((F.col("key") + F.col("j")) % 3).cast("string"))
    return genome.placed_probes(probes, hits.select("key", "j", place.alias("chrom"), (F.col("old_pos") + F.col("j") * 150).alias("pos"), F.lit("+").alias("strand")))

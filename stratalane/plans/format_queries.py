"""Formats written to the shared folder and read back, and the functions that their records are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalane.functions import sequences as seqs
from stratalane.operators import ids, reads, variants
from stratalane.plans.catalog import query
from stratalane.plans.sequence_queries import READS, SEQS, read_table, sequences
from stratalane.plans.views import FEAT, SIG, features, signal
from stratalane.session import fresh_path, load, passing
from stratalane.sources import readers, writers


def _put(spark, rows, label: str, put=writers.text) -> str:
    """The folder that rows were written to; it goes when the driver ends."""
    path = fresh_path(spark, label)
    put(rows, path)
    passing(spark, path)
    return path


def _line(*parts, sep: str = "\t"):
    return F.concat_ws(sep, *(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts)).alias("value")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def table_written_and_read(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return readers.table(spark, _put(spark, rows, "table", writers.delimited))


@query(f"WITH {FEAT} SELECT 'chr' || chrom AS chrom, s AS start, e AS \"end\", 'f' || id AS name, strand FROM feat")
def bed_written_and_read(spark, sf_dir):
    f = features(spark, sf_dir)
    rows = f.select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), "s", "e", F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.lit(0).alias("score"), "strand")
    return readers.bed(spark, _put(spark, writers.bed_lines(rows), "bed")).select("chrom", "start", "end", "name", "strand")


@query(f"WITH {FEAT} SELECT 'c' || chrom AS chrom, 'exon' AS feature, least(s, e) AS start, greatest(s, e) AS \"end\", strand, CAST(NULL AS DOUBLE) AS score FROM feat")
def gff_written_and_read(spark, sf_dir):
    """Starts and ends of half of the rows are written the wrong way round, strands as 1 and -."""
    f, odd = features(spark, sf_dir), F.col("id") % 2 == 1
    rows = f.select(_line(F.concat(F.lit("c"), F.col("chrom").cast("string")), "src", "exon", F.when(odd, F.col("e")).otherwise(F.col("s")), F.when(odd, F.col("s")).otherwise(F.col("e")), ".", F.when(F.col("strand") == "+", "1").otherwise("-"), ".", F.concat(F.lit('gene_id "g'), F.col("id").cast("string"), F.lit('";'))))
    return readers.gff(spark, _put(spark, rows, "gff")).select("chrom", "feature", "start", "end", "strand", "score")


@query(f"WITH {SIG} SELECT 'c' || chrom AS chrom, pos, CAST(floor(v) AS DOUBLE) AS v FROM sig")
def sgr_written_and_read(spark, sf_dir):
    rows = signal(spark, sf_dir).select(_line(F.concat(F.lit("c"), F.col("chrom").cast("string")), F.col("pos"), F.floor("v")))
    return readers.sgr(spark, _put(spark, rows, "sgr"))


@query(f"WITH {FEAT} SELECT 'c' || chrom AS chrom, s, e, CAST(id % 100 AS DOUBLE) AS v FROM feat")
def bedgraph_written_and_read(spark, sf_dir):
    rows = features(spark, sf_dir).select(_line(F.concat(F.lit("c"), F.col("chrom").cast("string")), F.col("s"), F.col("e"), F.col("id") % 100))
    return readers.bedgraph(spark, _put(spark, rows, "bedgraph"))


@query(f"WITH {SEQS} SELECT CAST(id AS VARCHAR) AS id, seq FROM seqs")
def fasta_written_and_read(spark, sf_dir):
    rows = writers.fasta_lines(sequences(spark, sf_dir).withColumn("id", F.col("id").cast("string")))
    return readers.fasta(spark, _put(spark, rows, "fasta")).select("id", "seq")


@query(f"WITH {READS} SELECT 'r' || id AS name, seq, qual FROM reads")
def fastq_written_and_read(spark, sf_dir):
    rows = writers.fastq_lines(read_table(spark, sf_dir).withColumn("name", F.concat(F.lit("r"), F.col("id").cast("string"))))
    return readers.fastq(spark, _put(spark, rows, "fastq", lambda df, path: writers.text(df, path, "gzip"))).select("name", "seq", "qual")


@query(f"WITH {READS} SELECT 'm:1:' || id % 8 || ':2:' || id || ':4' AS name, translate(seq, 'T', 'N') AS seq, qual FROM reads WHERE id % 3 <> 0")
def qseq_read(spark, sf_dir):
    k = F.col("id")
    rows = read_table(spark, sf_dir).select(_line("m", "1", k % 8, "2", k, "4", "0", "1", F.translate("seq", "T", "."), F.col("qual"), F.when(k % 3 == 0, 0).otherwise(1)))
    return readers.qseq(spark, _put(spark, rows, "qseq"))


@query("SELECT l_orderkey AS matches, CAST(l_partkey AS VARCHAR) AS query, l_linenumber AS qstart, l_linenumber + 30 AS qend, CAST(l_suppkey AS VARCHAR) AS target, l_orderkey AS tstart FROM lineitem")
def psl_read(spark, sf_dir):
    c = {**dict.fromkeys(readers.PSL, F.lit(0)), "matches": F.col("l_orderkey"), "query": F.col("l_partkey"), "qstart": F.col("l_linenumber"), "qend": F.col("l_linenumber") + 30, "target": F.col("l_suppkey"), "tstart": F.col("l_orderkey")}
    rows = load(spark, sf_dir, "lineitem").select(_line(*(c[n] for n in readers.PSL)))
    return readers.psl(spark, _put(spark, rows.unionByName(spark.range(1).select(F.lit("psLayout version 3").alias("value"))), "psl")).select("matches", "query", "qstart", "qend", "target", "tstart")


@query("SELECT CAST(l_partkey AS VARCHAR) AS query, l_linenumber * 0.5::DOUBLE AS identity, l_orderkey AS length, 0.001::DOUBLE AS evalue FROM lineitem")
def blast_read(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(_line(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber") * F.lit(0.5), F.col("l_orderkey"), *["1"] * 6, "1e-3", "50.5"))
    return readers.blast(spark, _put(spark, rows, "blast")).select("query", "identity", "length", "evalue")


@query("SELECT 'c' || o_custkey % 24 AS chrom, o_orderkey AS pos, 'A' AS ref, 'C,G' AS alt, CAST(o_orderkey % 90 AS DOUBLE) AS qual, o_orderkey % 3 || '/' || o_custkey % 3 || ';0|1' AS genotypes FROM orders")
def vcf_read(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = load(spark, sf_dir, "orders").select(_line(F.concat(F.lit("c"), (c % 24).cast("string")), k, ".", "A", "C,G", k % 90, "PASS", ".", "GT", F.concat_ws("/", (k % 3).cast("string"), (c % 3).cast("string")), "0|1"))
    found = readers.vcf(spark, _put(spark, rows, "vcf"))
    return found.select("chrom", "pos", "ref", "alt", "qual", F.array_join("genotypes", ";").alias("genotypes"))


@query(f"WITH {SIG} SELECT 'c' || chrom AS chrom, pos, CAST(max(floor(v)) AS DOUBLE) AS v FROM sig GROUP BY ALL")
def wig_written_and_read(spark, sf_dir):
    """Chromosomes are written whole, as a header reaches down to all lines below it."""
    track = signal(spark, sf_dir).groupBy(F.concat(F.lit("c"), F.col("chrom").cast("string")).alias("chrom"), "pos").agg(F.max(F.floor("v")).alias("v"))
    rows = writers.wig_lines(track).repartition("chrom").sortWithinPartitions("chrom", "pos").select("value")
    return readers.wig(spark, _put(spark, rows, "wig")).select("chrom", "pos", "v")


@query("SELECT 'c' || p_partkey AS chrom, p_size + k * 5 AS pos, CAST(p_partkey + k AS DOUBLE) AS v FROM part, range(0, 3) r(k)")
def fixed_wig_read(spark, sf_dir):
    k = F.col("p_partkey")
    head = F.concat(F.lit("fixedStep chrom=c"), k.cast("string"), F.lit(" start="), F.col("p_size").cast("string"), F.lit(" step=5"))
    rows = load(spark, sf_dir, "part").select(_line(head, k, k + 1, k + 2, sep="\n"))
    return readers.wig(spark, _put(spark, rows, "fixed")).select("chrom", "pos", "v")


@query(f"WITH {READS} SELECT CAST(id AS VARCHAR) AS id, 'r' AS chrom, id AS s, id + 31 AS e, seq AS ref, reverse(seq) AS other FROM reads")
def alignments_read(spark, sf_dir):
    k = F.col("id")
    head = _line(k, "r", k, k + 31, "q", k, k + 31, "+", "9", sep=" ")
    rows = read_table(spark, sf_dir).select(F.concat_ws("\n", head, "seq", F.reverse("seq"), F.lit("")).alias("value"))
    return readers.alignments(spark, _put(spark, rows, "axt")).select("id", "chrom", "s", "e", "ref", "other")


@query("SELECT 'c' || o_custkey % 24 AS chrom, o_orderkey AS start, o_orderkey + 90 AS \"end\", CASE o_orderkey % 3 WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE '.' END AS strand, CAST(o_orderkey % 7 AS INT) AS motif, o_custkey AS \"unique\" FROM orders")
def junctions_read(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = load(spark, sf_dir, "orders").select(_line(F.concat(F.lit("c"), (c % 24).cast("string")), k, k + 90, k % 3, k % 7, "1", c, "0", "20"))
    return readers.junctions(spark, _put(spark, rows, "junctions")).select("chrom", "start", "end", "strand", "motif", "unique")


@query("SELECT CAST(p_partkey AS VARCHAR) AS acc, p_brand AS sig, CASE WHEN p_size % 2 = 0 THEN 'GO:1;GO:' || p_size ELSE '' END AS go FROM part")
def domains_read(spark, sf_dir):
    go = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("GO:1|GO:"), F.col("p_size").cast("string"))).otherwise("")
    rows = load(spark, sf_dir, "part").select(_line(F.col("p_partkey"), *"aa", "Pfam", F.col("p_brand"), *["x"] * 8, go))
    return readers.domains(spark, _put(spark, rows, "domains")).select("acc", "sig", F.array_join("go", ";").alias("go"))


@query("SELECT DISTINCT p_brand AS name, CAST(p_size AS VARCHAR) AS member FROM part")
def gene_sets_read(spark, sf_dir):
    rows = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("string")).alias("m"))
    return readers.gene_sets(spark, _put(spark, rows.select(F.concat_ws("\t", "p_brand", "m").alias("value")), "sets"))


@query("SELECT 'BLOCK: ' || p_brand AS head, min(p_size) AS low, max(p_size) AS high, count(*) AS n FROM part GROUP BY p_brand")
def blocks_read(spark, sf_dir):
    rows = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list(F.col("p_size").cast("string")).alias("m"))
    text = rows.select(F.concat_ws("\n", F.concat(F.lit("BLOCK: "), F.col("p_brand")), "m").alias("value"))
    found = readers.blocks(spark, _put(spark, text, "blocks"), "^BLOCK")
    return found.groupBy("head").agg(F.min(F.col("value").cast("int")).alias("low"), F.max(F.col("value").cast("int")).alias("high"), F.count("*").alias("n"))


@query("SELECT replace(p_brand, ' ', '_') AS folder, CAST(p_partkey AS VARCHAR) AS id FROM part")
def split_on_a_column(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    path = _put(spark, rows, "split", lambda df, p: writers.split_on(df, "p_brand", p))
    return spark.read.csv(path, sep="\t", header=True).select(F.col("__to").alias("folder"), F.col("id").cast("string").alias("id"))


@query("SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders")
def chunks_by_count(spark, sf_dir):
    return writers.chunk_by_count(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 1000)


@query(f"WITH {READS} SELECT 's' || id % 4 AS sample, length(replace(seq, 'A', '')) AS n, count(*) AS reads FROM reads GROUP BY ALL")
def lengths_by_sample(spark, sf_dir):
    """Reads written by sample, compressed, and the histogram of their lengths from what was written."""
    rows = read_table(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("sample"), F.replace("seq", F.lit("A"), F.lit("")).alias("value"))
    path = _put(spark, rows, "samples", lambda df, p: writers.text(df, p, "gzip", by="sample"))
    return spark.read.text(path).groupBy("sample", F.length("value").cast("long").alias("n")).agg(F.count("*").alias("reads"))


@query("SELECT o_orderkey AS id, 'read' || o_orderkey || '/2' AS name FROM orders")
def standard_headers(spark, sf_dir):
    name = F.concat(F.lit("read"), F.col("o_orderkey").cast("string"), F.lit("/1 length=32"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), seqs.standard_header(name, "2").alias("name"))


@query(f"WITH {READS}, q AS (SELECT id, length(qual) - length(translate(qual, '#%(+.147:', '')) AS low, length(qual) - length(translate(qual, 'LMNOPQRSTUVWXYZ', '')) AS high FROM reads) SELECT id, CASE WHEN low > 2 AND high = 0 THEN 33 WHEN high > 2 AND low = 0 THEN 64 END AS \"offset\" FROM q")
def quality_offsets(spark, sf_dir):
    return read_table(spark, sf_dir).select("id", seqs.encoding("qual").alias("offset"))


@query("SELECT p_partkey AS id, chr(CAST(floor(33.499 + 10 * log10(1 + pow(10, (p_partkey % 40 - 5) / 10.0))) AS INT)) AS qual FROM part")
def solexa_recoded(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), seqs.from_solexa(F.char((F.col("p_partkey") % 40 + 59).cast("long"))).alias("qual"))


@query(f"WITH {READS} SELECT id, CASE WHEN id % 2 = 0 THEN substr(seq, CAST(id % 30 + 1 AS INT)) || substr(seq, 1, CAST(id % 30 AS INT)) ELSE substr(reverse(translate(seq, 'ACGT', 'TGCA')), CAST(id % 30 + 1 AS INT)) || substr(reverse(translate(seq, 'ACGT', 'TGCA')), 1, CAST(id % 30 AS INT)) END AS seq FROM reads")
def circular_rotated(spark, sf_dir):
    k = F.col("id")
    return read_table(spark, sf_dir).select("id", seqs.rotated("seq", (k % 30 + 1).cast("int"), k % 2 == 1).alias("seq"))


@query(f"WITH {READS}, x AS (SELECT id, seq, unnest(range(1, 33)) AS k FROM reads) SELECT id, string_agg(CASE WHEN k IN (1 + id % 5, 9, 20 + id % 12) THEN substr(seq, k, 1) ELSE 'N' END, '' ORDER BY k) AS seq FROM x GROUP BY id")
def masked_outside(spark, sf_dir):
    k = F.col("id")
    return read_table(spark, sf_dir).select("id", seqs.masked_outside("seq", F.array(20 + k % 12, 1 + k % 5, F.lit(9).cast("long"), F.lit(99).cast("long"))).alias("seq"))


@query(f"WITH {SEQS}, r AS (SELECT id, unnest(regexp_extract_all(seq, 'N+|[^N]+')) AS run, generate_subscripts(regexp_extract_all(seq, 'N+|[^N]+'), 1) AS k FROM seqs), p AS (SELECT id, run, CAST(coalesce(sum(length(run)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS INT) AS start FROM r) SELECT id, start, run AS piece FROM p WHERE run NOT LIKE 'N%'")
def contigs_of_scaffolds(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", F.explode(seqs.gap_pieces("seq")).alias("x")).select("id", "x.*")


@query("SELECT 'r' || coalesce(a.k, b.k) AS pair, CASE WHEN a.k IS NULL THEN 'only_second' WHEN b.k IS NULL THEN 'only_first' ELSE 'paired' END AS state FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0) b ON a.k = b.k")
def mates_paired(spark, sf_dir):
    """Files of first and second mates that each lack some of the other's."""
    orders, name = load(spark, sf_dir, "orders"), lambda n: F.concat(F.lit("r"), F.col("o_orderkey").cast("string"), F.lit(f"/{n} x")).alias("name")
    return reads.pairing(orders.where("o_orderkey % 3 <> 0").select(name(1)), orders.where("o_orderkey % 5 <> 0").select(name(2)))


@query("SELECT l_orderkey AS name, max(l_partkey) - min(l_partkey) + max(l_linenumber) AS size FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2")
def mate_distances(spark, sf_dir):
    return reads.insert_sizes(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber").withColumnRenamed("l_orderkey", "name")


@query(f"""WITH {FEAT}, g AS (SELECT id AS gene, chrom, strand, s AS gs, e AS ge, CASE WHEN strand = '+' THEN s - 500 ELSE s END AS s, CASE WHEN strand = '+' THEN e ELSE e + 500 END AS e FROM feat), v AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 24 AS chrom, min(datediff('day', TIMESTAMP '1995-01-01', l_shipdate) * 100 + l_partkey % 100) AS pos FROM lineitem GROUP BY ALL),
h AS (SELECT v.id, v.chrom, gene, CASE WHEN pos BETWEEN gs AND ge THEN 0 ELSE 1 END AS k, gs FROM v JOIN g ON g.chrom = v.chrom AND pos BETWEEN s AND e), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, gs, gene) = 1)
SELECT DISTINCT v.id, gene, CASE k WHEN 0 THEN 'gene' WHEN 1 THEN 'promoter' END AS place FROM (SELECT id FROM v GROUP BY id HAVING count(*) = 1) u JOIN v USING (id) LEFT JOIN b ON b.id = v.id""")
def variants_annotated(spark, sf_dir):
    """Line items as point variants, where order and line name one place."""
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    pos = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("long") * 100 + F.col("l_partkey") % 100
    found = load(spark, sf_dir, "lineitem").groupBy(line, (F.col("l_suppkey") % 24).alias("chrom")).agg(F.min(pos).alias("pos"))
    single = found.join(found.groupBy("id").count().where("count = 1"), "id", "left_semi")
    return variants.annotated(single, features(spark, sf_dir).withColumnRenamed("id", "gene"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def unique_keys_asserted(spark, sf_dir):
    return ids.assert_unique(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")

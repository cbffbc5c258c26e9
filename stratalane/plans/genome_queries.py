"""Sequences, hierarchies, scaffolds, synteny, ontology and footprints over the driver tables in those roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalane.functions import sequences as seqs
from stratalane.operators import bins, genome, matrices
from stratalane.plans.catalog import query
from stratalane.plans.sequence_queries import READS, SEQS, read_table, sequences
from stratalane.plans.views import FEAT, GTF, SIG, attributes, features
from stratalane.session import load

BED = "bed AS (SELECT id AS chrom, (id * 7) % 150 AS s, (id * 7) % 150 + 60 + id % 40 AS e, 'f' || id AS name, CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM seqs)"


def _bed(spark, sf_dir):
    k = F.col("id")
    rows = sequences(spark, sf_dir).select(k.alias("chrom"), ((k * 7) % 150).alias("s"), ((k * 7) % 150 + 60 + k % 40).alias("e"), F.concat(F.lit("f"), k.cast("string")).alias("name"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))
    return rows.withColumn("starts", F.array(F.lit(0).cast("long"), F.lit(25).cast("long"))).withColumn("sizes", F.array(F.lit(10).cast("long"), F.col("e") - F.col("s") - 25))


@query(f"""WITH {SEQS}, {BED}, x AS (SELECT name, strand, substr(seq, s + 1, 10) || substr(seq, s + 26, e - s - 25) AS q FROM bed JOIN seqs ON seqs.id = bed.chrom WHERE e <= length(seq))
SELECT name, CASE WHEN strand = '-' THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END AS seq FROM x""")
def sequences_extracted(spark, sf_dir):
    """Two blocks of each feature, from the texts as chromosomes."""
    return genome.extracted(_bed(spark, sf_dir), sequences(spark, sf_dir).select(F.col("id").alias("chrom"), "seq"))


@query(f"WITH {GTF} SELECT chrom, s, e, strand, feature, gene FROM gtf UNION ALL SELECT chrom, min(s), max(e), strand, 'gene', gene FROM gtf GROUP BY chrom, strand, gene")
def gene_rows_added(spark, sf_dir):
    return genome.genes_added(attributes(spark, sf_dir).withColumn("gene", F.concat(F.lit("g"), (F.col("okey") % 500).cast("string"))))


@query(f"""WITH {GTF}, f AS (SELECT * FROM gtf QUALIFY row_number() OVER (PARTITION BY tx ORDER BY s, e, chrom, strand, feature) = 1),
r AS (SELECT * FROM f, (VALUES ('gene', NULL), ('mRNA', 'gene'), ('exon', 'mRNA'), ('CDS', 'mRNA')) v(type, p) WHERE type <> 'CDS' OR feature = 'CDS')
SELECT chrom, s, e, strand, type, type || '|' || tx AS row_id, p || '|' || tx AS parent FROM r""")
def gene_hierarchy(spark, sf_dir):
    return genome.hierarchy(attributes(spark, sf_dir).withColumn("id", F.concat(F.lit("t"), F.col("okey").cast("string"))))


@query(f"""WITH {SEQS}, r AS (SELECT id, unnest(regexp_extract_all(seq, 'N+|[^N]+')) AS run, generate_subscripts(regexp_extract_all(seq, 'N+|[^N]+'), 1) AS k FROM seqs WHERE length(seq) >= 30),
g AS (SELECT id, k, length(run) AS n, (run LIKE 'N%' OR length(run) < 30) AS gap FROM r), h AS (SELECT *, CASE WHEN gap AND coalesce(lag(gap) OVER (PARTITION BY id ORDER BY k), false) THEN 0 ELSE 1 END AS fresh FROM g),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY k) AS grp FROM h), j AS (SELECT id, grp, sum(n) AS n, bool_or(gap) AS gap FROM i GROUP BY id, grp),
l AS (SELECT *, max(grp) OVER (PARTITION BY id) AS last FROM j), m AS (SELECT id, grp, gap, CASE WHEN gap THEN greatest(n, 5) ELSE n END AS n FROM l WHERE NOT gap OR (grp > 1 AND grp < last)),
o AS (SELECT *, sum(n) OVER w AS stop, count(*) OVER w AS part, sum(CASE WHEN gap THEN 0 ELSE 1 END) OVER w AS contig FROM m WINDOW w AS (PARTITION BY id ORDER BY grp))
SELECT id, CAST(stop - n + 1 AS BIGINT) AS object_start, CAST(stop AS BIGINT) AS object_end, part, CASE WHEN gap THEN 'N' ELSE 'W' END AS kind, CASE WHEN gap THEN NULL ELSE id || '_' || contig END AS contig, CAST(n AS BIGINT) AS length FROM o""")
def scaffold_parts(spark, sf_dir):
    return genome.scaffold_parts(sequences(spark, sf_dir), 30, 5)


ALIGNED = f"""{READS}, b AS (SELECT id AS block, 'r' || id % 3 AS ref_chrom, id * 10 AS ref_start, translate(seq, 'T', '-') AS r, 's' || id % 5 AS syn_chrom, id * 20 AS syn_start, translate(reverse(seq), 'G', '-') AS q FROM reads),
c AS (SELECT *, unnest(range(1, 33)) AS k FROM b), p AS (SELECT block, syn_chrom, ref_chrom, substr(q, k, 1) AS x, ref_start + length(replace(substr(r, 1, k - 1), '-', '')) AS ref_pos, syn_start + length(replace(substr(q, 1, k - 1), '-', '')) AS syn_pos FROM c)"""


@query(f"WITH {ALIGNED}, probes AS (SELECT 's' || l_orderkey % 5 AS syn_chrom, l_orderkey * 20 + l_linenumber AS syn_pos, l_partkey AS probe FROM lineitem) SELECT probe, block, ref_chrom, ref_pos FROM p JOIN probes USING (syn_chrom, syn_pos) WHERE x <> '-'")
def probes_across_alignments(spark, sf_dir):
    k = F.col("id")
    name = lambda c, n: F.concat(F.lit(c), (k % n).cast("string"))
    blocks = read_table(spark, sf_dir).select(k.alias("block"), name("r", 3).alias("ref_chrom"), (k * 10).alias("ref_start"), F.translate("seq", "T", "-").alias("ref_aln"), name("s", 5).alias("syn_chrom"), (k * 20).alias("syn_start"), F.translate(F.reverse("seq"), "G", "-").alias("syn_aln"))
    o = F.col("l_orderkey")
    probes = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), (o % 5).cast("string")).alias("syn_chrom"), (o * 20 + F.col("l_linenumber")).alias("syn_pos"), F.col("l_partkey").alias("probe"))
    return genome.probes_across(blocks, probes).select("probe", "block", "ref_chrom", "ref_pos")


@query("WITH f AS (SELECT o_custkey % 7 AS chrom, min(o_orderkey) AS k FROM orders GROUP BY ALL), r AS (SELECT chrom, 40 * (dense_rank() OVER (ORDER BY k) - 1) AS score FROM f) SELECT o_orderkey AS id, score FROM orders JOIN r ON r.chrom = o_custkey % 7")
def synteny_scores(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("chrom"))
    return genome.first_seen_scores(rows, "chrom", "id").select("id", F.col("score").cast("long").alias("score"))


PLACES = "places AS (SELECT l_partkey AS probe, l_suppkey % 24 AS chrom, l_orderkey * 10 AS s, l_orderkey * 10 + l_linenumber * 3 AS e, l_linenumber AS line FROM lineitem)"


def _places(spark, sf_dir):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    return load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("probe"), (F.col("l_suppkey") % 24).alias("chrom"), (o * 10).alias("s"), (o * 10 + n * 3).alias("e"), n.alias("line"))


@query(f"WITH {PLACES}, m AS (SELECT p_partkey AS probe, 'size' AS sample, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part) SELECT sample, chrom, s + (e - s) // 2 AS pos, v FROM m JOIN places USING (probe)")
def probe_tracks(spark, sf_dir):
    matrix = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("probe"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return genome.probe_tracks(matrix, _places(spark, sf_dir), "probe", ["size", "price"])


@query(f"""WITH {PLACES}, c AS (SELECT *, count(*) OVER (PARTITION BY probe) AS copies, row_number() OVER (PARTITION BY probe ORDER BY s, chrom, line, e) AS k FROM places)
SELECT chrom, s, e, CASE WHEN copies > 1 THEN probe || ':' || k ELSE CAST(probe AS VARCHAR) END AS name, CAST(floor(1000 / copies) AS BIGINT) AS score FROM c WHERE copies <= 30""")
def probe_copies(spark, sf_dir):
    return genome.probe_copies(_places(spark, sf_dir), "probe", ["s", "chrom", "line", "e"], 30).select("chrom", "s", "e", "name", "score")


@query(f"""WITH {SEQS}, g AS (SELECT id, length(seq) AS n, id * 13 % 400 AS a, id * 29 % 400 AS b, id % 7 - 3 AS f FROM seqs)
SELECT id AS contig, greatest(least(a, b) - 1, 0) AS s, least(greatest(a, b), n) AS e, id || '_' || (least(a, b) - 1) || '-' || greatest(a, b) || '_' || CASE WHEN f < 0 THEN '1' ELSE '0' END AS name, id % 10 AS score, CASE WHEN f < 0 THEN '-' ELSE '+' END AS strand FROM g""")
def predictions_to_bed(spark, sf_dir):
    k, rows = F.col("id"), sequences(spark, sf_dir)
    found = rows.select(k.alias("contig"), (k * 13 % 400).alias("a"), (k * 29 % 400).alias("b"), (k % 7 - 3).alias("frame"), (k % 10).alias("score"))
    return genome.predictions_to_bed(found, rows.select(k.alias("contig"), F.length("seq").cast("long").alias("length")))


@query("""WITH p AS (SELECT p_partkey AS read, unnest(string_split(p_name, ' ')) AS name, generate_subscripts(string_split(p_name, ' '), 1) AS pos, p_size FROM part), h AS (SELECT *, (length(name) * 7 + ascii(name)) % 4 AS rank FROM p),
b AS (SELECT read, name FROM h WHERE rank = 2 QUALIFY row_number() OVER (PARTITION BY read ORDER BY p_size + pos % 2 DESC, pos DESC) = 1) SELECT r.read, b.name FROM (SELECT DISTINCT read FROM p) r LEFT JOIN b USING (read)""")
def reads_at_rank(spark, sf_dir):
    """Words as taxa, their numbers made of length and first letter."""
    paths = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("read"), "p_size", F.posexplode(F.split("p_name", " ")).alias("at", "name")).select("read", (F.col("at") + 1).alias("pos"), "name", (F.col("p_size") + (F.col("at") + 1) % 2).alias("score"))
    names = paths.select("name").distinct().withColumn("taxid", F.length("name") * 7 + F.ascii("name"))
    nodes = names.select("taxid").distinct().withColumn("rank", F.concat(F.lit("r"), (F.col("taxid") % 4).cast("string")))
    return genome.at_rank(paths, names, nodes, "r2")


@query("""WITH t AS (SELECT DISTINCT 'GO:' || l_suppkey % 50 AS term, substr('CFP', CAST(l_suppkey % 50 % 3 AS INT) + 1, 1) AS ontology FROM lineitem), h AS (SELECT DISTINCT l_partkey AS gene, 'GO:' || l_suppkey % 50 AS term FROM lineitem WHERE l_linenumber = 1),
f AS (SELECT p_partkey AS gene, term, ontology, 'IEA' AS evidence FROM part JOIN h ON gene = p_partkey JOIN t USING (term)), r AS (SELECT * FROM (VALUES ('GO:0005575', 'C'), ('GO:0003674', 'F'), ('GO:0008150', 'P')) v(term, ontology))
SELECT * FROM f UNION ALL SELECT p_partkey, term, ontology, 'ND' FROM part, r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.gene = p_partkey AND f.ontology = r.ontology)""")
def ontology_rows(spark, sf_dir):
    lines, k = load(spark, sf_dir, "lineitem"), F.col("l_suppkey") % 50
    term = F.concat(F.lit("GO:"), k.cast("string")).alias("term")
    terms = lines.select(term, F.get(F.array(*map(F.lit, "CFP")), (k % 3).cast("int")).alias("ontology")).distinct()
    hits = lines.where("l_linenumber = 1").select(F.col("l_partkey").alias("gene"), term)
    return genome.ontology_rows(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene")), hits, terms, {"C": "GO:0005575", "F": "GO:0003674", "P": "GO:0008150"})


RIBO = "tx AS (SELECT c AS tx, c * 3 AS utr, 400 + c * 5 AS length FROM range(0, 50) r(c)), rd AS (SELECT o_custkey % 50 AS tx, o_orderkey % 97 AS s, 25 + o_orderkey % 10 AS n, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '+' END AS strand, 1 + CAST(o_orderkey % 11 = 0 AS INT) AS blocks FROM orders)"


def _ribo(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("id")
    transcripts = spark.range(50).select(c.alias("tx"), (c * 3).alias("utr"), (400 + c * 5).alias("length"))
    reads = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("tx"), (k % 97).alias("s"), (25 + k % 10).alias("length"), F.when(k % 3 == 0, "-").otherwise("+").alias("strand"), F.when(k % 11 == 0, 2).otherwise(1).alias("blocks"))
    return transcripts, reads


@query(f"WITH {RIBO} SELECT rd.tx, s - utr + 12 AS s, s + n - utr + 12 AS e, n FROM rd JOIN tx ON tx.tx = rd.tx WHERE tx.length >= 500")
def shifted_tracks(spark, sf_dir):
    transcripts, reads = _ribo(spark, sf_dir)
    return genome.shifted_tracks(reads.select("tx", "s", (F.col("s") + F.col("length")).alias("e"), F.col("length").alias("n")), transcripts, 12, 500)


@query(f"""WITH {RIBO}, c AS (SELECT rd.tx, s - utr + 12 + CASE WHEN n > 29 THEN 1 ELSE 0 END AS pos, tx.length AS size, count(*) AS n FROM rd JOIN tx ON tx.tx = rd.tx WHERE strand = '+' AND blocks = 1 GROUP BY ALL)
SELECT tx, pos, n, round(n * size / sum(n) OVER (PARTITION BY tx), 6) AS density FROM c""")
def footprint_density(spark, sf_dir):
    transcripts, reads = _ribo(spark, sf_dir)
    return genome.footprint_density(reads, transcripts, 12, 29).select("tx", "pos", "n", F.round("density", 6).alias("density"))


@query(f"""WITH {READS}, e AS (SELECT id, event, regexp_replace(seq, 'AAAA.*$', '') AS seq FROM reads, (VALUES ('one', 'GC[AG]A'), ('two', 'GC[AG]C')) v(event, pattern) WHERE regexp_matches(reads.seq, pattern))
SELECT id, event, seq, CAST(length(regexp_replace(seq, '.GC[AG].*', '')) AS INT) AS host_length FROM e WHERE NOT regexp_matches(seq, '^AGC[AG]')""")
def primed_events(spark, sf_dir):
    return genome.primed_events(read_table(spark, sf_dir), {"one": "GC[AG]A", "two": "GC[AG]C"}, "GC[AG]", "AGC[AG]", "AAAA")


@query("""WITH a AS (SELECT o_custkey % 24 AS k, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_orderdate AS k, count(*) AS n FROM orders GROUP BY ALL)
SELECT 'chrom' AS key, CAST(sum(n - 1) AS BIGINT) AS extra, count(*) FILTER (n > 1) AS repeated, count(*) AS "values" FROM a UNION ALL SELECT 'day', CAST(sum(n - 1) AS BIGINT), count(*) FILTER (n > 1), count(*) FROM b""")
def repeated_keys(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 24).alias("chrom"), "o_orderdate")
    return genome.repeats(rows, chrom=["chrom"], day=["o_orderdate"])


CODES = "CASE substr(seq, 1, 2) || substr(seq, 31, 2) WHEN 'GTAG' THEN 1 WHEN 'CTAC' THEN 2 WHEN 'GCAG' THEN 3 WHEN 'CTGC' THEN 4 WHEN 'ATAC' THEN 5 WHEN 'GTAT' THEN 6 ELSE 0 END"


@query(f"WITH {READS} SELECT id, CAST({CODES} AS INT) AS code FROM reads")
def motif_codes(spark, sf_dir):
    return read_table(spark, sf_dir).select("id", seqs.motif_code(F.substr("seq", F.lit(1), F.lit(2)), F.substr("seq", F.lit(31), F.lit(2))).alias("code"))


@query("""WITH d AS (SELECT o_orderkey AS gene, o_orderkey % 37 AS pc, (o_orderkey % 37) / (100 + o_custkey % 50) * 1000 AS p, (o_custkey % 90) / (1000 + o_orderkey % 300) * 1000 AS g FROM orders), m AS (SELECT median(x) AS x FROM (SELECT p AS x FROM d UNION ALL SELECT g FROM d))
SELECT gene, CASE WHEN p > 0 THEN round(log10(p / g), 6) END AS ratio FROM d, m WHERE g > 0 AND p >= 0 AND greatest(p, g) > m.x AND pc >= 5""")
def travelling_ratios(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    counts = load(spark, sf_dir, "orders").select(k.alias("gene"), (100 + c % 50).alias("p_size"), (k % 37).alias("p_count"), (1000 + k % 300).alias("g_size"), (c % 90).alias("g_count"))
    return genome.travelling_ratios(counts, 5).select("gene", F.round("ratio", 6).alias("ratio"))


@query("SELECT p_brand AS brand, " + ", ".join(f"round(coalesce(max(least(-log10(1.0 / p_retailprice), 3.1)) FILTER (p_size = {k}), 0), 6) AS \"{k}\"" for k in range(1, 6)) + " FROM part GROUP BY p_brand")
def p_matrix(spark, sf_dir):
    pairs = load(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("term"), (1 / F.col("p_retailprice")).alias("p"))
    wide = genome.p_matrix(pairs, "brand", "term", "p", list(range(1, 6)), 3.1)
    return wide.select("brand", *(F.round(f"`{k}`", 6).alias(str(k)) for k in range(1, 6)))


@query("WITH s AS (SELECT o_orderkey AS id, 'price' AS measure, o_totalprice / 1000000 AS v FROM orders UNION ALL SELECT o_orderkey, 'key', (o_orderkey % 100) / 100 FROM orders) SELECT id, measure, 'on' AS part, round(v, 8) AS value FROM s UNION ALL SELECT id, measure, 'off', round(1 - v, 8) FROM s")
def shares_melted(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    return genome.shares_melted(rows, "id", {"price": F.col("o_totalprice") / 1000000, "key": (F.col("id") % 100) / 100}).withColumn("value", F.round("value", 8))


@query("SELECT o_custkey AS ordinal, o_orderkey AS id, o_totalprice AS b, o_custkey AS a FROM orders WHERE o_orderkey % 3 = 0")
def matrices_synced(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    matrix = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("a"), F.col("o_totalprice").alias("b"), F.lit(0).alias("c"))
    like = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ordinal"), F.lit(1).alias("b"), F.lit(1).alias("a"), F.lit(1).alias("d"))
    return genome.synced(matrix, like, "id")


LAYOUT = "t AS (SELECT o_custkey AS contig, o_orderkey AS read, o_orderkey % 40 AS t1, o_orderkey % 90 AS t2 FROM orders), r AS (SELECT DISTINCT l_orderkey AS read, l_orderkey % 40 AS c1, l_orderkey % 45 AS c2, 80 + l_orderkey % 3 AS ns, 80 + l_orderkey % 2 AS nq FROM lineitem WHERE l_linenumber = 3), m AS (SELECT t.*, c1, c2, ns, nq FROM t LEFT JOIN r USING (read))"


@query(f"""WITH {LAYOUT} SELECT contig, read, 'missing read' AS error FROM m WHERE ns IS NULL UNION ALL SELECT contig, read, 'sequence and quality differ' FROM m WHERE ns <> nq UNION ALL SELECT contig, read, 'offsets differ' FROM m WHERE abs(t1 - t2) <> abs(c1 - c2)
UNION ALL SELECT contig, read, 'out of range' FROM m WHERE greatest(t1, t2, c1, c2) >= ns""")
def layout_errors(spark, sf_dir):
    k, o = F.col("o_orderkey"), F.col("l_orderkey")
    tiles = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("contig"), k.alias("read"), (k % 40).alias("t1"), (k % 90).alias("t2"))
    reads = load(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(o.alias("read"), (o % 40).alias("c1"), (o % 45).alias("c2"), (80 + o % 3).alias("n_seq"), (80 + o % 2).alias("n_qual")).distinct()
    return genome.layout_errors(tiles, reads)


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'failed' ELSE 'good' END AS side FROM orders")
def parted_by_failures(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"))
    good, failed = genome.parted(orders, "key", load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key")))
    return good.select("id", F.lit("good").alias("side")).unionByName(failed.select("id", F.lit("failed").alias("side")))


@query("WITH d AS (SELECT o_orderkey AS id, CAST('0x' || substr(md5(o_orderkey || ':7'), 1, 8) AS BIGINT) AS place FROM orders) SELECT id, place, place % 3 AS part FROM d")
def dealt_at_random(spark, sf_dir):
    """Order by place for a shuffle, write by part for a random split."""
    return genome.dealt(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 3, 7)


@query(f"""WITH {FEAT}, h AS (SELECT DISTINCT chrom, 0 AS ordinal, 'reference = chr' || chrom AS line FROM feat)
SELECT chrom, CAST(ordinal AS INT) AS ordinal, line FROM h UNION ALL SELECT chrom, CAST(row_number() OVER (PARTITION BY chrom ORDER BY s, id) AS INT), 'feature' || chr(9) || id || chr(9) || s || '..' || e FROM feat""")
def track_lines(spark, sf_dir):
    """Lines of a genome browser's track, under a header for each chromosome."""
    line = F.concat(F.lit("feature\t"), F.col("id").cast("string"), F.lit("\t"), F.col("s").cast("string"), F.lit(".."), F.col("e").cast("string"))
    return genome.grouped_lines(features(spark, sf_dir), "chrom", ["s", "id"], F.concat(F.lit("reference = chr"), F.col("chrom").cast("string")), line)


@query("SELECT CAST(1 AS INT) AS position, 'doc_id' AS name, count(doc_id) AS \"values\", count(*) - count(doc_id) AS empty FROM documents UNION ALL SELECT 2, 'text', count(text), count(*) - count(text) FROM documents UNION ALL SELECT 3, 'lang', count(lang), count(*) - count(lang) FROM documents")
def columns_described(spark, sf_dir):
    return genome.described(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query(f"WITH {PLACES}, m AS (SELECT s // 10 AS name, chrom % 3 AS chrom, s + line * 7 AS s, s + line * 7 + 30 AS e FROM places WHERE line <= 2) SELECT name, min(chrom) AS chrom, max(e) - min(s) + 1 AS insert FROM m GROUP BY name HAVING count(*) = 2 AND min(chrom) = max(chrom)")
def insert_sizes(spark, sf_dir):
    rows = _places(spark, sf_dir).where("line <= 2").select(F.floor(F.col("s") / 10).alias("name"), (F.col("chrom") % 3).alias("chrom"), (F.col("s") + F.col("line") * 7).alias("s"), (F.col("s") + F.col("line") * 7 + 30).alias("e"))
    return genome.insert_sizes(rows, "name")


@query(f"""WITH {FEAT}, {SIG}, p AS (SELECT id, chrom, strand, unnest(range(s, e + 1)) AS p FROM feat), m AS (SELECT chrom, pos, max(CAST(floor(v) AS BIGINT)) AS v FROM sig GROUP BY ALL)
SELECT id, string_agg(coalesce(v, 0)::VARCHAR, ',' ORDER BY CASE WHEN strand = '-' THEN -p.p ELSE p.p END) AS "values" FROM p LEFT JOIN m ON m.chrom = p.chrom AND m.pos = p.p GROUP BY id""")
def region_values(spark, sf_dir):
    """The signal at every place of each feature."""
    from stratalane.plans.views import signal

    track = signal(spark, sf_dir).select("chrom", F.col("pos").alias("s"), F.col("pos").alias("e"), F.floor("v").alias("v"))
    found = genome.region_values(features(spark, sf_dir), track)
    return found.select("id", F.array_join("values", ",").alias("values"))


@query("""WITH m AS (SELECT vec_id, unnest(embedding)::DOUBLE + 2 AS value, unnest(range(len(embedding))) AS ix FROM embeddings)
SELECT vec_id, CAST(ix AS INTEGER) AS ix, round(exp(avg(ln(1 + value)) OVER w) - 1, 6) AS geomean, round(median(value) OVER w, 6) AS median FROM m WINDOW w AS (PARTITION BY vec_id ORDER BY ix RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def smoothed_otherwise(spark, sf_dir):
    long = matrices.melted(load(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("value", F.col("value").cast("double") + 2)
    both = bins.smoothed(bins.smoothed(long, "vec_id", "ix", "value", 3, "geomean").withColumnRenamed("smooth", "geomean"), "vec_id", "ix", "value", 3, "median")
    return both.select("vec_id", "ix", F.round("geomean", 6).alias("geomean"), F.round("smooth", 6).alias("median"))

"""Annotation operators over line items as annotation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalane.operators import annotation
from stratalane.plans.catalog import query
from stratalane.plans.views import GTF, attributes
from stratalane.session import load

KEY = ("okey", "pkey", "line")


def _rows(spark, sf_dir):
    return attributes(spark, sf_dir).withColumn("bag", annotation.parsed("attrs"))


def _exons(spark, sf_dir):
    return _rows(spark, sf_dir).select("chrom", "s", "e", "strand", F.concat_ws(".", annotation.value("bag", "transcript_id"), "chrom").alias("tx"), annotation.value("bag", "gene_id").alias("gene"), "feature", *KEY)


TAG = "CASE WHEN pkey % 3 = 0 THEN CAST(pkey % 7 AS VARCHAR) ELSE '' END || CASE WHEN pkey % 6 = 0 THEN ',extra' ELSE '' END"


@query(f"WITH {GTF} SELECT {TAG} AS tag, CAST(line AS VARCHAR) AS exon_number, count(*) AS n, count(DISTINCT tx) AS transcripts, count(DISTINCT gene) AS genes FROM gtf GROUP BY 1, 2")
def attributes_counted(spark, sf_dir):
    return annotation.counted(_rows(spark, sf_dir), "bag", ["tag", "exon_number"])


def _gene_list(spark, sf_dir):
    return load(spark, sf_dir, "part").where("p_size <= 20").select(F.concat(F.lit("g"), (F.col("p_partkey") % 500).cast("string")).alias("g"))


LIST = "l AS (SELECT 'g' || (p_partkey % 500) AS g FROM part WHERE p_size <= 20)"


@query(f"WITH {GTF}, {LIST} SELECT okey, pkey, line FROM gtf WHERE gene IN (SELECT g FROM l)")
def attributes_filtered(spark, sf_dir):
    return annotation.filtered(_rows(spark, sf_dir), "bag", "gene_id", _gene_list(spark, sf_dir), "g").select(*KEY)


@query(f"WITH {GTF}, {LIST} SELECT okey, pkey, line FROM gtf WHERE gene NOT IN (SELECT g FROM l)")
def attributes_filtered_out(spark, sf_dir):
    return annotation.filtered(_rows(spark, sf_dir), "bag", "gene_id", _gene_list(spark, sf_dir), "g", anti=True).select(*KEY)


@query(f"""WITH {GTF}, n AS (SELECT 'g' || (n_nationkey * 7) AS g, n_name FROM nation)
SELECT okey, pkey, line, 'gene_id "' || gene || '"; transcript_id "' || tx || '"; exon_number ' || line || ';' ||
 CASE WHEN n_name IS NOT NULL THEN ' tag "' || n_name || '";' WHEN pkey % 3 = 0 THEN ' tag "' || (pkey % 7) || '";' || CASE WHEN pkey % 6 = 0 THEN ' tag "extra";' ELSE '' END ELSE ' tag "none";' END AS attrs
FROM gtf LEFT JOIN n ON gene = g""")
def attributes_set(spark, sf_dir):
    names = load(spark, sf_dir, "nation").select(F.concat(F.lit("g"), (F.col("n_nationkey") * 7).cast("string")).alias("g"), "n_name")
    out = annotation.set_attribute(_rows(spark, sf_dir), "bag", "gene_id", names, "g", "n_name", "tag", default="none")
    return out.select(*KEY, annotation.written_bag("bag").alias("attrs"))


@query(f"WITH {GTF} SELECT okey, pkey, line, CASE WHEN pkey % 3 = 0 THEN gene || '|' || (pkey % 7) ELSE gene END AS id FROM gtf WHERE feature = 'exon'")
def compound_ids(spark, sf_dir):
    return _rows(spark, sf_dir).where("feature = 'exon'").select(*KEY, annotation.compound_id("bag", ["gene_id", "absent", "tag"]).alias("id"))


BLOCKS = f"""{GTF}, x AS (SELECT DISTINCT tx || '.' || chrom AS tx, chrom, strand, s, e FROM gtf), t AS (SELECT tx, chrom, strand, min(s) AS s, max(e) AS e, count(*) AS n, list(s ORDER BY s, e) AS ss, list(e ORDER BY s, e) AS es FROM x GROUP BY tx, chrom, strand)"""


@query(f"WITH {BLOCKS} SELECT tx, chrom, strand, s, e, CAST(n AS INTEGER) AS n, array_to_string(list_transform(range(1, n + 1), lambda i: CAST(es[i] - ss[i] AS VARCHAR)), ',') AS sizes, array_to_string(list_transform(ss, lambda x: CAST(x - s AS VARCHAR)), ',') AS starts FROM t")
def blocks_gathered(spark, sf_dir):
    rows = annotation.transcripts(_exons(spark, sf_dir))
    return rows.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("sizes", "starts")})


@query(f"WITH {BLOCKS}, u AS (SELECT tx, strand, n, ss, es, unnest(range(1, n + 1)) AS i FROM t) SELECT tx, ss[i] AS s, es[i] AS e, CASE WHEN strand = '-' THEN n - i + 1 ELSE i END AS ordinal FROM u")
def blocks_exploded(spark, sf_dir):
    rows = annotation.exons(annotation.transcripts(_exons(spark, sf_dir)))
    return rows.select("tx", "s", "e", F.col("ordinal").cast("long").alias("ordinal"))


@query(f"WITH {BLOCKS}, u AS (SELECT tx, ss, es, unnest(range(1, n)) AS i FROM t WHERE n > 1) SELECT tx, i AS ordinal, es[i] AS s, ss[i + 1] AS e FROM u")
def introns(spark, sf_dir):
    rows = annotation.introns(annotation.transcripts(_exons(spark, sf_dir)))
    return rows.select("tx", F.col("ordinal").cast("long").alias("ordinal"), "s", "e")


THICK = f"{BLOCKS}, u AS (SELECT tx, strand, s + 5 AS a, e - 7 AS b, ss, es, unnest(range(1, n + 1)) AS i FROM t), c AS (SELECT tx, strand, i, greatest(ss[i], a) AS s, least(es[i], b) AS e FROM u WHERE least(es[i], b) > greatest(ss[i], a))"


def _coding(spark, sf_dir):
    rows = annotation.transcripts(_exons(spark, sf_dir)).withColumns({"thick_start": F.col("s") + 5, "thick_end": F.col("e") - 7})
    return annotation.coding(rows)


@query(f"WITH {THICK} SELECT tx, s, e, CAST((3 - coalesce(sum(e - s) OVER (PARTITION BY tx, strand ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3) % 3 AS INTEGER) AS frame FROM c")
def coding_frames(spark, sf_dir):
    return _coding(spark, sf_dir).select("tx", "s", "e", "frame")


@query(f"""WITH {GTF}, m AS (SELECT DISTINCT okey, strand, s * 1000 AS s, s * 1000 + pkey % 5 + 1 AS e FROM gtf), k AS (SELECT okey, strand, s, max(e) AS e FROM m GROUP BY ALL),
b AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY okey ORDER BY CASE WHEN strand = '-' THEN s ELSE -e END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM k),
t AS (SELECT okey, CASE WHEN strand = '-' THEN s + greatest(0, least(3 - bef, e - s)) ELSE s END AS s, CASE WHEN strand = '-' THEN e ELSE e - greatest(0, least(3 - bef, e - s)) END AS e FROM b)
SELECT okey, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM t WHERE e > s""")
def stop_codons_removed(spark, sf_dir):
    rows = attributes(spark, sf_dir).select("okey", "strand", (F.col("s") * 1000).alias("s"), (F.col("s") * 1000 + F.col("pkey") % 5 + 1).alias("e"))
    rows = rows.groupBy("okey", "strand", "s").agg(F.max("e").alias("e"))
    return annotation.without_stop(rows, "okey").select("okey", "s", "e")


@query(f"""WITH {BLOCKS}, f AS (SELECT tx, chrom, strand, n, list_transform(range(2, 2 * n), lambda k: CAST(CASE WHEN k % 2 = 1 THEN ss[(k + 1) // 2] ELSE es[k // 2] END AS VARCHAR)) AS c FROM t WHERE n > 1)
SELECT chrom || ':' || array_to_string(c, '-') || ':' || strand AS chain, count(*) AS n, string_agg(tx, ',' ORDER BY tx) AS names FROM f GROUP BY 1""")
def splice_chains(spark, sf_dir):
    return annotation.splice_chains(annotation.transcripts(_exons(spark, sf_dir)))


@query(f"""WITH {GTF}, d AS (SELECT DISTINCT okey, chrom, strand, s, e FROM gtf), r AS (SELECT *, count(*) OVER (PARTITION BY okey, 1) AS n, row_number() OVER (PARTITION BY okey ORDER BY CASE WHEN strand = '+' THEN s ELSE -e END, CASE WHEN strand = '+' THEN -e ELSE s END, chrom) AS k FROM d),
m AS (SELECT okey, count(DISTINCT (s, e)) AS n FROM d GROUP BY okey) SELECT okey, s, e FROM r JOIN m USING (okey) WHERE k = 1 AND m.n > 1""")
def first_exons(spark, sf_dir):
    return annotation.terminal_exons(attributes(spark, sf_dir).select("okey", "chrom", "strand", "s", "e"), "okey").select("okey", "s", "e")


@query(f"""WITH {GTF}, p AS (SELECT gene, tx, chrom, strand, min(s) AS s, max(e) AS e, count(*) AS n FROM gtf GROUP BY ALL), g AS (SELECT gene, chrom, strand, min(s) AS s, max(e) AS e, max(n) AS exons FROM p GROUP BY ALL),
t AS (SELECT gene, chrom, strand, s + CASE WHEN strand = '+' THEN 10 ELSE 20 END AS s, e - CASE WHEN strand = '+' THEN 20 ELSE 10 END AS e, exons FROM g) SELECT * FROM t WHERE e - s >= 500""")
def gene_regions(spark, sf_dir):
    rows = _rows(spark, sf_dir).select(annotation.value("bag", "gene_id").alias("gene"), annotation.value("bag", "transcript_id").alias("tx"), "chrom", "strand", "s", "e")
    return annotation.gene_regions(rows, trim5=10, trim3=20)


@query(f"WITH {GTF} SELECT okey, min(chrom) AS chrom, min(strand) AS strand, min(s) AS s, max(e) AS e, max(line) AS score FROM gtf GROUP BY okey")
def features_merged_by_name(spark, sf_dir):
    rows = attributes(spark, sf_dir).withColumn("score", F.col("line"))
    return annotation.merged_features(rows.select("okey", "chrom", "strand", "s", "e", "score"), "okey", strict=False)


@query(f"""WITH {GTF}, g AS (SELECT gene, chrom, strand, min(s) AS s, max(e) AS e FROM gtf GROUP BY ALL), f AS (SELECT gene, chrom, strand, CASE WHEN strand = '+' THEN '5' ELSE '3' END AS side, greatest(0, s - 1050) AS s, greatest(0, s - 50) AS e FROM g
 UNION ALL SELECT gene, chrom, strand, CASE WHEN strand = '+' THEN '3' ELSE '5' END, e + 50, e + 1050 FROM g) SELECT * FROM f WHERE e > s""")
def gene_flanks(spark, sf_dir):
    rows = _rows(spark, sf_dir).groupBy(annotation.value("bag", "gene_id").alias("gene"), "chrom", "strand").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return annotation.gene_flanks(rows, 1000, 50)


@query(f"""WITH {GTF} SELECT okey, pkey, line, greatest(0, CASE WHEN strand = '+' THEN s ELSE e END - 100) AS tss, CASE WHEN strand = '+' THEN e ELSE s END + 101 AS tts_end, least(1000, greatest(0, pkey - 500)) AS score FROM gtf""")
def transcript_ends(spark, sf_dir):
    rows = annotation.transcript_ends(attributes(spark, sf_dir).withColumn("score", F.col("pkey") - 500), 100)
    return rows.select(*KEY, F.col("tss.s").alias("tss"), F.col("tts.e").alias("tts_end"), "score")


@query(f"""WITH RECURSIVE {GTF}, x AS (SELECT DISTINCT chrom, strand, tx || '.' || chrom AS tx, s, e FROM gtf),
m AS (SELECT *, max(e - 1) OVER (PARTITION BY chrom, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM x),
i AS (SELECT *, max(CASE WHEN far IS NULL OR s > far THEN s END) OVER (PARTITION BY chrom, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
l AS (SELECT DISTINCT a.tx AS a, b.tx AS b FROM i a JOIN i b USING (chrom, strand, island)),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen), c AS (SELECT node, min(seen) AS root FROM r GROUP BY node),
k AS (SELECT root, chrom, strand, island, max(e) AS e, list(DISTINCT tx) AS t FROM i JOIN c ON tx = node GROUP BY ALL)
SELECT chrom, strand, min(island) AS s, max(e) AS e, list(island ORDER BY island) AS starts, list(e ORDER BY island) AS ends, array_to_string(list_sort(list_distinct(flatten(list(t)))), '|') AS names FROM k GROUP BY root, chrom, strand""")
def transcripts_collapsed(spark, sf_dir):
    return annotation.collapsed_exons(_exons(spark, sf_dir))

"""Sequence operators over whole document texts as sequences, and orders as reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalane.functions import sequences as seqs
from stratalane.operators import reads
from stratalane.plans.catalog import query
from stratalane.session import load

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtnacgtacgtacgta"
SEQS = f"seqs AS (SELECT doc_id AS id, upper(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}')) AS seq FROM documents WHERE text IS NOT NULL)"
HEX, PHRED = "0123456789abcdef", "#%(+.147:=@BDFHI"
READS = f"reads AS (SELECT o_orderkey AS id, upper(translate(md5(CAST(o_orderkey AS VARCHAR)), '{HEX}', 'acgtacgtacgtacgt')) AS seq, translate(md5('q' || o_orderkey), '{HEX}', '{PHRED}') AS qual FROM orders)"


def sequences(spark, sf_dir):
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return load(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.upper(F.translate(letters, LETTERS, BASES)).alias("seq"))


def read_table(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.upper(F.translate(F.md5(k.cast("binary")), HEX, "acgtacgtacgtacgt")).alias("seq"), F.translate(F.md5(F.concat(F.lit("q"), k).cast("binary")), HEX, PHRED).alias("qual"))


@query(f"WITH {SEQS} SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM seqs")
def reverse_complement(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", seqs.reverse_complement("seq").alias("rc"))


def _n(characters: str, column: str = "seq") -> str:
    return f"(length({column}) - length(translate({column}, '{characters}', '')))"


@query(f"WITH {SEQS} SELECT id, length(seq) AS bases, {_n('Nn')} AS unknown, round(CASE WHEN {_n('ACGT')} > 0 THEN {_n('GC')} / {_n('ACGT')} END, 6) AS gc FROM seqs")
def sequence_info(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", F.length("seq").cast("long").alias("bases"), seqs.count_of("seq", "Nn").cast("long").alias("unknown"), F.round(seqs.gc_fraction("seq"), 6).alias("gc"))


@query("SELECT CAST(sum(length(text) - length(translate(text, 'eE', ''))) AS BIGINT) AS n FROM documents")
def characters_counted(spark, sf_dir):
    return load(spark, sf_dir, "documents").agg(F.sum(seqs.count_of("text", "eE")).alias("n"))


@query(f"""WITH {SEQS}, w AS (SELECT id, seq, unnest(range(0, length(seq) - 200 + 1, 50)) AS p0 FROM seqs WHERE length(seq) >= 200)
SELECT id, p0 + 100 AS middle, {_n('GC', 'substr(seq, p0 + 1, 200)')} AS gc FROM w""")
def gc_windows(spark, sf_dir):
    rows = sequences(spark, sf_dir).select("id", F.explode(seqs.window_counts("seq", "GC", 200, 50)).alias("w"))
    return rows.select("id", (F.col("w.start") + 100).cast("long").alias("middle"), F.col("w.n").cast("long").alias("gc"))


@query(f"""WITH {SEQS}, c AS (SELECT id, unnest(range(0, CAST(greatest(0, ceil((length(seq) - 900) / 600)) AS BIGINT) * 600 + 1, 600)) AS p0, seq FROM seqs WHERE length(seq) > 0)
SELECT id, 0 AS fragment, p0 + 1 AS start, least(p0 + 900, length(seq)) AS stop, md5(substr(seq, p0 + 1, 900)) AS sum FROM c""")
def sequence_pieces(spark, sf_dir):
    rows = reads.pieces(sequences(spark, sf_dir), "id", "seq", 900, 300)
    return rows.select("id", "fragment", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.md5(F.col("piece").cast("binary")).alias("sum"))


@query(f"""WITH {SEQS}, l AS (SELECT length(seq) AS n, id FROM seqs WHERE length(seq) >= 150), c AS (SELECT n, sum(n) OVER (ORDER BY n, id) AS upto, sum(n) OVER () AS al FROM l)
SELECT count(*) AS count, CAST(sum(n) AS BIGINT) AS total, min(n) AS min, max(n) AS max, sum(n) / count(*) AS mean, median(n) AS median, arg_min(n, (abs(upto - al * 0.1), n)) AS n90, arg_min(n, (abs(upto - al * 0.5), n)) AS n50, arg_min(n, (abs(upto - al * 0.9), n)) AS n10 FROM c""")
def assembly_lengths(spark, sf_dir):
    return reads.length_statistics(sequences(spark, sf_dir).select(F.length("seq").alias("n")), "n")


@query(f"WITH {SEQS} SELECT id FROM seqs WHERE length(seq) BETWEEN 500 AND 5000")
def sequences_by_size(spark, sf_dir):
    return sequences(spark, sf_dir).where(F.length("seq").between(500, 5000)).select("id")


@query(f"""WITH {READS}, q AS (SELECT id, i, ascii(substr(qual, i, 1)) - 33 AS q FROM reads, range(1, 33) r(i)), f AS (SELECT *, sum(CASE WHEN q < 28 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS failed FROM q),
s AS (SELECT id, coalesce(min(i) FILTER (q <= 12 OR (q < 28 AND failed > 10)), 33) AS stop FROM f GROUP BY id), k AS (SELECT id, coalesce(max(i) FILTER (q >= 28 AND i < stop), 0) AS n FROM f JOIN s USING (id) GROUP BY id)
SELECT id, substr(seq, 1, n) AS seq, substr(qual, 1, n) AS qual FROM reads JOIN k USING (id) WHERE n >= 3""")
def quality_trimmed(spark, sf_dir):
    return reads.quality_trimmed(read_table(spark, sf_dir), shortest=3)


@query(f"WITH {READS} SELECT id, substr(substr(seq, 4), 1, 20) AS head, right(seq, 7) AS tail FROM reads")
def length_trimmed(spark, sf_dir):
    return read_table(spark, sf_dir).select("id", seqs.cut("seq", front=3, longest=20).alias("head"), seqs.cut("seq", tail=7).alias("tail"))


@query(f"WITH {READS} SELECT id, list_reduce(list_transform(range(1, 33), lambda i: chr(ascii(substr(qual, i, 1)) + 31)), lambda a, b: a || b) AS up, qual AS back FROM reads")
def quality_recoded(spark, sf_dir):
    q = F.col("qual")
    up = F.translate(q, "".join(map(chr, range(33, 96))), "".join(map(chr, range(64, 127))))
    return read_table(spark, sf_dir).select("id", up.alias("up"), seqs.requalified(up).alias("back"))


SHEET = (("ACGT", "one", 4), ("CCAA", "two", 6), ("GTGG", "three", 4), ("CCAC", "four", 2))
CODES = ", ".join(f"('{c}', '{s}', {t})" for c, s, t in SHEET)
DISTANCE = " + ".join(f"CAST(substr(seq, {i}, 1) <> substr(code, {i}, 1) AS INT)" for i in range(1, 5))


@query(f"WITH {READS}, b(code, sample, trim) AS (VALUES {CODES}), m AS (SELECT id, count(*) AS n, any_value(sample) AS sample, any_value(trim) AS trim FROM reads, b WHERE {DISTANCE} <= 1 GROUP BY id) SELECT id, CASE WHEN n = 1 THEN sample END AS sample, CASE WHEN n = 1 THEN substr(seq, trim + 1) ELSE seq END AS seq FROM reads LEFT JOIN m USING (id)")
def demultiplexed(spark, sf_dir):
    return reads.demultiplexed(read_table(spark, sf_dir), SHEET).select("id", "sample", "seq")


@query("""WITH b AS (SELECT p_brand AS name, upper(translate(substr(md5(p_brand), 1, 12), '0123456789abcdef', 'acgtacgtacgtacgt')) AS code FROM part GROUP BY p_brand),
d AS (SELECT a.name, o.name AS other, list_sum(list_transform(range(1, 13), lambda i: CAST(substr(a.code, i, 1) <> substr(o.code, i, 1) AS INT))) AS d FROM b a JOIN b o ON a.name <> o.name)
SELECT name, CAST(min(d) AS BIGINT) AS distance, arg_min(other, (d, other)) AS closest FROM d GROUP BY name""")
def closest_barcodes(spark, sf_dir):
    brands = load(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    code = F.upper(F.translate(F.substr(F.md5(F.col("name").cast("binary")), F.lit(1), F.lit(12)), HEX, "acgtacgtacgtacgt"))
    found = reads.closest_barcodes(brands.withColumn("code", code))
    return found.withColumn("distance", F.col("distance").cast("long"))


@query(f"WITH {READS} SELECT id FROM reads WHERE contains(seq, 'ACGTA') OR contains(seq, 'TACGT')")
def reads_containing(spark, sf_dir):
    return reads.containing(read_table(spark, sf_dir), "ACGTA", either_strand=True).select("id")


@query(f"WITH {READS} SELECT id FROM reads WHERE len(list_filter(range(1, length(seq) + 1), lambda i: len(list_filter(range(8, 13), lambda n: levenshtein(substr(seq, i, n), 'ACGTACGTAC') <= 2)) > 0)) > 0")
def reads_containing_approximately(spark, sf_dir):
    return reads.containing(read_table(spark, sf_dir), "ACGTACGTAC", edits=2).select("id")


PRIMERS = (("p1", "ACGTAC", "TTACGG"), ("p2", "GGGG", "CCCC"), ("p3", "ACGTACGTACGTACGT", "AAAA"))


@query(f"""WITH {SEQS}, p(primer, f, rv) AS (VALUES {', '.join(map(str, PRIMERS))}), x AS (SELECT primer, f, reverse(translate(rv, 'ACGT', 'TGCA')) AS r FROM p), s AS (SELECT id, seq AS w, reverse(translate(seq, 'ACGT', 'TGCA')) AS c FROM seqs),
y AS (SELECT primer, id, f, r, instr(w, f) AS wf, CASE WHEN instr(reverse(w), reverse(r)) > 0 THEN length(w) - instr(reverse(w), reverse(r)) - length(r) + 2 ELSE 0 END AS wr,
 instr(c, f) AS cf, CASE WHEN instr(reverse(c), reverse(r)) > 0 THEN length(c) - instr(reverse(c), reverse(r)) - length(r) + 2 ELSE 0 END AS cr FROM x, s),
z AS (SELECT primer, id, r, CASE WHEN wf > 0 AND wr > 0 THEN wf ELSE cf END AS a, CASE WHEN wf > 0 AND wr > 0 THEN wr ELSE cr END AS b FROM y), h AS (SELECT primer, CAST(id AS VARCHAR) AS match_id, b + length(r) - a AS fragment FROM z WHERE a > 0 AND b > 0 AND a < b)
SELECT primer, match_id, fragment FROM p LEFT JOIN h USING (primer)""")
def primer_products(spark, sf_dir):
    primers = spark.createDataFrame(list(PRIMERS), "primer string, fwd string, rev string")
    return reads.primer_products(primers, sequences(spark, sf_dir).withColumn("id", F.col("id").cast("string"))).withColumn("fragment", F.col("fragment").cast("long"))


@query(f"WITH {READS} SELECT o.id, list_reduce(list_transform(range(0, 10), lambda k: coalesce(substr('{seqs.CODE}', CAST(16 * (instr('TCAG', substr(seq, 3 * k + 1, 1)) - 1) + 4 * (instr('TCAG', substr(seq, 3 * k + 2, 1)) - 1) + instr('TCAG', substr(seq, 3 * k + 3, 1)) AS INT), 1), 'X')), lambda a, b: a || b) AS protein FROM reads o")
def translated(spark, sf_dir):
    return read_table(spark, sf_dir).select("id", seqs.translated("seq").alias("protein"))


GENO = "g AS (SELECT p_partkey AS variant, s.k AS sample, (p_partkey * (s.k + 3) + p_size) % 3 AS a, (p_partkey * 7 + s.k * p_size) % 2 AS b FROM part, range(0, 5) s(k))"


def _genotypes(spark, sf_dir):
    k, p, size = F.col("sample"), F.col("p_partkey"), F.col("p_size")
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("sample"))
    call = F.concat(((p * (k + 3) + size) % 3).cast("string"), F.lit("/"), ((p * 7 + k * size) % 2).cast("string"), F.lit(":99"))
    return rows.select(F.col("p_partkey").alias("variant"), "sample", call.alias("gt"))


@query(f"WITH {GENO} SELECT x.sample AS a, y.sample AS b, CAST(sum(CASE WHEN x.sample = y.sample THEN CAST(x.a <> x.b AS INT) ELSE CAST(least(x.a, x.b) <> least(y.a, y.b) OR greatest(x.a, x.b) <> greatest(y.a, y.b) AS INT) END) AS BIGINT) AS n FROM g x JOIN g y ON x.variant = y.variant AND x.sample <= y.sample GROUP BY ALL")
def genotype_differences(spark, sf_dir):
    """Heterozygous calls on the diagonal, differing genotypes off it; the samples of one variant are one row's array."""
    from stratalane.operators.variants import genotype_matrix

    return genotype_matrix(_genotypes(spark, sf_dir), "variant", "sample", "gt")


@query(f"""WITH {GENO}, c AS (SELECT sample, variant, list_sort(list_distinct([['A', 'C', 'G'][a + 1], ['A', 'C', 'G'][b + 1]])) AS l FROM g)
SELECT sample, string_agg(CASE array_to_string(l, '') WHEN 'AC' THEN 'M' WHEN 'AG' THEN 'R' WHEN 'CG' THEN 'S' ELSE array_to_string(l, '') END, '' ORDER BY variant) AS calls FROM c GROUP BY sample""")
def genotype_calls(spark, sf_dir):
    from stratalane.operators.variants import calls

    return calls(_genotypes(spark, sf_dir), "variant", "sample", "gt", F.array(F.lit("A"), F.lit("C"), F.lit("G")))

"""Readers of delimited tables and of annotation, track, alignment and sequence formats.

All read through Spark, so any store and any split size will do, and compressed files go by their extension. Formats
whose records span lines are read with a record separator where they have one, or by numbered lines; FASTQ by a file at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalane.operators import annotation
from stratalane.operators.intervals import running
from stratalane.session import written

BED = ("chrom", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "rgb", "block_count", "block_sizes", "block_starts")
GFF = ("chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attrs")
PSL = ("matches", "mismatches", "repmatches", "ns", "qgaps", "qgapbases", "tgaps", "tgapbases", "strand", "query", "qsize", "qstart", "qend", "target", "tsize", "tstart", "tend", "blocks", "sizes", "qstarts", "tstarts")
BLAST = ("query", "subject", "identity", "length", "mismatches", "gaps", "qstart", "qend", "sstart", "send", "evalue", "bits", "qlen")
VCF = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
QSEQ = ("machine", "run", "lane", "tile", "x", "y", "index", "mate", "seq", "qual", "passed")
JUNCTIONS = ("chrom", "start", "end", "strand", "motif", "annotated", "unique", "multiple", "overhang")
DOMAINS = ("acc", "md5", "len", "analysis", "sig", "description", "start", "end", "score", "status", "date", "ipr", "ipr_description", "go")


def lines(spark: SparkSession, path: str | Sequence[str], comments: bool = True) -> DataFrame:
    """Lines that hold data: no blank ones, no comments, no track or browser lines."""
    rows = spark.read.text(path if isinstance(path, str) else list(path)).withColumn("value", F.regexp_replace("value", "[\r\n]+$", ""))
    skip = r"^\s*$|^\s*#|^(track|browser)(\s|$)" if comments else r"^\s*$"
    return rows.where(~F.col("value").rlike(skip))


def fields(rows: DataFrame, names: Sequence[str], sep: str = "\t", line: str = "value") -> DataFrame:
    """Columns by place; what a short row lacks is null, what a long one has over is left out."""
    parts = F.split(F.col(line), sep)
    return rows.select(*(c for c in rows.columns if c != line), *(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns cast where their text allows it, null where it does not."""
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})


def table(spark: SparkSession, path: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """A delimited table of strings; the header may be a comment line, and is the first line of the first file."""
    if not header:
        one = lines(spark, path).select(F.size(F.split("value", sep)).alias("n")).agg(F.max("n")).first()[0] or 0
        return fields(lines(spark, path), [f"c{i + 1}" for i in range(one)], sep)
    first = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$")).first()
    if first is None:
        return spark.createDataFrame([], "c1 string")
    head = first.value.rstrip("\r\n")
    names = [n.strip() for n in head.lstrip("#").lstrip().split("\t" if sep == "\t" else sep)]
    if len(set(names)) < len(names):
        raise ValueError(f"a column name repeats: {names}")
    return fields(lines(spark, path).where(F.col("value") != head), names, sep)


def bed(spark: SparkSession, path: str) -> DataFrame:
    """BED of any number of columns, 0-based and half-open, blocks as arrays."""
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.try_cast("long"))
    rows = typed(fields(lines(spark, path), BED), start="long", end="long", score="double", thick_start="long", thick_end="long", block_count="int")
    return rows.withColumns({"block_sizes": numbers("block_sizes"), "block_starts": numbers("block_starts")})


def gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF or GTF, 1-based and inclusive; `.` is null, starts beyond ends are swapped, attributes are a bag."""
    rows = typed(fields(lines(spark, path), GFF), start="long", end="long", score="double", frame="int")
    rows = rows.withColumns({"start": F.least("start", "end"), "end": F.greatest("start", "end"), "strand": F.when(F.col("strand") == "1", "+").when(F.col("strand").isin("+", "-"), F.col("strand"))})
    return rows.withColumn("bag", annotation.parsed("attrs"))


def sgr(spark: SparkSession, path: str) -> DataFrame:
    return typed(fields(lines(spark, path), ("chrom", "pos", "v")), pos="long", v="double")


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return typed(fields(lines(spark, path), ("chrom", "s", "e", "v")), s="long", e="long", v="double")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value): lines by their number in their file. Files are read in splits, whose lines are counted to number them.

    Lines are laid down once, as another reading could be split in another way.
    """
    raw = spark.read.text(path, lineSep="\n").select(F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("block"), F.monotonically_increasing_id().alias("m"), F.regexp_replace("value", "\r$", "").alias("value"))
    raw = written(raw, "lines")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "block").agg(F.min("m").alias("__m"), F.count("*").alias("__many"))  # one row a split
    splits = splits.select("file", "block", (F.coalesce(F.sum("__many").over(before), F.lit(0)) - F.col("__m")).alias("__shift"))
    rows = raw.where(~F.col("value").rlike(r"^\s*$|^\s*#|^(track|browser)(\s|$)")).join(F.broadcast(splits), ["file", "block"])
    return rows.select("file", (F.col("m") + F.col("__shift")).alias("n"), "value")


def _headed(rows: DataFrame, head: Column, /, **said: Column) -> DataFrame:
    """Rows that are no heads, below the last head of their file before them, if any: what it said, its number `at` and the row's
    number `k` since it. Files are worked through in slices of lines."""
    rows = rows.withColumn("__head", F.coalesce(head, F.lit(False))).withColumn("__one", F.when(F.col("__head"), 0).otherwise(1))
    rows = running(rows, ("file",), ("n",), {"__k": ("sum", "__one")})
    rows = rows.withColumn("__of", F.when(F.col("__head"), F.struct(F.col("n").alias("at"), F.col("__k").alias("k"), *(c.alias(c_) for c_, c in said.items()))))
    body = running(rows, ("file",), ("n",), {"__last": ("max", "__of")}).where("NOT __head")
    return body.select("file", "n", "value", *(F.col(f"__last.{c}").alias(c) for c in ("at", *said)), (F.col("__k") - F.col("__last.k")).alias("k"))


def wig(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, span, v, v2) of fixedStep and variableStep tracks; v2 is the second strand's value where there is one."""
    field = lambda name, otherwise=None: F.coalesce(F.nullif(F.regexp_extract("value", rf"{name}=(\S+)", 1), F.lit("")), F.lit(otherwise))
    body = _headed(_numbered(spark, path), F.col("value").rlike("^(fixedStep|variableStep)"), kind=F.regexp_extract("value", r"^(\w+)", 1), chrom=field("chrom"), first=field("start", "1"), step=field("step", "1"), span=field("span", "1"))
    parts = F.split(F.trim("value"), r"\s+")
    fixed = F.col("kind") == "fixedStep"
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return body.select("chrom", F.when(fixed, F.col("first").cast("long") + F.col("step").cast("long") * F.col("k")).otherwise(F.get(parts, F.lit(0)).try_cast("long")).alias("pos"), F.col("span").cast("long").alias("span"), F.when(fixed, number(0)).otherwise(number(1)).alias("v"), F.when(~fixed, number(2)).alias("v2"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq): records are split at `>` at the beginning of a line, so large files are read in parallel."""
    rows = spark.read.text(path, lineSep="\n>").withColumn("value", F.regexp_replace("value", "^>", "")).where(~F.col("value").rlike(r"^\s*$"))
    head, body = F.regexp_extract("value", r"^([^\r\n]*)", 1), F.regexp_extract("value", r"^[^\r\n]*\r?\n?([\s\S]*)$", 1)
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.regexp_extract(head, r"^\S*\s*([\s\S]*)$", 1).alias("description"), F.regexp_replace(body, r"\s+", "").alias("seq"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual, n) of FASTQ, n the record's number in its file; sequences and qualities may run over several lines.

    Qualities may hold any mark, so a record's end is known only from its beginning: a file is one stream, walked line by
    line. Give large inputs as many files, as sequencers do.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                yield from (pd.DataFrame(part, columns=["name", "seq", "qual", "n"]) for part in _records(bytes(content)))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string, seq string, qual string, n long")


def _records(content: bytes, most: int = 20_000):
    import gzip
    import io

    source = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    text, out, n = io.TextIOWrapper(source, encoding="ascii", errors="replace"), [], 0
    line = text.readline()
    while line:
        if not line.strip():
            line = text.readline()
            continue
        if line[0] != "@":
            raise ValueError(f"no FASTQ record: {line[:40]!r}")
        name, seq, qual = line[1:].rstrip("\r\n"), "", ""
        line = text.readline()
        while line and line[0] != "+":
            seq += line.strip()
            line = text.readline()
        line = text.readline()
        while line and len(qual) < len(seq):
            qual += line.rstrip("\r\n")
            line = text.readline()
        if len(qual) != len(seq):
            raise ValueError(f"{name}: {len(seq)} bases and {len(qual)} qualities")
        out.append((name, seq, qual, n))
        n += 1
        if len(out) == most:
            yield out
            out = []
    if out:
        yield out


def qseq(spark: SparkSession, path: str, all_reads: bool = False) -> DataFrame:
    rows = fields(lines(spark, path, comments=False), QSEQ)
    rows = rows if all_reads else rows.where("passed = '1'")
    return rows.select(F.concat_ws(":", *QSEQ[:6]).alias("name"), F.translate("seq", ".", "N").alias("seq"), "qual")


def psl(spark: SparkSession, path: str) -> DataFrame:
    """BLAT hits; header lines don't begin with a digit."""
    rows = fields(lines(spark, path).where(F.col("value").rlike(r"^\d")), PSL)
    return typed(rows, **dict.fromkeys(("matches", "mismatches", "qsize", "qstart", "qend", "tsize", "tstart", "tend"), "long"))


def blast(spark: SparkSession, path: str) -> DataFrame:
    whole = dict.fromkeys(("length", "mismatches", "gaps", "qstart", "qend", "sstart", "send", "qlen"), "long")
    return typed(fields(lines(spark, path), BLAST), **whole, identity="double", evalue="double", bits="double")


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants with the genotypes of their samples as an array."""
    parts = F.split("value", "\t")
    rows = lines(spark, path).withColumn("genotypes", F.slice(parts, 10, 1 << 20))
    return typed(fields(rows, VCF), pos="long", qual="double").select(*VCF, "genotypes")


def junctions(spark: SparkSession, path: str) -> DataFrame:
    """Splice junctions with numeric strands 0, 1, 2 as `.`, `+`, `-`."""
    rows = typed(fields(lines(spark, path), JUNCTIONS), start="long", end="long", motif="int", annotated="int", unique="long", multiple="long", overhang="long")
    return rows.withColumn("strand", F.when(F.col("strand") == "1", "+").when(F.col("strand") == "2", "-").otherwise("."))


def domains(spark: SparkSession, path: str) -> DataFrame:
    """Protein domain hits; `go` as an array of terms."""
    return fields(lines(spark, path), DOMAINS).withColumn("go", F.filter(F.split(F.coalesce("go", F.lit("")), r"\|"), lambda x: x != ""))


def gene_sets(spark: SparkSession, path: str, described: bool = False) -> DataFrame:
    """(name, member) from lines of a name (a description) and members."""
    parts = F.split("value", "\t")
    return lines(spark, path).select(F.get(parts, F.lit(0)).alias("name"), F.explode(F.filter(F.slice(parts, 3 if described else 2, 1 << 20), lambda x: x != "")).alias("member"))


def blocks(spark: SparkSession, path: str, head: str) -> DataFrame:
    """(file, block, head, n, value): lines under the last line above them that matches `head`, as in block and brace formats."""
    rows = _headed(_numbered(spark, path), F.col("value").rlike(head), head=F.col("value")).where("at IS NOT NULL")
    return rows.select("file", F.col("at").alias("block"), "head", "n", "value")


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """AXT blocks: header fields with the two aligned sequences."""
    rows = spark.read.text(path, lineSep="\n\n").where(~F.col("value").rlike(r"^\s*$"))
    l = F.split(F.regexp_replace(F.regexp_replace("value", r"(?m)^#.*$", ""), r"^\s+", ""), "\r?\n")  # noqa: E741
    return typed(fields(rows.select(F.get(l, F.lit(0)).alias("value"), F.get(l, F.lit(1)).alias("ref"), F.get(l, F.lit(2)).alias("other")), ("id", "chrom", "s", "e", "chrom2", "s2", "e2", "strand", "score"), " "), s="long", e="long", s2="long", e2="long")

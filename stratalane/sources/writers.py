"""Sinks: delimited tables, tables split by a column or a size, sequences, tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalane.functions.sequences import wrapped


def delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = True, missing: str = "") -> None:
    df.write.option("compression", "none").csv(path, sep=sep, header=header, nullValue=missing, emptyValue="", quote="")


def file_name(column: str) -> Column:
    """A value as part of a file name: brackets, quotes and slashes go, blanks become `_`."""
    return F.regexp_replace(F.regexp_replace(F.col(column).cast("string"), "['\"(){}/\\\\]", ""), " ", "_")


def split_on(df: DataFrame, column: str, path: str, most: int = 500, sep: str = "\t") -> None:
    """A folder of files for each value of a column; more than `most` values are an error, found before anything is written."""
    found = df.select(column).distinct().limit(most + 1).count()
    if found > most:
        raise ValueError(f"{column} has more than {most} values")
    df.withColumn("__to", file_name(column)).write.partitionBy("__to").csv(path, sep=sep, header=True)


def chunk_by_count(df: DataFrame, order: str, size: int) -> DataFrame:
    """df with `chunk`, so many rows each in the order of a numeric column."""
    from stratalane.operators.intervals import running

    rows = running(df.withColumns({"__all": F.lit(0), "__one": F.lit(1)}), ["__all"], (order,), {"__before": ("sum", "__one")})
    return rows.withColumn("chunk", F.floor(F.col("__before") / size)).drop("__all", "__one", "__before")


def chunk_by_size(df: DataFrame, order: str, length: str, size: int) -> DataFrame:
    """df with `chunk`: rows belong to the chunk in which their first unit lies when lengths are laid end to end."""
    from stratalane.operators.intervals import running

    rows = running(df.withColumn("__all", F.lit(0)), ["__all"], (order,), {"__before": ("sum", length)})
    return rows.withColumn("chunk", F.floor(F.col("__before") / size)).drop("__all", "__before")


def fasta_lines(df: DataFrame, name: str = "id", seq: str = "seq", width: int = 60) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrapped(seq, width)).alias("value"))


def fastq_lines(df: DataFrame, name: str = "name", seq: str = "seq", qual: str = "qual") -> DataFrame:
    return df.select(F.concat(F.lit("@"), F.col(name), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(qual)).alias("value"))


def text(df: DataFrame, path: str, compression: str = "none", by: str | None = None) -> None:
    """One-column rows as lines; `by` makes a folder a value, as of a sample."""
    out = df.write.option("compression", compression)
    (out.partitionBy(by) if by else out).text(path)


def bed_lines(df: DataFrame) -> DataFrame:
    """Rows of intervals (chrom, s, e and what of name, score, strand they have) as BED lines."""
    have = [c for c in ("chrom", "s", "e", "name", "score", "strand") if c in df.columns]
    return df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in have)).alias("value"))


def wig_lines(df: DataFrame, by: str = "chrom", pos: str = "pos", value: str = "v") -> DataFrame:
    """(chrom, pos, value): variable-step lines, each chromosome's header with its first one; order them by chrom and pos to write."""
    first = F.row_number().over(Window.partitionBy(by).orderBy(pos)) == 1
    line = F.concat_ws(" ", F.col(pos).cast("string"), F.col(value).cast("string"))
    return df.select(by, pos, F.when(first, F.concat(F.lit("variableStep chrom="), F.col(by).cast("string"), F.lit("\n"), line)).otherwise(line).alias("value"))

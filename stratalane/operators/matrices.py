"""Numeric matrices: as rows with an array of values, or long as (row, column, value). Wide columns appear only at the edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_band(x: Column, above: float | None = None, below: float | None = None, or_equal: bool = False) -> Column:
    """Between above and below; outside of them where above exceeds below; one of them alone is a bound."""
    over = None if above is None else (x >= above if or_equal else x > above)
    under = None if below is None else (x <= below if or_equal else x < below)
    if over is None or under is None:
        return under if over is None else over
    return over & under if above <= below else over | under


def filter_rows(df: DataFrame, values: str, count: int = 1, **band) -> DataFrame:
    """Rows with at least `count` cells in a band."""
    return df.where(F.size(F.filter(values, lambda x: in_band(x, **band))) >= count)


def column_hits(long: DataFrame, column: str, value: str, **band) -> DataFrame:
    return long.groupBy(column).agg(F.sum(F.when(in_band(F.col(value), **band), 1).otherwise(0)).alias("hits"))


def filter_columns(long: DataFrame, column: str, value: str, count: int = 1, **band) -> DataFrame:
    """Cells of columns with at least `count` cells in a band (and at least one); columns are few next to cells."""
    keep = column_hits(long, column, value, **band).where(F.col("hits") >= max(count, 1)).select(column)
    return long.join(keep, column, "left_semi").select(long.columns)


def melted(df: DataFrame, row: str, values: str, name: str = "ix") -> DataFrame:
    """(row, ix, value) from rows with an array."""
    return df.select(row, F.posexplode(values).alias(name, "value"))


def gathered(long: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Rows with their values in column order, from long form."""
    return long.groupBy(row).agg(F.transform(F.sort_array(F.collect_list(F.struct(column, value))), lambda x: x[value]).alias("values"))


def scaled(df: DataFrame, factor: float, columns: Sequence[str] = (), arrays: Sequence[str] = ()) -> DataFrame:
    changed = {c: F.col(c) * factor for c in columns} | {c: F.transform(c, lambda x: x * factor) for c in arrays}
    return df.withColumns(changed)


def centred(long: DataFrame, by: str, value: str) -> DataFrame:
    """Values less the mean of their row or column, over its standard deviation (null where that is 0)."""
    stats = long.groupBy(by).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
    return long.join(stats, by).withColumn(value, F.try_divide(F.col(value) - F.col("__mean"), F.when(F.col("__sd") != 0, F.col("__sd")))).select(long.columns)


def frequency_table(df: DataFrame, key: str, cell: str, categories: Sequence[str] | None = None) -> DataFrame:
    """Cells of `k:v,k:v` summed by category, a column each; without categories one job finds them."""
    pairs = df.select(key, F.explode(F.split(cell, ",")).alias("p")).select(key, F.trim(F.split_part("p", F.lit(":"), F.lit(1))).alias("k"), F.expr("try_cast(split_part(p, ':', 2) AS double)").alias("v"))
    names = categories if categories is not None else sorted(r.k for r in pairs.select("k").distinct().collect())
    return pairs.groupBy(key).pivot("k", list(names)).agg(F.sum("v")).na.fill(0, list(names))


def zero_padded(df: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """df with rows of zeros for listed ids that it lacks."""
    values = [c for c in df.columns if c != key]
    absent = ids.select(F.col(id_column).alias(key)).distinct().join(df.select(key), key, "left_anti")
    return df.unionByName(absent.select(key, *(F.lit(0).cast(df.schema[c].dataType).alias(c) for c in values)))


def merged(frames: Mapping[str, DataFrame], key: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Wide matrices side by side by key, columns named `frame.column`, with their weights in a row EWEIGHT if given."""
    long = reduce(DataFrame.unionByName, (f.unpivot([key], [c for c in f.columns if c != key], "__c", "__v").select(F.col(key).cast("string").alias(key), F.concat(F.lit(n + "."), "__c").alias("__c"), F.col("__v").cast("double").alias("__v")) for n, f in frames.items()))
    names = [f"{n}.{c}" for n, f in frames.items() for c in f.columns if c != key]
    wide = long.groupBy(key).pivot("__c", names).agg(F.first("__v"))
    if weights:
        row = wide.sparkSession.range(1).select(F.lit("EWEIGHT").alias(key), *(F.lit(float(weights[n.split(".")[0]])).alias(n) for n in names))
        wide = row.unionByName(wide)
    return wide


def by_strand(forward: DataFrame, reverse: DataFrame, strand: str = "strand", antisense: bool = False) -> DataFrame:
    """Rows measured on their own strand (or the other one), from matrices of the two strands."""
    if forward.columns != reverse.columns:
        raise ValueError("the matrices have different columns")
    plus, minus = ("-", "+") if antisense else ("+", "-")
    return forward.where(F.col(strand) == plus).unionByName(reverse.where(F.col(strand) == minus))

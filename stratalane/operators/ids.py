"""Identifier algebra: semi, anti and ordered joins by ids, set operations, remapping, N-way joins, column selection.

Ids are trimmed and compared without case unless told otherwise. A cell with a separator holds several ids. Rows keep
their multiplicity and text; order is not part of a result but where an ordinal says so. Null keys match nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_of(column: Column | str, case: bool = False) -> Column:
    k = F.trim(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))
    return k if case else F.lower(k)


def assert_unique(df: DataFrame, *columns: str) -> DataFrame:
    """df, after a job that makes sure that no values of the columns repeat."""
    twice = df.groupBy(*columns).count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"not unique: {[tuple(r)[:-1] for r in twice]}")
    return df


def remap(ids: DataFrame, column: str, mapping: DataFrame, old: str, new: str, case: bool = False) -> DataFrame:
    """ids with `column` replaced through a mapping that must be one to one; ids that it lacks stay."""
    named = mapping.select(key_of(old, case).alias("__old"), F.col(new).cast("string").alias("__new"))
    assert_unique(named, "__old"), assert_unique(named, "__new")
    return ids.join(named, key_of(column, case) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", F.col(column).cast("string"))).drop("__old", "__new")


def by_ids(df: DataFrame, column: str, ids: DataFrame, id_column: str, anti: bool = False, sep: str | None = None, case: bool = False, any_absent: bool = False) -> DataFrame:
    """Rows of df whose cell is among the ids, or is not if anti. With `sep`, one of the cell's ids is enough.

    any_absent keeps, if anti and sep, rows with at least one id that is not listed, rather than those with none.
    Only the distinct cells are taken apart and matched, so that df itself is not exploded.
    """
    wanted = ids.select(key_of(id_column, case).alias("__key")).where("__key IS NOT NULL").distinct()
    if sep is None:
        return df.withColumn("__key", key_of(column, case)).join(wanted, "__key", "left_anti" if anti else "left_semi").select(df.columns)
    cells = df.select(F.col(column).alias("__cell")).distinct().withColumn("__part", F.explode(F.split(F.col("__cell").cast("string"), "[" + "".join("\\" + c for c in sep) + "]")))
    keyed = cells.withColumn("__key", key_of("__part", case))
    if anti and any_absent:
        hit, how = keyed.join(wanted, "__key", "left_anti"), "left_semi"
    else:
        hit, how = keyed.join(wanted, "__key", "left_semi"), "left_anti" if anti else "left_semi"
    return df.join(hit.select("__cell").distinct(), F.col(column) == F.col("__cell"), how).select(df.columns)


def in_order_of(df: DataFrame, column: str, ids: DataFrame, id_column: str, ordinal: str, case: bool = False) -> DataFrame:
    """Rows of df that are listed, with the ordinal that they have in the list; both sides must be unique."""
    listed = assert_unique(ids.select(key_of(id_column, case).alias("__key"), F.col(ordinal).alias("ordinal")), "__key")
    return assert_unique(df.withColumn("__key", key_of(column, case)), "__key").join(listed, "__key").drop("__key")


def join_by_ids(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", fill: str | None = None, case: bool = True) -> DataFrame:
    """inner, left, right or anti join that leaves the key in its place on the left and out on the right; fill is for what has no partner."""
    if how == "anti":
        return left.withColumn("__k", key_of(left_key, case)).join(right.select(key_of(right_key, case).alias("__k")), "__k", "left_anti").select(left.columns)
    a, b = left.withColumn("__k", key_of(left_key, case)), right.withColumn("__k", key_of(right_key, case))
    rest = [c for c in right.columns if c != right_key]
    met = a.join(b.select("__k", F.col(right_key).alias("__right_key"), *rest), "__k", how)
    key = F.coalesce(F.col(left_key).cast("string"), F.col("__right_key").cast("string")) if how == "right" else F.col(left_key)
    out = met.select(*(key.alias(c) if c == left_key else F.col(c) for c in left.columns), *rest)
    return out if fill is None else out.select(*(F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias(c) for c in out.columns))


def multi_join(frames: Mapping[str, DataFrame], key: str, value: str, common: bool = False, fill: str | None = None, case: bool = False) -> DataFrame:
    """One column of `value` a frame, by key: one shuffle of all frames together, however many there are."""
    tagged = [f.select((F.upper(key_of(key, True)) if not case else key_of(key, True)).alias(key), F.lit(n).alias("__from"), F.col(value).cast("string").alias("__v")) for n, f in frames.items()]
    wide = reduce(DataFrame.unionByName, tagged).groupBy(key).pivot("__from", list(frames)).agg(F.first("__v", ignorenulls=True))
    if common:
        wide = wide.dropna(subset=list(frames))
    return wide if fill is None else wide.na.fill(fill, list(frames))


def unique_ids(df: DataFrame, column: str, ordinal: str, sep: str | None = None, case: bool = False) -> DataFrame:
    """Distinct ids in the spelling of their first row by ordinal."""
    rows = df.select(F.col(column).cast("string").alias("id"), F.col(ordinal).alias("ordinal"))
    if sep is not None:
        rows = rows.withColumn("id", F.explode(F.split("id", sep)))
    rows = rows.withColumn("id", F.trim("id"))
    first = F.min(F.struct("ordinal", "id"))
    return rows.groupBy(key_of("id", case).alias("__key")).agg(first.alias("f")).select("f.id", "f.ordinal")


def duplicated_ids(df: DataFrame, column: str, case: bool = False) -> DataFrame:
    return df.groupBy(key_of(column, case).alias("id")).count().where("count > 1")


def common_to_both(left: DataFrame, right: DataFrame, column: str, other: str, case: bool = False) -> DataFrame:
    """Distinct left ids that are on the right, in a left spelling (the least one)."""
    mine = left.groupBy(key_of(column, case).alias("__key")).agg(F.min(F.trim(F.col(column).cast("string"))).alias("id"))
    return mine.join(right.select(key_of(other, case).alias("__key")), "__key", "left_semi").select("id")


def only_left(left: DataFrame, right: DataFrame, column: str, other: str, case: bool = False) -> DataFrame:
    mine = left.groupBy(key_of(column, case).alias("__key")).agg(F.min(F.trim(F.col(column).cast("string"))).alias("id"))
    return mine.join(right.select(key_of(other, case).alias("__key")), "__key", "left_anti").select("id")


def common_to_all(frames: Sequence[tuple[DataFrame, str]], case: bool = False, occurrences: bool = False) -> DataFrame:
    """Ids in every frame. occurrences counts rows rather than frames, so that ids repeated in one frame may pass or miss."""
    rows = reduce(DataFrame.unionByName, (f.select(key_of(c, case).alias("id"), F.lit(k).alias("__from")) for k, (f, c) in enumerate(frames)))
    n = F.count("*") if occurrences else F.count_distinct("__from")
    return rows.where("id IS NOT NULL").groupBy("id").agg(n.alias("__n")).where(F.col("__n") == len(frames)).select("id")


def columns_by_ids(df: DataFrame, names: Sequence[str], case: bool = False, missing_ok: bool = False) -> DataFrame:
    """The named columns in the order asked for."""
    fold = (lambda x: x.strip()) if case else (lambda x: x.strip().lower())
    there: dict[str, str] = {}
    for c in df.columns:
        if fold(c) in there:
            raise ValueError(f"column {c} is there twice")
        there[fold(c)] = c
    absent = [n for n in names if fold(n) not in there]
    if absent and not missing_ok:
        raise ValueError(f"no such columns: {absent}")
    return df.select(*(there[fold(n)] for n in names if fold(n) in there))


def columns_among(df: DataFrame, names: Sequence[str], first: int = 1, keep: bool = True, case: bool = False, reorder: bool = False) -> DataFrame:
    """Columns before number `first` and those among the names (or not among them); reorder puts them in the order of names."""
    fold = (lambda x: x.strip()) if case else (lambda x: x.strip().lower())
    order = {fold(n): k for k, n in reversed(list(enumerate(names)))}
    if reorder and len(order) < len(names):
        raise ValueError("names repeat, so they give no order")
    rest = [c for c in df.columns[first - 1 :] if (fold(c) in order) == keep]
    if reorder and keep:
        rest.sort(key=lambda c: order[fold(c)])
    return df.select(*df.columns[: first - 1], *rest)

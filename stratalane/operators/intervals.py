"""Intervals: overlap joins, islands, coverage, neighbours. Coordinates are inclusive unless said otherwise.

Overlap joins are equi-joins on bins, so that Spark shuffles, spills and splits skewed partitions as for any other join;
islands and running values are windows over slices of a chromosome with what earlier slices leave carried by a small
table, so that one chromosome is never one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 512
FAN = 8
#: Levels of bins; the widest hold any interval of 64-bit coordinates in use.
LEVELS = 16
SLICE = 1 << 16
#: Positions of a tile of overlap_collect(), lengths from which on rows of right are not packed, and rows of a pack that are too many.
TILE, LONG, CROWD = 512, 4096, 100_000


def _own_level(start: Column, end: Column, levels: int = LEVELS) -> Column:
    """The first level whose bins are at least as wide as the interval."""
    own = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        own = F.when(end - start < BIN * FAN**k, F.lit(k)).otherwise(own)
    return own


def _levels_of(df: DataFrame, start: Column, end: Column) -> list[int]:
    """The levels that intervals of df have, LEVELS at most."""
    return sorted(r.k for r in df.select(_own_level(start, end).alias("k")).distinct().collect())


def _filed(df: DataFrame, start: Column, end: Column, own_roles: dict[int, list[int]], above: list[int], role: int) -> DataFrame:
    """Rows for each interval's own level in each of own_roles, and for the levels `above` its own in role; by bin.

    An interval meets at most two bins of its own level and of those above.
    """
    own, none = _own_level(start, end), F.array().cast("array<struct<level:int,role:int,bin:bigint>>")

    def bins(k: int, roles: list[int]) -> Column:
        met = F.sequence(*(F.floor(x / (BIN * FAN**k)) for x in (start, end)))
        put = lambda role: F.transform(met, lambda b: F.struct(F.lit(k).alias("level"), F.lit(role).alias("role"), b.alias("bin")))
        return F.flatten(F.array(*map(put, roles)))

    at = [F.when(own == k, bins(k, roles)).otherwise(none) for k, roles in own_roles.items()]
    at += [F.when(own < k, bins(k, [role])).otherwise(none) for k in above]
    return df.withColumn("__at", F.explode(F.flatten(F.array(*at)) if at else none)).select(*df.columns, F.col("__at.level").alias("__level"), F.col("__at.role").alias("__role"), F.col("__at.bin").alias("__bin"))


def by_place(df: DataFrame, on: Sequence[str] = ("chrom",), start: str = "s", end: str = "e") -> DataFrame:
    """df dealt and sorted by place: overlap_join() keeps that order within bins, and pairs of neighbours take less to write."""
    return df.repartitionByRange(*on, start, end).sortWithinPartitions(*on, start, end)


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str] = ("chrom",), k: int = 1, percent: float | None = None, start: str = "s", end: str = "e") -> DataFrame:
    """Pairs of intervals with v = min(ends) - max(starts) + 1 of at least k; k < 0 allows gaps of up to -k.

    percent > 0 asks for that share of the longer interval, percent < 0 for that share of the shorter one (rounded down;
    a share that rounds to 0 lets abutting pairs through). Columns come back with 1 and 2 appended, and v.
    A pair is found at the level of its longer interval, in the later of the two first bins, and so once: rows meet at a
    level only if one of them has it as its own, so short intervals never meet in the wide bins of a few long ones.
    """
    pad = 1 if percent is not None else max(0, 1 - k)
    near, far = (F.col(start) - pad, F.col(end) + pad), (F.col(start), F.col(end))
    of_a, of_b = _levels_of(left, *near), _levels_of(right, *far)
    # Role 0: left's own level with right's up to it; role 1: right's own level with left's below it.
    a = _filed(left, *near, {n: [0] for n in of_a}, [n for n in of_b if n > min(of_a, default=n)], 1)
    b = _filed(right, *far, {n: [0, 1] if n > min(of_a, default=n) else [0] for n in of_b}, [n for n in of_a if n > min(of_b, default=n)], 0)
    a, b = a.select([F.col(c).alias(f"{c}1") for c in a.columns]), b.select([F.col(c).alias(f"{c}2") for c in b.columns])
    s1, e1, s2, e2 = (F.col(f"{start}1"), F.col(f"{end}1"), F.col(f"{start}2"), F.col(f"{end}2"))
    v = F.least(e1, e2) - F.greatest(s1, s2) + 1
    if percent is None:
        least = F.lit(k)
    else:
        pick = F.greatest if percent > 0 else F.least
        least = F.floor(pick(e1 - s1 + 1, e2 - s2 + 1) * abs(percent) / 100)
    width = F.element_at(F.array(*(F.lit(BIN * FAN**i) for i in range(LEVELS))), F.col("__level1") + 1)
    same = [F.col(f"{c}1") == F.col(f"{c}2") for c in (*on, "__level", "__role", "__bin")]
    once = F.greatest(F.floor((s1 - pad) / width), F.floor(s2 / width)) == F.col("__bin1")
    met = a.join(b, [*same, once, v >= least])
    return met.select(*(f"{c}1" for c in left.columns), *(f"{c}2" for c in right.columns), v.alias("v"))


def overlap_totals(left: DataFrame, right: DataFrame, key: str, on: Sequence[str] = (), width: int = SLICE) -> DataFrame:
    """(key, n, shared): how many rows of right each row of left overlaps, and the positions it shares with them in all.

    No pair is made: begun and ended rows of right, and the positions they cover, are summed up to the ends of left's rows.
    """
    at = lambda p, what, x: F.struct(p.cast("long").alias("p"), F.lit(what).alias("what"), F.lit(x).alias("x"))
    # Of right: a start counts from its place, an end from the place behind it.
    steps = right.where("s <= e").select(*on, F.explode(F.array(at(F.col("s"), "s", 1), at(F.col("e") + 1, "e", 1))).alias("__x")).groupBy(*on, F.col("__x.p").alias("__p"), F.col("__x.what").alias("what")).agg(F.sum("__x.x").alias("x"))
    per = steps.groupBy(*on, "__p").agg(F.sum(F.when(F.col("what") == "s", F.col("x")).otherwise(0)).alias("begun"), F.sum(F.when(F.col("what") == "e", F.col("x")).otherwise(0)).alias("ended"))
    # Of left: what has begun up to e and ended up to s, and the places covered up to e and before s.
    asked = left.where("s <= e").select(*on, F.explode(F.array(F.col("s").cast("long"), F.col("e").cast("long") + 1)).alias("__p")).distinct()
    known = [F.col(c).isNotNull() for c in on]
    both = per.unionByName(asked.withColumns({"begun": F.lit(0).cast("long"), "ended": F.lit(0).cast("long")})).groupBy(*on, "__p").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended"))
    for k in known:
        both = both.where(k)
    # Covered places before p: the sum over starts s < p of p - s, less that over ends (and one) before p; in decimals, as products of sums are long.
    wide = both.withColumn("weight", (F.col("__p") * (F.col("begun") - F.col("ended"))).cast("decimal(38,0)")).withColumn("__all", F.lit(0))
    upto = running(wide, [*on, "__all"], ("__p",), {"b": ("sum", "begun"), "f": ("sum", "ended"), "w": ("sum", "weight")}, width=width)
    upto = upto.select(*on, "__p", F.col("b").alias("before"), (F.col("f") + F.col("ended")).alias("ended"), ((F.col("b") - F.col("f")) * F.col("__p") - F.col("w")).cast("decimal(38,0)").alias("covered"))
    rows = left.where("s <= e").select(key, *on, F.col("s").cast("long").alias("__s"), (F.col("e").cast("long") + 1).alias("__z"))
    low = upto.select(*on, F.col("__p").alias("__s"), F.col("ended").alias("__gone"), F.col("covered").alias("__a"))
    high = upto.select(*on, F.col("__p").alias("__z"), F.col("before").alias("__begun"), F.col("covered").alias("__b"))
    met = rows.join(low, [*on, "__s"]).join(high, [*on, "__z"])
    totals = met.groupBy(key).agg(F.sum(F.col("__begun") - F.col("__gone")).alias("n"), F.sum(F.col("__b") - F.col("__a")).cast("long").alias("shared"))
    return totals.where("n > 0")


def overlap_semi(left: DataFrame, right: DataFrame, key: Sequence[str], anti: bool = False, **how) -> DataFrame:
    """Rows of left that overlap some row of right, or none; key names left's rows."""
    hits = overlap_join(left, right, **how).select([F.col(f"{c}1").alias(c) for c in key]).distinct()
    return left.join(hits, list(key), "left_anti" if anti else "left_semi").select(left.columns)


def overlap_collect(left: DataFrame, right: DataFrame, key: str, value: str, sep: str = ";", unique: bool = True, missing: str = "", on: Sequence[str] = ("chrom",), k: int = 1, percent: float | None = None, start: str = "s", end: str = "e") -> DataFrame:
    """left with the sorted values of the right rows that each row overlaps, joined to one string.

    Right rows are packed by tile, in order of their values, and each row of left meets the one pack of the tile in which it
    begins, so that no pair is a row. Rows that are longer than a tile, in crowded tiles or of keys that several rows have
    are joined by overlap_join(); what they find is carried to left's rows.
    """
    pad = 1 if percent is not None else max(0, 1 - k)
    s, e = F.col(start), F.col(end)
    fits = lambda long: F.coalesce((e >= s) & (e - s + 2 * pad < long), F.lit(False))
    right = right.select(*on, start, end, F.col(value).cast("string").alias("__v")).where("__v IS NOT NULL").withColumn("__fits", fits(LONG))
    tiles = F.explode(F.sequence(F.floor((s - pad) / TILE) - 1, F.floor((e + pad) / TILE)))
    filed = right.where("__fits").withColumn("__tile", tiles)
    crowded = filed.groupBy(*on, "__tile").agg(F.count("*").alias("__n")).where(F.col("__n") > CROWD)
    several = left.groupBy(key).agg(F.count("*").alias("__rows")).where("__rows > 1")
    rows = left.join(several, key, "left").withColumn("__tile", F.floor((s - pad) / TILE)).join(F.broadcast(crowded), [*on, "__tile"], "left")  # at most 10 * right / CROWD rows
    plain = fits(TILE) & F.col("__rows").isNull() & F.col("__n").isNull() & F.col(key).isNotNull()
    rows = rows.withColumn("__tile", F.when(plain, F.col("__tile"))).select(*left.columns, "__tile")
    how = {"on": on, "k": k, "percent": percent, "start": start, "end": end}
    said = []
    if not (odd := rows.where("__tile IS NULL")).isEmpty():
        said.append(overlap_join(odd.drop("__tile"), right, **how))
    if not (far := right.where("NOT __fits")).isEmpty():
        said.append(overlap_join(rows.where("__tile IS NOT NULL").drop("__tile"), far, **how))
    packs = filed.join(F.broadcast(crowded), [*on, "__tile"], "left_anti").groupBy(*on, "__tile").agg(F.sort_array(F.collect_list(F.struct("__v", start, end))).alias("__pack"))
    met = rows.join(packs, [*on, "__tile"], "left")
    v = lambda x: F.least(e, x[end]) - F.greatest(s, x[start]) + 1
    if percent is None:
        least = lambda x: F.lit(k)
    else:
        pick = F.greatest if percent > 0 else F.least
        least = lambda x: F.floor(pick(e - s + 1, x[end] - x[start] + 1) * abs(percent) / 100)
    # Of intervals of a position at least, each has to begin before the other ends, if k asks for no more.
    near = (lambda x: (x[start] <= F.col("__last")) & (x[end] >= F.col("__first"))) if percent is None and k <= 1 else (lambda x: v(x) >= least(x))
    met = met.withColumns({"__first": s + (k - 1), "__last": e - (k - 1)})
    found = F.coalesce(F.transform(F.filter("__pack", near), lambda x: x["__v"]), F.array().cast("array<string>"))
    for hits in said[1:]:
        said[0] = said[0].unionByName(hits)
    if said:
        more = said[0].groupBy(F.col(f"{key}1").alias(key)).agg(F.collect_list("__v2").alias("__more"))
        met = met.join(more, key, "left")
        found = F.when(F.col("__more").isNull(), found).otherwise(F.sort_array(F.concat(found, "__more")))
    if unique:
        found = F.array_distinct(found)
    return met.withColumn("__found", found).select(*left.columns, F.when(F.size("__found") == 0, F.lit(missing)).otherwise(F.array_join("__found", sep)).alias("joined"))


def peak_match(a: DataFrame, b: DataFrame, key: str, share: float = 0.5, pad: int = 350, **how) -> DataFrame:
    """One row of counts: peaks of a and b whose padded overlap exceeds a share of the shorter peak, and those alone."""
    wide = lambda df: df.select(*(c for c in df.columns if c not in ("s", "e")), (F.col("s") - pad // 2).alias("s"), (F.col("e") + pad // 2).alias("e"))
    pairs = overlap_join(wide(a), wide(b), **how).where(F.col("v") > share * F.least(F.col("e1") - F.col("s1") + 1, F.col("e2") - F.col("s2") + 1))
    both = pairs.agg(F.count_distinct(f"{key}1").alias("shared_a"), F.count_distinct(f"{key}2").alias("shared_b"), F.count("*").alias("pairs"))
    total = a.agg(F.count("*").alias("n_a")).crossJoin(b.agg(F.count("*").alias("n_b")))  # one row each
    return both.crossJoin(total).select("shared_a", "shared_b", "pairs", (F.col("n_a") - F.col("shared_a")).alias("unique_a"), (F.col("n_b") - F.col("shared_b")).alias("unique_b"))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, str]], reverse: bool = False, width: int = SLICE) -> DataFrame:
    """df with values of the rows before each row (after it, if reverse) in `order` within `by`.

    values: new column -> (max | min | sum | lag, column). The first order column is numeric; slices of `width` of it
    are windows of their own, and what they leave is carried to later ones by a table of one row a slice.
    """
    by, sign = list(by), -1 if reverse else 1
    cut = df.withColumn("__slice", F.floor(F.col(order[0]) / width))
    turned = [F.desc(c) if reverse else F.asc(c) for c in order]
    within = Window.partitionBy(*by, "__slice").orderBy(*turned).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*by).orderBy(sign * F.col("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    local = {"max": F.max, "min": F.min, "sum": F.sum}
    place = F.struct(*order)
    outermost = F.min_by if reverse else F.max_by
    left = cut.groupBy(*by, "__slice").agg(*((outermost(F.col(c), place) if how == "lag" else local[how](c)).alias(f"__left_{n}") for n, (how, c) in values.items()))
    carry = left.select(*by, "__slice", *((F.last(f"__left_{n}", ignorenulls=True) if how == "lag" else local[how](f"__left_{n}")).over(across).alias(f"__carry_{n}") for n, (how, _) in values.items()))
    here = cut.withColumns({f"__here_{n}": (F.lag(c).over(Window.partitionBy(*by, "__slice").orderBy(*turned)) if how == "lag" else local[how](c).over(within)) for n, (how, c) in values.items()})
    first = F.row_number().over(Window.partitionBy(*by, "__slice").orderBy(*turned)) == 1
    if any(how == "lag" for how, _ in values.values()):
        here = here.withColumn("__first", first)
    both = here.join(carry, [*by, "__slice"], "left")
    merge = {
        "max": lambda n: F.greatest(f"__here_{n}", f"__carry_{n}"),
        "min": lambda n: F.least(f"__here_{n}", f"__carry_{n}"),
        "sum": lambda n: F.coalesce(F.col(f"__here_{n}"), F.lit(0)) + F.coalesce(F.col(f"__carry_{n}"), F.lit(0)),
        "lag": lambda n: F.when(F.col("__first"), F.col(f"__carry_{n}")).otherwise(F.col(f"__here_{n}")),
    }
    return both.select(*df.columns, *(merge[how](n).alias(n) for n, (how, _) in values.items()))


def islands(df: DataFrame, by: Sequence[str] = ("chrom",), start: str = "s", end: str = "e", gap: int = 0, width: int = SLICE) -> DataFrame:
    """df with `island`, the start of the run of intervals that each belongs to; gaps of up to `gap` positions don't part runs."""
    rows = running(df, by, (start, end), {"__before": ("max", end)}, width=width)
    rows = rows.withColumn("__new", F.when(F.col("__before").isNull() | (F.col(start) > F.col("__before") + gap), F.col(start)))
    rows = running(rows, by, (start, end), {"__since": ("max", "__new")}, width=width)
    return rows.withColumn("island", F.coalesce("__new", "__since")).drop("__before", "__new", "__since")


def merged(df: DataFrame, by: Sequence[str] = ("chrom",), start: str = "s", end: str = "e", gap: int = 0, width: int = SLICE, **sums: Column) -> DataFrame:
    """The union of intervals: one row a run, with its number of intervals and what else `sums` asks for."""
    return islands(df, by, start, end, gap, width).groupBy(*by, "island").agg(F.max(end).alias(end), F.count("*").alias("n"), *(c.alias(n) for n, c in sums.items())).withColumnRenamed("island", start)


def coverage(df: DataFrame, by: Sequence[str] = ("chrom",), start: str = "s", end: str = "e", width: int = SLICE) -> DataFrame:
    """(by, s, e, depth): stretches of equal non-zero depth, half-open, where intervals are taken as half-open too."""
    events = df.select(*by, F.explode(F.array(F.struct(F.col(start).alias("p"), F.lit(1).alias("d")), F.struct(F.col(end).alias("p"), F.lit(-1).alias("d")))).alias("x")).select(*by, "x.p", "x.d")
    steps = events.groupBy(*by, "p").agg(F.sum("d").alias("d"))
    depth = running(steps, by, ("p",), {"__before": ("sum", "d")}, width=width)
    ends = running(depth, by, ("p",), {"__next": ("lag", "p")}, reverse=True, width=width)
    return ends.select(*by, F.col("p").alias("s"), F.col("__next").alias("e"), (F.col("__before") + F.col("d")).alias("depth")).where("depth > 0")


def flank_limits(df: DataFrame, by: Sequence[str] = ("chrom",), buffer: int = 0, width: int = SLICE) -> DataFrame:
    """df with the flanks that neighbours leave: up to the end of all before plus buffer, and the start of all after less it."""
    rows = running(df, by, ("s", "id"), {"__end": ("max", "e")}, width=width)
    rows = running(rows, by, ("e", "id"), {"__start": ("min", "s")}, reverse=True, width=width)
    first = F.least(F.col("s"), F.greatest(F.lit(1), F.coalesce(F.col("__end") + buffer, F.lit(1))))
    return rows.withColumn("flank_start", first).withColumn("flank_end", F.greatest(F.col("e"), F.coalesce(F.col("__start") - buffer, F.lit((1 << 62))))).drop("__end", "__start")


def subtract(df: DataFrame, blockers: DataFrame, by: Sequence[str] = ("chrom",), key: str = "id", least: int = 1) -> DataFrame:
    """What blockers leave of each interval, in pieces of at least `least` positions; half-open coordinates."""
    union = merged(blockers.select(*by, F.col("s"), F.col("e")), by)
    closed = df.withColumn("e", F.col("e") - 1)
    hits = overlap_join(closed, union.select(*by, "s", (F.col("e") - 1).alias("e")), by)
    cuts = hits.groupBy(F.col(f"{key}1").alias(key)).agg(F.sort_array(F.collect_list(F.struct(F.col("s2").alias("s"), (F.col("e2") + 1).alias("e")))).alias("cuts"))
    rows = df.join(cuts, key, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<s:bigint,e:bigint>>")))
    starts = F.concat(F.array(F.col("s")), F.transform("cuts", lambda c: c["e"]))
    ends = F.concat(F.transform("cuts", lambda c: c["s"]), F.array(F.col("e")))
    pieces = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"] - p["a"] >= least)
    return rows.withColumn("__piece", F.explode(pieces)).select(*(c for c in df.columns if c not in ("s", "e")), F.col("__piece.a").alias("s"), F.col("__piece.b").alias("e"))

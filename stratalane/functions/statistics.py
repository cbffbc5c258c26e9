"""Statistics as tables: exact tails by log-factorials, multiple testing, ranks, set enrichment."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series from 16 on (error below 1e-15) and exactly below."""
    from math import lgamma

    small = F.array(*(F.lit(lgamma(k + 1)) for k in range(16)))
    x = n + 1.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise(series)


def hypergeometric_tail(k: Column, a: Column, b: Column, n: Column) -> Column:
    """P(X >= k) for the overlap of sets of sizes a and b out of n: terms follow from one another by their ratio."""
    top = F.least(a, b)
    first = F.exp(log_factorial(a) - log_factorial(k) - log_factorial(a - k) + log_factorial(n - a) - log_factorial(b - k) - log_factorial(n - a - b + k) - log_factorial(n) + log_factorial(b) + log_factorial(n - b))
    zero = F.struct(first.alias("term"), first.alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        term = acc["term"] * ((a - x) * (b - x)) / ((x + 1.0) * (n - a - b + x + 1.0))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    more = F.when(top > k, F.sequence(k, top - 1)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(more, zero, step, lambda acc: F.least(F.lit(1.0), acc["sum"]))
    least = F.greatest(F.lit(0), a + b - n)
    return F.when(k <= least, F.lit(1.0)).when(k > top, F.lit(0.0)).otherwise(tail)


def set_overlaps(sets: DataFrame, name: str = "name", member: str = "member", background: DataFrame | None = None) -> DataFrame:
    """(a, b, size_a, size_b, total, overlap) for all pairs of named sets a < b, members outside the background left out.

    Pairs are made within each member's own array of sets, so pairs without a common member come from the list of sets.
    """
    rows = sets.select(F.col(name).alias("name"), F.col(member).alias("member")).distinct()
    if background is not None:
        rows = rows.join(background.select(F.col(background.columns[0]).alias("member")).distinct(), "member", "left_semi")
    total = (background.select(background.columns[0]) if background is not None else rows.select("member")).distinct().agg(F.count("*").alias("total"))
    sizes = rows.groupBy("name").agg(F.count("*").alias("size"))
    held = rows.groupBy("member").agg(F.sort_array(F.collect_list("name")).alias("x"))
    pairs = held.select(F.posexplode("x").alias("i", "a"), "x").select("a", F.explode(F.filter("x", lambda y, k: k > F.col("i"))).alias("b"))
    met = pairs.groupBy("a", "b").agg(F.count("*").alias("overlap"))
    left, right = (sizes.select(F.col("name").alias(c), F.col("size").alias(f"size_{c}")) for c in "ab")
    every = left.join(right, F.col("a") < F.col("b")).crossJoin(total)  # named sets, and one row
    return every.join(met, ["a", "b"], "left").na.fill(0, ["overlap"])


def enrichment(overlaps: DataFrame) -> DataFrame:
    """With expected overlap, fold and the one-sided p-value of Fisher's exact test."""
    expected = F.col("size_a") * F.col("size_b") / F.col("total")
    return overlaps.withColumns({"expected": expected, "fold": F.try_divide(F.col("overlap").cast("double"), expected), "p": hypergeometric_tail(F.col("overlap"), F.col("size_a"), F.col("size_b"), F.col("total"))})


def odds_ratio(overlaps: DataFrame) -> DataFrame:
    """With the conditional maximum-likelihood odds ratio of each pair's two-by-two table (0 and infinity at its bounds)."""
    import numpy as np

    @F.pandas_udf("double")
    def solve(k: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        from math import lgamma

        out = []
        for x, r, c, t in zip(k.tolist(), a.tolist(), b.tolist(), n.tolist()):
            low, high = max(0, r + c - t), min(r, c)
            if low == high or x == low:
                out.append(float("nan") if low == high else 0.0)
                continue
            if x == high:
                out.append(float("inf"))
                continue
            s = np.arange(low, high + 1)
            w = np.array([-lgamma(i + 1) - lgamma(r - i + 1) - lgamma(c - i + 1) - lgamma(t - r - c + i + 1) for i in s.tolist()])

            def mean(log_odds: float) -> float:
                z = w + s * log_odds
                p = np.exp(z - z.max())
                return float((s * p).sum() / p.sum())

            lo, hi = -50.0, 50.0
            for _ in range(100):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if mean(mid) < x else (lo, mid)
            out.append(float(np.exp((lo + hi) / 2)))
        return pd.Series(out)

    return overlaps.withColumn("odds", solve("overlap", "size_a", "size_b", "total"))


def adjusted(tests: DataFrame, p: str = "p", total: int | None = None) -> DataFrame:
    """With Benjamini-Hochberg (`bh`) and Bonferroni (`bonferroni`) values over all rows; ties share theirs.

    P-values are counted first, so the one running window is over distinct values.
    """
    counts = tests.groupBy(p).agg(F.count("*").alias("k"))
    m = F.sum("k").over(Window.partitionBy()) if total is None else F.lit(total)
    upto = F.sum("k").over(Window.orderBy(p))
    ranked = counts.select(p, m.alias("__m"), (F.col(p) * m / upto).alias("__raw"))
    out = ranked.select(p, F.least(F.lit(1.0), F.min("__raw").over(Window.orderBy(F.desc(p)))).alias("bh"), F.least(F.lit(1.0), F.col(p) * F.col("__m")).alias("bonferroni"))
    return tests.join(out, p)


def cumulative_share(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, share): share of rows of at most each distinct value."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by)
    return counts.select(*by, value, (F.sum("k").over(w.orderBy(value)) / F.sum("k").over(w)).alias("share"))


def group_summary(df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float] = (0.15, 0.5, 0.85)) -> DataFrame:
    """Count, mean, standard deviation and error, and interpolated quantiles by group.

    Quantiles come from counts of distinct values, summed map-side, rather than from a list of all rows.
    """
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("se"), F.percentile(v, F.array(*map(F.lit, quantiles))).alias("quantiles"))


def share_of_group(df: DataFrame, by: Sequence[str], value: str, least: float | None = None) -> DataFrame:
    """With each row's share of its group's sum; groups of a sum up to `least` go. Sums are made before the join."""
    sums = df.groupBy(*by).agg(F.sum(value).alias("__sum"))
    sums = sums if least is None else sums.where(F.col("__sum") > least)
    return df.join(sums, list(by)).withColumn("share", F.try_divide(F.col(value), F.col("__sum"))).drop("__sum")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark cuts groups down before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def _within(t: float, df: int) -> float:
    """Share of Student's distribution between -t and t, by its finite series for whole degrees of freedom."""
    from math import atan, cos, pi, sin, sqrt

    angle = atan(t / sqrt(df))
    term, total = (cos(angle), 0.0) if df % 2 else (1.0, 0.0)
    for k in range(df % 2 + 1, df, 2):
        total += term
        term *= cos(angle) ** 2 * k / (k + 1)
    return 2 / pi * (angle + sin(angle) * total) if df % 2 else sin(angle) * total


def t_quantile(df: int, share: float = 0.95) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if _within(middle, df) < share else (low, middle)
    return low


def t_limit(df: Column, exact: int = 30) -> Column:
    """The 97.5 % quantile of Student's distribution: a list for few degrees of freedom, its expansion beyond (to 1e-6)."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(0.975)
    series = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    far = F.lit(z)
    for i, g in enumerate(series, 1):
        far = far + g / F.pow(df.cast("double"), i)
    listed = F.array(*(F.lit(t_quantile(k)) for k in range(1, exact + 1)))
    return F.when(df <= exact, F.get(listed, (df - 1).cast("int"))).otherwise(far)

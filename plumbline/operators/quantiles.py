"""Exact quantiles, linear between ranks, to the last bit as the SQL engine takes them: lo * (1 - d) + hi * d with one rounding for the first product
and the sum. Of a whole column by selection: histograms that are refined around the wanted ranks. Every round is one
partial aggregation; no task sees more than its partition, and the driver no more than the bins. Of groups by counting equal values first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 1024


def _ranked(df: DataFrame, ranks: set[int], lo: float, hi: float) -> dict[int, float]:
    """The values at the ranks (from 0) among all of column v, which lie in [lo, hi]."""
    todo, done = [(lo, hi, 0, ranks)], {}  # bounds, rows below them, ranks within
    while todo:
        kinds = []
        for k, (a, b, _, _) in enumerate(todo):
            at = F.least(F.lit(BINS - 1), F.floor((F.col("v") - a) / ((b - a) / BINS or 1.0))).cast("int")
            kinds.append(F.when(F.col("v").between(a, b), F.struct(F.lit(k).alias("k"), at.alias("bin"))))
        rows = df.select("v", F.explode(F.array_compact(F.array(*kinds))).alias("at")).groupBy("at.k", "at.bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        new = []
        for k, (_, _, below, wanted) in enumerate(todo):
            for r in sorted((r for r in rows if r.k == k), key=lambda r: r.bin):
                own = {x for x in wanted if below <= x < below + r.n}
                if own and r.a == r.b:
                    done |= dict.fromkeys(own, r.a)
                elif own:
                    new.append((r.a, r.b, below, own))
                below += r.n
        todo = new
    return done


def exact_quantiles(df: DataFrame, value: Column | str, ps: list[float]) -> tuple[int, list[float | None]]:
    """(how many values, quantiles): linear between ranks; nulls and NaN don't count; None without values. df is read a few times."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    df = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n, lo, hi = df.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return 0, [None] * len(ps)
    at = [p * (n - 1) for p in ps]
    got = _ranked(df, {math.floor(x) for x in at} | {math.ceil(x) for x in at}, lo, hi)
    return n, [_between(got[math.floor(x)], got[math.ceil(x)], x - math.floor(x)) for x in at]


def _between(lo: float, hi: float, d: float) -> float:
    return math.fma(1 - d, lo, hi * d) if d else lo


def group_quantile(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """(keys, name, n): a quantile of each group and how many rows it has; nulls don't count for the quantile, NaN is the largest. A group's
    different values are sorted, in no task's memory as a whole."""
    each = df.groupBy(*keys, F.col(value).cast("double").alias("v_")).agg(F.count(F.lit(1)).alias("k_"))
    group = Window.partitionBy(*keys)
    upto = F.sum("k_").over(group.orderBy(F.col("v_").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = (F.sum(F.when(F.col("v_").isNotNull(), F.col("k_"))).over(group) - 1) * F.lit(p)
    own = each.select(*keys, "v_", "k_", upto.alias("upto_"), at.alias("at_"))
    holds = lambda rank: F.max(F.when((rank < F.col("upto_")) & (rank >= F.col("upto_") - F.col("k_")), F.col("v_")))
    got = own.groupBy(*keys).agg(holds(F.floor("at_")).alias("lo_"), holds(F.ceil("at_")).alias("hi_"), F.max(F.col("at_") - F.floor("at_")).alias("d_"), F.sum("k_").alias("n"))
    mixed = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), 1 - F.col("d_"), F.col("lo_"), F.col("hi_") * F.col("d_")).cast("double")
    return got.select(*keys, F.when(F.col("d_") > 0, mixed).otherwise(F.col("lo_")).alias(name), "n")

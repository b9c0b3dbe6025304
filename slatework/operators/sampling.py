"""Distributions and draws that don't depend on how the data is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatework.session import small, written


def u(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from an integer key and a seed, by integer arithmetic alone."""
    return F.pmod(key * 7919 + seed * 104729, F.lit(10007)) / F.lit(10007.0)


def distribution(df: DataFrame, group: list[str], category: str, weight: str) -> DataFrame:
    """group, category, weight, p: weights summed per category and divided by the group's total."""
    w = df.groupBy(*group, category).agg(F.sum(weight).alias("weight"))
    return w.withColumn("p", F.try_divide("weight", F.sum("weight").over(Window.partitionBy(*group))))


def cumulative(dist: DataFrame, group: list[str], category: str) -> DataFrame:
    """dist with ``cdf_from`` and ``cdf_to``: the interval of the category in its group's distribution, in category order.

    The window holds the categories of a group, not its rows.
    """
    w = Window.partitionBy(*group).orderBy(category)
    total = F.sum("weight").over(Window.partitionBy(*group))
    run = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(category).desc())) == 1
    return dist.withColumn("cdf_to", F.when(last, F.lit(1.0)).otherwise(F.try_divide(run, total))).withColumn("cdf_from", F.try_divide(run - F.col("weight"), total))


def drawn(rows: DataFrame, dist: DataFrame, group: list[str], category: str, uniform: str) -> DataFrame:
    """rows (left) with the category drawn by inverse CDF: the first one whose cdf is over ``uniform``; null where the group is unknown.

    The distribution is a table of groups and categories; it is packed to one
    row per group, so a row of the left side meets one row and none is multiplied.
    The packed table is broadcast if it is small, so that the rows aren't shuffled by a handful of groups.
    """
    c = cumulative(dist, group, category)
    packed = c.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.sort_array(F.collect_list(F.struct("cdf_to", F.col(category).alias("c")))).alias("_cdf"))
    on = None
    for g in group:
        e = F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        on = e if on is None else on & e
    out = rows.join(small(written(packed, "distribution")), on, "left")
    pick = F.try_element_at(F.filter("_cdf", lambda x: x.cdf_to > F.col(uniform)), F.lit(1))["c"]
    return out.withColumn(category, pick).drop("_cdf", *[f"_g_{g}" for g in group])


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows per group in the order of a seeded number, then key.

    Each partition keeps its own best n of a group first, so a group that holds a third of
    all rows is cut down before the final window.
    """
    d = df.withColumn("_u", u(F.col(key), seed))
    pre = Window.partitionBy(group, F.pmod(F.xxhash64(key), F.lit(32))).orderBy("_u", key)
    d = d.withColumn("_r", F.row_number().over(pre)).where(F.col("_r") <= n)
    w = Window.partitionBy(group).orderBy("_u", key)
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_u", "_r")


def with_replacement(rows: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """draw (0..n-1), key: n weighted draws with replacement, by inverse CDF over the rows in key-hash order.

    Rows are dealt to hash buckets of about a thousand; a draw finds its bucket in the list of bucket
    totals (65,536 numbers at most) and its row within the bucket. Rows without a positive weight are never drawn.
    """
    d = rows.where(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("_w"))
    count = d.count()
    if not count or n <= 0:
        return rows.select(F.lit(0).cast("long").alias("draw"), key).limit(0)
    buckets = min(max(count // 1000, 1), 65_536)
    d = d.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    sums = {r["_b"]: r["s"] for r in d.groupBy("_b").agg(F.sum("_w").alias("s")).collect()}  # one number per bucket
    total, run, edges = sum(sums.values()), 0.0, []
    for b in range(buckets):
        run += sums.get(b, 0.0)
        edges.append(run / total)
    cdf = F.split(F.lit(",".join(repr(e) for e in edges)), ",").cast("array<double>")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) / float(1 << 52)).alias("_u")
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), uniform)
    draws = draws.withColumn("_b", F.least(F.size(F.filter(cdf, lambda e: e <= F.col("_u"))), F.lit(buckets - 1)))
    draws = draws.withColumn("_rest", (F.col("_u") - F.when(F.col("_b") == 0, 0.0).otherwise(F.element_at(cdf, F.greatest(F.col("_b"), F.lit(1))))) * total)
    w = Window.partitionBy("_b").orderBy(key)
    inner = d.withColumn("_to", F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy("_b").agg(F.sort_array(F.collect_list(F.struct("_to", key))).alias("_rows"))
    hit = F.coalesce(F.try_element_at(F.filter("_rows", lambda r: r._to > F.col("_rest")), F.lit(1)), F.element_at("_rows", -1))
    return draws.join(inner, "_b").select("draw", hit[key].alias(key))


def pick_one(df: DataFrame, key: str, seed: int) -> DataFrame:
    """One row of ``df``, the same for the same seed however the rows are partitioned: that of the least seeded hash of its key, then the least key. No row if there is none."""
    one = df.agg(F.min_by(F.struct("*"), F.struct(F.xxhash64(F.lit(seed), key), key)).alias("_r"))
    return one.where("_r is not null").select("_r.*")

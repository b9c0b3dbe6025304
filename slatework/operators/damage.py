"""Damage classes from probabilities, and what repeated runs say about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatework.functions.vocab import DAMAGE_CLASSES, PROBABILITY_CLASSES


def literals(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def confident(p: Column, threshold: float = 0.5) -> Column:
    """Whether one probability alone decides."""
    return F.array_max(p) > threshold


def hybrid_class(p: Column) -> Column:
    """Class of an array of five probabilities: the label of the first largest one if it is
    over one half, else the label of the rounded (half to even) expected rank, kept within 1..4.
    Null for null and for arrays with null members."""
    first = F.element_at(literals(PROBABILITY_CLASSES), F.array_position(p, F.array_max(p)).cast("int"))
    rank = F.aggregate(F.zip_with(p, literals([1.0, 2.0, 3.0, 4.0, 5.0]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    ordinal = F.element_at(literals(DAMAGE_CLASSES), F.least(F.greatest(F.bround(rank, 0), F.lit(1.0)), F.lit(4.0)).cast("int"))
    return F.when(p.isNotNull() & ~F.exists(p, lambda x: x.isNull()), F.when(confident(p), first).otherwise(ordinal))


def class_table(df: DataFrame, labels: list[str], name: str) -> DataFrame:
    """A row per label: a dimension of fixed size."""
    return df.sparkSession.createDataFrame([(x,) for x in labels], f"`{name}` string")


def class_percentages(df: DataFrame, keys: list[str], label: str, labels: list[str] = DAMAGE_CLASSES) -> DataFrame:
    """keys, label, n, pct of all rows of the keys; labels without rows are kept with zero.

    Rows with other labels count in the total only. One shuffle: labels are
    counted conditionally, then unpivoted.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col(label) == x).alias(f"_{i}") for i, x in enumerate(labels)])
    rows = F.array(*[F.struct(F.lit(x).alias(label), F.col(f"_{i}").alias("n")) for i, x in enumerate(labels)])
    return counts.select(*keys, "_all", F.inline(rows)).select(*keys, label, "n", (100.0 * F.col("n") / F.col("_all")).alias("pct"))


def interval_summary(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """Mean, sample deviation (null for one value), two-sigma bounds kept within [low, high], and n."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n_runs"))
    return s.select(
        *keys, "mean", "std", F.greatest(F.lit(low), F.col("mean") - 2 * F.col("std")).alias("lo"), F.least(F.lit(high), F.col("mean") + 2 * F.col("std")).alias("hi"), "n_runs"
    )


def confusion_counts(df: DataFrame, keys: list[str], true: str, pred: str, labels: list[str] = DAMAGE_CLASSES) -> DataFrame:
    """keys, true, pred, n for all label pairs, zeros kept; rows with other labels are dropped."""
    n = df.groupBy(*keys).agg(*[F.count_if((F.col(true) == t) & (F.col(pred) == p)).alias(f"_{i}_{j}") for i, t in enumerate(labels) for j, p in enumerate(labels)])
    cells = F.array(*[F.struct(F.lit(t).alias("true_class"), F.lit(p).alias("pred_class"), F.col(f"_{i}_{j}").alias("n")) for i, t in enumerate(labels) for j, p in enumerate(labels)])
    return n.select(*keys, F.inline(cells))


def row_normalised(counts: DataFrame, keys: list[str], row: str = "true_class", n: str = "n") -> DataFrame:
    """Share of each cell in its row; an empty row gives zeros."""
    total = F.sum(n).over(Window.partitionBy(*keys, row))
    return counts.withColumn("share", F.coalesce(F.try_divide(F.col(n), total), F.lit(0.0)))


def accuracy(df: DataFrame, keys: list[str], true: str, pred: str) -> DataFrame:
    """Share of rows whose labels agree, over the rows that have both."""
    return df.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys).agg(F.avg((F.col(true) == F.col(pred)).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))

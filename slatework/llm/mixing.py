"""Mixing sources to target shares along a curriculum that varies over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatework.session import small, written

#: Rows that a window of the running totals holds, about.
BUCKET_ROWS = 5_000
#: How far a source's weight may rise or fall from the start to the end of training: 0 is constant.
TILT = 0.5


def _demands(sizes: DataFrame, targets: DataFrame, tilt: float) -> DataFrame:
    """Per source: tokens, share, demand in tokens, and the slope of its weight.

    Shares of sources that have tokens are scaled to one. The total is the
    largest at which no source is used more than its max_repeats, so every source
    gets its share exactly. Weights are share * (1 + slope * (1 - 2t)): slopes are
    +tilt for small sources first, and balanced so that weights sum to one at all times.
    """
    t = targets.where("target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    one = Window.partitionBy(F.lit(1))  # over a few rows, one per source
    d = sizes.join(small(t), "source").where("tokens > 0")
    d = d.withColumn("share", F.col("target_share") / F.sum("target_share").over(one))
    d = d.withColumn("total", F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).over(one))
    # Slopes sum to zero when weighted by share.
    lean = F.percent_rank().over(one.orderBy("tokens", "source")) - 0.5
    d = d.withColumn("lean", lean)
    d = d.withColumn("lean", F.col("lean") - F.sum(F.col("lean") * F.col("share")).over(one))
    d = d.withColumn("slope", -F.col("lean") / F.greatest(F.max(F.abs("lean")).over(one), F.lit(1e-12)) * tilt)
    return d.select("source", "tokens", "target_share", "max_repeats", "share", (F.col("share") * F.col("total")).alias("demand"), "slope", "total")


def running_totals(docs: DataFrame, seed: int, rows: int) -> DataFrame:
    """docs (id, source, tokens) with ``before``: the tokens of the source ahead of the row in shuffled order.

    The order is by a hash of (seed, id). Each source is dealt to hash ranges,
    so that a window holds about BUCKET_ROWS rows even if one source has most of
    them; the ranges' own sums are small and are totalled apart.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    h = F.xxhash64(F.lit(seed), "id")
    d = docs.withColumn("h", h).withColumn("bucket", F.floor((F.col("h").cast("double") + float(1 << 63)) / float(1 << 64) * buckets).cast("int"))
    d = d.withColumn("bucket", F.least("bucket", F.lit(buckets - 1)))
    per = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    # At most sources x buckets rows, ordered within a source.
    ahead = per.withColumn("ahead", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    within = Window.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("within", F.sum("tokens").over(within) - F.col("tokens"))
    return d.join(ahead, ["source", "bucket"]).select("id", "source", "tokens", (F.col("ahead") + F.col("within")).alias("before"))


def mixed(docs: DataFrame, targets: DataFrame, tilt: float = TILT, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(placed documents, shares reached).

    docs: (id, source, tokens). targets: (source, target_share, max_repeats).
    Placed: id, source, repeat from 1, tokens, position (token at which it
    starts in the mix). A source's demand D(t) is the integral of its weight; a
    document whose middle lies at token c of its source's stream is trained at
    the t where D(t) = c, found by inverting the quadratic. Rows are range-sorted by
    position. Documents without tokens, without a source or of a source without a
    target are not placed; a target whose source has no tokens is reported with zero.
    The report also tells the tokens of each source's documents that are never used: the
    total is bound by the source that its repeats make scarcest.
    """
    docs = written(docs.where("tokens > 0 and source is not null"), "mix-sizes")
    rows = docs.count()
    demand = _demands(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")), targets, tilt)
    placed = running_totals(docs, seed, rows).join(small(demand.withColumnRenamed("tokens", "size")), "source")
    # Stream position of the document's k-th use; used while its middle is within the demand.
    middle = F.col("before") + F.col("tokens") / 2
    uses = F.floor((F.col("demand") - middle) / F.col("size")) + 1
    placed = placed.withColumn("repeat", F.explode(F.when(uses >= 1, F.sequence(F.lit(1), F.least(uses, F.col("max_repeats")).cast("int")))))
    x = ((F.col("repeat") - 1) * F.col("size") + middle) / F.col("demand")
    # x = t + a (t - t^2), a in (-1, 1): the root in [0, 1].
    a = F.col("slope")
    t = F.when(F.abs(a) < 1e-9, x).otherwise((1 + a - F.sqrt(F.greatest((1 + a) * (1 + a) - 4 * a * x, F.lit(0.0)))) / (2 * a))
    placed = placed.select("id", "source", "repeat", "tokens", (t * F.col("total")).cast("long").alias("position"))
    placed = written(placed, "mix-placed")
    first = F.sum(F.when(F.col("repeat") == 1, F.col("tokens")))
    used = placed.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count(F.lit(1)).alias("rows"), F.max("repeat").alias("repeats"), first.alias("first"))
    have = docs.groupBy("source").agg(F.sum("tokens").alias("have"))
    one = Window.partitionBy(F.lit(1))
    report = targets.select("source", "target_share", "max_repeats").distinct().join(used, "source", "left").join(have, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("repeats", F.lit(0)).alias("repeats"),
        (F.coalesce("have", F.lit(0)) - F.coalesce("first", F.lit(0))).alias("left_out_tokens"),
    )
    report = report.withColumn("reached_share", F.coalesce(F.try_divide("used_tokens", F.sum("used_tokens").over(one)), F.lit(0.0)))
    return placed.orderBy("position", "source", "id", "repeat"), report

"""The registry of named queries and their SQL, and the table roles they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions.vocab import PROBABILITY_CLASSES  # noqa: F401
from slatework.operators import damage, tables
from slatework.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the DuckDB SQL it must equal."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, digits: int = 6):
    return F.round(c, digits)


# Order priorities as surveyed damage, as text so that the SQL has the same.
PRIORITY_CLASSES = {"5-LOW": "no-damage", "3-MEDIUM": "minor-damage", "2-HIGH": "major-damage", "1-URGENT": "destroyed"}
WEIGHTS = ("l_quantity", "l_discount * 400", "l_tax * 400", "51 - l_quantity", "CAST(l_partkey % 50 AS DOUBLE)")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Damage probabilities of assets in runs: mode, seed, asset_id, p (five), true_class, pred_class, branch."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", *[F.expr(w).cast("double").alias(f"w{i}") for i, w in enumerate(WEIGHTS)])
    total = F.col("w0") + F.col("w1") + F.col("w2") + F.col("w3") + F.col("w4")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.select(
        F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("seed"), F.col("l_orderkey").alias("asset_id"),
        F.array(*[F.col(f"w{i}") / total for i in range(5)]).alias("p"), tables.mapped(F.col("o_orderpriority"), PRIORITY_CLASSES).alias("true_class"),
    )
    return j.withColumn("pred_class", damage.hybrid_class(F.col("p"))).withColumn("branch", F.when(damage.confident(F.col("p")), "argmax").otherwise("ordinal"))


RUNS_SQL = """
w AS (SELECT l_returnflag AS mode, l_linenumber AS seed, l_orderkey AS asset_id, o_orderpriority,
        l_quantity AS w0, l_discount * 400 AS w1, l_tax * 400 AS w2, 51 - l_quantity AS w3, CAST(l_partkey % 50 AS DOUBLE) AS w4
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
q AS (SELECT *, w0 + w1 + w2 + w3 + w4 AS t FROM w),
p AS (SELECT mode, seed, asset_id, o_orderpriority, w0 / t AS p1, w1 / t AS p2, w2 / t AS p3, w3 / t AS p4, w4 / t AS p5 FROM q),
m AS (SELECT *, greatest(p1, p2, p3, p4, p5) AS top, p1 * 1.0::DOUBLE + p2 * 2.0::DOUBLE + p3 * 3.0::DOUBLE + p4 * 4.0::DOUBLE + p5 * 5.0::DOUBLE AS s FROM p),
runs AS (SELECT mode, seed, asset_id, CASE WHEN top > 0.5 THEN 'argmax' ELSE 'ordinal' END AS branch,
   CASE o_orderpriority WHEN '5-LOW' THEN 'no-damage' WHEN '3-MEDIUM' THEN 'minor-damage' WHEN '2-HIGH' THEN 'major-damage' WHEN '1-URGENT' THEN 'destroyed' END AS true_class,
   CASE WHEN top > 0.5 THEN CASE WHEN p1 = top THEN 'no-damage' WHEN p2 = top THEN 'minor-damage' WHEN p3 = top THEN 'minor-damage' WHEN p4 = top THEN 'major-damage' ELSE 'destroyed' END
   ELSE CASE WHEN round_even(s, 0) <= 1 THEN 'no-damage' WHEN round_even(s, 0) = 2 THEN 'minor-damage' WHEN round_even(s, 0) = 3 THEN 'major-damage' ELSE 'destroyed' END END AS pred_class
  FROM m)
"""
CLASSES_SQL = "classes AS (SELECT unnest(['no-damage', 'minor-damage', 'major-damage', 'destroyed']) AS c)"

PARTS_SQL = """
parts AS (SELECT p_partkey, p_brand, p_type, p_size, p_retailprice, p_size % 12 + 1 AS h,
   p_type || '/' || split_part(p_name, ' ', 1) || '+' || split_part(p_name, ' ', 2) AS mat_llrs,
   p_type || '/' || split_part(p_name, ' ', 1) || '+' || split_part(p_name, ' ', 2) || '/H' || (p_size % 12 + 1)::VARCHAR || '/RES' AS taxonomy FROM part)
"""


def parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts as buildings with a taxonomy material/system+ductility/height/occupancy."""
    p = table(spark, d, "part")
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    h = F.col("p_size") % 12 + 1
    mat = F.concat("p_type", F.lit("/"), word(1), F.lit("+"), word(2))
    return p.select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice", h.alias("h"), mat.alias("mat_llrs"), F.concat(mat, F.lit("/H"), h.cast("string"), F.lit("/RES")).alias("taxonomy"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as a planar point."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("pid"), "c_nationkey", ((k * 7919) % 1100).cast("double").alias("x"), ((k * 104729) % 1100).cast("double").alias("y"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers as planar sites."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("sid"), ((k * 6971 + 13) % 1000).cast("double").alias("x"), ((k * 15485) % 1000).cast("double").alias("y"))


POINTS_SQL = "points AS (SELECT c_custkey AS pid, c_nationkey, ((c_custkey * 7919) % 1100)::DOUBLE AS x, ((c_custkey * 104729) % 1100)::DOUBLE AS y FROM customer)"
SITES_SQL = "sites AS (SELECT s_suppkey AS sid, ((s_suppkey * 6971 + 13) % 1000)::DOUBLE AS x, ((s_suppkey * 15485) % 1000)::DOUBLE AS y FROM supplier)"
HEAT_SQL = """
heat AS (SELECT vec_id AS image_id, label AS method, (i - 1)::INT AS pos, ((i - 1) % 8)::INT AS x, ((i - 1) // 8)::INT AS y, embedding[i]::DOUBLE AS v
  FROM embeddings, unnest(range(1, 65)) AS t(i))
"""

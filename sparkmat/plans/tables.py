"""Tables that the queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATRIX = "X AS (SELECT l_suppkey AS cell, l_partkey % 50 AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
CELLS = "C AS (SELECT s_suppkey AS cell, s_nationkey AS grp FROM supplier)"
EDGES = "E0 AS (SELECT 2 * l_suppkey AS a, 2 * l_partkey + 1 AS b, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2), G AS (SELECT a AS src, b AS dst, w AS weight FROM E0 UNION ALL SELECT b, a, w FROM E0)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def matrix(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 50).alias("gene")).agg(F.sum("l_quantity").alias("value"))


def groups(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("grp"))


def whole_graph(spark, sf):
    """Suppliers (2 x key) and parts (2 x key + 1), an edge each way weighted by the line items that join them; no row or key is left out or folded."""
    e = table(spark, sf, "lineitem").groupBy((2 * F.col("l_suppkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    ways = F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return e.select(F.explode(ways).alias("e")).select("e.*")  # the line items are summed once

"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewell.llm.shared import spread_join, table

#: The links of a node with more of them are spread over tasks; such nodes are broadcast, one for so many links at most.
HOT_DEGREE = 100_000


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): links between node ids (bigint). Returns (node, root): every linked node with its component's least id.

    Self links and repeated links do no harm; null ends are dropped; no links give no rows. Each step is written, so
    a lost executor costs at most one step, and the number of steps grows with the logarithm of the longest chain.
    """
    star = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(star)
    while mark[0]:
        both = star.union(star.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("size"))
        large = spread_join(both, least, ["u"], "size", least=HOT_DEGREE).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = table(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        small = spread_join(large, least, ["u"], "size", least=HOT_DEGREE).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        star = table(small)
        now = _mark(star)
        if now == mark:
            break
        mark = now
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).union(star.select("v", "v").distinct())


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]

"""Connected components of a table of links, by alternating stars.

Every node points its larger neighbours to its smallest one, then every node points its smaller neighbours and itself to the
smallest of them, until all nodes point straight at the smallest of their component. The number of rounds grows with the
logarithm of the component sizes; links only get fewer. Each round is written out, which cuts lineage.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.scratch import materialize, materialize_counted


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("parent").alias("node"), F.col("node").alias("parent")))
    least = both.groupBy("node").agg(F.min("parent").alias("low")).withColumn("low", F.least("low", "node"))
    return (
        both.join(least, "node").where(F.col("parent") > F.col("node"))
        .select(F.col("parent").alias("node"), F.col("low").alias("parent")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("node").agg(F.min("parent").alias("low"))
    others = links.join(least, "node").where(F.col("parent") > F.col("low")).select(F.col("parent").alias("node"), F.col("low").alias("parent"))
    return others.unionByName(least.withColumnRenamed("low", "parent")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, parent)`` for every linked node but the smallest of its component, which is the parent."""
    links = materialize(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("parent")).distinct(),
        "links",
    )
    while True:
        links, n = materialize_counted(_small_star(_large_star(links)), "links")
        nodes = links.select("node").distinct()
        inner = links.select(F.col("parent").alias("node")).distinct().join(nodes, "node", "left_semi")
        if nodes.count() == n and inner.isEmpty():
            return links

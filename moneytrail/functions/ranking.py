"""Positions in a global order without a single-task sort.

Rows are range-partitioned by the order, counted per range, and numbered within their range; only the range
totals, one row per partition, are ever summed in one place.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.scratch import materialize


def smallest_hashes(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The ``k`` rows with the smallest seeded hashes of ``key``: a repeatable uniform sample.

    Rows whose hash is clearly too large are dropped before the sort, or every task would hand on ``k`` rows.
    """
    order = [F.xxhash64(key, F.lit(seed)), F.col(key)]
    n = df.count()
    if n > 4 * k:
        cut = -(2**63) + int(2**64 * (2 * k / n))
        low = df.where(order[0] < F.lit(cut))
        if low.count() >= k:
            return low.orderBy(*order).limit(k)
    return df.orderBy(*order).limit(k)


def running_total(df: DataFrame, order: list[str], weight: Column) -> DataFrame:
    """Add ``before``, the sum of ``weight`` over all rows that come earlier in ``order``.

    The order must tell all rows apart. Writes the range-partitioned rows as a scratch table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialize(
        df.withColumn("weight_", weight).repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()),
        "ranges",
    )
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("range_").agg(F.sum("weight_").alias("total_")).select(
        "range_", F.coalesce(F.sum("total_").over(earlier), F.lit(0)).alias("start_")
    )
    inside = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.join(F.broadcast(starts), "range_")  # one row per partition
        .withColumn("before", F.col("start_") + F.coalesce(F.sum("weight_").over(inside), F.lit(0)))
        .drop("range_", "start_", "weight_")
    )


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The ``q`` quantile with linear interpolation between neighbouring values."""
    n = df.count()
    if n == 0:
        return None
    at = q * (n - 1)
    low = int(at)
    # equal values are one row, so a value shared by many rows does not weigh on one range
    values = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("copies"))
    placed = running_total(values, ["value"], F.col("copies"))

    def value_at(position):
        return placed.where((F.col("before") <= position) & (F.col("before") + F.col("copies") > position)).head()["value"]

    first = value_at(low)
    return first if at == low else first + (at - low) * (value_at(low + 1) - first)


def roc_auc(df: DataFrame, score: str, label: str) -> float:
    """Area under the ROC curve by rank sums, ties sharing their mean rank; 0.5 if there is only one class."""
    by_score = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label)).alias("positives"), F.count("*").alias("rows")
    )
    placed = running_total(by_score, ["score"], F.col("rows"))
    sums = placed.agg(
        F.sum("positives").alias("p"), F.sum("rows").alias("n"),
        F.sum(F.col("positives") * (F.col("before") + (F.col("rows") + 1) / 2)).alias("ranks"),
    ).head()
    p = sums["p"] or 0
    negatives = (sums["n"] or 0) - p
    if p == 0 or negatives == 0:
        return 0.5
    return (sums["ranks"] - p * (p + 1) / 2) / (p * negatives)

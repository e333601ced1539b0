"""Joins that stay balanced when a single key holds a large share of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_MIN_ROWS = 1_000_000
HOT_MOST = 200
SPLITS = 32


def hot_keys(df: DataFrame, key: str, min_rows: int | None = None, rows: int | None = None) -> list:
    """The heaviest keys of a column, at most ``HOT_MOST``, with ``min_rows`` rows or more.

    Any key holding more than 1/HOT_MOST of the rows is among them. Runs one job that counts per key before
    it shuffles and returns a list of bounded length; no job if the table is known to have too few ``rows``.
    """
    least = HOT_MIN_ROWS if min_rows is None else min_rows
    if rows is not None and rows < least:
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    return [r[key] for r in counts.where(F.col("rows") >= least).orderBy(F.desc("rows")).limit(HOT_MOST).collect()]


def hot_listed(counted: DataFrame, key: str, rows: str, min_rows: int | None = None) -> list:
    """The same from a table that already holds one row per key and the number of its rows."""
    least = HOT_MIN_ROWS if min_rows is None else min_rows
    return [r[key] for r in counted.where(F.col(rows) >= least).orderBy(F.desc(rows)).limit(HOT_MOST).select(key).collect()]


def scatter(df: DataFrame, key: str, hot: list, by: Column, splits: int = SPLITS) -> DataFrame:
    """Add ``salt``: rows of a hot key are spread over ``splits`` values, the others get 0."""
    spread = F.pmod(F.xxhash64(by), F.lit(splits)).cast("int")
    return df.withColumn("salt", F.when(F.col(key).isin(hot), spread).otherwise(F.lit(0)))


def replicate(df: DataFrame, key: str, hot: list, splits: int = SPLITS) -> DataFrame:
    """Add ``salt``: rows of a hot key are copied to every salt value, the others kept once."""
    every = F.sequence(F.lit(0), F.lit(splits - 1))
    return df.withColumn("salt", F.explode(F.when(F.col(key).isin(hot), every).otherwise(F.array(F.lit(0)))))


def salted_join(
    many: DataFrame,
    one: DataFrame,
    key: str,
    by: Column,
    how: str = "inner",
    hot: list | None = None,
    splits: int = SPLITS,
) -> DataFrame:
    """Equi-join on the shared column ``key`` with the hot keys of ``many`` split over ``splits`` tasks.

    ``by`` tells the rows of ``many`` apart. ``how`` is any type that keeps or drops rows of ``many``: inner,
    left, left_semi, left_anti. Without hot keys this is a plain join.
    """
    hot = hot_keys(many, key) if hot is None else hot
    if not hot:
        return many.join(one, key, how)
    return (
        scatter(many, key, hot, by, splits)
        .join(replicate(one, key, hot, splits), [key, "salt"], how)
        .drop("salt")
    )

"""Reading and writing the stored tables."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moneytrail.schema import ACCOUNTS, TRANSACTIONS

CACHE_TTL_SECONDS = 3600


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Scan a table with a declared schema; a missing path fails when the scan is planned.

    A text file's value that doesn't fit its column becomes null, for the quality rules to count and to clean.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE")
    return reader.format(fmt).load(path)


def read_dataset(spark: SparkSession, folder: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """``(transactions, accounts)`` from one folder."""
    return (
        read_table(spark, f"{folder}/transactions.{fmt}", TRANSACTIONS, fmt),
        read_table(spark, f"{folder}/accounts.{fmt}", ACCOUNTS, fmt),
    )


def write_dataset(transactions: DataFrame, accounts: DataFrame, folder: str, fmt: str = "csv") -> None:
    """Replace both tables of a folder."""
    for name, df in (("transactions", transactions), ("accounts", accounts)):
        write_table(df, f"{folder}/{name}.{fmt}", fmt)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by_day: str | None = None) -> None:
    """Store a table; ``by_day`` partitions it by the date of that timestamp column.

    A transfers table stored by day lets the look-back filters of the detectors skip whole folders.
    """
    if by_day:
        # few files per day, yet a busy day is still written by several tasks
        df = df.withColumn("day", F.to_date(by_day)).hint("rebalance", "day")
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if by_day:
        writer = writer.partitionBy("day")
    writer.save(path)


def read_or_empty(spark: SparkSession, schema: T.StructType, base: str, path: str) -> DataFrame:
    """The files below a path pattern, or no rows if nothing matches it."""
    try:
        return spark.read.schema(schema).option("basePath", base).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_accounts(new: DataFrame, current: DataFrame, path: str) -> None:
    """Append accounts whose ids are all new and unique; otherwise append none and fail."""
    clash = new.join(current.select("account_id"), "account_id", "left_semi").select("account_id")
    repeated = new.groupBy("account_id").count().where("count > 1").select("account_id")
    offenders = clash.union(repeated).distinct()
    first = offenders.limit(1).head()
    if first:
        raise ValueError(f"account_id already present or repeated, e.g. {first[0]}")
    write_table(new, path, mode="append")


def save_features(features: DataFrame, path: str, as_of: str) -> None:
    """Store features stamped with the time they stand for."""
    write_table(features.withColumn("computed_at", F.lit(as_of).cast("timestamp_ntz")), path)


def load_features(spark: SparkSession, path: str, as_of: str, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame | None:
    """Stored features if they stand for ``as_of`` or at most ``ttl_seconds`` before it, else None."""
    try:
        stored = spark.read.parquet(path)
    except Exception as error:  # a table that was never written
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    now = F.lit(as_of).cast("timestamp_ntz")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.max("computed_at").cast("timestamp"))
    fresh = stored.agg(age.between(0, ttl_seconds * 1_000_000).alias("fresh")).head()["fresh"]
    return stored.drop("computed_at") if fresh else None

"""Transfer events from several feeds as one stream, cleaned and enriched."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LATENESS = "10 minutes"


def file_feed(spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "parquet", only: str | None = None) -> DataFrame:
    """New files of a folder as a stream; ``only`` is a file-name pattern."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if only:
        reader = reader.option("pathGlobFilter", only)
    return reader.load(folder)


def topic_feed(spark: SparkSession, servers: str, topic: str, schema: T.StructType, **options: str) -> DataFrame:
    """JSON events of a Kafka topic; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def unified(feeds: dict[str, DataFrame]) -> DataFrame:
    """All feeds as one stream of equal columns, marked with the name of the feed."""
    marked = [df.withColumn("feed", F.lit(name)) for name, df in feeds.items()]
    return reduce(DataFrame.unionByName, marked)


def event_time(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Event time as a zoned timestamp with a watermark; zone-less times cannot carry one."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def enriched(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transfers with customer and KYC attributes of the sender, null for an unknown one."""
    customer = accounts.select(
        F.col("account_id").alias("src"), "account_type", "customer_name", "customer_category", "kyc_status", "account_age_days"
    )
    return events.join(customer, "src", "left")


def deduplicated(events: DataFrame) -> DataFrame:
    """Each ``txn_id`` once within the lateness bound; call ``event_time`` first.

    Over a stored table the same rule is ``dropDuplicates``.
    """
    if events.isStreaming:
        return events.dropDuplicatesWithinWatermark(["txn_id"])
    return events.dropDuplicates(["txn_id"])

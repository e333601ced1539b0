"""Tables keyed by account that a batch changes in part.

Rows lie in buckets by the hash of their account. A change reads and rewrites only the buckets its accounts fall into, each as a new
version beside the old one; a manifest, one small file that lists the version of every bucket, then makes them current at once.
Until it is there readers see the old versions, so a job that dies in between has changed nothing. Two writers that start from the
same state clash at the manifest, and the second fails.
"""

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moneytrail.operators.features import moves
from moneytrail.operators.report import RECENT, newest_first
from moneytrail.sources.edges import upsert_accounts, write_back_risk
from moneytrail.sources.tables import read_or_empty

KEY = "account_id"
MANIFEST = "bucket int, version string, buckets int"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _put(rows: DataFrame, path: str, buckets: int) -> str:
    """Write rows as a new version of their buckets, which nothing refers to yet."""
    version = uuid4().hex
    placed = rows.withColumn("bucket", bucket_of(KEY, buckets))
    (
        placed.repartition("bucket").withColumn("version", F.lit(version))
        .write.mode("append").partitionBy("bucket", "version").parquet(f"{path}/data")
    )
    return version


def _publish(spark: SparkSession, path: str, number: int, versions: dict[int, str], buckets: int) -> None:
    rows = [(b, v, buckets) for b, v in sorted(versions.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/number={number}")


def _current(spark: SparkSession, path: str) -> tuple[int, dict[int, str], int]:
    """Number of the newest manifest, the version of each bucket that has rows, and how many buckets there are."""
    manifests = spark.read.schema(f"{MANIFEST}, number int").parquet(f"{path}/manifest")
    newest = manifests.agg(F.max("number")).head()[0]
    rows = manifests.where(F.col("number") == newest).collect()  # a row for each bucket
    return newest, {r["bucket"]: r["version"] for r in rows if r["version"]}, rows[0]["buckets"]


def _read(spark: SparkSession, path: str, versions: dict[int, str], schema) -> DataFrame:
    paths = [f"{path}/data/bucket={b}/version={v}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _buckets_with(spark: SparkSession, path: str, version: str) -> set[int]:
    """The buckets that a version has rows in."""
    data = f"{path}/data"
    rows = read_or_empty(spark, T.StructType.fromDDL("bucket int"), data, f"{data}/bucket=*/version={version}")
    return {r["bucket"] for r in rows.distinct().collect()}


def create(table: DataFrame, path: str, buckets: int) -> None:
    """Store a table anew; choose buckets so that one of them is a comfortable task."""
    spark = table.sparkSession
    table.limit(0).write.parquet(f"{path}/schema")
    version = _put(table, path, buckets)
    _publish(spark, path, 0, dict.fromkeys(range(buckets), "") | dict.fromkeys(_buckets_with(spark, path, version), version), buckets)


def read(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """The current rows; with ``ids`` those of some accounts, from their buckets alone."""
    schema = spark.read.parquet(f"{path}/schema").schema
    _, versions, buckets = _current(spark, path)
    if ids is None:
        return _read(spark, path, versions, schema)
    asked = spark.createDataFrame([(i,) for i in ids], f"{KEY} string")
    wanted = {r[0] for r in asked.select(bucket_of(KEY, buckets)).distinct().collect()}
    return _read(spark, path, {b: v for b, v in versions.items() if b in wanted}, schema).join(F.broadcast(asked.distinct()), KEY)


def change(path: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets of the accounts in ``changes`` by ``merge(their rows, changes)``; the buckets rewritten.

    ``merge`` may give rows of no other accounts than it was given.
    """
    spark = changes.sparkSession
    schema = spark.read.parquet(f"{path}/schema").schema
    number, versions, buckets = _current(spark, path)
    touched = sorted(r[0] for r in changes.select(bucket_of(KEY, buckets)).distinct().collect())
    if not touched:
        return []
    merged = merge(_read(spark, path, {b: versions[b] for b in touched if b in versions}, schema), changes)
    version = _put(merged.select(*schema.names), path, buckets)
    written = _buckets_with(spark, path, version)
    renewed = {b: version if b in written else "" for b in touched}
    _publish(spark, path, number + 1, dict.fromkeys(range(buckets), "") | versions | renewed, buckets)
    return touched


def upsert(path: str, batch: DataFrame, order_by: str | None = None) -> list[int]:
    """``edges.upsert_accounts`` on the buckets of a batch."""
    return change(path, batch, lambda current, new: upsert_accounts(current, new, order_by))


def write_back(path: str, updates: DataFrame) -> list[int]:
    """``edges.write_back_risk`` on the buckets of the updates."""
    return change(path, updates, write_back_risk)


# --- the latest transfers of every account ----------------------------------------------------------

LATEST = ["account_id", "txn_id", "amount", "txn_type", "ts", "counterparty", "sent", "is_fraud"]


def create_latest(transfers: DataFrame, path: str, buckets: int, limit: int = RECENT) -> None:
    """Store the latest ``limit`` transfers of every account, to be kept up by ``add_latest``."""
    create(newest_first(moves(transfers), limit).select(*LATEST), path, buckets)


def add_latest(path: str, batch: DataFrame, limit: int = RECENT) -> list[int]:
    """Add a batch of transfers, late ones included; a repeated batch changes nothing.

    The latest of all are among the latest before and the batch, so the transfers themselves are not read again.
    """
    new = newest_first(moves(batch), limit).select(*LATEST)
    return change(path, new, lambda current, more: newest_first(current.unionByName(more).distinct(), limit).select(*LATEST))


def latest(spark: SparkSession, path: str, ids: list[str] | None = None, limit: int = RECENT) -> DataFrame:
    """What ``report.recent_transfers`` gives, from the stored rows."""
    return newest_first(read(spark, path, ids), limit).drop("sent")

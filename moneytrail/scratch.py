"""Intermediate tables that cut lineage and survive the loss of an executor.

Iterative operators write each round as parquet below the shared folder named by
``spark.checkpoint.dir``. Reading it back gives the planner true sizes, so joins with a small
frontier become broadcasts and joins with a large one do not.
"""

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="moneytrail-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as a table scan."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The same with the number of rows, which parquet knows without reading them."""
    stored = materialize(df, name)
    return stored, stored.count()


#: Rows from which a table is joined by sorting both sides.
BROADCAST_ROWS = 100_000


def large(rows: int) -> bool:
    return rows > BROADCAST_ROWS


def sorted_join(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` for joins with another table that grows with the input: they sort both sides and broadcast neither.

    Parquet holds a few repeating ids in a small part of the space that rows take in memory, so by the size of its files the
    planner sends tables of millions of rows through the driver. One known to have few ``rows`` is left to the planner.
    """
    return df if rows is not None and not large(rows) else df.hint("merge")


def folded(df: DataFrame, step: int, name: str, every: int = 8) -> DataFrame:
    """A union that grows in a loop, stored as one table in every ``every``-th step, so that its scans stay few."""
    return materialize(df, name) if step % every == 0 else df


def together(spark: SparkSession, *steps: Callable) -> list:
    """Run independent steps, each of which starts jobs of its own, at the same time; results in order.

    The late, narrow stages of one step leave executors idle that another can use.
    """
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
        return [s.result() for s in started]

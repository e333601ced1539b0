"""Running per-account history that outlives sessions and restarts.

State is kept per account and shard. A busy account so has as many state rows as there are shards, handled by
different tasks; ``merged`` adds the shards up. A history without an end is a streaming aggregate, whose rows are added up
before they reach the state; only one that expires needs a processor of its own, called for each account and shard.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHARDS = 8
OUTPUT = "src string, shard int, transfers bigint, total double, largest double, last_ts timestamp"
STATE = "transfers bigint, total double, largest double, last_ts timestamp"


class AccountHistory(StatefulProcessor):
    """Count, sum, maximum and latest time of the transfers an account has sent."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        transfers, total, largest, last_ts = self.state.get() if self.state.exists() else (0, 0.0, None, None)
        for pdf in rows:
            transfers += len(pdf)
            total += float(pdf["amount"].sum())
            highest, latest = float(pdf["amount"].max()), pdf["ts"].max()
            largest = highest if largest is None else max(largest, highest)
            last_ts = latest if last_ts is None else max(pd.Timestamp(last_ts), latest)
        self.state.update((transfers, total, largest, last_ts))
        yield pd.DataFrame({
            "src": [key[0]], "shard": [key[1]], "transfers": [transfers], "total": [total],
            "largest": [largest], "last_ts": [last_ts],
        })

    def close(self) -> None:
        pass


def account_history(events: DataFrame, ttl_ms: int | None = None, shards: int = SHARDS) -> DataFrame:
    """The history of each account and shard a batch has touched; one that expires needs the RocksDB state store."""
    keyed = events.select("src", F.pmod(F.xxhash64("txn_id"), F.lit(shards)).cast("int").alias("shard"), "amount", "ts")
    if ttl_ms is None:
        return keyed.groupBy("src", "shard").agg(
            F.count("*").alias("transfers"), F.sum("amount").alias("total"), F.max("amount").alias("largest"), F.max("ts").alias("last_ts")
        )
    return keyed.groupBy("src", "shard").transformWithStateInPandas(
        statefulProcessor=AccountHistory(ttl_ms), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime",
    )


def merged(history: DataFrame, version: str = "batch_id") -> DataFrame:
    """One row per account from the newest version of each of its shards."""
    values = ["transfers", "total", "largest", "last_ts"]
    newest = history.groupBy("src", "shard").agg(F.max_by(F.struct(*values), F.col(version)).alias("h")).select("src", "h.*")
    return newest.groupBy("src").agg(
        F.sum("transfers").alias("transfers"), F.sum("total").alias("total"),
        F.max("largest").alias("largest"), F.max("last_ts").alias("last_ts"),
    )

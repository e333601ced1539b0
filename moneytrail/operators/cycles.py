"""Circular round trips: closed directed trails in the transfer graph.

A trail may pass an account more than once but uses a transfer only once. Every trail of n transfers
is reported n times, once from each of its transfers, as the anchor is part of the result. The search
finds each trail once and turns it round at the end.

* Transfers that cannot lie on a trail are trimmed first.
* A search starts only from the account of highest rank (degree, then id) on the trail, so paths never
  fan out through an account busier than their anchor.
* A trail of n transfers is the join of a forward half of ceil(n/2) and a backward half of floor(n/2) on
  (anchor, meeting account), so with five hops no more than three are ever enumerated.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.functions.columns import look_back
from moneytrail.functions.skew import hot_keys, salted_join
from moneytrail.scratch import materialize, materialize_counted

TRIM_ROUNDS = 2


def closable(edges: DataFrame) -> DataFrame:
    """Keep transfers whose receiver sends and whose sender receives; any number of rounds is lossless."""
    for _ in range(TRIM_ROUNDS):
        senders = edges.select(F.col("src").alias("dst")).distinct()
        receivers = edges.select(F.col("dst").alias("src")).distinct()
        edges = edges.join(senders, "dst", "left_semi").join(receivers, "src", "left_semi")
    return edges


def _ranked(edges: DataFrame) -> DataFrame:
    """Add the rank of both ends; ranks are ordered pairs (degree, id)."""
    degree = (
        edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    )
    rank = degree.select("node", F.struct("degree", "node").alias("rank"))
    return edges.join(
        rank.select(F.col("node").alias("src"), F.col("rank").alias("src_rank")), "src"
    ).join(rank.select(F.col("node").alias("dst"), F.col("rank").alias("dst_rank")), "dst")


def _step() -> Column:
    return F.struct("src", "dst", "txn_id", "amount", "ts").alias("step")


def trails(transfers: DataFrame, as_of: Column, max_hop: int = 5, hours: int = 72) -> DataFrame:
    """Each closed trail of 2..max_hop transfers once, as ``(cycle_length, steps)``.

    Writes the transfers of the window, the trimmed ones and the half paths as scratch tables.
    """
    window = look_back(transfers, as_of, hours=hours).select("src", "dst", "txn_id", "amount", "ts")
    trimmed = materialize(closable(materialize(window, "trail-window")), "trail-edges")
    edges, rows = materialize_counted(_ranked(trimmed), "trail-edges")

    forward = {
        1: edges.where("dst_rank <= src_rank").select(
            F.col("src").alias("anchor"),
            F.col("src_rank").alias("top"),
            F.col("dst").alias("meet"),
            F.col("txn_id").alias("first_txn"),
            F.array(_step()).alias("head"),
        )
    }
    backward = {
        1: edges.where("src_rank <= dst_rank").select(
            F.col("dst").alias("anchor"),
            F.col("dst_rank").alias("top"),
            F.col("src").alias("meet"),
            F.when(F.col("src") == F.col("dst"), F.col("txn_id")).alias("anchor_txn"),
            F.array(_step()).alias("tail"),
        )
    }
    hop = edges.select("src", "dst", "src_rank", "dst_rank", "txn_id", _step())
    busy_senders, busy_receivers = hot_keys(edges, "src", rows=rows), hot_keys(edges, "dst", rows=rows)
    for k in range(2, (max_hop + 1) // 2 + 1):
        onward = hop.withColumn("meet", F.col("src"))
        grown = salted_join(onward, forward[k - 1], "meet", F.col("txn_id"), hot=busy_senders).where(
            (F.col("dst_rank") <= F.col("top"))
            & ~F.array_contains(F.col("head.txn_id"), F.col("txn_id"))
            # of several transfers leaving the anchor the smallest id comes first
            & ((F.col("src") != F.col("anchor")) | (F.col("txn_id") > F.col("first_txn")))
        )
        forward[k] = materialize(
            grown.select("anchor", "top", F.col("dst").alias("meet"), "first_txn", F.array_append("head", F.col("step")).alias("head")),
            "trail-forward",
        )
    for k in range(2, max_hop // 2 + 1):
        before = hop.withColumn("meet", F.col("dst"))
        grown = salted_join(before, backward[k - 1], "meet", F.col("txn_id"), hot=busy_receivers).where(
            (F.col("src_rank") <= F.col("top")) & ~F.array_contains(F.col("tail.txn_id"), F.col("txn_id"))
        )
        leaves_anchor = F.when(F.col("src") == F.col("anchor"), F.col("txn_id"))
        backward[k] = materialize(
            grown.select(
                "anchor", "top", F.col("src").alias("meet"),
                F.least("anchor_txn", leaves_anchor).alias("anchor_txn"),
                F.array_prepend("tail", F.col("step")).alias("tail"),
            ),
            "trail-backward",
        )

    def closed(length: int) -> DataFrame:
        head, tail = forward[(length + 1) // 2], backward[length // 2].drop("top")
        return (
            head.join(tail, ["anchor", "meet"])
            .where(
                ~F.arrays_overlap("head.txn_id", "tail.txn_id")
                & (F.col("anchor_txn").isNull() | (F.col("anchor_txn") > F.col("first_txn")))
            )
            .select(F.lit(length).alias("cycle_length"), F.concat("head", "tail").alias("steps"))
        )

    return reduce(DataFrame.unionByName, [closed(n) for n in range(2, max_hop + 1)])


def circular(transfers: DataFrame, as_of: Column, max_hop: int = 5, hours: int = 72) -> DataFrame:
    """One row per closed trail and anchor, with accounts, transfers, amounts and times in travel order."""
    return circular_of(trails(transfers, as_of, max_hop, hours))


def circular_of(found: DataFrame) -> DataFrame:
    """The rows of ``circular`` for closed trails that are given once each."""
    n = F.col("cycle_length")
    turned = (
        found.withColumn("at", F.explode(F.sequence(F.lit(0), n - 1)))
        .select(
            n,
            F.concat(F.slice("steps", F.col("at") + 1, n - F.col("at")), F.slice("steps", F.lit(1), F.col("at"))).alias("steps"),
        )
    )
    return turned.select(
        F.col("steps")[0]["src"].alias("anchor_account"),
        F.array_append("steps.src", F.col("steps")[0]["src"]).alias("account_ids"),
        F.col("steps.txn_id").alias("txn_ids"),
        F.col("steps.amount").alias("amounts"),
        F.aggregate("steps.amount", F.lit(0.0), lambda total, amount: total + amount).alias("total_amount"),
        n,
        F.col("steps.ts").alias("timestamps"),
    )

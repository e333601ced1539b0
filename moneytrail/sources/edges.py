"""Building and maintaining the account graph tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.functions.skew import hot_keys, salted_join


def upsert_accounts(current: DataFrame, batch: DataFrame, order_by: str | None = None) -> DataFrame:
    """Merge a batch into the account table by ``account_id``.

    A batch row replaces every other column of the stored row. ``order_by`` names a batch column that
    decides between several rows for one account: the highest wins, nulls lowest. Rows that are equal in it, or all
    rows without ``order_by``, are decided by a hash of their contents, so an account is always one row and a
    repeated run gives the same. The deciding column is not kept.
    """
    columns = [c for c in current.columns if c != "account_id"]
    order = F.struct(*([F.col(order_by)] if order_by else []), F.xxhash64(*columns), F.struct(*columns))
    newest = batch.groupBy("account_id").agg(F.max_by(F.struct(*columns), order).alias("new"))
    merged = current.join(newest, "account_id", "full_outer")
    is_new = F.col("new").isNotNull()
    return merged.select(
        "account_id",
        *[F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in columns],
    )


def with_known(txns: DataFrame, accounts: DataFrame, column: str, how: str = "left_semi", hot: list | None = None) -> DataFrame:
    """Rows whose ``column`` is (or with ``left_anti`` is not) an existing account.

    An account with a large share of the transactions is split over several tasks; ``hot`` lists such accounts if
    they are known already.
    """
    known = accounts.select(F.col("account_id").alias(column)).distinct()
    return salted_join(txns, known, column, F.col("txn_id"), how, hot).select(txns.columns)


def _stamp(column: str):
    return F.date_trunc("second", column).cast("timestamp_ntz")


def build_transfers(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Account-to-account edges; a transaction with an unknown endpoint makes none."""
    # counted over the stored input, or the first join would run once more for the second count
    sent, received = "sender_account", "receiver_account"
    both = with_known(with_known(txns, accounts, sent, hot=hot_keys(txns, sent)), accounts, received, hot=hot_keys(txns, received))
    return both.select(
        "txn_id",
        _stamp("timestamp").alias("ts"),
        F.col("sender_account").alias("src"),
        F.col("receiver_account").alias("dst"),
        "amount",
        "txn_type",
        "is_fraud",
    )


def build_transactions(txns: DataFrame) -> DataFrame:
    """Transaction nodes: the record without its endpoints, null fraud type as empty text."""
    return txns.select(
        "txn_id",
        _stamp("timestamp").alias("timestamp"),
        "amount",
        "txn_type",
        "channel",
        "status",
        "description",
        "is_fraud",
        F.coalesce("fraud_type", F.lit("")).alias("fraud_type"),
    )


def build_sent(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Sender-to-transaction edges; only the sender must be known."""
    return with_known(txns, accounts, "sender_account").select(
        F.col("sender_account").alias("account_id"), "txn_id", "amount", _stamp("timestamp").alias("ts")
    )


def build_received(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transaction-to-receiver edges; only the receiver must be known."""
    return with_known(txns, accounts, "receiver_account").select(
        "txn_id", F.col("receiver_account").alias("account_id"), "amount", _stamp("timestamp").alias("ts")
    )


def build_counts(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows created per table as ``(metric, value)``, with the transactions lost to unknown endpoints."""
    ids = accounts.select("account_id").distinct()
    per_pair = txns.groupBy("sender_account", "receiver_account").agg(F.count("*").alias("n"))
    known = (
        per_pair
        .join(ids.select(F.col("account_id").alias("sender_account"), F.lit(True).alias("s")), "sender_account", "left")
        .join(ids.select(F.col("account_id").alias("receiver_account"), F.lit(True).alias("r")), "receiver_account", "left")
    )
    sent, received = F.col("s").isNotNull(), F.col("r").isNotNull()

    def rows(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    totals = known.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("transactions"),
        rows(sent).alias("sent_rels"),
        rows(received).alias("received_rels"),
        rows(sent & received).alias("transfer_rels"),
        rows(~(sent & received)).alias("orphan_transactions"),
    )
    names = totals.columns
    return totals.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])).alias("m")
    ).select("m.*")


def write_back_risk(accounts: DataFrame, updates: DataFrame) -> DataFrame:
    """Set ``risk_score`` (0-1) and ``is_flagged`` from updates keyed by account, each where the update has it; unknown ids are ignored."""
    new = updates.select(
        "account_id", F.col("risk_score").alias("new_risk"), F.col("is_flagged").alias("new_flag")
    )
    replaced = {"risk_score": F.coalesce("new_risk", "risk_score"), "is_flagged": F.coalesce("new_flag", "is_flagged")}
    return accounts.join(new, "account_id", "left").select(
        *[replaced[c].alias(c) if c in replaced else F.col(c) for c in accounts.columns]
    )

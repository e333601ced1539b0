"""Alerts: making them, listing them, their statistics, details and status changes."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.functions.columns import fixed
from moneytrail.functions.ranking import running_total
from moneytrail.operators.risk import tier_counts
from moneytrail.schema import ALERT_STATUSES, RISK_TIERS
from moneytrail.scratch import materialize

PAGE_MAX = 200
#: The listing of all tiers.
ALL_TIERS = "ALL"
RISK_UNIT = 10_000
EVIDENCE_FLOOR = 10


def evidence_summary() -> Column:
    """The sentences below are fixed values: texts that an alert shows."""
    model = F.when(F.col("gnn_contribution") > EVIDENCE_FLOOR, F.concat(
        F.lit("GNN model indicates "), fixed(F.col("gnn_contribution"), 0),
        F.lit("% structural risk from account neighbourhood."),
    ))
    outlier = F.when(F.col("iso_contribution") > EVIDENCE_FLOOR, F.concat(
        F.lit("Anomaly detection score contributes "), fixed(F.col("iso_contribution"), 0),
        F.lit("% — behavioral patterns deviate from baseline."),
    ))
    rules = F.when(F.size("triggered_patterns") > 0, F.concat(
        F.lit("AML patterns detected: "), F.array_join("triggered_patterns", ", "), F.lit(".")
    ))
    said = F.concat_ws(" ", model, outlier, rules)
    return F.when(said == "", "Account flagged based on aggregate risk signals.").otherwise(said)


def make_alerts(scored: DataFrame, as_of: Column, min_tier: str = "MEDIUM") -> DataFrame:
    """An open alert for every account at or above the tier, highest score first.

    The id is a hash of account and time, so making the alerts again gives the same ids.
    """
    wanted = RISK_TIERS[RISK_TIERS.index(min_tier) if min_tier in RISK_TIERS else 1:]
    return scored.where(F.col("risk_tier").isin(wanted)).select(
        F.sha2(F.concat_ws("|", "account_id", as_of.cast("string")), 256).alias("alert_id"),
        "account_id", "risk_score", "risk_tier", "triggered_patterns", "recommendation",
        evidence_summary().alias("evidence_summary"),
        as_of.alias("created_at"),
        F.lit("OPEN").alias("status"),
    ).orderBy(F.desc("risk_score"), "account_id")


def alert_page(alerts: DataFrame, tier: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of alerts by score, each row with the total and whether more follow."""
    if not 1 <= limit <= PAGE_MAX or offset < 0:
        raise ValueError(f"limit must be 1..{PAGE_MAX} and offset not negative")
    chosen = alerts.where(F.col("risk_tier") == tier.upper()) if tier else alerts
    total = chosen.agg(F.count("*").alias("n")).scalar()
    page = chosen.orderBy(F.desc("risk_score"), "account_id").offset(offset).limit(limit)
    return page.select(
        "alert_id", "account_id", "risk_score", "risk_tier", "triggered_patterns", "status", "created_at",
        total.alias("total"), (F.lit(offset + limit) < total).alias("has_more"),
    )


def store_pages(alerts: DataFrame, path: str, block_rows: int = 100 * PAGE_MAX) -> None:
    """Store alerts in page order, once for all tiers and once by tier, in blocks of ``block_rows`` places.

    Places come from range partitions and their totals, so no task orders all alerts. A page lies in one or two blocks.
    """
    listed = alerts.withColumn("listing", F.explode(F.array(F.lit(ALL_TIERS), F.col("risk_tier")))).withColumn("falling", -F.col("risk_score"))
    placed = materialize(running_total(listed, ["listing", "falling", "account_id", "alert_id"], F.lit(1)), "placed-alerts")
    # a listing for each tier
    sizes = F.broadcast(placed.groupBy("listing").agg(F.min("before").alias("first"), F.count("*").alias("total")))
    at = F.col("before") - F.col("first")
    blocks = placed.join(sizes, "listing").withColumns({"place": at, "block": F.floor(at / block_rows).cast("int"), "block_rows": F.lit(block_rows)})
    rows = blocks.drop("before", "first", "falling")
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    (
        rows.repartition("listing", "block").sortWithinPartitions("place")
        .write.mode("overwrite").partitionBy("listing", "block").parquet(f"{path}/pages")
    )


def stored_page(spark: SparkSession, path: str, tier: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """What ``alert_page`` gives, from the one or two blocks of ``store_pages`` that hold it."""
    if not 1 <= limit <= PAGE_MAX or offset < 0:
        raise ValueError(f"limit must be 1..{PAGE_MAX} and offset not negative")
    stored = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/pages")
    listing = stored.where(F.col("listing") == (tier.upper() if tier else ALL_TIERS))
    start = listing.where(F.col("block") == 0).select("block_rows").head()
    rows = start["block_rows"] if start else 1
    page = listing.where(F.col("block").between(offset // rows, (offset + limit - 1) // rows))
    return page.where(F.col("place").between(offset, offset + limit - 1)).orderBy("place").select(
        "alert_id", "account_id", "risk_score", "risk_tier", "triggered_patterns", "status", "created_at",
        "total", (F.lit(offset + limit) < F.col("total")).alias("has_more"),
    )


def alert_stats(alerts: DataFrame, top: int = 10) -> DataFrame:
    """``(section, item, value)``: total, count per tier, most frequent patterns, amount at risk."""
    by_tier = tier_counts(alerts).select(F.lit("by_tier").alias("section"), F.col("risk_tier").alias("item"), F.col("accounts").cast("double").alias("value"))
    # a pattern not known to the schema still counts, hence a top list
    patterns = (
        alerts.select(F.explode("triggered_patterns").alias("item")).groupBy("item").agg(F.count("*").cast("double").alias("value"))
        .orderBy(F.desc("value"), "item").limit(top)
        .select(F.lit("top_patterns").alias("section"), "item", "value")
    )
    severe = F.when(F.col("risk_tier").isin("HIGH", "CRITICAL"), F.col("risk_score") * RISK_UNIT)
    totals = alerts.agg(
        F.count("*").cast("double").alias("total_alerts"),
        F.round(F.coalesce(F.sum(severe), F.lit(0.0)), 2).alias("total_amount_at_risk"),
    )
    items = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in totals.columns])
    overall = totals.select(F.explode(items).alias("r")).select(F.lit("overall").alias("section"), "r.item", "r.value")
    return overall.unionByName(by_tier).unionByName(patterns)


def apply_updates(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """Fold status updates ``(alert_id, status, analyst_note, updated_at)`` into the alerts.

    Statuses are upper-cased and unknown ones ignored, as are updates of unknown alerts. The latest update of an
    alert gives its status; an empty note leaves the note before it in place.
    """
    for name, kind in (("analyst_note", "string"), ("updated_at", "timestamp_ntz")):
        if name not in alerts.columns:
            alerts = alerts.withColumn(name, F.lit(None).cast(kind))
    valid = updates.select(
        "alert_id", F.upper("status").alias("status"), F.nullif("analyst_note", F.lit("")).alias("note"), "updated_at"
    ).where(F.col("status").isin(ALERT_STATUSES))
    latest = valid.groupBy("alert_id").agg(
        F.max(F.struct("updated_at", "status")).alias("last"),
        F.max(F.when(F.col("note").isNotNull(), F.struct("updated_at", "note"))).alias("noted"),
    )
    changed = F.col("last").isNotNull()
    kept = [c for c in alerts.columns if c not in ("status", "analyst_note", "updated_at")]
    return alerts.join(latest, "alert_id", "left").select(
        *kept,
        F.when(changed, F.col("last.status")).otherwise(F.col("status")).alias("status"),
        F.coalesce("noted.note", "analyst_note").alias("analyst_note"),
        F.when(changed, F.col("last.updated_at")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def rejected_updates(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates that ``apply_updates`` ignores, and why."""
    known = alerts.select("alert_id", F.lit(True).alias("known"))
    reason = F.when(F.col("known").isNull(), "unknown_alert").when(
        ~F.upper("status").isin(ALERT_STATUSES), "invalid_status"
    )
    return updates.join(known, "alert_id", "left").withColumn("reason", reason).where("reason is not null").drop("known")


def alert_details(alerts: DataFrame, accounts: DataFrame, scored: DataFrame, recent: DataFrame) -> DataFrame:
    """Alerts with their account, latest transfers and the model scores behind them."""
    if "analyst_note" not in alerts.columns:
        alerts = alerts.withColumn("analyst_note", F.lit(None).cast("string"))
    fields = [c for c in accounts.columns if c != "account_id"]
    metadata = accounts.select("account_id", F.struct("account_id", *fields).alias("account_metadata"))
    moves = recent.groupBy("account_id").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("place"), "txn_id", "amount", "txn_type", "ts", "counterparty", "is_fraud"
        ))).alias("transactions")
    )
    parts = scored.select(
        "account_id", (F.col("gnn_contribution") / 40).alias("gnn_fraud_prob"), (F.col("iso_contribution") / 35).alias("anomaly_score")
    )
    return (
        alerts.join(metadata, "account_id", "left").join(moves, "account_id", "left").join(parts, "account_id", "left")
        .select(
            "alert_id", "account_id", "risk_score", "risk_tier", "triggered_patterns", "recommendation",
            "evidence_summary", "status", "analyst_note", "created_at",
            F.coalesce("account_metadata", F.struct("account_id", *[F.lit(None).cast(accounts.schema[c].dataType).alias(c) for c in fields])).alias("account_metadata"),
            "transactions",
            F.col("evidence_summary").alias("combined_explanation"),
            F.coalesce("gnn_fraud_prob", F.lit(0.0)).alias("gnn_fraud_prob"),
            F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
        )
    )

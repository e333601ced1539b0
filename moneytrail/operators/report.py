"""Latest transfers per account, report datasets and run summaries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.functions.columns import fixed
from moneytrail.operators.features import moves
from moneytrail.operators.patterns import Found, pattern_counts

RECENT = 10
REPORT_ROWS = 20


def account_lookup(accounts: DataFrame, ids: DataFrame) -> DataFrame:
    """The accounts asked for; an unknown id yields a row with nothing but the id."""
    return ids.select("account_id").distinct().join(accounts, "account_id", "left")


def recent_transfers(transfers: DataFrame, limit: int = RECENT) -> DataFrame:
    """The latest ``limit`` transfers of every account, either direction, newest first (``place`` 1).

    Spark keeps only the first ``limit`` rows per account on each side of the shuffle, so a busy account does
    not move all its transfers into one task.
    """
    return newest_first(moves(transfers), limit).drop("sent")


def newest_first(seen: DataFrame, limit: int) -> DataFrame:
    """The latest ``limit`` moves of every account with their ``place``."""
    newest = Window.partitionBy("account_id").orderBy(F.desc("ts"), "txn_id", "counterparty", "sent")
    return seen.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit).select(
        "account_id", "place", "txn_id", "amount", "txn_type", "ts", "counterparty", "sent", "is_fraud"
    )


def report_rows(details: DataFrame, analyst_name: str, analyst_id: str, as_of: Column, limit: int = REPORT_ROWS,
                institution: str | None = None) -> DataFrame:
    """One nested row per alert with everything a suspicious-transaction report prints.

    Its texts and formats are fixed values.
    """
    account = F.col("account_metadata")
    line = F.transform(F.slice(F.coalesce("transactions", F.array()), 1, limit), lambda t: F.struct(
        F.concat(F.substring(t["txn_id"], 1, 12), F.lit("...")).alias("txn_id"),
        F.concat(F.lit("₹"), F.format_number(t["amount"], 2)).alias("amount"),
        t["txn_type"].alias("type"),
        F.substring(F.date_format(t["ts"], "yyyy-MM-dd'T'HH:mm:ss"), 1, 19).alias("timestamp"),
        F.substring(t["counterparty"], 1, 13).alias("counterparty"),
        F.when(t["is_fraud"], "YES").otherwise("NO").alias("fraud"),
    ))
    report_id = F.sha2(F.concat_ws("|", "alert_id", F.lit(analyst_id), as_of.cast("string")), 256)
    missing = F.lit("N/A")
    return details.select(
        report_id.alias("report_id"),
        F.upper(F.substring(report_id, 1, 16)).alias("report_no"),
        "alert_id",
        F.lit(institution).cast("string").alias("institution"),
        F.lit("Suspicious Transaction Report (STR)").alias("report_type"),
        F.date_format(as_of, "dd-MM-yyyy").alias("report_date"),
        F.date_format(as_of, "HH:mm:ss").alias("report_time"),
        F.struct(
            F.col("account_id"),
            F.coalesce(account["customer_name"], missing).alias("customer_name"),
            F.coalesce(account["account_type"], missing).alias("account_type"),
            F.coalesce(account["customer_category"], missing).alias("customer_category"),
            F.coalesce(account["branch_code"], missing).alias("branch_code"),
            F.coalesce(account["kyc_status"], missing).alias("kyc_status"),
        ).alias("account"),
        F.concat(fixed(F.col("risk_score"), 0), F.lit("/100")).alias("risk_score"),
        "risk_tier",
        F.array_join("triggered_patterns", ", ").alias("patterns"),
        F.coalesce("evidence_summary", F.lit("No evidence summary available.")).alias("evidence"),
        line.alias("transactions"),
        F.struct(
            F.lit(analyst_name).alias("name"), F.lit(analyst_id).alias("id"),
            F.date_format(as_of, "dd-MM-yyyy HH:mm 'IST'").alias("date"),
        ).alias("analyst"),
    )


def _counts(df: DataFrame, names: dict[str, Column]) -> DataFrame:
    wide = df.agg(*[c.cast("double").alias(n) for n, c in names.items()])
    items = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return wide.select(F.explode(items).alias("m")).select("m.*")


def run_summary(metrics: DataFrame, anomalies: DataFrame, found: dict[str, Found], alerts: DataFrame) -> DataFrame:
    """``(metric, value)``: model metrics, flagged anomalies, detections per pattern and alerts per tier."""
    model = metrics.select(F.concat(F.lit("gnn_"), "metric").alias("metric"), F.round("value", 4).alias("value"))
    flagged = _counts(anomalies, {"anomalies_flagged": F.count_if(F.col("ensemble_is_anomaly"))})
    patterns = pattern_counts(found).select(
        F.concat(F.lit("patterns_"), "pattern").alias("metric"), F.col("detections").cast("double").alias("value")
    )
    tier = F.col("risk_tier")
    raised = _counts(alerts, {
        "alerts_critical": F.count_if(tier == "CRITICAL"), "alerts_high": F.count_if(tier == "HIGH"),
        "alerts_medium": F.count_if(tier == "MEDIUM"), "total_alerts": F.count("*"),
    })
    return model.unionByName(flagged).unionByName(patterns).unionByName(raised)


def loaded_counts(scored: DataFrame, alerts: DataFrame) -> DataFrame:
    """How many accounts are scored and alerts made."""
    return scored.agg(F.count("*").alias("accounts_loaded")).select(
        "accounts_loaded", alerts.agg(F.count("*")).scalar().alias("alerts_generated")
    )

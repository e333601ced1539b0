"""The combined 0-100 risk score."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.schema import PATTERN_POINTS, PATTERNS, RISK_TIERS

# Weights of the three parts, tier limits, advice per tier, points of an unknown pattern.
GNN_WEIGHT, ANOMALY_WEIGHT, RULE_WEIGHT = 0.40, 0.35, 0.25
TIER_FLOORS = {"CRITICAL": 76, "HIGH": 56, "MEDIUM": 31}
RECOMMENDATIONS = {
    "CRITICAL": "Freeze account immediately and file STR with FIU-IND.",
    "HIGH": "Immediate review required. Escalate to senior investigator.",
    "MEDIUM": "Enhanced due diligence. Monitor closely for 30 days.",
    "LOW": "Normal monitoring. No immediate action required.",
}
UNKNOWN_POINTS = 10


def risk_tier(score: Column) -> Column:
    return reduce(lambda c, t: c.when(score >= TIER_FLOORS[t], t), TIER_FLOORS, F).otherwise("LOW")


def recommendation(tier: Column) -> Column:
    return reduce(lambda c, t: c.when(tier == t, RECOMMENDATIONS[t]), RECOMMENDATIONS, F).otherwise("")


def rule_scores(involvement: DataFrame) -> DataFrame:
    """Points per account, up to 100, and its triggered patterns in reporting order.

    Every detection counts, so an account in three circular detections has reached the limit.
    """
    per_pattern = involvement.groupBy("account_id", "pattern").agg(F.count("*").alias("n"))
    pattern = F.col("pattern")
    points = reduce(lambda c, p: c.when(pattern == p, PATTERN_POINTS[p]), PATTERNS, F).otherwise(UNKNOWN_POINTS)
    order = reduce(lambda c, p: c.when(pattern == p, PATTERNS.index(p)), PATTERNS, F).otherwise(len(PATTERNS))
    return per_pattern.groupBy("account_id").agg(
        F.least(F.lit(100.0), F.sum(points * F.col("n")).cast("double")).alias("rule_score"),
        F.array_sort(F.collect_set(F.struct(order.alias("order"), pattern.alias("name")))).getField("name").alias("triggered_patterns"),
    )


def risk_scores(accounts: DataFrame, gnn: DataFrame, anomaly: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Score, tier and contributions of every account; a missing part counts 0.

    The tier goes by the score before rounding.
    """
    zero = F.lit(0.0)
    joined = (
        accounts.select("account_id")
        .join(gnn.select("account_id", "gnn_fraud_prob"), "account_id", "left")
        .join(anomaly.select("account_id", "ensemble_anomaly_score"), "account_id", "left")
        .join(rules.select("account_id", "rule_score", "triggered_patterns"), "account_id", "left")
    )
    parts = joined.select(
        "account_id",
        (GNN_WEIGHT * F.coalesce("gnn_fraud_prob", zero) * 100).alias("gnn"),
        (ANOMALY_WEIGHT * F.coalesce("ensemble_anomaly_score", zero) * 100).alias("iso"),
        (RULE_WEIGHT * F.coalesce("rule_score", zero)).alias("rule"),
        F.coalesce("triggered_patterns", F.array().cast("array<string>")).alias("triggered_patterns"),
    )
    total = F.col("gnn") + F.col("iso") + F.col("rule")
    scored = parts.withColumn("total", F.least(F.greatest(total, zero), F.lit(100.0)))
    tier = risk_tier(F.col("total"))
    return scored.select(
        "account_id",
        F.round("total", 2).alias("risk_score"),
        tier.alias("risk_tier"),
        F.round("gnn", 2).alias("gnn_contribution"),
        F.round("iso", 2).alias("iso_contribution"),
        F.round("rule", 2).alias("rule_contribution"),
        "triggered_patterns",
        recommendation(tier).alias("recommendation"),
        as_of.alias("timestamp"),
    )


def tier_counts(scored: DataFrame) -> DataFrame:
    """Accounts (or alerts) per tier, zeros included."""
    tiers = scored.sparkSession.createDataFrame([(t,) for t in RISK_TIERS], "risk_tier string")
    counts = scored.groupBy("risk_tier").agg(F.count("*").alias("n"))
    return tiers.join(counts, "risk_tier", "left").select("risk_tier", F.coalesce("n", F.lit(0)).alias("accounts"))


def write_back(scored: DataFrame, flag_from: str = "HIGH") -> DataFrame:
    """Account updates from scores: risk on the 0-1 scale, flagged from the given tier upwards."""
    flagged = RISK_TIERS[RISK_TIERS.index(flag_from):]
    return scored.select(
        "account_id", (F.col("risk_score") / 100).alias("risk_score"), F.col("risk_tier").isin(flagged).alias("is_flagged")
    )

"""Nodes and edges in the shape a graph view draws."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colours and sizes.
TIER_COLOURS = {
    "CRITICAL": "#FF4757",
    "HIGH": "#FF6B35",
    "MEDIUM": "#FFA502",
    "LOW": "#2ED573",
    "NONE": "#636E72",
}
FRAUD_COLOUR = "#FF4757"
NORMAL_COLOUR = "rgba(255, 255, 255, 0.3)"
DEFAULT_SIZE, MIN_SIZE, MAX_SIZE = 30, 20, 80
MIN_WIDTH, MAX_WIDTH = 1, 8


def visual_tier(risk: Column) -> Column:
    """Tier of a 0-1 risk score; a score of 0 has the tier NONE."""
    score = risk * 100
    return (
        F.when(score >= 76, "CRITICAL").when(score >= 56, "HIGH").when(score >= 31, "MEDIUM")
        .when(score > 0, "LOW").otherwise("NONE")
    )


def tier_colour(tier: Column) -> Column:
    return reduce(lambda c, t: c.when(tier == t, TIER_COLOURS[t]), TIER_COLOURS, F).otherwise(TIER_COLOURS["NONE"])


def _peak(df: DataFrame, value: Column, group: list[str]) -> tuple[DataFrame, Column]:
    """The frame with ``peak``, the largest value of its group (of all rows without a group)."""
    if not group:
        top = df.agg(F.max(value).alias("peak")).scalar()
        return df, F.coalesce(top, F.lit(0.0))
    tops = df.groupBy(*group).agg(F.max(value).alias("peak"))
    return df.join(tops, group), F.col("peak")


def _first(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the smallest one, picked by a combining aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("kept")).select(*keys, "kept.*")


def export_nodes(nodes: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Drawn nodes from rows with ``id``, optional risk, sent and received totals and account fields.

    Sizes use the largest volume before duplicate ids are removed; rows without an id are dropped. Of several
    rows for one id the smallest is kept.
    """
    group = group or []
    for name, kind, default in (
        ("risk_score", "double", None), ("total_sent", "double", None), ("total_received", "double", None),
        ("account_type", "string", "UNKNOWN"), ("customer_name", "string", ""), ("customer_category", "string", ""),
        ("is_flagged", "boolean", False), ("kyc_status", "string", "UNKNOWN"),
    ):
        if name not in nodes.columns:
            nodes = nodes.withColumn(name, F.lit(default).cast(kind))
    zero = F.lit(0.0)
    volume = F.coalesce("total_sent", zero) + F.coalesce("total_received", zero)
    sized, peak = _peak(nodes, volume, group)
    risk = F.coalesce("risk_score", zero)
    tier = visual_tier(risk)
    size = F.when(peak <= 0, DEFAULT_SIZE).otherwise(F.floor(MIN_SIZE + volume / peak * (MAX_SIZE - MIN_SIZE)))
    drawn = sized.select(
        *group, "id",
        F.substring("id", 1, 10).alias("label"),
        F.round(risk * 100, 1).alias("risk_score"),
        tier.alias("risk_tier"),
        "account_type", "customer_name", "customer_category",
        F.coalesce("total_sent", zero).alias("total_sent"),
        F.coalesce("total_received", zero).alias("total_received"),
        "is_flagged", "kyc_status",
        tier_colour(tier).alias("color"),
        size.cast("int").alias("size"),
    )
    return _first(drawn.where(F.coalesce("id", F.lit("")) != ""), [*group, "id"])


def export_edges(edges: DataFrame, nodes: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Drawn edges between drawn nodes.

    Widths use the largest amount before anything is removed. Edges with an end that is not drawn are dropped, as
    are repeated ids. An edge without a transfer id is named after its ends.
    """
    group = group or []
    if "fraud_type" not in edges.columns:
        edges = edges.withColumn("fraud_type", F.lit(""))
    amount = F.coalesce("amount", F.lit(0.0))
    fraud = F.coalesce("is_fraud", F.lit(False))
    wide, peak = _peak(edges, amount, group)
    width = F.when(peak <= 0, F.lit(float(MIN_WIDTH))).otherwise(
        F.round(MIN_WIDTH + amount / peak * (MAX_WIDTH - MIN_WIDTH), 1)
    )
    drawn = wide.select(
        *group,
        F.coalesce("txn_id", F.concat_ws("__", "src", "dst")).alias("id"),
        F.col("src").alias("source"), F.col("dst").alias("target"),
        amount.alias("amount"), "txn_type", F.col("ts").alias("timestamp"), fraud.alias("is_fraud"),
        F.coalesce("fraud_type", F.lit("")).alias("fraud_type"),
        F.when(fraud, FRAUD_COLOUR).otherwise(NORMAL_COLOUR).alias("color"),
        width.alias("width"),
    )
    ends = nodes.select(*group, "id")
    valid = drawn.join(ends.withColumnRenamed("id", "source"), [*group, "source"], "left_semi").join(
        ends.withColumnRenamed("id", "target"), [*group, "target"], "left_semi"
    )
    return _first(valid, [*group, "id"])


def export_summary(raw_edges: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Drawn nodes and edges, and how many edges were dropped."""
    return raw_edges.agg(F.count("*").alias("raw")).select(
        nodes.agg(F.count("*")).scalar().alias("nodes"),
        edges.agg(F.count("*")).scalar().alias("edges"),
        (F.col("raw") - edges.agg(F.count("*")).scalar()).alias("dropped_edges"),
    )


def as_json(df: DataFrame) -> DataFrame:
    """One ``{"data": {...}}`` document per row."""
    return df.select(F.to_json(F.struct(F.struct(*df.columns).alias("data"))).alias("value"))


def path_rows(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of traced paths as rows for ``export_nodes`` and ``export_edges``."""
    keys = ["source", "dest"]
    nodes = paths.select(*[F.col(k).alias(f"path_{k}") for k in keys], F.explode("nodes").alias("n")).select(
        "path_source", "path_dest", "n.*"
    )
    edges = paths.select(*[F.col(k).alias(f"path_{k}") for k in keys], F.explode("edges").alias("e")).select(
        "path_source", "path_dest", F.col("e.txn_id"), F.col("e.source").alias("src"), F.col("e.target").alias("dst"),
        F.col("e.amount"), F.col("e.txn_type"), F.col("e.timestamp").alias("ts"), F.col("e.is_fraud"),
    )
    return nodes, edges

"""Behavioural and structural account features, the standardised matrix and the fraud labels."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.functions.columns import within_days
from moneytrail.scratch import materialize, sorted_join

BEHAVIOUR = [
    "account_age_days", "total_sent_30d", "total_received_30d", "txn_count_30d", "unique_counterparties_30d",
    "avg_txn_amount", "max_single_txn", "velocity_7d", "is_dormant_activated", "std_txn_amount",
    "night_txn_ratio", "days_since_last_txn", "sent_received_ratio",
]
STRUCTURE = [
    "in_degree", "out_degree", "betweenness_centrality", "clustering_coefficient", "pagerank_score",
    "is_in_cycle", "max_cycle_length", "hop_count_to_flagged",
]
FEATURES = BEHAVIOUR + STRUCTURE


def moves(transfers: DataFrame) -> DataFrame:
    """Each transfer seen from both ends: ``(account_id, sent, counterparty, ...)``."""
    def end(account, other, sent):
        return F.struct(
            F.col(account).alias("account_id"), F.col(other).alias("counterparty"), F.lit(sent).alias("sent")
        )

    rest = [c for c in transfers.columns if c not in ("src", "dst")]
    return transfers.select(
        F.explode(F.array(end("src", "dst", True), end("dst", "src", False))).alias("m"), *rest
    ).select("m.*", *rest)


#: Relative standard deviation of approximate distinct counts.
SKETCH_ERROR = 0.02


def account_features(transfers: DataFrame, accounts: DataFrame, as_of: Column, only: str | None = None,
                     activated: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """Thirteen behavioural features per account, zero for accounts without transfers.

    Transfers that agree in account, direction, amount, time and counterparty count once. Sums are taken per
    counterparty before they are taken per account. ``activated`` (rows with ``account_id``) replaces the account
    type as the sign of a dormant activation. With ``approximate``, counterparties are counted by sketches, within a few times
    SKETCH_ERROR, and sums are taken per account at once.
    """
    past = transfers.where(F.col("ts") <= as_of).select("src", "dst", "ts", "amount")
    seen = moves(past)
    if only is not None:
        accounts = accounts.where(F.col("account_id") == only)
        seen = seen.where(F.col("account_id") == only)
    seen = seen.distinct()

    ts, amount, sent = F.col("ts"), F.col("amount"), F.col("sent")
    month, week = within_days(ts, as_of, 30), within_days(ts, as_of, 7)
    fortnight = within_days(ts, as_of, 14)
    night = (F.hour(ts) >= 23) | (F.hour(ts) < 5)
    sums = [
        F.sum(F.when(month & sent, amount)).alias("sent_30d"),
        F.sum(F.when(month & ~sent, amount)).alias("received_30d"),
        F.count_if(month).alias("n_30d"),
        F.count("*").alias("n"),
        F.sum("amount").alias("total"),
        F.sum(amount * amount).alias("squares"),
        F.max("amount").alias("largest"),
        F.count_if(week & sent).alias("n_7d"),
        F.count_if(fortnight & ~week & sent).alias("n_prev_7d"),
        F.count_if(night).alias("n_night"),
        F.max("ts").alias("last_ts"),
    ]
    if approximate:
        counted = F.approx_count_distinct(F.when(month, F.col("counterparty")), SKETCH_ERROR).alias("counterparties")
        return described(seen.groupBy("account_id").agg(*sums, counted), accounts, as_of, activated)
    partial = seen.groupBy("account_id", "counterparty").agg(*sums)
    whole = partial.groupBy("account_id").agg(
        *[F.sum(c).alias(c) for c in (
            "sent_30d", "received_30d", "n_30d", "n", "total", "squares", "n_7d", "n_prev_7d", "n_night"
        )],
        F.count_if(F.col("n_30d") > 0).alias("counterparties"),
        F.max("largest").alias("largest"),
        F.max("last_ts").alias("last_ts"),
    )
    return described(whole, accounts, as_of, activated)


def described(whole: DataFrame, accounts: DataFrame, as_of: Column, activated: DataFrame | None = None) -> DataFrame:
    """The thirteen features from the sums of each account with transfers."""
    joined = accounts.join(whole, "account_id", "left")
    if activated is not None:
        joined = joined.join(
            activated.select("account_id", F.lit(1).alias("woke")).distinct(), "account_id", "left"
        )
        dormant = F.coalesce("woke", F.lit(0))
    else:
        dormant = (F.col("account_type") == "DORMANT").cast("int")

    zero = F.lit(0.0)
    n = F.col("n")
    mean = F.coalesce(F.try_divide("total", n), zero)
    mean_square = F.coalesce(F.try_divide("squares", n), zero)
    sent_30d, received_30d = F.coalesce("sent_30d", zero), F.coalesce("received_30d", zero)
    return joined.select(
        "account_id", "account_type", "is_flagged", "account_age_days",
        sent_30d.alias("total_sent_30d"),
        received_30d.alias("total_received_30d"),
        F.coalesce("n_30d", F.lit(0)).alias("txn_count_30d"),
        F.coalesce("counterparties", F.lit(0)).alias("unique_counterparties_30d"),
        mean.alias("avg_txn_amount"),
        F.coalesce("largest", zero).alias("max_single_txn"),
        (F.coalesce("n_7d", F.lit(0)) / (F.coalesce("n_prev_7d", F.lit(0)) + 1)).alias("velocity_7d"),
        dormant.alias("is_dormant_activated"),
        F.sqrt(F.greatest(zero, mean_square - mean * mean)).alias("std_txn_amount"),
        F.coalesce(F.try_divide("n_night", n), zero).alias("night_txn_ratio"),
        F.datediff(as_of.cast("date"), F.col("last_ts").cast("date")).alias("days_since_last_txn"),
        (sent_30d / (received_30d + 1)).alias("sent_received_ratio"),
    )


def degrees(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Distinct senders and receivers per account; ``degree`` counts a two-way neighbour twice."""
    pairs = transfers.select("src", "dst").distinct()
    zero = F.lit(0)
    return (
        accounts.select("account_id")
        .join(pairs.groupBy(F.col("dst").alias("account_id")).agg(F.count("*").alias("n_in")), "account_id", "left")
        .join(pairs.groupBy(F.col("src").alias("account_id")).agg(F.count("*").alias("n_out")), "account_id", "left")
        .select(
            "account_id",
            F.coalesce("n_in", zero).alias("in_degree"),
            F.coalesce("n_out", zero).alias("out_degree"),
            (F.coalesce("n_in", zero) + F.coalesce("n_out", zero)).alias("degree"),
        )
    )


def degree_share_rank(degree: DataFrame, damping: float = 0.85) -> DataFrame:
    """Importance as a damped share of all degrees, 1/n if there are no edges."""
    totals = degree.agg(F.count("*").alias("n"), F.sum("degree").alias("total"))
    n, total = totals.select("n").scalar(), totals.select("total").scalar()
    return degree.select(
        "account_id",
        F.when(total > 0, (1 - damping) / n + damping * F.col("degree") / total).otherwise(F.lit(1.0) / n).alias("degree_share_rank"),
    )


def standardise(features: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become 0, then every column gets mean 0 and population deviation 1; constant columns become 0."""
    filled = features.select("account_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    moments = filled.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("dev")).alias(c) for c in columns])
    scale = moments.select(F.struct(*columns).alias("scale")).scalar()

    def z(c):
        mean, dev = F.col(f"scale.{c}.mean"), F.col(f"scale.{c}.dev")
        # deviations within rounding of the mean mark a constant column
        constant = dev <= F.lit(1e-14) * F.greatest(F.abs(mean), F.lit(1.0))
        return F.when(constant, F.lit(0.0)).otherwise((F.col(c) - mean) / dev).alias(c)

    return filled.withColumn("scale", scale).select("account_id", *[z(c) for c in columns])


def feature_matrix(behaviour: DataFrame, structure: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The standardised features of every account. Writes the raw features as a scratch table first.

    An account that was never active counts as idle for all its age, one that no path leads to as one hop beyond the
    farthest: 0 would make either look like the riskiest.
    """
    columns = columns or FEATURES
    raw = materialize(behaviour.join(sorted_join(structure), "account_id", "left").select("account_id", *columns), "features")
    return standardise(fill_gaps(raw), columns)


def fill_gaps(raw: DataFrame) -> DataFrame:
    gaps = {}
    if "days_since_last_txn" in raw.columns and "account_age_days" in raw.columns:
        gaps["days_since_last_txn"] = F.coalesce("days_since_last_txn", "account_age_days")
    if "hop_count_to_flagged" in raw.columns:
        gaps["hop_count_to_flagged"] = F.coalesce("hop_count_to_flagged", raw.agg(F.max("hop_count_to_flagged") + 1).scalar())
    return raw.withColumns(gaps) if gaps else raw


def fraud_labels(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """An account is fraudulent if it took part in any transfer marked as fraud."""
    touched = moves(transfers.where("is_fraud").select("src", "dst")).select("account_id", F.lit(True).alias("touched")).distinct()
    return accounts.select("account_id").join(touched, "account_id", "left").select(
        "account_id", F.coalesce("touched", F.lit(False)).alias("is_fraud")
    )

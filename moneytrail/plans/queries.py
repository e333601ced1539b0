"""The registered queries: each takes (spark, sf_dir) and runs one operator over the whole tables.

Results hold scalar columns only, so that they can be compared with SQL row by row.
"""

from collections.abc import Callable
from datetime import date, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.functions.columns import text_of
from moneytrail.operators import alerts as alert_ops
from moneytrail.operators import (
    anomaly, centrality, daily, explain, export, features, neighbours, nodeclf, patterns, projections, quality, report, risk, traverse,
)
from moneytrail.operators.cycles import circular, trails
from moneytrail.scratch import materialize, scratch_path, sorted_join
from moneytrail.sources import buckets, edges, star, tables
from moneytrail.streaming import history, inbox, sink
from moneytrail.streaming import rules as rules_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

AS_OF = star.as_of_lit
SECONDS = "yyyy-MM-dd HH:mm:ss"

# The look-back windows are widened where the defaults find nothing in the test tables.
PARAMS = {
    "CIRCULAR_ROUND_TRIP": {"max_hop": 5, "hours": 72},
    "LAYERING": {"min_amount": 300_000, "hours": 72},
    "STRUCTURING": {"threshold": 49_999, "hours": 240, "min_count": 5},
    "DORMANT_ACTIVATION": {"dormant_days": 60},
    "PROFILE_MISMATCH": {"min_amount": 500_000},
}


def query(function):
    QUERIES[function.__name__] = function
    return function


def whole(array: str):
    """Array of whole-number doubles as text."""
    return text_of(F.transform(array, lambda x: x.cast("bigint").cast("string")))


def seconds(column: str):
    return F.date_format(column, SECONDS).alias(column)


def unknown(account: str):
    """An id that no account has, made from the id of one."""
    return F.concat(F.lit("X"), F.substring(account, 2, 20))


# --- sources and quality --------------------------------------------------------------------------


@query
def transfers_build(spark, sf_dir):
    built = edges.build_transfers(star.transactions(spark, sf_dir), star.accounts(spark, sf_dir))
    return built.withColumn("ts", seconds("ts"))


@query
def transaction_nodes(spark, sf_dir):
    nodes = edges.build_transactions(star.transactions(spark, sf_dir))
    return nodes.withColumn("timestamp", seconds("timestamp")).withColumnRenamed("timestamp", "ts")


@query
def sent_received_edges(spark, sf_dir):
    txns, accounts = star.transactions(spark, sf_dir), star.accounts(spark, sf_dir)
    sent = edges.build_sent(txns, accounts).withColumn("relation", F.lit("SENT"))
    received = edges.build_received(txns, accounts).withColumn("relation", F.lit("RECEIVED_BY"))
    return sent.unionByName(received).withColumn("ts", seconds("ts"))


@query
def build_counters(spark, sf_dir):
    return edges.build_counts(star.transactions(spark, sf_dir), star.accounts(spark, sf_dir))


UPSERTED = ["account_id", "account_type", "customer_name", "is_flagged"]


def account_batch(spark, sf_dir):
    return star.table(spark, sf_dir, "orders", star.ORDERS).select(
        F.expr("concat('ACC', lpad(cast(o_custkey + 1000 as string), 10, '0'))").alias("account_id"),
        F.lit("CURRENT").alias("account_type"),
        F.col("o_orderstatus").alias("customer_name"),
        F.lit(False).alias("is_flagged"),
        "o_orderkey",
    )


@query
def accounts_upsert(spark, sf_dir):
    return edges.upsert_accounts(star.accounts(spark, sf_dir).select(UPSERTED), account_batch(spark, sf_dir), "o_orderkey")


@query
def accounts_upsert_buckets(spark, sf_dir):
    """The same on a table in buckets, of which the batch rewrites its own."""
    path = scratch_path(spark, "account-buckets")
    buckets.create(star.accounts(spark, sf_dir).select(UPSERTED), path, 16)
    buckets.upsert(path, account_batch(spark, sf_dir), "o_orderkey")
    return buckets.read(spark, path)


@query
def risk_writeback(spark, sf_dir):
    updates = star.transfers(spark, sf_dir).groupBy(F.col("dst").alias("account_id")).agg(
        (F.least(F.count("*"), F.lit(100)) / 100).alias("risk_score"), (F.max("amount") >= 500_000).alias("is_flagged")
    )
    written = edges.write_back_risk(star.accounts(spark, sf_dir), updates)
    return written.select("account_id", "risk_score", "is_flagged")


@query
def csv_round_trip(spark, sf_dir):
    """Transactions written as CSV over an earlier table, and read again."""
    folder = scratch_path(spark, "csv-tables")
    txns, accounts = star.transactions(spark, sf_dir), star.accounts(spark, sf_dir)
    for part in (txns.where("is_fraud"), txns):
        tables.write_dataset(part, accounts, folder)
    read, _ = tables.read_dataset(spark, folder)
    return read.withColumn("timestamp", seconds("timestamp")).withColumnRenamed("timestamp", "ts").drop("description", "fraud_type")


@query
def accounts_appended(spark, sf_dir):
    """Flagged accounts stored first, the others appended."""
    path = scratch_path(spark, "accounts")
    accounts = star.accounts(spark, sf_dir).withColumn("account_age_days", F.col("account_age_days").cast("bigint"))
    tables.write_table(accounts.where("is_flagged"), path)
    tables.append_accounts(accounts.where("not is_flagged"), spark.read.parquet(path), path)
    return spark.read.parquet(path)


@query
def transfers_by_day(spark, sf_dir):
    """Transfers stored by day; those of the last week before the evaluation time are read."""
    path = scratch_path(spark, "transfers-by-day")
    tables.write_table(star.transfers(spark, sf_dir), path, by_day="ts")
    stored = spark.read.parquet(path)
    return stored.where((F.col("day") > F.date_sub(AS_OF().cast("date"), 7)) & (F.col("day") <= AS_OF().cast("date"))).select(
        "txn_id", "src", "dst", "amount", "txn_type", "is_fraud", F.date_format("day", "yyyy-MM-dd").alias("day")
    )


@query
def features_reused(spark, sf_dir):
    """Features stored half an hour before they are asked for."""
    path = scratch_path(spark, "stored-features")
    chosen = behaviour(spark, sf_dir).select("account_id", "total_sent_30d", "txn_count_30d", "max_single_txn")
    tables.save_features(chosen, path, "2024-01-30 23:30:00")
    return tables.load_features(spark, path, star.AS_OF)


@query
def quality_violations(spark, sf_dir):
    txns, accounts = star.transactions(spark, sf_dir), star.accounts(spark, sf_dir)
    return (
        quality.transaction_violations(txns)
        .unionByName(quality.limit_violations(txns, accounts))
        .unionByName(quality.account_violations(accounts))
    )


@query
def orphan_transfers(spark, sf_dir):
    """Over transactions whose receivers at cash machines are unknown."""
    txns = star.transactions(spark, sf_dir).withColumn(
        "receiver_account", F.when(F.col("channel") == "ATM", unknown("receiver_account")).otherwise(F.col("receiver_account"))
    )
    return quality.orphan_transfers(txns, star.accounts(spark, sf_dir))


@query
def duplicate_keys(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("key"))
    return quality.duplicate_keys(lines, "key")


@query
def dataset_profile(spark, sf_dir):
    return quality.dataset_profile(star.transactions(spark, sf_dir), star.accounts(spark, sf_dir))


@query
def txn_defaults(spark, sf_dir):
    """Every transaction, with gaps made from its values, after the gaps are filled."""
    gaps = star.transactions(spark, sf_dir).withColumns({
        "txn_id": F.when(F.col("amount") >= 100_000, F.col("txn_id")),
        "status": F.when(F.col("channel") == "ATM", F.lit("FAILED")),
        "is_fraud": F.when(F.col("txn_type") == "UPI", F.col("is_fraud")),
    })
    filled = quality.fill_defaults(gaps)
    return filled.groupBy("status", "is_fraud", F.length("txn_id").cast("bigint").alias("id_length")).agg(
        F.count("*").alias("transactions"), F.count_distinct("txn_id").alias("ids")
    )


@query
def numeric_cleaning(spark, sf_dir):
    """Texts that are no numbers and values that are not finite count as 0."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", F.concat(F.col("l_quantity").cast("string"), F.when(F.col("l_returnflag") == "N", "x").otherwise("")).alias("quantity"),
        F.when(F.col("l_tax") == 0, F.lit(float("nan"))).when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity")).alias("ratio"),
    )
    clean = quality.finite_or_zero(quality.coerce_numeric(lines, ["quantity"]), ["ratio"])
    return clean.groupBy("l_orderkey").agg(F.sum("quantity").alias("quantity"), F.sum("ratio").alias("ratio"))


@query
def alert_quality(spark, sf_dir):
    """Scores of 150 per cent and unknown states among alerts made from customers."""
    made = star.accounts(spark, sf_dir).select(
        F.col("account_id").alias("alert_id"), (F.col("account_age_days") / 100).alias("risk_score"),
        F.when(F.col("is_flagged"), "SEVERE").otherwise("LOW").alias("risk_tier"),
        F.when(F.col("kyc_status") == "EXPIRED", "GONE").otherwise("OPEN").alias("status"),
    )
    return quality.alert_violations(made)


# --- patterns -------------------------------------------------------------------------------------


def found_patterns(spark, sf_dir):
    return patterns.all_patterns(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir), AS_OF(), PARAMS)


@query
def circular_round_trips(spark, sf_dir):
    found = circular(star.transfers(spark, sf_dir), AS_OF(), **PARAMS["CIRCULAR_ROUND_TRIP"])
    return found.select(
        "anchor_account", text_of("account_ids").alias("account_ids"), text_of("txn_ids").alias("txn_ids"),
        whole("amounts").alias("amounts"), "total_amount", F.col("cycle_length").cast("bigint").alias("cycle_length"),
    )


@query
def layering(spark, sf_dir):
    return patterns.layering(star.transfers(spark, sf_dir), AS_OF(), **PARAMS["LAYERING"])


@query
def layering_evidence(spark, sf_dir):
    pairs = materialize(patterns.layering_pairs(star.transfers(spark, sf_dir), AS_OF(), **PARAMS["LAYERING"]), "layering-pairs")
    return patterns.layering_evidence(pairs, patterns.layering_of(pairs)).drop("ts")


@query
def layering_top(spark, sf_dir):
    """The report's view: the 1000 largest by amount sent out."""
    found = patterns.layering(star.transfers(spark, sf_dir), AS_OF(), **PARAMS["LAYERING"])
    return patterns.ranked(found, "total_fan_out", ["source_account", "destination_account"], limit=1000)


@query
def structuring(spark, sf_dir):
    return patterns.structuring(star.transfers(spark, sf_dir), AS_OF(), **PARAMS["STRUCTURING"])


@query
def structuring_evidence(spark, sf_dir):
    transfers, rule = star.transfers(spark, sf_dir), PARAMS["STRUCTURING"]
    found = materialize(patterns.structuring(transfers, AS_OF(), **rule), "detections")
    return patterns.structuring_evidence(transfers, found, AS_OF(), rule["threshold"], rule["hours"]).drop("ts")


@query
def structuring_sliding(spark, sf_dir):
    found = patterns.structuring_sliding(star.transfers(spark, sf_dir), AS_OF())
    return found.withColumn("first_reached", seconds("first_reached"))


@query
def dormant(spark, sf_dir):
    found = patterns.dormant_activation(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir), AS_OF())
    return found.withColumns({
        "account_age_days": F.col("account_age_days").cast("bigint"), "forward_ratio": F.round("forward_ratio", 6)
    })


@query
def dormant_evidence(spark, sf_dir):
    transfers = star.transfers(spark, sf_dir)
    found = patterns.dormant_activation(transfers, star.accounts(spark, sf_dir), AS_OF())
    return patterns.dormant_evidence(transfers, found, AS_OF()).drop("ts")


@query
def dormant_strict(spark, sf_dir):
    found = patterns.dormant_strict(
        star.transfers(spark, sf_dir), AS_OF(), quiet_days=1, spike=1.5, forward_share=0.5, forward_days=10
    )
    return found.withColumns({
        "activated_at": seconds("activated_at"), "quiet_since": seconds("quiet_since"),
        "mean_before": F.round("mean_before", 4),
    })


@query
def profile_mismatch(spark, sf_dir):
    return patterns.profile_mismatch(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir), AS_OF())


@query
def profile_evidence(spark, sf_dir):
    transfers = star.transfers(spark, sf_dir)
    found = patterns.profile_mismatch(transfers, star.accounts(spark, sf_dir), AS_OF())
    return patterns.profile_evidence(transfers, found, AS_OF()).drop("ts")


@query
def pattern_counts(spark, sf_dir):
    return patterns.pattern_counts(found_patterns(spark, sf_dir))


@query
def involvement(spark, sf_dir):
    return patterns.involvement(found_patterns(spark, sf_dir)).groupBy("pattern", "account_id").agg(F.count("*").alias("detections"))


@query
def detector_eval(spark, sf_dir):
    txns = star.transactions(spark, sf_dir)
    scored = patterns.detector_evaluation(txns, patterns.transfers_behind(found_patterns(spark, sf_dir)))
    return scored.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "own_recall")})


# --- traversal and export -------------------------------------------------------------------------


def flagged(spark, sf_dir):
    return star.accounts(spark, sf_dir).where("is_flagged").select("account_id")


def around_flagged(spark, sf_dir, **options):
    return traverse.neighbourhood(
        star.transfers(spark, sf_dir), star.accounts(spark, sf_dir), flagged(spark, sf_dir), **options
    )


@query
def subgraph_nodes(spark, sf_dir):
    nodes, _ = around_flagged(spark, sf_dir, depth=2)
    return nodes.withColumn("hop", F.col("hop").cast("bigint"))


@query
def subgraph_edges(spark, sf_dir):
    _, edges = around_flagged(spark, sf_dir, depth=1)
    return edges.drop("ts")


@query
def subgraph_edges_reached(spark, sf_dir):
    _, edges = around_flagged(spark, sf_dir, depth=1, edges="reached")
    return edges.drop("ts")


def way_back(spark, sf_dir):
    """Can money sent by a flagged account return to it: (receiver, flagged sender) pairs."""
    sent = star.transfers(spark, sf_dir).join(flagged(spark, sf_dir).withColumnRenamed("account_id", "src"), "src", "left_semi")
    return sent.select(F.col("dst").alias("source"), F.col("src").alias("dest")).distinct()


def traced(spark, sf_dir):
    return traverse.fund_paths(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir), way_back(spark, sf_dir))


@query
def fund_paths(spark, sf_dir):
    return traced(spark, sf_dir).select(
        "source", "dest", F.col("path_length").cast("bigint").alias("path_length"), "total_amount",
        text_of("nodes.id").alias("nodes"), text_of("edges.txn_id").alias("txn_ids"),
        text_of("intermediate_accounts").alias("intermediate_accounts"),
    )


@query
def fund_path_export(spark, sf_dir):
    nodes, edges = export.path_rows(traced(spark, sf_dir))
    group = ["path_source", "path_dest"]
    drawn = export.export_edges(edges, export.export_nodes(nodes, group), group)
    return drawn.select(*group, "id", "source", "target", "amount", "color", F.round("width", 1).alias("width"))


def found_members(spark, sf_dir):
    return patterns.involvement(found_patterns(spark, sf_dir)).withColumn(
        "detection_id", F.concat_ws(":", "pattern", "detection_id")
    )


@query
def pattern_subgraph_nodes(spark, sf_dir):
    nodes, _ = traverse.pattern_subgraph(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir), found_members(spark, sf_dir))
    return nodes


@query
def pattern_subgraph_edges(spark, sf_dir):
    _, edges = traverse.pattern_subgraph(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir), found_members(spark, sf_dir))
    return edges.drop("ts")


@query
def edge_list(spark, sf_dir):
    return traverse.directed_pairs(star.transfers(spark, sf_dir))


def raw_nodes(spark, sf_dir):
    volume = features.moves(star.transfers(spark, sf_dir)).groupBy("account_id").agg(
        F.sum(F.when(F.col("sent"), F.col("amount"))).alias("total_sent"),
        F.sum(F.when(~F.col("sent"), F.col("amount"))).alias("total_received"),
        F.count_if(F.col("is_fraud")).alias("marked"),
    )
    known = star.accounts(spark, sf_dir).drop("risk_score")
    return known.join(volume, "account_id", "left").withColumn(
        "risk_score", F.least(F.coalesce("marked", F.lit(0)), F.lit(4)) / 4
    ).withColumnRenamed("account_id", "id")


def raw_edges(spark, sf_dir):
    """Transfers of which those by RTGS go to accounts that are not known."""
    return star.transfers(spark, sf_dir).withColumn("dst", F.when(F.col("txn_type") == "RTGS", unknown("dst")).otherwise(F.col("dst")))


@query
def graph_export_nodes(spark, sf_dir):
    drawn = export.export_nodes(raw_nodes(spark, sf_dir))
    return drawn.withColumn("size", F.col("size").cast("bigint"))


@query
def graph_export_edges(spark, sf_dir):
    nodes = export.export_nodes(raw_nodes(spark, sf_dir))
    raw = raw_edges(spark, sf_dir)
    return export.export_edges(raw.unionByName(raw), nodes).drop("timestamp")


@query
def graph_export_summary(spark, sf_dir):
    nodes = export.export_nodes(raw_nodes(spark, sf_dir))
    raw = raw_edges(spark, sf_dir)
    return export.export_summary(raw, nodes, export.export_edges(raw, nodes))


# --- features -------------------------------------------------------------------------------------


def behaviour(spark, sf_dir):
    return features.account_features(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir), AS_OF())


def closed_trails(spark, sf_dir):
    return trails(star.transfers(spark, sf_dir), AS_OF(), **PARAMS["CIRCULAR_ROUND_TRIP"])


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


@query
def account_features(spark, sf_dir):
    return rounded(
        behaviour(spark, sf_dir), 4, "avg_txn_amount", "std_txn_amount", "velocity_7d", "night_txn_ratio", "sent_received_ratio"
    ).withColumns({
        c: F.col(c).cast("bigint") for c in ("account_age_days", "is_dormant_activated", "days_since_last_txn")
    })


@query
def features_incremental(spark, sf_dir):
    """Features from daily aggregates: first without two days and a part of a third, then refreshed for these alone."""
    transfers, path = star.transfers(spark, sf_dir), scratch_path(spark, "daily")
    late = (F.to_date("ts").isin(date(2024, 1, 10), date(2024, 1, 29))) | (F.col("ts") >= F.lit("2024-01-30 06:00:00").cast("timestamp_ntz"))
    early = transfers.where(~late)
    daily.refresh(early, path, daily.changed_days(early))
    daily.refresh(transfers, path, daily.changed_days(transfers.where(late)))
    found = daily.account_features(path, transfers, star.accounts(spark, sf_dir), datetime.fromisoformat(star.AS_OF))
    return rounded(
        found, 4, "avg_txn_amount", "std_txn_amount", "velocity_7d", "night_txn_ratio", "sent_received_ratio"
    ).withColumns({c: F.col(c).cast("bigint") for c in ("account_age_days", "is_dormant_activated", "days_since_last_txn")})


@query
def features_refreshed(spark, sf_dir):
    """Features of the evening before, brought up to date for the accounts that something happened to."""
    transfers, accounts = star.transfers(spark, sf_dir), star.accounts(spark, sf_dir)
    before, as_of = datetime(2024, 1, 30, 18), datetime.fromisoformat(star.AS_OF)
    stored = materialize(features.account_features(transfers, accounts, F.lit(before).cast("timestamp_ntz")), "stored-features")
    found, _ = daily.refreshed(stored, transfers, accounts, before, as_of)
    return rounded(
        found, 4, "avg_txn_amount", "std_txn_amount", "velocity_7d", "night_txn_ratio", "sent_received_ratio"
    ).withColumns({c: F.col(c).cast("bigint") for c in ("account_age_days", "is_dormant_activated", "days_since_last_txn")})


@query
def counterparty_sketches(spark, sf_dir):
    """Counterparties of the month: the exact count, and whether both sketched counts are within a twentieth, or one, of it."""
    transfers, accounts, path = star.transfers(spark, sf_dir), star.accounts(spark, sf_dir), scratch_path(spark, "daily")
    daily.refresh(transfers, path, daily.changed_days(transfers))
    name, exact = "unique_counterparties_30d", behaviour(spark, sf_dir)
    merged = daily.account_features(path, transfers, accounts, datetime.fromisoformat(star.AS_OF), sketch=True)
    at_once = features.account_features(transfers, accounts, AS_OF(), approximate=True)
    rows = exact.select("account_id", name).join(merged.select("account_id", F.col(name).alias("merged")), "account_id").join(
        at_once.select("account_id", F.col(name).alias("at_once")), "account_id"
    )
    bound = F.greatest(F.lit(1), F.col(name) / 20)
    return rows.select("account_id", name, *[(F.abs(F.col(c) - F.col(name)) <= bound).alias(f"{c}_near") for c in ("merged", "at_once")])


@query
def activated_features(spark, sf_dir):
    """Features with the strict detector as the sign of a dormant activation."""
    woke = patterns.dormant_strict(
        star.transfers(spark, sf_dir), AS_OF(), quiet_days=1, spike=1.5, forward_share=0.5, forward_days=10
    )
    found = features.account_features(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir), AS_OF(), activated=woke)
    return found.select("account_id", F.col("is_dormant_activated").cast("bigint").alias("is_dormant_activated"), "txn_count_30d")


@query
def graph_features(spark, sf_dir):
    degree = features.degrees(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir))
    return rounded(degree.join(features.degree_share_rank(degree), "account_id"), 9, "degree_share_rank")


@query
def pagerank(spark, sf_dir):
    return rounded(centrality.page_rank(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir)), 9, "pagerank_score")


@query
def betweenness(spark, sf_dir):
    """From all start accounts, so exact."""
    exact = centrality.betweenness(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir), samples=None)
    return rounded(exact, 9, "betweenness_centrality")


def chosen_starts(spark, sf_dir):
    """The accounts with the smallest MD5 hashes, as many as betweenness is sampled from."""
    ids = star.accounts(spark, sf_dir).select("account_id")
    return materialize(ids.orderBy(F.md5("account_id"), "account_id").limit(centrality.SAMPLES), "starts")


@query
def betweenness_sampled(spark, sf_dir):
    transfers, accounts = star.transfers(spark, sf_dir), star.accounts(spark, sf_dir)
    return rounded(centrality.betweenness(transfers, accounts, starts=chosen_starts(spark, sf_dir)), 9, "betweenness_centrality")


@query
def clustering(spark, sf_dir):
    return rounded(centrality.clustering(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir)), 6, "clustering_coefficient")


@query
def cycle_features(spark, sf_dir):
    member = centrality.cycle_membership(closed_trails(spark, sf_dir), star.accounts(spark, sf_dir))
    return member.withColumns({c: F.col(c).cast("bigint") for c in ("is_in_cycle", "max_cycle_length")})


@query
def hops_to_flagged(spark, sf_dir):
    hops = centrality.hops_to_flagged(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir))
    return hops.withColumn("hop_count_to_flagged", F.col("hop_count_to_flagged").cast("bigint"))


def full_matrix(spark, sf_dir):
    """All 21 features of every account, standardised; betweenness is exact."""
    transfers, accounts = star.transfers(spark, sf_dir), star.accounts(spark, sf_dir)
    structure = centrality.structural_features(
        transfers, accounts, features.degrees(transfers, accounts), closed_trails(spark, sf_dir), samples=None
    )
    return features.feature_matrix(behaviour(spark, sf_dir), structure)


@query
def feature_matrix(spark, sf_dir):
    return rounded(full_matrix(spark, sf_dir), 6, *features.FEATURES)


@query
def labels(spark, sf_dir):
    return features.fraud_labels(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir))


# --- node scores ----------------------------------------------------------------------------------

SIMPLE = ["total_sent_30d", "txn_count_30d", "account_age_days"]


@query
def model_edges(spark, sf_dir):
    neighbours = nodeclf.Neighbours(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir))
    return neighbours.edges.groupBy("source", "target").agg(F.count("*").alias("copies"))


@query
def neighbour_means(spark, sf_dir):
    transfers, accounts = star.transfers(spark, sf_dir), star.accounts(spark, sf_dir)
    matrix = materialize(features.fill_gaps(behaviour(spark, sf_dir)).select("account_id", *features.BEHAVIOUR), "matrix")
    wide = nodeclf.neighbour_means(matrix, nodeclf.Neighbours(transfers, accounts), features.BEHAVIOUR)
    return rounded(wide, 3, *[c for c in wide.columns if c != "account_id"])


@query
def class_weights(spark, sf_dir):
    normal, fraud = nodeclf.class_weights(labels(spark, sf_dir))
    return labels(spark, sf_dir).groupBy("is_fraud").agg(F.count("*").alias("accounts")).withColumn(
        "weight", F.round(F.when(F.col("is_fraud"), fraud).otherwise(normal), 6)
    )


@query
def split(spark, sf_dir):
    return nodeclf.stratified_split(labels(spark, sf_dir)).groupBy("is_fraud", "is_validation").agg(F.count("*").alias("accounts"))


@query
def node_scores(spark, sf_dir):
    matrix = materialize(full_matrix(spark, sf_dir), "matrix")
    neighbours = nodeclf.Neighbours(star.transfers(spark, sf_dir), star.accounts(spark, sf_dir))
    wide = materialize(nodeclf.neighbour_means(matrix, neighbours, features.FEATURES), "wide-matrix")
    return nodeclf.score(nodeclf.train(wide, labels(spark, sf_dir), features.FEATURES), wide)


@query
def sage_scores(spark, sf_dir):
    """Inference of a fixed small network (weights from a formula), aggregated over its embedding."""
    transfers, accounts = star.transfers(spark, sf_dir), star.accounts(spark, sf_dir)
    simple = behaviour(spark, sf_dir).select(
        "account_id", (F.col("txn_count_30d") / 100).alias("a"), (F.col("velocity_7d") / 10).alias("b")
    )
    scored = nodeclf.sage_inference(simple, nodeclf.Neighbours(transfers, accounts), formula_weights(2, (4, 3, 2)), ["a", "b"])
    return scored.select(
        "account_id", F.round("gnn_fraud_prob", 9).alias("gnn_fraud_prob"),
        *[F.round(F.col("embedding")[i], 9).alias(f"e{i}") for i in range(2)],
    )


def formula_weights(width, sizes):
    """Network weights from a rule, in the names of a stored checkpoint."""
    def table(rows, columns, shift):
        return np.array([[((3 * i + 5 * j + shift) % 7 - 3) / 4 for j in range(columns)] for i in range(rows)])
    weights, before = {}, width
    for n, size in enumerate(sizes, 1):
        weights[f"conv{n}.lin_l.weight"] = table(size, before, n)
        weights[f"conv{n}.lin_l.bias"] = table(1, size, n + 1)[0]
        weights[f"conv{n}.lin_r.weight"] = table(size, before, n + 2)
        if n < len(sizes):
            weights[f"bn{n}.weight"], weights[f"bn{n}.bias"] = np.ones(size), np.zeros(size)
            weights[f"bn{n}.running_mean"], weights[f"bn{n}.running_var"] = np.zeros(size), np.ones(size) - nodeclf.NORM_EPSILON
        before = size
    weights["classifier.weight"], weights["classifier.bias"] = table(2, before, 4), np.array([0.25, -0.5])
    return weights


@query
def embedding_projection(spark, sf_dir):
    transfers, accounts = star.transfers(spark, sf_dir), star.accounts(spark, sf_dir)
    matrix = features.standardise(behaviour(spark, sf_dir), SIMPLE + ["avg_txn_amount"])
    scored = nodeclf.sage_inference(
        matrix, nodeclf.Neighbours(transfers, accounts), formula_weights(4, (8, 6, 4)), SIMPLE + ["avg_txn_amount"]
    )
    spread = scored.select("account_id", *[F.col("embedding")[i].alias(f"e{i}") for i in range(4)])
    return nodeclf.project_2d(spread, [f"e{i}" for i in range(4)])


def proxy_scores(spark, sf_dir):
    """Stand-ins for model scores that SQL can compute: fraud and activity shares in round steps."""
    moves = features.moves(star.transfers(spark, sf_dir)).groupBy("account_id").agg(
        F.count_if(F.col("is_fraud")).alias("marked"), F.count("*").alias("n")
    )
    return star.accounts(spark, sf_dir).select("account_id").join(moves, "account_id", "left").select(
        "account_id",
        (F.least(F.coalesce("marked", F.lit(0)), F.lit(4)) / 4).alias("gnn_fraud_prob"),
        (F.least(F.coalesce("n", F.lit(0)), F.lit(100)) / 100).alias("ensemble_anomaly_score"),
    )


@query
def node_metrics(spark, sf_dir):
    scores = proxy_scores(spark, sf_dir).withColumnRenamed("ensemble_anomaly_score", "p")
    return rounded(nodeclf.metrics(scores, labels(spark, sf_dir), column="p"), 6, "value")


# --- anomalies and explanations -------------------------------------------------------------------

#: Steps in which a feature becomes a whole number, so that equal distances are equal in SQL too; 1 where not listed.
STEPS = {
    **dict.fromkeys(("total_sent_30d", "total_received_30d", "avg_txn_amount", "max_single_txn", "std_txn_amount"), 100),
    "velocity_7d": 0.01, "night_txn_ratio": 0.01,
}


@query
def iforest(spark, sf_dir):
    matrix = materialize(full_matrix(spark, sf_dir), "matrix")
    forest = anomaly.fit_forest(matrix, features.FEATURES)
    return anomaly.score_forest(matrix, forest, features.FEATURES, min(anomaly.SAMPLE, matrix.count()))


def behaviour_steps(spark, sf_dir):
    """All features of behaviour in whole steps."""
    filled = features.fill_gaps(behaviour(spark, sf_dir))
    return materialize(filled.select("account_id", *[
        F.round(F.col(c).cast("double") / STEPS.get(c, 1)).alias(c) for c in features.BEHAVIOUR
    ]), "matrix")


@query
def lof(spark, sf_dir):
    return rounded(anomaly.lof(behaviour_steps(spark, sf_dir), features.BEHAVIOUR), 6, "lof_score")


@query
def neighbour_recall(spark, sf_dir):
    """How many nearest neighbours there are, and whether projection tables find nine of ten or more of them."""
    sites = materialize(neighbours.sites(behaviour_steps(spark, sf_dir), features.BEHAVIOUR), "sites")
    exact = neighbours.nearest(sites, anomaly.NEIGHBOURS)
    found = projections.recall(projections.nearest_approximate(sites, anomaly.NEIGHBOURS), exact)
    return found.select("wanted", (F.col("recall") >= 0.9).alias("enough"))


@query
def anomaly_ensemble(spark, sf_dir):
    """The ensemble over stand-in scores; ``anomaly_scores`` runs it over the real models."""
    raw = behaviour(spark, sf_dir).select(
        "account_id", (-F.col("txn_count_30d")).cast("double").alias("iso_score"),
        (-F.col("account_age_days")).cast("double").alias("lof_score"),
    )
    return rounded(anomaly.ensemble(raw), 9, "ensemble_anomaly_score")


@query
def anomaly_scores(spark, sf_dir):
    matrix = materialize(full_matrix(spark, sf_dir), "matrix")
    return anomaly.detect(matrix, features.FEATURES)[0]


WEIGHTS = {
    "total_sent_30d": {"total_sent_30d": 0.000002}, "txn_count_30d": {"txn_count_30d": -0.03},
    "account_age_days": {"account_age_days": 0.0005}, "velocity_7d": {"velocity_7d": 1.5},
    "unique_counterparties_30d": {"unique_counterparties_30d": 0.07}, "days_since_last_txn": {"days_since_last_txn": -0.2},
}


@query
def top_contributions(spark, sf_dir):
    filled = behaviour(spark, sf_dir).fillna(0)
    explained = explain.explain_linear(filled, WEIGHTS)
    return explained.select("account_id", F.explode("explanation").alias("x")).select(
        "account_id", F.col("x.rank").cast("bigint").alias("rank"), "x.feature", "x.shap_value", "x.direction"
    )


@query
def anomaly_explanations(spark, sf_dir):
    matrix = materialize(full_matrix(spark, sf_dir), "matrix")
    scored, forest = anomaly.detect(matrix, features.FEATURES)
    explained = explain.explain_forest(matrix, forest, features.FEATURES, min(anomaly.SAMPLE, matrix.count()))
    text = explain.anomaly_text(F.col("account_id"), F.col("ensemble_anomaly_score"), F.col("explanation"))
    return explained.join(sorted_join(scored), "account_id").select(
        "account_id", text.alias("text"), F.explode("explanation").alias("x")
    ).select("account_id", "text", "x.*")


@query
def forest_contributions(spark, sf_dir):
    """For every account whether its Shapley values add up to its score less the mean score of the background."""
    matrix = behaviour_steps(spark, sf_dir)
    forest = anomaly.fit_forest(matrix, features.BEHAVIOUR)
    drawn = min(anomaly.SAMPLE, matrix.count())
    found = explain.forest_contributions(matrix, forest, features.BEHAVIOUR, drawn)
    scored = anomaly.score_forest(matrix, forest, features.BEHAVIOUR, drawn)
    total = F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)
    return found.join(sorted_join(scored), "account_id").select(
        "account_id", F.size("shares").cast("bigint").alias("features"),
        (F.abs(total - (-F.col("iso_score") - F.col("base"))) < 1e-9).alias("adds_up"),
    )


@query
def readable_features(spark, sf_dir):
    rows = behaviour(spark, sf_dir).select("account_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for c in ("account_age_days", "txn_count_30d", "total_sent_30d", "max_single_txn")
    ])).alias("f")).select("account_id", "f.*")
    return rows.select(
        "account_id", "feature", explain.readable(F.col("feature"), F.col("value"), F.col("value") > 100).alias("readable")
    )


# --- risk and alerts ------------------------------------------------------------------------------


def rules(spark, sf_dir):
    return risk.rule_scores(patterns.involvement(found_patterns(spark, sf_dir)))


def scores(spark, sf_dir):
    proxy = proxy_scores(spark, sf_dir)
    return materialize(
        risk.risk_scores(star.accounts(spark, sf_dir), proxy, proxy, rules(spark, sf_dir), AS_OF()), "risk-scores"
    )


@query
def rule_scores(spark, sf_dir):
    return rules(spark, sf_dir).withColumn("triggered_patterns", text_of("triggered_patterns"))


@query
def risk_scores(spark, sf_dir):
    return scores(spark, sf_dir).drop("timestamp").withColumn("triggered_patterns", text_of("triggered_patterns"))


@query
def tier_counts(spark, sf_dir):
    return risk.tier_counts(scores(spark, sf_dir))


@query
def risk_flags(spark, sf_dir):
    written = edges.write_back_risk(star.accounts(spark, sf_dir), risk.write_back(scores(spark, sf_dir)))
    return written.select("account_id", F.round("risk_score", 4).alias("risk_score"), "is_flagged")


def raised(spark, sf_dir):
    return alerts_of(scores(spark, sf_dir))


def alerts_of(scored):
    return alert_ops.make_alerts(scored, AS_OF())


@query
def alerts(spark, sf_dir):
    return raised(spark, sf_dir).select(
        "account_id", "risk_score", "risk_tier", text_of("triggered_patterns").alias("triggered_patterns"),
        "recommendation", "evidence_summary", "status",
    )


@query
def alert_page(spark, sf_dir):
    page = alert_ops.alert_page(raised(spark, sf_dir), "medium", limit=20, offset=10)
    return page.select("account_id", "risk_score", "risk_tier", "status", "total", "has_more")


@query
def alert_page_stored(spark, sf_dir):
    """The same page from stored blocks of 16 alerts."""
    path = scratch_path(spark, "alert-pages")
    alert_ops.store_pages(raised(spark, sf_dir), path, 16)
    page = alert_ops.stored_page(spark, path, "medium", limit=20, offset=10)
    return page.select("account_id", "risk_score", "risk_tier", "status", "total", "has_more")


@query
def alert_stats(spark, sf_dir):
    return alert_ops.alert_stats(raised(spark, sf_dir))


@query
def alert_detail(spark, sf_dir):
    scored = scores(spark, sf_dir)
    details = alert_ops.alert_details(
        alerts_of(scored), star.accounts(spark, sf_dir), scored, report.recent_transfers(star.transfers(spark, sf_dir))
    )
    return details.select(
        "account_id", "risk_tier", F.col("account_metadata.customer_name"), F.col("account_metadata.kyc_status"),
        text_of("transactions.txn_id").alias("txn_ids"), F.round("gnn_fraud_prob", 4).alias("gnn_fraud_prob"),
        F.round("anomaly_score", 4).alias("anomaly_score"),
    )


@query
def alert_updates(spark, sf_dir):
    """Status updates taken from orders: the customer's alert, order priority as the status, order key as the time."""
    open_alerts = raised(spark, sf_dir).withColumn("alert_id", F.col("account_id"))
    changes = star.table(spark, sf_dir, "orders", star.ORDERS).select(
        F.expr("concat('ACC', lpad(cast(o_custkey as string), 10, '0'))").alias("alert_id"),
        F.expr("case o_orderpriority when '1-URGENT' then 'escalated' when '2-HIGH' then 'INVESTIGATING'"
               " when '3-MEDIUM' then 'dismissed' when '5-LOW' then 'OPEN' else 'CLOSED' end").alias("status"),
        F.expr("case when o_orderkey % 3 = 0 then '' else concat('note ', cast(o_orderkey as string)) end").alias("analyst_note"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, o_orderkey)").alias("updated_at"),
    )
    return alert_ops.apply_updates(open_alerts, changes).select(
        "account_id", "status", F.coalesce("analyst_note", F.lit("")).alias("analyst_note"),
        F.coalesce(F.date_format("updated_at", SECONDS), F.lit("")).alias("updated_at"),
    )


@query
def account_lookup(spark, sf_dir):
    asked = star.transfers(spark, sf_dir).select(F.col("dst").alias("account_id"))
    return report.account_lookup(star.accounts(spark, sf_dir), asked).withColumn(
        "account_age_days", F.col("account_age_days").cast("bigint")
    )


@query
def recent_transfers(spark, sf_dir):
    rows = report.recent_transfers(star.transfers(spark, sf_dir))
    return rows.drop("ts").withColumn("place", F.col("place").cast("bigint"))


@query
def recent_transfers_kept(spark, sf_dir):
    """The same kept up over three batches in no order of time."""
    transfers, path = star.transfers(spark, sf_dir), scratch_path(spark, "latest")
    part = F.pmod(F.xxhash64("txn_id"), F.lit(3))
    buckets.create_latest(transfers.where(part == 0), path, 16)
    for n in (1, 2):
        buckets.add_latest(path, transfers.where(part == n))
    return buckets.latest(spark, path).drop("ts").withColumn("place", F.col("place").cast("bigint"))


@query
def narratives(spark, sf_dir):
    said = raised(spark, sf_dir).join(proxy_scores(spark, sf_dir), "account_id").withColumnRenamed(
        "ensemble_anomaly_score", "anomaly_score"
    )
    return explain.narrative(said)


@query
def report_rows(spark, sf_dir):
    scored = scores(spark, sf_dir)
    details = alert_ops.alert_details(
        alerts_of(scored), star.accounts(spark, sf_dir), scored, report.recent_transfers(star.transfers(spark, sf_dir))
    )
    rows = report.report_rows(details, "A. Analyst", "AN-1", AS_OF())
    return rows.select(
        F.col("account.account_id").alias("account_id"), F.col("account.customer_name").alias("customer_name"),
        F.col("account.branch_code").alias("branch_code"), "risk_score", "risk_tier", "patterns", "evidence", "report_date",
        F.col("analyst.date").alias("signed"),
        F.array_join(F.transform("transactions", lambda t: F.concat_ws(
            " ", t["txn_id"], t["amount"], t["type"], t["timestamp"], t["counterparty"], t["fraud"]
        )), "; ").alias("transactions"),
    )


@query
def run_summary(spark, sf_dir):
    proxy, found = proxy_scores(spark, sf_dir), found_patterns(spark, sf_dir)
    scored = materialize(risk.risk_scores(
        star.accounts(spark, sf_dir), proxy, proxy, risk.rule_scores(patterns.involvement(found)), AS_OF()
    ), "risk-scores")
    flagged_rows = proxy.withColumn("ensemble_is_anomaly", F.col("ensemble_anomaly_score") > anomaly.THRESHOLD)
    metrics = nodeclf.metrics(proxy, labels(spark, sf_dir))
    return report.run_summary(metrics, flagged_rows, found, alerts_of(scored))


@query
def loaded_counts(spark, sf_dir):
    scored = scores(spark, sf_dir)
    return report.loaded_counts(scored, alerts_of(scored))


# --- streams --------------------------------------------------------------------------------------


def one_feed(session, sf_dir):
    return star.edges_of(star.transactions_from(inbox.file_feed(session, sf_dir, star.EVENTS, only="events.parquet")))


def event_count(spark, sf_dir):
    return star.table(spark, sf_dir, "events", star.EVENTS).count()


def live_transfers(spark, sf_dir):
    """The events as a stream of transfers, each arriving over two feeds."""
    session = sink.state_session(spark, rows=2 * event_count(spark, sf_dir))
    return inbox.event_time(inbox.unified({"mobile": one_feed(session, sf_dir), "branch": one_feed(session, sf_dir)}))


def local_seconds(column):
    return F.date_format(F.col(column), SECONDS).alias(column)


@query
def stream_inbox(spark, sf_dir):
    rows = sink.collect_stream(live_transfers(spark, sf_dir))
    return rows.groupBy("feed", "txn_type").agg(F.count("*").alias("transfers"), F.sum("amount").alias("amount"))


@query
def stream_dedup(spark, sf_dir):
    rows = sink.collect_stream(inbox.deduplicated(live_transfers(spark, sf_dir)))
    return rows.select("txn_id", "src", "dst", "amount", local_seconds("ts"))


@query
def stream_enriched(spark, sf_dir):
    session_events = inbox.deduplicated(live_transfers(spark, sf_dir))
    accounts = star.accounts(session_events.sparkSession, sf_dir)
    rows = sink.collect_stream(inbox.enriched(session_events, accounts))
    return rows.select("txn_id", "src", "customer_name", "kyc_status", "amount")


@query
def stream_structuring(spark, sf_dir):
    """Windows of a day instead of ten minutes, and two transfers instead of five: the test events are sparse."""
    events = inbox.deduplicated(live_transfers(spark, sf_dir))
    rows = sink.collect_stream(rules_stream.bursts(events, "1 day", "1 hour", 2, 49_999.0)).drop("batch_id")
    return rows.withColumns({c: local_seconds(c) for c in ("window_start", "window_end")})


@query
def stream_sessions(spark, sf_dir):
    events = inbox.deduplicated(live_transfers(spark, sf_dir))
    rows = sink.collect_stream(rules_stream.sessions(events, "6 hours")).drop("batch_id")
    return rows.withColumns({c: local_seconds(c) for c in ("session_start", "session_end")})


@query
def stream_history(spark, sf_dir):
    events = inbox.event_time(one_feed(sink.state_session(spark, rows=event_count(spark, sf_dir)), sf_dir))
    kept = sink.collect_stream(history.account_history(events), "update")
    return history.merged(kept).withColumn("last_ts", local_seconds("last_ts"))


@query
def stream_alerts(spark, sf_dir):
    """All events in one batch, scored after a nightly run at the evaluation time."""
    events = inbox.deduplicated(live_transfers(spark, sf_dir))
    session = events.sparkSession
    folder = scratch_path(spark, "stream-alerts")
    proxy, nightly = (
        session.read.schema(t.schema).parquet(*t.inputFiles()) for t in (
            materialize(proxy_scores(spark, sf_dir), "scores"),
            materialize(patterns.involvement(found_patterns(spark, sf_dir)), "nightly-involvement"),
        )
    )
    write = sink.alert_writer(folder, star.accounts(session, sf_dir), proxy, proxy, 40.0, PARAMS, nightly)
    sink.run_available(events, write, scratch_path(spark, "stream-checkpoint"))
    return spark.read.parquet(f"{folder}/alerts").select(
        "account_id", "risk_score", "risk_tier", text_of("triggered_patterns").alias("triggered_patterns"), "evidence_summary"
    )


@query
def stream_alerts_live(spark, sf_dir):
    """History, then the last day in two batches; each alerts with all five rules as of its own latest transfer."""
    transfers = star.transfers(spark, sf_dir)
    folder, feed, checkpoint = (scratch_path(spark, n) for n in ("stream-alerts", "stream-feed", "stream-checkpoint"))
    slices = [F.lit(t).cast("timestamp_ntz") for t in ("2024-01-30 00:00:00", "2024-01-30 12:00:00", "2024-02-01 00:00:00")]
    sink.prime(folder, transfers.where(F.col("ts") < slices[0]), PARAMS)
    session = sink.state_session(spark)
    scores = materialize(proxy_scores(spark, sf_dir), "scores")
    proxy = session.read.schema(scores.schema).parquet(*scores.inputFiles())
    write = sink.alert_writer(folder, star.accounts(session, sf_dir), proxy, proxy, 40.0, PARAMS)
    for since, until in zip(slices, slices[1:]):
        transfers.where((F.col("ts") >= since) & (F.col("ts") < until)).write.mode("append").parquet(feed)
        events = inbox.event_time(inbox.file_feed(session, feed, transfers.schema))
        sink.run_available(events, write, checkpoint)
    return spark.read.parquet(f"{folder}/alerts").select(
        "batch_id", "account_id", "risk_score", "risk_tier", text_of("triggered_patterns").alias("triggered_patterns"), "evidence_summary"
    )

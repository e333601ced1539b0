"""The nightly run: from accounts and transactions to scores and alerts, as stored tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.operators import alerts as A
from moneytrail.operators import anomaly, centrality, explain, features, nodeclf, patterns, report, risk
from moneytrail.operators.cycles import trails
from moneytrail.scratch import materialize
from moneytrail.sources import tables
from moneytrail.sources.edges import build_transfers, write_back_risk


def run(spark: SparkSession, transactions: DataFrame, accounts: DataFrame, out: str, as_of: str,
        params: dict | None = None, reuse_features: bool = False, trees: int = anomaly.TREES,
        samples: int | None = centrality.SAMPLES, exact_neighbours: bool = True) -> DataFrame:
    """Score all accounts and return the run summary.

    Writes transfers, features, detections, node scores, anomaly scores, explanations, risk scores, alerts,
    reports, updated accounts, the models and the summary below ``out``. With ``reuse_features`` a feature table of
    the last hour is taken instead of a new one. Without ``exact_neighbours`` the outlier factors take approximate neighbours,
    for more accounts than exact search can serve.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    transfers_path = f"{out}/transfers"
    tables.write_table(build_transfers(transactions, accounts), transfers_path, by_day="ts")
    transfers = spark.read.parquet(transfers_path)

    settings = {**patterns.DEFAULTS["CIRCULAR_ROUND_TRIP"], **(params or {}).get("CIRCULAR_ROUND_TRIP", {})}
    found = patterns.all_patterns(transfers, accounts, now, params)
    for name, part in found.items():
        tables.write_table(part.detections, f"{out}/detections/{name}")

    matrix = tables.load_features(spark, f"{out}/features", as_of) if reuse_features else None
    if matrix is None:
        behaviour = features.account_features(transfers, accounts, now)
        structure = centrality.structural_features(
            transfers, accounts, features.degrees(transfers, accounts), trails(transfers, now, **settings), samples
        )
        tables.save_features(features.feature_matrix(behaviour, structure), f"{out}/features", as_of)
        matrix = spark.read.parquet(f"{out}/features").drop("computed_at")
    columns = [c for c in matrix.columns if c != "account_id"]

    labels = materialize(features.fraud_labels(transfers, accounts), "labels")
    wide = materialize(
        nodeclf.neighbour_means(matrix, nodeclf.Neighbours(transfers, accounts), columns), "wide-matrix"
    )
    model = nodeclf.train(wide, labels, columns)
    nodeclf.save_model(model, f"{out}/models/node")
    tables.write_table(nodeclf.score(model, wide), f"{out}/node_scores")
    node_scores = spark.read.parquet(f"{out}/node_scores")

    ensemble, forest = anomaly.detect(matrix, columns, trees, exact=exact_neighbours)
    tables.write_table(forest, f"{out}/models/forest")
    tables.write_table(ensemble, f"{out}/anomaly_scores")
    anomalies = spark.read.parquet(f"{out}/anomaly_scores")

    rules = risk.rule_scores(patterns.involvement(found))
    tables.write_table(risk.risk_scores(accounts, node_scores, anomalies, rules, now), f"{out}/risk_scores")
    scored = spark.read.parquet(f"{out}/risk_scores")
    tables.write_table(A.make_alerts(scored, now), f"{out}/alerts")
    raised = spark.read.parquet(f"{out}/alerts")
    tables.write_table(write_back_risk(accounts, risk.write_back(scored)), f"{out}/accounts")

    drawn = min(anomaly.SAMPLE, matrix.count())
    by_model = explain.explain_linear(wide, explain.model_weights(model), only=raised)
    by_forest = explain.explain_forest_shapley(matrix, forest, columns, drawn, only=raised)
    said = (
        raised.select("account_id", "risk_score", "risk_tier", "triggered_patterns")
        .join(node_scores, "account_id", "left")
        .join(anomalies.select("account_id", F.col("ensemble_anomaly_score").alias("anomaly_score")), "account_id", "left")
        .join(by_model.select("account_id", F.col("explanation").alias("gnn_explanation")), "account_id", "left")
        .join(by_forest.select("account_id", F.col("explanation").alias("anomaly_explanation")), "account_id", "left")
        .withColumns({
            "gnn_top": F.col("gnn_explanation")[0]["readable"], "anomaly_top": F.col("anomaly_explanation")[0]["readable"],
        })
    )
    explained = said.join(explain.narrative(said), "account_id").withColumn(
        "anomaly_text", explain.anomaly_text(F.col("account_id"), F.col("anomaly_score"), F.col("anomaly_explanation"))
    )
    tables.write_table(explained.select(
        "account_id", "gnn_explanation", "anomaly_explanation", "anomaly_text", "narrative"
    ), f"{out}/explanations")

    details = A.alert_details(raised, accounts, scored, report.recent_transfers(transfers))
    tables.write_table(report.report_rows(details, "", "", now), f"{out}/reports", fmt="json")
    summary = report.run_summary(nodeclf.metrics(node_scores, labels), anomalies, found, raised)
    tables.write_table(summary, f"{out}/summary")
    return spark.read.parquet(f"{out}/summary")

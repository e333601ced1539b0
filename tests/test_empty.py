"""No transfers, no accounts, one account."""

import pytest
from pyspark.sql import functions as F

from moneytrail.operators import alerts as A
from moneytrail.operators import anomaly, centrality, features, nodeclf, patterns, quality, report, risk, traverse
from moneytrail.scratch import materialize_counted


def test_counts(spark, transfers):
    assert materialize_counted(transfers(("A", "B", 1, 1)), "t")[1] == 1
    assert materialize_counted(transfers(("A", "B", 1, 1)).where("false"), "t")[1] == 0
    assert materialize_counted(spark.range(10).where("id > 100"), "t")[1] == 0


@pytest.fixture
def none(transfers):
    return transfers(("A", "B", 1, 1)).where("amount > 5")


def test_patterns(none, accounts, now):
    found = patterns.all_patterns(none, accounts("A"), now)
    assert {r.detections for r in patterns.pattern_counts(found).collect()} == {0}
    assert risk.rule_scores(patterns.involvement(found)).count() == 0
    assert patterns.structuring_sliding(none, now).count() == 0 and patterns.layering(none, now).count() == 0
    scored = {r.pattern: r for r in patterns.detector_evaluation(none, patterns.transfers_behind(found)).collect()}
    assert scored["LAYERING"].recall == 0


def test_graph(spark, none, accounts, now):
    people = accounts("A", ("B", {"is_flagged": True}))
    rank = [r.pagerank_score for r in centrality.page_rank(none, people).collect()]
    assert rank == pytest.approx([0.5, 0.5])
    assert {r.betweenness_centrality for r in centrality.betweenness(none, people).collect()} == {0.0}
    assert {r.clustering_coefficient for r in centrality.clustering(none, people).collect()} == {0.0}
    assert {r.account_id: r.hop_count_to_flagged for r in centrality.hops_to_flagged(none, people).collect()} == {"A": None, "B": 0}
    pairs = spark.createDataFrame([("A", "B")], "source string, dest string")
    assert traverse.fund_paths(none, people, pairs).count() == 0
    d = features.degrees(none, people)
    assert {r.degree_share_rank for r in features.degree_share_rank(d).collect()} == {0.5}
    assert centrality.page_rank(none, people.where("false")).count() == 0


def test_models(spark, none, accounts, now):
    people = accounts("A", "B")
    neighbours = nodeclf.Neighbours(none, people)
    matrix = features.standardise(features.account_features(none, people, now), features.BEHAVIOUR)
    wide = nodeclf.neighbour_means(matrix, neighbours, ["velocity_7d"], 1)
    assert {(r.velocity_7d, r.velocity_7d_h1) for r in wide.collect()} == {(0.0, 0.0)}
    scores, _ = anomaly.detect(matrix, features.BEHAVIOUR, trees=5)
    assert {r.ensemble_anomaly_score for r in scores.collect()} == {0.0}
    with pytest.raises(ValueError):
        anomaly.fit_forest(matrix.where("false"), features.BEHAVIOUR, trees=5)


def test_reports(spark, none, accounts, now):
    people = accounts("A")
    gnn = spark.createDataFrame([], "account_id string, gnn_fraud_prob double")
    iso = spark.createDataFrame([], "account_id string, ensemble_anomaly_score double")
    rules = spark.createDataFrame([], "account_id string, rule_score double, triggered_patterns array<string>")
    scored = risk.risk_scores(people, gnn, iso, rules, now)
    alerts = A.make_alerts(scored, now, "LOW")
    detail = A.alert_details(alerts, people, scored, report.recent_transfers(none)).head()
    assert detail.evidence_summary == "Account flagged based on aggregate risk signals." and detail.transactions is None
    assert report.report_rows(A.alert_details(alerts, people, scored, report.recent_transfers(none)), "a", "b", now).head().transactions == []
    assert A.alert_page(alerts.where("false")).count() == 0


def test_profile(none, accounts, now, spark):
    from moneytrail.schema import TRANSACTIONS
    empty = spark.createDataFrame([], TRANSACTIONS)
    rows = {r.item: r.value for r in quality.dataset_profile(empty, accounts("A")).collect()}
    assert rows["total_transactions"] == "0" and rows["fraud_percent"] == "0.0" and rows["total_accounts"] == "1"


def test_gaps_are_not_the_riskiest_value(spark):
    raw = spark.createDataFrame([("A", 100, 5, 0), ("B", 400, None, 3), ("C", 50, 1, None)],
                                "account_id string, account_age_days int, days_since_last_txn int, hop_count_to_flagged int")
    filled = {r.account_id: (r.days_since_last_txn, r.hop_count_to_flagged) for r in features.fill_gaps(raw).collect()}
    assert filled == {"A": (5, 0), "B": (400, 3), "C": (1, 4)}

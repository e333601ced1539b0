import pytest
from pyspark.sql import functions as F

from moneytrail.operators import alerts as A
from moneytrail.operators import report, risk


def involved(spark, *rows):
    return spark.createDataFrame(rows, "pattern string, detection_id string, account_id string")


def scored(spark, accounts, now, gnn=(), anomaly=(), rules=()):
    return risk.risk_scores(
        accounts,
        spark.createDataFrame(list(gnn), "account_id string, gnn_fraud_prob double"),
        spark.createDataFrame(list(anomaly), "account_id string, ensemble_anomaly_score double"),
        risk.rule_scores(involved(spark, *rules)), now,
    )


def test_points_count_per_detection_up_to_100(spark):
    rows = risk.rule_scores(involved(
        spark, *[("CIRCULAR_ROUND_TRIP", f"c{i}", "A") for i in range(3)],
        ("PROFILE_MISMATCH", "B", "B"), ("LAYERING", "l", "B"), ("SOMETHING_NEW", "x", "C"),
    )).collect()
    got = {r.account_id: (r.rule_score, r.triggered_patterns) for r in rows}
    assert got == {
        "A": (100.0, ["CIRCULAR_ROUND_TRIP"]), "B": (55.0, ["LAYERING", "PROFILE_MISMATCH"]), "C": (10.0, ["SOMETHING_NEW"])
    }


def test_score_combines_the_parts(spark, accounts, now):
    rows = {r.account_id: r for r in scored(
        spark, accounts("A", "B"), now, [("A", 1.0)], [("A", 1.0)], [("LAYERING", str(i), "A") for i in range(4)]
    ).collect()}
    assert rows["A"].risk_score == 100 and rows["A"].risk_tier == "CRITICAL" and rows["A"].rule_contribution == 25
    assert rows["B"].risk_score == 0 and rows["B"].risk_tier == "LOW" and rows["B"].triggered_patterns == []
    assert rows["B"].recommendation == "Normal monitoring. No immediate action required."


@pytest.mark.parametrize("score,tier", [
    (0.0, "LOW"), (30.5, "LOW"), (31.0, "MEDIUM"), (55.9, "MEDIUM"), (56.0, "HIGH"), (75.99, "HIGH"), (76.0, "CRITICAL"),
])
def test_tiers(spark, score, tier):
    assert spark.range(1).select(risk.risk_tier(F.lit(score))).head()[0] == tier


def make(spark, now):
    rows = [("A", 90.0, "CRITICAL", 30.0, 35.0, 25.0, ["LAYERING"]), ("B", 60.0, "HIGH", 12.5, 11.5, 10.0, []),
            ("C", 40.0, "MEDIUM", 9.0, 9.0, 10.0, ["LAYERING", "STRUCTURING"]), ("D", 35.0, "MEDIUM", 9.0, 9.0, 0.0, []),
            ("E", 33.0, "MEDIUM", 9.0, 9.0, 0.0, []), ("F", 3.0, "LOW", 0.0, 0.0, 0.0, [])]
    return spark.createDataFrame(
        rows, "account_id string, risk_score double, risk_tier string, gnn_contribution double, iso_contribution double,"
              " rule_contribution double, triggered_patterns array<string>"
    ).withColumn("recommendation", F.lit("r"))


def test_alerts_and_evidence(spark, now):
    rows = A.make_alerts(make(spark, now), now).collect()
    assert [r.account_id for r in rows] == list("ABCDE") and {r.status for r in rows} == {"OPEN"}
    said = {r.account_id: r.evidence_summary for r in rows}
    assert said["A"].endswith("AML patterns detected: LAYERING.") and "contributes 35%" in said["A"]
    # halves go to the even digit
    assert said["B"] == ("GNN model indicates 12% structural risk from account neighbourhood. "
                         "Anomaly detection score contributes 12% — behavioral patterns deviate from baseline.")
    assert said["D"] == "Account flagged based on aggregate risk signals."
    assert [r.alert_id for r in A.make_alerts(make(spark, now), now).collect()] == [r.alert_id for r in rows]
    assert A.make_alerts(make(spark, now), now, "HIGH").count() == 2


def test_paging(spark, now):
    alerts = A.make_alerts(make(spark, now), now)
    last = A.alert_page(alerts, limit=2, offset=4).collect()
    assert [(r.account_id, r.total, r.has_more) for r in last] == [("E", 5, False)]
    first = A.alert_page(alerts, "medium", limit=2).collect()
    assert [(r.account_id, r.total, r.has_more) for r in first] == [("C", 3, True), ("D", 3, True)]
    with pytest.raises(ValueError):
        A.alert_page(alerts, limit=201)


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_stored_pages_equal_pages_by_offset(spark, now, tmp_path, block):
    """Every page of every tier, ties in the score included, from at most two blocks."""
    tiers = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    alerts = spark.createDataFrame(
        [(f"x{i}", f"A{i * 7 % 40:02d}", float(i // 3), tiers[i % 3], ["LAYERING"], "OPEN", "c") for i in range(40)],
        "alert_id string, account_id string, risk_score double, risk_tier string, triggered_patterns array<string>, status string, created_at string",
    )
    path = str(tmp_path / "pages")
    A.store_pages(alerts, path, block)
    for tier in (None, "high", "LOW"):
        for limit, offset in ((5, 0), (5, 5), (7, 6), (50, 0), (3, 39), (2, 60)):
            page = A.stored_page(spark, path, tier, limit, offset)
            assert page.collect() == A.alert_page(alerts, tier, limit, offset).collect(), (tier, limit, offset)
    plan = A.stored_page(spark, path, None, 3, 6)._jdf.queryExecution().executedPlan().toString()
    assert "block#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    A.store_pages(alerts.limit(0), path, block)
    assert A.stored_page(spark, path).collect() == []


def test_statistics(spark, now):
    rows = {(r.section, r.item): r.value for r in A.alert_stats(A.make_alerts(make(spark, now), now)).collect()}
    assert rows == {
        ("overall", "total_alerts"): 5, ("overall", "total_amount_at_risk"): 1_500_000.0,
        ("by_tier", "LOW"): 0, ("by_tier", "MEDIUM"): 3, ("by_tier", "HIGH"): 1, ("by_tier", "CRITICAL"): 1,
        ("top_patterns", "LAYERING"): 2, ("top_patterns", "STRUCTURING"): 1,
    }
    none = A.alert_stats(A.make_alerts(make(spark, now).where("false"), now)).collect()
    assert {r.item: r.value for r in none} == dict.fromkeys(
        ["total_alerts", "total_amount_at_risk", "LOW", "MEDIUM", "HIGH", "CRITICAL"], 0.0)


def test_updates_are_validated_and_the_latest_wins(spark, now):
    alerts = A.make_alerts(make(spark, now), now).withColumn("alert_id", F.col("account_id"))
    changes = spark.createDataFrame([
        ("A", "investigating", "first", "2024-02-01 00:00:00"), ("A", "ESCALATED", "", "2024-02-02 00:00:00"),
        ("B", "CLOSED", "no", "2024-02-01 00:00:00"), ("Z", "OPEN", "no", "2024-02-01 00:00:00"),
    ], "alert_id string, status string, analyst_note string, at string").withColumn("updated_at", F.col("at").cast("timestamp_ntz"))
    rows = {r.alert_id: r for r in A.apply_updates(alerts, changes).collect()}
    assert (rows["A"].status, rows["A"].analyst_note, rows["A"].updated_at.day) == ("ESCALATED", "first", 2)
    assert (rows["B"].status, rows["B"].analyst_note, rows["B"].updated_at) == ("OPEN", None, None) and len(rows) == 5
    why = {(r.alert_id, r.reason) for r in A.rejected_updates(alerts, changes).collect()}
    assert why == {("B", "invalid_status"), ("Z", "unknown_alert")}


def test_details_and_report(spark, transfers, accounts, now):
    moves = transfers(*[("A", "B", 1234567.891, h) for h in range(1, 13)])
    alerts = A.make_alerts(make(spark, now), now)
    details = A.alert_details(alerts, accounts("A"), make(spark, now), report.recent_transfers(moves))
    rows = {r.account_id: r for r in details.collect()}
    assert rows["A"].gnn_fraud_prob == 0.75 and rows["A"].anomaly_score == 1.0 and rows["A"].account_metadata.branch_code == "B"
    assert [t.txn_id for t in rows["A"].transactions] == [f"t{i:03d}" for i in range(10)]
    assert rows["C"].account_metadata.account_id == "C" and rows["C"].account_metadata.customer_name is None
    printed = {r.account.account_id: r for r in report.report_rows(details, "Ann", "7", now, limit=2).collect()}
    line = printed["A"].transactions
    assert len(line) == 2 and line[0].txn_id == "t000..." and line[0].amount == "₹1,234,567.89"
    assert line[0].timestamp == "2024-01-30T23:00:00" and line[0].fraud == "NO"
    assert printed["A"].risk_score == "90/100" and printed["A"].report_no == printed["A"].report_id[:16].upper()
    assert printed["E"].account.kyc_status == "N/A" and printed["E"].transactions == [] and printed["A"].analyst.name == "Ann"


def test_lookup_keeps_unknown_ids(spark, accounts):
    rows = report.account_lookup(accounts("A", "B"), spark.createDataFrame([("A",), ("Q",)], "account_id string")).collect()
    assert {r.account_id: r.branch_code for r in rows} == {"A": "B", "Q": None}


def test_write_back_scale(spark, now):
    rows = {r.account_id: (r.risk_score, r.is_flagged) for r in risk.write_back(make(spark, now)).collect()}
    assert rows["A"] == (0.9, True) and rows["B"] == (0.6, True) and rows["C"] == (0.4, False)

"""The nightly run end to end on the smallest tables."""

from conftest import SMALL

from moneytrail.operators import nodeclf
from moneytrail.operators.quality import alert_violations
from moneytrail.plans import batch
from moneytrail.sources import star, tables


def test_run(spark, tmp_path):
    out = str(tmp_path / "run")
    tables.write_dataset(star.transactions(spark, SMALL), star.accounts(spark, SMALL), str(tmp_path / "in"))
    transactions, accounts = tables.read_dataset(spark, str(tmp_path / "in"))
    summary = {r.metric: r.value for r in batch.run(spark, transactions, accounts, out, star.AS_OF, trees=20, samples=20).collect()}
    n = accounts.count()
    scored = spark.read.parquet(f"{out}/risk_scores")
    assert scored.count() == n and scored.where("risk_score < 0 or risk_score > 100").count() == 0
    assert summary["patterns_PROFILE_MISMATCH"] == 48 and 0 <= summary["gnn_auc_roc"] <= 1
    alerts = spark.read.parquet(f"{out}/alerts")
    assert alerts.count() == summary["total_alerts"] and alert_violations(alerts).count() == 0
    assert spark.read.json(f"{out}/reports").count() == alerts.count()
    explained = spark.read.parquet(f"{out}/explanations").collect()
    assert len(explained) == alerts.count() and all(len(r.gnn_explanation) == 5 and r.narrative for r in explained)
    updated = spark.read.parquet(f"{out}/accounts")
    assert updated.columns == accounts.columns and updated.agg({"risk_score": "max"}).head()[0] > 0

    model = nodeclf.load_model(f"{out}/models/node")
    assert len(model.columns) == 21 and len(model.inputs) == 84
    stored = tables.load_features(spark, f"{out}/features", star.AS_OF)
    assert stored is not None and len(stored.columns) == 22
    again = batch.run(spark, transactions, accounts, out + "-again", star.AS_OF, trees=20, samples=20)
    repeated = {r.metric: r.value for r in again.collect()}
    assert repeated == summary

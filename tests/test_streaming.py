from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from moneytrail.streaming import history, inbox, rules, sink

START = datetime(2024, 1, 1, 12)
SCHEMA = "txn_id string, ts timestamp_ntz, src string, dst string, amount double, txn_type string, is_fraud boolean"


@pytest.fixture
def feed(spark, tmp_path):
    """Write files of ``(txn_id, src, amount, minute)`` rows and stream them, one file per batch."""
    def make(*files, name="feed"):
        for i, rows in enumerate(files):
            full = [(t, START + timedelta(minutes=m), s, "D", float(a), "UPI", False) for t, s, a, m in rows]
            spark.createDataFrame(full, SCHEMA).coalesce(1).write.parquet(str(tmp_path / name / f"{i:03d}"))
        session = sink.state_session(spark, 2)
        reader = session.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        return inbox.event_time(reader.parquet(str(tmp_path / name)))
    return make


def test_duplicates_are_dropped_across_batches(feed):
    events = feed([("a", "S", 1, 0), ("b", "S", 2, 1)], [("a", "S", 1, 0), ("c", "S", 3, 2)])
    rows = sink.collect_stream(inbox.deduplicated(events)).collect()
    assert sorted(r.txn_id for r in rows) == ["a", "b", "c"] and {r.batch_id for r in rows} == {0, 1}


def test_feeds_are_united_and_enriched(feed, accounts):
    both = inbox.unified({"upi": feed([("a", "S", 1, 0)], name="x"), "atm": feed([("b", "Q", 1, 0)], name="y")})
    people = accounts(("S", {"customer_name": "Sam"}))
    people = both.sparkSession.createDataFrame(people.collect(), people.schema)
    rows = sink.collect_stream(inbox.enriched(both, people)).collect()
    assert {(r.txn_id, r.feed, r.customer_name) for r in rows} == {("a", "upi", "Sam"), ("b", "atm", None)}


def burst(account, last=40_000, minutes=(0, 2, 4, 6, 8)):
    return [(f"{account}{m}", account, 40_000 if m != minutes[-1] else last, m) for m in minutes]


def test_burst_rule(spark, feed):
    later = [("z", "Z", 1, 500)]
    events = feed(burst("S") + burst("T", 60_000) + burst("U", minutes=(0, 2, 4, 6)), later)
    rows = sink.collect_stream(rules.bursts(events)).collect()
    assert {r.src for r in rows} == {"S"} and all(r.transfers == 5 for r in rows) and len(rows) == 2


def test_late_rows_are_left_out_and_the_batch_twin_agrees(spark, feed):
    on_time = burst("S")
    # the bound for late rows follows the watermark one batch behind
    events = feed(on_time, [("z", "Z", 1, 500)], [("y", "Z", 1, 501)], [("late", "S", 60_000, 5)])
    rows = sink.collect_stream(rules.bursts(events)).drop("batch_id").collect()
    stored = spark.createDataFrame(
        [(t, START + timedelta(minutes=m), s, float(a)) for t, s, a, m in on_time], "txn_id string, ts timestamp, src string, amount double")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, rules.bursts(stored).collect()))


def test_sessions(feed):
    events = feed([("a", "S", 1, 0), ("b", "S", 2, 20), ("c", "S", 4, 90)], [("z", "Z", 1, 500)])
    rows = sink.collect_stream(rules.sessions(events)).collect()
    assert sorted((r.src, r.transfers, r.total) for r in rows) == [("S", 1, 4.0), ("S", 2, 3.0)]


def test_history_spans_batches_and_shards(feed):
    events = feed([(f"a{i}", "S", i, i) for i in range(20)] + [("q", "Q", 5, 3)], [(f"b{i}", "S", 100, 30 + i) for i in range(3)])
    kept = sink.collect_stream(history.account_history(events, shards=4), "update")
    rows = {r.src: r for r in history.merged(kept).collect()}
    assert (rows["S"].transfers, rows["S"].total, rows["S"].largest) == (23, 490.0, 100.0)
    assert rows["S"].last_ts == START + timedelta(minutes=32) and rows["Q"].transfers == 1
    assert kept.where("src = 'S'").select("shard").distinct().count() > 1


def test_alert_stream_scores_touched_accounts(spark, feed, accounts, tmp_path):
    events = feed([(f"a{i}", f"S{i}", 100, i) for i in range(4)], [("a9", "S9", 100, 9)], [("x", "Y", 900_000, 20)])
    session = events.sparkSession
    people = session.createDataFrame(accounts("D", "S0", "S9", "Y", "P").collect(), accounts("D").schema)
    gnn = session.createDataFrame([("D", 1.0), ("P", 1.0)], "account_id string, gnn_fraud_prob double")
    anomaly = session.createDataFrame([], "account_id string, ensemble_anomaly_score double")
    stored, raised = str(tmp_path / "out/transfers"), str(tmp_path / "out/alerts")
    write = sink.alert_writer(str(tmp_path / "out"), people, gnn, anomaly, 20.0)
    sink.run_available(events, write, str(tmp_path / "checkpoint"))
    rows = spark.read.parquet(raised).orderBy("batch_id").collect()
    # the account is alerted on in each batch that touches it; the fifth credit adds the structuring points
    assert [(r.batch_id, r.account_id, r.risk_score) for r in rows] == [(0, "D", 40.0), (1, "D", 47.5), (2, "D", 47.5)]
    assert rows[1].triggered_patterns == ["STRUCTURING"]
    before = spark.read.parquet(stored).count()
    batch = spark.read.parquet(stored).where("batch_id = 2").drop("day", "batch_id")
    write(session.createDataFrame(batch.collect(), batch.schema), 2)  # a repeated batch replaces itself
    assert spark.read.parquet(stored).count() == before == 6
    assert spark.read.parquet(raised).count() == 3


def test_alert_stream_takes_graph_rules_from_the_nightly_run(spark, feed, accounts, tmp_path):
    events = feed([("a", "S", 100, 1), ("b", "T", 100, 2)])
    session = events.sparkSession
    people = session.createDataFrame(accounts("D", "S", "T", "P").collect(), accounts("D").schema)
    gnn = session.createDataFrame([], "account_id string, gnn_fraud_prob double")
    anomaly = session.createDataFrame([], "account_id string, ensemble_anomaly_score double")
    nightly = session.createDataFrame(
        [("CIRCULAR_ROUND_TRIP", "1", "S"), ("LAYERING", "2", "S"), ("DORMANT_ACTIVATION", "3", "T"), ("STRUCTURING", "4", "T"), ("LAYERING", "5", "P")],
        "pattern string, detection_id string, account_id string",
    )
    write = sink.alert_writer(str(tmp_path / "out"), people, gnn, anomaly, 1.0, nightly=nightly)
    sink.run_available(events, write, str(tmp_path / "checkpoint"))
    rows = spark.read.parquet(str(tmp_path / "out/alerts")).collect()
    # accounts without a transfer in the batch are left alone, and rules found anew are not taken from the night
    assert {r.account_id: (r.risk_score, r.triggered_patterns) for r in rows} == {
        "S": (18.75, ["CIRCULAR_ROUND_TRIP", "LAYERING"]), "T": (6.25, ["DORMANT_ACTIVATION"])
    }


def test_credits_of_many_batches_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "FOLD", 3)
    folder, schema = str(tmp_path), "account_id string, credit_count bigint, total_suspicious_amount double"
    for batch in range(8):
        rows = [("A", 1, 10.0), (f"B{batch}", 1, 1.0)] if batch != 4 else []
        sink.per_batch(f"{folder}/credits")(spark.createDataFrame(rows, schema), batch)
        for _ in range(2):  # a repeated batch folds to the same
            sums = sink.credit_sums(spark, folder, batch)
            if (batch + 1) % 3 == 0:
                sums.write.mode("overwrite").parquet(f"{folder}/credit_sums/before={batch + 1}")
        read = sums.inputFiles()
        assert len({f.split("/")[-2] for f in read}) <= 4
    assert {r.account_id: r.credit_count for r in sums.collect()} == {"A": 7, **{f"B{b}": 1 for b in range(8) if b != 4}}


def test_newest_version_of_each_key(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 5, 2), ("b", 3, 1)], "k string, v int, batch_id int")
    assert sorted(map(tuple, sink.newest(rows, ["k"]).collect())) == [("a", 5), ("b", 3)]

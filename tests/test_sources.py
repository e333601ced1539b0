from datetime import datetime

import pytest
from pyspark.sql import functions as F

from moneytrail.functions import skew
from moneytrail.operators import quality
from moneytrail.schema import TRANSACTIONS
from moneytrail.sources import edges, tables

GOOD = {
    "txn_id": "t1", "timestamp": datetime(2024, 1, 1, 10, 0, 0, 123456), "sender_account": "ACC0000000001",
    "receiver_account": "ACC0000000002", "amount": 100.0, "txn_type": "NEFT", "channel": "API", "status": "SUCCESS",
    "description": "", "is_fraud": False, "fraud_type": None,
}


@pytest.fixture
def txns(spark):
    def make(*changes):
        rows = [{**GOOD, "txn_id": f"t{i}", **c} for i, c in enumerate(changes)]
        return spark.createDataFrame([tuple(r[f.name] for f in TRANSACTIONS.fields) for r in rows], TRANSACTIONS)
    return make


PEOPLE = ("ACC0000000001", "ACC0000000002")


def test_record_rules(txns):
    found = {(r.record_id, r.rule) for r in quality.transaction_violations(txns(
        {}, {"amount": 99.99}, {"amount": 50_000_000.0}, {"sender_account": "ACC1"}, {"txn_type": "CASH"}, {"channel": None},
        {"status": "LOST"}, {"fraud_type": "LAYERING"}, {"fraud_type": "ODD"}, {"receiver_account": "ACCabcdefghij"},
    )).collect()}
    assert found == {
        ("t1", "amount_range"), ("t3", "sender_format"), ("t4", "txn_type_domain"), ("t5", "channel_domain"),
        ("t6", "status_domain"), ("t8", "fraud_type_domain"),
    }


def test_account_rules(accounts):
    found = {(r.record_id, r.rule) for r in quality.account_violations(accounts(
        PEOPLE[0], ("bad", {}), (PEOPLE[1], {"account_age_days": -1, "risk_score": 1.5, "kyc_status": "NEW"}),
    )).collect()}
    assert found == {("bad", "account_id_format"), (PEOPLE[1], "account_age_range"), (PEOPLE[1], "account_risk_range"), (PEOPLE[1], "kyc_status_domain")}


def test_limit_rules(txns, accounts):
    people = accounts((PEOPLE[0], {"account_type": "SALARY"}), (PEOPLE[1], {"account_type": "DORMANT"}))
    found = {(r.record_id, r.rule) for r in quality.limit_violations(txns(
        {"amount": 20_000.0}, {"amount": 19_999.0}, {"txn_type": "RTGS", "amount": 70_000.0}, {"txn_type": "UPI", "amount": 100_000.5},
        {"sender_account": PEOPLE[1], "amount": 500_000.0}, {"sender_account": PEOPLE[1], "amount": 999.0},
    ), people).collect()}
    assert found == {
        ("t1", "account_type_band"), ("t2", "rtgs_minimum"), ("t3", "upi_maximum"), ("t3", "account_type_band"), ("t5", "account_type_band")
    }


def test_alert_rules(spark):
    df = spark.createDataFrame([("a", 100.0, "LOW", "OPEN"), ("b", 100.5, "NONE", "GONE")], "alert_id string, risk_score double, risk_tier string, status string")
    assert {r.rule for r in quality.alert_violations(df).collect()} == {"alert_risk_range", "risk_tier_domain", "status_domain"}


def test_defaults_are_repeatable(txns):
    raw = txns({"txn_id": None, "status": None, "description": None, "is_fraud": None}, {"txn_id": "own"})
    first, again = (sorted(r.txn_id for r in quality.fill_defaults(raw).collect()) for _ in range(2))
    assert first == again and "own" in first
    row = quality.fill_defaults(raw).where("txn_id <> 'own'").head()
    assert (row.status, row.description, row.is_fraud, len(row.txn_id)) == ("SUCCESS", "", False, 64)


def test_numeric_cleaning(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    assert [r.v for r in quality.coerce_numeric(df, ["v"]).collect()] == [1.5, 0.0, 0.0]
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.0,)], "v double")
    assert [r.v for r in quality.finite_or_zero(df, ["v"]).collect()] == [0.0, 0.0, 0.0, 0.0, 2.0]


def test_graph_tables(txns, accounts):
    raw = txns({}, {"receiver_account": "ACC9"}, {"sender_account": "ACC9"}, {"receiver_account": PEOPLE[0], "fraud_type": None})
    people = accounts(*PEOPLE)
    built = edges.build_transfers(raw, people).collect()
    assert sorted(r.txn_id for r in built) == ["t0", "t3"] and built[0].ts.microsecond == 0
    assert sorted(r.txn_id for r in edges.build_sent(raw, people).collect()) == ["t0", "t1", "t3"]
    assert sorted(r.txn_id for r in edges.build_received(raw, people).collect()) == ["t0", "t2", "t3"]
    assert {r.fraud_type for r in edges.build_transactions(raw).collect()} == {""}
    assert {r.metric: r.value for r in edges.build_counts(raw, people).collect()} == {
        "transactions": 4, "sent_rels": 3, "received_rels": 3, "transfer_rels": 2, "orphan_transactions": 2}
    assert {(r.txn_id, r.side) for r in quality.orphan_transfers(raw, people).collect()} == {("t1", "receiver"), ("t2", "sender")}


def test_upsert_replaces_rows(spark, accounts):
    current = accounts("A", ("B", {"customer_name": "old", "is_flagged": True}))
    batch = accounts(("B", {"customer_name": "first"}), ("B", {"customer_name": "last", "branch_code": None}), "C").withColumn(
        "n", F.when(F.col("customer_name") == "last", 2).otherwise(1))
    rows = {r.account_id: r for r in edges.upsert_accounts(current, batch, "n").collect()}
    assert set(rows) == {"A", "B", "C"} and (rows["B"].customer_name, rows["B"].branch_code, rows["B"].is_flagged) == ("last", None, False)


@pytest.mark.parametrize("order", [None, "n"])
def test_upsert_keeps_one_row_an_account(accounts, order):
    """Repeated and undecided rows, and a deciding column that is null throughout."""
    batch = accounts(("A", {"customer_name": "x"}), ("A", {"customer_name": "y"}), "C").withColumn("n", F.lit(None).cast("int"))
    rows = edges.upsert_accounts(accounts("A", "B"), batch, order).collect()
    assert sorted(r.account_id for r in rows) == ["A", "B", "C"] and all(r.customer_name for r in rows)
    again = edges.upsert_accounts(accounts("A", "B"), batch.orderBy("customer_name"), order).collect()
    assert sorted(rows) == sorted(again)


def test_half_an_update_keeps_the_other_half(spark, accounts):
    updates = spark.createDataFrame([("A", None, True), ("B", 0.5, None)], "account_id string, risk_score double, is_flagged boolean")
    people = accounts(("A", {"risk_score": 0.25}), ("B", {"is_flagged": True}))
    rows = {r.account_id: (r.risk_score, r.is_flagged) for r in edges.write_back_risk(people, updates).collect()}
    assert rows == {"A": (0.25, True), "B": (0.5, True)}


def test_a_bad_number_in_a_file_is_cleaned(spark, txns, accounts, tmp_path):
    tables.write_dataset(txns({"amount": 7.5}), accounts(*PEOPLE), str(tmp_path))
    for file in (tmp_path / "transactions.csv").glob("part-*.csv"):
        file.write_text(file.read_text().replace("7.5", "seven"))
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    read = tables.read_dataset(spark, str(tmp_path))[0]
    assert [r.amount for r in read.collect()] == [None]
    assert [r.amount for r in quality.coerce_numeric(read, ["amount"]).collect()] == [0.0]


def test_risk_write_back_ignores_unknown_accounts(spark, accounts):
    updates = spark.createDataFrame([("A", 0.5, True), ("Z", 1.0, True)], "account_id string, risk_score double, is_flagged boolean")
    rows = {r.account_id: (r.risk_score, r.is_flagged) for r in edges.write_back_risk(accounts("A", "B"), updates).collect()}
    assert rows == {"A": (0.5, True), "B": (0.0, False)}


def test_csv_round_trip_and_append(spark, txns, accounts, tmp_path):
    people = accounts(*PEOPLE)
    tables.write_dataset(txns({}, {"amount": 7.25}), people, str(tmp_path))
    read, who = tables.read_dataset(spark, str(tmp_path))
    assert sorted(map(tuple, read.collect()))[1][4] == 7.25 and read.schema == TRANSACTIONS
    assert sorted(map(tuple, who.collect())) == sorted(map(tuple, people.collect()))
    tables.write_dataset(txns({}), people, str(tmp_path))
    assert tables.read_dataset(spark, str(tmp_path))[0].count() == 1
    stored = str(tmp_path / "accounts")
    tables.write_table(people, stored)
    with pytest.raises(ValueError):
        tables.append_accounts(accounts(PEOPLE[0], "new"), spark.read.parquet(stored), stored)
    with pytest.raises(ValueError):
        tables.append_accounts(accounts("new", "new"), spark.read.parquet(stored), stored)
    tables.append_accounts(accounts("new"), spark.read.parquet(stored), stored)
    assert spark.read.parquet(stored).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_dataset(spark, str(tmp_path / "nothing"))


def test_feature_cache_expires(spark, tmp_path):
    path = str(tmp_path / "features")
    assert tables.load_features(spark, path, "2024-01-01 00:00:00") is None
    tables.save_features(spark.createDataFrame([("A", 1.0)], "account_id string, x double"), path, "2024-01-01 00:00:00")
    assert tables.load_features(spark, path, "2024-01-01 01:00:00").columns == ["account_id", "x"]
    assert tables.load_features(spark, path, "2024-01-01 01:00:01") is None
    assert tables.load_features(spark, path, "2023-12-31 23:59:59") is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    many = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    one = spark.range(30).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    hot = skew.hot_keys(many, "k", min_rows=1000)
    assert hot == [0]
    salted = skew.salted_join(many, one, "k", F.col("id"), how, hot)
    plain = many.join(one, "k", how)
    assert sorted(map(tuple, salted.select(plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    tasks = skew.scatter(many, "k", hot, F.col("id")).where("k = 0").select("salt").distinct().count()
    assert tasks == skew.SPLITS
    assert skew.hot_listed(many.groupBy("k").count(), "k", "count", 1000) == [0]

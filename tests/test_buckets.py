import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from moneytrail.operators import report
from moneytrail.sources import buckets, edges

SCHEMA = "txn_id string, ts timestamp_ntz, src string, dst string, amount double, txn_type string, is_fraud boolean"


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def stored_versions(path):
    return {(b, v) for b in os.listdir(f"{path}/data") if b.startswith("bucket=") for v in os.listdir(f"{path}/data/{b}") if v.startswith("version=")}


def test_upsert_rewrites_touched_buckets_only(spark, accounts, tmp_path):
    path, people = str(tmp_path / "t"), accounts(*[f"A{i}" for i in range(200)])
    buckets.create(people, path, 32)
    before = stored_versions(path)
    batch = accounts(("A3", {"customer_name": "new"}), ("Z1", {"branch_code": "C"}))
    touched = buckets.upsert(path, batch)
    assert len(touched) <= 2 and {b for b, _ in stored_versions(path) - before} == {f"bucket={b}" for b in touched}
    assert rows(buckets.read(spark, path)) == rows(edges.upsert_accounts(people, batch))
    only = buckets.read(spark, path, ["A3", "Z1", "unknown"])
    assert {r.account_id for r in only.collect()} == {"A3", "Z1"} and len(only.inputFiles()) < 32


def test_batches_in_any_number(spark, accounts, tmp_path):
    rng, path, whole = random.Random(1), str(tmp_path / "t"), accounts(*[f"A{i}" for i in range(50)])
    buckets.create(whole, path, 8)
    for n in range(3):
        batch = accounts(*[(f"A{rng.randrange(80)}", {"customer_name": f"n{n}"}) for _ in range(12)])
        buckets.upsert(path, batch)
        whole = spark.createDataFrame(edges.upsert_accounts(whole, batch).collect(), whole.schema)
        assert rows(buckets.read(spark, path)) == rows(whole)
    updates = spark.createDataFrame([("A1", 0.7, True), ("A2", None, False), ("gone", 1.0, True)], "account_id string, risk_score double, is_flagged boolean")
    buckets.write_back(path, updates)
    assert rows(buckets.read(spark, path)) == rows(edges.write_back_risk(whole, updates))
    assert buckets.upsert(path, whole.limit(0)) == []


def test_a_crash_before_the_swap_changes_nothing(spark, accounts, tmp_path, monkeypatch):
    path, people = str(tmp_path / "t"), accounts("A", "B", "C")
    buckets.create(people, path, 4)
    with monkeypatch.context() as m:
        m.setattr(buckets, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            buckets.upsert(path, accounts(("A", {"customer_name": "lost"})))
    assert rows(buckets.read(spark, path)) == rows(people)
    buckets.upsert(path, accounts(("A", {"customer_name": "kept"})))
    assert {r.account_id: r.customer_name for r in buckets.read(spark, path).collect()} == {"A": "kept", "B": "N", "C": "N"}


def test_a_second_writer_from_the_same_state_fails(spark, accounts, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(accounts("A", "B"), path, 4)

    def other_writes_first(current, new):
        buckets.upsert(path, accounts(("A", {"customer_name": "first"})))
        return edges.upsert_accounts(current, new)

    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        buckets.change(path, accounts(("A", {"customer_name": "second"})), other_writes_first)
    assert {r.account_id: r.customer_name for r in buckets.read(spark, path).collect()} == {"A": "first", "B": "N"}


@pytest.mark.parametrize("seed", [1, 2])
def test_latest_transfers_after_any_split(spark, tmp_path, seed):
    """Equal to the window over all transfers: late and repeated batches, ties, and a busy account."""
    rng, path = random.Random(seed), str(tmp_path / "t")
    made = [
        (f"t{i:03d}", datetime(2024, 1, 1) + timedelta(hours=rng.randrange(40)), rng.choice(["HUB", f"A{rng.randrange(15)}"]), f"A{rng.randrange(15)}",
         float(i), "UPI", i % 2 == 0) for i in range(300)
    ]
    rng.shuffle(made)
    cuts = sorted(rng.sample(range(1, 300), 3))
    parts = [spark.createDataFrame(made[a:b], SCHEMA) for a, b in zip([0, *cuts], [*cuts, 300])]
    buckets.create_latest(parts[0], path, 8)
    for part in (parts[1], parts[2], parts[1], parts[3]):
        buckets.add_latest(path, part)
    want = report.recent_transfers(spark.createDataFrame(made, SCHEMA))
    assert rows(buckets.latest(spark, path)) == rows(want)
    assert rows(buckets.latest(spark, path, ["A1", "HUB"])) == rows(want.where(F.col("account_id").isin("A1", "HUB")))
    assert buckets.add_latest(path, parts[0].limit(0)) == []

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from moneytrail.operators import daily, features

SCHEMA = "txn_id string, ts timestamp_ntz, src string, dst string, amount double, txn_type string, is_fraud boolean"
START = datetime(2024, 1, 1)


def made(seed, n=400, days=45):
    rng = random.Random(seed)
    names = [f"A{i}" for i in range(12)] + ["HUB"] * 4
    rows = [
        (f"t{i}", START + timedelta(minutes=rng.randrange(days * 1440)), rng.choice(names), rng.choice(names), float(rng.randrange(1, 500)), "UPI", False)
        for i in range(n)
    ]
    return rows + [(f"u{r[0]}", *r[1:]) for r in rows[::7]]  # equal but for the id: counted once


def values(df):
    return {r.account_id: [round(v, 9) if isinstance(v, float) else v for v in r] for r in df.collect()}


@pytest.mark.parametrize("as_of", [datetime(2024, 2, 10, 13, 37), datetime(2024, 2, 1), datetime(2024, 1, 4, 23, 59, 59), datetime(2023, 12, 1)])
def test_features_equal_those_from_transfers(spark, accounts, tmp_path, as_of):
    """For windows that cut days anywhere, after late transfers and transfers after the time asked for."""
    rows, owners, path = made(1), accounts(*[f"A{i}" for i in range(13)], ("HUB", {"account_type": "DORMANT"})), str(tmp_path)
    random.Random(2).shuffle(rows)
    stored = spark.createDataFrame(rows[:200], SCHEMA)
    daily.refresh(stored, path, daily.changed_days(stored))
    new = spark.createDataFrame(rows[200:], SCHEMA)
    every = stored.unionByName(new)
    daily.refresh(every, path, daily.changed_days(new))
    now = F.lit(as_of).cast("timestamp_ntz")
    want = values(features.account_features(every, owners, now))
    assert values(daily.account_features(path, every, owners, as_of)) == want
    sketched = values(daily.account_features(path, every, owners, as_of, sketch=True))
    at_once = values(features.account_features(every, owners, now, approximate=True))
    assert sketched == want == at_once  # sketches of few values are exact


def test_only_changed_days_are_written(spark, tmp_path):
    path = str(tmp_path)
    stored = spark.createDataFrame(made(3), SCHEMA)
    daily.refresh(stored, path, daily.changed_days(stored))

    def written():
        return {(t, d): os.stat(f"{path}/{t}/{d}").st_mtime_ns for t in ("daily", "pairs") for d in os.listdir(f"{path}/{t}") if d.startswith("day=")}

    before = written()
    new = spark.createDataFrame([("n", datetime(2024, 1, 9, 5), "A1", "A2", 5.0, "UPI", False)], SCHEMA)
    daily.refresh(stored.unionByName(new), path, daily.changed_days(new))
    assert {k[1] for k, t in written().items() if t != before[k]} == {"day=2024-01-09"}


def test_sketch_of_many_counterparties(spark, accounts, tmp_path):
    rows = [(f"t{i}", START + timedelta(minutes=i), "HUB", f"C{i % 7000}", 1.0, "UPI", False) for i in range(20_000)]
    df, owners = spark.createDataFrame(rows, SCHEMA), accounts("HUB")
    daily.refresh(df, str(tmp_path), daily.changed_days(df))
    as_of = START + timedelta(days=20)
    got = daily.account_features(str(tmp_path), df, owners, as_of, sketch=True).head().unique_counterparties_30d
    near = features.account_features(df, owners, F.lit(as_of).cast("timestamp_ntz"), approximate=True).head().unique_counterparties_30d
    assert abs(got - 7000) < 0.05 * 7000 and abs(near - 7000) < 0.08 * 7000


def test_no_transfers(spark, accounts, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    daily.refresh(df, str(tmp_path), daily.changed_days(df))
    rows = spark.createDataFrame(made(4, 5), SCHEMA)
    daily.refresh(rows, str(tmp_path), daily.changed_days(rows))
    daily.refresh(df, str(tmp_path), [])
    found = daily.account_features(str(tmp_path), rows, accounts("Q"), datetime(2024, 2, 10)).head()
    assert found.txn_count_30d == 0 and found.unique_counterparties_30d == 0


@pytest.mark.parametrize("before, as_of", [
    (datetime(2024, 2, 3, 11), datetime(2024, 2, 3, 17)), (datetime(2024, 2, 3), datetime(2024, 2, 12, 5)), (datetime(2024, 2, 20), datetime(2024, 3, 20)),
])
def test_features_reused_in_part(spark, accounts, before, as_of):
    """Equal to features made anew; only accounts that something happened to are computed."""
    rows = [r for r in made(5, 150) if r[2] != "HUB" and r[3] != "HUB"] + [("q", START, "OLD1", "OLD2", 5.0, "UPI", False)]
    late_rows = [("l", datetime(2024, 2, 1, 3), "A1", "OLD2", 7.0, "UPI", False)] if as_of.day == 17 or before.day == 20 else []
    owners = accounts(*[f"A{i}" for i in range(13)], "OLD1", ("OLD2", {"account_type": "DORMANT"}), "NEW")
    old = spark.createDataFrame(rows, SCHEMA)
    stored = features.account_features(old, owners.where("account_id <> 'NEW'"), F.lit(before).cast("timestamp_ntz"))
    late = spark.createDataFrame(late_rows, SCHEMA)
    every = old.unionByName(late)
    found, n = daily.refreshed(stored, every, owners, before, as_of, late)
    want = features.account_features(every, owners, F.lit(as_of).cast("timestamp_ntz"))
    assert values(found) == values(want.select(*found.columns))
    assert 1 <= n < 16

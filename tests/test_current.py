"""The alert stream against batch runs over all transfers so far."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from moneytrail.operators import cycles, patterns, risk
from moneytrail.streaming import current, sink

START = datetime(2024, 1, 1)
SCHEMA = "txn_id string, ts timestamp_ntz, src string, dst string, amount double, txn_type string, is_fraud boolean"
RULES = {
    "CIRCULAR_ROUND_TRIP": {"max_hop": 5, "hours": 30}, "LAYERING": {"min_amount": 300, "hours": 40},
    "STRUCTURING": {"threshold": 400, "hours": 60, "min_count": 4}, "PROFILE_MISMATCH": {"min_amount": 950},
    "DORMANT_ACTIVATION": {"dormant_days": 60, "window_days": 3},
}


def made(seed, n=260, nodes=24, hours=130):
    """Transfers of whole amounts in a small graph, with a hub, loops and equal times."""
    rng = random.Random(seed)
    names = ["HUB"] * 3 + [f"A{i:02d}" for i in range(nodes)]
    return [
        (f"t{i:04d}", START + timedelta(minutes=rng.randrange(hours * 60) // 10 * 10), rng.choice(names), rng.choice(names),
         float(rng.randrange(1, 1000)), "UPI", False)
        for i in range(n)
    ]


def people(accounts):
    kinds = [{"account_type": t, "account_age_days": a, "customer_category": c} for t, a, c in
             (("DORMANT", 1, "RETIRED"), ("SAVINGS", 100, "STUDENT"), ("SAVINGS", 5, "INDIVIDUAL"))]
    return accounts("HUB", *[(f"A{i:02d}", kinds[i % 3]) for i in range(24)])


def expected(spark, rows, seen, owners, touched):
    """Rule score and patterns of the touched accounts, by the batch detectors over all rows."""
    params = {**RULES, "DORMANT_ACTIVATION": {"dormant_days": 60, "window_days": 3}}
    now = F.lit(seen).cast("timestamp_ntz")
    involved = patterns.involvement(patterns.all_patterns(spark.createDataFrame(rows, SCHEMA), owners, now, params))
    return {
        r.account_id: (round(0.25 * r.rule_score, 2), r.triggered_patterns)
        for r in risk.rule_scores(involved).collect() if r.account_id in touched
    }


def raised(spark, folder, batch):
    rows = spark.read.parquet(f"{folder}/alerts/batch_id={batch}").collect()
    return {r.account_id: (r.risk_score, r.triggered_patterns) for r in rows}


@pytest.mark.parametrize("seed, cuts, late, history", [(2, (60, 61, 150), 25, 0), (3, (), 10, 130)])
def test_alerts_equal_a_batch_run(spark, accounts, tmp_path, seed, cuts, late, history):
    """After every batch, late transfers and history included, in any split."""
    rows = sorted(made(seed), key=lambda r: r[1])
    rng = random.Random(seed)
    for _ in range(late):  # arrives when others already have
        i = rng.randrange(history, len(rows))
        rows.append(rows.pop(i))
    owners, folder = people(accounts), str(tmp_path)
    none = spark.createDataFrame([], "account_id string, gnn_fraud_prob double, ensemble_anomaly_score double")
    if history:
        sink.prime(folder, spark.createDataFrame(rows[:history], SCHEMA), RULES)
    write = sink.alert_writer(folder, owners, none, none, 0.0, RULES)
    bounds = [history, *cuts, len(rows)]
    kinds = set()
    for batch, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = rows[a:b]
        for _ in range(1 + (batch == 2)):  # one batch is repeated
            write(spark.createDataFrame(part, SCHEMA), batch)
        seen = max(r[1] for r in rows[:b])
        want = expected(spark, rows[:b], seen, owners, {x for r in part for x in r[2:4]})
        assert raised(spark, folder, batch) == want
        kinds |= {p for _, names in want.values() for p in names}
    assert kinds == set(patterns.PATTERNS)


@pytest.mark.parametrize("max_hop", [2, 3, 4, 5, 6])
def test_fresh_trails_are_those_with_a_fresh_transfer(spark, now, max_hop):
    rows = made(7, 60, 9, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    seen = F.lit(max(r[1] for r in rows)).cast("timestamp_ntz")
    fresh = {r[0] for r in rows if r[0] >= "t0050"}

    def turned(trail):
        ids = [s.txn_id for s in trail]
        at = ids.index(min(ids))
        return tuple(ids[at:] + ids[:at])

    want = [turned(r.steps) for r in cycles.trails(df, seen, max_hop, 1000).collect()]
    want = sorted(t for t in want if fresh & set(t))
    got = current.fresh_trails(df.withColumn("fresh", F.col("txn_id") >= "t0050"), max_hop).collect()
    assert sorted(turned(r.steps) for r in got) == want and all(r.cycle_length == len(r.steps) for r in got)
    assert want


def test_fresh_trails_with_every_key_hot(spark, monkeypatch):
    from moneytrail.functions import skew

    df = spark.createDataFrame(made(8, 50, 8, 40), SCHEMA).withColumn("fresh", F.col("txn_id") >= "t0040")
    want = sorted(sorted(s.txn_id for s in r.steps) for r in current.fresh_trails(df).collect())
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 1)
    assert sorted(sorted(s.txn_id for s in r.steps) for r in current.fresh_trails(df).collect()) == want


def test_what_expires_is_gone(spark, accounts, tmp_path):
    """A trail counts while all of it lies in the window, for accounts that later batches touch."""
    folder = str(tmp_path)
    none = spark.createDataFrame([], "account_id string, gnn_fraud_prob double, ensemble_anomaly_score double")
    write = sink.alert_writer(folder, people(accounts), none, none, 0.0, RULES)

    def batch(number, *rows):
        full = [(f"b{number}{i}", START + timedelta(hours=h), s, d, 900.0, "UPI", False) for i, (s, d, h) in enumerate(rows)]
        write(spark.createDataFrame(full, SCHEMA), number)
        return raised(spark, folder, number)

    assert batch(0, ("A02", "A05", 0)) == {}
    closed = {"A02": (20.0, ["CIRCULAR_ROUND_TRIP"]), "A05": (20.0, ["CIRCULAR_ROUND_TRIP"])}
    assert batch(1, ("A05", "A02", 5)) == closed
    assert batch(2, ("A02", "A08", 29)) == {"A02": closed["A02"]}
    assert batch(3, ("A02", "A08", 31)) == {}
    assert batch(4, ("A02", "A05", 28)) == closed  # late, and closes the rest of the old trail anew
    write(spark.createDataFrame([], SCHEMA), 5)
    assert batch(6, ("A05", "A08", 20)) == {"A05": closed["A05"]}  # late: time does not go back, so what expired stays so


def test_stored_tables_are_read_by_day(spark, tmp_path):
    rows = made(9, 40, 5, 200)
    current.keep(spark.createDataFrame(rows, SCHEMA), str(tmp_path), 0)
    seen = START + timedelta(hours=100)
    part = current.stored(spark, str(tmp_path), "transfers", seen - timedelta(hours=30), seen)
    days = {f.split("day=")[1][:10] for f in part.inputFiles()}
    assert len(days) <= 3 and {str(r.day) for r in part.select("day").distinct().collect()} == days
    assert current.stored(spark, str(tmp_path), "trails", START, seen).count() == 0

from collections import Counter

import pytest
from pyspark.sql import functions as F

from moneytrail.operators import patterns as P
from moneytrail.operators.cycles import circular

BIG = 2_000_000


def lengths(df):
    return Counter((r.anchor_account, r.cycle_length) for r in df.collect())


def test_triangle_is_reported_from_each_corner(transfers, now):
    rows = circular(transfers(("A", "B", 10, 10), ("B", "C", 10, 9), ("C", "A", 10, 8)), now).collect()
    assert sorted(r.anchor_account for r in rows) == ["A", "B", "C"]
    for r in rows:
        assert r.cycle_length == 3 and len(r.account_ids) == 4 and r.total_amount == 30
        assert r.account_ids[0] == r.account_ids[-1] == r.anchor_account


def test_cycles_need_no_time_order(transfers, now):
    assert circular(transfers(("A", "B", 1, 8), ("B", "A", 1, 10)), now).count() == 2


def test_a_transfer_is_used_once(transfers, now):
    assert lengths(circular(transfers(("A", "B", 1, 1), ("B", "A", 1, 2)), now)) == {("A", 2): 1, ("B", 2): 1}


def test_accounts_may_repeat(transfers, now):
    found = lengths(circular(transfers(("A", "B", 1, 1), ("B", "A", 1, 2), ("A", "C", 1, 3), ("C", "A", 1, 4)), now))
    assert found == {("A", 2): 2, ("A", 4): 2, ("B", 2): 1, ("B", 4): 1, ("C", 2): 1, ("C", 4): 1}


def test_parallel_transfers(transfers, now):
    found = Counter(r.cycle_length for r in circular(
        transfers(("A", "B", 1, 1), ("A", "B", 1, 2), ("B", "A", 1, 3), ("B", "A", 1, 4)), now).collect())
    assert found[2] == 8 and found[4] == 8


def test_self_transfers_close_trails(transfers, now):
    rows = circular(transfers(("A", "A", 1, 1), ("A", "A", 1, 2)), now).collect()
    assert sorted(r.txn_ids for r in rows) == [["t000", "t001"], ["t001", "t000"]]


def test_stale_leg_breaks_the_cycle(transfers, now):
    assert circular(transfers(("A", "B", 1, 100), ("B", "C", 1, 9), ("C", "A", 1, 8)), now).count() == 0


@pytest.mark.parametrize("max_hop", [2, 3, 4, 5, 6])
def test_cycles_against_brute_force(spark, transfers, now, max_hop):
    import random
    rng = random.Random(max_hop)
    edges = [(rng.choice("ABCDE"), rng.choice("ABCDE"), 1, 1 + i) for i in range(11)]
    df = transfers(*edges)
    listed = [(e[0], e[1], f"t{i:03d}") for i, e in enumerate(edges)]

    def walk(path):
        if len(path) >= 2 and path[-1][1] == path[0][0]:
            yield tuple(e[2] for e in path)
        if len(path) < max_hop:
            for e in listed:
                if e[0] == path[-1][1] and e not in path:
                    yield from walk(path + [e])

    expected = Counter(t for e in listed for t in walk([e]))
    assert Counter(tuple(r.txn_ids) for r in circular(df, now, max_hop).collect()) == expected


MIDS = [("S", "M1", BIG, 20), ("S", "M2", BIG, 20), ("M1", "D", 10, 10), ("M2", "D", 10, 10)]


def test_layering_through_two_accounts(transfers, now):
    pairs = P.layering_pairs(transfers(*MIDS), now, 1_000_000, 48)
    row = P.layering_of(pairs).collect()
    assert len(row) == 1 and row[0].intermediary_count == 2 and row[0].total_fan_out == 2 * BIG
    legs = {(r.intermediate_account, r.leg, r.txn_id) for r in P.layering_evidence(pairs, P.layering_of(pairs)).collect()}
    assert legs == {("M1", "fan_out", "t000"), ("M2", "fan_out", "t001"), ("M1", "converge", "t002"), ("M2", "converge", "t003")}


def test_busy_couples_that_never_follow_make_no_pairs(transfers, now, monkeypatch):
    """Two busy accounts with many payers and payees, all payouts before all receipts."""
    monkeypatch.setattr(P, "BUSY_PAIRS", 100)
    early = [(m, f"D{i}", 10, 30) for i in range(40) for m in ("M1", "M2")]
    late = [(f"S{i}", m, BIG, 20) for i in range(40) for m in ("M1", "M2")]
    assert P.layering(transfers(*early, *late), now).count() == 0
    follows = [("M1", "D0", 10, 10), ("M2", "D0", 10, 10)]
    assert P.layering(transfers(*early, *late, *follows), now).count() == 40


def test_layering_sums_over_pairs(transfers, now):
    row = P.layering(transfers(*MIDS, ("M1", "D", 5, 9)), now).head()
    assert row.total_fan_out == 3 * BIG and row.total_converge == 25


@pytest.mark.parametrize("change", [
    {0: ("S", "M1", 1_000_000, 20)},  # the floor is exclusive
    {2: ("M1", "D", 10, 20)},  # same instant
    {0: ("S", "M1", BIG, 47), 2: ("M1", "D", 10, -1)},  # after the evaluation time
])
def test_layering_bounds_are_strict(transfers, now, change):
    rows = [change.get(i, r) for i, r in enumerate(MIDS)]
    assert P.layering(transfers(*rows), now).count() == 0


def test_layering_needs_three_different_accounts(transfers, now):
    rows = [("S", "M1", BIG, 20), ("S", "M2", BIG, 20), ("M1", "S", 1, 10), ("M2", "S", 1, 10)]
    assert P.layering(transfers(*rows), now).count() == 0


def test_structuring_counts_sub_threshold_credits(transfers, now):
    small = [("X", "D", 49_999, h) for h in range(1, 5)] + [("Y", "D", 49_999, 5), ("Z", "D", 50_000, 6)]
    found = P.structuring(transfers(*small), now)
    row = found.collect()
    assert len(row) == 1 and row[0].transaction_count == 5 and row[0].sender_count == 2
    evidence = P.structuring_evidence(transfers(*small), found, now).orderBy("ts").collect()
    assert [r.txn_id for r in evidence] == ["t004", "t003", "t002", "t001", "t000"] and {r.sender_account for r in evidence} == {"X", "Y"}


def test_four_credits_are_no_structuring(transfers, now):
    assert P.structuring(transfers(*[("X", "D", 100, h) for h in range(1, 5)]), now).count() == 0


def test_a_detection_of_any_size_is_one_row(transfers, now):
    many = transfers(*[(f"X{i % 900}", "D", 100, i / 200) for i in range(3000)])
    found = P.structuring(many, now)
    assert [(r.transaction_count, r.sender_count) for r in found.collect()] == [(3000, 900)]
    assert P.structuring_evidence(many, found, now).select("txn_id").distinct().count() == 3000


def test_cents_do_not_drift(transfers, now):
    rows = [("X", "D", 0.1, 900 - i / 4) for i in range(3000)]
    found = P.structuring_sliding(transfers(*rows), now).head()
    assert (found.max_transaction_count, found.max_total_amount) == (96, 9.6)


def test_sliding_window_sees_bursts_long_ago(transfers, now):
    burst = [("X", "D", 100, 500 + h) for h in (0, 6, 12, 18, 23.9)]
    spread = [("X", "E", 100, 500 + h) for h in (0, 6, 12, 18, 24)]
    found = P.structuring_sliding(transfers(*burst, *spread), now).collect()
    assert [(r.destination_account, r.max_transaction_count, r.max_total_amount) for r in found] == [("D", 5, 500.0)]


def test_dormant_needs_both_sides_and_a_strict_ratio(transfers, accounts, now):
    old = {"account_age_days": 100}
    people = accounts(("A", old), ("B", old), ("C", old), ("D", old), "E")
    moves = transfers(
        ("Z", "A", 100, 5), ("A", "Z", 80, 4),  # forwards enough
        ("Z", "B", 100, 5),  # only receives
        ("C", "Z", 100, 5),  # only sends
        ("Z", "D", 100, 5), ("D", "Z", 75, 4),  # exactly the ratio
        ("Z", "E", 100, 5), ("E", "Z", 90, 4),  # too young
    )
    found = P.dormant_activation(moves, people, now, forward_ratio=0.75)
    assert [(r.account_id, r.forward_ratio) for r in found.collect()] == [("A", 0.8)]
    evidence = {(r.direction, r.counterparty, r.amount) for r in P.dormant_evidence(moves, found, now).collect()}
    assert evidence == {("incoming", "Z", 100.0), ("outgoing", "Z", 80.0)}


def test_strict_dormancy(transfers, now):
    day = 24
    moves = transfers(
        ("Z", "A", 100, 200 * day), ("A", "Z", 100, 190 * day),  # history with mean 100
        ("Z", "A", 600, 20 * day), ("A", "Y", 500, 19.5 * day),  # wakes up and forwards
        ("Z", "B", 100, 200 * day), ("Z", "B", 600, 20 * day),  # wakes up but keeps it
        ("Z", "C", 100, 60 * day), ("Z", "C", 600, 20 * day), ("C", "Y", 600, 19.9 * day),  # was not quiet long enough
    )
    found = P.dormant_strict(moves, now).collect()
    assert [(r.account_id, r.activation_amount, r.forwarded_amount, r.mean_before) for r in found] == [("A", 600, 500, 100)]


def test_profile_mismatch_includes_the_bound(transfers, accounts, now):
    people = accounts(("S", {"customer_category": "STUDENT"}), ("I", {}))
    moves = transfers(("X", "S", 500_000, 9000), ("X", "S", 499_999, 1), ("X", "I", 900_000, 1))
    found = P.profile_mismatch(moves, people, now)
    assert [(r.account_id, r.category, r.credit_count) for r in found.collect()] == [("S", "STUDENT", 1)]
    assert [(r.sender, r.amount) for r in P.profile_evidence(moves, found, now).collect()] == [("X", 500_000.0)]


def test_counts_and_involvement(transfers, accounts, now):
    moves = transfers(*MIDS, ("P", "Q", 1, 1), ("Q", "P", 1, 2))
    found = P.all_patterns(moves, accounts("S"), now)
    assert {r.pattern: r.detections for r in P.pattern_counts(found).collect()} == {
        "CIRCULAR_ROUND_TRIP": 2, "LAYERING": 1, "STRUCTURING": 0, "DORMANT_ACTIVATION": 0, "PROFILE_MISMATCH": 0, "TOTAL": 3,
    }
    rows = {(r.pattern, r.account_id): r["count"] for r in P.involvement(found).groupBy("pattern", "account_id").count().collect()}
    assert rows == {
        ("CIRCULAR_ROUND_TRIP", "P"): 2, ("CIRCULAR_ROUND_TRIP", "Q"): 2,
        **{("LAYERING", a): 1 for a in ("S", "M1", "M2", "D")},
    }
    behind = P.transfers_behind(found)
    marked = moves.withColumn("is_fraud", F.col("txn_id").isin("t000", "t004", "t099")).withColumn("fraud_type", F.lit("LAYERING"))
    scored = {r.pattern: r for r in P.detector_evaluation(marked, behind).collect()}
    assert scored["LAYERING"].precision == 0.25 and scored["LAYERING"].own_recall == 0.5
    assert scored["STRUCTURING"].precision == 0


def test_report_order(transfers, now):
    rows = P.ranked(P.layering(transfers(*MIDS, ("S", "M3", BIG, 20), ("M3", "E", 1, 5), ("M2", "E", 1, 5)), now),
                    "total_fan_out", ["destination_account"], limit=1).collect()
    assert [r.destination_account for r in rows] == ["D"]

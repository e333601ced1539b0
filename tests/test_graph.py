import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from moneytrail.operators import centrality as C
from moneytrail.operators import export, features, traverse
from moneytrail.operators.cycles import trails


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "account_id string")


def test_isolated_center_is_empty(spark, transfers, accounts):
    nodes, edges = traverse.neighbourhood(transfers(("A", "B", 1, 1)), accounts("A", "B", "X"), ids(spark, "X"), 2)
    assert nodes.count() == 0 and edges.count() == 0


def test_frontier_edges(spark, transfers, accounts):
    moves = transfers(("A", "B", 1, 1), ("A", "C", 1, 1), ("B", "C", 1, 1))
    for kind, n in (("induced", 3), ("reached", 2)):
        nodes, edges = traverse.neighbourhood(moves, accounts("A", "B", "C"), ids(spark, "A"), 1, edges=kind)
        assert nodes.count() == 3 and edges.count() == n


def test_depth_is_clamped_and_nodes_limited_on_request(spark, transfers, accounts):
    chain = "ABCDEFG"
    moves = transfers(*[(a, b, 1, 1) for a, b in zip(chain, chain[1:])])
    people = accounts(*chain)
    assert traverse.neighbourhood(moves, people, ids(spark, "A"), 9)[0].count() == 5
    assert traverse.neighbourhood(moves, people, ids(spark, "A"), 0)[0].count() == 2
    nodes, edges = traverse.neighbourhood(moves, people, ids(spark, "A"), 4, max_nodes=3)
    assert sorted(r.account_id for r in nodes.collect()) == ["A", "B", "C"] and edges.count() == 2


def test_paths_up_to_ten_transfers(spark, transfers, accounts):
    names = [f"N{i:02d}" for i in range(12)]
    moves = transfers(*[(a, b, 2, 1) for a, b in zip(names, names[1:])])
    pairs = spark.createDataFrame([("N00", "N10"), ("N00", "N11"), ("N05", "N04")], "source string, dest string")
    rows = traverse.fund_paths(moves, accounts(*names), pairs).collect()
    assert [(r.source, r.dest, r.path_length, r.total_amount) for r in rows] == [("N00", "N10", 10, 20)]
    assert rows[0].intermediate_accounts == names[1:10] and len(rows[0].nodes) == 11 and len(rows[0].edges) == 10
    assert [e.source for e in rows[0].edges] == names[:10]


def test_path_choice_is_repeatable(spark, transfers, accounts):
    moves = transfers(
        ("S", "C", 1, 1), ("S", "B", 1, 1), ("B", "D", 5, 1, "z"), ("B", "D", 7, 1, "a"), ("C", "D", 1, 1), ("S", "E", 1, 1)
    )
    pairs = spark.createDataFrame([("S", "D"), ("S", "E"), ("S", "S")], "source string, dest string")
    rows = {r.dest: r for r in traverse.fund_paths(moves, accounts(*"SBCDE"), pairs).collect()}
    assert [n.id for n in rows["D"].nodes] == ["S", "B", "D"] and rows["D"].edges[1].txn_id == "a"
    assert rows["E"].intermediate_accounts == [] and set(rows) == {"D", "E"}


def test_export_cleans_up(spark):
    nodes = spark.createDataFrame(
        [("A", 0.8, 100.0, 0.0), ("A", 0.8, 100.0, 0.0), ("B", None, None, None), ("", 0.5, 900.0, 100.0)],
        "id string, risk_score double, total_sent double, total_received double",
    )
    edges = spark.createDataFrame(
        [("t1", "A", "B", 50.0, True), ("t1", "A", "B", 50.0, True), ("t2", "A", "X", 200.0, False), (None, "B", "A", 100.0, None)],
        "txn_id string, src string, dst string, amount double, is_fraud boolean",
    ).withColumns({"txn_type": F.lit("UPI"), "ts": F.lit("2024-01-01").cast("timestamp_ntz")})
    drawn = {r.id: r for r in export.export_nodes(nodes).collect()}
    assert set(drawn) == {"A", "B"}
    # sizes refer to the largest volume before the row without an id went
    assert drawn["A"]["size"] == 26 and drawn["A"].risk_tier == "CRITICAL" and drawn["A"].risk_score == 80.0
    assert drawn["B"].risk_tier == "NONE" and drawn["B"].kyc_status == "UNKNOWN" and drawn["B"]["size"] == 20
    lines = {r.id: r for r in export.export_edges(edges, export.export_nodes(nodes)).collect()}
    assert set(lines) == {"t1", "B__A"}
    assert lines["t1"].width == 2.8 and lines["t1"].color == "#FF4757" and lines["B__A"].width == 4.5
    summary = export.export_summary(edges, export.export_nodes(nodes), export.export_edges(edges, export.export_nodes(nodes))).head()
    assert tuple(summary) == (2, 2, 2)
    assert '"data":{"id":"A"' in export.as_json(export.export_nodes(nodes).where("id = 'A'")).head()[0]


def test_sizes_without_volume(spark):
    nodes = spark.createDataFrame([("A",), ("B",)], "id string")
    assert {r["size"] for r in export.export_nodes(nodes).collect()} == {30}


def test_features_of_one_account(transfers, accounts, now):
    day = 24
    moves = transfers(
        ("A", "B", 100, 1 * day), ("A", "B", 100, 1 * day),  # equal in all but the id: counts once
        ("A", "C", 300, 7 * day),  # exactly a week ago: in the week before
        ("C", "A", 200, 40 * day), ("A", "A", 50, 2 * day),
    )
    row = features.account_features(moves, accounts(("A", {"account_type": "DORMANT"}), "B", "X"), now, only="A").collect()
    assert len(row) == 1
    r = row[0]
    assert (r.total_sent_30d, r.total_received_30d, r.txn_count_30d, r.unique_counterparties_30d) == (450, 50, 4, 3)
    amounts = [100, 300, 200, 50, 50]
    assert r.avg_txn_amount == pytest.approx(np.mean(amounts)) and r.std_txn_amount == pytest.approx(np.std(amounts))
    assert r.max_single_txn == 300 and r.velocity_7d == 2 / 2 and r.is_dormant_activated == 1
    assert r.days_since_last_txn == 1 and r.sent_received_ratio == pytest.approx(450 / 51) and r.night_txn_ratio == 1.0


def test_inactive_account_has_zeros(transfers, accounts, now):
    r = features.account_features(transfers(("A", "B", 1, 1)), accounts("X"), now).head()
    assert (r.total_sent_30d, r.txn_count_30d, r.avg_txn_amount, r.velocity_7d, r.days_since_last_txn) == (0, 0, 0, 0, None)


def test_degrees_count_a_two_way_neighbour_twice(transfers, accounts):
    d = features.degrees(transfers(("A", "B", 1, 1), ("A", "B", 1, 2), ("B", "A", 1, 3)), accounts("A", "X"))
    assert {r.account_id: (r.in_degree, r.out_degree, r.degree) for r in d.collect()} == {"A": (1, 1, 2), "X": (0, 0, 0)}
    assert sum(r.degree_share_rank for r in features.degree_share_rank(d).collect()) == pytest.approx(1)


def test_standardise(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0), ("c", None, 5.0)], "account_id string, x double, y double")
    rows = {r.account_id: r for r in features.standardise(df, ["x", "y"]).collect()}
    x = np.array([1.0, 3.0, 0.0])
    assert [rows[k].x for k in "abc"] == pytest.approx(list((x - x.mean()) / x.std())) and {r.y for r in rows.values()} == {0.0}


def test_labels(transfers, accounts):
    moves = transfers(("A", "B", 1, 1), ("C", "D", 1, 1)).withColumn("is_fraud", F.col("src") == "A")
    rows = {r.account_id: r.is_fraud for r in features.fraud_labels(moves, accounts(*"ABCD")).collect()}
    assert rows == {"A": True, "B": True, "C": False, "D": False}


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(5)
    names = [f"n{i:02d}" for i in range(14)]
    pairs = sorted({(rng.choice(names[:11]), rng.choice(names[:12])) for _ in range(34)})
    return names, pairs


def test_page_rank(graph, transfers, accounts):
    names, pairs = graph
    n, at = len(names), {x: i for i, x in enumerate(names)}
    out = {x: sum(a == x for a, _ in pairs) for x in names}
    r = np.full(n, 1 / n)
    for _ in range(20):
        new = np.full(n, 0.15 / n)
        for a, b in pairs:
            new[at[b]] += 0.85 * r[at[a]] / out[a]
        new += 0.85 * sum(r[at[x]] for x in names if not out[x]) / n
        r = new
    moves = transfers(*[(a, b, 1, i + 1) for i, (a, b) in enumerate(pairs)], (*pairs[0], 1, 99), ("n00", "stranger", 1, 1))
    got = {x.account_id: x.pagerank_score for x in C.page_rank(moves, accounts(*names)).collect()}
    assert [got[x] for x in names] == pytest.approx(list(r), abs=1e-12)


def brute_betweenness(names, pairs):
    out = {x: sorted({b for a, b in pairs if a == x and b != x}) for x in names}
    total = dict.fromkeys(names, 0.0)
    for s in names:
        dist, count, order, before = {s: 0}, {s: 1}, [], {x: [] for x in names}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    count[w] = 0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += count[v] / count[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    n = len(names)
    return [total[x] / ((n - 1) * (n - 2)) for x in names]


def test_betweenness_is_exact_with_all_starts(graph, transfers, accounts):
    names, pairs = graph
    moves = transfers(*[(a, b, 1, 1) for a, b in pairs])
    for samples in (None, 100):
        got = {r.account_id: r.betweenness_centrality for r in C.betweenness(moves, accounts(*names), samples).collect()}
        assert [got[x] for x in names] == pytest.approx(brute_betweenness(names, pairs), abs=1e-12)


def test_betweenness_sample_is_scaled(graph, transfers, accounts):
    names, pairs = graph
    rows = C.betweenness(transfers(*[(a, b, 1, 1) for a, b in pairs]), accounts(*names), 5).collect()
    assert len(rows) == len(names) and all(r.betweenness_centrality >= 0 for r in rows)


def test_clustering(graph, transfers, accounts):
    names, pairs = graph
    near = {x: {b for a, b in pairs if a == x} | {a for a, b in pairs if b == x} for x in names}
    for x in names:
        near[x].discard(x)
    def share(x):
        k = len(near[x])
        linked = sum(b in near[a] for a in near[x] for b in near[x] if a < b)
        return 2 * linked / (k * (k - 1)) if k > 1 else 0.0
    got = {r.account_id: r.clustering_coefficient for r in C.clustering(transfers(*[(a, b, 1, 1) for a, b in pairs]), accounts(*names)).collect()}
    assert [got[x] for x in names] == pytest.approx([share(x) for x in names])


def test_cycle_membership(transfers, accounts, now):
    moves = transfers(("A", "B", 1, 1), ("B", "A", 1, 2), ("B", "C", 1, 3), ("C", "A", 1, 4), ("C", "D", 1, 5))
    rows = {r.account_id: (r.is_in_cycle, r.max_cycle_length) for r in C.cycle_membership(trails(moves, now), accounts(*"ABCD")).collect()}
    assert rows == {"A": (1, 3), "B": (1, 3), "C": (1, 3), "D": (0, 0)}


def test_hops_to_flagged(transfers, accounts):
    moves = transfers(("F", "A", 1, 1), ("B", "A", 1, 1), ("C", "B", 1, 1), ("X", "Y", 1, 1))
    rows = C.hops_to_flagged(moves, accounts(("F", {"is_flagged": True}), *"ABCX"))
    assert {r.account_id: r.hop_count_to_flagged for r in rows.collect()} == {"F": 0, "A": 1, "B": 2, "C": 3, "X": None}


def one_sided(edges, pairs, most):
    """Breadth first from every source; every account is entered from the least one of the level before."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for source, dest in pairs:
        before, level, hop = {source: None}, {source}, 0
        while dest not in before and level and hop < most:
            hop += 1
            entered = {}
            for a in sorted(level, reverse=True):
                entered.update({b: a for b in after.get(a, ()) if b not in before})
            before |= entered
            level = set(entered)
        if source != dest and dest in before:
            path = [dest]
            while path[0] != source:
                path.insert(0, before[path[0]])
            out[source, dest] = path
    return out


@pytest.mark.parametrize("seed, nodes, links, most", [(1, 30, 60, 10), (2, 60, 90, 10), (3, 40, 50, 4), (4, 12, 60, 10), (5, 50, 75, 1)])
def test_paths_from_both_ends_equal_those_from_one(spark, seed, nodes, links, most):
    """Sparse and dense graphs, many pairs of one source or one destination, pairs without a path, ties everywhere."""
    rng = random.Random(seed)
    names = [f"N{i:02d}" for i in range(nodes)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(links)}
    edges = {(a, b) for a, b in edges if a != b}
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(60)} | {(names[0], n) for n in names} | {(n, names[1]) for n in names}
    table = spark.createDataFrame(sorted(edges), "src string, dst string")
    found = traverse.shortest_paths(table, spark.createDataFrame(sorted(pairs), "source string, dest string"), most).collect()
    assert {(r.source, r.dest): r.accounts for r in found} == one_sided(edges, pairs, most) and len(found) == len({(r.source, r.dest) for r in found})
    assert all(r.path_length == len(r.accounts) - 1 for r in found)

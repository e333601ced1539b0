"""Steps that must hold on tables of millions of rows, seen from their plans and from small tables taken as large ones."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from test_graph import brute_betweenness

from moneytrail import scratch
from moneytrail.operators import anomaly, explain
from moneytrail.operators import centrality as C
from moneytrail.operators import neighbours as N
from moneytrail.operators import traverse as T
from moneytrail.plans import queries
from moneytrail.streaming import history, inbox, sink


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(monkeypatch):
    """Every table counts as too large to be broadcast."""
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 0)


def test_clustering_broadcasts_no_table_of_pairs(large, transfers, accounts):
    moves = transfers(("A", "B", 1, 1), ("B", "C", 1, 2), ("C", "A", 1, 3), ("C", "D", 1, 4))
    found = C.clustering(moves, accounts(*"ABCDX"))
    assert "BroadcastHashJoin" not in plan(found)
    assert {r.account_id: round(r.clustering_coefficient, 6) for r in found.collect()} == {
        "A": 1.0, "B": 1.0, "C": 0.333333, "D": 0.0, "X": 0.0
    }


@pytest.mark.parametrize("rows", [0, 100_000])
def test_betweenness_adds_levels_up_before_it_looks_for_known_accounts(spark, transfers, accounts, monkeypatch, rows):
    """Without an anti-join, which the optimizer moves below the sums; exact whether arcs are broadcast or not."""
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", rows)
    plans, store = [], C.materialize_counted
    monkeypatch.setattr(C, "materialize_counted", lambda df, name: (plans.append((name, plan(df))), store(df, name))[1])
    rng = random.Random(7)
    names = [f"n{i:02d}" for i in range(12)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(30)})
    found = C.betweenness(transfers(*[(a, b, 1, 1) for a, b in pairs]), accounts(*names), None).collect()
    assert [r.betweenness_centrality for r in sorted(found)] == pytest.approx(brute_betweenness(names, pairs), abs=1e-12)
    steps = [p for name, p in plans if name == "between-level"]
    assert len(steps) > 2 and not any("LeftAnti" in p for p in steps)


def test_feature_matrix_takes_betweenness_from_all_starts(spark, monkeypatch):
    chosen = []
    kept = C.betweenness

    def noted(transfers, accounts, samples=C.SAMPLES, seed=42, starts=None):
        chosen.append((samples, starts))
        return kept(transfers, accounts, samples, seed, starts)

    monkeypatch.setattr(C, "betweenness", noted)
    assert queries.full_matrix(spark, SMALL).count() == 150
    assert chosen == [(None, None)]


@pytest.mark.parametrize("columns", [5, 70])
def test_walks_through_a_forest_take_only_trees_that_turn(columns):
    """The same mean paths as walking every tree at every step, with fewer rows walked."""
    rng = np.random.RandomState(3)
    x = np.round(rng.gamma(1, size=(200, columns)), 1)
    rows = [(t, *r) for t in range(30) for r in anomaly._grow(x[rng.choice(200, 64, replace=False)], 6, rng)]
    table = pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "low", "high", "path"])
    forest = anomaly.Forest(SimpleNamespace(toPandas=lambda: table))
    walk, walked = anomaly.Walk(forest, x, x[7]), []
    down = walk._down
    walk._down = lambda rows, *rest: (walked.append(len(rows)), down(rows, *rest))[1]
    for order in (list(rng.permutation(columns)), list(range(columns))):
        mixed, steps = np.tile(x[7], (len(x), 1)), list(walk.mean_paths(order))
        assert [j for j, _ in steps] == order
        for j, paths in steps:
            mixed[:, j] = x[:, j]
            assert (paths == forest.mean_paths(mixed)).all()
    assert sum(walked) < columns * len(x) * 30


def test_neighbourhoods_store_sets_and_not_a_row_per_account(spark, transfers, accounts, monkeypatch):
    """Accounts that share receivers: the levels of the search stay far smaller than the neighbourhoods."""
    stored, store = [], T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name: (stored.append((name, store(df, name))), stored[-1][1])[1])
    monkeypatch.setattr(scratch, "materialize", T.materialize)
    rng = random.Random(11)
    names = [f"n{i:03d}" for i in range(600)]
    pairs = sorted({(a, f"r{rng.randrange(6)}") for a in names for _ in range(3)}) + [("n000", "n000"), ("n001", "x"), ("x", "y"), ("y", "z"), ("u", "v")]
    people, centers = [*names, *(f"r{i}" for i in range(6)), "x", "y", "alone", "u"], [*names[:20], "r1", "x", "alone", "u"]
    links = {}
    for a, b in pairs:
        if a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    moves, known = transfers(*[(a, b, 1, 1) for a, b in pairs]), set(people)
    chosen = spark.createDataFrame([(c,) for c in centers], "account_id string")
    for depth in (1, 2, 4):
        stored.clear()
        nodes, _ = T.neighbourhood(moves, accounts(*people), chosen, depth)
        want = set()
        for c in centers:
            hops, edge = {c: 0}, {c}
            for hop in range(1, depth + 1):
                edge = {b for a in edge for b in links.get(a, ())} - set(hops)
                hops |= dict.fromkeys(edge, hop)
            want |= {(c, a, h) for a, h in hops.items() if a in known} if c in links else set()
        found = [(r.center, r.account_id, r.hop) for r in nodes.collect()]
        assert len(found) == len(want) and set(found) == want
        levels = sum(df.count() for name, df in stored if name == "frontier")
        assert depth == 1 or levels < len(want) / 10


def test_history_of_accounts_is_added_up_without_python(spark):
    """Only one that expires is kept by a processor."""
    events = inbox.event_time(queries.one_feed(sink.state_session(spark, 2), SMALL))
    native, expiring = history.account_history(events), history.account_history(events, 10**9)
    planned = [df._jdf.queryExecution().analyzed().toString() for df in (native, expiring)]
    assert ["InPandas" in p or "InPySpark" in p for p in planned] == [False, True]
    assert native.dtypes == expiring.dtypes
    kept = history.merged(sink.collect_stream(native, "update")).collect()
    assert sum(r.transfers for r in kept) == 1000 and len({r.src for r in kept}) == len(kept)


def test_state_partitions_grow_with_the_events(spark, monkeypatch):
    """And the windows found do not depend on their number."""
    few = queries.stream_structuring(spark, SMALL)
    monkeypatch.setattr(sink, "STATE_ROWS", 160)
    sessions, start = [], sink.state_session
    monkeypatch.setattr(sink, "state_session", lambda *args, **options: (sessions.append(start(*args, **options)), sessions[-1])[1])
    many = queries.stream_structuring(spark, SMALL)
    # 1000 events over two feeds
    assert [s.conf.get("spark.sql.shuffle.partitions") for s in sessions] == ["13"]
    rows = sorted(map(tuple, few.collect()))
    assert rows and rows == sorted(map(tuple, many.collect()))


@pytest.fixture
def grown():
    """A forest over rounded values, of which some are equal to thresholds' neighbours, and its rows."""
    rng = np.random.RandomState(3)
    x = np.round(rng.gamma(1, size=(200, 6)), 1)
    rows = [(t, *r) for t in range(30) for r in anomaly._grow(x[rng.choice(200, 64, replace=False)], 6, rng)]
    table = pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "low", "high", "path"])
    return table, anomaly.Forest(SimpleNamespace(toPandas=lambda: table)), x


@pytest.mark.parametrize("late", [1, 400])
def test_mixtures_are_those_of_the_walked_trees(grown, monkeypatch, late):
    """After every step of every order, with features that come in together and steps at which none does."""
    _, forest, x = grown
    monkeypatch.setattr(anomaly.Mixtures, "ROWS", 77)
    monkeypatch.setattr(anomaly.Mixtures, "ORDERS", 3)
    rng = np.random.RandomState(5)
    ranks = np.array([*(rng.permutation(6) + 1 for _ in range(4)), [1, 1, 2, 2, 6 * late, 3]])
    behind = x[rng.choice(200, 5)]
    seen = np.zeros((200, 5, 6 * late + 1), dtype=int)
    for rows, orders, paths in anomaly.Mixtures(forest, ranks, behind).mean_paths(x):
        seen[rows, orders] += 1
        for n, step in np.ndindex(paths.shape[1:]):
            if step < 8 or step == 6 * late:
                own = ranks[orders][n] <= step
                assert np.allclose(paths[:, n, step], forest.mean_paths(np.where(own, x[rows], behind[orders][n])), rtol=0, atol=1e-9)
    assert (seen == 1).all()


def test_mixtures_without_a_turn_are_exactly_equal(grown):
    """Sums of paths don't differ by rounding, so a feature that changes nothing has the share 0."""
    _, forest, x = grown
    orders = np.array([[1, 2, 3, 4, 5, 6], [6, 5, 4, 3, 2, 1]])
    for _, _, paths in anomaly.Mixtures(forest, orders, x[[7, 7]]).mean_paths(x[[7, 7]]):
        assert (paths == paths[:, :, :1]).all()


def test_rows_without_a_feature_are_those_of_the_walked_trees(grown):
    _, forest, x = grown
    walk, walked = anomaly.Walk(forest, x, np.zeros(6)), []
    down = walk._down
    walk._down = lambda rows, *rest: (walked.append(len(rows)), down(rows, *rest))[1]
    full, *without = walk.without()
    assert (full == forest.mean_paths(x)).all()
    for j, paths in enumerate(without):
        assert (paths == forest.mean_paths(np.where(np.arange(6) == j, 0, x))).all()
    assert sum(walked) < 5 * len(x) * 30


@pytest.mark.parametrize("explained", [explain.forest_contributions, explain.explain_forest])
def test_forests_are_explained_in_many_tasks(spark, grown, monkeypatch, explained):
    """However few files hold the accounts; equal accounts are walked once."""
    table, _, x = grown
    columns = [f"f{i}" for i in range(6)]
    rows = np.concatenate([x] * 5)
    df = spark.createDataFrame(pd.DataFrame(rows, columns=columns).assign(account_id=[f"p{i:04d}" for i in range(1000)])).coalesce(1)
    found = explained(df, spark.createDataFrame(table, anomaly.TREE_SCHEMA), columns, 64)
    assert found.rdd.getNumPartitions() == 4
    got = {r.account_id: tuple(r)[1:] for r in found.collect()}
    assert len(got) == 1000 and all(got[f"p{i:04d}"] == got[f"p{i % 200:04d}"] for i in range(1000))


def test_neighbours_store_no_table_of_candidates(spark, monkeypatch):
    """Independent features, where cells exclude little: what is stored grows with the sites and not with their pairs."""
    stored, store = [], N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, name: (stored.append(store(df, name)), stored[-1])[1])
    rng = np.random.default_rng(4)
    sites = spark.createDataFrame([(f"s{i:03d}", int(w), v.tolist()) for i, (w, v) in enumerate(zip(rng.integers(1, 4, 600), rng.normal(size=(600, 21))))], "site string, weight bigint, v array<double>")
    found = N.nearest(sites, 5, pivots=12, chunk=50).toPandas()
    assert found["site"].nunique() == 600 and stored and sum(df.count() for df in stored) <= 2 * 600


@pytest.mark.parametrize("kind", ["independent", "clusters", "grid", "far", "tails"])
def test_neighbours_in_blocks_are_those_of_all_pairs(kind):
    """Bit for bit, with ties by name, for sites that come in batches of any size."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 4))
    if kind == "clusters":
        v = np.repeat(v[:20], 20, axis=0) + rng.normal(size=(400, 4)) * 10.0 ** rng.integers(-16, -6, (400, 1))
    elif kind == "grid":
        v = np.array(list(np.ndindex(5, 5, 4, 4)), dtype=float)[rng.permutation(400)]
    elif kind == "far":
        v = v * 1e-3 + 1e8
    elif kind == "tails":
        v = np.sign(v) * rng.pareto(0.5, size=(400, 4))
    weight, names, nth = rng.integers(1, 4, 400), np.array([f"s{i:03d}" for i in range(400)], dtype=object), np.arange(400)
    d, k = N.distances(v, v), 7
    lists = N.Lists(v[:150], nth[:150], k, 16)
    parts = np.split(rng.permutation(400), [3, 120, 121])
    for part in parts[:2]:
        lists.meet(v[part], nth[part], weight[part], names[part])
    again, held = N.Lists(v[:150], nth[:150], k, 16), lists.columns()
    again.resume(lists.reach, np.array([len(x) for x in held["names"]]), *(np.concatenate(held[c]) for c in ("distances", "numbers", "weights", "names")))
    for part in parts[2:]:
        again.meet(v[part], nth[part], weight[part], names[part])
    got = again.columns()
    for i in range(150):
        order = sorted(range(400), key=lambda j: (j != i, d[i, j], j))
        ends = int(np.searchsorted(np.cumsum(weight[order]), k + 1)) + 1
        assert got["names"][i].tolist() == names[order[:ends]].tolist() and got["distances"][i].tolist() == d[i, order[:ends]].tolist()


def broadcasts(plan_text):
    """What a plan broadcasts, each as the lines below it."""
    lines = plan_text.split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_anomaly_scores_broadcast_no_table_of_accounts(spark, monkeypatch):
    """Many accounts that share a few sites: tables of sites may be broadcast, those of accounts not."""
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 200)
    plans, store = {}, anomaly.materialize
    monkeypatch.setattr(anomaly, "materialize", lambda df, name: (plans.update({name: plan(df)}), store(df, name))[1])
    kinds = np.random.default_rng(2).normal(size=(20, 3))
    rows = pd.DataFrame(np.repeat(kinds, 20, axis=0), columns=["a", "b", "c"]).assign(account_id=[f"p{i:03d}" for i in range(400)])
    scored, _ = anomaly.detect(spark.createDataFrame(rows), ["a", "b", "c"], trees=5, k=5)
    assert scored.count() == 400
    sent = list(broadcasts(plans["anomaly-scores"]))
    assert not any("lof-input" in text or "MapInPandas" in text for text in sent) and "SortMergeJoin" in plans["anomaly-scores"]


def test_betweenness_broadcasts_no_table_of_names(large, transfers, accounts, monkeypatch):
    plans, store = {}, C.materialize_counted
    monkeypatch.setattr(C, "materialize_counted", lambda df, name: (plans.update({name: plan(df)}), store(df, name))[1])
    C.betweenness(transfers(("A", "B", 1, 1), ("B", "C", 1, 2), ("C", "D", 1, 3)), accounts(*"ABCD"), None).collect()
    assert "SortMergeJoin" in plans["between-sums"] and "BroadcastHashJoin" not in plans["between-sums"]

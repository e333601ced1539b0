import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from moneytrail.functions.ranking import exact_quantile, roc_auc, running_total, smallest_hashes
from moneytrail.operators import anomaly, explain, nodeclf
from moneytrail.operators.neighbours import nearest, sites


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.RandomState(3)
    x = np.vstack([rng.normal(size=(120, 3)), rng.normal(size=(40, 3)) * 4 + 6, np.tile([1.0, 2.0, 3.0], (60, 1)), [[25.0, -20.0, 30.0]]])
    return pd.DataFrame(x, columns=["a", "b", "c"]).assign(account_id=[f"p{i:03d}" for i in range(len(x))])


@pytest.fixture(scope="module")
def points(spark, cloud):
    return spark.createDataFrame(cloud)


def test_running_total_and_quantile(spark):
    rng = np.random.RandomState(1)
    values = np.round(rng.normal(size=101), 1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, v double")
    placed = {r.id: r.before for r in running_total(df, ["v", "id"], F.lit(1)).collect()}
    order = sorted(range(101), key=lambda i: (values[i], i))
    assert [placed[i] for i in order] == list(range(101))
    for q in (0.0, 0.08, 0.5, 0.77, 1.0):
        assert exact_quantile(df, "v", q) == pytest.approx(np.percentile(values, 100 * q))


def test_auc(spark):
    rng = np.random.RandomState(2)
    p, y = np.round(rng.rand(200), 1), rng.rand(200) < 0.3
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(p, y)], "p double, y boolean")
    wins = sum((a > b) + 0.5 * (a == b) for a in p[y] for b in p[~y])
    assert roc_auc(df, "p", "y") == pytest.approx(wins / (y.sum() * (~y).sum()))
    assert roc_auc(df.where("y"), "p", "y") == 0.5


def test_metrics_without_positives(spark):
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "account_id string, gnn_fraud_prob double")
    labels = spark.createDataFrame([("a", False)], "account_id string, is_fraud boolean")
    assert {r.metric: r.value for r in nodeclf.metrics(scores, labels).collect()} == {"auc_roc": 0.5, "precision": 0, "recall": 0}


def test_split_is_stratified_and_repeatable(spark):
    labels = spark.range(100).select(F.format_string("a%03d", "id").alias("account_id"), (F.col("id") < 20).alias("is_fraud"))
    first = {r.account_id: r for r in nodeclf.stratified_split(labels).collect()}
    assert sum(r.is_validation for r in first.values() if r.is_fraud) == 4
    assert sum(r.is_validation for r in first.values() if not r.is_fraud) == 16
    again = {r.account_id: r for r in nodeclf.stratified_split(labels.repartition(7)).collect()}
    assert first == again
    assert nodeclf.class_weights(labels) == (1.0, 4.0)
    assert nodeclf.class_weights(labels.where("not is_fraud")) == (1.0, 1.0)


def test_nearest_matches_brute_force(points, cloud):
    all_sites = sites(points, ["a", "b", "c"])
    stored = all_sites.toPandas()
    x = np.stack(stored["v"])
    d = np.sqrt(sum((x[:, j, None] - x[None, :, j]) ** 2 for j in range(3)))
    k = 5
    for pivots, chunk in ((1, 2000), (6, 2000), (12, 7)):
        got = nearest(all_sites, k, pivots, chunk).toPandas()
        for i, site in enumerate(stored["site"]):
            own = got[got["site"] == site].sort_values("place")
            order = sorted(range(len(x)), key=lambda j: (j != i, d[i, j], stored["site"][j]))
            total, expected = 0, []
            for j in order:
                if total >= k + 1:
                    break
                expected.append(stored["site"][j])
                total += stored["weight"][j]
            assert list(own["neighbour"]) == expected


def test_lof_matches_its_definition(points, cloud):
    x = cloud[["a", "b", "c"]].to_numpy()
    n, k = len(x), 20
    d = np.sqrt(sum((x[:, j, None] - x[None, :, j]) ** 2 for j in range(3)))
    names = list(cloud["account_id"])
    first = {}
    for i in range(n):
        first.setdefault(tuple(x[i]), names[i])
    place = [first[tuple(v)] for v in x]
    def order(i, keep_self):
        others = [j for j in range(n) if keep_self or j != i]
        return sorted(others, key=lambda j: (place[j] != place[i], d[i, j], place[j], names[j]))[:k]
    train = [order(i, False) for i in range(n)]
    far = np.array([max(d[i, j] for j in train[i]) for i in range(n)])
    density = lambda i, near: 1 / (np.mean([max(d[i, j], far[j]) for j in near]) + 1e-10)
    fitted = [density(i, train[i]) for i in range(n)]
    expected = []
    for i in range(n):
        near = order(i, True)
        expected.append(-np.mean([fitted[j] for j in near]) / density(i, near))
    got = {r.account_id: r.lof_score for r in anomaly.lof(points, ["a", "b", "c"], k, pivots=5).collect()}
    assert [got[a] for a in names] == pytest.approx(expected, rel=1e-9)


def test_forest_finds_the_outlier_and_is_repeatable(spark, points, cloud):
    columns = ["a", "b", "c"]
    forest = anomaly.fit_forest(points, columns, trees=50)
    drawn = min(anomaly.SAMPLE, len(cloud))
    scores = anomaly.score_forest(points, forest, columns, drawn).toPandas().set_index("account_id")["iso_score"]
    assert scores.idxmin() == "p220" and scores.between(-1, 0).all()
    again = anomaly.score_forest(points.repartition(5), anomaly.fit_forest(points.repartition(3), columns, trees=50), columns, drawn)
    assert again.toPandas().set_index("account_id")["iso_score"].sort_index().equals(scores.sort_index())


def test_forest_paths_by_hand(spark):
    # one split at 0.5: a leaf with one row and a leaf with three
    rows = [(0, 0, 0, 0.5, 1, 2, 0.0), (0, 1, -1, 0.0, -1, -1, 1.0), (0, 2, -1, 0.0, -1, -1, 1 + anomaly.mean_path(3))]
    trees = spark.createDataFrame(rows, anomaly.TREE_SCHEMA)
    x = spark.createDataFrame([("l", 0.0), ("r", 1.0)], "account_id string, a double")
    got = {r.account_id: r.iso_score for r in anomaly.score_forest(x, trees, ["a"], 4).collect()}
    c = 2 * (math.log(3) + np.euler_gamma) - 2 * 3 / 4
    assert got == pytest.approx({"l": -(2 ** (-1 / c)), "r": -(2 ** (-(1 + anomaly.mean_path(3)) / c))})


def test_ensemble(spark):
    df = spark.createDataFrame(
        [("a", -0.9, -9.0), ("b", -0.5, -1.0), ("c", -0.4, -1.0)], "account_id string, iso_score double, lof_score double"
    )
    rows = {r.account_id: r for r in anomaly.ensemble(df).collect()}
    assert rows["a"].ensemble_anomaly_score == pytest.approx(1.0) and rows["a"].ensemble_is_anomaly and rows["a"].iso_is_anomaly
    assert rows["c"].ensemble_anomaly_score == 0.0 and not rows["b"].lof_is_anomaly
    flat = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 1.0)], "account_id string, iso_score double, lof_score double")
    assert {r.ensemble_anomaly_score for r in anomaly.ensemble(flat).collect()} == {0.0}


def test_sage_inference_against_numpy(spark, transfers, accounts):
    rng = np.random.RandomState(7)
    names = [f"n{i}" for i in range(6)]
    pairs = [("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n3", "n1"), ("n4", "n4")]
    moves = transfers(*[(a, b, 1, 1) for a, b in pairs])
    x = rng.normal(size=(6, 3))
    shapes, weights, before = (5, 4, 2), {}, 3
    for n, size in enumerate(shapes, 1):
        weights[f"conv{n}.lin_l.weight"], weights[f"conv{n}.lin_r.weight"] = rng.normal(size=(2, size, before))
        weights[f"conv{n}.lin_l.bias"] = rng.normal(size=size)
        if n < 3:
            for part in ("weight", "bias", "running_mean"):
                weights[f"bn{n}.{part}"] = rng.normal(size=size)
            weights[f"bn{n}.running_var"] = rng.rand(size) + 0.5
        before = size
    weights["classifier.weight"], weights["classifier.bias"] = rng.normal(size=(2, 2)), rng.normal(size=2)
    linked = [(names.index(a), names.index(b)) for a, b in pairs] + [(i, i) for i in range(6)]
    h = x
    for n in (1, 2, 3):
        mean = np.array([np.mean([h[a] for a, b in linked if b == i], axis=0) for i in range(6)])
        h = mean @ weights[f"conv{n}.lin_l.weight"].T + weights[f"conv{n}.lin_l.bias"] + h @ weights[f"conv{n}.lin_r.weight"].T
        if n < 3:
            h = (h - weights[f"bn{n}.running_mean"]) / np.sqrt(weights[f"bn{n}.running_var"] + 1e-5) * weights[f"bn{n}.weight"] + weights[f"bn{n}.bias"]
        h = np.maximum(h, 0)
    logits = h @ weights["classifier.weight"].T + weights["classifier.bias"]
    p = np.exp(logits[:, 1]) / np.exp(logits).sum(axis=1)

    table = spark.createDataFrame([(k, list(v.shape), [float(z) for z in v.ravel()]) for k, v in weights.items()],
                                  "name string, shape array<int>, values array<double>")
    matrix = spark.createDataFrame([(a, *map(float, row)) for a, row in zip(names, x)], "account_id string, a double, b double, c double")
    neighbours = nodeclf.Neighbours(moves, accounts(*names))
    got = {r.account_id: r for r in nodeclf.sage_inference(matrix, neighbours, nodeclf.read_weights(table), ["a", "b", "c"]).collect()}
    assert [got[a].gnn_fraud_prob for a in names] == pytest.approx(list(p))
    assert np.allclose([got[a].embedding for a in names], h)


def test_projection(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(40, 3)) * [5, 2, 0.1]
    df = spark.createDataFrame([(f"a{i:02d}", *map(float, v)) for i, v in enumerate(x)], "account_id string, a double, b double, c double")
    got = {r.account_id: r for r in nodeclf.project_2d(df, ["a", "b", "c"]).collect()}
    centred = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    expected = centred @ np.array([v * np.sign(v[np.argmax(abs(v))]) for v in vt[:2]]).T
    assert np.allclose([[got[f"a{i:02d}"].gnn_embed_x, got[f"a{i:02d}"].gnn_embed_y] for i in range(40)], expected)


def test_linear_explanations_add_up(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 3.0, 4.0)], "account_id string, x double, y double")
    rows = {r.account_id: r.explanation for r in explain.explain_linear(df, {"x": {"x": 2.0}, "y": {"y": -1.0}}).collect()}
    assert [(e.rank, e.feature, e.shap_value, e.direction) for e in rows["b"]] == [
        (1, "x", 2.0, "increases_risk"), (2, "y", -2.0, "decreases_risk")]
    assert rows["b"][0].readable == "x = 3.00 (increases risk)"


def test_phrases(spark):
    df = spark.createDataFrame([("velocity_7d", 10.5, True), ("velocity_7d", 12.5, False), ("other", -0.125, True)], "f string, v double, up boolean")
    said = [r[0] for r in df.select(explain.readable(F.col("f"), F.col("v"), F.col("up"))).collect()]
    assert said == ["Transaction velocity is 10 (increases risk)", "Transaction velocity is 12 (decreases risk)", "other = -0.12 (increases risk)"]


def test_narrative(spark):
    df = spark.createDataFrame(
        [("A", 80.4, "CRITICAL", ["LAYERING", "OTHER"], 0.9, 0.2, "Account age is 99 (increases risk)"), ("B", 10.0, "LOW", [], 0.1, 0.75, None)],
        "account_id string, risk_score double, risk_tier string, triggered_patterns array<string>, gnn_fraud_prob double, anomaly_score double, gnn_top string",
    )
    said = {r.account_id: r.narrative for r in explain.narrative(df).collect()}
    assert said["A"] == (
        "Account A is flagged CRITICAL (score: 80/100). The GNN model detected structural risk (fraud probability: 90%). "
        "Top signal: Account age is 99 (increases risk). AML patterns triggered: fund layering through intermediaries, OTHER. "
        "Recommendation: Freeze account immediately and file STR with FIU-IND."
    )
    assert said["B"] == "Account B is flagged LOW (score: 10/100). Anomaly detection score: 0.75 — behavioral patterns deviate significantly from baseline."


def test_forest_explanation_names_the_odd_feature(spark, points, cloud):
    columns = ["a", "b", "c"]
    centred = points.select("account_id", *[(F.col(c) - float(cloud[c].mean())).alias(c) for c in columns])
    forest = anomaly.fit_forest(centred, columns, trees=40)
    rows = {r.account_id: r.explanation for r in explain.explain_forest(centred, forest, columns, len(cloud)).collect()}
    assert len(rows) == len(cloud) and all(len(e) == 3 for e in rows.values())
    assert rows["p220"][0].direction == "increases_risk"
    text = spark.createDataFrame([("p",)], "account_id string").select(
        explain.anomaly_text(F.col("account_id"), F.lit(0.714), F.array(F.struct(
            F.lit("x").alias("feature"), F.lit("increases_risk").alias("direction"), F.lit(0.25).alias("shap_value"))))
    ).head()[0]
    assert text == "Account p flagged with anomaly score 0.71. Key factors: x (increases risk, SHAP: 0.250)."


def all_subsets(forest, expected, x, behind):
    """Shapley values by their definition: over all sets of features, the others taken from every background row."""
    d = len(x)

    def worth(inside):
        mixed = behind.copy()
        mixed[:, list(inside)] = x[list(inside)]
        return float(np.exp2(-forest.mean_paths(mixed) / expected).mean())

    values = {s: worth(s) for n in range(d + 1) for s in itertools.combinations(range(d), n)}
    out = np.zeros(d)
    for s, value in values.items():
        weight = math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) if len(s) < d else 0
        for j in set(range(d)) - set(s):
            out[j] += weight * (values[tuple(sorted((*s, j)))] - value)
    return out


@pytest.fixture(scope="module")
def six(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(120, 6))
    v[7, 2] = 9.0
    columns = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([(f"p{i:03d}", *map(float, r)) for i, r in enumerate(v)], "account_id string, " + ", ".join(f"{c} double" for c in columns))
    return df, v, columns, anomaly.fit_forest(df, columns, trees=20)


def test_shapley_values_equal_full_enumeration(six):
    """All orders of six features give the values of the definition; sampled ones come near and add up too."""
    df, v, columns, trees = six
    forest, expected = anomaly.Forest(trees), anomaly.mean_path(120)
    only = df.where("account_id in ('p000', 'p007', 'p050')")
    exact = {r.account_id: r for r in explain.forest_contributions(df, trees, columns, 120, count=None, background=3, only=only).collect()}
    names = sorted(r.account_id for r in smallest_hashes(df, "account_id", 3, explain.SEED).collect())
    behind = v[[int(n[1:]) for n in names]]
    for name, r in exact.items():
        assert np.allclose(r.shares, all_subsets(forest, expected, v[int(name[1:])], behind), atol=1e-12)
        assert sum(r.shares) == pytest.approx(r.score - r.base)
    assert np.argmax(exact["p007"].shares) == 2
    sampled = {r.account_id: r for r in explain.forest_contributions(df, trees, columns, 120, count=64, background=3, only=only).collect()}
    for name, r in sampled.items():
        assert sum(r.shares) == pytest.approx(r.score - r.base) and r.base == pytest.approx(exact[name].base)
        assert np.abs(np.array(r.shares) - exact[name].shares).max() < 0.03


def test_shapley_values_are_repeatable(six):
    df, _, columns, trees = six
    one, other = ({r.account_id: r.shares for r in explain.forest_contributions(d, trees, columns, 120, count=4).collect()} for d in (df, df.repartition(5)))
    assert one == other and len(one) == 120
    top = {r.account_id: r.explanation for r in explain.explain_forest_shapley(df, trees, columns, 120, count=8).collect()}
    assert top["p007"][0].feature == "f2" and top["p007"][0].direction == "increases_risk" and len(top) == 120
    assert explain.forest_contributions(df.limit(0), trees, columns, 120).collect() == []


def test_forest_walks_all_trees_together(six):
    df, v, columns, trees = six
    forest = anomaly.Forest(trees)
    nodes = {(r.tree, r.node): r for r in trees.collect()}

    def path(tree, row):
        node = nodes[tree, 0]
        while node.feature >= 0:
            node = nodes[tree, node.low if row[node.feature] <= node.threshold else node.high]
        return node.path

    want = [sum(path(t, row) for t in range(20)) / 20 for row in v]
    assert np.allclose(forest.mean_paths(v), want) and len(forest.mean_paths(v[:0])) == 0

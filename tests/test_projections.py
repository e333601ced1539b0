import numpy as np
import pytest

from moneytrail.operators import anomaly, neighbours, projections


def table(spark, v, weights=None):
    rows = [(f"S{i:05d}", int(weights[i]) if weights is not None else 1, [float(x) for x in r]) for i, r in enumerate(v)]
    return spark.createDataFrame(rows, "site string, weight bigint, v array<double>").repartition(4)


def clusters(n, dim=21, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim)) * 2
    return centres[rng.integers(0, 30, n)] + rng.normal(size=(n, dim)) * rng.lognormal(size=(n, 1)) * 0.3


@pytest.mark.parametrize("kind", ["clusters", "independent"])
def test_recall(spark, kind):
    """At least 0.9 of the exact neighbours, with windows that hold a small part of the sites."""
    v = clusters(6000) if kind == "clusters" else np.random.default_rng(2).normal(size=(6000, 21))
    sites = table(spark, v)
    found = projections.nearest_approximate(sites, 20, tables=16, window=256 if kind == "clusters" else 512).cache()
    got = projections.recall(found, neighbours.nearest(sites, 20)).head()
    assert got.wanted == 6000 * 20 and 0.9 <= got.recall < 1
    assert found.groupBy("site").count().where("count <> 21").count() == 0
    d = {r.site: np.array(r.v) for r in sites.collect()}
    for r in found.where("site < 'S00020'").collect():
        assert r.distance == pytest.approx(np.linalg.norm(d[r.site] - d[r.neighbour])) and (r.place == 1) == (r.site == r.neighbour)


def test_small_tables_are_exact(spark, monkeypatch):
    """All sites in one window: the lists of the exact search, weights and ties included."""
    rng = np.random.default_rng(3)
    v = rng.integers(0, 3, size=(150, 4))
    v = np.unique(v, axis=0)
    sites = table(spark, v, rng.integers(1, 9, len(v)))
    order = ["site", "place"]
    exact = [tuple(r) for r in neighbours.nearest(sites, 7).orderBy(*order).collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = projections.nearest_approximate(sites, 7, tables=2)
        assert [tuple(r) for r in got.select("site", "neighbour", "distance", "weight", "place").orderBy(*order).collect()] == exact
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_windows_of_any_partitions_are_bounded(spark):
    """Every site has a whole list, however the ranges fall."""
    sites = table(spark, clusters(900, 5))
    a, b = (sorted(map(tuple, projections.nearest_approximate(s, 5, tables=3, window=50).collect())) for s in (sites, sites.coalesce(1)))
    assert len({r[0] for r in a}) == 900 and len(a) == 900 * 6
    assert len(set(a) & set(b)) > 0.8 * len(a)  # only windows at the ends of ranges differ
    assert projections.nearest_approximate(sites.limit(0), 5).collect() == []


def test_outlier_factors_agree(spark):
    """Factors from approximate neighbours keep the order of the exact ones among the most anomalous accounts."""
    v = clusters(1500, 6, 4)
    v[:10] += 40 * np.random.default_rng(5).normal(size=(10, 6))
    columns = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([(f"A{i:05d}", *map(float, r)) for i, r in enumerate(v)], "account_id string, " + ", ".join(f"{c} double" for c in columns))
    exact, near = ({r.account_id: r.lof_score for r in anomaly.lof(df, columns, exact=e).collect()} for e in (True, False))
    assert set(exact) == set(near)
    lowest = [set(sorted(s, key=s.get)[:30]) for s in (exact, near)]
    assert len(lowest[0] & lowest[1]) >= 27

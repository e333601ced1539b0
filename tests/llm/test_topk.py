import math

import numpy as np
import pytest
from llm_data import SMALL
from pyspark.sql import functions as F

from moneytrail.llm import topk


def brute(rows, is_query, k=10):
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in sound if is_query(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q and len(w) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(df, **options):
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, **options).collect()))


SCHEMA = "vec_id bigint, embedding array<float>, dim int, block string, v int, score int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "b", 2, 3, 4) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("size", [100, 4096])
def test_whole_table(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "BLOCK_ROWS", size)
    monkeypatch.setattr(topk, "CHUNK_ROWS", 2)
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert found(df) == brute(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("kind", ["sparse", "copies", "dense"])
def test_made_vectors(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 12)).astype("float32")
    if kind == "sparse":
        v[rng.random(v.shape) < 0.8] = 0
    if kind == "copies":
        v[100:500] = v[100]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    assert found(table(spark, rows)) == brute(rows, lambda i: i % 100 == 0)


def test_search_stops_early_but_exactly():
    """One strong vector per direction: the end is proven long before all segments are processed."""
    rng = np.random.default_rng(5)
    v = rng.integers(-30, 30, size=(2000, 16))
    v[:20] *= 60
    index = topk.ImpactIndex(np.arange(2000), v)
    members = index.possible(v[0], np.arange(1, 2000), 5)
    assert len(members) < 200
    ids, scores = index.search(0, v[0], 5)
    want = sorted(range(1, 2000), key=lambda i: (-(v[i] @ v[0]), i))[:5]
    assert list(ids) == want and list(scores) == [v[i] @ v[0] for i in want]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1.0, None]), (200, None), (300, [nan, 1.0]), (400, [inf, 1.0]), (500, []), (600, []), (7, []),
            (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.0]), (4, [1.0]), (None, [1.0, 2.0]), (0, [1.0, 2.0]), (700, [0.0, 0.0])]
    got = found(table(spark, rows))
    assert got == brute(rows, lambda i: i is not None and i % 100 == 0)
    assert found(table(spark, [(0, [1.0])])) == [] and found(table(spark, rows).limit(0)) == []


def test_large_components(spark):
    """Scores are exact up to the size of a long, in one block with small vectors; beyond, they stop at its ends."""
    rng = np.random.default_rng(6)
    rows = [(0, [1e6]), (1, [2e6]), (2, [3e5])]
    assert found(table(spark, rows)) == [(0, 1, 1, 2097152000000000000), (0, 2, 2, 314572800000000000)] == brute(rows, lambda i: i % 100 == 0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 10.0 ** rng.integers(-3, 5)]) for i in range(250)]
    rows += [(300, [1e6, 0.0, 0.0, 1.0]), (301, [1e6, 2.0, 0.5, 0.0]), (302, [-1e6, 3.0, 1.0, 0.0])]
    assert found(table(spark, rows)) == brute(rows, lambda i: i % 100 == 0)
    beyond = found(table(spark, [(0, [1e20, 0.0]), (1, [1e20, 1.0]), (2, [-1e20, 1.0]), (3, [1.0, 1.0])]))
    assert [r[2:] for r in beyond] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]

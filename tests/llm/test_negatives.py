import math

import numpy as np
import pytest
from llm_data import SMALL
from pyspark.sql import functions as F

from moneytrail.llm import negatives, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, dim int, v string, block int, chunk int, part string, score int, rank int, place int"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, y, 1, "b", 2, 3, "p", 4, 5, 6) for i, v, y in rows], SCHEMA.replace("float", kind))


def brute(rows, is_anchor=lambda i: i % 100 == 0, scale=256):
    """Plain search with Python integers: all rows of a label, then all rows in each positive's window."""
    def sound(v):
        return v is not None and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in v)

    known = [(i, tuple(math.floor(x * scale) for x in v), y) for i, v, y in rows if i is not None and y is not None and sound(v)]
    out = []
    for i, v, y in {r for r in known if is_anchor(r[0])}:
        others = [(sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in known if j != i and len(w) == len(v)]
        others.sort(key=lambda o: (-o[0], o[1]))
        for nth, (best, j, _) in enumerate([o for o in others if o[2] == y][:5], 1):
            hard = [o for o in others if o[2] != y and 80 * best <= 100 * o[0] <= 100 * best]
            out += [(i, j, nth, rank, k, best, s) for rank, (s, k, _) in enumerate(hard[:5], 1)]
    return sorted(out)


def found(df, **options):
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect()))


@pytest.mark.parametrize("dim, bits", [(1, 3), (2, 1), (2, 4), (3, 3), (4, 2), (6, 1)])
def test_curve_goes_to_neighbours(dim, bits):
    """All cells have different places, and cells that follow each other are one step apart."""
    cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dim, indexing="ij"), axis=-1).reshape(-1, dim)
    places = negatives.hilbert_places(cells, bits)
    number = [int("".join(map(str, p)), 2) for p in places.tolist()]
    assert sorted(number) == list(range(2 ** (bits * dim)))
    walk = cells[np.argsort(number)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    for size in (10, 1e4, 1e12):
        zone, v = np.floor(rng.normal(size=(50, 6)) * size), np.floor(rng.normal(size=(20, 6)) * size)
        low, high = negatives.bounds(v, zone.min(axis=0)[None], zone.max(axis=0)[None])
        exact = negatives.products(v, zone)
        assert (exact >= low).all() and (exact <= high).all()


@pytest.mark.parametrize("block, chunk, part", [(100, 3, 2), (4096, 1024, 1024)])
def test_whole_table(spark, monkeypatch, block, chunk, part):
    monkeypatch.setattr(negatives, "PART_ROWS", part)
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert found(df, block_rows=block, chunk_rows=chunk) == brute(rows)


def test_query(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in df.collect()]
    got = queries.op13_negatives(spark, SMALL)
    order = ["anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.select(*order).collect())) == brute(rows)


def clustered(n=3000, dim=8, seed=2):
    """Vectors around centres that lie close together in pairs of labels, so a label's hard negatives are its partner's rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim)) * 8
    at = rng.integers(0, 40, n)
    return [(i, [float(x) for x in (centres[c // 2] + rng.normal(size=dim) * 0.3).astype("float32")], int(c)) for i, c in enumerate(at)]


def test_clusters_are_read_in_part(spark, monkeypatch):
    rows = clustered()
    read = []
    choose = negatives.Blocks.to_read

    def noted(self, *args):
        wanted = choose(self, *args)
        read.append(sum(len(r.needed) // 4 for r in wanted.collect()))
        return wanted

    monkeypatch.setattr(negatives.Blocks, "to_read", noted)
    assert found(table(spark, rows), block_rows=50) == brute(rows)
    anchors, zones = 30, 3000 / 50
    assert read[0] <= 2 * anchors and sum(read) < 0.5 * anchors * zones


@pytest.mark.parametrize("kind", ["copies", "one label", "opposite"])
def test_made_vectors(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 5)).round(2)
    if kind == "copies":
        v[100:450] = v[100]
    if kind == "opposite":
        v[1::2] = -v[::2]
    rows = [(i, [float(np.float32(x)) for x in r], 0 if kind == "one label" else i % 3) for i, r in enumerate(v)]
    assert found(table(spark, rows), block_rows=64) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [2.0, 2.0], 1), (100, [1.0, None], 1), (200, None, 1), (300, [nan, 1.0], 1), (400, [inf, 1.0], 2),
        (500, [], 1), (7, [], 1), (8, [], 2), (600, [1.0, 1.0], None), (700, [1.0, 2.0], 3), (None, [1.0, 2.0], 1),
        *[(i, [1.0, 2.0 - i / 100], i % 2) for i in range(1, 30)], *[(3, [1.0, 2.0], 1)] * 7, *[(4, [1.0, 2.0], 0)] * 7, (800, [1.0], 5),
    ]
    assert found(table(spark, rows)) == brute(rows)
    assert found(table(spark, rows), block_rows=4, chunk_rows=1) == brute(rows)
    assert found(table(spark, rows).limit(0)) == []


def test_large_components(spark):
    """Scores far beyond what floating-point numbers hold exactly, up to the size of a long."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 3) * 1e6 + i / 3], i % 2) for i in range(300)]
    rows += [(1000, [1e6, 2e6, 3e5], 0), (1001, [2e6, 1e6, 0.5], 0), (1002, [3e5 + 0.25, 3e6, 0.0], 1)]
    assert found(table(spark, rows, "double"), block_rows=40) == brute(rows)
    beyond = [(0, [1e20, 0.0], 0), (1, [1e20, 1.0], 0), (2, [9e19, 1.0], 1), (3, [1e308, 1.0], 1)]
    got = found(table(spark, beyond, "double"))
    assert got == [(0, 1, 1, 1, 2, 2**63 - 1, 2**63 - 1)]

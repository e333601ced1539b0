"""Every registered query against its SQL twin on the smallest tables, and once more with all joins salted."""

import pytest
from compare import compare, connect
from conftest import SMALL

from moneytrail.functions import skew
from moneytrail.operators import patterns
from moneytrail.plans.oracle import ORACLE
from moneytrail.plans.queries import QUERIES

SALTED = [
    "transfers_build", "sent_received_edges", "quality_violations", "orphan_transfers", "layering", "structuring",
    "circular_round_trips", "involvement", "dormant_evidence", "profile_evidence", "subgraph_nodes", "fund_paths", "pagerank", "hops_to_flagged", "neighbour_means", "lof",
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_names():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, _, _, problem = compare(spark, con, SMALL, name)
    assert problem is None


@pytest.mark.parametrize("least", [0, 20, 100])
def test_layering_with_some_busy_intermediaries(spark, least, monkeypatch):
    """Pairs over busy intermediaries are built another way; detections must not change."""
    folder = SMALL.replace("sf0.001", "sf0.01")
    monkeypatch.setattr(patterns, "BUSY_PAIRS", least)
    rows, _, _, problem = compare(spark, connect(folder), folder, "layering")
    assert problem is None and rows == 78


@pytest.mark.parametrize("name", SALTED)
def test_query_with_every_key_hot(spark, con, name, monkeypatch):
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 1)
    monkeypatch.setattr(skew, "HOT_MOST", 10_000)
    monkeypatch.setattr(patterns, "BUSY_PAIRS", -1)
    _, _, _, problem = compare(spark, con, SMALL, name)
    assert problem is None

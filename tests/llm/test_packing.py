import random
import re
from collections import defaultdict

import pytest
from llm_data import ODD, SMALL, documents  # noqa: F401

from moneytrail.llm import packing


def brute(items, capacity):
    """Look at every bin for every item: the least residual that takes it, the first such bin."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["left"], b["since"], i) for i, b in enumerate(bins) if b["left"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
        if fits:
            i = min(fits)[2]
        else:
            i = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set(), "n": 0, "since": 0})
        b = bins[i]
        b["left"] -= size
        b["sources"].add(source)
        b["clusters"].add(cluster)
        b["since"] = len(out)
        out.append((i, b["n"]))
        b["n"] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_the_tightest_bin(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 64, 300])
    items = [(rng.randint(1, capacity - 1), 0 if rng.random() < 0.35 else rng.randrange(6), rng.randrange(40)) for _ in range(400)]
    if seed % 2:
        items.sort(reverse=True)
    bins = packing.Bins(capacity)
    assert [bins.place(*i) for i in items] == brute(items, capacity)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def check(rows, placed, capacity):
    """Every word of every row exactly once, in bins that hold what they may."""
    want, got = defaultdict(int), defaultdict(int)
    for doc_id, text, source in rows:
        want[doc_id, source] += len(words(text))
    bins = defaultdict(list)
    for r in placed:
        got[r.doc_id, r.source] += r["size"]
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
        else:
            assert r["size"] == 0
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v}
    for pieces in bins.values():
        assert sum(p["size"] for p in pieces) <= capacity
        assert sorted(p.position for p in pieces) == list(range(len(pieces)))
        assert len({p.source for p in pieces}) == len(pieces) and len({tuple(p.words) for p in pieces}) == len(pieces)


@pytest.mark.parametrize("capacity", [50, 512])
def test_whole_table(spark, capacity):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    check_texts(rows, packing.packed_texts(docs, capacity), capacity)
    again = packing.pack(docs, capacity=capacity)
    assert sorted(map(str, again.collect())) == sorted(map(str, packing.pack(docs, capacity=capacity).collect()))


def check_texts(rows, df, capacity):
    placed = df.collect()

    class Piece(dict):
        __getattr__ = dict.__getitem__

    pieces = [Piece(r.asDict(), words=words(r.text)) for r in placed]
    assert all(len(p.words) == p["size"] for p in pieces)
    check(rows, pieces, capacity)
    texts = defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.first_word):
        texts[p.doc_id].append(p)
    for doc_id, text, _ in rows:
        if doc_id is not None and sum(r[0] == doc_id for r in rows) == 1:
            assert [w for p in texts[doc_id] for w in p.words] == words(text)


def test_odd_rows(documents):
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in ODD]
    check_texts(rows, packing.packed_texts(documents(*ODD), 7), 7)
    assert packing.pack(documents((1, "x")).limit(0)).collect() == []


def test_copies_and_sources_never_share_a_bin(documents):
    rows = [(i, "same words here" if i % 3 else f"own {i}", f"s{i % 4}" if i % 5 else "hot") for i in range(120)]
    check_texts(rows, packing.packed_texts(documents(*rows), 30), 30)

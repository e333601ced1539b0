import hashlib
import re
from collections import defaultdict

import pytest
from llm_data import ODD, SMALL, documents  # noqa: F401

from moneytrail.llm import mixing


def brute(rows, share=1.5, weights=(3, 1, 2), most=2):
    """Reshare the excess over and over, then walk each source in key order."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    sources = defaultdict(int)
    for r, n in zip(rows, sizes):
        sources[r[2]] += n
    names = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, share * sum(sizes)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > most * sources[s]}
        if not over:
            target.update({s: rate * weight[s] for s in open_})
            break
        for s in over:
            target[s] = most * sources[s]
            left -= target[s]
        open_ -= over
    out = []
    for s in names:
        budget = int(target[s] + 1e-9)
        own = sorted((hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), -1 if r[0] is None else r[0], n) for r, n in zip(rows, sizes) if r[2] == s)
        full, rest = divmod(budget, sources[s]) if sources[s] else (0, 0)
        before = 0
        for _, i, n in own:
            out.append((None if i == -1 else i, n, sources[s], round(target[s], 6), full * n + max(0, min(n, rest - before))))
            before += n
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def test_odd_rows(documents):
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in ODD]
    assert rows_of(mixing.mix(documents(*ODD))) == brute(rows)


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_many_intervals_change_nothing(documents, monkeypatch, least):
    monkeypatch.setattr(mixing, "INTERVAL_ROWS", least)
    rows = [(i, "w " * (i * 7 % 13), "abcde"[min(i % 9, 4)]) for i in range(300)]
    assert rows_of(mixing.mix(documents(*rows))) == brute(rows)


def test_exact_budgets_and_limits(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mixing.mix(docs).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(taken[s] == int(target[s]) for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-3


def test_empty_tables_and_texts(documents, spark):
    assert mixing.mix(documents((1, "x")).limit(0)).collect() == []
    assert rows_of(mixing.mix(documents((1, None), (2, "  ")))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]

import hashlib
import re

import pytest
from llm_data import ODD, SMALL, documents  # noqa: F401
from pyspark.sql import functions as F

from moneytrail.llm import winnow


def kept_by_hand(hashes, window):
    """Robust to ties: the rightmost smallest of every window, each place once."""
    if not hashes:
        return []
    out = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i:i + window]
        at = i + max(j for j, h in enumerate(part) if h == min(part))
        if (hashes[at], at) not in out:
            out.append((hashes[at], at))
    return out


@pytest.mark.parametrize("window", [1, 5, 8])
def test_against_windows_by_hand(spark, documents, window):
    texts = [r[1] for r in ODD if r[1]][:6] + ["a b " * 40, "x " * 30, "one two three four five six seven eight nine ten eleven twelve " * 3]
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(winnow.TOKEN), F.lit(0))
    kept = winnow.winnow(F.col("text"), window=window)
    df = documents(*enumerate(texts)).select(
        tokens.alias("tokens"), F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(winnow.PRIME))).alias("h"),
        winnow.gram_hashes(tokens).alias("grams"),
        F.transform(kept, winnow.hash_of).alias("hashes"), F.transform(kept, winnow.place_of).alias("places"),
    )
    for r in df.collect():
        if len(r.tokens) >= winnow.K:
            rolled = []
            for i in range(len(r.h) - winnow.K + 1):
                value = 0
                for h in r.h[i:i + winnow.K]:
                    value = (value * winnow.BASE + h) % winnow.PRIME
                rolled.append(value)
            assert r.grams == rolled
        else:
            assert len(r.grams) == (len(r.tokens) > 0)
        assert list(zip(r.hashes, r.places)) == kept_by_hand(r.grams, window)


def expected_next(rows):
    """Descending ids, nulls last; the text of the row after each, the first after the last."""
    return rows[1:] + rows[:1]


@pytest.mark.parametrize("least", [1, 7, 1000])
def test_edited_texts(spark, monkeypatch, least):
    monkeypatch.setattr(winnow, "RANGE_ROWS", least)
    monkeypatch.setattr(winnow, "shard_count", lambda rows, least: max(1, rows // least))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in winnow.fingerprint_edits(docs).collect()}
    assert len(got) == len(rows)
    seen = {}
    for (doc_id, text), (_, after) in zip(rows, expected_next(rows)):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        if edited == text:
            assert (r.near_edited, r.edited_fingerprint) == (1.0, r.fingerprint)
        if after == text:
            assert r.near_next == 1.0


def test_odd_rows(documents):
    rows = winnow.fingerprint_edits(documents(*ODD)).collect()
    assert len(rows) == len(ODD)
    assert sum(r.doc_id is None for r in rows) == 2
    one = winnow.fingerprint_edits(documents((1, "a b c d"))).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest() and one.near_next == 1.0
    assert winnow.fingerprint_edits(documents((1, "x")).limit(0)).collect() == []


def test_match_guarantee(documents):
    """A shared run of K + WINDOW - 1 tokens always shares a kept hash."""
    words = [f"w{i}" for i in range(winnow.K + winnow.WINDOW - 1)]
    a, b = "p q r " + " ".join(words) + " s t", "u " * 9 + " ".join(words) + " v" * 5
    kept = documents((1, a), (2, b)).select(F.transform(winnow.winnow(F.col("text")), winnow.hash_of).alias("h")).collect()
    assert set(kept[0].h) & set(kept[1].h)


def test_tokens_of_dense_scripts():
    assert len(re.findall(winnow.TOKEN, "漢字 ab漢")) == 4

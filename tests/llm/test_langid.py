import zlib

import numpy as np
from llm_data import ODD, SMALL, documents  # noqa: F401
from pyspark.sql import functions as F

from moneytrail.llm import langid


def plain_bundle(text, letters):
    """Every n-gram bound and added on its own."""
    codes = langid.letter_codes(text)
    total = np.zeros(letters.dimensions)
    for trio in zip(codes, codes[1:], codes[2:]):
        bound = np.ones(letters.dimensions)
        for back, code in zip((2, 1, 0), trio):
            bound *= np.roll(letters.of(np.array([code]))[0], back)
        total += bound
    return total


def test_bundles(monkeypatch):
    monkeypatch.setattr(langid, "CHARS", 50)
    monkeypatch.setattr(langid, "GRAMS", 7)
    monkeypatch.setattr(langid, "DOCS", 3)
    letters = langid.Letters(64)
    texts = ["", "a", "Hello, World!", "ÄÖ 123 straße", "abc " * 60, "...", "漢字かな", "x"]
    got = langid.bundles(texts, letters)
    for text, row in zip(texts, got):
        assert np.array_equal(row, plain_bundle(text, langid.Letters(64)))
    assert not got[0].any() and not got[5].any() and got[1].any()


def test_letter_codes():
    assert langid.letter_codes("Ab, c1D").tolist() == [0, 97, 98, 0, 99, 0, 100, 0]
    assert langid.letter_codes("12 !").tolist() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_prediction_ignores_labels_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert sorted(langid.identify(docs).collect()) == sorted(langid.identify(other).collect())


def test_odd_rows(documents):
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "s", None if r[0] == 9 else "en") for r in ODD]
    found = langid.identify(documents(*rows))
    assert found.count() == len(ODD)
    by_id = {(r.doc_id): r for r in found.collect()}
    for i in (1, 2, 3):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[None].held_out
    nothing = documents(*[(r[0], r[1], "s", None) for r in ODD])
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}
    assert langid.identify(nothing.limit(0)).collect() == []
    kept = langid.keep_identified(documents(*rows), 0.02)
    assert kept.columns == documents(*rows).columns and not {r.doc_id for r in kept.collect()} & {1, 2, 3}

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from llm_data import ODD, SMALL, documents  # noqa: F401

from moneytrail.llm import mixing


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, f in corpus_pipeline.STAGES:
        before = docs
        f(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best-fit packing":
            assert docs.columns == columns, name
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
    assert sum(r["size"] for r in docs.collect()) == sum(len(words(r.text)) for r in before.collect())
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


def test_clean_documents_stay_and_letterless_go(spark, documents):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert stage("language ID")(spark, docs, SMALL).count() == docs.count()
    kept = stage("language ID")(spark, documents(*ODD, (20, "12 34 !!"), *[(i, "ordinary words in a text") for i in range(30, 60)]), SMALL)
    assert {r.doc_id for r in kept.collect()} >= {*range(30, 60)} and not {r.doc_id for r in kept.collect()} & {1, 2, 3, 20}


def test_mixture_takes_what_the_mix_says(documents, spark):
    rows = [(i, " ".join(f"{i}w{j}" for j in range(5 + i % 17)), "abc"[i % 3] if i % 4 else "a") for i in range(80)] + [(3, "twice the same", "b")] * 2 + [(90, None, "c"), (None, "no id", None)]
    df = documents(*rows)
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id] += r.taken
    got = stage("mixing")(spark, df, SMALL)
    assert got.columns == df.columns
    have = Counter()
    texts = {(r.doc_id): words(r.text) for r in df.collect() if r.doc_id != 3}
    for r in got.collect():
        have[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
        if r.doc_id != 3:
            assert words(r.text) == texts[r.doc_id][:len(words(r.text))]
    assert +have == +want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_empty_tables(spark, documents, name):
    df = documents(*ODD)
    out = stage(name)(spark, df, SMALL)
    out.collect()
    assert stage(name)(spark, df.limit(0), SMALL).collect() == []
    if name != "best-fit packing":
        assert out.columns == df.columns


def test_unlearned_scripts_go_and_short_clean_texts_stay(spark):
    rng = random.Random(5)
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    alphabets = ["абвгдежзийклмнопрстуфхцчшщ", "αβγδεζηθικλμνξοπρστυφχψω", "".join(chr(0xAC00 + 7 * i) for i in range(600)), "bcdfghjklmnpqrstvwxz"]
    junk = [" ".join("".join(rng.choices(a, k=rng.randint(2, 9))) for _ in range(200)) for a in alphabets for _ in range(50)]
    clean = ["Jazz", "Fjord", "Zug", "Hello world", "Oui."]
    rows = [(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(junk + clean)]
    mixed = docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    kept = {r.doc_id for r in stage("language ID")(spark, mixed, SMALL).select("doc_id").collect()}
    assert {i for i in kept if i >= 10**9} == {10**9 + len(junk) + i for i in range(len(clean))}
    assert len(kept) == docs.count() + len(clean)

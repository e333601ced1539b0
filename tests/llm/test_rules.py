import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import ODD, SMALL, documents  # noqa: F401
from pyspark.sql import functions as F

from moneytrail.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def measured(df):
    return [tuple(r) for r in rules.judge(df).select(*[f"quality.{c}" for c in COUNTED]).collect()]


def test_measures_of_a_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert measured(df) == [brute(r.text) for r in df.collect()]


def test_odd_rows(spark, documents):  # noqa: F811
    df = documents(*ODD).withColumn("quality", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    rows = rules.judge(df).collect()
    assert [tuple(r.quality[c] for c in COUNTED) for r in rows] == [brute(r.text) for r in rows] and len(rows) == len(ODD)
    assert all(r.n_words == "clash" for r in rows)
    assert rows[0].quality.base_failed and not rows[0].quality.kept and "few_words" in rows[0].quality.broken
    assert rules.judge(df.limit(0)).collect() == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\r #|é𝒳", max_size=60), min_size=1, max_size=20))
def test_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").orderBy("doc_id")
    assert measured(df) == [brute(t) for t in texts]


def test_very_long_text(spark):
    text = " ".join(f"w{i % 70_000}" for i in range(200_000)) + "\n" + "x" * 1_000_000
    assert measured(spark.createDataFrame([(1, text)], "doc_id int, text string")) == [brute(text)]


CLEAN = (
    "The river ran past the old mill, and the children of the village went there to play on long days. "
    "It was cold as snow in spring, but by the end of June they had built a dam from stones and wood."
)


@pytest.mark.parametrize("text, name", [
    (CLEAN, ""),
    ("only four words here", "few_words"),
    ("one two three four five " * 20, "repeated_words"),
    (" | ".join(CLEAN.split()), "symbols"),
    (" ".join(f"{i}.{i}" for i in range(60)), "words_with_letters"),
    (" ".join(f"{w.upper()}!!" for w in CLEAN.split()), "shouting"),
    (" ".join("supercalifragilistic" + w for w in CLEAN.split()), "word_length"),
    ("\n".join(f"- of the {w}" for w in CLEAN.split()), "bullet_lines"),
    ("\n".join(f"the {w} of..." for w in CLEAN.split()), "ellipsis_lines"),
    (CLEAN + "\nof the\n" * 12, "repeated_lines"),
    (" ".join(w[::-1] + "q" for w in CLEAN.split()), "stop_words"),
])
def test_each_rule(spark, text, name):
    found = rules.judge(spark.createDataFrame([(text,)], "text string")).head().quality
    assert name in found.broken.split(",") and found.kept == (name == "")


def test_limits_are_part_of_the_rule(spark):
    """Ten words pass, nine don't; a fifth of repeated words passes, more doesn't."""
    ten = " ".join(f"word{i}" for i in range(10))
    fifth = " ".join(["a b c d e"] * 2 + [f"w{i}" for i in range(40)])
    over = " ".join(["a b c d e"] * 2 + [f"w{i}" for i in range(39)])
    df = spark.createDataFrame([(t,) for t in (ten, ten[6:], fifth, over)], "text string")
    assert [r.quality.base_failed for r in rules.judge(df).collect()] == [False, True, False, True]


def test_labelled_documents(spark):
    """Clean documents stay unless the base refuses them; nearly all junk goes."""
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    judged = rules.judge(docs).join(labels.withColumnRenamed("quality", "good"), "doc_id").select("good", "quality.*")
    assert judged.where("good = 1 and not kept and not base_failed").count() == 0
    assert judged.where("good = 0 and not kept").count() >= 0.9 * judged.where("good = 0").count()


def test_own_table(spark):
    own = (rules.Rule("short", "word_chars", None, 5, None), rules.Rule("wide", "word_chars", "n_lines", None, 10))
    df = spark.createDataFrame([("abc",), ("abcdef",), ("abcdefghijk",), (None,)], "text string")
    assert [r.quality.broken for r in rules.judge(df, own, ()).collect()] == ["short", "", "wide", "short"]


def test_one_projection(spark):
    """The whole job is a scan and projections: no exchange, no Python."""
    plan = rules.judge(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan

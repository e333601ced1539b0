"""From raw documents to packed training sequences, stage by stage.

Every stage reads what the stage before it wrote, and works on all of it.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moneytrail.llm import langid, lines, mixing, packing, simhash
from moneytrail.llm.helpers import SPACE, fresh, word_count
from moneytrail.scratch import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter, or no more like a language than chance gives, go."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs across documents."""
    cleaned, *counts = lines.drop_recurring(docs, short=True, copies_once=True)
    return cleaned.drop(*counts).withColumn("n_chars", F.length("text").cast("bigint"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: fingerprints over three words that differ in at most three bits."""
    return simhash.one_of_each(docs, simhash.SHINGLE, simhash.RADIUS, simhash.AGREE, similarity=None)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole epochs as repeated rows, the one at a source's cut shortened to its words.

    Documents of which nothing is taken go, those without a word among them. Equal rows are matched with their shares one by one.
    """
    known, code, origin, shares, nth, taken, copy, size = (
        fresh(docs, n) for n in ("known", "text_code", "origin", "shares", "nth", "taken", "copy", "size")
    )
    key = [known, code, origin]
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias(known)
    sources = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias(origin)
    mixed = mixing.mix(docs, also={"mixed_code": F.xxhash64("text")}).where("taken > 0").select(ids, F.col("mixed_code").alias(code), sources, "taken")
    of_rows = mixed.groupBy(*key).agg(F.sort_array(F.collect_list("taken"), asc=False).alias(shares))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    part = F.least(F.col(size), F.col(taken) - (F.col(copy) - 1) * F.col(size)).cast("int")
    return (
        docs.select("*", ids, F.xxhash64("text").alias(code), sources).join(of_rows, key)
        .withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy("doc_id")))
        .withColumn(taken, F.get(shares, F.col(nth) - 1)).where(F.col(taken).isNotNull())
        .withColumn(size, word_count(F.col("text")))
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
        .withColumn("text", F.when(part < F.col(size), F.array_join(F.slice(words, 1, part), " ")).otherwise(F.col("text")))
        .withColumn("n_chars", F.length("text").cast("bigint"))
        .select(*docs.columns)
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: every piece of every document with its bin, its place in it and its text."""
    return packing.packed_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixture),
    ("best-fit packing", packed),
]

#: Language profiles, fingerprints and best-fit packing have no SQL form; stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

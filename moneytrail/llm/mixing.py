"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are put in the order of their keys, and a running
sum of their sizes tells which of them lie before the cut at the source's budget. The running sum is distributed: keys
are uniform, so cutting their range into equal intervals splits a source of any size into groups of like size; sums per
interval are added up per source, and rows are summed only within their interval.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.llm.helpers import hinted, word_count
from moneytrail.scratch import materialize, materialize_counted

SHARE = 1.5
WEIGHTS = (3, 1, 2)
MOST_EPOCHS = 2
#: Least rows of one interval of keys; beyond a million rows it is the root of the source's rows.
INTERVAL_ROWS = 1000


def targets(sources: DataFrame, share: float, weights: tuple[int, ...], most: int) -> DataFrame:
    """Add ``target`` to a table with one row per ``source`` and its ``source_size``.

    Sources in code point order, null last, weigh ``weights`` in turn. Shares by weight above ``most`` times the
    source's size stop there and the excess goes to the others by weight, again until none is above: that is
    min(cap, rate * weight) with one common rate, the largest of the rates that arise as sources are capped one by one
    in the order of cap / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    everyone = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    return (
        sources.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everyone) * F.lit(share))
        .withColumn("capped", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rate", F.max((F.col("total") - F.col("capped")) / F.col("open")).over(everyone))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("rate") * F.col("weight")))
        .select("source", "source_key", "source_size", "rows", "target")
    )


def random_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    share: float = SHARE,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: str = "mix",
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` has doc_id, text and source; other columns are ignored. ``size`` is the size of a document, by default its
    words. ``also`` names expressions over ``docs`` to carry along. Returns one row per input row: doc_id, source, size,
    source_size, target, taken. A source's budget is the whole part of its target; the document at the cut is taken in
    part, so that the words taken from a source are exactly its budget. A null text has size 0, a null source is a
    source of its own, a null doc_id is a value like any other, repeated rows count as often as they occur, an empty
    table gives an empty result. Documents with the same key and id are interchangeable but for their sizes, by which
    they are ordered.
    """
    also = also or {}
    size = word_count(F.col("text")) if size is None else size
    key = random_key(F.col("doc_id"), seed)
    rows = materialize(
        docs.select(
            "doc_id", "source", F.coalesce(size, F.lit(0)).cast("long").alias("size"), key.alias("key"),
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source_key"),
            *[c.alias(name) for name, c in also.items()],
        ),
        "sized",
    )
    sources = rows.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    aims, count = materialize_counted(targets(sources, share, weights, most), "targets")
    intervals = F.ceil(F.col("rows") / F.greatest(F.lit(INTERVAL_ROWS), F.sqrt(F.col("rows"))))
    unit = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = rows.join(hinted(aims.drop("source"), count), "source_key").withColumn(
        "interval", F.shiftright(unit * intervals.cast("long"), 32)
    )
    earlier = Window.partitionBy("source_key").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("source_key", "interval").agg(F.sum("size").alias("sum")).select(
        "source_key", "interval", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start")
    )
    inside = (
        Window.partitionBy("source_key", "interval").orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    return (
        placed.join(starts, ["source_key", "interval"])
        .withColumn("before", before)
        .withColumn("epochs", epochs)
        .withColumn("rest", rest)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))))
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), *also,
        )
    )

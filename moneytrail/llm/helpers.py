"""Small pieces that several operators of this subpackage share."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Most rows of a table that is broadcast by hint; larger ones take part in an ordinary shuffle join.
SMALL_ROWS = 100_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. Each word with the space around it becomes one character, so nothing is listed."""
    around = rf"[\x20\x09-\x0D]*+{WORD}+[\x20\x09-\x0D]*+"
    return F.when(text.rlike(WORD), F.length(F.regexp_replace(text, around, "x"))).otherwise(F.lit(0)).cast("long")


def shard_count(rows: int, least: int) -> int:
    """Shards of at least ``least`` rows; their size and their number both grow with the root of ``rows``."""
    return max(1, math.ceil(rows / max(least, math.isqrt(rows))))


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def running(numbers: Column, chunk: int = 256) -> Column:
    """Inclusive running sums of an array of whole numbers.

    Two levels, sums within chunks and sums of chunks, keep the copying that appending costs small.
    """
    def sums(xs):
        return F.aggregate(
            xs, F.array(F.lit(0).cast("long")),
            lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
        )

    def all_chunks(xs):
        starts = F.sequence(F.lit(1), F.size(xs), F.lit(chunk))
        return let(
            F.transform(starts, lambda s: sums(F.slice(xs, s, chunk))),
            lambda parts: let(
                sums(F.transform(parts, lambda p: F.element_at(p, -1))),
                lambda offsets: F.flatten(
                    F.transform(parts, lambda p, i: F.transform(F.slice(p, 2, chunk), lambda v: v + F.get(offsets, i)))
                ),
            ),
        )

    empty = F.array().cast("array<bigint>")
    return let(numbers, lambda xs: F.when(F.size(xs) > 0, all_chunks(xs)).otherwise(empty))

"""Document fingerprints by winnowing.

Hashes of every K tokens in a row roll over a text; of each WINDOW consecutive hashes the smallest is kept, the rightmost
if several are equal, together with its place. Two texts that share a run of K + WINDOW - 1 tokens therefore share a
kept hash. Tokens are words, or single characters of scripts that write without spaces. All of it is array expressions:
a rolling hash of 2m tokens is that of m tokens times a power of the base plus that of the next m, and a minimum over
2m hashes is the smaller of two minima over m, so K and WINDOW take log2 many passes.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.llm.helpers import let, shard_count
from moneytrail.scratch import materialize_counted

K = 4
WINDOW = 8
BASE = 1_000_003
PRIME = 2**31 - 1
#: A kept hash and its place in one number whose order is that of the hash, later places first.
PLACES = 2**32
_DENSE = "฀-๿぀-ヿ㐀-䶿一-鿿"
TOKEN = rf"[{_DENSE}]|[^\x20\x09-\x0D{_DENSE}]+"
#: Least documents of one range of ids; beyond a million it is the root of their number.
RANGE_ROWS = 1000


def _beside(xs: Column, apart: int, f) -> Column:
    """f(xs[i], xs[i + apart]) for every i that has both."""
    return let(xs, lambda a: let(F.greatest(F.size(a) - apart, F.lit(0)), lambda n: F.zip_with(
        F.slice(a, 1, n), F.slice(a, apart + 1, n), f
    )))


def _joined(hashes: Column, m: int, power: int) -> Column:
    """Hashes of 2m tokens from those of m, ``power`` being the base to the m."""
    return _beside(hashes, m, lambda a, b: (a * F.lit(power) + b) % PRIME)


def _doublings(most: int) -> list[int]:
    steps, have = [], 1
    while have < most:
        steps.append(min(have, most - have))
        have += steps[-1]
    return steps


def gram_hashes(tokens: Column, k: int = K) -> Column:
    """Polynomial hashes modulo a prime of every ``k`` tokens in a row; of fewer tokens than ``k`` all are one gram.

    ``k`` is a power of two.
    """
    def rolled(hashes):
        power = BASE
        for step in _doublings(k):
            hashes = _joined(hashes, step, power)
            power = power * power % PRIME
        return hashes

    def hashed(t):
        return F.pmod(F.xxhash64(t), F.lit(PRIME))

    return let(tokens, lambda ts: F.when(F.size(ts) >= k, rolled(F.transform(ts, hashed)))
               .when(F.size(ts) > 0, F.array(hashed(F.array_join(ts, " ")))).otherwise(F.array().cast("array<bigint>")))


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Kept (hash, place) pairs of a text in text order, packed into one number each: see ``hash_of`` and ``place_of``.

    A text of fewer hashes than a window keeps its smallest; a text without a token keeps none.
    """
    def smallest(v):
        for step in _doublings(window):
            v = _beside(v, step, lambda a, b: F.least(a, b))
        return F.array_distinct(v)

    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    packed = F.transform(gram_hashes(tokens, k), lambda h, i: h * PLACES + (PLACES - 1 - i))
    return let(packed, lambda v: F.when(F.size(v) >= window, smallest(v))
               .when(F.size(v) > 0, F.array(F.array_min(v))).otherwise(v))


def hash_of(kept: Column) -> Column:
    return F.shiftright(kept, 32)


def place_of(kept: Column) -> Column:
    return F.lit(PLACES - 1) - F.pmod(kept, F.lit(PLACES))


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct kept hashes of two texts that both have; 1 if neither has any."""
    return let(F.size(F.array_union(a, b)), lambda n: F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(1.0))


def digest(kept: Column) -> Column:
    """Hash of all kept hashes and places."""
    return F.sha2(F.concat_ws(",", F.transform(kept, lambda v: v.cast("string"))), 256)


def _distinct_hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda v: hash_of(v).cast("int")))


def id_ranges(docs: DataFrame, least: int = RANGE_ROWS) -> Column:
    """Expression of the number of the range of ids a doc_id is in, ascending; -1 for null.

    The limits are quantiles, as many as there are ranges, and are searched by halving.
    """
    total = docs.count()
    ranges = shard_count(total, least)
    limits = []
    if ranges > 1:
        parts = [i / ranges for i in range(1, ranges)]
        limits = sorted(set(docs.agg(F.percentile_approx("doc_id", parts, max(10_000, 20 * ranges))).head()[0] or []))
    if not limits:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    sorted_limits = F.split(F.lit(",".join(map(str, limits))), ",").cast("array<bigint>")
    halves = [1 << i for i in reversed(range(len(limits).bit_length()))]
    place = F.aggregate(
        F.array(*map(F.lit, halves)), F.lit(0),
        lambda at, step: F.when(F.get(sorted_limits, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at),
    )
    return F.when(F.col("doc_id").isNull(), -1).otherwise(place)


def marked(texts: DataFrame) -> DataFrame:
    """Add the length, the fingerprint and its distinct hashes, which later steps need, to rows with a text."""
    kept = texts.withColumn("kept", winnow(F.col("text")))
    return kept.select(
        *texts.columns, F.length("text").cast("long").alias("n_chars"), digest(F.col("kept")).alias("fingerprint"),
        F.size("kept").alias("n_kept"), _distinct_hashes(F.col("kept")).alias("hashes"),
    )


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Rows of doc_id and text as ``marked``, with ``next_<name>`` for every ``carried`` column: its value in the next row.

    The order is descending doc_id, nulls last, equal ids by a hash of the text; after the last row comes the first. Rows
    are sorted within ranges of ids only; the first row of each range is copied behind the last of the range before it.
    """
    ranged = docs.withColumn("range_", id_ranges(docs))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    heads = ranged.groupBy("range_").agg(F.max("doc_id").alias("doc_id"))  # one row per range
    backwards = Window.orderBy(F.desc("range_"))
    heads = heads.select(
        "range_", "doc_id",
        F.coalesce(F.lag("range_").over(backwards), F.min("range_").over(Window.partitionBy())).alias("before_"),
    )
    heads, _ = materialize_counted(heads, "range-heads")
    first = (
        ranged.withColumnRenamed("range_", "own_")
        .join(F.broadcast(heads.withColumnRenamed("doc_id", "head_")), (F.col("own_") == F.col("range_")) & F.col("doc_id").eqNullSafe(F.col("head_")))
        .withColumn("nth_", F.row_number().over(Window.partitionBy("range_").orderBy(*order[1:])))
        .where("nth_ = 1")
        .select("doc_id", "text", F.col("before_").alias("range_"), F.lit(1).alias("copy_"))
    )
    rows = marked(ranged.select("doc_id", "text", "range_", F.lit(0).alias("copy_")).unionByName(first))
    inside = Window.partitionBy("range_").orderBy("copy_", *order)
    return rows.select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in carried]).where("copy_ = 0")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of an edited one, whose second half is the start of the next text.

    ``docs`` has doc_id and text; other columns are ignored. One row per input row: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, n_kept. A null text is empty; the fingerprint of a text
    without a token is that of no hashes; likeness of two such texts is 1. Rows of equal doc_id follow each other in an
    order by text; a single row is its own next. An empty table gives an empty result.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(texts, ["text", "hashes"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = rows.withColumn(
        "edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))
    )
    both = edited.select(
        "doc_id", "n_chars", "fingerprint", "hashes", "next_hashes", F.sha2("edited", 256).alias("edited_sha256"),
        "n_kept", winnow(F.col("edited")).alias("edited_kept"),
    )
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", digest(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), _distinct_hashes(F.col("edited_kept"))).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"), "n_kept",
    )

"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors become whole numbers and are stored as Parquet in the order of label and place on a Hilbert curve, cut into blocks. A zone
map holds, for each block and label, the smallest and largest value of every dimension. For an anchor, interval arithmetic over a
zone gives bounds of all its inner products there, and a block is read only if they meet a window of scores the anchor asks for:

1. an anchor's own block gives a first list of its nearest rows of the same label, and so a least score of its positives,
2. other zones of its label are read if they may hold a better one,
3. zones of other labels are read if they may hold a score in the window below one of its positives.

Anchors that are neighbours on the curve read together, as a chunk. The bounds are safe, so results are exact.
"""

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.llm.helpers import shard_count
from moneytrail.scratch import materialize, materialize_counted

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least so many hundredths of its positive, and no more than it.
HUNDREDTHS = 80
#: Least rows of a block, anchors of a chunk and zones of a part; beyond the square of that they grow with the root of the rows.
BLOCK_ROWS, CHUNK_ROWS, PART_ROWS = 4096, 1024, 1024
#: Bits of a place on the curve, if the dimensions are not more, and the most bits of one dimension.
KEY_BITS, DIMENSION_BITS = 128, 8
#: Whole numbers below it, and sums of them, are exact as floating-point numbers.
EXACT = 2.0**53
LONG = 2**63 - 1
#: Bounds are widened by this share of their terms, far more than rounding can take away.
SLACK = 1e-9
ANYTHING = (-LONG - 1, LONG)
NO_WINDOW = (LONG, -LONG)


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Bits of the place on the Hilbert curve, most significant first, of each row of cells with ``bits`` bits a dimension.

    Going from high bits to low, a cell's set bit turns the lower bits of the first dimension over and an unset one exchanges
    them with those of the dimension; a Gray code over dimensions, then over levels, gives the place.
    """
    x = cells.astype(np.uint32).T.copy()
    if not len(x):
        return np.zeros((cells.shape[0], 0), dtype=np.uint8)
    for level in range(bits - 1, 0, -1):
        lower = np.uint32((1 << level) - 1)
        for d in range(len(x)):
            set_here = (x[d] >> level & 1).astype(bool)
            swap = np.where(set_here, 0, (x[0] ^ x[d]) & lower).astype(np.uint32)
            x[0] ^= np.where(set_here, lower, swap).astype(np.uint32)
            x[d] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turned = np.zeros(x.shape[1], dtype=np.uint32)
    for level in range(bits - 1, 0, -1):
        turned ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0).astype(np.uint32)
    x ^= turned
    return np.concatenate([(x >> level & 1).T for level in range(bits - 1, -1, -1)], axis=1).astype(np.uint8)


def hilbert_key(vector: Column, middle: float, spread: float) -> Column:
    """The place of a vector on the curve as bytes that sort alike; cells are even between ``middle`` - and + 2 ``spread``."""
    @F.pandas_udf("binary")
    def key(vectors: pd.Series) -> pd.Series:
        out = pd.Series([b""] * len(vectors), dtype=object)
        sizes = vectors.map(len).to_numpy()
        for dim in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == dim)
            bits = max(1, min(DIMENSION_BITS, KEY_BITS // dim))
            values = np.vstack(vectors.iloc[at].to_list())
            cells = np.floor(((values - middle) / (4 * spread) + 0.5) * 2**bits).clip(0, 2**bits - 1).astype(np.uint32)
            packed_bits = np.packbits(hilbert_places(cells, bits), axis=1)
            out.iloc[at] = [row.tobytes() for row in packed_bits]
        return out

    return key(vector)


def whole_numbers(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """vec_id, label, dim and v, the components floor(scale * x) as exact floating-point numbers, of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))

    def floored(x):
        return F.when(F.abs(x) < EXACT / 2, F.floor(x).cast("double")).otherwise(x)

    v = F.transform("embedding", lambda x: floored(x.cast("double") * scale))
    return vectors.select("vec_id", label.alias("label"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound
    ).select("vec_id", "label", F.size("embedding").alias("dim"), v.alias("v"))


def stored_blocks(rows: DataFrame, rows_known: int, block_rows: int) -> DataFrame:
    """``rows`` with ``block``, stored in the order of dim, label, Hilbert place. Equal rows may lie in different blocks."""
    flat = rows.select(F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("s"),
                       F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("q"), "dim")
    total = flat.agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("dim").alias("n")).head()
    n = total["n"] or 1
    middle = (total["s"] or 0.0) / n
    spread = math.sqrt(max((total["q"] or 0.0) / n - middle**2, 0.0))
    if not (math.isfinite(middle) and math.isfinite(spread) and spread > 0):
        middle, spread = 0.0, 1.0
    keyed = rows.withColumn("place", hilbert_key(F.col("v"), middle, spread)).withColumn("nth", F.monotonically_increasing_id())
    order = ["dim", "label", "place", "vec_id", "nth"]
    ranges = keyed.repartitionByRange(shard_count(rows_known, block_rows), *order).withColumn("block", F.spark_partition_id())
    return materialize(ranges.sortWithinPartitions(*order).drop("place", "nth"), "hilbert-blocks")


def zone_maps(blocks: DataFrame) -> DataFrame:
    """One row per block, dim and label: zone, an array of (pos, low, high)."""
    per_value = blocks.select("block", "dim", "label", F.posexplode_outer("v").alias("pos", "value"))
    limits = per_value.groupBy("block", "dim", "label", "pos").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    zone = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "low", "high"))))
    return limits.groupBy("block", "dim", "label").agg(zone.alias("zone"))


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return dict(arrays)


def matrix(vectors, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors]).reshape(len(vectors), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, as floats if those hold them, else as Python integers."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < EXACT:
        return a @ b.T

    def integers(m):
        return np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)

    return integers(a) @ integers(b).T if a.shape[1] else np.zeros((len(a), len(b)))


def pack_chunk(rows: pd.DataFrame) -> pd.DataFrame:
    """The anchors of one chunk and dimension, with their windows, as one row."""
    rows = rows.sort_values("anchor")
    widest = max(map(len, rows["lows"]), default=0)

    def square(column, fill):
        return np.array([[*w, *[fill] * (widest - len(w))] for w in rows[column]], dtype=np.int64).reshape(len(rows), widest)

    dim = int(rows["dim"].iloc[0])
    data = packed(
        anchor=rows["anchor"].to_numpy(np.int64), vec_id=rows["vec_id"].to_numpy(np.int64), label=rows["label"].to_numpy(np.int64),
        block=rows["block"].to_numpy(np.int64), v=matrix(rows["v"], dim),
        low=square("lows", NO_WINDOW[0]), high=square("highs", NO_WINDOW[1]),
    )
    return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "dim": [dim], "anchors": [data]})


def pack_zones(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["block", "label"])
    dim = int(rows["dim"].iloc[0])
    data = packed(
        block=rows["block"].to_numpy(np.int64), label=rows["label"].to_numpy(np.int64),
        low=matrix([[z["low"] for z in zone] for zone in rows["zone"]], dim),
        high=matrix([[z["high"] for z in zone] for zone in rows["zone"]], dim),
    )
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "dim": [dim], "zones": [data]})


def bounds(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product that each row of ``v`` can have within each zone, widened for rounding."""
    up, down = np.maximum(v, 0), np.minimum(v, 0)
    with np.errstate(all="ignore"):
        slack = SLACK * (np.abs(v) @ np.maximum(np.abs(low), np.abs(high)).T)
        return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


class Blocks:
    """Stored candidates with their zone maps, to be searched by chunks of anchors."""

    def __init__(self, vectors: DataFrame, label: Column, is_anchor: Column, scale: int = SCALE, block_rows: int = BLOCK_ROWS,
                 chunk_rows: int = CHUNK_ROWS):
        rows, n = materialize_counted(whole_numbers(vectors, label, scale), "whole-vectors")
        self.rows = stored_blocks(rows, n, block_rows)
        zones, count = materialize_counted(zone_maps(self.rows), "zones")
        self.parts = shard_count(count, PART_ROWS)
        part = F.pmod(F.xxhash64("block", "label"), F.lit(self.parts)).cast("int").alias("part")
        self.zones = materialize(
            zones.select("*", part).groupBy("part", "dim").applyInPandas(pack_zones, "part int, dim int, zones binary"), "zone-parts"
        )
        own = self.rows.where(is_anchor).groupBy("vec_id", "label", "dim", "v").agg(F.min("block").alias("block"))
        own, anchors = materialize_counted(own.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
        # blocks that follow each other share a chunk as long as their anchors are few
        together = max(1, chunk_rows * shard_count(n, block_rows) // max(1, anchors))
        self.anchors = own.withColumn("chunk", F.floor(F.col("block") / together).cast("int"))

    def chunks(self, windows: DataFrame) -> DataFrame:
        """One row per chunk and dim with its anchors and their windows, from anchor, lows and highs."""
        asked = self.anchors.join(windows, "anchor")
        return materialize(asked.groupBy("chunk", "dim").applyInPandas(pack_chunk, "chunk int, dim int, anchors binary"), "chunks")

    def to_read(self, chunks: DataFrame, same_label: bool, home: bool) -> DataFrame:
        """The zones each chunk must read: chunk, dim, block, label, and the places of the anchors that need them.

        ``same_label`` asks for zones of the anchor's label, otherwise for all others. With ``home`` only an anchor's own block
        counts, without it all others do, by the bounds of its scores there.
        """
        def choose(batches):
            for pdf in batches:
                for chunk, dim, anchors, zones in zip(pdf["chunk"], pdf["dim"], pdf["anchors"], pdf["zones"]):
                    a, z = unpacked(anchors), unpacked(zones)
                    need = (a["label"][:, None] == z["label"]) == same_label
                    own = a["block"][:, None] == z["block"]
                    if home:
                        need &= own
                    else:
                        least, most = bounds(a["v"], z["low"], z["high"])
                        meets = np.zeros_like(need)
                        for low, high in zip(a["low"].T, a["high"].T):
                            # written so that a bound that is not a number excludes nothing; the ends of longs stand for no limit
                            under, over = (most < low[:, None]) & (low > ANYTHING[0])[:, None], (least > high[:, None]) & (high < LONG)[:, None]
                            meets |= (low <= high)[:, None] & ~under & ~over
                        need &= meets & ~(own & same_label)
                    at = np.flatnonzero(need.any(axis=0))
                    yield pd.DataFrame({
                        "chunk": np.full(len(at), chunk), "dim": dim, "block": z["block"][at], "label": z["label"][at],
                        "needed": [np.flatnonzero(need[:, j]).astype(np.int32).tobytes() for j in at],
                    })

        every = F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part")
        pairs = chunks.select("*", every).join(self.zones, ["part", "dim"])
        return materialize(pairs.select("chunk", "dim", "anchors", "zones").mapInPandas(
            choose, "chunk int, dim int, block int, label bigint, needed binary"
        ), "to-read")

    def search(self, chunks: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
        """anchor, nth window, vec_id, score: the ``most`` best of every window in each zone the chunk reads."""
        def best(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(asked) and len(block):
                block = block.sort_values("vec_id")
                ids, dim = block["vec_id"].to_numpy(np.int64), int(block["dim"].iloc[0])
                b = matrix(block["v"], dim)
                for anchors, needed in zip(asked["anchors"], asked["needed"]):
                    a, at = unpacked(anchors), np.frombuffer(needed, dtype=np.int32)
                    for i, scores in zip(at, products(a["v"][at], b)):
                        found.extend(in_windows(a, i, ids, scores, most))
            columns = ["anchor", "window", "vec_id", "score"]
            return pd.DataFrame(found, columns=columns).astype("int64")

        zone = ["dim", "block", "label"]
        asking = wanted.join(chunks, ["chunk", "dim"])
        readers = wanted.drop("needed").withColumnRenamed("chunk", "reader")
        read = self.rows.withColumn("label", F.col("label").cast("long")).join(readers, zone)
        return asking.groupBy("chunk", *zone).cogroup(read.groupBy("reader", *zone)).applyInPandas(
            best, "anchor bigint, window int, vec_id bigint, score bigint"
        )


def in_windows(a: dict, i: int, ids: np.ndarray, scores: np.ndarray, most: int) -> list[tuple]:
    """(anchor, window, vec_id, score) of the ``most`` best scores in each window of one anchor; rows come by vec_id."""
    order = np.argsort(-scores, kind="stable")
    order = order[ids[order] != a["vec_id"][i]]
    ranked, out = scores[order], []
    for w, (low, high) in enumerate(zip(a["low"][i].tolist(), a["high"][i].tolist())):
        # the ends of the windows that ask for anything hold scores that no long can
        start = 0 if high >= LONG else np.searchsorted(-ranked, -high, "left")
        for at in order[start:start + most].tolist():
            if low > -LONG and scores[at] < low:
                break
            out.append((int(a["anchor"][i]), w, int(ids[at]), min(LONG, max(-LONG - 1, int(scores[at])))))
    return out


def mine(vectors: DataFrame, is_anchor: Column, label: Column | str = "label", scale: int = SCALE, positives: int = POSITIVES,
         negatives: int = NEGATIVES, hundredths: int = HUNDREDTHS, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, positive_rank, rank, negative_id, both scores.

    ``vectors`` has vec_id, embedding (an array of floating-point numbers) and what the whole number ``label`` is made of; other
    columns are ignored. ``is_anchor`` is a condition on vec_id. A score is the inner product of the components floor(scale * x); higher
    comes first, then the smaller vec_id. Positives are the first other rows of the anchor's label; negatives of a positive the
    first rows of other labels whose score lies between ``hundredths`` of the positive's and the positive's, none if that is
    below 0. Rows without vec_id, label or vector, or with a component that is null, not finite or beyond a double once scaled,
    take no part. Vectors meet only those of their length, empty ones with score 0. Rows with the anchor's vec_id are its own.
    Repeated rows are candidates of their own; a repeated anchor is answered once. Scores beyond a long saturate. An empty table
    gives an empty result.
    """
    label = F.col(label) if isinstance(label, str) else label
    found = Blocks(vectors, label, is_anchor, scale, block_rows, chunk_rows)
    by_anchor = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")

    def window(name, end):
        return F.array(F.lit(end).cast("long") if isinstance(end, int) else end).alias(name)

    # the anchor's own block first: its last positive there bounds the search of the others
    open_ended = found.anchors.select("anchor", window("lows", ANYTHING[0]), window("highs", ANYTHING[1]))
    chunks = found.chunks(open_ended)
    near = materialize(found.search(chunks, found.to_read(chunks, True, True), positives), "near")
    enough = near.groupBy("anchor").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= positives)
    bounded = found.anchors.select("anchor").join(enough, "anchor", "left").select(
        "anchor", window("lows", F.coalesce("least", F.lit(ANYTHING[0]).cast("long"))), window("highs", ANYTHING[1])
    )
    chunks = found.chunks(bounded)
    far = found.search(chunks, found.to_read(chunks, True, False), positives)
    chosen = materialize(
        near.unionByName(far).withColumn("nth", F.row_number().over(by_anchor)).where(F.col("nth") <= positives)
        .select("anchor", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
        "positives",
    )

    # one window below each positive
    below = F.col("positive_score") - F.expr(f"cast(cast(positive_score as decimal(20)) * {100 - hundredths} div 100 as bigint)")
    spans = chosen.where("positive_score >= 0").withColumn("low", below)
    listed = F.sort_array(F.collect_list(F.struct("nth", "low", "positive_score")))
    windows = spans.groupBy("anchor").agg(listed.alias("w")).select("anchor", F.col("w.low").alias("lows"), F.col("w.positive_score").alias("highs"))
    chunks = found.chunks(windows)
    hard = found.search(chunks, found.to_read(chunks, False, False), negatives)
    by_window = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    ranked = hard.withColumn("rank", F.row_number().over(by_window)).where(F.col("rank") <= negatives).select(
        "anchor", (F.col("window") + 1).alias("nth"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    names = found.anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return ranked.join(chosen, ["anchor", "nth"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("nth").alias("positive_rank"), "rank", "negative_id", "positive_score", "negative_score"
    )

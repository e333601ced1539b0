"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors become whole numbers and are spread over blocks. A task holds one block and a chunk of queries. It indexes the
block: the postings of each dimension, in the order of their absolute values, are cut into segments of equal quantised
impact. For a query, segments are processed by descending impact, that is query component times the segment's largest
value. What no segment has added yet is at most the sum over the dimensions of the impact of the next segment; as soon as
this proves that all but a few vectors stay behind the k-th, the remaining members are rescored exactly. The ranks of
all blocks are merged at the end.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.llm.helpers import shard_count

K = 10
SCALE = 1024
LEVELS = 16
BLOCK_ROWS = 4096
CHUNK_ROWS = 2048
#: Sums of products below this are computed as 64-bit numbers, larger ones as Python integers.
LIMIT = 2.0**62
LONG = 2**63 - 1
#: Segments between two tries to prove the end, and the share of a block that is cheaper rescored than processed.
STEPS, FEW = 48, 16


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, values floor(scale * x) as exact floating-point numbers, and how many; without vectors that take no part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))

    def floored(x):
        # numbers from 2^53 on are whole
        return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)

    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        "vec_id", F.transform("embedding", lambda x: floored(x.cast("double") * scale)).alias("v"), F.size("embedding").alias("dim")
    )


class ImpactIndex:
    """Segments of a block of vectors, and exact search in them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        dims, rows, bounds = [], [], []
        for d in range(vectors.shape[1]):
            size = np.abs(vectors[:, d])
            level = (size * (LEVELS / (float(size.max()) + 1))).astype(np.int64)
            order = np.argsort(-level, kind="stable")
            cuts = np.flatnonzero(np.diff(level[order])) + 1
            for segment in np.split(order, cuts):
                dims.append(d)
                rows.append(segment)
                bounds.append(size[segment].max())
        self.rows = rows
        self.values = [vectors[r, d] for r, d in zip(rows, dims)]
        self.dims, self.bounds = np.array(dims, dtype=np.int64), np.array(bounds, dtype=np.int64)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best by (score, smaller id) but the query's own; all that tie with the k-th are ranked."""
        others = np.flatnonzero(self.ids != query_id)
        members = others
        if len(others) > k and len(query):
            members = others[self.possible(query, others, k)]
        scores = self.vectors[members] @ query
        best = np.lexsort((self.ids[members], -scores))[:k]
        return self.ids[members][best], scores[best]

    def possible(self, query: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
        """Places among ``others`` of the vectors not proven to stay behind the k-th."""
        impact = np.abs(query)[self.dims] * self.bounds
        order = np.argsort(-impact, kind="stable")
        left = np.zeros(len(query), dtype=np.int64)
        np.maximum.at(left, self.dims, impact)
        following = self.following(impact)
        partial = np.zeros(len(self.ids), dtype=np.int64)
        for at, s in enumerate(order, 1):
            d = self.dims[s]
            partial[self.rows[s]] += query[d] * self.values[s]
            left[d] = following[s]
            if at % STEPS == 0 or at == len(order):
                rest, seen = left.sum(), partial[others]
                least = np.partition(seen, len(seen) - k)[len(seen) - k] - rest
                members = np.flatnonzero(seen + rest >= least)
                if len(members) <= max(4 * k, len(others) // FEW):
                    return members
        return members

    def following(self, impact: np.ndarray) -> np.ndarray:
        """Impact of the next segment of the same dimension, 0 after the last."""
        after = np.append(impact[1:], 0)
        after[:-1][self.dims[1:] != self.dims[:-1]] = 0
        return after


def search_widely(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """Like ``ImpactIndex.search`` for products that 64 bits do not hold: all rows are scored with Python integers."""
    factors = [int(x) for x in query]
    scored = [(-sum(f * int(x) for f, x in zip(factors, row)), i) for i, row in zip(ids.tolist(), vectors) if i != query_id]
    best = sorted(scored)[:k]
    return [i for _, i in best], [min(LONG, max(-LONG - 1, -s)) for s, _ in best]


def search_block(k: int):
    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(block):
            ids, vectors = block["vec_id"].to_numpy(np.int64), np.vstack(block["v"].to_list()).astype(np.float64)
            largest, index = float(np.abs(vectors).max(initial=0)), None
            for query_id, vector in zip(queries["vec_id"], queries["v"]):
                query = np.asarray(vector, dtype=np.float64)
                if len(query) * largest * float(np.abs(query).max(initial=0)) < LIMIT and largest < LIMIT:
                    index = index or ImpactIndex(ids, vectors.astype(np.int64))
                    best, scores = index.search(query_id, query.astype(np.int64), k)
                else:
                    best, scores = search_widely(ids, vectors, query_id, query, k)
                found.append(pd.DataFrame({"query_id": query_id, "vec_id": best, "score": scores}))
        return pd.concat(found).astype("int64") if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return search


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE) -> DataFrame:
    """The ``k`` highest inner products of every query with all other rows: query_id, rank from 1, vec_id, score.

    ``vectors`` has vec_id and embedding, an array of floating-point numbers; other columns are ignored. ``is_query`` is
    a condition on vec_id. Ties go to the smaller vec_id; a query with fewer candidates gets all of them. Rows without
    vec_id, vectors that are null or hold null or non-finite components take no part; vectors meet only those of the same
    number of components, empty ones with score 0. A row is a query's own if it has its vec_id. Repeated rows are
    candidates of their own; a repeated query is answered once. Scores are exact; one beyond a long is given as the nearest long,
    and rows take no part whose scaled components are beyond a double.
    """
    rows = whole_numbers(vectors, scale)
    queries = rows.where(is_query).dropDuplicates(["vec_id", "v"])
    blocks = shard_count(rows.count(), BLOCK_ROWS)
    chunks = shard_count(queries.count(), CHUNK_ROWS)

    def spread(df, own, parts, other, copies):
        number = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(parts)).cast("int")
        return df.withColumn(own, number).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    key = ["dim", "block", "chunk"]
    found = (
        spread(queries, "chunk", chunks, "block", blocks).groupBy(*key)
        .cogroup(spread(rows, "block", blocks, "chunk", chunks).groupBy(*key))
        .applyInPandas(search_block(k), "query_id bigint, vec_id bigint, score bigint")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

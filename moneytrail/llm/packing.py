"""Conflict-constrained best-fit packing of documents into training sequences.

A bin holds at most ``capacity`` words, and no two pieces of one source or of one cluster of duplicates. Pieces go, longest
first, to the bin with the least residual that still takes them: bins are ordered by residual, each carries bitmaps of its
sources and clusters, and the search goes from residual to residual until the tightest compatible bin is found.
Documents are dealt to shards by hash; a task packs one shard, from a few columns without the text.
"""

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.llm.helpers import SPACE, shard_count, word_count
from moneytrail.scratch import materialize_counted

CAPACITY = 2048
#: Least documents of a shard; beyond some millions it is the root of their number.
SHARD_ROWS = 2000


class Bins:
    """Open bins in the order of their residuals."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residual: list[int] = []
        self.filled: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.at: dict[int, list[int]] = defaultdict(list)
        self.open = 0  # bit r: there are bins of residual r
        self.holding: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))  # source, residual: bins with the source
        self.barred: dict[int, int] = defaultdict(int)  # source: bit r: all bins of residual r have the source

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and position of a piece."""
        found = self._tightest(size, source, cluster)
        if found is None:
            found = len(self.residual)
            for column, value in ((self.residual, self.capacity), (self.filled, 0), (self.sources, 0), (self.clusters, 0)):
                column.append(value)
        else:
            self._take_out(found)
        position = self.filled[found]
        self.residual[found] -= size
        self.filled[found] += 1
        self.sources[found] |= 1 << source
        self.clusters[found] |= 1 << cluster
        if self.residual[found]:
            self._put_in(found)
        return found, position

    def _tightest(self, size: int, source: int, cluster: int) -> int | None:
        """The first compatible bin of the smallest residual from ``size`` up; residuals whose bins all have the source are passed over."""
        left = (self.open & ~self.barred[source]) >> size << size
        while left:
            residual = (left & -left).bit_length() - 1
            for b in self.at[residual]:
                if not self.sources[b] >> source & 1 and not self.clusters[b] >> cluster & 1:
                    return b
            left &= left - 1
        return None

    def _take_out(self, b: int) -> None:
        residual = self.residual[b]
        self.at[residual].remove(b)
        for s in _bits(self.sources[b]):
            self.holding[s][residual] -= 1
        self._mark(residual, self.sources[b])

    def _put_in(self, b: int) -> None:
        residual = self.residual[b]
        self.at[residual].append(b)
        for s in _bits(self.sources[b]):
            self.holding[s][residual] += 1
        self._mark(residual, self.sources[b])

    def _mark(self, residual: int, sources: int) -> None:
        """Set the bits of a residual anew for the sources that may have gained or lost it: those of the moved and of any one bin."""
        bins, bit = self.at[residual], 1 << residual
        self.open = self.open | bit if bins else self.open & ~bit
        for s in _bits(sources | (self.sources[bins[0]] if bins else 0)):
            if bins and self.holding[s][residual] == len(bins):
                self.barred[s] |= bit
            else:
                self.barred[s] &= ~bit


def _bits(bitmap: int):
    while bitmap:
        yield (bitmap & -bitmap).bit_length() - 1
        bitmap &= bitmap - 1


def pack_shard(capacity: int):
    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rest", "text_hash", "doc_id"], ascending=[False, True, True], kind="stable")
        sources, clusters = (pd.factorize(rows[c], use_na_sentinel=False)[0].tolist() for c in ("source", "cluster"))
        bins = Bins(capacity)
        out = []
        for row, source, cluster in zip(rows.itertuples(index=False), sources, clusters):
            if row.rest:
                out.append((row.at, row.full, *bins.place(row.rest, source, cluster)))
        number = len(bins.residual)
        for row in rows.itertuples(index=False):
            for piece in range(row.full):
                out.append((row.at, piece, number, 0))
                number += 1
        return pd.DataFrame(out, columns=["at", "piece", "bin", "position"]).merge(rows, on="at")[
            ["doc_id", "text_hash", "source", "n_words", "shard", "piece", "bin", "position"]
        ]

    def numbered(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(at=range(len(rows)), full=rows["n_words"] // capacity, rest=rows["n_words"] % capacity)
        return packed(rows)

    return numbered


PLACED = "doc_id bigint, text_hash bigint, source string, n_words bigint, shard int, piece bigint, bin bigint, position bigint"


def cluster_of(text: Column) -> Column:
    """A cluster for each distinct sequence of words, letters A-Z in either case."""
    return F.xxhash64(F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), SPACE, " ")))


def pack(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Places of all documents: doc_id, source, text_hash, n_words of the document, piece, first_word, size, bin_id, position.

    ``docs`` has doc_id, text and source; other columns are ignored. ``cluster`` names duplicates, by default texts of the
    same words. A document longer than ``capacity`` words is cut into pieces: full ones fill a bin alone, the rest is
    placed like a short document. A null source or cluster conflicts with itself like a value. A document without words
    gets one row without bin. Repeated rows are documents of their own. An empty table gives an empty result.
    """
    cluster = cluster_of(F.col("text")) if cluster is None else cluster
    sized, rows = materialize_counted(
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", cluster.cast("bigint").alias("cluster"), word_count(F.col("text")).alias("n_words")),
        "to-pack",
    )
    shards = shard_count(rows, SHARD_ROWS)
    dealt = sized.where("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(shards)).cast("int"))
    placed = dealt.groupBy("shard").applyInPandas(pack_shard(capacity), PLACED)
    first = F.col("piece") * capacity
    with_bin = placed.select(
        "doc_id", "source", "text_hash", "n_words", "piece", first.alias("first_word"),
        F.least(F.lit(capacity), F.col("n_words") - first).cast("bigint").alias("size"),
        F.concat_ws("-", "shard", "bin").alias("bin_id"), "position",
    )
    none = sized.where("n_words = 0").select(
        "doc_id", "source", "text_hash", "n_words", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("first_word"),
        F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("bigint").alias("position"),
    )
    return with_bin.unionByName(none)


def packed_texts(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` with the text of every piece: the whole text of a document of one piece, else its words joined by one space."""
    places = pack(docs, capacity=capacity)
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    key, code = "id_", "text_hash"
    texts = docs.select(known.alias(key), F.xxhash64("text").alias(code), "text")
    first = texts.groupBy(key, code).agg(F.min("text").alias("text"))  # repeated rows have one text
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    cut = F.array_join(F.slice(words, (F.col("first_word") + 1).cast("int"), F.col("size").cast("int")), " ")
    whole = F.col("size") == F.col("n_words")
    return (
        places.withColumn(key, known).join(first, [key, code], "left")
        .select(*[c for c in places.columns if c != code], F.when(whole, F.coalesce("text", F.lit(""))).otherwise(cut).alias("text"))
    )

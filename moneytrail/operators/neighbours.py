"""Exact nearest neighbours of every account, without comparing all pairs.

Accounts with equal features form one site with a weight. A tree of median cuts through a sample divides space into cells of
some thousand sites. The nearest sites within its own cell bound how far a site must look. A site is sent to a foreign cell only
if it lies within that bound of a box around some of the cell's sites, and arrives there as a stream of batches that are
compared block by block, the nearest box first, so a task holds one cell and one batch, however many sites come.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.functions.ranking import running_total, smallest_hashes
from moneytrail.scratch import materialize, materialize_counted

#: Cells at most, sites of a cell if there are no more than that, sites of a block, and sites that cuts are chosen from.
MAX_PIVOTS, SITES, CHUNK, SAMPLE = 1024, 2048, 1000, 16384


def vector(columns: list[str]) -> Column:
    """The columns as one array; adding zero turns -0.0 into 0.0, so that equal means equal bits."""
    return F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns])


def sites(points: DataFrame, columns: list[str]) -> DataFrame:
    """``(site, weight, v)``: distinct feature vectors named after their smallest account id."""
    return points.groupBy(vector(columns).alias("v")).agg(
        F.min("account_id").alias("site"), F.count("*").alias("weight")
    ).select("site", "weight", "v")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


class Cuts:
    """Median cuts through a sample, each across the axis that varies most, that make at most ``cells`` cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        # axis, threshold, lower and upper node; a cell has axis -1 and its number in place of the lower node
        self.nodes, self.cells, todo = [(-1, 0.0, 0, 0)], 0, [(0, sample, cells)]
        while todo:
            at, v, wanted = todo.pop()
            axis = int(v.std(axis=0).argmax()) if len(v) and wanted > 1 else -1
            values = np.unique(v[:, axis]) if axis >= 0 else np.zeros(0)
            if len(values) < 2:
                self.nodes[at] = -1, 0.0, self.cells, self.cells
                self.cells += 1
                continue
            threshold = min(float(np.quantile(v[:, axis], 0.5, method="lower")), float(values[-2]))
            low, below = len(self.nodes), v[:, axis] <= threshold
            self.nodes += [(-1, 0.0, 0, 0)] * 2
            self.nodes[at] = axis, threshold, low, low + 1
            todo += [(low, v[below], wanted - wanted // 2), (low + 1, v[~below], wanted // 2)]

    def cell(self, v: np.ndarray) -> np.ndarray:
        axis, threshold, low, high = (np.array(c) for c in zip(*self.nodes))
        at = np.zeros(len(v), dtype=np.int64)
        while (inner := np.flatnonzero(axis[at] >= 0)).size:
            here = at[inner]
            at[inner] = np.where(v[inner, axis[here]] <= threshold[here], low[here], high[here])
        return low[at].astype("int32")


def halved(v: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of the rows of ``v`` in blocks of at most ``size``, cut in halves across the axis that varies most."""
    blocks, todo = [], [np.arange(len(v))] if len(v) else []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            blocks.append(rows)
        else:
            order = rows[np.argsort(v[rows, v[rows].std(axis=0).argmax()], kind="stable")]
            todo += [order[:len(order) // 2], order[len(order) // 2:]]
    return blocks


def gaps(low: np.ndarray, high: np.ndarray, box_low: np.ndarray, box_high: np.ndarray) -> np.ndarray:
    """Distances between two sets of boxes. Rounding keeps order, so none is above that of two sites in them."""
    total = np.zeros((len(low), len(box_low)))
    for j in range(low.shape[1]):
        total += np.maximum(np.maximum(box_low[None, :, j] - high[:, j, None], low[:, j, None] - box_high[None, :, j]), 0.0) ** 2
    return np.sqrt(total)


class Lists:
    """The nearest sites of the sites of a cell, among those it has met so far."""

    def __init__(self, v: np.ndarray, nth: np.ndarray, k: int, block: int):
        self.v, self.nth, self.k, self.block = v, nth, k, block
        self.blocks = halved(v, block)
        self.low, self.high = (np.array([f(v[rows], axis=0) for rows in self.blocks]).reshape(-1, v.shape[1]) for f in (np.min, np.max))
        #: How far a site must look: no neighbour it lacks is farther away.
        self.reach = np.full(len(v), np.inf)
        # row, distance (-1 to itself), number, weight and name of each neighbour, per block
        none = np.zeros(0, dtype=np.int64)
        self.near = [(none, np.zeros(0), none, none, np.zeros(0, dtype=object)) for _ in self.blocks]

    def resume(self, reach: np.ndarray, lengths: np.ndarray, d: np.ndarray, nth: np.ndarray, weight: np.ndarray, names: np.ndarray) -> None:
        """Takes up lists made before, given one after the other."""
        self.reach, starts = reach.copy(), np.cumsum(lengths) - lengths
        for n, rows in enumerate(self.blocks):
            at = np.repeat(starts[rows] - (np.cumsum(lengths[rows]) - lengths[rows]), lengths[rows]) + np.arange(lengths[rows].sum())
            row = np.repeat(rows, lengths[rows])
            self.near[n] = row, np.where(nth[at] == self.nth[row], -1.0, d[at]), nth[at], weight[at], names[at]

    def meet(self, v: np.ndarray, nth: np.ndarray, weight: np.ndarray, names: np.ndarray) -> None:
        parts = halved(v, self.block)
        low, high = (np.array([f(v[rows], axis=0) for rows in parts]).reshape(-1, v.shape[1]) for f in (np.min, np.max))
        for n, (rows, between) in enumerate(zip(self.blocks, gaps(self.low, self.high, low, high))):
            for at in np.argsort(between, kind="stable"):
                if between[at] > self.reach[rows].max():
                    break
                mine = rows[gaps(self.v[rows], self.v[rows], low[at:at + 1], high[at:at + 1])[:, 0] <= self.reach[rows]]
                if len(mine):
                    theirs = parts[at]
                    i, j, d = self._pairs(mine, v[theirs])
                    self._take(n, mine[i], d, nth[theirs[j]], weight[theirs[j]], names[theirs[j]])

    def _pairs(self, mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that may be neighbours. A product of matrices finds them, within its rounding; their distances are exact."""
        middle = (other.min(axis=0) + other.max(axis=0)) / 2
        a, b, reach = self.v[mine] - middle, other - middle, self.reach[mine]
        squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
        error = squares * (16 * (a.shape[1] + 4) * np.finfo(float).eps)
        rough = squares - 2.0 * (a @ b.T)
        limit = reach * reach * (1 + 1e-12)
        open_, k = np.flatnonzero(np.isinf(reach)), self.k
        if len(open_) and len(other) > k:
            limit[open_] = np.partition(rough[open_] + error[open_], k, axis=1)[:, k] * (1 + 1e-12)
        i, j = np.nonzero(rough - error <= limit[:, None])
        total = np.zeros(len(i))
        for axis in range(other.shape[1]):
            total += (self.v[mine[i], axis] - other[j, axis]) ** 2
        d = np.sqrt(total)
        kept = d <= reach[i]
        return i[kept], j[kept], d[kept]

    def _take(self, n: int, row, d, nth, weight, names) -> None:
        """Lists by distance, then name, until they stand for ``k + 1`` accounts."""
        d = np.where(nth == self.nth[row], -1.0, d)
        row, d, nth, weight, names = (np.concatenate(c) for c in zip(self.near[n], (row, d, nth, weight, names)))
        order = np.lexsort((nth, d, row))
        row, total = row[order], np.cumsum(weight[order])
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=np.int64)
        lengths = np.diff(np.r_[first, len(row)])
        before = total - weight[order]
        before -= np.repeat(before[first], lengths)
        kept = before <= self.k
        order, row, before = order[kept], row[kept], before[kept]
        self.near[n] = row, d[order], nth[order], weight[order], names[order]
        last = np.flatnonzero(np.r_[row[1:] != row[:-1], True]) if len(row) else first
        full = last[before[last] + weight[order][last] > self.k]
        self.reach[row[full]] = np.maximum(d[order][full], 0.0)

    def columns(self) -> dict[str, list[np.ndarray]]:
        """A list per site of the names, distances, weights and numbers of its neighbours."""
        row, d, nth, weight, names = (np.concatenate(c) for c in zip(*self.near))
        order = np.argsort(row, kind="stable")
        ends = np.cumsum(np.bincount(row, minlength=len(self.v)))[:-1]
        found = {"names": names, "distances": np.maximum(d, 0.0), "weights": weight, "numbers": nth}
        return {name: np.split(x[order], ends) for name, x in found.items()}


#: Shares of a block's sites that look less far than the others and have a box of their own.
LEVELS = (0.5, 0.9, 0.99, 1.0)


def nearest(all_sites: DataFrame, k: int, pivots: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``(site, neighbour, distance, weight, place)``: for each site the nearest sites, itself first.

    Neighbours are listed by distance, then id, until they stand for at least ``k + 1`` accounts. ``pivots`` is the number of
    cells, by default one for every 2048 sites, and ``chunk`` that of the sites in a block.
    """
    numbered = running_total(all_sites.select("site", "weight", "v"), ["site"], F.lit(1)).withColumnRenamed("before", "nth")
    stored, n = materialize_counted(numbered, "sites")
    if n == 0:
        return _no_rows(stored)
    spark = all_sites.sparkSession
    wanted = min(MAX_PIVOTS, max(1, n // SITES) if pivots is None else pivots)
    # bounded, whatever the number of sites
    sample = matrix(smallest_hashes(stored, "site", SAMPLE).select("v").toPandas()["v"])
    cuts = Cuts(sample, wanted)
    tasks = min(cuts.cells, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=cuts.cell(matrix(pdf["v"])))

    own = "site string, weight bigint, v array<double>, nth bigint, cell int"
    listed = "names array<string>, distances array<double>, weights array<bigint>, numbers array<bigint>"

    def in_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        lists = Lists(matrix(pdf["v"]), pdf["nth"].to_numpy(), k, chunk)
        lists.meet(lists.v, lists.nth, pdf["weight"].to_numpy(), pdf["site"].to_numpy())
        level = np.zeros(len(pdf), dtype="int32")
        for at, rows in enumerate(lists.blocks):
            ends = np.ceil(np.array(LEVELS) * len(rows)).astype(int)
            level[rows[np.argsort(lists.reach[rows], kind="stable")]] = at * len(LEVELS) + np.searchsorted(ends, np.arange(len(rows)), side="right")
        return pdf.assign(reach=lists.reach, level=level, **lists.columns())

    assigned = stored.mapInPandas(assign, own).repartition(tasks, "cell")
    near = materialize(assigned.groupBy("cell").applyInPandas(in_cell, f"{own}, reach double, level int, {listed}"), "near-in-cell")
    width = sample.shape[1]
    boxes = near.groupBy("cell", "level").agg(
        F.max("reach").alias("reach"), *[f(F.get("v", F.lit(i))).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(width)]
    ).toPandas().sort_values(["cell", "level"])
    low, high = (boxes[[f"{f}{i}" for i in range(width)]].to_numpy() for f in ("min", "max"))
    reach, cell_of = boxes["reach"].to_numpy(), boxes["cell"].to_numpy()
    around = {
        int(c): (low[at].min(axis=0)[None], high[at].max(axis=0)[None], reach[at].max(), low[at], high[at], reach[at])
        for c in np.unique(cell_of) for at in [cell_of == c]
    }

    def send(batches):
        """Copies of sites for the foreign cells in whose reach they lie."""
        for pdf in batches:
            v, home = matrix(pdf["v"]), pdf["cell"].to_numpy()
            for cell, (its_low, its_high, most, lows, highs, reaches) in around.items():
                at = np.flatnonzero(home != cell)
                at = at[gaps(v[at], v[at], its_low, its_high)[:, 0] <= most]
                at = at[(gaps(v[at], v[at], lows, highs) <= reaches).any(axis=1)]
                if len(at):
                    yield pdf.iloc[at].assign(cell=np.int32(cell))

    def resumed(pdf: pd.DataFrame) -> tuple[np.ndarray, Lists]:
        lists = Lists(matrix(pdf["v"]), pdf["nth"].to_numpy(), k, chunk)
        if len(pdf):
            d, nth, weight, names = (np.concatenate(pdf[c].to_numpy()) for c in ("distances", "numbers", "weights", "names"))
            lists.resume(pdf["reach"].to_numpy(), pdf["names"].map(len).to_numpy(), d, nth.astype(np.int64), weight.astype(np.int64), names)
        return pdf["site"].to_numpy(), lists

    def listing(sites_: np.ndarray, lists: Lists) -> pd.DataFrame:
        found = lists.columns()
        return pd.DataFrame({"site": sites_, **{c: found[c] for c in ("names", "distances", "weights")}})

    def search(batches):
        """The lists of each cell; its own sites come before those sent to it."""
        cell, own_rows, lists = None, [], None
        for batch in batches:
            for (here, foreign), pdf in batch.groupby(["cell", "foreign"]):
                if here != cell:
                    if own_rows:
                        yield listing(*(lists or resumed(pd.concat(own_rows))))
                    cell, own_rows, lists = here, [], None
                if not foreign:
                    own_rows.append(pdf)
                    continue
                lists = lists or resumed(pd.concat(own_rows))
                lists[1].meet(matrix(pdf["v"]), pdf["nth"].to_numpy(), pdf["weight"].to_numpy(), pdf["site"].to_numpy())
        if own_rows:
            yield listing(*(lists or resumed(pd.concat(own_rows))))

    if len(around) > 1:
        sent = near.select("site", "weight", "v", "nth", "cell").mapInPandas(send, own).withColumn("foreign", F.lit(True))
        meeting = near.drop("level").withColumn("foreign", F.lit(False)).unionByName(sent, allowMissingColumns=True)
        near = meeting.repartition(tasks, "cell").sortWithinPartitions("cell", "foreign").mapInPandas(
            search, "site string, names array<string>, distances array<double>, weights array<bigint>"
        )
    each = F.posexplode(F.arrays_zip("names", "distances", "weights")).alias("at", "o")
    return near.select("site", each).select(
        "site", F.col("o.names").alias("neighbour"), F.col("o.distances").alias("distance"), F.col("o.weights").alias("weight"), (F.col("at") + 1).alias("place")
    )


def _no_rows(stored: DataFrame) -> DataFrame:
    return stored.limit(0).select(
        "site", F.col("site").alias("neighbour"), F.lit(0.0).alias("distance"), "weight", F.lit(0).alias("place")
    )

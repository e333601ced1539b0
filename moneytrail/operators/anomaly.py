"""Unsupervised anomaly scores: an isolation forest, local outlier factors and their ensemble."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.functions.ranking import exact_quantile, smallest_hashes
from moneytrail.functions.skew import hot_keys, salted_join
from moneytrail.operators.features import standardise
from moneytrail.operators.neighbours import nearest, sites, vector
from moneytrail.operators.projections import nearest_approximate
from moneytrail.operators.quality import finite_or_zero
from moneytrail.scratch import materialize, materialize_counted, sorted_join

# Ensemble settings.
TREES = 300
SAMPLE = 256
CONTAMINATION = 0.08
NEIGHBOURS = 20
ISO_WEIGHT, LOF_WEIGHT = 0.6, 0.4
THRESHOLD = 0.65
SEED = 42
# Fixed value: added to a mean reachability before it is inverted.
DENSITY_EPSILON = 1e-10

TREE_SCHEMA = "tree int, node int, feature int, threshold double, low int, high int, path double"


def mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, limit: int, rng: np.random.RandomState) -> list[tuple]:
    """One random tree as rows ``(node, feature, threshold, low, high, path)``; leaves have feature -1."""
    rows, todo = [], [(0, x, 0)]
    made = 1
    while todo:
        node, part, depth = todo.pop()
        varies = np.flatnonzero(part.max(axis=0) > part.min(axis=0))
        if depth >= limit or len(part) <= 1 or len(varies) == 0:
            rows.append((node, -1, 0.0, -1, -1, depth + mean_path(len(part))))
            continue
        feature = int(rng.choice(varies))
        values = part[:, feature]
        threshold = float(rng.uniform(values.min(), values.max()))
        threshold = min(threshold, float(np.nextafter(values.max(), -np.inf)))
        below = values <= threshold
        rows.append((node, feature, threshold, made, made + 1, 0.0))
        todo += [(made, part[below], depth + 1), (made + 1, part[~below], depth + 1)]
        made += 2
    return rows


def fit_forest(matrix: DataFrame, columns: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The trees of an isolation forest as a table; one task grows a tree from at most ``sample`` rows.

    Samples are drawn without replacement from a pool of at most ``trees * sample`` accounts, which are those
    with the smallest seeded hashes.
    """
    clean = finite_or_zero(matrix.select("account_id", *columns), columns)
    pool = materialize(
        smallest_hashes(clean, "account_id", trees * sample, seed)
        # the pool is bounded, whatever the number of accounts
        .withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64("account_id", F.lit(seed)), "account_id")) - 1),
        "forest-pool",
    )
    size = pool.count()
    if size == 0:
        raise ValueError("cannot fit on no accounts")
    drawn = min(sample, size)
    limit = math.ceil(math.log2(max(drawn, 2)))

    def draw(batches):
        for pdf in batches:
            for tree in pdf["id"]:
                picked = np.random.RandomState(seed + int(tree)).choice(size, drawn, replace=False)
                yield pd.DataFrame({"tree": np.int32(tree), "place": picked.astype("int32")})

    def grow(key, pdf):
        rng = np.random.RandomState([seed, int(key[0])])
        ordered = pdf.sort_values("place")
        rows = _grow(ordered[columns].to_numpy(dtype=float), limit, rng)
        out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "low", "high", "path"])
        out.insert(0, "tree", key[0])
        return out

    draws = matrix.sparkSession.range(trees).mapInPandas(draw, "tree int, place int")
    return materialize(draws.join(pool, "place").groupBy("tree").applyInPandas(grow, TREE_SCHEMA), "forest")


class Forest:
    """Stored trees as arrays. Their size depends on the forest settings only, not on the data."""

    #: Rows walked at once.
    SLICE = 1024

    def __init__(self, trees: DataFrame):
        table = trees.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        first = table.groupby("tree").head(1).index.to_numpy()
        offset = np.repeat(first, np.diff([*first, len(table)]))
        inner = table["feature"].to_numpy() >= 0
        own = np.arange(len(table))
        # a leaf leads to itself, so all trees are walked together
        self.roots, self.path = first, table["path"].to_numpy()
        self.feature, self.threshold = np.where(inner, table["feature"], 0), table["threshold"].to_numpy()
        self.low, self.high = (np.where(inner, table[c] + offset, own) for c in ("low", "high"))

    def mean_paths(self, x: np.ndarray) -> np.ndarray:
        parts = [self._mean_paths(x[at:at + self.SLICE]) for at in range(0, len(x), self.SLICE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _mean_paths(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        at = np.tile(self.roots, (len(x), 1))
        while True:
            after = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.low[at], self.high[at])
            if (after == at).all():
                return self.path[at].sum(axis=1) / len(self.roots)
            at = after


class Walk:
    """A forest over rows whose features take the place of those of one background row one by one.

    Per row and tree it knows the features at which the way through the tree would turn; only trees that turn at the feature
    that changes are walked anew.
    """

    def __init__(self, forest: Forest, x: np.ndarray, z: np.ndarray):
        self.forest, self.x, self.behind = forest, x, z[forest.feature] <= forest.threshold
        # a leaf leads to itself either way, so its decision turns nothing
        leaf = forest.low == np.arange(len(forest.low))
        self.bit = np.where(leaf, 0, self._bit(forest.feature.astype(np.int64)))
        rows, trees = np.indices((len(x), len(forest.roots))).reshape(2, -1)
        at, turns = self._down(rows, trees, np.zeros(x.shape[1], dtype=bool))
        self.path, self.turns = forest.path[at].reshape(len(x), -1), turns.reshape(len(x), -1)

    @staticmethod
    def _bit(feature):
        """Features that share a bit only cause walks that change nothing."""
        return np.left_shift(np.int64(1), feature % 62)

    def _down(self, rows: np.ndarray, trees: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = self.forest
        at, turns = f.roots[trees], np.zeros(len(rows), dtype=np.int64)
        while True:
            feature, behind = f.feature[at], self.behind[at]
            own = self.x[rows, feature] <= f.threshold[at]
            turns |= np.where(own != behind, self.bit[at], 0)
            after = np.where(np.where(taken[feature], own, behind), f.low[at], f.high[at])
            if (after == at).all():
                return at, turns
            at = after

    def mean_paths(self, order: list[int]):
        """The feature that changes and the mean paths after it, in the given order of the features."""
        path, turns, taken = self.path.copy(), self.turns.copy(), np.zeros(self.x.shape[1], dtype=bool)
        for j in order:
            taken[j] = True
            rows, trees = np.nonzero(turns & self._bit(np.int64(j)))
            if len(rows):
                at, turns[rows, trees] = self._down(rows, trees, taken)
                path[rows, trees] = self.forest.path[at]
            yield j, path.sum(axis=1) / len(self.forest.roots)

    def without(self):
        """The mean paths of the rows themselves, then for each feature those of rows that have the background's instead."""
        own = np.ones(self.x.shape[1], dtype=bool)
        rows, trees = np.indices(self.path.shape).reshape(2, -1)
        at, turns = (a.reshape(self.path.shape) for a in self._down(rows, trees, own))
        full = self.forest.path[at]
        yield full.sum(axis=1) / len(self.forest.roots)
        for j in range(self.x.shape[1]):
            path, taken = full.copy(), own.copy()
            taken[j] = False
            rows, trees = np.nonzero(turns & self._bit(np.int64(j)))
            if len(rows):
                path[rows, trees] = self.forest.path[self._down(rows, trees, taken)[0]]
            yield path.sum(axis=1) / len(self.forest.roots)


class Mixtures:
    """A forest over rows whose features take the place of those of background rows one by one, for many orders at once.

    The features of a row come in after a number of steps, ``ranks`` (order, feature; 1 or more), and till then those of the
    order's ``behind`` (order, feature) stand for them. So a node is reached by a row from the step on at which the last
    background feature has gone that turns off before it, to the step at which the first feature has come that does. Trees are
    walked down once for all orders and rows, which leave a node when no step is left. Paths are whole multiples of a small
    step, so that their sums don't depend on the order of trees and ways of equal length have equal sums.
    """

    #: Rows and orders that go down the trees together.
    ROWS, ORDERS = 4096, 16
    #: Share of the rows of a node below which those that go on are copied.
    COPIED = 0.7

    def __init__(self, forest: Forest, ranks: np.ndarray, behind: np.ndarray):
        self.roots, self.behind, self.top = forest.roots.tolist(), behind, int(ranks.max(initial=0)) + 1
        self.kind = np.min_scalar_type(self.top)
        self.gain = (self.top - ranks).astype(self.kind).T[:, :, None]
        most = max(2.0, len(self.roots) * (self.top + 1) * float(np.abs(forest.path).max(initial=0.0)))
        self.grid = 2.0 ** (52 - math.ceil(math.log2(most)))
        low = np.where(forest.low == np.arange(len(forest.low)), -1, forest.low)
        columns = (forest.feature, forest.threshold, low, forest.high, np.rint(forest.path * self.grid))
        self.nodes = list(zip(*(c.tolist() for c in columns)))

    def mean_paths(self, x: np.ndarray):
        """Parts of the result: the slices of rows and orders, and their mean paths after 0, 1, ... steps (row, order, step)."""
        for at in range(0, len(x), self.ROWS):
            columns = np.ascontiguousarray(x[at:at + self.ROWS].T)
            for order in range(0, len(self.behind), self.ORDERS):
                chosen = slice(order, order + self.ORDERS)
                yield slice(at, at + self.ROWS), chosen, self._sums(columns, self.gain[:, chosen], self.behind[chosen]) / (self.grid * len(self.roots))

    def _sums(self, columns: np.ndarray, gains: np.ndarray, behind: np.ndarray) -> np.ndarray:
        orders, n, top = len(behind), columns.shape[1], self.top
        every, first, order = np.arange(n), np.arange(n) * (top + 1), np.arange(orders)
        change = np.zeros(orders * n * (top + 1))
        # steps lost at the end, by row, and left from the start, by order
        begin = np.zeros((orders, n), dtype=self.kind), np.full((orders, 1), top, dtype=self.kind)
        for root in self.roots:
            todo = [(root, every, *begin)]
            while todo:
                at, rows, lost, limit = todo.pop()
                feature, threshold, low, high, path = self.nodes[at]
                if low < 0:
                    alive = lost < limit
                    found, counts = np.flatnonzero(alive), np.count_nonzero(alive, axis=1)
                    until = first.take(rows.take(found - np.repeat(order * len(rows), counts)))
                    until += np.repeat(order * (n * (top + 1)) + top, counts)
                    since = until - np.repeat(limit[:, 0].astype(np.int64), counts)
                    until -= lost.ravel().take(found)
                    # a row and order come once to a leaf
                    change[since] += path
                    change[until] -= path
                    continue
                gain = gains[feature]
                below = (columns[feature] if rows is every else columns[feature].take(rows)) <= threshold
                stays = behind[:, feature:feature + 1] <= threshold
                below, cut = np.negative(below.astype(self.kind)), np.minimum(limit, gain)
                for child, off, bound in ((low, ~below, np.where(stays, limit, cut)), (high, below, np.where(stays, cut, limit))):
                    less = off & gain
                    np.maximum(less, lost, out=less)
                    alive = (less < bound).any(axis=0)
                    left = np.count_nonzero(alive)
                    if left and left < self.COPIED * len(rows):
                        kept = np.flatnonzero(alive)
                        todo.append((child, rows.take(kept), less.take(kept, axis=1), bound))
                    elif left:
                        todo.append((child, rows, less, bound))
        return change.reshape(orders, n, top + 1)[:, :, :-1].cumsum(axis=2).transpose(1, 0, 2)


def score_forest(matrix: DataFrame, trees: DataFrame, columns: list[str], drawn: int) -> DataFrame:
    """``(account_id, iso_score)``: minus 2^(-mean path / expected path), lower is more anomalous."""
    forest = Forest(trees)
    expected = mean_path(drawn) or 1.0
    clean = finite_or_zero(matrix.select("account_id", *columns), columns)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                paths = forest.mean_paths(pdf[columns].to_numpy(dtype=float))
                yield pd.DataFrame({"account_id": pdf["account_id"], "iso_score": -np.exp2(-paths / expected)})

    return clean.mapInPandas(run, "account_id string, iso_score double")


def lof(matrix: DataFrame, columns: list[str], k: int = NEIGHBOURS, pivots: int | None = None, exact: bool = True) -> DataFrame:
    """``(account_id, lof_score)``: minus the local outlier factor, lower is more anomalous.

    Densities of the fitted accounts leave the account itself out. The score of an account looks it up as if it
    were new, so the account is its own nearest neighbour at distance 0. Equal accounts count one by one.
    Without ``exact``, neighbours are those that projection tables find, with work in proportion to the accounts.
    """
    clean, n = materialize_counted(finite_or_zero(matrix.select("account_id", *columns), columns), "lof-input")
    k = max(1, min(k, n - 1))
    all_sites, distinct = materialize_counted(sites(clean, columns), "lof-sites")
    near = materialize(nearest(all_sites, k, pivots) if exact else nearest_approximate(all_sites, k), "lof-neighbours")

    # hints go by the larger side, which the planner may take for the smaller one
    entries = distinct * (k + 1)
    listed = Window.partitionBy("site").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)

    def taken(weight):
        """The first ``k`` accounts of each list; the last site may be taken in part."""
        before = F.coalesce(F.sum(weight).over(listed), F.lit(0))
        return near.select("site", "neighbour", "distance", F.least(weight, k - before).alias("take")).where("take > 0")

    # leaving itself out, an account has one copy less of its own site
    others = taken(F.col("weight") - (F.col("place") == 1).cast("bigint"))
    looked_up = taken(F.col("weight"))
    k_distance = others.groupBy(F.col("site").alias("neighbour")).agg(F.max("distance").alias("k_distance"))

    def density(rows):
        reach = F.greatest("distance", "k_distance") * F.col("take")
        return rows.join(sorted_join(k_distance, entries), "neighbour").groupBy("site").agg(
            (1.0 / (F.sum(reach) / k + DENSITY_EPSILON)).alias("density")
        )

    fitted = materialize(density(others), "lof-density").select(F.col("site").alias("neighbour"), F.col("density").alias("fitted"))
    own = density(looked_up)
    factor = (
        looked_up.join(sorted_join(fitted, entries), "neighbour").groupBy("site").agg(F.sum(F.col("take") * F.col("fitted")).alias("around"))
        .join(sorted_join(own, distinct), "site")
        .select("site", (-F.col("around") / k / F.col("density")).alias("lof_score"))
    )
    scored = all_sites.join(sorted_join(factor, distinct), "site").select(F.xxhash64("v").alias("key"), F.col("v").alias("site_v"), "lof_score")
    owners = clean.select("account_id", vector(columns).alias("v")).withColumn("key", F.xxhash64("v"))
    # a third of all accounts may share one site
    return salted_join(owners, sorted_join(scored, n), "key", F.col("account_id"), hot=hot_keys(owners, "key", rows=n)).where(F.col("v") == F.col("site_v")).select(
        "account_id", "lof_score"
    )


def invert_scores(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name``: 1 for the lowest score, 0 for the highest, all 0 if scores are equal."""
    ends = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("ends")).scalar()
    low, high = F.col("ends_.low"), F.col("ends_.high")
    scaled = F.when(low == high, F.lit(0.0)).otherwise((high - F.col(column)) / (high - low))
    return df.withColumn("ends_", ends).withColumn(name, F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("ends_")


def ensemble(scores: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Flags and the combined score from ``(account_id, iso_score, lof_score)``.

    An account is anomalous for one model if its score is below that model's ``contamination`` quantile, and for
    the ensemble if the combined score is above 0.65. Writes the scores as a scratch table.
    """
    kept = materialize(scores.select("account_id", "iso_score", "lof_score"), "anomaly-scores")
    iso_cut = exact_quantile(kept, "iso_score", contamination)
    lof_cut = exact_quantile(kept, "lof_score", contamination)
    scaled = invert_scores(invert_scores(kept, "iso_score", "iso"), "lof_score", "lof")
    combined = ISO_WEIGHT * F.col("iso") + LOF_WEIGHT * F.col("lof")
    return scaled.select(
        "account_id", "iso_score", "lof_score",
        (F.col("iso_score") < F.lit(iso_cut)).alias("iso_is_anomaly"),
        (F.col("lof_score") < F.lit(lof_cut)).alias("lof_is_anomaly"),
        combined.alias("ensemble_anomaly_score"),
        (combined > THRESHOLD).alias("ensemble_is_anomaly"),
    )


def detect(matrix: DataFrame, columns: list[str], trees: int = TREES, k: int = NEIGHBOURS,
           rescale: bool = False, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(ensemble scores, forest)`` of a feature matrix; ``rescale`` standardises one that is not yet, ``exact`` is that of ``lof``."""
    if rescale:
        matrix = materialize(standardise(finite_or_zero(matrix, columns), columns), "matrix")
    forest = fit_forest(matrix, columns, trees)
    n = matrix.count()
    iso = score_forest(matrix, forest, columns, min(SAMPLE, n))
    return ensemble(iso.join(sorted_join(lof(matrix, columns, k, exact=exact), n), "account_id")), forest

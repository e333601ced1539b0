"""Structural importance of accounts: page rank, betweenness, clustering, cycles, distance to flagged accounts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.functions.ranking import smallest_hashes
from moneytrail.functions.skew import hot_keys, replicate, scatter
from moneytrail.operators.traverse import Adjacency, both_ways, directed_pairs
from moneytrail.scratch import folded, large, materialize, materialize_counted, sorted_join, together

ITERATIONS = 20
DAMPING = 0.85
SAMPLES = 100
ROUNDS_PER_WRITE = 5


def page_rank(transfers: DataFrame, accounts: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """Page rank over distinct directed pairs by a fixed number of power iterations from the uniform start.

    The rank of accounts that send nothing is shared out evenly. As that share is the same for every account, it
    need not be known while iterating: with P the damped transition, each iteration only computes P^k u for the
    uniform u, and the ranks are a weighted sum of these vectors whose weights follow from their sums. So a
    round is one join and one aggregate, and several rounds form one job between two scratch writes.
    """
    ids, n = materialize_counted(accounts.select("account_id").distinct(), "accounts")
    if n == 0:
        return ids.withColumn("pagerank_score", F.lit(0.0))
    # a transfer with an unknown end is not an edge of the graph
    known = sorted_join(ids, n)
    pairs = (
        directed_pairs(transfers)
        .join(known.withColumnRenamed("account_id", "source"), "source", "left_semi")
        .join(known.withColumnRenamed("account_id", "target"), "target", "left_semi")
    )
    pairs, rows = materialize_counted(pairs, "rank-pairs")
    hot = hot_keys(pairs, "source", rows=rows)
    out = pairs.groupBy("source").agg(F.count("*").alias("out_degree"))
    weighted = replicate(sorted_join(out, rows), "source", hot).join(scatter(pairs, "source", hot, F.col("target")), ["source", "salt"]).select(
        "source", "salt", "target", (F.lit(damping) / F.col("out_degree")).alias("weight")
    )
    # an account keeps its own history through an edge to itself that carries no weight
    own = ids.select(
        F.col("account_id").alias("source"), F.lit(0).alias("salt"), F.col("account_id").alias("target"),
        F.lit(None).cast("double").alias("weight"),
    )
    links = materialize(weighted.unionByName(own), "rank-links")

    state = ids.select(F.col("account_id").alias("source"), F.lit(1.0 / n).alias("t0"))
    blocks = []
    for k in range(1, iterations + 1):
        carried = [c for c in state.columns if c != "source"]
        state = (
            replicate(sorted_join(state, n), "source", hot)
            .join(links, ["source", "salt"])
            .groupBy(F.col("target").alias("source"))
            .agg(
                *[F.max(F.when(F.col("weight").isNull(), F.col(c))).alias(c) for c in carried],
                F.coalesce(F.sum(F.col(f"t{k - 1}") * F.col("weight")), F.lit(0.0)).alias(f"t{k}"),
            )
        )
        if k % ROUNDS_PER_WRITE == 0 or k == iterations:
            state = materialize(state, "rank-terms")
            blocks.append(state)
            state = state.select("source", f"t{k}")

    terms = blocks[0] if blocks else state
    for block in blocks[1:]:
        terms = sorted_join(terms, n).join(block.drop(*[c for c in terms.columns if c != "source"]), "source")
    sums = terms.agg(*[F.sum(f"t{k}").alias(f"t{k}") for k in range(iterations + 1)]).head()
    weights = [1.0]
    for _ in range(iterations):
        moved = sum(w * sums[k + 1] for k, w in enumerate(weights))
        weights = [1.0 - moved, *weights]
    score = sum((F.col(f"t{k}") * w for k, w in enumerate(weights)), F.lit(0.0))
    return terms.select(F.col("source").alias("account_id"), score.alias("pagerank_score"))


def sample_accounts(accounts: DataFrame, samples: int, seed: int = 42) -> DataFrame:
    """A repeatable uniform sample: the accounts with the smallest seeded hashes."""
    return smallest_hashes(accounts.select("account_id").distinct(), "account_id", samples, seed)


def numbered_arcs(transfers: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(account_id, node)`` of all accounts and ends of transfers, and the distinct arcs ``(tail, head)`` between these numbers."""
    pairs, n = materialize_counted(directed_pairs(transfers).where("source <> target"), "between-pairs")
    ends = pairs.select(F.explode(F.array("source", "target")).alias("account_id"))
    every = ids.unionByName(ends).where("account_id is not null").distinct()
    names, known = materialize_counted(every.withColumn("node", F.monotonically_increasing_id()), "between-names")
    tail, head = (sorted_join(names, known).select(F.col("account_id").alias(x), F.col("node").alias(y)) for x, y in (("source", "tail"), ("target", "head")))
    return names, materialize(sorted_join(pairs, n).join(tail, "source").join(head, "target").select("tail", "head"), "between-arcs")


def betweenness(transfers: DataFrame, accounts: DataFrame, samples: int | None = SAMPLES, seed: int = 42,
                starts: DataFrame | None = None) -> DataFrame:
    """Share of shortest directed paths through each account, estimated from sampled start accounts.

    Path counts go forward level by level from all starts at once, dependencies come back the same way. The sum
    over the sample is scaled to all starts and to the (n-1)(n-2) ordered pairs of other accounts. ``samples=None``
    starts everywhere and is exact; ``starts`` (rows with ``account_id``) takes the place of the sample.

    The first level are the arcs of the starts themselves. From there on only arcs count whose tail is a receiver; where
    these are few, they are broadcast, and as the rows of a start lie together, a level is added up before it is shuffled.
    """
    ids, n = materialize_counted(accounts.select("account_id").distinct(), "accounts")
    if starts is None:
        starts = ids if samples is None else sample_accounts(accounts, samples, seed)
    starts, used = materialize_counted(starts.select("account_id"), "starts")
    names, arcs = numbered_arcs(transfers, ids)
    chosen, rows = materialize_counted(names.join(sorted_join(starts, used), "account_id", "left_semi").select(F.col("node").alias("tail")), "start-nodes")
    level, size = materialize_counted(arcs.join(sorted_join(chosen, rows), "tail", "left_semi").select(
        F.col("tail").alias("start"), F.col("head").alias("node"), F.lit(1.0).alias("paths")
    ).repartition("start"), "between-level")
    heads, rows = materialize_counted(arcs.select(F.col("head").alias("tail")).distinct(), "receivers")
    inner = arcs.join(sorted_join(heads, rows), "tail", "left_semi")
    onward = Adjacency(inner.select(F.col("tail").alias("node"), F.col("head").alias("next")), "node")
    back = Adjacency(inner.select(F.col("head").alias("node"), F.col("tail").alias("next")), "node")

    def step(adjacency: Adjacency, level: DataFrame, size: int, value: str) -> DataFrame:
        """The sums of ``value`` over the arcs that lead from a level to each account, per start."""
        along = level.select("start", "node", value).repartition("start")
        if large(adjacency.rows):
            along = sorted_join(along, size)
        return (
            adjacency.step(along).where("start <> next")
            .groupBy("start", F.col("next").alias("node")).agg(F.sum(value).alias(value))
        )

    levels, seen, found = [(level, size)], level.select("start", "node"), size
    while size:
        nearby = step(onward, level, size, "paths")
        # an anti-join would be moved below the sums, where a level has a row per arc
        new = nearby.join(sorted_join(seen.withColumn("known", F.lit(True)), found), ["start", "node"], "left").where("known is null")
        level, size = materialize_counted(new.drop("known"), "between-level")
        levels.append((level, size))
        found += size
        seen = folded(seen.unionByName(level.select("start", "node")), len(levels), "between-seen")

    levels = [x for x in levels if x[1]]
    if len(levels) < 2:
        return ids.withColumn("betweenness_centrality", F.lit(0.0))
    later, size = levels[-1][0].withColumn("dependency", F.lit(0.0)), levels[-1][1]
    total = None
    for level, rows in reversed(levels[:-1]):
        behind = later.select("start", "node", ((1 + F.col("dependency")) / F.col("paths")).alias("per_path"))
        given = step(back, behind, size, "per_path")
        later, size = materialize(
            sorted_join(level, rows).join(given, ["start", "node"], "left").select(
                "start", "node", "paths", F.coalesce(F.col("paths") * F.col("per_path"), F.lit(0.0)).alias("dependency")
            ),
            "between-back",
        ), rows
        part = later.groupBy("node").agg(F.sum("dependency").alias("dependency"))
        total = part if total is None else total.unionByName(part)
    scale = n / max(used, 1) / max((n - 1) * (n - 2), 1)
    sums = total.groupBy("node").agg(F.sum("dependency").alias("dependency"))
    sums, rows = materialize_counted(names.join(sorted_join(sums, n), "node").select("account_id", "dependency"), "between-sums")
    return ids.join(sorted_join(sums, rows), "account_id", "left").select(
        "account_id", (F.coalesce("dependency", F.lit(0.0)) * scale).alias("betweenness_centrality")
    )


def clustering(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Share of an account's neighbour pairs that deal with each other.

    Each undirected pair points to its end of higher degree, so the pairs leaving one account number at most the
    square root of twice all pairs, however busy the account is.
    """
    links, n = materialize_counted(both_ways(transfers), "links")
    degree, known = materialize_counted(links.groupBy("account_id").agg(F.count("*").alias("degree")), "degrees")
    rank = sorted_join(degree.select("account_id", F.struct("degree", "account_id").alias("rank")), known)
    up, n = materialize_counted(
        sorted_join(links, n).where("account_id < neighbour")
        .join(rank, "account_id")
        .join(rank.select(F.col("account_id").alias("neighbour"), F.col("rank").alias("other_rank")), "neighbour")
        .select(
            F.least("rank", "other_rank").getField("account_id").alias("low"),
            F.greatest("rank", "other_rank").getField("account_id").alias("high"),
        ),
        "oriented-pairs",
    )
    first, second = up.select("low", F.col("high").alias("a")), up.select("low", F.col("high").alias("b"))
    wedges = sorted_join(first, n).join(second, "low").where("a < b")
    # a pair closes a wedge only if other pairs point to both of its ends
    busier, ends = materialize_counted(up.select("high").distinct(), "busier-ends")
    closing, pairs = materialize_counted(
        sorted_join(up, n).join(sorted_join(busier.withColumnRenamed("high", "low"), ends), "low", "left_semi")
        .select(F.least("low", "high").alias("a"), F.greatest("low", "high").alias("b")),
        "closing-pairs",
    )
    triangles = wedges.join(sorted_join(closing, pairs), ["a", "b"]).select(F.explode(F.array("low", "a", "b")).alias("account_id"))
    counted = triangles.groupBy("account_id").agg(F.count("*").alias("triangles"))
    d = F.col("degree")
    return (
        accounts.select("account_id").distinct()
        .join(sorted_join(degree, known), "account_id", "left")
        .join(sorted_join(counted, known), "account_id", "left")
        .select(
            "account_id",
            F.when(d >= 2, F.coalesce("triangles", F.lit(0)) * 2.0 / (d * (d - 1))).otherwise(F.lit(0.0)).alias("clustering_coefficient"),
        )
    )


def cycle_membership(trails: DataFrame, accounts: DataFrame) -> DataFrame:
    """Whether an account lies on a closed trail, and the longest such trail; takes ``cycles.trails`` rows."""
    on = trails.select(F.explode(F.array_distinct("steps.src")).alias("account_id"), "cycle_length").groupBy("account_id").agg(
        F.max("cycle_length").alias("longest")
    )
    return accounts.select("account_id").distinct().join(on, "account_id", "left").select(
        "account_id",
        F.col("longest").isNotNull().cast("int").alias("is_in_cycle"),
        F.coalesce("longest", F.lit(0)).alias("max_cycle_length"),
    )


def hops_to_flagged(transfers: DataFrame, accounts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Least number of undirected hops to a flagged account; 0 for a flagged one, null if none is reachable."""
    adjacency = Adjacency(both_ways(transfers), "account_id")
    flagged = accounts.where("is_flagged").select("account_id").distinct().withColumn("hop", F.lit(0))
    frontier, known = materialize_counted(flagged, "flagged-level")
    reached, hop = frontier, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        nearby = adjacency.step(frontier).select(F.col("neighbour").alias("account_id")).distinct()
        nearby = nearby.join(sorted_join(reached, known), "account_id", "left_anti").withColumn("hop", F.lit(hop))
        frontier, found = materialize_counted(nearby, "flagged-level")
        if not found:
            break
        known += found
        reached = folded(reached.unionByName(frontier), hop, "reached")
    return accounts.select("account_id").distinct().join(
        sorted_join(reached.withColumnRenamed("hop", "hop_count_to_flagged"), known), "account_id", "left"
    )


def structural_features(transfers: DataFrame, accounts: DataFrame, degree: DataFrame, trails: DataFrame,
                        samples: int | None = SAMPLES, starts: DataFrame | None = None) -> DataFrame:
    """The eight structural features of every account."""
    parts = together(
        transfers.sparkSession,
        lambda: betweenness(transfers, accounts, samples, starts=starts),
        lambda: clustering(transfers, accounts),
        lambda: page_rank(transfers, accounts),
        lambda: cycle_membership(trails, accounts),
        lambda: hops_to_flagged(transfers, accounts),
    )
    joined = degree.select("account_id", "in_degree", "out_degree")
    for part in parts:
        joined = joined.join(sorted_join(part), "account_id", "left")
    return joined

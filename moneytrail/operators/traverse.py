"""Neighbourhoods, shortest paths and induced subgraphs.

Searches go level by level and for many start accounts at once. Each level is written as a scratch table; the
only thing the driver sees is whether a level found anything.
"""

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.functions import skew
from moneytrail.functions.ranking import running_total
from moneytrail.functions.skew import hot_keys, replicate, salted_join, scatter
from moneytrail.scratch import folded, materialize, materialize_counted, sorted_join

logger = logging.getLogger(__name__)

MAX_DEPTH = 4
MAX_PATH = 10
#: The bits of a block of numbered accounts, in words of 64.
BITS = ["w0", "w1", "w2", "w3"]
BLOCK = 64 * len(BITS)
NODE_FIELDS = [
    "account_type", "customer_name", "customer_category", "risk_score", "is_flagged", "kyc_status",
]
EDGE_FIELDS = ["txn_id", "src", "dst", "amount", "txn_type", "ts", "is_fraud"]


def both_ways(transfers: DataFrame) -> DataFrame:
    """Distinct neighbour pairs ``(account_id, neighbour)`` ignoring direction and self-transfers."""
    return (
        transfers.where("src <> dst")
        .select(F.explode(F.array(
            F.struct(F.col("src").alias("account_id"), F.col("dst").alias("neighbour")),
            F.struct(F.col("dst").alias("account_id"), F.col("src").alias("neighbour")),
        )).alias("p"))
        .select("p.*")
        .distinct()
    )


def directed_pairs(transfers: DataFrame) -> DataFrame:
    """Distinct directed pairs ``(source, target)``."""
    return transfers.select(F.col("src").alias("source"), F.col("dst").alias("target")).distinct()


class Adjacency:
    """Neighbour pairs stored once; joins split the pairs of very busy accounts over several tasks."""

    def __init__(self, pairs: DataFrame, key: str):
        self.key = key
        self.pairs, self.rows = materialize_counted(pairs, "adjacency")
        self.hot = hot_keys(self.pairs, key, rows=self.rows)
        self.other = next(c for c in pairs.columns if c != key)

    def step(self, frontier: DataFrame) -> DataFrame:
        """Join a frontier that holds the key column with its pairs."""
        return salted_join(self.pairs, frontier, self.key, F.col(self.other), hot=self.hot)


class Blocks:
    """Neighbours as sets: accounts are numbered, the busiest first, and a block of numbers is one row with a bit for each.

    Many ways that lead a center to the same accounts so are a few rows instead of one per way and account, and joining sets
    takes the bits of both. An account with few neighbours has at most a row for each; as busy accounts lie together, often fewer.
    """

    def __init__(self, transfers: DataFrame):
        pairs = materialize(both_ways(transfers), "adjacency")
        degrees = pairs.groupBy("account_id").agg((-F.count("*")).alias("order"))
        placed = running_total(degrees, ["order", "account_id"], F.lit(1))
        self.names, self.known = materialize_counted(placed.select("account_id", F.col("before").alias("node")), "numbered")
        names = sorted_join(self.names, self.known)
        own = pairs.join(names, "account_id").select("node", F.col("neighbour").alias("account_id"))
        linked = own.join(names.withColumnRenamed("node", "other"), "account_id")
        self.links, rows = materialize_counted(as_sets(linked, "node", "other"), "neighbour-sets")
        self.hot = hot_keys(self.links, "node", max(1, skew.HOT_MIN_ROWS // BLOCK), rows)
        self.parts = int(self.links.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def step(self, frontier: DataFrame) -> DataFrame:
        """The sets ``(center, block)`` that the neighbours of ``(center, node)`` rows make up.

        A few rows of links give very many here, so tasks are not chosen by the size of what they read.
        """
        keys = ["node", "salt"]
        links = scatter(self.links, "node", self.hot, F.col("block")).repartition(self.parts, *keys)
        ways = replicate(frontier, "node", self.hot).repartition(self.parts, *keys).join(links, keys)
        return ways.groupBy("center", "block").agg(*[F.bit_or(w).alias(w) for w in BITS])

    def members(self, sets: DataFrame, rows: DataFrame) -> DataFrame:
        """``rows`` of accounts for each account in the sets of each center; ``sets`` keep their other columns.

        The rows of a block are joined as one, and what is not in the set is left out before there is a row for it.
        """
        fields = [c for c in rows.columns if c != "account_id"]
        kept = [c for c in sets.columns if c not in ("center", "block", *BITS)]
        numbered = rows.join(sorted_join(self.names, self.known), "account_id")
        block = numbered.groupBy(F.expr(f"node div {BLOCK}").alias("block")).agg(F.collect_list(F.struct(
            F.expr(f"cast(node % {BLOCK} div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(node % 64 as int))").alias("bit"),
            "account_id", *fields,
        )).alias("rows"))
        centers = sorted_join(self.names.select(F.col("node").alias("center"), F.col("account_id").alias("name")), self.known)
        named = sets.join(centers, "center").repartition(self.parts, "block").join(sorted_join(block), "block")
        inside = F.filter("rows", lambda r: F.get(F.array(*BITS), r["word"]).bitwiseAND(r["bit"]) != 0)
        return named.select(F.col("name").alias("center"), *kept, F.explode(inside).alias("r")).select(
            "r.account_id", "center", *kept, *[f"r.{c}" for c in fields]
        )


def as_sets(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``(key, block)`` rows with the bits of the numbers that a key has."""
    bit, word = F.expr(f"shiftleft(1L, cast({number} % 64 as int))"), F.expr(f"{number} % {BLOCK} div 64")
    return rows.groupBy(key, F.expr(f"{number} div {BLOCK}").alias("block")).agg(
        *[F.bit_or(F.when(word == i, bit).otherwise(0)).alias(w) for i, w in enumerate(BITS)]
    )


def numbers_in(sets: DataFrame) -> DataFrame:
    """The ``(center, node)`` rows of sets."""
    word = sets.select("center", "block", F.posexplode(F.array(*BITS)).alias("at", "word")).where("word <> 0")
    inside = F.explode(F.expr("filter(sequence(0, 63), b -> shiftright(word, b) & 1L = 1L)")).alias("b")
    return word.select("center", "block", "at", inside).select("center", F.expr(f"block * {BLOCK} + at * 64 + b").alias("node"))


def reach(blocks: Blocks, centers: DataFrame, max_hops: int | None) -> DataFrame:
    """``(center, block, hop)`` sets of the accounts within ``max_hops`` of each center that has neighbours, any distance if None."""
    start = centers.select("account_id").join(sorted_join(blocks.names, blocks.known), "account_id")
    frontier = materialize(as_sets(start.withColumn("center", F.col("node")), "center", "node"), "frontier")
    reached, hop = frontier.withColumn("hop", F.lit(0)), 0
    while max_hops is None or hop < max_hops:
        hop += 1
        seen = reached.groupBy("center", "block").agg(*[F.bit_or(w).alias(f"seen_{w}") for w in BITS])
        nearby = blocks.step(numbers_in(frontier)).join(seen, ["center", "block"], "left")
        added = nearby.select("center", "block", *[
            F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"seen_{w}", F.lit(0).cast("long")))).alias(w) for w in BITS
        ])
        frontier, rows = materialize_counted(added.where(" or ".join(f"{w} <> 0" for w in BITS)), "frontier")
        if not rows:
            break
        reached = folded(reached.unionByName(frontier.withColumn("hop", F.lit(hop))), hop, "reached")
    return reached


def neighbourhood(transfers: DataFrame, accounts: DataFrame, centers: DataFrame, depth: int = 3,
                  max_nodes: int | None = None, edges: str = "induced") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around each center account.

    Depth is clamped to 1..4 and direction ignored. A center without transfers to others yields nothing.
    ``edges='induced'`` keeps all transfers among the reached accounts, ``'reached'`` only those on a path of at
    most ``depth`` hops from the center. ``max_nodes`` keeps the nearest accounts, ids deciding among equals.
    """
    if edges not in ("induced", "reached"):
        raise ValueError("edges must be 'induced' or 'reached'")
    depth = max(1, min(depth, MAX_DEPTH))
    blocks = Blocks(transfers)
    reached = reach(blocks, centers, depth)
    members = blocks.members(reached, blocks.names.select("account_id"))
    described = accounts.select("account_id", *NODE_FIELDS)
    if max_nodes is None:
        kept, nodes = members, blocks.members(reached, described)
    else:
        nearest = Window.partitionBy("center").orderBy("hop", "account_id")
        kept = members.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= max_nodes).drop("n")
        nodes = kept.join(described, "account_id")
    if edges == "induced":
        return nodes, induced_edges(transfers, kept, "center")
    found = induced_edges(transfers, members, "center", keep=["hop"])
    on_path = found.where((F.col("src_hop") < depth) | (F.col("dst_hop") < depth)).drop("src_hop", "dst_hop")
    return nodes, on_path


def induced_edges(transfers: DataFrame, members: DataFrame, group: str, keep: list[str] | None = None) -> DataFrame:
    """All transfers with both ends in the same group; ``keep`` carries member columns as src_ and dst_."""
    keep = keep or []
    own = members.select(group, "account_id", *keep)
    # pairs of accounts are far fewer than transfers: find the pairs first
    pairs = transfers.select("src", "dst").distinct()

    def end(name):
        return own.withColumnsRenamed({"account_id": name, **{c: f"{name}_{c}" for c in keep}})

    inside = pairs.join(end("src"), "src").join(end("dst"), [group, "dst"])
    return inside.join(transfers.select(*EDGE_FIELDS), ["src", "dst"]).select(
        group, *EDGE_FIELDS, *[f"{e}_{c}" for c in keep for e in ("src", "dst")]
    )


class Spread:
    """Accounts reached from one end of the wanted pairs, level by level, each with the least account before it."""

    def __init__(self, wanted: DataFrame, end: str, links: DataFrame, key: str, other: str):
        self.end = end
        self.adjacency = Adjacency(links.select(F.col(key).alias("account_id"), F.col(other).alias("next")), "account_id")
        start = wanted.select(end, F.col(end).alias("account_id"), F.lit(None).cast("string").alias("previous")).distinct()
        first, rows = materialize_counted(start, "frontier")
        self.levels, self.rows, self.size = [first], rows, rows

    @property
    def frontier(self) -> DataFrame:
        return self.levels[-1]

    def grow(self, open_pairs: DataFrame) -> None:
        """Add the next level of the ends that open pairs have."""
        active = self.frontier.join(open_pairs.select(self.end).distinct(), self.end, "left_semi")
        entered = entered_by(self.adjacency.step(active), self.end)
        seen = _union(self.levels).select(self.end, "account_id")
        level, self.size = materialize_counted(entered.join(seen, [self.end, "account_id"], "left_anti"), "frontier")
        self.levels.append(level)
        self.rows += self.size


def entered_by(steps: DataFrame, *groups: str) -> DataFrame:
    """Where steps lead, each account with the least one it is entered from."""
    return steps.groupBy(*groups, F.col("next").alias("account_id")).agg(F.min("account_id").alias("previous"))


def shortest_paths(links: DataFrame, pairs: DataFrame, max_hops: int) -> DataFrame:
    """``(source, dest, path_length, accounts)`` of the pairs that have a path of at most ``max_hops`` links.

    Both ends of the pairs spread, at each turn the one with fewer accounts at its edge, until they meet: then the sum of both
    depths is the length of the pair's shortest paths. Accounts where both meet lie on one; from there the shortest paths are
    followed on through the accounts the destination had reached, and then back from the destination through least
    predecessors, which lie on shortest paths as well.
    """
    wanted = materialize(pairs.select("source", "dest").where("source <> dest").distinct(), "pairs")
    forward, backward = Spread(wanted, "source", links, "src", "dst"), Spread(wanted, "dest", links, "dst", "src")
    open_pairs, meetings = wanted, []
    for hops in range(1, max_hops + 1):
        side = forward if forward.size <= backward.size else backward
        side.grow(open_pairs)
        if not side.size:
            break
        f, b = len(forward.levels) - 1, len(backward.levels) - 1
        near = open_pairs.join(forward.frontier.select("source", "account_id"), "source")
        met = near.join(backward.frontier.select("dest", "account_id"), ["dest", "account_id"], "left_semi")
        met, found = materialize_counted(met.select("source", "dest", "account_id"), "meetings")
        if found:
            meetings.append((f, b, met))
            open_pairs = open_pairs.join(met.select("source", "dest").distinct(), ["source", "dest"], "left_anti")
        # an end that reaches nothing more has no path to what it has not met
        open_pairs = open_pairs.join(side.frontier.select(side.end).distinct(), side.end, "left_semi")
        open_pairs, left = materialize_counted(open_pairs, "pairs")
        if not left:
            break
    logger.info("paths: %d rows reached from sources, %d from destinations", forward.rows, backward.rows)
    if not meetings:
        return wanted.limit(0).select("source", "dest", F.lit(0).alias("path_length"), F.array("dest").alias("accounts"))

    deepest = max(b for _, b, _ in meetings)
    onward, at = [], None
    for depth in range(deepest, 0, -1):
        here = [met for _, b, met in meetings if b == depth] + ([at.select("source", "dest", "account_id")] if at is not None else [])
        if not here:
            continue
        entered = entered_by(forward.adjacency.step(_union(here)), "source", "dest")
        at = materialize(
            entered.join(backward.levels[depth - 1].select("dest", "account_id"), ["dest", "account_id"], "left_semi"), "onward"
        )
        onward.append(at)

    path = _union([
        met.select("source", "dest").distinct().select("source", "dest", F.lit(f + b).alias("path_length")) for f, b, met in meetings
    ]).withColumn("at", F.col("dest")).withColumn("accounts", F.array("dest"))

    def walked(path: DataFrame, back: DataFrame, keys: list[str]) -> DataFrame:
        """Paths one account longer at their start, where ``back`` knows the account before."""
        return path.join(back, [*keys, "at"], "left").select(
            "source", "dest", "path_length", F.coalesce("before", "at").alias("at"),
            F.when(F.col("before").isNull(), F.col("accounts")).otherwise(F.array_prepend("accounts", F.col("before"))).alias("accounts"),
        )

    def pointers(levels: list[DataFrame], *keys: str) -> DataFrame:
        return _union([x.select(*keys, F.col("account_id").alias("at"), F.col("previous").alias("before")) for x in levels])

    if onward:
        behind = pointers(onward, "source", "dest")
        for _ in range(deepest):
            path = walked(path, behind, ["source", "dest"])
    if len(forward.levels) > 1:
        behind = pointers(forward.levels[1:], "source")
        for _ in range(max(f for f, _, _ in meetings)):
            path = walked(path, behind, ["source"])
    return path.drop("at")


def fund_paths(transfers: DataFrame, accounts: DataFrame, pairs: DataFrame, max_hops: int = MAX_PATH) -> DataFrame:
    """One shortest directed path for each ``(source, dest)`` pair that has one of at most ``max_hops`` transfers.

    Among equally short paths each account is entered from the smallest predecessor id, and over the
    smallest transfer id between the two. See ``shortest_paths`` for the search.
    """
    # of parallel transfers only the smallest id can be on a path
    links = transfers.where("src <> dst").groupBy("src", "dst").agg(
        F.min_by(F.struct(*[c for c in EDGE_FIELDS if c not in ("src", "dst")]), "txn_id").alias("edge")
    )
    path = materialize(shortest_paths(links, pairs, max_hops), "paths")

    step = path.select(
        "source", "dest",
        F.posexplode(F.arrays_zip(
            F.slice("accounts", F.lit(1), F.col("path_length")).alias("src"), F.slice("accounts", F.lit(2), F.col("path_length")).alias("dst")
        )).alias("position", "s"),
    ).select("source", "dest", "position", "s.src", "s.dst")
    edges = step.join(links, ["src", "dst"]).groupBy("source", "dest").agg(
        F.array_sort(F.collect_list(F.struct("position", "src", "dst", "edge"))).alias("steps"),
        F.sum("edge.amount").alias("total_amount"),
    )
    node = path.select("source", "dest", F.posexplode("accounts").alias("position", "account_id")).join(
        accounts.select("account_id", "account_type", "customer_name", "risk_score", "is_flagged"), "account_id", "left"
    ).groupBy("source", "dest").agg(
        F.array_sort(F.collect_list(F.struct("position", F.struct(
            F.col("account_id").alias("id"), "account_type", "customer_name", "risk_score", "is_flagged"
        ).alias("node")))).alias("nodes")
    )
    return path.join(edges, ["source", "dest"]).join(node, ["source", "dest"]).select(
        "source", "dest",
        F.col("nodes.node").alias("nodes"),
        F.transform("steps", lambda s: F.struct(
            s["src"].alias("source"), s["dst"].alias("target"), s["edge"]["amount"].alias("amount"),
            s["edge"]["txn_type"].alias("txn_type"), s["edge"]["ts"].alias("timestamp"),
            s["edge"]["txn_id"].alias("txn_id"), s["edge"]["is_fraud"].alias("is_fraud"),
        )).alias("edges"),
        "path_length",
        "total_amount",
        F.slice("accounts", F.lit(2), F.col("path_length") - 1).alias("intermediate_accounts"),
    )


def _union(levels: list[DataFrame]) -> DataFrame:
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole


def pattern_subgraph(transfers: DataFrame, accounts: DataFrame, involvement: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and induced edges of every detection in ``(detection_id, account_id)`` rows."""
    members = involvement.select("detection_id", "account_id").distinct()
    nodes = members.join(accounts.select("account_id", "account_type", "customer_name", "risk_score", "is_flagged"), "account_id")
    known = members.join(accounts.select("account_id"), "account_id", "left_semi")
    return nodes, induced_edges(transfers, known, "detection_id")

"""Graph patterns kept current while transfers arrive.

A batch can only add detections that contain one of its transfers, and time can only take detections away. So a batch joins
its transfers with the stored window (delta joins), adds what that closes to a table of what is still open to expire, and
reads of that table what lies within the window now. All tables are below one folder, by day and batch:

* ``trails``: closed trails by the day of their first transfer,
* ``layers``: the pairs of legs of layering detections by the day of the leg out, newest version per pair of ends,
* ``flows``: credits and debits per account and day, whose sums give dormant activations,
* ``clock``: the latest time seen up to a batch; it never goes back, so what has expired stays so.

A repeated batch finds the same and replaces its own rows. Late transfers count in every window they still lie in.
"""

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moneytrail.functions.columns import look_back
from moneytrail.functions.skew import hot_keys, salted_join
from moneytrail.operators import cycles, patterns
from moneytrail.scratch import materialize, together
from moneytrail.sources.tables import read_or_empty

STEP = "struct<src string, dst string, txn_id string, amount double, ts timestamp_ntz>"
SCHEMAS = {
    "transfers": "txn_id string, ts timestamp_ntz, src string, dst string, amount double, txn_type string, is_fraud boolean",
    "trails": f"cycle_length int, steps array<{STEP}>, first_ts timestamp_ntz",
    "layers": "source string, mid string, dest string, out_txn string, out_amount double, out_ts timestamp_ntz,"
              " in_txn string, in_amount double, in_ts timestamp_ntz",
    "flows": "account_id string, incoming_count bigint, activation_amount double, outgoing_count bigint, forwarded_amount double",
}
#: The batch number of history that was there before the stream began.
BEFORE = -1
#: Rules that look back over hours.
HOURLY = ("CIRCULAR_ROUND_TRIP", "LAYERING", "STRUCTURING")


def put(rows: DataFrame, folder: str, name: str, day: Column, batch_id: int) -> None:
    """Write a batch's rows of a table, each under its day; a repeated batch replaces them."""
    (
        rows.withColumns({"day": day, "batch_id": F.lit(batch_id)})
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id")
        .parquet(f"{folder}/{name}")
    )


def stored(spark: SparkSession, folder: str, name: str, since: datetime, until: datetime) -> DataFrame:
    """Rows of a table from the days ``since`` to ``until``, of whatever batch; only their folders are listed."""
    schema = T.StructType([
        *T.StructType.fromDDL(SCHEMAS[name]).fields, T.StructField("day", T.DateType()), T.StructField("batch_id", T.IntegerType()),
    ])
    days = ",".join(str(since.date() + timedelta(days=n)) for n in range((until.date() - since.date()).days + 1))
    return read_or_empty(spark, schema, f"{folder}/{name}", f"{folder}/{name}/day={{{days}}}")


def clock(spark: SparkSession, folder: str, latest: datetime | None, batch_id: int) -> datetime | None:
    """The latest time of this batch and all before it; writes it for the next."""
    schema = T.StructType.fromDDL("seen timestamp_ntz")
    known = read_or_empty(spark, schema, f"{folder}/clock", f"{folder}/clock/number={batch_id - 1}").agg(F.max("seen")).head()[0]
    seen = max((t for t in (known, latest) if t is not None), default=None)
    spark.createDataFrame([(seen,)], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/clock/number={batch_id}")
    return seen


# --- circular ---------------------------------------------------------------------------------------


def fresh_trails(window: DataFrame, max_hop: int = 5) -> DataFrame:
    """Each closed trail of 2..max_hop transfers that contains a fresh one, once, as ``(cycle_length, steps)``.

    ``window`` has the transfers of the window and a boolean ``fresh``. A trail starts at the fresh transfer of its own with the
    smallest id. Two halves grow from there, forward from its receiver and backward from its sender, and are joined where they
    meet, so only paths of half the length around fresh transfers are ever built.
    """
    step = F.struct("src", "dst", "txn_id", "amount", "ts").alias("step")
    hop = materialize(cycles.closable(window).select("src", "dst", "txn_id", "fresh", step), "delta-edges")
    start = F.col("txn_id").alias("start")
    forward = {0: materialize(hop.where("fresh").select(start, F.col("dst").alias("meet"), F.array("step").alias("head")), "delta-forward")}
    backward = {0: hop.where("fresh").select(start, F.col("src").alias("meet"), F.expr(f"cast(array() as array<{STEP}>)").alias("tail"))}
    # of several fresh transfers on a trail the smallest id is its start
    later = ~F.col("fresh") | (F.col("txn_id") > F.col("start"))
    busy = {end: hot_keys(hop, end) for end in ("src", "dst")} if max_hop > 1 else {}

    def grown(paths: DataFrame, at: str, onward: str, path: str, add) -> DataFrame:
        met = salted_join(hop.withColumn("meet", F.col(at)), paths, "meet", F.col("txn_id"), hot=busy[at])
        unused = ~F.array_contains(F.col(f"{path}.txn_id"), F.col("txn_id")) & (F.col("txn_id") != F.col("start"))
        return materialize(met.where(later & unused).select("start", F.col(onward).alias("meet"), add(path, F.col("step")).alias(path)), f"delta-{path}")

    for k in range(1, max_hop // 2 + 1):
        forward[k] = grown(forward[k - 1], "src", "dst", "head", F.array_append)
    for k in range(1, (max_hop - 1) // 2 + 1):
        backward[k] = grown(backward[k - 1], "dst", "src", "tail", F.array_prepend)

    def closed(length: int) -> DataFrame:
        return (
            forward[length // 2].join(backward[(length - 1) // 2], ["start", "meet"])
            .where(~F.arrays_overlap("head.txn_id", "tail.txn_id"))
            .select(F.lit(length).alias("cycle_length"), F.concat("head", "tail").alias("steps"))
        )

    return reduce(DataFrame.unionByName, [closed(n) for n in range(2, max_hop + 1)])


def with_first(trails: DataFrame) -> DataFrame:
    return trails.withColumn("first_ts", F.array_min("steps.ts"))


# --- layering ---------------------------------------------------------------------------------------


def fresh_layers(window: DataFrame, as_of: Column, min_amount: float, hours: int) -> DataFrame:
    """All pairs of legs of every detection whose source pays, or whose destination is paid by, a fresh transfer.

    Only these can have changed but by expiry. Legs of those sources and their intermediaries, and of those destinations and
    theirs, are all that their pairs are made of.
    """
    moved = window.where("src <> dst")
    fresh = moved.where("fresh")

    def among(df: DataFrame, column: str, nodes: DataFrame, name: str) -> DataFrame:
        return df.join(nodes.select(F.col(name).alias(column)).distinct(), column, "left_semi")

    sources = fresh.where(F.col("amount") > min_amount).select(F.col("src").alias("source")).distinct()
    paying = materialize(among(moved.where(F.col("amount") > min_amount), "src", sources, "source"), "delta-out")
    dests = fresh.select(F.col("dst").alias("dest")).distinct()
    paid = materialize(among(moved, "dst", dests, "dest"), "delta-in")

    onward = among(moved, "src", paying, "dst")
    upward = among(moved.where(F.col("amount") > min_amount), "dst", paid, "src")
    columns = ["src", "dst", "txn_id", "amount", "ts"]
    by_source = patterns.layering_pairs(
        paying.select(columns).union(onward.select(columns)).distinct(), as_of, min_amount, hours, sources=sources
    )
    by_dest = patterns.layering_pairs(
        paid.select(columns).union(upward.select(columns)).distinct(), as_of, min_amount, hours, dests=dests
    )
    both = by_source.unionByName(by_dest.join(sources, "source", "left_anti"))
    return detected(materialize(both, "delta-pairs"))


def detected(pairs: DataFrame) -> DataFrame:
    """The pairs whose ends meet over two intermediaries or more."""
    ends = pairs.groupBy("source", "dest").agg(F.min("mid").alias("a"), F.max("mid").alias("b")).where("a <> b")
    return pairs.join(ends.select("source", "dest"), ["source", "dest"], "left_semi")


def newest_layers(pairs: DataFrame) -> DataFrame:
    """The pairs of each two ends as the newest batch that has any found them."""
    newest = pairs.groupBy("source", "dest").agg(F.max("batch_id").alias("batch_id"))
    return pairs.join(newest, ["source", "dest", "batch_id"], "left_semi")


# --- dormant activation -----------------------------------------------------------------------------


def flows(transfers: DataFrame) -> DataFrame:
    """Counts and sums of credits and debits per account and day."""
    def side(end, count, amount, other_count, other_amount):
        return transfers.groupBy(F.col(end).alias("account_id"), F.to_date("ts").alias("on")).agg(
            F.count("*").alias(count), F.sum("amount").alias(amount)
        ).withColumns({other_count: F.lit(0).cast("bigint"), other_amount: F.lit(0.0)})

    credit, debit = ("incoming_count", "activation_amount"), ("outgoing_count", "forwarded_amount")
    both = side("dst", *credit, *debit).unionByName(side("src", *debit, *credit))
    return both.groupBy("account_id", "on").agg(*[F.sum(c).alias(c) for c in (*credit, *debit)])


def month_sums(spark: SparkSession, folder: str, seen: datetime, touched: DataFrame, window_days: int) -> DataFrame:
    """What ``patterns.activated`` needs of the touched accounts: whole days from ``flows``, the first, cut one from transfers."""
    start = seen - timedelta(days=window_days)
    whole = stored(spark, folder, "flows", start + timedelta(days=1), seen).drop("day", "batch_id")
    cut = stored(spark, folder, "transfers", start, start).where(F.col("ts") > F.lit(start).cast("timestamp_ntz"))
    rows = whole.unionByName(flows(cut).drop("on")).join(touched, "account_id", "left_semi")
    sums = rows.groupBy("account_id").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "account_id"])
    return sums.where("incoming_count > 0 and outgoing_count > 0")


# --- all rules --------------------------------------------------------------------------------------


def keep(new: DataFrame, folder: str, batch_id: int) -> None:
    """Store a batch's transfers and their daily sums."""
    put(new, folder, "transfers", F.to_date("ts"), batch_id)
    put(flows(new), folder, "flows", F.col("on"), batch_id)


def find_graph_rules(spark: SparkSession, folder: str, seen: datetime, batch_id: int, rules: dict) -> None:
    """Add the trails and layering pairs that a kept batch brings to the stored ones."""
    now = F.lit(seen).cast("timestamp_ntz")
    circle, layer = rules["CIRCULAR_ROUND_TRIP"], rules["LAYERING"]

    def trails() -> None:
        found = fresh_trails(window_of(spark, folder, seen, circle["hours"], batch_id), circle["max_hop"])
        put(with_first(found), folder, "trails", F.to_date("first_ts"), batch_id)

    def layers() -> None:
        found = fresh_layers(window_of(spark, folder, seen, layer["hours"], batch_id), now, **layer)
        put(found, folder, "layers", F.to_date("out_ts"), batch_id)

    together(spark, trails, layers)


def prime(transfers: DataFrame, folder: str, rules: dict) -> None:
    """Fill the tables of a new stream with what the transfers before it make up, as a batch of their own."""
    spark = transfers.sparkSession
    columns = T.StructType.fromDDL(SCHEMAS["transfers"]).names
    seen = clock(spark, folder, transfers.agg(F.max("ts")).head()[0], BEFORE)
    if seen is None:
        return
    now = F.lit(seen).cast("timestamp_ntz")
    days = max([rules["DORMANT_ACTIVATION"].get("window_days", patterns.WINDOW_DAYS), *[-(-rules[r]["hours"] // 24) for r in HOURLY]])
    keep(look_back(transfers, now, days=days + 1).select(columns), folder, BEFORE)
    circle = rules["CIRCULAR_ROUND_TRIP"]

    def trails() -> None:
        put(with_first(cycles.trails(transfers, now, circle["max_hop"], circle["hours"])), folder, "trails", F.to_date("first_ts"), BEFORE)

    def layers() -> None:
        pairs = materialize(patterns.layering_pairs(transfers, now, **rules["LAYERING"]), "layering-pairs")
        put(detected(pairs), folder, "layers", F.to_date("out_ts"), BEFORE)

    together(spark, trails, layers)


def window_of(spark: SparkSession, folder: str, seen: datetime, hours: int, batch_id: int) -> DataFrame:
    """Stored transfers of the window ending now, those of the batch marked ``fresh``."""
    rows = stored(spark, folder, "transfers", seen - timedelta(hours=hours), seen)
    return look_back(rows, F.lit(seen).cast("timestamp_ntz"), hours=hours).withColumn("fresh", F.col("batch_id") == batch_id)


def graph_rules(spark: SparkSession, folder: str, seen: datetime, touched: DataFrame, accounts: DataFrame, rules: dict) -> dict[str, patterns.Found]:
    """Detections of the three graph rules that hold now and involve a touched account."""
    def alive(name: str, ts: str, hours: int) -> DataFrame:
        start = seen - timedelta(hours=hours)
        return stored(spark, folder, name, start, seen).where(F.col(ts) > F.lit(start).cast("timestamp_ntz"))

    trails = alive("trails", "first_ts", rules["CIRCULAR_ROUND_TRIP"]["hours"]).select("cycle_length", "steps")
    on_them = trails.withColumn("account_id", F.explode("steps.src")).join(touched, "account_id", "left_semi")
    circular = cycles.circular_of(on_them.drop("account_id").distinct())

    pairs = newest_layers(alive("layers", "out_ts", rules["LAYERING"]["hours"]))
    ends = pairs.select("source", "dest", F.explode(F.array("source", "mid", "dest")).alias("account_id"))
    ends = ends.join(touched, "account_id", "left_semi").select("source", "dest").distinct()
    pairs = materialize(pairs.join(ends, ["source", "dest"], "left_semi"), "live-pairs")
    layers = patterns.layering_of(pairs)

    rule = rules["DORMANT_ACTIVATION"]
    sums = month_sums(spark, folder, seen, touched, rule.get("window_days", patterns.WINDOW_DAYS))
    woken = patterns.activated(sums, accounts, **{k: v for k, v in rule.items() if k != "window_days"})
    return {
        "CIRCULAR_ROUND_TRIP": patterns.Found(circular, None),
        "LAYERING": patterns.Found(layers, patterns.layering_evidence(pairs, layers)),
        "DORMANT_ACTIVATION": patterns.Found(woken, None),
    }

"""Writing streams to tables so that a repeated batch replaces itself."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moneytrail.operators import alerts as A
from moneytrail.operators import patterns, risk
from moneytrail.scratch import materialize, scratch_path
from moneytrail.sources.tables import read_or_empty
from moneytrail.streaming import current

#: Batches after which the sums of credits are written anew.
FOLD = 16
#: Rows of a stream for each state partition, if their number is known when a query first starts.
STATE_ROWS = 250_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession, partitions: int | None = None, rows: int = 0) -> SparkSession:
    """A session of the same application with the state settings of the streaming jobs.

    The number of state partitions is fixed when a query first starts, so it is chosen here and not left to the
    settings of the batch jobs: one for each core, and so many that none gets more than its share of the ``rows`` to
    come. What a task holds of them at once then does not grow with the stream. Stores share the memory of an executor.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    if partitions is None:
        partitions = max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS))
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return session


def per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer: each batch has its own folder, written again if the batch is repeated."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop. State and progress stay in ``checkpoint`` for the next run."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def collect_stream(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over the available data and return its output rows with their ``batch_id``."""
    spark = stream.sparkSession
    out = scratch_path(spark, "stream-out")
    run_available(stream, per_batch(out), scratch_path(spark, "stream-checkpoint"), mode)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    return spark.read.schema(schema).parquet(out)


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key from the output of an updating stream."""
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")


def credit_sums(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """High-value credits per account up to a batch: the sums at the last fold and the few batches after it."""
    base = batch_id // FOLD * FOLD
    later = ",".join(map(str, range(base, batch_id + 1)))
    read = spark.read.schema("account_id string, credit_count bigint, total_suspicious_amount double")
    rows = read.parquet(f"{folder}/credits/batch_id={{{later}}}")
    before = f"{folder}/credit_sums/before={base}"
    rows = rows.unionByName(read.parquet(before) if base else read_or_empty(spark, rows.schema, before, before))
    return rows.groupBy("account_id").agg(*[F.sum(c).alias(c) for c in ("credit_count", "total_suspicious_amount")])


def rules_with(params: dict | None) -> dict:
    return {name: {**patterns.DEFAULTS[name], **(params or {}).get(name, {})} for name in patterns.PATTERNS}


def prime(folder: str, transfers: DataFrame, params: dict | None = None) -> None:
    """Start an alert stream from the transfers there were before it, so that its first batch counts them in."""
    rules = rules_with(params)
    current.prime(transfers.withColumn("ts", F.col("ts").cast("timestamp_ntz")), folder, rules)
    sums = patterns.high_credits(transfers, rules["PROFILE_MISMATCH"]["min_amount"])
    sums.write.mode("overwrite").parquet(f"{folder}/credit_sums/before=0")


def alert_writer(folder: str, accounts: DataFrame, node_scores: DataFrame, anomalies: DataFrame, threshold: float,
                 params: dict | None = None, nightly: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer that adds the batch to the stored transfers and alerts on the accounts it touched.

    Touched accounts are scored from all five rules as of the latest transfer so far, and from the model scores of the last
    nightly run. The alerts are those a batch run over all transfers so far would raise on these accounts (``prime`` adds the
    ones before the stream). Closed trails and layering come from delta joins with the stored window, see ``current``, dormant
    activations from daily sums, profile mismatches from the sums of high-value credits at the last fold and the at most
    FOLD batches since. With ``nightly``, the involvement of a nightly run, the three graph rules are taken from there and
    not kept current. Every batch reads the days of the windows, however many batches there were. Writes ``transfers``,
    ``flows``, ``trails``, ``layers``, ``clock``, ``credits``, ``credit_sums`` and ``alerts`` below ``folder``; a repeated
    batch replaces its own rows. An empty batch alerts on nothing.
    """
    p = rules_with(params)
    columns = ["txn_id", "ts", "src", "dst", "amount", "txn_type", "is_fraud"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = materialize(batch.select(*columns).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "batch")
        per_batch(f"{folder}/credits")(patterns.high_credits(new, p["PROFILE_MISMATCH"]["min_amount"]), batch_id)
        credits = credit_sums(spark, folder, batch_id)
        if (batch_id + 1) % FOLD == 0:
            credits.write.mode("overwrite").parquet(f"{folder}/credit_sums/before={batch_id + 1}")
        latest = new.agg(F.max("ts")).head()[0]
        seen = current.clock(spark, folder, latest, batch_id)
        if latest is None:
            return
        current.keep(new, folder, batch_id)
        now = F.lit(seen).cast("timestamp_ntz")
        touched = materialize(new.select(F.explode(F.array("src", "dst")).alias("account_id")).distinct(), "touched")

        rule = p["STRUCTURING"]
        window = current.window_of(spark, folder, seen, rule["hours"], batch_id)
        # a touched account is involved as a receiver, or as a sender to one
        small = window.where((F.col("amount") > 0) & (F.col("amount") <= rule["threshold"]))
        paid = small.join(touched.withColumnRenamed("account_id", "src"), "src", "left_semi").select("dst")
        receivers = paid.union(touched.select("account_id")).distinct()
        credited = window.join(receivers, "dst", "left_semi")
        structuring = materialize(patterns.structuring(credited, now, **rule), "detections")
        mismatch = patterns.mismatch_of(
            credits.join(touched, "account_id", "left_semi"), accounts, p["PROFILE_MISMATCH"]["categories"]
        )
        found = {
            "STRUCTURING": patterns.Found(structuring, patterns.structuring_evidence(
                credited, structuring, now, rule["threshold"], rule["hours"]
            )),
            "PROFILE_MISMATCH": patterns.Found(mismatch, None),
        }
        if nightly is None:
            current.find_graph_rules(spark, folder, seen, batch_id, p)
            found |= current.graph_rules(spark, folder, seen, touched, accounts, p)
        involved = patterns.involvement(found).join(touched, "account_id", "left_semi")
        if nightly is not None:
            before = nightly.where(~F.col("pattern").isin(*found)).join(touched, "account_id", "left_semi")
            involved = involved.unionByName(before.select(*involved.columns))
        scored = risk.risk_scores(
            accounts.join(touched, "account_id", "left_semi"), node_scores, anomalies, risk.rule_scores(involved), now
        )
        per_batch(f"{folder}/alerts")(A.make_alerts(scored, now, "LOW").where(F.col("risk_score") > threshold), batch_id)

    return write

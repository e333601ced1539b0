"""The laundering-pattern detectors other than the circular one.

Every detector returns one row per detection with scalar columns, whatever its size, and has an ``*_evidence``
twin with one row per transfer behind a detection.
Sums and counts are combined before any shuffle by account, so a busy account is not one big task.
"""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.functions.columns import from_micros, look_back, micros
from moneytrail.functions.skew import hot_listed, salted_join
from moneytrail.operators.cycles import circular
from moneytrail.schema import PATTERNS
from moneytrail.scratch import materialize, together

# --- layering -------------------------------------------------------------------------------------

BUSY_PAIRS = 5_000_000
CENTS = "decimal(28,2)"
PAIR = ["source", "mid", "dest", "out_txn", "out_amount", "out_ts", "in_txn", "in_amount", "in_ts"]

def layering_pairs(transfers: DataFrame, as_of: Column, min_amount: float, hours: int, sources: DataFrame | None = None,
                   dests: DataFrame | None = None) -> DataFrame:
    """Pairs of a leg out and a later leg in over one intermediary, for all ends that may have two of them.

    Pairs over ordinary intermediaries are joined directly. A busy one has far too many: its payers times its
    payees, nearly all with nothing else in common. A detection needs a second intermediary, so pairs over busy
    ones are built only for ends that also meet elsewhere: over an ordinary intermediary, or over two busy ones.
    Detections are the same either way. ``sources`` and ``dests`` (tables of source, of dest) restrict the ends.
    Writes the transfers of the window as a scratch table.
    """
    recent = materialize(
        look_back(transfers, as_of, hours=hours).where("src <> dst").select("src", "dst", "txn_id", "amount", "ts"),
        "layering-window",
    )
    out_leg = recent.where(F.col("amount") > min_amount).select(
        F.col("src").alias("source"), F.col("dst").alias("mid"),
        F.col("txn_id").alias("out_txn"), F.col("amount").alias("out_amount"), F.col("ts").alias("out_ts"),
    )
    in_leg = recent.select(
        F.col("src").alias("mid"), F.col("dst").alias("dest"),
        F.col("txn_id").alias("in_txn"), F.col("amount").alias("in_amount"), F.col("ts").alias("in_ts"),
    )

    if sources is not None:
        out_leg = out_leg.join(sources, "source", "left_semi")
    if dests is not None:
        in_leg = in_leg.join(dests, "dest", "left_semi")

    def at_least_two(df: DataFrame, end: str) -> DataFrame:
        several = df.groupBy(end).agg(F.min("mid").alias("a"), F.max("mid").alias("b")).where("a <> b")
        return df.join(several.select(end), end, "left_semi")

    def follows(df: DataFrame) -> DataFrame:
        return df.where(
            (F.col("in_ts") > F.col("out_ts"))
            & (F.col("in_ts") < F.col("out_ts") + F.make_dt_interval(hours=F.lit(hours)))
            & (F.col("source") != F.col("dest"))
        ).select(*PAIR)

    # a source needs two receivers that pay on, a destination two payers that were paid
    out_leg = at_least_two(out_leg.join(in_leg.select("mid").distinct(), "mid", "left_semi"), "source")
    in_leg = at_least_two(in_leg.join(out_leg.select("mid").distinct(), "mid", "left_semi"), "dest")
    busy = _busy_intermediaries(recent, min_amount)
    if busy.isEmpty():
        return follows(in_leg.join(out_leg, "mid"))

    def ordinary(df: DataFrame) -> DataFrame:
        return df.join(busy, "mid", "left_anti")

    direct = materialize(follows(ordinary(in_leg).join(ordinary(out_leg), "mid")), "layering-pairs")
    out_busy, in_busy = out_leg.join(busy, "mid", "left_semi"), in_leg.join(busy, "mid", "left_semi")

    def couples(df: DataFrame, end: str, bound: Column, at: str) -> DataFrame:
        """Each end with the couples of busy intermediaries it deals with, and its bounding time at either."""
        once = df.groupBy(end, "mid").agg(bound.alias(at))
        met = once.groupBy(end).agg(F.array_sort(F.collect_list(F.struct("mid", at))).alias("mids")).where(F.size("mids") >= 2)
        pairs = met.select(end, F.explode("mids").alias("first"), "mids").select(
            end, "first", F.explode(F.filter("mids", lambda m: m["mid"] > F.col("first.mid"))).alias("second")
        )
        return pairs.select(
            end, F.col("first.mid").alias("first"), F.col("second.mid").alias("second"),
            F.col(f"first.{at}").alias(f"{at}_first"), F.col(f"second.{at}").alias(f"{at}_second"),
        )

    # ends whose last receipt over a couple is before the first payment into it have nothing that follows
    in_order = (F.col("paid_first") < F.col("got_first")) & (F.col("paid_second") < F.col("got_second"))
    over_two = (
        couples(out_busy, "source", F.min("out_ts"), "paid")
        .join(couples(in_busy, "dest", F.max("in_ts"), "got"), ["first", "second"]).where(in_order).select("source", "dest")
    )
    meeting = direct.select("source", "dest").union(over_two).where("source <> dest").distinct()
    checked = follows(out_busy.join(meeting, "source").join(in_busy, ["mid", "dest"]))
    return direct.unionByName(checked)


def _busy_intermediaries(recent: DataFrame, min_amount: float) -> DataFrame:
    """All accounts with more than ``BUSY_PAIRS`` pairs of a leg out and a leg in, as a stored table of ``mid``."""
    roles = F.explode(F.array(
        F.struct(F.col("dst").alias("mid"), (F.col("amount") > min_amount).cast("bigint").alias("paid"), F.lit(0).cast("bigint").alias("pays")),
        F.struct(F.col("src").alias("mid"), F.lit(0).cast("bigint").alias("paid"), F.lit(1).cast("bigint").alias("pays")),
    ))
    counts = recent.select(roles.alias("r")).groupBy("r.mid").agg(F.sum("r.paid").alias("paid"), F.sum("r.pays").alias("pays"))
    pairs = counts.select("mid", (F.col("paid").cast("double") * F.col("pays")).alias("pairs"))
    return materialize(pairs.where(F.col("pairs") > BUSY_PAIRS).select("mid"), "busy")


def layering(transfers: DataFrame, as_of: Column, min_amount: float = 1_000_000, hours: int = 48) -> DataFrame:
    """Funds that leave one account through two or more others and meet again in one account.

    Amounts are summed over pairs of legs: a leg out that is followed by two legs in counts twice.
    """
    return layering_of(layering_pairs(transfers, as_of, min_amount, hours))


def layering_of(pairs: DataFrame) -> DataFrame:
    per_mid = pairs.groupBy("source", "dest", "mid").agg(
        F.sum("out_amount").alias("out_sum"), F.sum("in_amount").alias("in_sum")
    )
    return (
        per_mid.groupBy(F.col("source").alias("source_account"), F.col("dest").alias("destination_account"))
        .agg(
            F.count("*").alias("intermediary_count"),
            F.sum("out_sum").alias("total_fan_out"),
            F.sum("in_sum").alias("total_converge"),
        )
        .where("intermediary_count >= 2")
    )


def layering_evidence(pairs: DataFrame, detections: DataFrame) -> DataFrame:
    """The distinct transfers of each detection: ``leg`` is fan_out or converge."""
    pairs = pairs.withColumnsRenamed(
        {"source": "source_account", "dest": "destination_account", "mid": "intermediate_account"}
    )
    keys = ["source_account", "destination_account"]

    def leg(name, side):
        return F.struct(
            F.lit(name).alias("leg"),
            *[F.col(f"{side}_{c}").alias(n) for c, n in (("txn", "txn_id"), ("amount", "amount"), ("ts", "ts"))],
        )

    return (
        pairs.join(detections.select(keys), keys, "left_semi")
        .select(*keys, "intermediate_account", F.explode(F.array(leg("fan_out", "out"), leg("converge", "in"))).alias("l"))
        .select(*keys, "intermediate_account", "l.*")
        .distinct()
    )


# --- structuring ----------------------------------------------------------------------------------


def _small_credits(transfers: DataFrame, as_of: Column, threshold: float, hours: int) -> DataFrame:
    return look_back(transfers, as_of, hours=hours).where((F.col("amount") > 0) & (F.col("amount") <= threshold))


def structuring(transfers: DataFrame, as_of: Column, threshold: float = 49_999, hours: int = 24, min_count: int = 5) -> DataFrame:
    """Accounts credited ``min_count`` times or more with sub-threshold amounts in the window ending now."""
    small = _small_credits(transfers, as_of, threshold, hours)
    per_sender = small.groupBy("dst", "src").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return (
        per_sender.groupBy(F.col("dst").alias("destination_account"))
        .agg(
            F.count("*").alias("sender_count"),
            F.sum("n").alias("transaction_count"),
            F.sum("total").alias("total_amount"),
        )
        .where(F.col("transaction_count") >= min_count)
    )


def structuring_evidence(transfers: DataFrame, detections: DataFrame, as_of: Column, threshold: float = 49_999,
                         hours: int = 24) -> DataFrame:
    small = _small_credits(transfers, as_of, threshold, hours).withColumnsRenamed(
        {"dst": "destination_account", "src": "sender_account"}
    )
    hot = hot_listed(detections, "destination_account", "transaction_count")
    return salted_join(
        small, detections.select("destination_account"), "destination_account", F.col("txn_id"), "left_semi", hot
    ).select("destination_account", "sender_account", "txn_id", "amount", "ts")


def structuring_sliding(transfers: DataFrame, as_of: Column, threshold: float = 49_999, hours: int = 24,
                        min_count: int = 5, slot_minutes: int = 1) -> DataFrame:
    """Accounts with ``min_count`` or more sub-threshold credits in any span (t - hours, t].

    A sweep: each credit adds one at its time and takes one away ``hours`` later. The running total is
    taken per account and short slot of the time line and shifted by the totals of the earlier slots, so no
    task has to hold all credits of an account. Amounts are added and taken away as whole cents, so that nothing drifts.
    """
    small = transfers.where((F.col("amount") > 0) & (F.col("amount") <= threshold) & (F.col("ts") <= as_of))
    at, amount = micros(F.col("ts")), F.col("amount").cast(CENTS)
    span = hours * 3_600_000_000
    changes = (
        small.select(
            "dst",
            F.explode(F.array(
                F.struct(at.alias("at"), F.lit(1).alias("turn"), amount.alias("amount")),
                F.struct((at + span).alias("at"), F.lit(0).alias("turn"), (-amount).cast(CENTS).alias("amount")),
            )).alias("c"),
        )
        .select("dst", "c.*")
        .groupBy("dst", "at", "turn")
        .agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
        .withColumn("slot", F.floor(F.col("at") / (slot_minutes * 60_000_000)))
        .withColumn("change", F.when(F.col("turn") == 1, F.col("n")).otherwise(-F.col("n")))
    )
    earlier = Window.partitionBy("dst").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        changes.groupBy("dst", "slot")
        .agg(F.sum("change").alias("change"), F.sum("amount").alias("amount"))
        .select(
            "dst", "slot",
            F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("count_before"),
            F.coalesce(F.sum("amount").over(earlier), F.lit(0)).alias("amount_before"),
        )
    )
    # what leaves at an instant leaves before what arrives, as the span is open at its start
    in_slot = Window.partitionBy("dst", "slot").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    running = changes.join(before, ["dst", "slot"]).select(
        "dst", "at", "turn",
        (F.col("count_before") + F.sum("change").over(in_slot)).alias("credits"),
        (F.col("amount_before") + F.sum("amount").over(in_slot)).alias("amount"),
    )
    return (
        running.where((F.col("turn") == 1) & (F.col("credits") >= min_count))
        .groupBy(F.col("dst").alias("destination_account"))
        .agg(
            F.max("credits").alias("max_transaction_count"),
            F.max("amount").cast("double").alias("max_total_amount"),
            from_micros(F.min("at")).alias("first_reached"),
        )
    )


# --- dormant activation ---------------------------------------------------------------------------


WINDOW_DAYS = 30


def dormant_activation(transfers: DataFrame, accounts: DataFrame, as_of: Column, dormant_days: int = 60,
                       forward_ratio: float = 0.7, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Dormant or old accounts that forwarded more than ``forward_ratio`` of the month's credits."""
    recent = look_back(transfers, as_of, days=window_days)

    def side(end, amount, count):
        return recent.groupBy(F.col(end).alias("account_id")).agg(
            F.sum("amount").alias(amount), F.count("*").alias(count)
        )

    sums = side("dst", "activation_amount", "incoming_count").join(side("src", "forwarded_amount", "outgoing_count"), "account_id")
    return activated(sums, accounts, dormant_days, forward_ratio)


def activated(sums: DataFrame, accounts: DataFrame, dormant_days: int = 60, forward_ratio: float = 0.7) -> DataFrame:
    """Dormant activations among accounts with credits and debits, from the sums and counts of both."""
    eligible = accounts.where((F.col("account_type") == "DORMANT") | (F.col("account_age_days") > dormant_days))
    return (
        sums.where(F.col("forwarded_amount") > F.col("activation_amount") * forward_ratio)
        .join(eligible.select("account_id", "account_type", "account_age_days"), "account_id")
        .select(
            "account_id", "account_type", "account_age_days", "activation_amount", "forwarded_amount",
            F.try_divide("forwarded_amount", "activation_amount").alias("forward_ratio"),
            "incoming_count", "outgoing_count",
        )
    )


def dormant_evidence(transfers: DataFrame, detections: DataFrame, as_of: Column, window_days: int = 30) -> DataFrame:
    """Credits and debits behind each detection: ``direction`` is incoming or outgoing."""
    recent = look_back(transfers, as_of, days=window_days)
    found = detections.select("account_id")

    def side(own, other, direction):
        return salted_join(
            recent.withColumnsRenamed({own: "account_id", other: "counterparty"}), found, "account_id",
            F.col("txn_id"), "left_semi", hot_listed(detections, "account_id", f"{direction}_count"),
        ).select("account_id", F.lit(direction).alias("direction"), "counterparty", "amount", "ts", "txn_id")

    return side("dst", "src", "incoming").unionByName(side("src", "dst", "outgoing"))


def dormant_strict(transfers: DataFrame, as_of: Column, quiet_days: int = 75, spike: float = 5.0,
                   forward_share: float = 0.8, forward_days: int = 2) -> DataFrame:
    """Credits that wake an account after ``quiet_days`` and are passed on.

    The credit must exceed ``spike`` times the mean of all earlier transfers of the account, and the account
    must send more than ``forward_share`` of it within the following ``forward_days``. The history is combined
    per account and day first. As the account was quiet for at least a day, a waking credit can only be the
    first thing that happens on its day.
    """
    if quiet_days < 1:
        raise ValueError("quiet_days must be at least 1")
    past = transfers.where(F.col("ts") <= as_of)
    moves = past.select(
        F.explode(F.array(
            F.struct(F.col("dst").alias("account_id"), F.lit(True).alias("credit")),
            F.struct(F.col("src").alias("account_id"), F.lit(False).alias("credit")),
        )).alias("m"),
        "ts", "amount",
    ).select("m.*", "ts", "amount", F.to_date("ts").alias("day"))
    days = moves.groupBy("account_id", "day").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count("*").alias("n"), F.sum("amount").alias("total"),
    )
    by_day = Window.partitionBy("account_id").orderBy("day")
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    wakes = (
        days.select(
            "account_id", "first_ts",
            F.lag("last_ts").over(by_day).alias("quiet_since"),
            (F.sum("total").over(earlier) / F.sum("n").over(earlier)).alias("mean_before"),
        )
        .where(F.col("first_ts") >= F.col("quiet_since") + F.make_dt_interval(days=F.lit(quiet_days)))
    )
    credits = past.select(
        F.col("dst").alias("account_id"), F.col("ts").alias("first_ts"), "txn_id", "amount",
        F.col("src").alias("sender"),
    )
    woken = wakes.join(credits, ["account_id", "first_ts"]).where(F.col("amount") > spike * F.col("mean_before"))
    debits = past.groupBy(F.col("src").alias("account_id"), F.col("ts").alias("out_ts")).agg(
        F.sum("amount").alias("out_amount")
    ).withColumn("day", F.to_date("out_ts"))
    # by account and day, so that a busy account is not one group
    first_day = F.to_date("first_ts")
    days_after = F.explode(F.sequence(first_day, F.date_add(first_day, forward_days)))
    return (
        woken.withColumn("day", days_after).join(debits, ["account_id", "day"])
        .where(
            (F.col("out_ts") > F.col("first_ts"))
            & (F.col("out_ts") <= F.col("first_ts") + F.make_dt_interval(days=F.lit(forward_days)))
        )
        .groupBy("account_id", "txn_id", F.col("first_ts").alias("activated_at"), "quiet_since", "mean_before",
                 F.col("amount").alias("activation_amount"))
        .agg(F.sum("out_amount").alias("forwarded_amount"))
        .where(F.col("forwarded_amount") > forward_share * F.col("activation_amount"))
    )


# --- profile mismatch -----------------------------------------------------------------------------

LOW_INCOME = ("STUDENT", "RETIRED")


def profile_mismatch(transfers: DataFrame, accounts: DataFrame, as_of: Column, categories: tuple = LOW_INCOME,
                     min_amount: float = 500_000) -> DataFrame:
    """Low-income customers with high-value credits, over all time up to ``as_of``."""
    return mismatch_of(high_credits(transfers.where(F.col("ts") <= as_of), min_amount), accounts, categories)


def high_credits(transfers: DataFrame, min_amount: float) -> DataFrame:
    """Count and sum of high-value credits per account."""
    return (
        transfers.where(F.col("amount") >= min_amount)
        .groupBy(F.col("dst").alias("account_id"))
        .agg(F.count("*").alias("credit_count"), F.sum("amount").alias("total_suspicious_amount"))
    )


def mismatch_of(credits: DataFrame, accounts: DataFrame, categories: tuple = LOW_INCOME) -> DataFrame:
    targets = accounts.where(F.col("customer_category").isin(*categories)).select(
        "account_id", F.col("customer_category").alias("category"), "customer_name"
    )
    return credits.join(targets, "account_id").select(
        "account_id", "category", "customer_name", "credit_count", "total_suspicious_amount"
    )


def profile_evidence(transfers: DataFrame, detections: DataFrame, as_of: Column, min_amount: float = 500_000) -> DataFrame:
    credits = transfers.where((F.col("amount") >= min_amount) & (F.col("ts") <= as_of)).withColumnsRenamed(
        {"dst": "account_id", "src": "sender"}
    )
    return salted_join(
        credits, detections.select("account_id"), "account_id", F.col("txn_id"), "left_semi",
        hot_listed(detections, "account_id", "credit_count"),
    ).select("account_id", "sender", "amount", "ts", "txn_id")


# --- all patterns ---------------------------------------------------------------------------------


def ranked(detections: DataFrame, by: str, ties: list[str], limit: int | None = None) -> DataFrame:
    """Detections in report order, optionally only the first ``limit``."""
    ordered = detections.orderBy(F.desc(by), *ties)
    return ordered.limit(limit) if limit is not None else ordered


DEFAULTS = {
    "CIRCULAR_ROUND_TRIP": {"max_hop": 5, "hours": 72},
    "LAYERING": {"min_amount": 1_000_000, "hours": 48},
    "STRUCTURING": {"threshold": 49_999, "hours": 24, "min_count": 5},
    "DORMANT_ACTIVATION": {"dormant_days": 60},
    "PROFILE_MISMATCH": {"categories": LOW_INCOME, "min_amount": 500_000},
}


class Found(NamedTuple):
    """Detections of one pattern, and the transfers behind them (none where the detection row lists them)."""

    detections: DataFrame
    evidence: DataFrame | None


def all_patterns(transfers: DataFrame, accounts: DataFrame, as_of: Column, params: dict | None = None) -> dict[str, Found]:
    """The five detectors by pattern name, in reporting order; ``params`` overrides defaults per pattern.

    Detections are written as scratch tables, because counting, scoring and evaluating all read them.
    """
    p = {name: {**DEFAULTS[name], **(params or {}).get(name, {})} for name in PATTERNS}
    pairs = None

    def layers():
        nonlocal pairs
        pairs = materialize(layering_pairs(transfers, as_of, **p["LAYERING"]), "layering-pairs")
        return layering_of(pairs)

    detectors = {
        "CIRCULAR_ROUND_TRIP": lambda: circular(transfers, as_of, **p["CIRCULAR_ROUND_TRIP"]),
        "LAYERING": layers,
        "STRUCTURING": lambda: structuring(transfers, as_of, **p["STRUCTURING"]),
        "DORMANT_ACTIVATION": lambda: dormant_activation(transfers, accounts, as_of, **p["DORMANT_ACTIVATION"]),
        "PROFILE_MISMATCH": lambda: profile_mismatch(transfers, accounts, as_of, **p["PROFILE_MISMATCH"]),
    }
    written = together(transfers.sparkSession, *[lambda d=d: materialize(d(), "detections") for d in detectors.values()])
    kept = dict(zip(detectors, written))
    evidence = {
        "LAYERING": layering_evidence(pairs, kept["LAYERING"]),
        "STRUCTURING": structuring_evidence(
            transfers, kept["STRUCTURING"], as_of, p["STRUCTURING"]["threshold"], p["STRUCTURING"]["hours"]
        ),
        "DORMANT_ACTIVATION": dormant_evidence(transfers, kept["DORMANT_ACTIVATION"], as_of),
        "PROFILE_MISMATCH": profile_evidence(
            transfers, kept["PROFILE_MISMATCH"], as_of, p["PROFILE_MISMATCH"]["min_amount"]
        ),
    }
    return {name: Found(df, evidence.get(name)) for name, df in kept.items()}


def detection_id(pattern: str) -> Column:
    parts = {
        "CIRCULAR_ROUND_TRIP": [F.array_join("txn_ids", ">")],
        "LAYERING": ["source_account", "destination_account"],
        "STRUCTURING": ["destination_account"],
        "DORMANT_ACTIVATION": ["account_id"],
        "PROFILE_MISMATCH": ["account_id"],
    }[pattern]
    return F.concat_ws(">", *parts)


def pattern_counts(found: dict[str, Found]) -> DataFrame:
    """Detections per pattern, zeros included, and their total."""
    counts = reduce(DataFrame.unionByName, [
        part.detections.agg(F.count("*").alias("detections")).select(F.lit(name).alias("pattern"), "detections")
        for name, part in found.items()
    ])
    return counts.rollup("pattern").agg(F.sum("detections").alias("detections")).select(
        F.coalesce("pattern", F.lit("TOTAL")).alias("pattern"), "detections"
    )


def involvement(found: dict[str, Found]) -> DataFrame:
    """``(pattern, detection_id, account_id)``, each account once per detection.

    Accounts on a trail, the ends and intermediaries of a layering, the senders and the receiver of a
    structuring, and the account itself for the other two.
    """
    def accounts_of(name, df, account):
        return df.select(F.lit(name).alias("pattern"), detection_id(name).alias("detection_id"), account.alias("account_id"))

    ends = F.explode(F.array("source_account", "destination_account"))
    parts = {
        "CIRCULAR_ROUND_TRIP": lambda n, d, e: accounts_of(n, d, F.explode(F.array_distinct("account_ids"))),
        "LAYERING": lambda n, d, e: accounts_of(n, d, ends).unionByName(
            accounts_of(n, e, F.col("intermediate_account")).distinct()
        ),
        "STRUCTURING": lambda n, d, e: accounts_of(n, d, F.col("destination_account"))
        .unionByName(accounts_of(n, e, F.col("sender_account")))
        .distinct(),
        "DORMANT_ACTIVATION": lambda n, d, e: accounts_of(n, d, F.col("account_id")),
        "PROFILE_MISMATCH": lambda n, d, e: accounts_of(n, d, F.col("account_id")),
    }
    return reduce(DataFrame.unionByName, [parts[n](n, f.detections, f.evidence) for n, f in found.items()])


def transfers_behind(found: dict[str, Found]) -> DataFrame:
    """``(pattern, txn_id)``: the distinct transfers behind the detections of each pattern."""
    def txns(f):
        return f.evidence if f.evidence is not None else f.detections.select(F.explode("txn_ids").alias("txn_id"))

    return reduce(DataFrame.unionByName, [
        txns(f).select(F.lit(name).alias("pattern"), "txn_id").distinct() for name, f in found.items()
    ])


def detector_evaluation(transfers: DataFrame, behind: DataFrame) -> DataFrame:
    """Precision and recall of each pattern's transfers against the fraud labels.

    ``labelled`` counts all fraud transfers, ``labelled_here`` those labelled with the pattern itself when the
    transfers carry ``fraud_type``.
    """
    has_type = "fraud_type" in transfers.columns
    marks = transfers.where("is_fraud").select(
        "txn_id", (F.col("fraud_type") if has_type else F.lit(None).cast("string")).alias("fraud_type")
    )
    hits = (
        behind.join(marks.withColumn("marked", F.lit(True)), "txn_id", "left")
        .groupBy("pattern")
        .agg(
            F.count("*").alias("detected"),
            F.count_if(F.col("marked")).alias("fraud_detected"),
            F.count_if(F.col("fraud_type") == F.col("pattern")).alias("own_detected"),
        )
    )
    names = transfers.sparkSession.createDataFrame([(n,) for n in PATTERNS], "pattern string")
    per_type = marks.groupBy(F.col("fraud_type").alias("pattern")).agg(F.count("*").alias("own_labelled"))
    labelled = marks.agg(F.count("*").alias("n")).scalar()
    zero = F.lit(0).cast("bigint")
    joined = names.join(hits, "pattern", "left").join(per_type, "pattern", "left").select(
        "pattern",
        *[F.coalesce(c, zero).alias(c) for c in ("detected", "fraud_detected", "own_detected", "own_labelled")],
        labelled.alias("labelled"),
    )

    def share(part, whole):
        return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))

    return joined.select(
        "*",
        share("fraud_detected", "detected").alias("precision"),
        share("fraud_detected", "labelled").alias("recall"),
        share("own_detected", "own_labelled").alias("own_recall"),
    )

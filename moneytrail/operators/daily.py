"""Account features from daily partial aggregates, so that new transfers cost only the days they fall on.

``daily`` holds per day, account and direction the counts, sums, squares and extremes of the transfers, and a sketch of the
counterparties; ``pairs`` the counterparties themselves. Both are stored by day. Transfers that agree in everything agree in their
day, so that counting them once is a matter of one day. Windows are made of whole days and of the up to four days they cut, which
are read from the transfers.
"""

from datetime import date, datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.functions.columns import days_before
from moneytrail.operators.features import account_features as features_from
from moneytrail.operators.features import described, moves
from moneytrail.scratch import materialize, materialize_counted

#: Logarithm of the buckets of a counterparty sketch: a relative error of about 1.04 / sqrt(2^LG).
LG = 12
MONTH, FORTNIGHT, WEEK = 30, 14, 7
SUMS = ("n", "total", "squares", "n_night")


def changed_days(transfers: DataFrame) -> list[date]:
    """The days that transfers fall on."""
    return [r["day"] for r in transfers.select(F.to_date("ts").alias("day")).distinct().orderBy("day").collect()]


def on_days(transfers: DataFrame, days: list[date]) -> DataFrame:
    """The transfers of some days; of a table stored by day only their folders are read."""
    at = F.col("day") if "day" in transfers.columns else F.to_date("ts")
    return transfers.where(at.isin(days)) if days else transfers.limit(0)


def seen_once(transfers: DataFrame) -> DataFrame:
    return moves(transfers.select("src", "dst", "ts", "amount")).distinct()


def partials(seen: DataFrame, *by: Column) -> DataFrame:
    """Sums of moves that count once, per account, direction and ``by``."""
    amount, hour = F.col("amount"), F.hour("ts")
    return seen.groupBy("account_id", "sent", *by).agg(
        F.count("*").alias("n"), F.sum(amount).alias("total"), F.sum(amount * amount).alias("squares"),
        F.count_if((hour >= 23) | (hour < 5)).alias("n_night"), F.max(amount).alias("largest"), F.max("ts").alias("last_ts"),
        F.hll_sketch_agg("counterparty", LG).alias("sketch"),
    )


def refresh(transfers: DataFrame, path: str, days: list[date]) -> None:
    """Make the partial aggregates of ``days`` anew from all transfers, and leave those of other days alone."""
    seen = materialize(seen_once(on_days(transfers, days)).withColumn("day", F.to_date("ts")), "daily-moves")
    for name, rows in (("daily", partials(seen, F.col("day"))), ("pairs", seen.select("day", "account_id", "counterparty").distinct())):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{name}")


def account_features(path: str, transfers: DataFrame, accounts: DataFrame, as_of: datetime, sketch: bool = False,
                     activated: DataFrame | None = None) -> DataFrame:
    """What ``features.account_features`` gives, from the partial aggregates below ``path`` and the transfers of days a window cuts.

    With ``sketch`` the counterparties of the month are an estimate from merged sketches.
    """
    spark = transfers.sparkSession
    now = F.lit(as_of).cast("timestamp_ntz")
    cut = sorted({(as_of - timedelta(days=d)).date() for d in (0, WEEK, FORTNIGHT, MONTH)})
    day, ts = F.col("day"), F.col("ts")

    def stored(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}").where((day < F.lit(as_of.date())) & ~day.isin(cut))

    spans = {"month": MONTH, "fortnight": FORTNIGHT, "week": WEEK}
    whole_days = stored("daily").withColumns({name: day > F.lit((as_of - timedelta(days=d)).date()) for name, d in spans.items()}).drop("day")
    recent = {name: ts > days_before(now, d) for name, d in spans.items()}
    cut_moves = materialize(seen_once(on_days(transfers, cut).where(ts <= now)).withColumns(recent), "cut-moves")
    rows = whole_days.unionByName(partials(cut_moves, *[F.col(name) for name in spans]))

    def within(name: str, sent: bool, column: str) -> Column:
        return F.sum(F.when(F.col(name) & (F.col("sent") == sent), F.col(column)))

    sums = rows.groupBy("account_id").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.max("largest").alias("largest"), F.max("last_ts").alias("last_ts"),
        within("month", True, "total").alias("sent_30d"), within("month", False, "total").alias("received_30d"),
        F.sum(F.when(F.col("month"), F.col("n"))).alias("n_30d"),
        within("week", True, "n").alias("n_7d"),
        F.sum(F.when(F.col("fortnight") & ~F.col("week") & F.col("sent"), F.col("n"))).alias("n_prev_7d"),
        F.hll_union_agg(F.when(F.col("month"), F.col("sketch"))).alias("sketch"),
    )
    if sketch:
        return described(sums.withColumn("counterparties", F.hll_sketch_estimate("sketch")).drop("sketch"), accounts, now, activated)
    month_pairs = stored("pairs").where(day > F.lit((as_of - timedelta(days=MONTH)).date())).select("account_id", "counterparty")
    others = month_pairs.unionByName(cut_moves.where("month").select("account_id", "counterparty")).distinct()
    counted = others.groupBy("account_id").agg(F.count("*").alias("counterparties"))
    return described(sums.drop("sketch").join(counted, "account_id", "left"), accounts, now, activated)


def stale_accounts(transfers: DataFrame, before: datetime, as_of: datetime) -> DataFrame:
    """Accounts whose features of ``before`` no longer hold at ``as_of``: a transfer has come, or has left one of the windows."""
    spans = [(before - timedelta(days=d), as_of - timedelta(days=d)) for d in (0, WEEK, FORTNIGHT, MONTH)]
    days = sorted({a.date() + timedelta(days=n) for a, b in spans for n in range((b.date() - a.date()).days + 1)})
    ts = F.col("ts")

    def between(a: datetime, b: datetime) -> Column:
        return (ts > F.lit(a).cast("timestamp_ntz")) & (ts <= F.lit(b).cast("timestamp_ntz"))

    crossed = reduce(or_, [between(a, b) for a, b in spans])
    return on_days(transfers, days).where(crossed).select(F.explode(F.array("src", "dst")).alias("account_id")).distinct()


def refreshed(stored: DataFrame, transfers: DataFrame, accounts: DataFrame, before: datetime, as_of: datetime,
              late: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Features at ``as_of`` from those stored for ``before``, and the number of accounts computed anew.

    Anew are the stale accounts, those of ``late`` transfers (that came after ``before`` for a time up to it), and those not
    stored. The others keep their sums; what they take from the account table and the days since their last transfer are brought up to date.
    """
    stale = stale_accounts(transfers, before, as_of)
    if late is not None:
        stale = stale.union(late.select(F.explode(F.array("src", "dst")).alias("account_id")))
    stale = stale.union(accounts.select("account_id").join(stored, "account_id", "left_anti"))
    again, n = materialize_counted(accounts.join(stale.distinct(), "account_id", "left_semi"), "stale-accounts")
    now = F.lit(as_of).cast("timestamp_ntz")
    own = again.select("account_id")
    moved = transfers.join(own.withColumnRenamed("account_id", "src"), "src", "left_semi").select(*transfers.columns).union(
        transfers.join(own.withColumnRenamed("account_id", "dst"), "dst", "left_semi").select(*transfers.columns)
    )
    # equal moves count once, so a transfer between two stale accounts may come twice
    anew = features_from(moved, again, now)
    given = ["account_type", "is_flagged", "account_age_days"]
    kept = stored.join(own, "account_id", "left_anti").drop(*given, "is_dormant_activated").join(
        accounts.select("account_id", *given, (F.col("account_type") == "DORMANT").cast("int").alias("is_dormant_activated")), "account_id"
    ).withColumn("days_since_last_txn", F.col("days_since_last_txn") + F.datediff(F.lit(as_of.date()), F.lit(before.date())))
    return anew.unionByName(kept.select(*anew.columns)), n

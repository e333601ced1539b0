"""Record rules, normalisation and the dataset profile."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail import schema as S
from moneytrail.functions.skew import salted_join
from moneytrail.sources.edges import with_known


def valid_account_id(column: str) -> Column:
    """Prefix ACC and 13 characters; the rest need not be digits."""
    return F.col(column).startswith("ACC") & (F.length(column) == 13)


def _violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per record and broken rule; a rule that evaluates to null is broken."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.select(F.col(key).alias("record_id"), F.explode(broken).alias("rule"))


def account_violations(accounts: DataFrame) -> DataFrame:
    return _violations(accounts, "account_id", {
        "account_id_format": valid_account_id("account_id"),
        "account_type_domain": F.col("account_type").isin(S.ACCOUNT_TYPES),
        "customer_category_domain": F.col("customer_category").isin(S.CUSTOMER_CATEGORIES),
        "kyc_status_domain": F.col("kyc_status").isin(S.KYC_STATUSES),
        "account_age_range": F.col("account_age_days") >= 0,
        "account_risk_range": F.col("risk_score").between(*S.ACCOUNT_RISK_RANGE),
    })


def transaction_violations(txns: DataFrame) -> DataFrame:
    return _violations(txns, "txn_id", {
        "sender_format": valid_account_id("sender_account"),
        "receiver_format": valid_account_id("receiver_account"),
        "amount_range": F.col("amount").between(*S.AMOUNT_RANGE),
        "txn_type_domain": F.col("txn_type").isin(S.TXN_TYPES),
        "channel_domain": F.col("channel").isin(S.CHANNELS),
        "status_domain": F.col("status").isin(S.TXN_STATUSES),
        "fraud_type_domain": F.col("fraud_type").isNull() | F.col("fraud_type").isin(S.PATTERNS),
    })


def alert_violations(alerts: DataFrame) -> DataFrame:
    return _violations(alerts, "alert_id", {
        "alert_risk_range": F.col("risk_score").between(*S.ALERT_RISK_RANGE),
        "risk_tier_domain": F.col("risk_tier").isin(S.RISK_TIERS),
        "status_domain": F.col("status").isin(S.ALERT_STATUSES),
    })


# Amount bands by the sender's account type, and limits by channel product.
TYPE_BANDS = {
    "SALARY": (20_000.0, 80_000.0),
    "CURRENT": (100.0, 50_000_000.0),
    "SHELL": (100.0, 50_000_000.0),
    "DORMANT": (1_000.0, 500_000.0),
}
OTHER_BAND = (100.0, 5_000_000.0)
RTGS_MIN = 200_000.0
UPI_MAX = 100_000.0


def limit_violations(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transactions outside the product limits or outside the band of the sender's account type."""
    rules = {
        "rtgs_minimum": (F.col("txn_type") != "RTGS") | (F.col("amount") >= RTGS_MIN),
        "upi_maximum": (F.col("txn_type") != "UPI") | (F.col("amount") <= UPI_MAX),
    }
    by_product = _violations(txns, "txn_id", rules)

    kind = F.col("account_type")
    lower = reduce(lambda c, t: c.when(kind == t, TYPE_BANDS[t][0]), TYPE_BANDS, F).otherwise(OTHER_BAND[0])
    upper = reduce(lambda c, t: c.when(kind == t, TYPE_BANDS[t][1]), TYPE_BANDS, F).otherwise(OTHER_BAND[1])
    senders = accounts.select(F.col("account_id").alias("sender_account"), "account_type")
    typed = salted_join(
        txns.select("txn_id", "sender_account", "amount"), senders, "sender_account", F.col("txn_id")
    )
    outside = ~F.col("amount").between(lower, upper)
    by_type = typed.where(outside).select(
        F.col("txn_id").alias("record_id"), F.lit("account_type_band").alias("rule")
    )
    return by_product.unionByName(by_type)


def fill_defaults(txns: DataFrame) -> DataFrame:
    """Missing status, description, fraud mark and id get their defaults; ids are content hashes."""
    content = ["timestamp", "sender_account", "receiver_account", "amount", "txn_type", "channel"]
    made_id = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]), 256)
    return (
        txns.withColumn("txn_id", F.coalesce("txn_id", made_id))
        .withColumn("status", F.coalesce("status", F.lit("SUCCESS")))
        .withColumn("description", F.coalesce("description", F.lit("")))
        .withColumn("is_fraud", F.coalesce("is_fraud", F.lit(False)))
    )


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Parse as double; what does not parse becomes 0."""
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) for c in columns
    })


def finite_or_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN, infinities and nulls become 0."""
    def clean(c):
        value = F.col(c).cast("double")
        bad = F.isnan(value) | (F.abs(value) == float("inf")) | value.isNull()
        return F.when(bad, F.lit(0.0)).otherwise(value)
    return df.withColumns({c: clean(c) for c in columns})


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of a supposedly unique key that occur more than once."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("copies")).where("copies > 1")


def orphan_transfers(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transactions with an unknown endpoint, and which end is unknown."""
    def lost(column, side):
        return with_known(txns, accounts, column, "left_anti").select("txn_id", F.lit(side).alias("side"))
    return lost("sender_account", "sender").unionByName(lost("receiver_account", "receiver"))


def dataset_profile(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Totals, fraud share, date range and breakdowns as ``(section, item, value, position)``."""
    fraud = F.coalesce(F.col("is_fraud"), F.lit(False))
    totals = txns.agg(
        F.count("*").alias("total"),
        F.count_if(fraud).alias("fraud"),
        F.date_format(F.min("timestamp"), "yyyy-MM-dd").alias("first"),
        F.date_format(F.max("timestamp"), "yyyy-MM-dd").alias("last"),
    )
    percent = F.when(F.col("total") > 0, F.format_string("%.1f", F.col("fraud") * F.lit(100.0) / F.col("total"))).otherwise("0.0")
    items = {
        "total_transactions": F.col("total").cast("string"),
        "fraud_transactions": F.col("fraud").cast("string"),
        "fraud_percent": percent,
        "first_date": F.col("first"),
        "last_date": F.col("last"),
    }
    totals = totals.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("item"), v.alias("value")) for k, v in items.items()])).alias("r")
    ).select(F.lit("totals").alias("section"), "r.item", "r.value")
    n_accounts = accounts.agg(F.count("*").cast("string").alias("value")).select(
        F.lit("totals").alias("section"), F.lit("total_accounts").alias("item"), "value"
    )

    def breakdown(df, section, column):
        return df.groupBy(F.col(column).alias("item")).agg(F.count("*").cast("string").alias("value")).select(
            F.lit(section).alias("section"), "item", "value"
        )

    return (
        totals.unionByName(n_accounts)
        .unionByName(breakdown(txns.where(fraud & F.col("fraud_type").isNotNull()), "fraud_type", "fraud_type"))
        .unionByName(breakdown(accounts, "account_type", "account_type"))
        .orderBy("section", F.desc(F.col("value").try_cast("bigint")), "item")
    )

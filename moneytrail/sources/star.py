"""Accounts and transactions derived from the star-schema test tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,"
    " o_orderpriority string"
)


def table(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def as_of_lit(as_of: str = AS_OF):
    return F.lit(as_of).cast("timestamp_ntz")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 11-column transaction record, one row per event."""
    return transactions_from(table(spark, sf_dir, "events", EVENTS))


def transactions_from(events: DataFrame) -> DataFrame:
    """Static or streaming events as transactions."""
    return events.select(
        F.expr("concat('T', lpad(cast(event_id as string), 12, '0'))").alias("txn_id"),
        F.col("ts").alias("timestamp"),
        F.expr("concat('ACC', lpad(cast(user_id as string), 10, '0'))").alias("sender_account"),
        F.expr("concat('ACC', lpad(regexp_extract(props, '[0-9]+', 0), 10, '0'))").alias("receiver_account"),
        F.expr("cast(cast(round(value * 100) as bigint) * 100 as double)").alias("amount"),
        F.expr(
            "case event_type when 'purchase' then 'NEFT' when 'view' then 'UPI' when 'signup' then 'IMPS'"
            " when 'error' then 'RTGS' else 'INTERNAL' end"
        ).alias("txn_type"),
        F.expr("element_at(array('MOBILE','NETBANKING','BRANCH','ATM','API'), cast(event_id % 5 as int) + 1)").alias("channel"),
        F.lit("SUCCESS").alias("status"),
        F.lit("").alias("description"),
        F.expr("value >= 250").alias("is_fraud"),
        F.expr(
            "case when value >= 250 then element_at(array('CIRCULAR_ROUND_TRIP','LAYERING','STRUCTURING',"
            "'DORMANT_ACTIVATION','PROFILE_MISMATCH'), cast(event_id % 5 as int) + 1) end"
        ).alias("fraud_type"),
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transfer edges ``(txn_id, ts, src, dst, amount, txn_type, is_fraud)``."""
    return edges_of(transactions(spark, sf_dir))


def edges_of(txns: DataFrame) -> DataFrame:
    return txns.select(
        "txn_id",
        F.col("timestamp").alias("ts"),
        F.col("sender_account").alias("src"),
        F.col("receiver_account").alias("dst"),
        "amount",
        "txn_type",
        "is_fraud",
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 9-column account record, one row per customer."""
    customer = table(spark, sf_dir, "customer", CUSTOMER)
    first_order = (
        table(spark, sf_dir, "orders", ORDERS)
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.min("o_orderdate").alias("first_order"))
    )
    return customer.join(first_order, "c_custkey", "left").select(
        F.expr("concat('ACC', lpad(cast(c_custkey as string), 10, '0'))").alias("account_id"),
        F.expr(
            "case c_mktsegment when 'AUTOMOBILE' then 'SAVINGS' when 'BUILDING' then 'CURRENT'"
            " when 'FURNITURE' then 'SALARY' when 'HOUSEHOLD' then 'DORMANT' else 'SHELL' end"
        ).alias("account_type"),
        F.col("c_name").alias("customer_name"),
        F.expr("element_at(array('INDIVIDUAL','BUSINESS','STUDENT','RETIRED'), c_nationkey % 4 + 1)").alias("customer_category"),
        F.expr("concat('BR', lpad(cast(c_nationkey as string), 4, '0'))").alias("branch_code"),
        F.expr("case c_custkey % 10 when 8 then 'PENDING' when 9 then 'EXPIRED' else 'VERIFIED' end").alias("kyc_status"),
        F.expr("coalesce(datediff(date'2024-01-31', cast(first_order as date)), 0)").alias("account_age_days"),
        F.lit(0.0).alias("risk_score"),
        F.expr("c_acctbal < -500").alias("is_flagged"),
    )

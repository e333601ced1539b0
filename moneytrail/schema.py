"""Table schemas and value domains."""

from pyspark.sql import types as T

# The fields of the two records.
ACCOUNTS = T.StructType([
    T.StructField("account_id", T.StringType()),
    T.StructField("account_type", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("customer_category", T.StringType()),
    T.StructField("branch_code", T.StringType()),
    T.StructField("kyc_status", T.StringType()),
    T.StructField("account_age_days", T.IntegerType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("is_flagged", T.BooleanType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("txn_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("sender_account", T.StringType()),
    T.StructField("receiver_account", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("txn_type", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("is_fraud", T.BooleanType()),
    T.StructField("fraud_type", T.StringType()),
])

# The domains of the string enumerations.
TXN_TYPES = ["NEFT", "RTGS", "IMPS", "UPI", "INTERNAL"]
CHANNELS = ["MOBILE", "NETBANKING", "BRANCH", "ATM", "API"]
TXN_STATUSES = ["SUCCESS", "FAILED", "PENDING"]
ACCOUNT_TYPES = ["SAVINGS", "CURRENT", "SALARY", "DORMANT", "SHELL"]
CUSTOMER_CATEGORIES = ["INDIVIDUAL", "BUSINESS", "STUDENT", "RETIRED"]
KYC_STATUSES = ["VERIFIED", "PENDING", "EXPIRED"]
RISK_TIERS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
ALERT_STATUSES = ["OPEN", "INVESTIGATING", "DISMISSED", "ESCALATED"]

# Pattern names in reporting order, with the points one detection is worth.
PATTERN_POINTS = {
    "CIRCULAR_ROUND_TRIP": 40,
    "LAYERING": 35,
    "STRUCTURING": 30,
    "DORMANT_ACTIVATION": 25,
    "PROFILE_MISMATCH": 20,
}
PATTERNS = list(PATTERN_POINTS)

# Accepted ranges (inclusive).
AMOUNT_RANGE = (100.0, 50_000_000.0)
ACCOUNT_RISK_RANGE = (0.0, 1.0)
ALERT_RISK_RANGE = (0.0, 100.0)

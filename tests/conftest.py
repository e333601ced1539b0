import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from pyspark.sql import functions as F  # noqa: E402

from moneytrail.session import local_session  # noqa: E402

AS_OF = datetime(2024, 1, 31)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


@pytest.fixture
def transfers(spark):
    """Make transfers from ``(src, dst, amount, hours before)`` rows, optionally with a txn_id."""
    def make(*rows):
        full = [
            (r[4] if len(r) > 4 else f"t{i:03d}", AS_OF - timedelta(hours=r[3]), r[0], r[1], float(r[2]), "NEFT", False)
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(
            full, "txn_id string, ts timestamp_ntz, src string, dst string, amount double, txn_type string, is_fraud boolean"
        )
    return make


@pytest.fixture
def accounts(spark):
    """Make accounts from ids or ``(id, overrides)`` pairs."""
    base = {
        "account_type": "SAVINGS", "customer_name": "N", "customer_category": "INDIVIDUAL", "branch_code": "B",
        "kyc_status": "VERIFIED", "account_age_days": 10, "risk_score": 0.0, "is_flagged": False,
    }
    from moneytrail.schema import ACCOUNTS

    def make(*items):
        rows = []
        for item in items:
            name, own = (item, {}) if isinstance(item, str) else item
            row = {"account_id": name, **base, **own}
            rows.append(tuple(row[f.name] for f in ACCOUNTS.fields))
        return spark.createDataFrame(rows, ACCOUNTS)
    return make

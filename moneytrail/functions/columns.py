"""Small column expressions shared by the operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _before(as_of: Column, **parts: int) -> Column:
    return as_of - F.make_dt_interval(**{k: F.lit(v) for k, v in parts.items()})


def hours_before(as_of: Column, hours: int) -> Column:
    return _before(as_of, days=0, hours=hours)


def days_before(as_of: Column, days: int) -> Column:
    return _before(as_of, days=days)


def look_back(transfers: DataFrame, as_of: Column, **span: int) -> DataFrame:
    """Transfers in (as_of - span, as_of], the span given in ``hours`` or ``days``.

    If the table is stored by ``day``, only the folders of the span are read.
    """
    start = _before(as_of, **{"days": 0, **span})
    if "day" in transfers.columns:
        transfers = transfers.where(F.col("day").between(F.to_date(start), F.to_date(as_of)))
    return transfers.where((F.col("ts") > start) & (F.col("ts") <= as_of))


def within_days(ts: Column, as_of: Column, days: int) -> Column:
    """``ts`` in (as_of - days, as_of]."""
    return (ts > days_before(as_of, days)) & (ts <= as_of)


def micros(ts: Column) -> Column:
    """Microseconds of a zone-less timestamp, read as UTC wherever the session is."""
    minutes = F.unix_date(ts.cast("date")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def from_micros(value: Column) -> Column:
    """The inverse of ``micros``."""
    seconds = (value / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def text_of(array: str | Column) -> Column:
    """Array as one text, for sinks and comparisons that hold no arrays."""
    return F.array_join(array, ",")


def fixed(value: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals, halves going to the even digit."""
    return F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits))

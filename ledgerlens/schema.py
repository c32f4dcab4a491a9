"""Thresholds of the detectors and shared expressions.  Fixed values: results depend on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUND_TRIP = {"days": 30, "low": 0.65, "high": 1.35, "quantile": 0.60, "per_pair": 3}
CYCLE = {"min_hops": 3, "max_hops": 6, "days": 45, "hop_hours": 96, "keep": 0.55, "close_low": 0.55, "close_high": 1.45, "quantile": 0.20, "floor_from": 5}
LAYERING = {"min_chain": 3, "max_chain": 6, "hop_hours": 72, "keep": 0.50, "quantile": 0.60}
FAN = {"in": {"parties": 4, "hours": 72, "quantile": 0.60}, "out": {"parties": 4, "hours": 48, "quantile": 0.60}}
SMURF = {"txns": 3, "days": 14, "destinations": 2, "quantile": 0.75, "lower": 0.80, "account_txns": 8}
ODD = {"start": 0, "end": 5, "txns": 3, "timed_ratio": 0.20, "odd_ratio": 0.25}
VELOCITY = {"minutes": 30, "txns": 3}
BALANCE = {"tolerance": 0.01, "minor": 5.0, "account_ratio": 0.05, "flat_ratio": 0.90, "flat_txns": 5}
OUTLIER = {"times_iqr": 3.0, "txns": 10, "nonzero": 4}
BENEFICIARY = {"zscore": 2.5, "new_ratio": 0.5}
WEIGHTS = {"round_trip": 0.14, "layering": 0.16, "fan_in": 0.11, "fan_out": 0.11, "smurfing": 0.12, "odd_hour": 0.06, "velocity": 0.08, "high_value": 0.07, "balance_breach": 0.05, "new_hv_bene": 0.04, "graph": 0.06}

MONEY = "decimal(18,2)"


def counterparty(account: Column, name: Column) -> Column:
    """The first of account and name that isn't blank, trimmed, spaces collapsed, upper case; else ''."""
    clean = lambda c: F.nullif(F.upper(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))
    return F.coalesce(clean(account), clean(name), F.lit(""))


def timestamp_of(date: Column, time: Column) -> Column:
    """Date and time, else the date alone, else the first of January 2000."""
    return F.coalesce(F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(date, F.lit("yyyy-MM-dd")), F.lit("2000-01-01").cast("timestamp"))


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def joined(values: Column) -> Column:
    """An array as one sorted, comma-separated string, as the registered queries show arrays."""
    return F.array_join(F.array_sort(values), ",")

"""Joins of rows with equal keys and times within a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs with equal keys and 0 <= right_time - left_time <= seconds (epoch seconds).

    Times fall into buckets as long as the window, so a pair's right row is in the left row's bucket or the next one.
    The join is an equi-join on keys and bucket, which keeps a busy key from being compared as a whole.  Columns
    other than the keys must have different names.
    """
    bucket = lambda c: F.floor(F.col(c) / seconds)
    a = left.withColumn("_bucket", F.explode(F.array(bucket(left_time), bucket(left_time) + 1)))
    b = right.withColumn("_bucket", bucket(right_time))
    return a.join(b, [*keys, "_bucket"]).filter((F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + seconds)).drop("_bucket")

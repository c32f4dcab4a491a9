"""The detectors' counts on streams; a drained stream gives what the batch gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..plans.fixpoint import shared_folder


def sliding_counts(events: DataFrame, length: str = "30 minutes", step: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """Events and their values for each user and sliding window; in output mode complete all windows stay in the state."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))


def drained(spark: SparkSession, sf_dir: str, name: str, transform, mode: str = "complete") -> DataFrame:
    """What a stream over a table gives once all of it has been read; results and state are in the shared folder."""
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{home}/out")
    transform(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{home}/out")


register(
    "str_sliding_counts",
    lambda s, d: drained(s, d, "events", sliding_counts).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n", F.col("total").cast("double").alias("total")),
    """SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n, CAST(sum(CAST(value AS decimal(18,4))) AS DOUBLE) AS total
FROM (SELECT user_id, value, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(10 * k) AS start FROM events CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)) GROUP BY 1, 2""",
)
register(
    "str_sessions",
    lambda s, d: (
        s.read.parquet(f"{d}/events.parquet").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
        .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")
    ),
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
x AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM x GROUP BY user_id, k""",
)

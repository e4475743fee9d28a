"""Structured Streaming over the event log: windowed counts with late data, and a stateful fold per account."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The log as it grows, from a folder of JSON or Parquet files."""
    kind = "parquet" if path.rstrip("/").endswith(".parquet") else "json"
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and value by type and hour. In append mode a window comes out when the watermark (``late`` behind the latest
    event) has passed its end: later events of it are dropped, and windows still open at the end of the input stay in
    the state."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "value")
    )


def balances(events: DataFrame) -> DataFrame:
    """Running balance per account over micro-batches: purchases and errors lower it. State: a balance an account."""

    def fold(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        cents, n = state.get if state.exists else (0, 0)
        for b in batches:
            sign = b["event_type"].isin(["purchase", "error"]).map({True: -1, False: 1})
            cents, n = cents + int((sign * (b["value"] * 100).round().astype("int64")).sum()), n + len(b)
        state.update((cents, n))
        yield pd.DataFrame({"account": [key[0]], "balance": [cents / 100], "n": [n]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("user_id").applyInPandasWithState(fold, "account long, balance double, n long", "cents long, n long", "update", GroupStateTimeout.NoTimeout)


def drained(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there, into a Parquet table at path, and reads it."""
    spark = df.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/data")

    spark_query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    spark_query.awaitTermination()
    return spark.read.parquet(f"{path}/data")

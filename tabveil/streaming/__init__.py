"""The same operators on streams: cleaning, constraints and suppressed counts over event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.operators.aggregates import suppress
from tabveil.session import shared_dir


def read_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The Parquet files of that name in the folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def windowed_counts(events: DataFrame, time: str, keys: list[str | Column], width: str = "1 day", late: str = "7 days") -> DataFrame:
    """start, keys, n: rows of each window; rows that come later than `late` behind the newest are left out."""
    w = F.window(time, width)
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).withColumn("start", F.col("w.start")).drop("w")


def latest(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run a stream over all that is there and give the last row of each key.

    The stream is in update mode, so that windows behind the watermark leave the state. Each batch writes the rows that
    it changed as Parquet in the shared folder, under its own number: a batch that is run again replaces them.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result/batch={number}")

    df.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.schema(schema.add("batch", "long")).parquet(f"{base}/result")
    others = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_x")).select(*keys, "_x.*")


def hide_small(df: DataFrame, least: int = 10) -> DataFrame:
    """n below least becomes NULL."""
    return df.withColumn("n", suppress(F.col("n"), least))

"""Structured Streaming forms of ingestion (STM01-STM05)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def drain_folder(spark: SparkSession, folder: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None], fmt: str = "parquet", **options) -> StreamingQuery:
    """STM01, SRC19: all files that came since the last call, each once, then the query ends."""
    s = spark.readStream.format(fmt).schema(schema).options(**options).load(folder)
    q = s.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def append_once(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """STM02: a batch sink that keeps the first row of each key; run again, it adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return run


def merge_by_cursor(path: str, key: str, order: str, removed: str) -> Callable[[DataFrame, int], None]:
    """STM03: versions of the table in folders by batch; each holds the newest image of each key that is
    not removed.  A batch that is run again writes the same folder."""

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        every = batch if n == 0 else spark.read.parquet(f"{path}/v{n - 1}").unionByName(batch)
        rest = [c for c in every.columns if c != key]
        last = every.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
        last.write.mode("overwrite").parquet(f"{path}/v{n}")

    return run


def changed_since(df: DataFrame, last: str) -> DataFrame:
    """STM04: rows whose ``updated_at`` is later than the consumer's mark."""
    return df.where(F.col("updated_at") > F.lit(last).cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Beyond the reference: counts and sums by event time, late rows dropped past the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def running_state(events: DataFrame) -> DataFrame:
    """STM05, beyond the reference: a balance for each user carried across batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, n = state.get if state.exists else (0.0, 0)
        for pdf in batches:
            total, n = total + float(pdf["value"].sum()), n + len(pdf)
        state.update((total, n))
        yield pd.DataFrame({"user_id": [key[0]], "total": [total], "n": [n]})

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(step, "user_id long, total double, n long", "total double, n long", "update", "NoTimeout")

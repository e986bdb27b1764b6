"""Event streams: windows with watermarks, deduplication, idempotent upserts, the last samples of each kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LATE = "2 hours"


def read_stream(spark: SparkSession, path: str, schema: str | object, files_a_trigger: int | None = None) -> DataFrame:
    """A file stream; times without a zone are read as UTC, as watermarks need times with one."""
    reader = spark.readStream.schema(schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return with_time(reader.parquet(path))


def with_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, width: str, *keys: str, late: str = LATE) -> DataFrame:
    return _windowed(events, F.window("ts", width), keys, late)


def sliding(events: DataFrame, width: str, step: str, *keys: str, late: str = LATE) -> DataFrame:
    return _windowed(events, F.window("ts", width, step), keys, late)


def sessions(events: DataFrame, gap: str, *keys: str, late: str = LATE) -> DataFrame:
    return _windowed(events, F.session_window("ts", gap), keys, late)


def _windowed(events: DataFrame, window: Column, keys: tuple[str, ...], late: str) -> DataFrame:
    marked = events.withWatermark("ts", late)
    t = marked.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return t.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def distinct_by(events: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """The first event of each key; state is kept for as long as late events may come."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upsert_each(apply: Callable[[DataFrame], None], key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands on the newest row of each key, so a replayed batch changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        newest = Window.partitionBy(*key).orderBy(F.col(order).desc())
        apply(batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n"))

    return run


def last_samples(samples: DataFrame, kind: str, seq: str, n: int = 1000) -> DataFrame:
    """The newest n samples of each kind, and how many there were in all."""
    newest = Window.partitionBy(kind).orderBy(F.col(seq).desc())
    t = samples.withColumn("_n", F.row_number().over(newest)).withColumn("lifetime", F.count("*").over(Window.partitionBy(kind)))
    return t.where(F.col("_n") <= n).drop("_n")


def rolling_latency(samples: DataFrame, kind: str = "kind", value: str = "latency_ms", n: int = 1000) -> DataFrame:
    """(kind, lifetime, held, p50, p95, p99) after each trigger, over the last n samples of each kind; lifetime counts them all.

    State is at most n numbers for each kind.
    """
    import numpy as np
    import pandas as pd

    def run(key, batches, state):
        lifetime, kept = state.get if state.exists else (0, [])
        kept = list(kept)
        for b in batches:
            kept = (kept + b["value"].tolist())[-n:]
            lifetime += len(b)
        state.update((lifetime, kept))
        at = np.percentile(kept, [50, 95, 99]) if kept else [0.0] * 3
        yield pd.DataFrame([(key[0], lifetime, len(kept), *map(float, at))], columns=["kind", "lifetime", "held", "p50", "p95", "p99"])

    rows = samples.select(F.col(kind).cast("string").alias("kind"), F.col(value).cast("double").alias("value")).where("value is not null")
    out, held = "kind string, lifetime long, held long, p50 double, p95 double, p99 double", "lifetime long, kept array<double>"
    return rows.groupBy("kind").applyInPandasWithState(run, out, held, "update", "NoTimeout")

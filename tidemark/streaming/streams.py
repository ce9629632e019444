"""Unbounded variants: windows, complete periods, deduplication, stateful trends, incremental parts.

Every function takes a streaming DataFrame and gives one; the same code runs on batches, which is how it is tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.sinks import write_partitions


def events(spark: SparkSession, path: str, like: DataFrame, time: str = "ts", files: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of `like`; `time` as a timestamp with zone, which watermarks need."""
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(df: DataFrame, time: str, width: str, keys: Sequence[str], value: str, late: str | None = None) -> DataFrame:
    """Count, sum and largest value by window and keys; with `late`, rows later than that are dropped and a window is final once the watermark passes it."""
    source = df.withWatermark(time, late) if late and df.isStreaming else df
    return source.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("highest")).select(F.col("w.start").alias("window_start"), *keys, "n", "total", "highest")


def sliding(df: DataFrame, time: str, width: str, slide: str, keys: Sequence[str], late: str | None = None) -> DataFrame:
    source = df.withWatermark(time, late) if late and df.isStreaming else df
    return source.groupBy(F.window(time, width, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], late: str | None = None) -> DataFrame:
    source = df.withWatermark(time, late) if late and df.isStreaming else df
    return source.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def look_back(df: DataFrame, time: str, days: int, now: str | None = None) -> DataFrame:
    """Rows of the last `days` days before `now` (the moment of the query if not given)."""
    end = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return df.where((F.col(time) >= end - F.make_dt_interval(days=F.lit(days))) & (F.col(time) <= end))


def once(df: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """Each key once; the state of a key is dropped when the watermark passes it."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def running_extremes(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Per key, after each batch, the count, largest value and time of it so far; state of three numbers per key. Batches of one key come in pieces and are reduced as they come."""
    shape = f"{key} {dict(df.dtypes)[key]}, n bigint, highest double, at timestamp"

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, highest, at = state.get if state.exists else (0, None, None)
        for batch in batches:
            seen = batch.dropna(subset=[value])
            n += len(batch)
            if len(seen):
                best = seen.loc[seen[value].idxmax()]
                if highest is None or best[value] > highest:
                    highest, at = float(best[value]), best[time].to_pydatetime()
        state.update((n, highest, at))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "highest": [highest], "at": [at]})

    return df.groupBy(key).applyInPandasWithState(update, shape, "n bigint, highest double, at timestamp", "update", GroupStateTimeout.NoTimeout)


def write_parts(df: DataFrame, path: str, by: Sequence[str], checkpoint: str, build: Callable[[DataFrame], DataFrame] = lambda x: x):
    """The parts of each micro-batch replaced in a partitioned table; a batch that is done again writes the same. Ends when the input that is there has been taken."""

    def each(batch: DataFrame, _: int) -> None:
        write_partitions(build(batch), path, by)

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(df: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """What a stream of results by key gives over the input that is there, as a table of files below `folder`.

    Every micro-batch writes the keys it changed, under its own number, so a batch that is done again replaces its
    own files; the last value of a key counts. State is bounded by the stream's watermark, not by this.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    df.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    parts = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/parts/*")
    number = F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("bigint")
    rest = [c for c in df.columns if c not in keys]
    last = parts.withColumn("__b", number).groupBy(*keys).agg(F.max(F.struct("__b", *rest)).alias("__r"))
    return last.select(*(F.col(f"__r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns))


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """What a stream gives over the input that is there, as a table in memory: for replays and tests."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)

"""A count window over a stream of gradient entries, kept by sample index and not by arrival.

For each source the window holds the entries with the largest sample indices; an entry that comes late into a full
window and is smaller than all of it leaves at once. ``batch_window`` is the same over a table, and what the stream
has reached after any order of arrival, and after any restart, equals it.

A source's window is a map in the state store with an entry for each entry: a micro-batch writes those that come and deletes those that
leave, and reads the kept indices only when something has to leave. Windows are read from the store itself, as of
any micro-batch, so the stream gives out no more than counts.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators.attribution import dot_scores, normalised, top_k

OUTPUT = "source_id string, came long, seen long, held long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def batch_window(df: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy(F.desc("sample_index"))
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= size).drop("_k")


class CountWindow(StatefulProcessor):
    """State of a source: ``window`` (sample_index, number of arrival) -> value, and ``counts`` (seen, held)."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getMapState("window", "sample_index long, arrival long", "value double")
        self.counts = handle.getValueState("counts", "seen long, held long")

    def handleInputRows(self, key, rows, timerValues):
        seen, held = self.counts.get() if self.counts.exists() else (0, 0)
        new: dict[tuple[int, int], float] = {}
        before = seen
        for pdf in rows:
            new |= {(int(i), seen + k): float(v) for k, (i, v) in enumerate(zip(pdf.sample_index, pdf.value, strict=True))}
            seen += len(pdf)
            if len(new) > 2 * self.size:
                new = {k: new[k] for k in sorted(new)[-self.size :]}
        over = held + len(new) - self.size
        if over > 0:
            for k in sorted([*self.window.keys(), *new])[:over]:
                if k in new:
                    del new[k]
                else:
                    self.window.removeKey(k)
                    held -= 1
        for k, v in new.items():
            self.window.updateValue(k, (v,))
        held += len(new)
        self.counts.update((seen, held))
        yield pd.DataFrame({"source_id": [key[0]], "came": [seen - before], "seen": [seen], "held": [held]})

    def close(self) -> None:
        pass


def streaming_window(stream: DataFrame, size: int) -> DataFrame:
    """(source_id, came, seen, held) for each source and micro-batch that touched it: entries of the batch, of the stream so far, and of the window.

    ``stream`` has (source_id, sample_index, value). State is at most ``size`` entries for each source.
    """
    return stream.select("source_id", "sample_index", "value").groupBy("source_id").transformWithStateInPandas(CountWindow(size), OUTPUT, "update", "none")


def read_entries(spark, path: str, schema: str, files: int = 2, flush_bytes: int | None = None) -> DataFrame:
    """A stream of a folder's Parquet files; a micro-batch ends after so many files, or at a budget of bytes."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxBytesPerTrigger", flush_bytes) if flush_bytes else reader.option("maxFilesPerTrigger", files)).parquet(path)


def run_to_table(windowed: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, interval: str | None = None):
    """Write each micro-batch's counts to its own folder of a table, so that one that is run again replaces what it wrote: what is available now, or for
    ever with one micro-batch in each ``interval``. The checkpoint resumes either."""
    spark = windowed.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if each:
            each(batch, number)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # the query keeps the settings that it starts with
    try:
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return windowed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(write).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def windows(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(source_id, sample_index, value) of all windows, read from the state store as of a micro-batch (the last one: None)."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "window")
    rows = (reader if batch is None else reader.option("batchId", batch)).load()
    return rows.select(F.col("key.source_id").alias("source_id"), F.col("user_map_key.sample_index").alias("sample_index"), F.col("user_map_value.value").alias("value"))


def window_stats(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, seen, held): entries that each source's state has counted and those it holds, from the table of counts."""
    last = spark.read.parquet(path).groupBy("source_id").agg(F.max_by(F.struct("seen", "held"), "batch").alias("w"))
    return last.select("source_id", "w.seen", "w.held")


def due_batches(spark: SparkSession, path: str, every: int) -> list[tuple[int, int]]:
    """(micro-batch, entries) where a stream's entries have passed another multiple of ``every``: one row for each micro-batch is looked at."""
    per = spark.read.parquet(path).groupBy("batch").agg(F.sum("came").alias("n")).orderBy("batch").collect()
    total, out = 0, []
    for r in per:
        if (total + r.n) // every > total // every:
            out.append((int(r.batch), total + r.n))
        total += r.n
    return out


def write_checkpoints(spark: SparkSession, path: str, checkpoint: str, every: int, to: str) -> list[int]:
    """A copy of all windows after each micro-batch that passes another ``every`` entries, under ``to``/entries=n; those already there stay. Gives
    the n that are new."""
    made = []
    for batch, n in due_batches(spark, path, every):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{to}/entries={n}/_SUCCESS")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            windows(spark, checkpoint, batch).write.mode("overwrite").parquet(f"{to}/entries={n}")
            made.append(n)
    return made


class StreamingContext:
    """Windows of one stream of entries in a folder: run what has come, ask for windows, counts, checkpoints and attribution, and go on after a restart."""

    def __init__(self, spark: SparkSession, source: str, folder: str, size: int, checkpoint_every: int | None = None, files: int = 2, flush_bytes: int | None = None):
        self.spark, self.source, self.folder, self.size = spark, source, folder.rstrip("/"), size
        self.every, self.files, self.flush_bytes = checkpoint_every, files, flush_bytes

    def run(self, schema: str = "source_id string, sample_index long, value double", shape: Callable[[DataFrame], DataFrame] | None = None) -> StreamingContext:
        """Take all entries that are there; with ``checkpoint_every`` their checkpoints are written."""
        stream = read_entries(self.spark, self.source, schema, self.files, self.flush_bytes)
        stream = shape(stream) if shape else stream
        run_to_table(streaming_window(stream, self.size), f"{self.folder}/counts", f"{self.folder}/state").awaitTermination()
        if self.every:
            write_checkpoints(self.spark, f"{self.folder}/counts", f"{self.folder}/state", self.every, f"{self.folder}/checkpoints")
        return self

    def windows(self, batch: int | None = None) -> DataFrame:
        return windows(self.spark, f"{self.folder}/state", batch)

    def stats(self) -> DataFrame:
        return window_stats(self.spark, f"{self.folder}/counts")

    def checkpoints(self) -> DataFrame:
        """(source_id, sample_index, value, entries)."""
        return self.spark.read.parquet(f"{self.folder}/checkpoints")

    def attribute(self, gradients: DataFrame, queries: DataFrame, k: int, most_harmful: bool = False) -> DataFrame:
        return attribute_window(self.windows(), gradients, queries, k, most_harmful)


def attribute_window(held: DataFrame, gradients: DataFrame, queries: DataFrame, k: int, most_harmful: bool = False) -> DataFrame:
    """(query_id, rank, sample_index, source_id, score): top-k of the samples that windows hold (see ``windows``),
    with scores normalised among these alone."""
    own = held.select("source_id", "sample_index").join(gradients.select("sample_index", "vec"), "sample_index")
    return top_k(normalised(dot_scores(own, queries)), k, most_harmful)


def event_windows(stream: DataFrame, time: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """An extension: tumbling event-time sums by source with a watermark for late rows."""
    w = F.window(time, length)
    return stream.withWatermark(time, late).groupBy(w, "source_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "source_id", "n", "total")

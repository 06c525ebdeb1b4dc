"""Streaming twins of the conversation jobs. Stateless work stays in expressions; state per key is small and bounded."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from palisade.dims.phrases import CYCLE
from palisade.sources.planted import phrase_bank, sent_ms
from palisade.session import shared_folder
from palisade.streaming.processors import Context, Outbound, Quarantine

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES_PER_BATCH = 8  # a backlog is worked off in batches of so many files


def _files(spark: SparkSession, folder: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, place


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that a stream needed only while it ran."""
    fs, place = _files(spark, folder)
    fs.delete(place, True)


def stream_table(spark: SparkSession, folder: str, name: str, order: Column) -> DataFrame:
    """A table as a stream: one file, or a folder of part files, which is replayed in the order of event time (`order`)."""
    path = f"{folder}/{name}.parquet"
    rows = spark.read.parquet(path)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_PER_BATCH)
    fs, place = _files(spark, path)
    if not fs.getFileStatus(place).isDirectory():
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return source.parquet(time_ranged(rows, order))


def closed_stream(spark: SparkSession, folder: str, name: str, clock: str) -> DataFrame:
    """A whole table as a stream in the order of `clock` (a time stamp), with a last row a day later that has nothing but its time.

    The last row moves the watermark over all others, so windows that are open at the end of the backlog are closed as well.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    end = rows.agg((F.max(clock) + F.expr("INTERVAL 1 DAY")).alias(clock))
    mark = end.select(*[F.col(clock).cast(f.dataType).alias(clock) if f.name == clock else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    path = time_ranged(rows, F.col(clock), mark)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)


def time_ranged(rows: DataFrame, order: Column, last: DataFrame | None = None) -> str:
    """Folder with the rows in files of ascending ranges of `order`, which a file stream reads in this sequence, and the rows of `last` after them.

    No row comes later than one of a batch before, so none is late for a watermark and carried state sees the turns in order; a long
    conversation reaches its stateful step in as many parts as it has ranges.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    rows.repartitionByRange(max(1, rows.rdd.getNumPartitions()), order).write.parquet(folder)
    fs, place = _files(spark, folder)
    listed = lambda: {f.getPath().getName(): f for f in fs.listStatus(place) if f.getPath().getName().startswith("part-")}
    parts = listed()
    names = sorted(parts)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(folder)
        parts = listed()
        names += sorted(set(parts) - set(names))
    start = min(f.getModificationTime() for f in parts.values())
    for i, name in enumerate(names):  # a file stream goes by modification time
        fs.setTimes(parts[name].getPath(), start + 1000 * i, -1)
    return folder


def stream_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return stream_table(spark, folder, "conversations", sent_ms())


def stream_messages(spark: SparkSession, folder: str) -> DataFrame:
    conv = stream_conversations(spark, folder).filter(F.col("role").isin("user", "assistant"))
    base = conv.select(
        "conv_id", "turn", sent_ms().alias("ts_ms"),
        F.when(F.col("role") == "user", "outbound").otherwise("inbound").alias("direction"), F.col("text").alias("raw"),
        ((F.col("conv_id") * 7 + F.col("turn")) % CYCLE).cast("int").alias("k"),
    )
    j = base.join(F.broadcast(phrase_bank(spark)), "k", "left")
    text = F.when(F.col("phrase").isNull(), F.col("raw")).when(F.col("conv_id") % 2 == 0, F.col("phrase")).otherwise(F.concat("raw", F.lit(". "), "phrase"))
    return j.select("conv_id", "turn", "ts_ms", "direction", text.alias("text"), F.timestamp_millis("ts_ms").alias("ts"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now into a fresh folder under the checkpoint folder and read it back.

    State lives in the embedded key-value store, whose maps and lists are on disk. The query's own folder (offsets, state) goes when it has ended.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = (
            stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    remove(spark, f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _stateful(rows: DataFrame, processor: StatefulProcessor) -> DataFrame:
    return rows.withWatermark("ts", "15 minutes").groupBy("conv_id").transformWithStateInPandas(processor, processor.OUT, "append", "eventtime")


def with_stream_context(flagged: DataFrame) -> DataFrame:
    """flagged: conv_id, turn, ts_ms, ts, direction, clusters (joined text), payout. Every message with its inbound context; see `Context`."""
    return _stateful(flagged, Context())


def with_stream_memory(assets: DataFrame) -> DataFrame:
    """assets: conv_id, turn, ts_ms, ts, session, cards, cvv, lone, expiry, otp, gps, sab, item_id. Adds what was sent before; see `Outbound`."""
    return _stateful(assets, Outbound())


def quarantine(verdicts: DataFrame) -> DataFrame:
    """verdicts: conv_id, turn, ts_ms, ts, is_scam, confidence; see `Quarantine`."""
    return _stateful(verdicts, Quarantine())


def tainted(lures: DataFrame, forms: DataFrame) -> DataFrame:
    """Interval join of two streams: a form event within 15 minutes after a lure of its user (a minute of skew)."""
    l = lures.withWatermark("lure_ts", "15 minutes")
    f = forms.withWatermark("form_ts", "15 minutes")
    return f.join(
        l,
        F.expr("form_user = lure_user AND form_ts >= lure_ts - INTERVAL 60 SECONDS AND form_ts <= lure_ts + INTERVAL 15 MINUTES"),
    )


def latest_lure(pairs: DataFrame) -> DataFrame:
    """Of the lures within reach of a form event the latest one stands, as a later context replaces the earlier."""
    best = pairs.groupBy("form_user", "form_ts", "form_id").agg(F.max(F.struct("lure_ts", "lure_id")).alias("l"))
    return best.select("form_user", "form_ts", "form_id", F.col("form_user").alias("lure_user"), "l.lure_ts", "l.lure_id")


def dedup(messages: DataFrame) -> DataFrame:
    long_enough = messages.filter((F.col("direction") == "inbound") & (F.length("text") >= 5))
    return long_enough.withWatermark("ts", "15 minutes").dropDuplicatesWithinWatermark(["conv_id", "text"])


WINDOWS = {
    "tumbling": lambda: F.window("ts", "5 minutes"),
    "sliding": lambda: F.window("ts", "15 minutes", "5 minutes"),
    "session": lambda: F.session_window("ts", "15 minutes"),
}


def detection_counts(verdicts: DataFrame, window: str) -> DataFrame:
    """Detections per host and kind in windows of event time; a window is given out once, when the watermark has passed it.

    The last row of a `closed_stream` comes out as a window without host: a filter here would be pushed below the watermark and take that row away.
    """
    counted = verdicts.withWatermark("ts", "15 minutes").groupBy(WINDOWS[window]().alias("w"), "host", "kind").agg(F.count("*").alias("n"))
    return counted.select(F.lit(window).alias("window"), F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "host", "kind", "n")

"""Incremental state as Structured Streaming: upserts, gap rollups, approvals, windows, sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def idempotent(stream: DataFrame, key: str, ts: str, late: str = "7 days") -> DataFrame:
    """The first arrival of each id; retries within the watermark change nothing, and state older than it goes."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, ts: str, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling windows by key; late rows within the watermark still count."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def session_counts(stream: DataFrame, ts: str, by: str, gap: str = "90 minutes", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def gaps(stream: DataFrame) -> DataFrame:
    """(gap_key, asks, question, last_asked), complete mode: the flag where there is one, else the wording."""
    gap = F.coalesce(F.col("unanswered"), T.is_refusal(F.col("answer")), F.lit(False))
    keyed = stream.filter(gap).withColumn("gap_key", T.gap_key(F.col("question")))
    return keyed.groupBy("gap_key").agg(F.count("*").alias("asks"), F.max_by("question", F.struct("asked_at", "id")).alias("question"), F.max("asked_at").alias("last_asked"))


def approvals(stream: DataFrame) -> DataFrame:
    """(id, status, approved_seq) updates from (seq, id, status): the first approval's number stays, whenever it arrives.

    The state is one row per id; an approval again changes nothing, a rejection keeps the row.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    from gristmill.functions.workers import importable

    importable(stream.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, status, approved = state.get if state.exists else (-1, None, None)
        for b in batches:
            for s, st in sorted(zip(b["seq"].tolist(), b["status"].tolist(), strict=True)):
                if st == "approved":
                    approved = s if approved is None else min(approved, s)
                if s > seq:
                    seq, status = s, st
        state.update((seq, status, approved))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "approved_seq": pd.array([approved], "Int64")})

    return stream.groupBy("id").applyInPandasWithState(step, "id long, status string, approved_seq long", "seq long, status string, approved_seq long", "update", GroupStateTimeout.NoTimeout)


def append_numbered(target: str, *order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that numbers rows on from the highest number written; a batch that is replayed is written once."""
    from gristmill.operators.gaps import assign_sequence

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.parquet(target)
            if not seen.filter(F.col("batch") == batch_id).isEmpty():
                return
            start = seen.agg(F.max("seq")).first()[0] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            start = 0
        assign_sequence(batch, start, *order).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(target)

    return write


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Runs what is there and stops. With ``sink`` every micro-batch goes through it."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    q = w.foreachBatch(sink).start() if sink else w.format("parquet").start(target)
    q.awaitTermination()


def snapshot(target: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for complete mode: the whole result replaces the last one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return write

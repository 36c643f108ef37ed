"""Deliveries that count only once they are acknowledged, and answers that are stored only where they succeeded."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 500


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


class Outbox:
    """What has been acknowledged, as a log (batch, id) under ``path``. A row's flag is its id's place in that log; nothing else sets it."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", kind: str = "long") -> None:
        self.spark, self.path, self.key, self.schema = spark, path, key, f"batch string, {key} {kind}"

    def acknowledged(self) -> DataFrame:
        return _read(self.spark, self.path, self.schema)

    def pending(self, rows: DataFrame, limit: int | None = LIMIT) -> DataFrame:
        """Rows without an acknowledgement, oldest first, ``limit`` at most: what one request may carry."""
        left = rows.join(self.acknowledged().select(self.key).distinct(), self.key, "left_anti")
        return left.orderBy(self.key).limit(limit) if limit else left

    def marked(self, rows: DataFrame) -> DataFrame:
        """``rows`` with uploaded."""
        done = self.acknowledged().select(self.key).distinct().withColumn("uploaded", F.lit(True))
        return rows.join(done, self.key, "left").withColumn("uploaded", F.coalesce("uploaded", F.lit(False)))

    def deliver(self, batch: DataFrame, name: str, send: Callable[[DataFrame], DataFrame | None]) -> None:
        """Sends a batch and writes down what was acknowledged: the ids that ``send`` returns, or all if it returns None. It raises if nothing was.

        A batch that the log has isn't sent again. One that was sent and then not written down - the run failed in between - is sent
        again whole: a receiver tells it by its ids (``store_once``).
        """
        if not self.acknowledged().filter(F.col("batch") == name).isEmpty():
            return
        accepted = send(batch)
        ids = (batch if accepted is None else accepted).select(F.lit(name).alias("batch"), self.key)
        ids.write.mode("append").parquet(self.path)

    def sink(self, send: Callable[[DataFrame], DataFrame | None]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch sink: each micro-batch without the rows acknowledged before, under its number."""

        def write(batch: DataFrame, batch_id: int) -> None:
            own = batch.join(self.acknowledged().filter(F.col("batch") != f"s{batch_id}").select(self.key).distinct(), self.key, "left_anti")
            self.deliver(own, f"s{batch_id}", send)

        return write


def store_once(spark: SparkSession, path: str, schema: str, key: str) -> Callable[[DataFrame], DataFrame]:
    """A receiver: stores rows whose id it lacks, the first of each, and acknowledges all of them."""

    def send(batch: DataFrame) -> DataFrame:
        have = _read(spark, path, schema).select(key)
        batch.dropDuplicates([key]).join(have, key, "left_anti").write.mode("append").parquet(path)
        return batch.select(key).distinct()

    return send


class AnswerCache:
    """Answers by the fingerprint of what was asked, (fingerprint, payload, model), in generations under ``path``; failures are never stored."""

    _SCHEMA = "fingerprint string, payload string, model string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _generation(self) -> int:
        made = _read(self.spark, f"{self.path}/current", "generation long")
        return made.agg(F.max("generation")).first()[0] or 0

    def stored(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/g{self._generation()}", self._SCHEMA)

    def answered(self, jobs: DataFrame, ask: Callable[[DataFrame], DataFrame], model: str) -> DataFrame:
        """(job_id, fingerprint, payload, source) of every job (job_id, fingerprint, prompt): ``stored``, ``fresh`` or ``failed``.

        Only different fingerprints without a stored answer are asked: ``ask`` gives (fingerprint, payload), null or absent where it failed.
        What succeeded is appended before anything is returned; what failed stays unknown and is asked again by the next run.
        """
        have = self.stored().select("fingerprint", "payload").dropDuplicates(["fingerprint"])
        misses = jobs.join(have.select("fingerprint"), "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min("prompt").alias("prompt"))
        path = f"{self.path}/fresh/{uuid.uuid4().hex}"
        ask(misses).filter("payload is not null").select("fingerprint", "payload", F.lit(model).alias("model")).write.parquet(path)
        fresh = self.spark.read.schema(self._SCHEMA).parquet(path)
        old = jobs.join(have.withColumn("source", F.lit("stored")), "fingerprint")
        fresh.write.mode("append").parquet(f"{self.path}/g{self._generation()}")
        new = jobs.join(misses.select("fingerprint"), "fingerprint").join(fresh.dropDuplicates(["fingerprint"]).select("fingerprint", "payload"), "fingerprint", "left")
        new = new.withColumn("source", F.when(F.col("payload").isNull(), "failed").otherwise("fresh"))
        return old.select("job_id", "fingerprint", "payload", "source").unionByName(new.select("job_id", "fingerprint", "payload", "source"))

    def compact(self) -> int:
        """One row for each fingerprint, in a few files, as the next generation; readers change over when its number is written."""
        now = self._generation() + 1
        one = self.stored().groupBy("fingerprint").agg(F.min(F.struct("payload", "model")).alias("r")).select("fingerprint", "r.*")
        one.write.mode("overwrite").parquet(f"{self.path}/g{now}")
        self.spark.createDataFrame([(now,)], "generation long").coalesce(1).write.mode("append").parquet(f"{self.path}/current")
        return now

"""Tables of Parquet files that can be merged into: copy on write by buckets of the key, committed by a manifest.

A version is a list of folders, one for each bucket. A merge reads the buckets that its changes fall into, writes them anew beside the old
ones, and then appends one file to the manifest that names the new folders and carries the others on. That one file is the commit: until it
is there, readers see the version before, and what a failed run has written is in no version. A batch whose name the manifest has is not
merged again, so a run can be repeated. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
_MANIFEST = "version long, bucket int, folder string, batch string"


def _missing(e: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(e)


class MergedTable:
    """``path`` holds data/ and manifest/; ``schema`` is the table's DDL, ``key`` the columns that tell its rows apart."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema)

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except Exception as e:
            if not _missing(e):
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def version(self) -> int:
        """The last version that was committed; 0 before the first."""
        return self.manifest().agg(F.max("version")).first()[0] or 0

    def _folders(self, version: int) -> dict[int, str]:
        return {r["bucket"]: r["folder"] for r in self.manifest().filter((F.col("version") == version) & F.col("bucket").isNotNull()).collect()}  # one for each bucket

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the last one if none is named."""
        folders = sorted(set(self._folders(self.version() if version is None else version).values()))
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def merge(self, changes: DataFrame, how: str, batch: str, order: list[str] | None = None, add: list[str] | None = None) -> int:
        """Merges ``changes`` (the table's columns, rows of one key allowed) and gives the version it made, or the last one if ``batch`` is in already.

        how: ``replace`` - the change takes the row's place, the last by ``order`` where there are several; ``ignore`` - a row that is there stays,
        else the first by ``order``; ``add`` - columns of ``add`` are summed onto the row, its others stay, of a new one the first by ``order``.
        """
        if how not in ("replace", "ignore", "add"):
            raise ValueError(how)
        known = self.manifest()
        if not known.filter(F.col("batch") == batch).isEmpty():
            return self.version()
        columns = [f.name for f in self.schema]
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        new = changes.withColumn("_b", bucket)
        touched = [r["_b"] for r in new.select("_b").distinct().collect()]
        now = self.version()
        folders = self._folders(now)
        merged = self._combined(new.select(*columns, "_b", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order or [])]), [f for b, f in folders.items() if b in touched], how, len(order or []), add or [])
        target = f"{self.path}/data/{uuid.uuid4().hex}"
        if touched:
            merged.withColumn("_b", bucket).repartition("_b").write.partitionBy("_b").parquet(target)
        entries = [(now + 1, b, f"{target}/_b={b}" if b in touched else folders[b], batch) for b in sorted(set(folders) | set(touched))]
        entries = entries or [(now + 1, None, None, batch)]
        self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")  # one file: it is there or it isn't
        return now + 1

    def _combined(self, new: DataFrame, old: list[str], how: str, order: int, add: list[str]) -> DataFrame:
        key, columns = self.key, [f.name for f in self.schema]
        others = [c for c in columns if c not in key and c not in add]
        before = (self.spark.read.schema(self.schema).parquet(*old) if old else self.spark.createDataFrame([], self.schema)).withColumn("_new", F.lit(0))
        rank = F.struct(F.col("_new"), *[F.col(f"_o{i}") for i in range(order)])
        both = before.unionByName(new.withColumn("_new", F.lit(1)).drop("_b"), allowMissingColumns=True)
        pick = F.max_by if how == "replace" else F.min_by
        sums = [F.sum(c).cast(self.schema[c].dataType).alias(c) for c in add]
        one = [pick(F.struct(*others), rank).alias("_one")] if others else []
        if not sums and not one:
            return both.select(*key).distinct()
        out = both.groupBy(*key).agg(*one, *sums)
        if one:
            out = out.select(*key, *[F.col(f"_one.`{c}`").alias(c) for c in others], *add)
        return out.select(*columns)

    def unused(self, keep: int = 1) -> list[str]:
        """Folders that only versions before the last ``keep`` name: they can go."""
        m, now = self.manifest().filter("folder is not null"), self.version()
        live = m.filter(F.col("version") > now - keep).select("folder").distinct()
        return [r["folder"] for r in m.select("folder").distinct().join(live, "folder", "left_anti").collect()]

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from gristmill.functions.shared import shared_dir
from gristmill.functions.workers import importable

#: ASCII white space, fixed by the word contract ``[^\x20\x09-\x0D]+``.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows of one call of an operator's function, so that long texts don't fill a Python worker.
ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

__all__ = ["LOWER", "ROWS", "SPACE", "UPPER", "WORD", "ascii_lower", "chosen_rows", "importable", "map_texts", "materialise", "rows_with_ids", "shared_dir", "union_all", "word_count"]


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before), ROWS)))  # of this write alone
    try:
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(rows: DataFrame, added: str, start: Callable, text: str = "text") -> DataFrame:
    """``rows`` without the column ``text`` and with the columns ``added``; the other columns pass through as Arrow has them, nulls and all.

    ``start()`` runs once in each task and gives a function of (texts, batch) to lists by column name, or a pair of it and a
    function whose dicts become further rows at the task's end, null in all other columns.
    """
    spark = rows.sparkSession
    importable(spark)
    new = StructType.fromDDL(added)
    others = [f for f in rows.schema.fields if f.name != text]
    kinds = {f.name: to_arrow_schema(StructType([f])).field(0).type for f in [*others, *new.fields]}
    out = pa.schema(list(kinds.items()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = start()
        work, end = made if isinstance(made, tuple) else (made, None)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                got = work(b.column(text).to_pylist(), b)
                yield pa.RecordBatch.from_arrays([*[b.column(f.name).cast(kinds[f.name]) for f in others], *[pa.array(got[f.name], kinds[f.name]) for f in new.fields]], schema=out)
        for got in end() if end else ():
            n = len(got[new.fields[0].name])
            yield pa.RecordBatch.from_arrays([*[pa.nulls(n, kinds[f.name]) for f in others], *[pa.array(got[f.name], kinds[f.name]) for f in new.fields]], schema=out)
        del work, end, made
        release()

    return rows.mapInArrow(of, StructType([StructField(f.name, f.dataType, True) for f in (*others, *new.fields)]))


def release() -> None:
    """Gives a worker's free memory back at a task's end: workers stay for other operators, and idle ones share the executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _scans(docs: DataFrame) -> bool:
    """Whether each row is one row of a file: a scan, at most filtered and projected."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation"


def rows_with_ids(docs: DataFrame) -> DataFrame:
    """``docs`` as (_file, _place, _row): where each row stands in the Parquet files it is read from, and the row as a struct.

    The place is the same whatever is read beside it and whoever reads it, so decisions on rows can be taken on it alone. What
    doesn't come straight from files is written first.
    """
    names = [f"_{k}" for k in range(len(docs.columns))]  # a file can't hold clashing names
    if not _scans(docs):
        docs, own = materialise(docs.toDF(*names)), docs.columns
    else:
        names = own = docs.columns
    row = F.struct(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, own, strict=True)]).alias("_row")
    return docs.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"), row)


def chosen_rows(rows: DataFrame, times: DataFrame, limit: int = 1 << 25) -> DataFrame:
    """``rows`` of ``rows_with_ids`` as often as ``times`` (_file, _place, _times byte) says; rows it doesn't name go.

    Per file one array has each row's count. With ``limit`` rows or fewer in all files together - counted, a byte each - the
    arrays are broadcast and the rows themselves move nowhere; beyond that, rows and counts meet in a join by place.
    """
    times = materialise(times)
    last = times.groupBy("_file").agg((F.max("_place") + 1).alias("n"))
    if (last.agg(F.sum("n")).first()[0] or 0) <= limit:
        entry = F.map_from_entries(F.collect_list(F.struct((F.col("_place") % _SPAN).cast("int"), "_times")))
        spans = times.groupBy("_file", F.floor(F.col("_place") / _SPAN).alias("span")).agg(entry.alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("byte")))
        spans = spans.select("_file", "span", dense.alias("counts"))
        met = rows.withColumn("span", F.floor(F.col("_place") / _SPAN)).join(F.broadcast(spans), ["_file", "span"])
        out = met.withColumn("_times", F.get("counts", (F.col("_place") % _SPAN).cast("int"))).drop("counts", "span")
    else:
        out = rows.join(times, ["_file", "_place"])
    return out.filter("_times > 0")


_SPAN = 512


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. ``lower`` serves where it can't differ: a pure ASCII string."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

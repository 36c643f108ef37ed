"""Gates on a build: what tables exist, what they hold, how their vectors and retrieval behave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table, or none of its rows where it isn't there: builds older than the table still answer."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def floors(tables: dict[str, DataFrame | None], least: dict[str, int]) -> DataFrame:
    """(table, rows, floor, verdict) of every expected table: ok, below, or missing (no such table)."""
    spark = next(t for t in tables.values() if t is not None).sparkSession
    counts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items() if t is not None]
    want = spark.createDataFrame(list(least.items()), "table string, floor long")
    both = want.join(reduce(DataFrame.unionByName, counts), "table", "left")
    return both.withColumn("verdict", F.when(F.col("rows").isNull(), "missing").when(F.col("rows") < F.col("floor"), "below").otherwise("ok"))


def structural(tables: dict[str, DataFrame | None], present: tuple[str, ...], filled: tuple[str, ...]) -> DataFrame:
    """(table, complaint): tables that must be there and aren't, and those that must hold rows and don't."""
    found = floors(tables, dict.fromkeys((*present, *filled), 0) | dict.fromkeys(filled, 1))
    return found.filter("verdict <> 'ok'").select("table", F.when(F.col("verdict") == "missing", "absent").otherwise("empty").alias("complaint"))


def manifest(vectors: DataFrame) -> DataFrame:
    """One row per model of (model, embedding): how many vectors, their least and greatest length; ``sound`` if there is one model of one length."""
    per = vectors.groupBy("model").agg(F.count("*").alias("vectors"), F.min(F.size("embedding")).alias("shortest"), F.max(F.size("embedding")).alias("longest"))
    models = per.agg(F.count("*").alias("models"))  # one row
    return per.join(F.broadcast(models), F.lit(True)).withColumn("sound", (F.col("models") == 1) & (F.col("shortest") == F.col("longest"))).drop("models")


def coverage(rows: DataFrame, key: str, text: str, vectors: DataFrame) -> DataFrame:
    """One row: rows with a text, those with a vector, vectors of no such row. vectors: (key)."""
    wanted = rows.filter(F.trim(F.coalesce(text, F.lit(""))) != "").select(key, F.lit(True).alias("_w"))
    both = wanted.join(vectors.select(key, F.lit(True).alias("_v")).distinct(), key, "full")
    return both.agg(F.count("_w").alias("wanted"), F.count_if(F.col("_w").isNotNull() & F.col("_v").isNotNull()).alias("covered"), F.count_if(F.col("_w").isNull()).alias("stray"))


def hit_verdict(found: Column, must: Column, must_not: Column, expected_to_fail: Column) -> Column:
    """pass, miss or forbidden by substrings of the texts found; xfail and xpass where failure is expected."""
    has = lambda w: F.exists(found, lambda t: F.contains(F.lower(t), F.lower(w)))
    plain = F.when(F.exists(must, lambda w: ~has(w)), F.lit("miss")).when(F.exists(must_not, lambda w: has(w)), F.lit("forbidden")).otherwise(F.lit("pass"))
    return F.when(expected_to_fail, F.when(plain == "pass", F.lit("xpass")).otherwise(F.lit("xfail"))).otherwise(plain)


def goldens(rows: DataFrame, case: str, *ids: str) -> DataFrame:
    """(case, digest): a hash of each case's ids in order, to hold against the last accepted one."""
    listed = rows.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("/", *[F.col(i).cast("string") for i in ids]).alias("id")))).alias("l"))
    return listed.select(case, F.sha2(F.array_join(F.col("l.id"), ","), 256).alias("digest"))


def attempts(tries: DataFrame) -> DataFrame:
    """(id, tries, outcome) of (id, n, answer, ok): accepted by the first good answer, dropped if answers came and none was good, unreached if none came."""
    return tries.groupBy("id").agg(
        F.count("*").alias("tries"),
        F.when(F.max(F.coalesce("ok", F.lit(False))), "accepted").when(F.count("answer") > 0, "dropped").otherwise("unreached").alias("outcome"),
    )

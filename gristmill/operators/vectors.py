"""Vectors: norms, cosine, floored top-k, health."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.text import let
from gristmill.functions.workers import importable

SIMILARITY_FLOOR = 0.45
SEMANTIC_LIMIT = 2
#: Fixed list: topics that only an exact word reaches.
EXCLUDED_TOPICS = ("roster",)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def nearest(base: DataFrame, queries: DataFrame, k: int, floor: float = SIMILARITY_FLOOR, dim: int | None = None) -> DataFrame:
    """(qid, vec_id, similarity, rank): each query's k rows of highest cosine at ``floor`` or above, itself left out.

    Goes through a partitioned index (``vector_index``), which prunes and stays exact. Queries (qid, query [, model]). Where both sides
    name a model only vectors of the same one meet; vectors of another length than ``dim``, or than the queries' where that isn't
    given, or with values that aren't finite are skipped.
    """
    from gristmill.operators import vector_index

    return vector_index.build(base, dim).nearest(queries, k, floor)


def with_semantic(lexical: DataFrame, near: DataFrame, limit: int = SEMANTIC_LIMIT) -> DataFrame:
    """Lexical rows (qid, id, score) first, then up to ``limit`` near ones (qid, id, similarity) that aren't among them.

    Near rows of an excluded topic are kept out by ``outside_topics`` before they get here: formulaic rows lie close to any question.
    """
    fresh = near.join(lexical.select("qid", "id"), ["qid", "id"], "left_anti")
    fresh = fresh.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id"))).filter(F.col("r") <= limit)
    both = lexical.select("qid", "id", F.lit(0).alias("tier"), F.col("score").alias("weight")).unionByName(fresh.select("qid", "id", F.lit(1).alias("tier"), F.col("similarity").alias("weight")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("tier", F.desc("weight"), "id")))


def outside_topics(near: DataFrame, topics: DataFrame, excluded: tuple[str, ...] = EXCLUDED_TOPICS) -> DataFrame:
    """Near rows (qid, id, similarity) but those whose topic by ``topics`` (id, topic) is excluded; those that have no row there go, too."""
    return near.join(topics.filter(~F.coalesce("topic", F.lit("")).isin(*excluded)).select("id"), "id", "left_semi")


def health(vectors: DataFrame) -> DataFrame:
    """One row: vectors, different lengths, those not finite, those not of unit length."""
    return vectors.agg(
        F.count("*").alias("vectors"),
        F.countDistinct(F.size("embedding")).alias("lengths"),
        F.count_if(~finite(F.col("embedding"))).alias("not_finite"),
        F.count_if(F.abs(norm(F.col("embedding")) - 1) > 1e-3).alias("not_unit"),
    )


def pack(v: Column) -> Column:
    """A vector as little-endian 32-bit floats."""
    importable(SparkSession.active())

    @F.pandas_udf("binary")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return of(v)


def unpack(b: Column) -> Column:
    """The other way; null where the bytes are no whole floats."""
    importable(SparkSession.active())

    @F.pandas_udf("array<float>")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))

    return of(b)


def document_form(title: Column, text: Column) -> Column:
    """What an encoder is given for a row."""
    return F.concat(F.lit("title: "), F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("none")), F.lit(" | text: "), text)


def query_form(question: Column) -> Column:
    """What an encoder is given for a question."""
    return F.concat(F.lit("task: search result | query: "), question)


def embed(rows: DataFrame, key: str, form: Column, encode: Callable[[list[str]], list[list[float]]], dim: int) -> DataFrame:
    """(key, embedding) by an encoder of many texts at once, run on the workers; a vector of another length than ``dim`` stops the job."""
    importable(rows.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [list(map(float, v)) for v in encode(b["form"].tolist())]
            if any(len(v) != dim for v in got):
                raise ValueError(f"vectors of {sorted({len(v) for v in got})}, not {dim}")
            yield pd.DataFrame({key: b[key], "embedding": got})

    kept = rows.select(key, form.alias("form")).filter(F.trim("form") != "")
    return kept.mapInPandas(of, f"{key} {dict(kept.dtypes)[key]}, embedding array<float>")

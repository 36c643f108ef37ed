"""A partitioned vector index: exact nearest rows by cosine through cells, radii and the triangle inequality.

On unit vectors the distance is sqrt(2 - 2 cosine), so a floor on the cosine is a ball around the query. A cell keeps its centre and the
least and greatest distance of its rows from it. A query at distance d from the centre can only find rows between d - r and d + r from it;
a cell outside of that isn't visited, and in a cell whose rows are sorted by that distance only the slice in between is compared. The
query's own cell is searched first: with k rows found, the k-th best replaces the floor for all other cells. Nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.shared import written
from gristmill.functions.workers import importable

CELLS = 4096
CELL_ROWS = 512
PART_ROWS = 16_384
QUERIES = 10_000
DIGITS = 6
_SLACK = 1e-6


def _unit(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of unit length as float64; a zero vector stays."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=x.copy(), where=n > 0)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Between all rows of both, zero vectors included."""
    square = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def _sound(vectors: DataFrame, column: str, dim: int | None) -> DataFrame:
    finite = F.forall(column, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))  # NaN is above infinity
    return vectors.filter(finite & ((F.size(column) == dim) if dim else (F.size(column) > 0)))


@dataclass(frozen=True)
class VectorIndex:
    """rows (cell, part, far, vec_id, embedding [, model]) in the shared folder; centres and, by cell, radii and parts: at most ``CELLS`` of each."""

    rows: DataFrame
    centres: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray
    dim: int

    def visits(self, queries: DataFrame, reach: str, first: bool) -> DataFrame:
        """(qid, query, cell, part, reach ...) for the cells a query has to look into: its own one alone, or all others within reach."""
        centres, low, high, parts, dim = self.centres, self.low, self.high, self.parts, self.dim
        schema = pa.schema([("qid", pa.int64()), ("at", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("d", pa.float64())])

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                d = _distances(_unit(b.column("query"), dim), centres)
                own = d.argmin(1)
                r = b.column("reach").to_numpy(zero_copy_only=False)[:, None]
                wanted = (d - r <= high) & (d + r >= low)
                mine = np.zeros_like(wanted)
                mine[np.arange(len(own)), own] = True
                q, cell = np.nonzero(wanted & (mine if first else ~mine))
                n = parts[cell]
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q, cell = np.repeat(q, n), np.repeat(cell, n)
                yield pa.RecordBatch.from_arrays([b.column("qid").take(pa.array(q)), pa.array(q.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(d[q, cell])], schema=schema)

        asked = queries.withColumn("reach", F.col(reach)).select("qid", "query", "reach")
        found = asked.mapInArrow(of, "qid long, at int, cell int, part int, d double")
        return found.drop("at").join(queries, "qid")

    def compared(self, visits: DataFrame, k: int, floor: float) -> DataFrame:
        """(qid, vec_id, similarity) of up to k rows of each visit, and a row without vec_id that has the number of rows compared."""
        dim, keys = self.dim, ["cell", "part", *[c for c in ("model",) if c in self.rows.columns and c in visits.columns]]
        schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64()), ("compared", pa.int64())])

        def of(rows: pa.Table, asks: pa.Table) -> pa.Table:
            if not rows.num_rows or not asks.num_rows:
                return schema.empty_table()
            rows = rows.sort_by("far")
            far, ids, x = rows.column("far").to_numpy(), rows.column("vec_id").to_numpy(), _unit(rows.column("embedding"), dim)
            q, d, reach, qid = _unit(asks.column("query"), dim), asks.column("d").to_numpy(), asks.column("reach").to_numpy(), asks.column("qid").to_numpy()
            begin, end = np.searchsorted(far, d - reach, "left"), np.searchsorted(far, d + reach, "right")
            out = []
            for i in range(len(qid)):
                s = np.round(x[begin[i] : end[i]] @ q[i], DIGITS)
                own = ids[begin[i] : end[i]]
                good = np.flatnonzero((s >= floor) & (own != qid[i]))
                best = good[np.lexsort((own[good], -s[good]))][:k]
                out.append(pa.table([np.full(len(best), qid[i]), own[best], s[best], pa.nulls(len(best), pa.int64())], schema=schema))
                out.append(pa.table([[qid[i]], pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), [end[i] - begin[i]]], schema=schema))
            return pa.concat_tables(out)

        return self.rows.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(of, "qid long, vec_id long, similarity double, compared long")

    def search(self, queries: DataFrame, k: int, floor: float) -> DataFrame:
        """What ``compared`` gives for all cells that hold anything for queries (qid, query [, model]) of different qids, in the shared folder."""
        importable(self.rows.sparkSession)
        asked = _sound(queries.filter("qid is not null").withColumn("qid", F.col("qid").cast("long")), "query", self.dim)
        n = asked.count()
        blocks = max(1, -(-n // QUERIES))
        out = []
        for b in range(blocks):
            some = asked.filter(F.pmod(F.hash("qid"), F.lit(blocks)) == b) if blocks > 1 else asked
            some = written(some.withColumn("reach", F.lit(float(np.sqrt(max(0.0, 2 - 2 * (floor - _SLACK)))))))
            if not len(self.centres):
                continue
            near = written(self.compared(self.visits(some, "reach", True), k, floor))
            kth = near.filter("vec_id is not null").groupBy("qid").agg(F.sort_array(F.collect_list("similarity"), False).alias("s"))
            least = F.get("s", F.lit(k - 1))
            closer = some.join(kth.filter(least.isNotNull()).select("qid", F.sqrt(F.greatest(2 - 2 * (least - _SLACK), F.lit(0.0))).alias("closer")), "qid", "left")
            closer = closer.withColumn("reach", F.coalesce(F.least("reach", "closer"), "reach")).drop("closer")
            out += [near, written(self.compared(self.visits(closer, "reach", False), k, floor))]
        return _union(out) if out else self.rows.sparkSession.createDataFrame([], "qid long, vec_id long, similarity double, compared long")

    def nearest(self, queries: DataFrame, k: int, floor: float) -> DataFrame:
        """(qid, vec_id, similarity, rank): the k rows of highest cosine at ``floor`` or above, ties to the smaller vec_id."""
        w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "vec_id")
        found = self.search(queries, k, floor).filter("vec_id is not null")
        return found.select("qid", "vec_id", "similarity", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)

    def work(self, queries: DataFrame, k: int, floor: float) -> DataFrame:
        """(qid, compared): the rows each query was compared with."""
        return self.search(queries, k, floor).groupBy("qid").agg(F.sum("compared").alias("compared"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def build(base: DataFrame, dim: int | None = None, cells: int | None = None) -> VectorIndex:
    """An index of ``base`` (vec_id long, embedding [, model]). Centres are the vectors with the smallest hashes of their ids: one for each
    ``CELL_ROWS`` rows, ``CELLS`` at most. Every row is indexed; rows of another length, or not finite, are skipped."""
    spark = base.sparkSession
    importable(spark)
    base = base.filter("vec_id is not null").withColumn("vec_id", F.col("vec_id").cast("long"))
    sound = _sound(base, "embedding", dim)
    n = base.count()
    wanted = cells or min(CELLS, max(1, -(-n // CELL_ROWS)))
    picked = sound.select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(wanted).collect()
    dim = dim or (len(picked[0]["embedding"]) if picked else 1)
    centres = _unit(pa.array([list(map(float, r["embedding"])) for r in picked if len(r["embedding"]) == dim], pa.list_(pa.float64())), dim) if picked else np.zeros((0, dim))
    keep = [c for c in ("vec_id", "embedding", "model") if c in base.columns]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(_unit(b.column("embedding"), dim), centres)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], [*keep, "cell", "far"])

    schema = ", ".join(f"{c} {t}" for c, t in base.select(*keep).dtypes)
    rows = sound.select(*keep).filter(F.size("embedding") == dim)
    rows = written(rows.mapInArrow(of, f"{schema}, cell int, far double")) if len(centres) else written(rows.withColumn("cell", F.lit(0)).withColumn("far", F.lit(0.0)).limit(0))
    about = {r["cell"]: r for r in rows.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).collect()}
    at = lambda c, none: np.array([about[k][c] if k in about else none for k in range(len(centres))], float)
    parts = np.maximum(1, -(-at("n", 0).astype(np.int64) // PART_ROWS))
    many = F.get(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell")) if len(parts) and parts.max() > 1 else F.lit(1)
    return VectorIndex(rows.withColumn("part", F.pmod(F.hash("vec_id"), many).cast("int")), centres, at("low", np.inf), at("high", -np.inf), parts, dim)

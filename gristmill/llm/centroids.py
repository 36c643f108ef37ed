"""Centroid clustering of integer vectors by exact arithmetic (Lloyd's rounds).

A block of vectors meets all centroids in one float64 matrix product: |x|^2 - 2 x.c + |c|^2. Components are integers, so
every term is one, and the product is exact as long as none can pass 2^53: ``dims * (max |x| + max |c|)^2`` bounds them all.
Vectors or centroids whose magnitudes exceed that bound are compared in integers instead: in 64 bits while the same bound
stays below 2^63, in Python's own beyond.

* ``kept``: rows whose vector has ``dims`` components, none null or non-finite.
* ``first_centroids``: the vectors with the smallest hashes of seed and id.
* ``sums``: each task adds its vectors up by nearest centroid, exactly; ``treeAggregate`` adds the tasks' sums. What reaches
  the driver is one vector and two numbers for each centroid, whatever the input's size.
* ``assign``: cluster and squared distance of every row; nothing is shuffled.

Defined results: ties go to the smaller centroid; a null id is hashed last, repeated ids are told apart by their vectors,
and equal rows stay separate rows; with fewer vectors than centroids there are fewer centroids, an empty table gives an empty
result; an empty centroid stays where it is; a distance or sum of distances that no long can hold is null (the choice of
the cluster is exact all the same); other columns of the table, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ROWS, importable, release

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
EXACT_FLOAT, EXACT_LONG = 1 << 53, 1 << 63

Centroids = list[list[int]]


def kept(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, x) of the rows whose x, an array of numbers, has ``dims`` components, none null or non-finite, before and after scaling."""
    finite = lambda v: v.isNotNull() & (F.abs(v.cast("double") * scale) < float("inf"))  # noqa: E731  # NaN is above infinity
    return vectors.filter((F.size("x") == dims) & F.forall("x", finite))


def quantised(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x) as float64. The product is exact for a scale that is a power of two."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).reshape(-1, dims)


def first_centroids(rows: DataFrame, clusters: int, scale: int, seed: int) -> Centroids:
    """The ``clusters`` vectors with the smallest sha256 of "seed:id", in that order. Ids that repeat are ordered by their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    least = rows.select(key.isNull().alias("n"), key.alias("key"), F.col("x").cast("array<double>").alias("x")).orderBy("n", "key", "x").limit(clusters)
    return [[int(v) for v in np.floor(np.array(r["x"], np.float64) * scale)] for r in least.collect()]


def _integers(x: np.ndarray, kind: type) -> np.ndarray:
    return x.astype(np.int64) if kind is np.int64 else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def _expanded(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """|x|^2 - 2 x.c + |c|^2 for every row of x and c."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance (exact integers) of each row's nearest centroid. x: integers as float64."""
    n, dims = x.shape
    size_x = np.abs(x).max(1, initial=0)
    size_c = np.array([float(max(map(abs, c))) for c in centroids])  # above 2^53 only its order of magnitude counts
    low_c = size_c <= np.sqrt(EXACT_FLOAT / dims) / 2
    limit = np.sqrt((EXACT_FLOAT - 1) / dims) - size_c[low_c].max(initial=0)
    low_x = size_x < np.floor(limit)
    if low_c.all() and low_x.all():
        d = _expanded(x, np.array(centroids, np.float64)).astype(np.int64)
        at = d.argmin(1)
        return at, d[np.arange(n), at]
    top = float(size_x.max(initial=0)) + float(size_c.max())
    kind = np.int64 if dims * (top + 1) ** 2 < EXACT_LONG / 2 else object
    d = np.empty((n, len(centroids)), kind)
    if low_x.any() and low_c.any():
        d[np.ix_(low_x, low_c)] = _expanded(x[low_x], np.array([c for c, low in zip(centroids, low_c, strict=True) if low], np.float64)).astype(np.int64).astype(kind)
    whole = _integers(x, kind)
    for rows, columns in ((~low_x, np.ones(len(centroids), bool)), (low_x, ~low_c)):
        if rows.any() and columns.any():
            c = np.array([c for c, chosen in zip(centroids, columns, strict=True) if chosen], kind)
            d[np.ix_(rows, columns)] = _expanded(whole[rows], c)
    at = d.argmin(1)
    return at, d[np.arange(n), at]


def _add(x: np.ndarray, at: np.ndarray, d: np.ndarray, total: list[list[int]]) -> None:
    """Adds a block's vectors, counts and distances to ``total``: for each centroid its components' sums, count and distances' sum."""
    hot = np.zeros((len(total), len(x)))
    hot[at, np.arange(len(x))] = 1
    if len(x) * (np.abs(x).max(initial=0) + 1) < EXACT_FLOAT:
        sums = (hot @ x).astype(np.int64).tolist()
    else:
        whole = _integers(x, object)
        sums = [[int(v) for v in whole[at == k].sum(0)] if (at == k).any() else [0] * x.shape[1] for k in range(len(total))]
    count = hot.sum(1).astype(np.int64).tolist()
    inertia = [0] * len(total)
    for k in np.unique(at).tolist():
        inertia[k] = sum(d[at == k].tolist())
    for k, row in enumerate(sums):
        total[k] = _plus(total[k], [*row, count[k], inertia[k]])


def _plus(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def _merge(a: list[list[int]] | None, b: list[list[int]] | None) -> list[list[int]] | None:
    return a if b is None else b if a is None else [_plus(x, y) for x, y in zip(a, b, strict=True)]


def _in_blocks(rows: DataFrame, out: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    importable(rows.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(b.slice(k, ROWS * 8) for b in batches for k in range(0, b.num_rows, ROWS * 8))
        release()

    return rows.mapInArrow(of, out)


def sums(rows: DataFrame, centroids: Centroids, scale: int = SCALE) -> list[list[int]]:
    """For each centroid the exact sums of its vectors' components, their number and the sum of their distances."""
    dims, k = len(centroids[0]), len(centroids)

    def work(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dims + 2) for _ in range(k)]
        for b in blocks:
            x = quantised(b.column("x"), dims, scale)
            _add(x, *nearest(x, centroids), total)
        yield pa.RecordBatch.from_pydict({"total": [json.dumps(total)]})

    parts = _in_blocks(rows.select("x"), "total string", work).rdd
    found = parts.treeAggregate(None, lambda total, row: _merge(total, json.loads(row["total"])), _merge, depth=3)
    return found or [[0] * (dims + 2) for _ in range(k)]


def fit(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> Centroids:
    """Centroids after ``rounds`` rounds of assignment and replacement by the floor of each component's mean."""
    centroids = first_centroids(rows, clusters, scale, seed)
    for _ in range(rounds if centroids else 0):
        found = sums(rows, centroids, scale)
        centroids = [[v // row[-2] for v in row[:-2]] if row[-2] else old for row, old in zip(found, centroids, strict=True)]
    return centroids


def assign(rows: DataFrame, centroids: Centroids, scale: int = SCALE) -> DataFrame:
    """(id, cluster int, distance long) of every row."""
    dims = len(centroids[0]) if centroids else 0
    kind = rows.schema["id"].dataType.simpleString()

    def work(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            at, d = nearest(quantised(b.column("x"), dims, scale), centroids)
            far = [v if v < EXACT_LONG else None for v in d.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at, pa.int32()), pa.array(far, pa.int64())], ["id", "cluster", "distance"])

    return _in_blocks(rows, f"id {kind}, cluster int, distance long", work)


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of ``vectors`` (id, x)."""
    rows = kept(vectors, dims, scale)
    centroids = fit(rows, clusters, rounds, scale, seed)
    each = [row[-1] for row in sums(rows, centroids, scale)] if centroids else []
    fits = lambda v: F.lit(v if v < EXACT_LONG else None).cast("long")
    pick = lambda values: F.get(F.array(*values), F.col("cluster")) if values else F.lit(None)
    digests = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]
    return assign(rows, centroids, scale).select(
        "id", "cluster", "distance", pick([fits(v) for v in each]).cast("long").alias("cluster_inertia"), fits(sum(each)).alias("inertia"), pick(digests).cast("string").alias("centroid_sha256")
    )


def op11_centroids(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return clustered(vectors).withColumnRenamed("id", "vec_id")


def _round(k: int, last: bool) -> str:
    far = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    out = f"""
    near{k} AS MATERIALIZED (
      SELECT place, any_value(vec_id) AS vec_id, any_value(x) AS x, min(struct_pack(d := d, c := cluster)) AS best
      FROM (SELECT place, vec_id, x, cluster, {far} AS d FROM v CROSS JOIN c{k}) GROUP BY place)"""
    if last:
        return out
    return (
        out
        + f""",
    mean{k} AS (
      SELECT cluster, list(m ORDER BY i) AS c FROM (
        SELECT best.c AS cluster, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM near{k}, range(1, {DIMS + 1}) t(i) GROUP BY 1, 2) GROUP BY 1),
    c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c)::BIGINT[] AS c FROM c{k} o LEFT JOIN mean{k} m USING (cluster)),"""
    )


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * e::DOUBLE) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {DIMS} AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS cluster, x AS c
  FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {CLUSTERS})),
{"".join(_round(k, False) for k in range(ROUNDS))}
{_round(ROUNDS, True)}
SELECT n.vec_id, n.best.c AS cluster, n.best.d AS distance, CAST(sum(n.best.d) OVER (PARTITION BY n.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(n.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM near{ROUNDS} n JOIN c{ROUNDS} c ON c.cluster = n.best.c
"""

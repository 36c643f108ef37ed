"""Exact order statistics of the similarities of stated queries with all vectors, by label.

All queries meet all vectors, so the work is their product; what moves is not. Vectors are dealt by label, ``PART`` rows to a part, and meet the
queries block by block where they are: of a label that is one part only the statistics leave the task. Parts of a larger label let out every
``STEP``-th of a query's sorted values, which says between which two values a rank must be, and then, computed again, the different values
between those two with their counts. So no task holds more than a part and a block of queries, however large a label is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.shared import written
from gristmill.functions.workers import importable

PART = 1 << 15
STEP = 256
BLOCK = 32
CHUNK = 4096


def upper_median(n: int) -> int:
    """The place, from 1, of the upper of two middle values."""
    return n // 2 + 1


def nearest_rank(share: int) -> callable:
    """The place of the ``share``-th percentile by nearest rank."""
    return lambda n: max(1, (n * share + 99) // 100)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """To ``digits`` decimals, halves away from zero; what isn't finite stays."""
    a = np.abs(x) * 10.0**digits
    low = np.floor(a)
    with np.errstate(invalid="ignore"):
        out = np.copysign(low + (a - low >= 0.5), x) / 10.0**digits + 0.0  # no minus zero
    return np.where(np.isfinite(a), out, x)


def matrices(column: pa.ChunkedArray | pa.Array) -> dict[int, np.ndarray]:
    """Vectors without nulls as float64, by their length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.filter(flat.is_valid())
    long = np.diff(flat.offsets.to_numpy())
    values = flat.flatten()
    bad = np.add.reduceat(np.append(np.asarray(values.is_null()).astype(np.int64), 0), np.minimum(np.cumsum(long) - long, len(values))) if len(long) else long
    bad = (bad > 0) & (long > 0)
    x, at = values.to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(long) - long
    return {int(d): x[(at[(long == d) & ~bad][:, None] + np.arange(d)[None]).astype(np.int64)] for d in np.unique(long[~bad])}


def _dots(x: np.ndarray, q: np.ndarray, digits: int) -> np.ndarray:
    """(queries, vectors): products added one after the other, as a fold over the components does."""
    out = np.zeros((len(q), len(x)))
    for k in range(0, len(x), CHUNK):
        some, t = out[:, k : k + CHUNK], np.ascontiguousarray(x[k : k + CHUNK].T)
        for j in range(x.shape[1]):
            some += q[:, j : j + 1] * t[j][None]
        some[:] = rounded(some, digits)
    return out


def _values(t: pa.Table, queries: dict[int, tuple[np.ndarray, np.ndarray]], digits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query's place, its sorted similarities but NaN); one query has one length, unless its id repeats."""
    for d, x in matrices(t.column("embedding")).items():
        place, q = queries.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
        for b in range(0, len(q), BLOCK):
            for p, s in zip(place[b : b + BLOCK].tolist(), _dots(x, q[b : b + BLOCK], digits), strict=True):
                s = np.sort(s)
                yield p, s[: np.searchsorted(s, np.nan)]  # NaN comes last


def order_statistics(vectors: DataFrame, queries: DataFrame, places: dict[str, callable], digits: int = 6, part: int = PART, lot: int = 10_000) -> DataFrame:
    """(qid, label, n, one column for each of ``places``): the similarity at a place, from 1, that is a function of the group's n.

    vectors: (label, embedding), queries: (qid, query). Pairs of vectors of different lengths, or with nulls, and NaN don't count; a null label is a
    group. Queries are broadcast, ``lot`` or so at a time.
    """
    spark = vectors.sparkSession
    importable(spark)
    kind = dict(vectors.dtypes)["label"]
    sizes = vectors.groupBy("label").count().filter(F.col("count") > part).select("label", F.ceil(F.col("count") / part).alias("parts"))
    sizes = sizes.toDF("big", "parts").withColumn("large", F.lit(True))  # one row for each ``part`` vectors at most
    dealt = vectors.join(F.broadcast(sizes), F.col("label").eqNullSafe(F.col("big")), "left")
    dealt = written(dealt.select("label", "embedding", F.coalesce("large", F.lit(False)).alias("large"), F.coalesce(F.monotonically_increasing_id() % F.col("parts"), F.lit(0)).cast("int").alias("part")))
    lots = max(1, -(-queries.count() // lot))
    out = [_lot(dealt, queries.filter(F.pmod(F.xxhash64("qid"), F.lit(lots)) == k), kind, places, digits) for k in range(lots)]
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def _lot(dealt: DataFrame, queries: DataFrame, kind: str, places: dict[str, callable], digits: int) -> DataFrame:
    spark = dealt.sparkSession
    asked = queries.select("qid", "query").toArrow()
    qid = asked.column("qid").combine_chunks()
    qkind, names = dict(queries.dtypes)["qid"], list(places)
    different = qid.unique()
    code = pc.index_in(qid, different).to_numpy()
    usable = [(c, {d: x[0] for d, x in matrices(asked.column("query").slice(k, 1)).items()}) for k, c in enumerate(code.tolist())]
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {d for _, q in usable for d in q}:
        own = sorted((c, k) for k, (c, q) in enumerate(usable) if d in q)
        by[d] = np.array([c for c, _ in own], np.int64), np.stack([usable[k][1][d] for _, k in own]).reshape(len(own), d)
    shared = spark.sparkContext.broadcast((by, different))

    def grouped(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """Values of each query's id: those of a repeated one together."""
        by, different = shared.value
        twice = {p for q in [np.concatenate([np.zeros(0, np.int64), *[p for p, _ in by.values()]])] for p in np.flatnonzero(np.bincount(q, minlength=1) > 1).tolist()}
        held: dict[int, list[np.ndarray]] = {}
        for p, s in _values(t, by, digits):
            if p in twice:
                held.setdefault(p, []).append(s)
            elif len(s):
                yield p, s
        for p, parts in held.items():
            s = np.sort(np.concatenate(parts))
            if len(s):
                yield p, s

    def made(key: tuple, rows: list[tuple], columns: list[str], kinds: list[pa.DataType]) -> pa.Table:
        """Rows (query's place, ...) under their ids and the group's label."""
        first = shared.value[1].take(pa.array([r[0] for r in rows], pa.int64()))
        label = pa.array([key[0].as_py()] * len(rows), key[0].type)
        cells = list(zip(*rows, strict=True))[1:] if rows else [[] for _ in columns]
        return pa.table({"qid": first, "label": label} | {c: pa.array(list(v), k) for c, v, k in zip(columns, cells, kinds, strict=True)})

    def whole(key: tuple, t: pa.Table) -> pa.Table:
        rows = [(p, len(s), *(float(s[f(len(s)) - 1]) for f in places.values())) for p, s in grouped(t)]
        return made(key, rows, ["n", *names], [pa.int64(), *[pa.float64()] * len(names)])

    head = f"qid {qkind}, label {kind}"
    small = written(dealt.filter("not large").groupBy("label", "part").applyInArrow(whole, f"{head}, n long, " + ", ".join(f"`{x}` double" for x in names)))
    large = dealt.filter("large")
    if large.isEmpty():
        return small

    def sampled(key: tuple, t: pa.Table) -> pa.Table:
        rows = []
        for p, s in grouped(t):
            at = np.unique(np.append(np.arange(STEP - 1, len(s), STEP), len(s) - 1))
            rows.append((p, s[at], np.diff(at, prepend=-1)))
        return made(key, rows, ["v", "w"], [pa.list_(pa.float64()), pa.list_(pa.int64())])

    parts = written(large.groupBy("label", "part").applyInArrow(sampled, f"{head}, v array<double>, w array<long>"))
    totals = parts.groupBy("qid", "label").agg(F.sum(F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"), F.count("*").alias("parts"))
    totals = written(totals)
    wanted = []
    for r in totals.select("n").distinct().collect():  # sizes of groups, few unless values are NaN
        wanted += [(r["n"], k, f(r["n"])) for k, f in enumerate(places.values())]
    ranks = written(totals.join(F.broadcast(spark.createDataFrame(wanted or [(0, 0, 1)], "n long, stat int, place long")), "n"))
    each = parts.select("qid", "label", F.explode(F.arrays_zip("v", "w")).alias("x")).groupBy("qid", "label", F.col("x.v").alias("v")).agg(F.sum("x.w").alias("w"))
    upto = each.withColumn("upto", F.sum("w").over(Window.partitionBy("qid", "label").orderBy("v")))
    at = upto.join(ranks.toDF("n", "_q", "_l", "parts", "stat", "place"), F.col("qid").eqNullSafe(F.col("_q")) & F.col("label").eqNullSafe(F.col("_l")))
    ends = at.groupBy("qid", "label", "stat", "n", "place").agg(
        F.max(F.when(F.col("upto") + F.col("parts") * (STEP - 1) < F.col("place"), F.col("v"))).alias("lo"), F.min(F.when(F.col("upto") >= F.col("place"), F.col("v"))).alias("hi")
    )
    ends = written(ends)
    found = ends.select("qid", "label", "stat", "lo", "hi").toArrow()  # a row for each query of the lot, large label and statistic
    bounds: dict = {}
    for q, x, k, lo, hi in zip(*[found.column(c).to_pylist() for c in ("qid", "label", "stat", "lo", "hi")], strict=True):
        bounds.setdefault(x, {}).setdefault(q, []).append((k, -np.inf if lo is None else lo, lo is None, hi))
    told = spark.sparkContext.broadcast(bounds)

    def between(key: tuple, t: pa.Table) -> pa.Table:
        own, ids, rows = told.value[key[0].as_py()], shared.value[1].to_pylist(), []
        for p, s in grouped(t):
            for k, lo, open_, hi in own[ids[p]]:
                below = 0 if open_ else int(np.searchsorted(s, lo, "right"))
                v, c = np.unique(s[below : int(np.searchsorted(s, hi, "right"))], return_counts=True)
                rows.append((p, k, below, v, c))
        return made(key, rows, ["stat", "below", "v", "c"], [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())])

    near = written(large.groupBy("label", "part").applyInArrow(between, f"{head}, stat int, below long, v array<double>, c array<long>"))
    below = near.groupBy("qid", "label", "stat").agg(F.sum("below").alias("below"))
    each = near.select("qid", "label", "stat", F.explode(F.arrays_zip("v", "c")).alias("x")).groupBy("qid", "label", "stat", F.col("x.v").alias("v")).agg(F.sum("x.c").alias("c"))
    upto = each.withColumn("upto", F.sum("c").over(Window.partitionBy("qid", "label", "stat").orderBy("v")))
    on = lambda rows: [F.col("qid").eqNullSafe(F.col(f"_q{rows}")), F.col("label").eqNullSafe(F.col(f"_l{rows}")), F.col("stat") == F.col(f"_s{rows}")]
    a, b = below.toDF("_q1", "_l1", "_s1", "below"), ends.select("qid", "label", "stat", "n", "place").toDF("_q2", "_l2", "_s2", "n", "place")
    hit = upto.join(a, on(1)).join(b, on(2)).withColumn("rank", F.col("below") + F.col("upto")).filter((F.col("rank") >= F.col("place")) & (F.col("rank") - F.col("c") < F.col("place")))
    wide = hit.groupBy("qid", "label", "n").agg(*[F.max(F.when(F.col("stat") == k, F.col("v"))).alias(name) for k, name in enumerate(names)])
    return small.unionByName(written(wide.select("qid", "label", "n", *names)))

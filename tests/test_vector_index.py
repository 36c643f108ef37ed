"""The vector index against all rows, and how little it compares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import vector_index as I
from gristmill.operators import vectors as V


def brute(base, queries, k, floor, models=None):
    unit = lambda x: x / np.sqrt((x * x).sum()) if (x * x).sum() > 0 else x
    out = []
    for qid, q in queries:
        s = sorted((-round(float(unit(np.array(x, float)) @ unit(np.array(q, float))), 6), i) for i, x in base if i != qid and len(x) == len(q) and np.isfinite(x).all() and (models is None or models[i] == models[qid]))
        out += [(qid, i, -v, r + 1) for r, (v, i) in enumerate([e for e in s if -e[0] >= floor][:k])]
    return sorted(out)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(k, (centres[k % 12] + 0.15 * rng.normal(size=dim)).astype(np.float32).tolist()) for k in range(n)]


def found(df):
    return sorted((r.qid, r.vec_id, r.similarity, r.rank) for r in df.collect())


@pytest.mark.parametrize("k,floor", [(5, 0.2), (3, -1.0), (50, 0.6), (1, 0.999)])
def test_same_rows_as_all_pairs(spark, k, floor):
    rows = clustered(400, 16, k) + [(900, [0.0] * 16), (901, [1.0] * 15), (902, [float("nan")] + [1.0] * 15), (903, [1e-30] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = [r for r in rows if r[0] % 40 == 0 and len(r[1]) == 16]
    index = I.build(df, 16, cells=20)
    asked = spark.createDataFrame(q, "qid long, query array<float>")
    assert found(index.nearest(asked, k, floor)) == brute([r for r in rows if len(r[1]) == 16], q, k, floor)


def test_rows_compared(spark):
    """Twelve dense clusters: a query compares little more than its own one, and counts what it compares."""
    rows = clustered(1200, 16, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = I.build(df, cells=40)
    work = {r.qid: r.compared for r in index.work(spark.createDataFrame(rows[:24], "qid long, query array<float>"), 3, 0.5).collect()}
    assert len(work) == 24 and max(work.values()) < 600 and sum(work.values()) / 24 < 300


def test_hot_cell_is_split_and_models_apart(spark, monkeypatch):
    monkeypatch.setattr(I, "PART_ROWS", 50)
    rows = [(k, v, "mn"[k % 2]) for k, v in clustered(300, 8, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, model string")
    index = I.build(df, cells=2)
    assert index.parts.max() > 1
    q = df.filter("vec_id % 30 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"), "model")
    want = brute([r[:2] for r in rows], [r[:2] for r in rows if r[0] % 30 == 0], 4, 0.3, {r[0]: r[2] for r in rows})
    assert found(index.nearest(q, 4, 0.3)) == want


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, query array<float>")
    assert V.nearest(none, q, 3).count() == 0
    assert V.nearest(spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>"), q.limit(0), 3).count() == 0


def test_excluded_topics_and_both_ways(spark):
    near = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.7), (1, 13, 0.6), (1, 14, 0.5)], "qid long, id long, similarity double")
    topics = spark.createDataFrame([(10, "roster"), (11, "water"), (12, None), (14, "food")], "id long, topic string")
    lexical = spark.createDataFrame([(1, 11, 6.0)], "qid long, id long, score double")
    got = V.with_semantic(lexical, V.outside_topics(near, topics)).orderBy("place").collect()
    assert [(r.id, r.tier) for r in got] == [(11, 0), (12, 1), (14, 1)]


def test_percentiles_of_all_queries(spark, monkeypatch):
    """Queries beyond those that are broadcast count, too."""
    import oracle

    from gristmill.plans import search

    monkeypatch.setattr(search, "BROADCAST_QUERIES", 1)
    rows = search.vector_percentiles(spark, oracle.DATA)
    assert rows.select("qid").distinct().count() == spark.read.parquet(f"{oracle.DATA}/embeddings.parquet").filter("vec_id % 50 = 0").count() > 1


def test_order_statistics_by_parts_and_lots(spark):
    """Labels of one part and of several, copies, repeated queries, odd vectors, against sorted lists."""
    import math

    from gristmill.operators import vector_ranks as K

    rng = np.random.default_rng(5)
    rows = [(k, "big" if k % 4 else None, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for k in range(900)]
    rows += [(1000 + k, "big", rows[5][2]) for k in range(700)] + [(2000 + k, f"few{k % 3}", rows[k][2]) for k in range(9)]
    rows += [(3000, "few0", None), (3001, "few0", [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3002, "odd", [1.0, 2.0]), (3003, "few1", [float("nan")] * 6), (3004, "few1", [float("inf")] + [1.0] * 5), (3005, "none", [])]
    queries = [(k, rows[k][2]) for k in (0, 50, 100, 150)] + [(50, rows[7][2]), (7, [3.0, 1.0]), (8, None)]
    want: dict = {}
    for q, a in queries:
        for _, label, b in rows:
            if a is None or b is None or len(a) != len(b) or None in b:
                continue
            s = 0.0
            for x, y in zip(a, b, strict=True):
                s += x * y
            if not math.isnan(s):
                want.setdefault((q, label), []).append(round(s, 6) if math.isfinite(s) else s)
    want = {k: (len(v), sorted(v)[len(v) // 2], sorted(v)[(len(v) * 90 + 99) // 100 - 1]) for k, v in want.items()}
    df = spark.createDataFrame([r[1:] for r in rows], "label string, embedding array<float>")
    q = spark.createDataFrame(queries, "qid long, query array<float>")
    places = {"median": K.upper_median, "p90": K.nearest_rank(90)}
    for part, lot in ((1 << 15, 10_000), (300, 10_000), (300, 3)):
        got = {(r.qid, r.label): (r.n, r.median, r.p90) for r in K.order_statistics(df, q, places, part=part, lot=lot).collect()}
        assert got == want


def test_percentiles_move_no_pairs(spark):
    """What the statistics of a label shuffle doesn't grow with pairs of queries and vectors."""
    import oracle

    from gristmill.plans import search

    plan = search.vector_percentiles(spark, oracle.DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan

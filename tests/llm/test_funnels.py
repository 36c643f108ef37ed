"""Funnels against attempts followed one by one, with chunks so small that attempts cross several of them."""

import bisect
import datetime
import math
import random

import pytest
from oracle import differences

from gristmill.llm import funnels as U
from gristmill.llm.queries import ORACLE_SQL, QUERIES

START = datetime.datetime(2024, 3, 31)


def brute(rows, funnels=U.FUNNELS):
    own = {}
    for c, k, t in {r for r in rows if None not in r}:
        own.setdefault(c, {}).setdefault(k, []).append((t - START) // datetime.timedelta(microseconds=1))
    found = []
    for c, of in own.items():
        for v in of.values():
            v.sort()
        for f, (steps, bar) in funnels.items():
            n, times = [0] * 4, [[], [], []]
            for t in of.get(steps[0], []):
                n[0] += 1
                for s, k in enumerate(steps[1:]):
                    v, b = of.get(k, []), of.get(bar, [])
                    i, j = bisect.bisect_right(v, t), bisect.bisect_right(b, t)
                    if i == len(v) or v[i] - t > U.GAP or (j < len(b) and b[j] <= v[i]):
                        break
                    times[s].append(v[i] - t)
                    n[s + 1] += 1
                    t = v[i]
            if n[0]:
                q = [sorted(x)[math.ceil(90 * len(x) / 100) - 1] if x else None for x in times]
                found.append((f, c, *n, sum(x > 0 for x in n), *q))
    depth = lambda r: (r[0], r[6])
    every = [depth(r) for r in found]
    return sorted((*r, every.count(depth(r))) for r in found)


def found(spark, rows, chunk, kind="long"):
    df = spark.createDataFrame(rows, f"client {kind}, kind string, ts timestamp_ntz, extra string" if rows and len(rows[0]) == 4 else f"client {kind}, kind string, ts timestamp_ntz")
    return sorted(tuple(r) for r in U.funnel_counts(df.repartition(3), chunk=chunk).select("funnel", "client", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth").collect())


def clicks(rng, n, kinds, clients, minutes, tick):
    at = lambda: START + datetime.timedelta(microseconds=rng.randrange(minutes * 60_000_000 // tick) * tick)
    return [(rng.choice(clients), rng.choice(kinds), at()) for _ in range(n)]


KINDS = ["view", "click", "purchase", "signup"] * 4 + ["error", "other"]


@pytest.mark.parametrize("chunk", [3, 25, 1 << 17])
def test_hot_client(spark, chunk):
    """Half of all rows have one client, and many rows one time; chunks of 3 rows are crossed by nearly every attempt."""
    rng = random.Random(chunk)
    rows = clicks(rng, 300, KINDS, [7] * 12 + list(range(12)), 900, 30_000_000)
    rows += rows[:40] + [(None, "view", START), (1, None, START), (1, "view", None), (2, "view", datetime.datetime(1, 1, 1)), (2, "click", datetime.datetime(9999, 12, 31, 23, 59))]
    want = brute(rows)
    assert found(spark, rows, chunk) == want and any(r[6] == 4 for r in want)


def test_dense_and_sparse(spark):
    """One kind is missing for hours, so what waits for it passes through many chunks; then all comes at once."""
    rng = random.Random(5)
    rows = clicks(rng, 120, ["view"], [1], 170, 1_000_000) + clicks(rng, 6, ["click", "purchase", "signup"], [1, 2], 170, 1_000_000) + clicks(rng, 60, KINDS, [1], 1, 1000)
    assert found(spark, rows, 4) == brute(rows)


def test_text_ids_and_empty(spark):
    rng = random.Random(6)
    rows = [(f"é{c}", k, t) for c, k, t in clicks(rng, 90, KINDS, [1, 2, 3], 200, 1_000_000)]
    assert found(spark, rows, 10, "string") == brute(rows)
    assert found(spark, [], 10) == [] and found(spark, [(1, "other", START)], 10) == []


def test_session_zone_with_a_clock_change(spark):
    rng = random.Random(8)
    rows = clicks(rng, 150, KINDS, [1, 2], 300, 1_000_000)  # 31 March 2024, 0 to 5 o'clock
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert found(spark, rows, 20) == brute(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_odd_rows_as_registered(spark, tmp_path):
    """Columns whose names the operator uses itself, nulls everywhere, repeats and an empty table."""
    rng = random.Random(9)
    rows = [(k, c, kind, t) for k, (c, kind, t) in enumerate(clicks(rng, 120, KINDS, [1, 1, 1, 2, 3], 400, 1_000_000) + [(None, None, None), (1, "view", None), (None, "view", START)])]
    rows += rows[:20]
    df = spark.createDataFrame([(*r, 1, "x", 2.0, None) for r in rows], "click_id long, client_id long, kind string, ts timestamp_ntz, chunk int, client string, t double, role int")
    for name, part in (("some", df), ("none", df.limit(0))):
        part.repartition(2).write.parquet(f"{tmp_path}/{name}/clicks.parquet")
        got = QUERIES["op12_funnels"](spark, f"{tmp_path}/{name}")
        assert got.columns == ["funnel", "client_id", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth"]
        assert sorted(tuple(r) for r in got.collect()) == (brute([r[1:] for r in rows]) if name == "some" else [])


def test_percentile_rank():
    assert [U.rank_of(n) for n in (1, 9, 10, 11, 100)] == [math.ceil(90 * n / 100) for n in (1, 9, 10, 11, 100)]


def test_query_and_twin(spark):
    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        assert differences(QUERIES["op12_funnels"](spark, d), ORACLE_SQL["op12_funnels"], d) == []

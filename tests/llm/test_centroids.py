"""Centroid clustering against plain integers, its SQL twin, and the guard of the float64 product."""

import hashlib
import math
import random

import numpy as np
import pytest
from oracle import differences

from gristmill.llm import centroids as C
from gristmill.llm.queries import ORACLE_SQL, QUERIES


def brute(rows, clusters=C.CLUSTERS, rounds=C.ROUNDS, dims=C.DIMS):
    good = [(i, [math.floor(C.SCALE * v) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{C.SEED}:{r[0]}".encode()).hexdigest(), r[1])
    cs = [x for _, x in sorted(good, key=key)[:clusters]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(cs))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in good]
        for k in range(len(cs)):
            own = [x for (_, x), j in zip(good, at, strict=True) if j == k]
            if own:
                cs[k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    best = [near(x) for _, x in good]
    fits = lambda v: v if v < 1 << 63 else None
    return [(i, k, fits(d), fits(sum(e for e, j in best if j == k)), fits(sum(e for e, _ in best)), hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(good, best, strict=True)]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "id long, x array<float>").repartition(3)
    return [tuple(r) for r in C.clustered(df, **options).collect()]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


def odd_rows(top):
    rng = random.Random(3)
    vector = lambda: [float(np.float32(rng.uniform(-top, top))) for _ in range(C.DIMS)]
    rows = [(k, vector()) for k in range(60)]
    rows += [(7, vector()), rows[3], rows[3], (None, vector()), (100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 63 + [None]), (104, [0.5] * 63 + [math.nan]), (105, [math.inf] + [0.5] * 63), (106, [0.0] * 64), (107, [-0.0] * 64)]
    return rows


@pytest.mark.parametrize("top", [1, 3e5, 5e6, 3e38])
def test_against_integers(spark, top):
    rows = odd_rows(top)
    same(found(spark, rows), brute(rows))


def test_mixed_magnitudes_and_few_rows(spark):
    rows = odd_rows(1) + [(500 + k, [float(np.float32(3e38)) if j == k else 1.0 for j in range(64)]) for k in range(3)] + [(600, [4e5] * 64)]
    same(found(spark, rows), brute(rows))
    same(found(spark, rows[:5]), brute(rows[:5]))
    assert found(spark, []) == []


def test_ties_take_the_smaller_number():
    x = np.array([[1.0] * 64, [0.0] * 64])
    at, d = C.nearest(x, [[0] * 64, [2] * 64, [0] * 64])
    assert at.tolist() == [0, 0] and d.tolist() == [64, 0]


def test_guard_keeps_the_product_exact():
    """Just above the bound the float64 product would be wrong; the integers are right."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.uniform(-1, 1, (50, 64)) * 2**26)
    cs = [[int(v) for v in row] for row in np.floor(rng.uniform(-1, 1, (5, 64)) * 2**26)]
    _, d = C.nearest(x, cs)
    exact = [min(sum((int(a) - b) ** 2 for a, b in zip(row, c, strict=True)) for c in cs) for row in x]
    rough = C._expanded(x, np.array(cs, float)).min(1)
    assert d.tolist() == exact and [int(v) for v in rough] != exact


def test_query_and_twin(spark):
    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        assert differences(QUERIES["op11_centroids"](spark, d), ORACLE_SQL["op11_centroids"], d) == []

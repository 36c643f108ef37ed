"""Matching operators against stepwise versions of themselves."""

import itertools
import random

import pytest

from gristmill.operators import matching as M
from gristmill.operators import people as P
from gristmill.operators.vector_index import VectorIndex  # noqa: F401


def greedy(rows):
    a, b, out = set(), set(), []
    for x, y, s in sorted(rows, key=lambda r: (-(r[2] if r[2] is not None else float("-inf")), r[0], r[1])):
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            out.append((x, y))
    return sorted(out)


def taken(spark, rows, **options):
    df = spark.createDataFrame(rows, "a_id long, b_id long, score double").repartition(3)
    return sorted((r.a_id, r.b_id) for r in M.one_to_one(df, **options).collect())


def test_one_to_one_is_what_going_through_in_order_gives(spark):
    rng = random.Random(4)
    rows = list({(rng.randrange(60), rng.randrange(60)): None for _ in range(500)})
    rows = [(x, y, rng.choice([None, 1.0, 2.0, rng.random()])) for x, y in rows]
    assert taken(spark, rows) == greedy(rows)


def test_chains_of_falling_scores_end(spark):
    chain = [(k // 2, (k + 1) // 2, 100.0 - k) for k in range(13)]  # each pair waits for the one before
    assert taken(spark, chain, rounds=2) == greedy(chain)
    assert taken(spark, chain, rounds=2, together=5) == greedy(chain)  # too long for one task: further rounds
    assert taken(spark, []) == []


def test_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.9), (1, 2, 0.7), (None, 2, 5.0), (2, 2, None)], "a_id long, b_id long, score double")
    assert sorted(tuple(r) for r in M.one_to_one(df).collect()) == [(1, 1, 0.9), (2, 2, float("-inf"))]


def test_absorbed(spark):
    real = [(1, "Saami Khoury"), (2, "Cece Garland"), (3, "David Moss"), (4, "David Hall"), (5, "Anna Maria Lund"), (6, "Zoë"), (7, "Ana Luna")]
    orphans = [(11, "Saami"), (12, "CeCe Garlan"), (13, "David"), (14, "Lund Anna"), (15, "Nobody Known"), (16, "Da"), (17, "Anna Moss"), (18, "ana luna"), (19, "Garland  Cece"), (20, None), (21, "")]
    f = lambda rows: spark.createDataFrame(rows, "id long, name string")
    got = sorted(tuple(r) for r in M.absorbed(f(orphans), f(real)).collect())
    assert got == [(11, 1), (12, 2), (14, 5), (19, 2)]  # two Davids fit none; equal names are another matter


def test_variants(spark):
    rows = [
        (1, "Ana", "Bartkow", "San Francisco"), (2, "Ana", "Luna", "Zihuat"), (3, "Ana", "Stanc", "Barcelona"), (4, "Ana", "", "SF / Berlin"), (5, "Ana", None, "SF"), (6, "Ana", "", "Rome"), (7, "ana", "", None),
        (8, "Simo", "", None), (9, "Simone", "", "x"), (10, "Simo", "", None),  # all agree
        (11, "Joe", "Hanley", "a"), (12, "Joe", "H", "a"), (13, "Joseph", "Horvath", "b"),  # a letter that fits two
        (14, "Pat", "Quill", None), (15, "", "Quill", None), (16, None, None, None),
    ]
    got = {r.id: (r.person, r.how) for r in M.merge_variants(spark.createDataFrame(rows, "id long, first string, last string, city string")).collect()}
    assert {k: got[k] for k in (4, 5, 6, 7)} == {4: (1, "rescued"), 5: (1, "rescued"), 6: (6, "ambiguous"), 7: (7, "ambiguous")}
    assert [got[k] for k in (1, 2, 3)] == [(k, "ambiguous") for k in (1, 2, 3)]
    assert [got[k] for k in (8, 9, 10)] == [(9, "merged")] * 3
    assert [got[k] for k in (11, 12, 13)] == [(k, "ambiguous") for k in (11, 12, 13)]
    assert [got[k] for k in (14, 15, 16)] == [(k, "alone") for k in (14, 15, 16)]


def test_ambiguity_names_the_others(spark):
    rows = [(1, "Joe", "Hanley", "a"), (2, "Joe", "H", "a"), (3, "Joe", "Horvath", "b")]
    got = {r.id: r.others for r in M.merge_variants(spark.createDataFrame(rows, "id long, first string, last string, city string")).collect()}
    assert got == {1: "Joe H", 2: "Joe Hanley, Joe Horvath", 3: "Joe H"}


@pytest.mark.parametrize("window", [1, 3, 10])
def test_neighbourhood_over_borders(spark, window):
    rng = random.Random(window)
    rows = [(k, rng.choice("abcdefgh") * rng.randint(1, 3)) for k in range(80)] + [(500, None)]
    got = sorted(tuple(r) for r in M.neighbourhood(spark.createDataFrame(rows, "id long, name string"), "name", "id", window, partitions=13).collect())
    order = [k for _, k in sorted((n, k) for k, n in rows if n)]
    assert got == sorted((order[i], order[j]) for i, j in itertools.combinations(range(len(order)), 2) if j - i <= window)


def test_link_candidates(spark):
    members = spark.createDataFrame([(1, "Marcus", "Foster", None), (2, "Jessica", "Shel", "Biscuit"), (3, "Alex", "Tam", None)], "id long, first string, last string, nickname string")
    people = spark.createDataFrame([(10, "Marcus Foster", 0), (11, "Marcus", 1136), (12, "Biscuit", 5), (13, "Jess Shel", 0), (14, "Alex Tam", 3), (15, "Alexandria", 2), (16, "", 9)], "id long, name string, messages long")
    c = M.link_candidates(members, people)
    assert sorted((r.a_id, r.b_id, r.how) for r in c.collect()) == [(1, 11, 2), (2, 12, 1), (3, 14, 0), (3, 15, 2)]  # who has written competes alone
    assert sorted((r.a_id, r.b_id) for r in M.one_to_one(c).collect()) == [(1, 11), (2, 12), (3, 14)]


def test_alike_counts_edits_in_bytes(spark):
    """As in SQL: another accented letter is one byte, a plain one in its place two."""
    rows = [(1, "Ankem\u00e9 Str\u00f6mkostrimez"), (2, "Ankem\u00e9 Str\u00f6mkostr\u00f6mez"), (3, "Zoe Brandenburgerstein"), (4, "Zoe Brandenburgersteim")]
    got = M.duplicate_candidates(spark.createDataFrame(rows, "id long, name string"))
    assert sorted((r.a, r.b, r.reason) for r in got.collect() if r.reason == "nearly equal") == [(3, 4, "nearly equal")]


def test_absorbed_copies(spark):
    """Copies of a name add rows to no join: names meet with the smallest and largest id of their rows."""
    rng = random.Random(5)
    name = lambda: " ".join(rng.choice(["ann", "bob", "cole", "dora", "annabella", "annabela"]) for _ in range(rng.randint(1, 3)))
    orphans, real = [(k, name()) for k in range(60)], [(100 + k, name()) for k in range(6)] + [(200, "eve stone"), (201, "zed"), (202, "zed zed")]
    orphans += [(70, "eve"), (71, "zed"), (72, "stone eve")]
    one = lambda a, b: any(a[:i] + a[i + k :] == b[:i] + b[i + m :] for i in range(max(len(a), len(b)) + 1) for k, m in ((1, 1), (1, 0), (0, 1), (0, 0)))
    fits = lambda a, b: a != b and (set(a.split()) <= set(b.split()) or (min(len(a), len(b)) >= 8 and one(a.replace(" ", ""), b.replace(" ", ""))))
    f = lambda rows: spark.createDataFrame(rows, "id long, name string")
    brute = lambda rows: sorted((k, m[0]) for k, a in orphans if len(m := [i for i, b in rows if fits(a, b)]) == 1)
    got = M.absorbed(f(orphans), f(real))
    assert sorted(map(tuple, got.collect())) == brute(real) != []
    assert "min(low" in got._jdf.queryExecution().optimizedPlan().toString()
    copies = real + [(i + 1000, b) for i, b in real if i != 200]
    assert sorted(map(tuple, M.absorbed(f(orphans), f(copies)).collect())) == brute(copies) != []


def test_name_keys_are_equal_where_names_agree(spark):
    from pyspark.sql import functions as F

    from gristmill.operators import people as P

    firsts = ["Jo", "Joel", "Joe", "Joseph", "J.", "j", "Jim/Jo", "James", "Ed & Ted", "Edward", "", "É", "Joël", "jo", "Joelle / Bob", "Robert", "Don"]
    lasts = ["Hall", "hall", "H", "Van der Hall", "vdh", "van Dyck", "VD", "a b c d", "abcd", "", "Hull", "h."]
    names = [(k, f, l) for k, (f, l) in enumerate(itertools.product(firsts, lasts))]
    n = spark.createDataFrame(names, "id long, first string, last string")
    x, y = n.select(F.col("id").alias("a_id"), F.col("first").alias("af"), F.col("last").alias("al")), n.select(F.col("id").alias("b_id"), F.col("first").alias("bf"), F.col("last").alias("bl"))
    want = x.crossJoin(y).filter(P.first_names_agree(F.col("af"), F.col("bf")) & P.surnames_agree(F.col("al"), F.col("bl"))).select("a_id", "b_id")
    got = P.name_pairs(n, n)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and not want.isEmpty()


def test_names_that_only_begin_alike_make_no_rows(spark):
    """Keys of two letters and an initial let all of these meet each other."""
    from pyspark.sql import functions as F

    from gristmill.operators import people as P

    n = spark.createDataFrame([(k, f"Jo{'abcdefgh'[k % 8]}{'lmnopqrs'[k // 8 % 8]}", f"Sa{k}") for k in range(400)], "id long, first string, last string")
    keys = lambda c, other: n.select(F.col("id").alias(c), F.explode(P.meeting(P.first_keys(F.col("first")), other)).alias("k"), "last").select(c, "k", F.explode(P.meeting(P.last_keys(F.col("last")), other)).alias("l"))
    assert keys("a", False).join(keys("b", True), ["k", "l"]).select("a", "b").distinct().count() == 400  # each with itself


def test_components_of_chains_stars_and_loops(spark, tmp_path):
    from gristmill.operators import people as P

    rng = random.Random(8)
    chain = [(k, k + 1) for k in range(0, 60)]
    rows = [*chain, *[(200, 300 + k) for k in range(50)], (7, 7), (900, 900), (5, 4), *[(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(50)]]
    to = {n: n for e in rows for n in e}
    for _ in range(90):
        for a, b in rows:
            to[a] = to[b] = min(to[a], to[b])
    got = P.connected(spark.createDataFrame(rows, "a long, b long").repartition(3), str(tmp_path)).collect()
    assert {r.node: r.root for r in got} == to and len(got) == len(to)
    assert P.connected(spark.createDataFrame([], "a long, b long"), str(tmp_path)).collect() == []


def test_keys_of_names_are_never_broadcast(spark, tmp_path):
    """Names on disk look small beside their keys."""
    rows = [(k, f"Ana{k % 7} Bel{k}", f"Ana{k % 7}", f"Bel{k}") for k in range(50)]
    spark.createDataFrame(rows, "id long, name string, first string, last string").write.parquet(f"{tmp_path}/names")
    df = spark.read.parquet(f"{tmp_path}/names")
    people = df.withColumns({"messages": df["id"], "nickname": df["first"], "name_id": df["id"]})
    for met in (M.agreeing_names(people), P.name_pairs(df, df)):
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    plan = M.link_candidates(people, people)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [key#" in line]

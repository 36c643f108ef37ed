"""Order statistics, payloads, corrections, merged tables, deliveries and caches, by example and against plain Python."""

import json
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from gristmill.operators import payloads as J
from gristmill.operators import quantiles as Q
from gristmill.operators import sequences as S
from gristmill.operators import speech as H
from gristmill.plans import mechanisms
from gristmill.sources.versions import MergedTable
from gristmill.streaming import incremental as I
from gristmill.streaming.outbox import AnswerCache, Outbox, store_once

# --- order statistics ---


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_order_statistics(spark, bins):
    """One group of all rows, values of every size, repeats, and groups of one or two rows."""
    rng = random.Random(bins)
    values = [rng.choice([0.0, -1.5, 3.0, 1e300, -1e300, 5e-324, rng.gauss(0, 1), rng.random() * 1e-9]) for _ in range(500)]
    rows = [("hot", v) for v in values] + [("one", 2.5), ("two", 1.0), ("two", 9.0), (None, 4.0), ("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: tuple(r)[1:] for r in Q.order_statistics(df, ["k"], "v", {"m": Q.upper_median, "p90": Q.nearest_rank(90), "tenth": lambda n: n - n + 10}, bins).collect()}
    for k in ("hot", "one", "two", None):
        v = sorted(x for g, x in rows if g == k and x is not None and not math.isnan(x))
        assert got[k] == (len(v), v[len(v) // 2], v[math.ceil(0.9 * len(v)) - 1], v[9] if len(v) > 9 else None)
    assert set(got) == {"hot", "one", "two", None}


def test_order_statistics_of_integers_and_nothing(spark):
    df = spark.createDataFrame([(1, k * k) for k in range(101)], "k int, v long")
    r = Q.order_statistics(df, ["k"], "v", {"m": Q.upper_median}, 4).first()
    assert (r.n, r.m) == (101, 2500)
    assert Q.order_statistics(df.limit(0), ["k"], "v", {"m": Q.upper_median}).count() == 0


# --- payloads ---


def test_payloads(spark):
    good = {"k": 3, "device": {"os": "ios", "ver": "1"}, "tags": ["a"], "items": [{"sku": 1, "qty": 2}, {"sku": 5, "qty": None}]}
    rows = [(1, json.dumps(good)), (2, None), (3, "  "), (4, '{"k": 1, "device": {"os"'), (5, '{"device": null}'), (6, '{"k": {"no": "number"}}'), (7, "[1, 2]"), (8, "no json"), (9, '{"k": 4, "more": [1]}'), (10, '{"k": null}')]
    p = J.parsed(spark.createDataFrame(rows, "id long, props string"), "props", "click")
    assert {r.id: r.reason for r in p.collect()} == {1: None, 2: "missing", 3: "missing", 4: "broken", 5: "incomplete", 6: "broken", 7: "broken", 8: "broken", 9: None, 10: "incomplete"}
    assert sorted((r.outcome, r.n) for r in J.counts(p).collect()) == [("broken", 4), ("incomplete", 2), ("kept", 2), ("missing", 2)]
    assert {r.id: r.props for r in J.broken(p, "props", "id").collect()}[4] == rows[3][1]
    kept = {r.id: r.payload for r in J.kept(p).collect()}
    assert kept[1].asDict(True) == good and kept[9].k == 4
    assert json.loads(J.kept(p).filter("id = 1").select(J.encoded(F.col("payload")).alias("t")).first().t)["items"][0] == {"sku": 1, "qty": 2}


def test_every_schema_parses_its_own_rows(spark):
    for kind in J.SCHEMAS:
        p = J.parsed(spark.createDataFrame([("{}",), ("x",)], "t string"), "t", kind)
        assert sorted(r.reason for r in p.collect()) == ["broken", "incomplete"]


def test_every_job_has_an_outcome(spark):
    jobs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "job_id long")
    results = spark.createDataFrame([(1, '{"facts": []}', None), (2, None, "503"), (3, "cut off {", None), (1, "later and broken", None)], "job_id long, response string, error string")
    got = {r.job_id: (r.payload is not None, r.reason) for r in J.by_job(results, jobs, "document_facts").collect()}
    assert got == {1: (True, None), 2: (False, "failed"), 3: (False, "broken"), 4: (False, "failed")}


# --- corrections ---


def test_corrected(spark):
    texts = [(1, "The piotre, and  an ozzol! (jewel)"), (2, "the real word stays"), (3, None), (4, ""), (5, "Marcos and marcus"), (6, "piotre piotre's xyzzyq")]
    words = [("real",), ("word",), ("stays",), ("the",)]
    vocabulary = [("Piotr",), ("ozzle",), ("Marcus",), ("two words",), ("stayz",)]
    got = H.corrected(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(vocabulary, "term string"), spark.createDataFrame(words, "word string"), {"JUUL": ("jewel", "chu"), "Oz hole": ("oz whole",)})
    assert {r.id: (r.text, r.changed) for r in got.collect()} == {
        1: ("The Piotr, and  an ozzle! (JUUL)", True),
        2: ("the real word stays", False), 3: (None, False), 4: ("", False), 5: ("Marcus and marcus", True), 6: ("Piotr piotre's xyzzyq", True),
    }


def test_fixed_map_takes_whole_words(spark):
    df = spark.createDataFrame([("Jewel jewels JEWEL",)], "t string")
    assert df.select(H.fixed_map(F.col("t"), {"$J\\": ("jewel",)}).alias("t")).first().t == "$J\\ jewels $J\\"


# --- merged tables ---


def table(spark, tmp_path):
    return MergedTable(spark, f"{tmp_path}/{uuid.uuid4().hex}", "id long, name string, n long", ["id"], buckets=4)


def rows_of(t, version=None):
    return sorted(tuple(r) for r in t.read(version).collect())


def test_merge_modes(spark, tmp_path):
    t = table(spark, tmp_path)
    f = lambda rows: spark.createDataFrame(rows, "id long, name string, n long, at int")
    assert rows_of(t) == [] and t.version() == 0
    assert t.merge(f([(1, "b", 1, 2), (1, "a", 2, 1), (2, "x", 5, 1)]), "add", "b1", ["at"], ["n"]) == 1
    assert rows_of(t) == [(1, "a", 3), (2, "x", 5)]
    t.merge(f([(1, "z", 10, 1), (3, "new", 1, 1)]), "add", "b2", ["at"], ["n"])
    assert rows_of(t) == [(1, "a", 13), (2, "x", 5), (3, "new", 1)]
    t.merge(f([(2, "y", 0, 1), (2, "yy", 7, 2), (4, "four", 4, 1)]), "replace", "b3", ["at"])
    t.merge(f([(2, "never", 0, 1), (5, "five", 5, 1)]), "ignore", "b4", ["at"])
    assert rows_of(t) == [(1, "a", 13), (2, "yy", 7), (3, "new", 1), (4, "four", 4), (5, "five", 5)]
    assert rows_of(t, 1) == [(1, "a", 3), (2, "x", 5)]  # versions before are still there
    assert t.merge(f([]), "add", "nothing", ["at"], ["n"]) == 5 and len(rows_of(t)) == 5


def test_replayed_batch_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    rows = spark.createDataFrame([(k, "a", 1) for k in range(20)], "id long, name string, n long")
    t.merge(rows, "add", "one", add=["n"])
    assert t.merge(rows, "add", "one", add=["n"]) == 1 and {r[2] for r in rows_of(t)} == {1}


def test_failed_merge_leaves_the_version_before(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, name string, n long"), "add", "one", add=["n"])
    bad = spark.range(40).select("id", F.lit("x").alias("name"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.lit(1)).cast("long").alias("n"))
    with pytest.raises(Exception, match="lost"):
        t.merge(bad, "add", "two", add=["n"])
    assert t.version() == 1 and rows_of(t) == [(1, "a", 1), (2, "b", 1)]
    t.merge(spark.range(40).select("id", F.lit("x").alias("name"), F.lit(1).cast("long").alias("n")), "add", "two", add=["n"])
    assert len(rows_of(t)) == 40 and rows_of(t)[1] == (1, "a", 2)
    assert len(t.unused()) > 0 and not any(f in t.unused() for f in t._folders(2).values())


# --- deliveries ---


def test_outbox_stream_that_fails_between_sending_and_writing_down(spark, tmp_path):
    src, received, acks, state = (f"{tmp_path}/{x}" for x in ("src", "received", "acks", "state"))
    for k in range(4):
        spark.createDataFrame([(k * 10 + i, f"q{i}") for i in range(5)], "id long, question string").coalesce(1).write.mode("append").parquet(src)
    box, receive = Outbox(spark, acks), store_once(spark, received, "id long, question string", "id")
    sent = []

    def send(batch):
        ids = receive(batch)
        sent.append(sorted(r.id for r in ids.collect()))
        if len(sent) == 3:
            raise RuntimeError("lost after sending")
        return ids

    stream = lambda: I.event_stream(spark, src, "id long, question string")
    with pytest.raises(Exception, match="lost after sending"):
        I.drain(stream(), "", state, sink=box.sink(send))
    rows = spark.read.parquet(src)
    assert box.marked(rows).filter("uploaded").count() == 10 and spark.read.parquet(received).count() == 15  # stored, but not known to be
    known = {r.id for r in box.acknowledged().collect()}
    assert [r.id for r in box.pending(rows, 3).collect()] == sorted({r.id for r in rows.collect()} - known)[:3]
    I.drain(stream(), "", state, sink=box.sink(send))
    assert sent[3] == sent[2] and box.marked(rows).filter("not uploaded").count() == 0
    assert spark.read.parquet(received).count() == 20  # what was sent twice is stored once


def test_outbox_flags_only_what_was_accepted(spark, tmp_path):
    box = Outbox(spark, f"{tmp_path}/acks")
    rows = spark.createDataFrame([(k,) for k in range(6)], "id long")
    box.deliver(box.pending(rows, 4), "a", lambda b: b.filter("id % 2 = 0"))
    assert [r.id for r in box.pending(rows).collect()] == [1, 3, 4, 5]
    box.deliver(box.pending(rows), "a", lambda b: 1 / 0)  # the log has this batch
    with pytest.raises(ZeroDivisionError):
        box.deliver(box.pending(rows), "b", lambda b: 1 / 0)
    assert box.pending(rows).count() == 4


# --- caches ---


def test_cache_stores_successes_alone(spark, tmp_path):
    cache, asked = AnswerCache(spark, f"{tmp_path}/cache"), []
    jobs = spark.createDataFrame([(1, "fa", "a"), (2, "fb", "b"), (3, "fa", "a")], "job_id long, fingerprint string, prompt string")

    def ask(fails):
        def of(misses):
            asked.append(sorted(r.fingerprint for r in misses.collect()))
            return misses.select("fingerprint", F.when(~F.col("fingerprint").isin(*fails), F.upper("prompt")).alias("payload"))

        return of

    one = {r.job_id: (r.payload, r.source) for r in cache.answered(jobs, ask(["fb"]), "m").collect()}
    assert one == {1: ("A", "fresh"), 2: (None, "failed"), 3: ("A", "fresh")}
    two = {r.job_id: (r.payload, r.source) for r in cache.answered(jobs, ask(["none"]), "m").collect()}
    assert two == {1: ("A", "stored"), 2: ("B", "fresh"), 3: ("A", "stored")} and asked == [["fa", "fb"], ["fb"]]
    assert cache.compact() == 1 and cache.stored().count() == 2
    assert {r.source for r in cache.answered(jobs, ask([]), "m").collect()} == {"stored"} and asked[-1] == []


# --- pages ---


def test_pages_cover_all_rows_once(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("k")).repartition(5)
    want = [r.id for r in df.orderBy("k", "id").collect()]
    got = [r.id for at in range(0, 100, 30) for r in S.page_at(df, at, 30, "k", "id").orderBy("place").collect()]
    assert got == want and S.page_at(df, 100, 5, "k", "id").count() == 0


def test_recall_leaves_the_last_turns_out(spark):
    turns = spark.createDataFrame([(k, "water and bikes" if k % 2 else "water") for k in range(10)], "id long, text string")
    terms = spark.createDataFrame([(1, "water", 1), (1, "bikes", 1)], "qid int, term string, n long")
    assert [(r.id, r.hits) for r in S.recall(turns, terms, limit=3).orderBy("r").collect()] == [(5, 2), (3, 2), (1, 2)]


# --- queries that SQL has no twin for ---


def test_chat_links_are_what_going_through_in_order_gives(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.a_id, r.b_id, r.score) for r in mechanisms.link_pairs(spark, d).collect()]
    a, b, want = set(), set(), []
    for x, y, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            want.append((x, y, s))
    assert sorted(tuple(r) for r in mechanisms.chat_links(spark, d).collect()) == sorted(want) and want

"""Streams give what batches give."""

from pyspark.sql import functions as F

from gristmill.operators.gaps import review, rollup
from gristmill.streaming import incremental as I


def parts(spark, df, path, n=3):
    for k in range(n):
        df.filter(F.pmod(F.hash("id"), F.lit(n)) == k).coalesce(1).write.mode("append").parquet(str(path))
    return I.event_stream(spark, str(path), df.schema)


def test_approvals_follow_the_state_not_the_arrival(spark, tmp_path):
    rows = [(s, s % 4, ("pending", "approved", "rejected")[s % 3]) for s in range(24)]
    df = spark.createDataFrame(rows, "seq long, id long, status string")
    for k, part in enumerate((rows[12:], rows[:12])):  # late events arrive last
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = I.event_stream(spark, str(tmp_path / "in"), df.schema)
    got = {}

    def keep(batch, _):
        got.update({r.id: (r.status, r.approved_seq) for r in batch.collect()})

    I.drain(I.approvals(stream), "", str(tmp_path / "state"), "update", keep)
    assert got == {r.id: (r.status, r.approved_seq) for r in review(df).collect()}


def test_gap_rollup(spark, tmp_path):
    df = spark.createDataFrame([(k, ("Where is the pump?", "pump where", "who is Ana")[k % 3], ("I don't know", "By the tank")[k % 2], None if k % 5 else True, k) for k in range(40)], "id int, question string, answer string, unanswered boolean, asked_at int")
    stream = parts(spark, df, tmp_path / "in")
    I.drain(I.gaps(stream), "", str(tmp_path / "s"), "complete", I.snapshot(str(tmp_path / "out")))
    from gristmill.operators.gaps import is_gap

    want = rollup(df.withColumn("gap", is_gap(F.col("unanswered"), F.col("answer")))).drop("answered")
    key = lambda d: sorted(map(tuple, d.select("gap_key", "asks", "question", "last_asked").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(want)


def test_numbers_go_on_and_replays_change_nothing(spark, tmp_path):
    df = spark.createDataFrame([(k,) for k in range(30)], "id int")
    write = I.append_numbered(str(tmp_path / "out"), "id")
    write(df.filter("id < 10"), 0)
    write(df.filter("id >= 10"), 1)
    write(df.filter("id >= 10"), 1)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 31)) and [r.id for r in rows] == list(range(30))


def test_retries_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([(k % 7, f"2024-01-0{1 + k // 7} 00:00:00") for k in range(14)], "id int, t string").select("id", F.to_timestamp("t").alias("t"))
    stream = parts(spark, df, tmp_path / "in")
    I.drain(I.idempotent(stream, "id", "t"), str(tmp_path / "out"), str(tmp_path / "s"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(7))

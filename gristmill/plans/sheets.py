"""Named queries: composition and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.shared import shared_dir
from gristmill.operators import compose as K
from gristmill.plans.registry import query
from gristmill.plans.search import DOCS_SQL, first_word_sql, read, readable_documents, story_search, terms
from gristmill.streaming import incremental as I


def layers(spark, d):
    docs = readable_documents(spark, d).join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    talk = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    lore = story_search(spark, d).join(talk, "id")
    line = lambda: F.concat(F.lit("- "), T.clip(T.squeeze(F.col("text"))))
    return docs.select("qid", F.lit("docs").alias("layer"), "rank", line().alias("line"), "text").unionByName(lore.select("qid", F.lit("lore").alias("layer"), "rank", line().alias("line"), "text"))


@query("layer_ranking", f"""
WITH {DOCS_SQL.replace("r AS (SELECT f.*, passage", "ra AS (SELECT f.*, passage")},
r AS (SELECT qid, doc_id FROM ra WHERE rank <= 2),
c AS (SELECT r.qid, r.doc_id, count(*) FILTER (WHERE {first_word_sql('lower(text)', 'term')}) AS n FROM r JOIN documents USING (doc_id) JOIN terms ON terms.qid = r.qid GROUP BY ALL),
l AS (SELECT qid, 'docs' AS layer, max(n) AS coverage FROM c GROUP BY qid UNION ALL SELECT DISTINCT qid, 'camp', 0 FROM terms)
SELECT qid, layer, coverage::INT AS coverage, row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, CASE layer WHEN 'camp' THEN 0 ELSE 1 END)::INT AS place FROM l""")
def layer_ranking(spark, d):
    return K.rank_layers(layers(spark, d).filter("layer = 'docs'"), terms(spark))


@query("fact_sheets")
def fact_sheets(spark, d):
    """Sheets per question; checked by example in the tests."""
    return K.fact_sheet(layers(spark, d), terms(spark))


def _drained(spark, d, build, mode="append"):
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = I.event_stream(spark, f"{d}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    I.drain(build(stream), f"{base}/out", f"{base}/state", mode, I.snapshot(f"{base}/out") if mode == "complete" else None)
    return spark.read.parquet(f"{base}/out")


@query("stream_daily_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    out = _drained(spark, d, lambda s: I.counts(s, "ts", "event_type"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("stream_idempotent", "SELECT event_id, user_id FROM events")
def stream_idempotent(spark, d):
    return _drained(spark, d, lambda s: I.idempotent(s.unionAll(s), "event_id", "ts").select("event_id", "user_id"))

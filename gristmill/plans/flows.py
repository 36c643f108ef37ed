"""Named queries: ordered data, evidence, gaps, graphs of co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.dates import gap_phrase
from gristmill.operators import evidence as E
from gristmill.operators import gaps as G
from gristmill.operators import sequences as S
from gristmill.plans.registry import query
from gristmill.plans.search import read

GAP_STOP = "[" + ", ".join(f"'{w}'" for w in T.GAP_STOP_WORDS) + "]"
NORM_SQL = (
    "coalesce(nullif(array_to_string(list_sort(list_filter(regexp_split_to_array(lower(replace({0}, '’', '''')), '[^a-z0-9]+'), "
    f"lambda w: length(w) > 1 AND NOT list_contains({GAP_STOP}, w))), ' '), ''), trim(regexp_replace(lower(replace({{0}}, '’', '''')), '[^a-z0-9]+', ' ', 'g')))"
)
REFUSE = "(" + " OR ".join("contains(replace(replace(lower({0}), '’', ''''), 'do not', 'don''t'), '" + r.replace("'", "''") + "')" for r in T.REFUSALS) + ")"


@query("sessions", """
WITH f AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 90 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM f),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) - 1) // 30 AS part FROM s)
SELECT user_id, session, part, count(*) AS rows, 0::BIGINT AS words FROM p GROUP BY ALL HAVING count(*) >= 2""")
def sessions(spark, d):
    s = S.sessions(read(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id")
    return S.kept_sessions(s, "user_id", min_rows=2)


@query("month_windows", """
WITH RECURSIVE m AS (SELECT o_custkey % 5 AS k, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY m) AS i, count(*) OVER (PARTITION BY k) AS last FROM m),
r AS (SELECT k, i, m AS first, m AS upto, n, n >= 60 AS isfull, 1 AS w FROM o WHERE i = 1
      UNION ALL SELECT o.k, o.i, CASE WHEN r.isfull THEN o.m ELSE r.first END, o.m, CASE WHEN r.isfull THEN o.n ELSE r.n + o.n END,
        CASE WHEN r.isfull THEN o.n ELSE r.n + o.n END >= 60, r.w + CASE WHEN r.isfull THEN 1 ELSE 0 END FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1),
e AS (SELECT k, w, arg_max(first, i) AS first, arg_max(upto, i) AS upto, arg_max(n, i) AS n, arg_max(r.isfull, i) AS isfull FROM r GROUP BY ALL),
t AS (SELECT *, max(w) OVER (PARTITION BY k) AS ws FROM e),
g AS (SELECT k, CASE WHEN w = ws AND NOT isfull AND ws > 1 THEN w - 1 ELSE w END AS w, first, upto, n FROM t)
SELECT k AS cust_group, min(first) AS first_month, max(upto) AS last_month, sum(n)::BIGINT AS rows FROM g GROUP BY k, w""")
def month_windows(spark, d):
    o = read(spark, d, "orders").select((F.col("o_custkey") % 5).alias("cust_group"), "o_orderdate")
    return S.month_windows(o, "cust_group", "o_orderdate", floor=60)


@query("chunks", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) // 25 AS chunk, role FROM conversations")
def chunks(spark, d):
    return S.chunks(read(spark, d, "conversations").select("conv_id", "turn", "role"), 25, "role", "conv_id", "turn")


@query("cap_recent", """
WITH b AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS place FROM b WHERE back <= 10""")
def cap_recent(spark, d):
    return S.most_recent(read(spark, d, "events").select("user_id", "event_id", "ts"), 10, "user_id", "ts", "event_id").select("user_id", "event_id", "place")


@query("fill_down", """
SELECT event_id, last_value(CASE WHEN value > 50 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM events""")
def fill_down(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("value") > 50, F.col("event_type")).alias("label"))
    return S.fill_down(e, "label", "user_id", "ts", "event_id").select("event_id", "label")


@query("runs", """
WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM c""")
def runs(spark, d):
    return S.runs(read(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), "event_type", "user_id", "ts", "event_id").select("event_id", "run")


@query("char_budget", """
WITH s AS (SELECT source, doc_id, n_chars + 1 AS cost FROM documents),
r AS (SELECT *, sum(cost) OVER w::BIGINT AS spent, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id, spent FROM r WHERE n = 1 OR spent <= 4000""")
def char_budget(spark, d):
    docs = read(spark, d, "documents").select("source", "doc_id", "n_chars")
    return S.within_budget(docs, F.col("n_chars") + 1, 4000, "source", "doc_id", large=True).select("source", "doc_id", "spent")


@query("stratified_split", """
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id) AS n, count(*) OVER (PARTITION BY source) AS k FROM documents)
SELECT doc_id, source, n <= floor(k * 0.2) AS held_out FROM r""")
def stratified_split(spark, d):
    return S.stratified_split(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 0.2, "7")


@query("keyset_page", "SELECT event_id, user_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 500")
def keyset_page(spark, d):
    return S.page(read(spark, d, "events").select("event_id", "user_id"), "event_id", 100, 9999)


@query("latest_edition", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def latest_edition(spark, d):
    return S.latest_edition(read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y")), "y").select("o_orderkey")


@query("weekday_rota", """
SELECT *, row_number() OVER (ORDER BY CASE dow WHEN 'Sun' THEN 0 WHEN 'Mon' THEN 1 WHEN 'Tue' THEN 2 WHEN 'Wed' THEN 3 WHEN 'Thu' THEN 4 WHEN 'Fri' THEN 5 ELSE 6 END, event_type)::INT AS place
FROM (SELECT strftime(ts, '%a') AS dow, event_type, count(*) AS n FROM events GROUP BY ALL)""")
def weekday_rota(spark, d):
    e = read(spark, d, "events").select(F.date_format("ts", "E").alias("dow"), "event_type").groupBy("dow", "event_type").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*[F.lit(x) for x in ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")]), F.col("dow"))
    return e.withColumn("place", F.row_number().over(Window.orderBy(place, "event_type")))


@query("vocabulary_budget", """
WITH v AS (SELECT p_name AS name, 'thing' AS source, row_number() OVER (ORDER BY p_name) AS rank FROM (SELECT DISTINCT p_name FROM part)
           UNION ALL SELECT n_name, 'person', row_number() OVER (ORDER BY n_name) FROM nation),
u AS (SELECT *, CASE source WHEN 'person' THEN 0 ELSE 1 END AS tier FROM v),
k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY tier, rank, name) = 1),
c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY rank, name) <= CASE source WHEN 'person' THEN 15 ELSE 25 END)
SELECT name, source, rank::INT AS rank, row_number() OVER (ORDER BY tier, rank, name)::INT AS place FROM c QUALIFY place <= 30""")
def vocabulary_budget(spark, d):
    things = read(spark, d, "part").select(F.col("p_name").alias("name")).distinct().select("name", F.lit("thing").alias("source"), F.row_number().over(Window.orderBy("name")).alias("rank"))
    people = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("person").alias("source"), F.row_number().over(Window.orderBy("n_name")).alias("rank"))
    return S.round_robin(things.unionByName(people), "name", {"person": 15, "thing": 25}, 30)


@query("latest_per_key", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, max(ts)::VARCHAR AS at, arg_max(value, (value, event_id)) AS most FROM events GROUP BY user_id")
def latest_per_key(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.max("ts").cast("string").alias("at"), F.max_by("value", F.struct("value", "event_id")).alias("most"))


@query("earliest_per_pair", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def earliest_per_pair(spark, d):
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("evidence_complete", "SELECT 'orders' AS claim_table, o_orderkey AS claim_id FROM orders WHERE NOT EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) UNION ALL SELECT 'part', p_partkey FROM part WHERE NOT EXISTS (FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def evidence_complete(spark, d):
    lines = read(spark, d, "lineitem").filter("l_quantity > 45")
    ev = lines.select(F.lit("orders").alias("claim_table"), F.col("l_orderkey").alias("claim_id")).unionByName(lines.select(F.lit("part").alias("claim_table"), F.col("l_partkey").alias("claim_id")))
    return E.unevidenced({"orders": (read(spark, d, "orders"), "o_orderkey"), "part": (read(spark, d, "part"), "p_partkey")}, ev)


@query("dangling_evidence", "SELECT 'orders' AS source_table, l_orderkey AS source_id, l_linenumber::BIGINT AS claim_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)")
def dangling_evidence(spark, d):
    ev = read(spark, d, "lineitem").select(F.lit("orders").alias("source_table"), F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").cast("long").alias("claim_id"))
    return E.dangling(ev, {"orders": (read(spark, d, "orders").filter("o_totalprice > 100000"), "o_orderkey")})


@query("quote_verify", r"""
WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS quote FROM benchmark),
t AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS text FROM documents)
SELECT item_id, doc_id FROM q JOIN t ON contains(text, quote) WHERE quote <> ''""")
def quote_verify(spark, d):
    """Documents that hold a whole benchmark passage: nominated by the passage's longest inner word, decided by the passage."""
    q = read(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"), T.words(F.col("text")).alias("ws"))
    inner = F.slice("ws", F.lit(2), F.greatest(F.size("ws") - 2, F.lit(0)))  # the first and last may be part of a longer word
    long = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    k = q.select("item_id", "quote", F.coalesce(long, F.lit("")).alias("term"))
    docs = read(spark, d, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.concat(T.words(F.col("text")), F.array(F.lit(""))))).alias("term"))
    pairs = words.join(k.select("item_id", "term"), "term").select("doc_id", "item_id")
    return pairs.join(docs, "doc_id").join(k.select("item_id", "quote"), "item_id").filter(T.quote_verified(F.col("text"), F.col("quote"))).select("item_id", "doc_id")


@query("gap_key", f"SELECT conv_id, turn, {NORM_SQL.format('text')} AS normal, sha256({NORM_SQL.format('text')}) AS gap_key FROM conversations")
def gap_key(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.normalise_question(F.col("text")).alias("normal"), T.gap_key(F.col("text")).alias("gap_key"))


@query("gap_rollup", f"""
WITH p AS (SELECT conv_id, turn, text AS question, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sha256({NORM_SQL.format('question')}) AS gap_key FROM p WHERE role = 'user' AND coalesce(CASE WHEN answer IS NULL THEN true END, {REFUSE.format('answer')}, false) OR role = 'user' AND conv_id % 3 = 0),
a AS (SELECT DISTINCT sha256({NORM_SQL.format('question')}) AS gap_key FROM p WHERE role = 'user' AND conv_id % 9 = 0)
SELECT gap_key, count(*) AS asks, arg_max(question, (turn, conv_id)) AS question, max(turn) AS last_asked, gap_key IN (SELECT gap_key FROM a) AS answered FROM g GROUP BY gap_key""")
def gap_rollup(spark, d):
    t = G.turns(read(spark, d, "conversations"))
    gap = G.is_gap(F.when(F.col("answer").isNull(), F.lit(True)), F.col("answer")) | (F.col("conv_id") % 3 == 0)
    log = t.select("question", F.col("turn").alias("asked_at"), F.col("conv_id").alias("id"), gap.alias("gap"))
    return G.rollup(log, t.filter("conv_id % 9 = 0").select("question", F.lit("approved").alias("status")))


@query("refusals", f"SELECT conv_id, turn, {REFUSE.format('text')} AS refusal FROM conversations")
def refusals(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.is_refusal(F.col("text")).alias("refusal"))


@query("idempotent_upsert", "SELECT user_id AS id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def idempotent_upsert(spark, d):
    return G.upsert_first(read(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", "event_type"), "id", "event_id")


@query("review_states", """
WITH e AS (SELECT event_id AS seq, user_id AS id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'view' THEN 'pending' ELSE 'rejected' END AS status FROM events)
SELECT id, arg_max(status, seq) AS status, min(seq) FILTER (WHERE status = 'approved') AS approved_seq FROM e GROUP BY id""")
def review_states(spark, d):
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "view", "pending").otherwise("rejected")
    return G.review(read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), status.alias("status")))


@query("sequence_numbers", "SELECT event_id, 1000 + row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def sequence_numbers(spark, d):
    return G.assign_sequence(read(spark, d, "events").select("event_id", "ts"), 1000, "ts", "event_id").select("event_id", "seq")


@query("relationship_pairs", """
WITH m AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
SELECT a.s AS a, b.s AS b, count(*) AS shared, min(a.p) AS first_shared FROM m a JOIN m b ON a.p = b.p AND a.s < b.s GROUP BY ALL HAVING count(*) >= 2""")
def relationship_pairs(spark, d):
    """Suppliers that share two parts or more."""
    m = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).filter("s is not null and p is not null").distinct()
    return G.sharing(m, "s", "p").filter("shared >= 2")


@query("co_mentions", """
WITH n AS (SELECT unnest(['the', 'and', 'der', 'und', 'les', 'que', 'para', 'with']) AS name),
m AS (SELECT DISTINCT doc_id, w AS name FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents) WHERE w IN (SELECT name FROM n))
SELECT a.name AS a, b.name AS b, count(*) AS n, round(least(count(*) / 10.0::DOUBLE, 1), 6) AS weight FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.name < b.name GROUP BY ALL HAVING count(*) >= 3""".replace("\\\\", "\\"))
def co_mentions(spark, d):
    """Names of a short list met in one document: pairs of a document stay within the list's size."""
    names = T.strings(("the", "and", "der", "und", "les", "que", "para", "with"))
    m = read(spark, d, "documents").select(F.array_sort(F.array_intersect(T.words(F.col("text")), names)).alias("ns"))
    pairs = F.flatten(F.transform("ns", lambda a: F.transform(F.filter("ns", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    out = m.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).filter("n >= 3")
    return out.withColumn("weight", F.round(F.least(F.col("n") / 10.0, F.lit(1.0)), 6))


@query("contradictions", """
WITH f AS (SELECT source AS entity_id, 'c' || doc_id % 3 AS category, doc_id AS fact_id, (2000 + doc_id % 7)::INT AS asserted_on,
             (contains(lower(text), 'no ') OR contains(lower(text), 'not ') OR contains(lower(text), 'never ') OR contains(lower(text), 'zero ') OR contains(lower(text), 'none')) AS neg FROM documents),
p AS (SELECT y.entity_id, y.category, y.fact_id AS x, n.fact_id AS z, y.asserted_on < n.asserted_on AS older FROM f y JOIN f n ON y.entity_id = n.entity_id AND y.category = n.category AND y.asserted_on <> n.asserted_on AND y.neg <> n.neg AND y.fact_id < n.fact_id),
o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY entity_id, category ORDER BY x, z) = 1)
SELECT entity_id, category, CASE WHEN older THEN x ELSE z END AS earlier, CASE WHEN older THEN z ELSE x END AS later FROM o""")
def contradictions(spark, d):
    f = read(spark, d, "documents")
    return E.contradictions(f.select(F.col("source").alias("entity_id"), F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("category"), F.col("doc_id").alias("fact_id"), (2000 + F.col("doc_id") % 7).cast("int").alias("asserted_on"), F.col("text").alias("fact")))


@query("strengths", "SELECT o_custkey AS person_id, o_orderpriority AS topic, count(DISTINCT o_orderkey) AS sources, CASE WHEN count(DISTINCT o_orderkey) >= 3 THEN 'strong' WHEN count(DISTINCT o_orderkey) = 2 THEN 'moderate' ELSE 'mentioned' END AS strength FROM orders GROUP BY ALL")
def strengths(spark, d):
    return E.counted_strength(read(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("topic"), F.col("o_orderkey").alias("source_id")), "person_id", "topic")


@query("job_prompts", "SELECT conv_id, string_agg('[' || turn || '] ' || role || ': ' || text, chr(10) ORDER BY turn) AS prompt, sha256(string_agg(turn::VARCHAR, ',' ORDER BY turn)) AS shown FROM conversations GROUP BY conv_id")
def job_prompts(spark, d):
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), F.col("text"))
    j = E.jobs(read(spark, d, "conversations"), "conv_id", line, "turn", "turn")
    return j.select("conv_id", "prompt", F.sha2(F.array_join(F.col("shown").cast("array<string>"), ","), 256).alias("shown"))


@query("shrink_gate", """
WITH c AS (SELECT 'part' AS "table", count(*) AS rows FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'nation', count(*) FROM nation),
b("table", baseline) AS (VALUES ('part', 100000000), ('nation', 25), ('ghost', 5))
SELECT coalesce(c."table", b."table") AS "table", rows, baseline::BIGINT AS baseline,
  CASE WHEN baseline IS NULL THEN 'new' WHEN rows IS NULL THEN 'vanished' WHEN rows <= baseline * 0.75 THEN 'shrunk' ELSE 'ok' END AS verdict FROM c FULL JOIN b ON c."table" = b."table" """)
def shrink_gate(spark, d):
    now = E.table_counts({t: read(spark, d, t) for t in ("part", "orders", "nation")})
    return E.shrinkage(now, spark.createDataFrame([("part", 100000000), ("nation", 25), ("ghost", 5)], "table string, rows long"))


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")))
def table_counts(spark, d):
    return E.table_counts({t: read(spark, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")})


@query("gap_phrases", """
WITH p AS (SELECT o_orderkey, o_orderdate::DATE AS b, lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a FROM orders), x AS (SELECT o_orderkey, date_diff('day', a, b) AS d FROM p)
SELECT o_orderkey, CASE WHEN d <= 0 THEN 'the same day' WHEN d = 1 THEN 'the next day' WHEN d < 14 THEN d || ' days later' WHEN d <= 60 THEN 'a few weeks later' WHEN d <= 400 THEN 'months later' WHEN d > 400 THEN 'years later' ELSE 'later' END AS phrase FROM x""")
def gap_phrases(spark, d):
    before = F.lag(F.to_date("o_orderdate")).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey", gap_phrase(before, F.to_date("o_orderdate")).alias("phrase"))


@query("cache_misses", """
SELECT doc_id FROM documents WHERE sha256('v1' || chr(0) || coalesce(lang, '') || chr(0) || text || chr(0)) NOT IN (SELECT sha256('v1' || chr(0) || coalesce(lang, '') || chr(0) || text || chr(0)) FROM documents WHERE doc_id % 3 = 0)""")
def cache_misses(spark, d):
    jobs = read(spark, d, "documents").select("doc_id", E.fingerprint(F.lit("v1"), F.col("lang"), F.col("text")).alias("fingerprint"))
    return E.cache_misses(jobs, jobs.filter("doc_id % 3 = 0").select("fingerprint", F.lit("{}").alias("payload"))).select("doc_id")

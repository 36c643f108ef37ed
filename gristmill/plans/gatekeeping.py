"""Named queries: gates, evidence behind facts, vectors' forms, retrieval cases, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import compose as K
from gristmill.operators import evidence as E
from gristmill.operators import gates as G
from gristmill.operators import knowledge as N
from gristmill.operators import redact as X
from gristmill.operators import retrieve as R
from gristmill.operators import vectors as V
from gristmill.plans.registry import query
from gristmill.plans.search import read
from gristmill.plans.words import sql_pattern


@query("table_floors", """
WITH c AS (SELECT 'part' AS "table", count(*) AS rows FROM part UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region),
f("table", floor) AS (VALUES ('part', 100000000), ('nation', 25), ('region', 1), ('ghost', 5))
SELECT f."table", rows, floor::BIGINT AS floor, CASE WHEN rows IS NULL THEN 'missing' WHEN rows < floor THEN 'below' ELSE 'ok' END AS verdict FROM f LEFT JOIN c ON c."table" = f."table" """)
def table_floors(spark, d):
    return G.floors({t: read(spark, d, t) for t in ("part", "nation", "region")} | {"ghost": None}, {"part": 100000000, "nation": 25, "region": 1, "ghost": 5})


@query("structural_gate", "SELECT 'ghost' AS \"table\", 'absent' AS complaint UNION ALL SELECT 'none', 'empty' WHERE (SELECT count(*) FROM part WHERE p_size < 0) = 0")
def structural_gate(spark, d):
    tables = {"part": read(spark, d, "part"), "none": read(spark, d, "part").filter("p_size < 0"), "nation": read(spark, d, "nation"), "ghost": None}
    return G.structural(tables, ("part", "ghost"), ("nation", "none"))


@query("absent_table", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, 'there' AS found FROM nation")
def absent_table(spark, d):
    """One table that is there and one that isn't, read alike."""
    there, not_there = (G.table_or_empty(spark, f"{d}/{t}.parquet", read(spark, d, "nation").schema) for t in ("nation", "no_such_table"))
    rows = there.withColumn("found", F.lit("there")).unionByName(not_there.withColumn("found", F.lit("made up")))
    return rows.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", "found")


@query("vector_manifest", "SELECT 'm' || label % 2 AS model, count(*) AS vectors, min(len(embedding))::INT AS shortest, max(len(embedding))::INT AS longest, false AS sound FROM embeddings GROUP BY label % 2")
def vector_manifest(spark, d):
    return G.manifest(read(spark, d, "embeddings").select(F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model"), "embedding"))


@query("vector_coverage", """
WITH w AS (SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> ''), v AS (SELECT DISTINCT vec_id AS doc_id FROM embeddings)
SELECT (SELECT count(*) FROM w) AS wanted, (SELECT count(*) FROM w JOIN v USING (doc_id)) AS covered, (SELECT count(*) FROM v ANTI JOIN w USING (doc_id)) AS stray""")
def vector_coverage(spark, d):
    return G.coverage(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("packed_vectors", "SELECT vec_id, (len(embedding) * 4)::INT AS bytes, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def packed_vectors(spark, d):
    p = read(spark, d, "embeddings").select("vec_id", V.pack(F.col("embedding")).alias("b"))
    total = F.aggregate(V.unpack(F.col("b")), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return p.select("vec_id", F.octet_length("b").alias("bytes"), F.round(total, 6).alias("total"))


@query("unit_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS total FROM embeddings")
def unit_vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(V.normalise(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("text_forms", "SELECT doc_id, sha256('title: ' || coalesce(nullif(trim(source), ''), 'none') || ' | text: ' || text) AS document, 'task: search result | query: ' || lang AS question FROM documents")
def text_forms(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(V.document_form(F.col("source"), F.col("text")), 256).alias("document"), V.query_form(F.col("lang")).alias("question"))


@query("embedded_rows", "SELECT p_partkey, [length(p_name), p_size]::FLOAT[] AS v FROM part WHERE trim(p_name) <> ''")
def embedded_rows(spark, d):
    """A stand-in encoder: the length of a text and the number at its end."""
    p = read(spark, d, "part")
    form = F.concat("p_name", F.lit("|"), F.col("p_size").cast("string"))
    out = V.embed(p, "p_partkey", form, lambda ts: [[len(t.rsplit("|", 1)[0]), float(t.rsplit("|", 1)[1])] for t in ts], 2)
    return out.select("p_partkey", F.col("embedding").alias("v"))


@query("retrieval_cases", """
WITH c AS (SELECT conv_id, list(lower(text)) AS ts FROM conversations GROUP BY conv_id),
v AS (SELECT conv_id, CASE WHEN len(list_filter(ts, lambda t: contains(t, 'the'))) = 0 THEN 'miss' WHEN len(list_filter(ts, lambda t: contains(t, 'zing'))) > 0 THEN 'forbidden' ELSE 'pass' END AS v FROM c)
SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN CASE v WHEN 'pass' THEN 'xpass' ELSE 'xfail' END ELSE v END AS verdict FROM v""")
def retrieval_cases(spark, d):
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("ts"))
    return c.select("conv_id", G.hit_verdict(F.col("ts"), F.array(F.lit("the")), F.array(F.lit("zing")), F.col("conv_id") % 5 == 0).alias("verdict"))


@query("golden_digests", "SELECT conv_id, sha256(string_agg(role || '/' || turn, ',' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def golden_digests(spark, d):
    return G.goldens(read(spark, d, "conversations").withColumn("rank", F.col("turn")), "conv_id", "role", "turn")


@query("attempt_outcomes", """
SELECT user_id AS id, count(*) AS tries, CASE WHEN bool_or(value > 95) THEN 'accepted' WHEN count(CASE WHEN value > 50 THEN 1 END) > 0 THEN 'dropped' ELSE 'unreached' END AS outcome FROM events GROUP BY user_id""")
def attempt_outcomes(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("n"), F.when(F.col("value") > 50, F.col("event_type")).alias("answer"), (F.col("value") > 95).alias("ok"))
    return G.attempts(e)


@query("attributed_facts", """
WITH e AS (SELECT l_orderkey AS claim_id, min(l_partkey) AS source_id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY l_orderkey)
SELECT o_orderkey AS fact_id, source_id, p_name AS title, array_to_string([x for x in [nullif(trim(p_brand), ''), p_type, strftime(o_orderdate, '%-d %b %Y')] if x IS NOT NULL], ' · ') AS line
FROM orders LEFT JOIN e ON claim_id = o_orderkey LEFT JOIN part ON p_partkey = source_id""")
def attributed_facts(spark, d):
    """Orders as facts, lines of two kinds as their evidence, parts as the documents behind it."""
    lines = read(spark, d, "lineitem")
    table = F.when(F.col("l_linestatus") == "F", "document").otherwise("message")
    ev = lines.select(F.when(F.col("l_returnflag") == "R", "camp_fact").otherwise("story").alias("claim_table"), F.col("l_orderkey").alias("claim_id"), table.alias("source_table"), F.col("l_partkey").alias("source_id"))
    part = read(spark, d, "part")
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_type").alias("group"), F.col("p_partkey").alias("person_id"))
    hits = read(spark, d, "orders").select(F.col("o_orderkey").alias("fact_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("on"))
    out = R.attributed(hits, ev, docs, part.select(F.col("p_partkey").alias("person_id"), F.col("p_brand").alias("name")), "camp_fact")
    return out.select("fact_id", "source_id", "title", K.attribution(F.col("name"), F.col("group"), F.col("on")).alias("line"))


@query("cited_rows", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def cited_rows(spark, d):
    ev = read(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "part").otherwise("other").alias("source_table"), F.col("l_partkey").alias("source_id"))
    return E.cited_subset(read(spark, d, "part"), ev, "part", "p_partkey").select("p_partkey")


@query("citations_checked", r"""
WITH c AS (SELECT doc_id % 50 AS job_id, doc_id AS claim_id, CASE WHEN doc_id % 4 = 0 THEN doc_id + 1 WHEN doc_id % 11 = 0 THEN -1 ELSE doc_id END AS source_id, substr(text, 5, 30) AS quote FROM documents),
x AS (SELECT c.*, d.text, d.doc_id IS NOT NULL AND d.doc_id % 50 = job_id OR source_id = -1 AS shown FROM c LEFT JOIN documents d ON d.doc_id = source_id)
SELECT claim_id, CASE WHEN NOT shown THEN 'id not shown' WHEN text IS NULL THEN 'no such source'
  WHEN trim(regexp_replace(quote, '\s+', ' ', 'g')) = '' OR NOT contains(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), trim(regexp_replace(lower(quote), '\s+', ' ', 'g'))) THEN 'quote not in source' END AS reason FROM x""")
def citations_checked(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    job = (F.col("doc_id") % 50).alias("job_id")
    source = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") + 1).when(F.col("doc_id") % 11 == 0, F.lit(-1)).otherwise(F.col("doc_id"))
    claims = docs.select(job, F.col("doc_id").alias("claim_id"), source.alias("source_id"), F.substring("text", 5, 30).alias("quote"))
    shown = docs.select(job, F.col("doc_id").alias("source_id")).unionAll(spark.range(50).select(F.col("id"), F.lit(-1).cast("long")))
    return E.check_citations(claims, shown, docs.select(F.col("doc_id").alias("source_id"), "text")).select("claim_id", "reason")


@query("replaced_by_key", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT o_custkey, -o_orderkey FROM orders WHERE o_custkey % 7 = 0")
def replaced_by_key(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey")
    return E.replace_by_key(o, o.filter("o_custkey % 7 = 0").select("o_custkey", (-F.col("o_orderkey")).alias("o_orderkey")), "o_custkey")


@query("failure_rates", "SELECT count(*) AS total, count(*) FILTER (WHERE value < 10) AS failed, round(count(*) FILTER (WHERE value < 10) / greatest(count(*), 1)::DOUBLE, 6) AS rate, round(count(*) FILTER (WHERE value < 10) / greatest(count(*), 1)::DOUBLE, 6) <= 0.05 AS passes FROM events")
def failure_rates(spark, d):
    return E.failure_rate(read(spark, d, "events"), F.col("value") < 10, 0.05)


@query("manual_facts", "SELECT f.name, f.fact, e.id AS entity_id FROM (VALUES ('red widget', 'old'), ('no such thing', 'x')) f(name, fact) LEFT JOIN (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY p_name) e ON e.p_name = f.name")
def manual_facts(spark, d):
    facts = spark.createDataFrame([("red widget", "old"), ("no such thing", "x")], "name string, fact string")
    found, lost = N.manual_facts(facts, read(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")))
    return found.select("name", "fact", "entity_id").unionByName(lost.withColumn("entity_id", F.lit(None).cast("long")))


@query("blanked_export", "SELECT c_custkey, c_name, NULL::VARCHAR AS c_mktsegment, NULL::DOUBLE AS c_acctbal FROM customer")
def blanked_export(spark, d):
    return X.blanked(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), ("c_mktsegment", "c_acctbal"))


_BARE = sql_pattern(rf"(?i)\bphone\s*[:#][^\n]{{0,40}}?{X.DIGITS}")
_LABEL, _STREET, _TOWN, _BUSINESS = (sql_pattern(p) for p in (X.LABEL, X.STREET, X.TOWN, X.BUSINESS))


@query("gate_in_context", f"""
WITH t AS (SELECT doc_id, text || repeat(' -', 50) || CASE doc_id % 7 WHEN 0 THEN chr(10) || 'Phone: +1 415 555 0199' WHEN 1 THEN ' Acme Rentals phone: 775-555-01000' WHEN 2 THEN ' Ship to: Ana, 12 LONG MEADOW ST UNIT 9' ELSE '' END AS text FROM documents),
s AS (SELECT doc_id, regexp_split_to_array(text, '{_BARE}') AS b, regexp_split_to_array(text, '{_LABEL}') AS a FROM t)
SELECT doc_id, array_to_string([x for x in [CASE WHEN len(b) > 1 AND len(list_filter(b[1:len(b) - 1], lambda x: NOT regexp_matches(right(x, 90), '{_BUSINESS}'))) > 0 THEN 'bare phone' END,
  CASE WHEN len(a) > 1 AND len(list_filter(a[2:], lambda x: regexp_matches(left(x, 200), '{_STREET}') OR regexp_matches(left(x, 200), '{_TOWN}'))) > 0 THEN 'labelled address' END] if x IS NOT NULL], ',') AS found FROM s""")
def gate_in_context(spark, d):
    tail = F.when(F.col("doc_id") % 7 == 0, "\nPhone: +1 415 555 0199").when(F.col("doc_id") % 7 == 1, " Acme Rentals phone: 775-555-01000").when(F.col("doc_id") % 7 == 2, " Ship to: Ana, 12 LONG MEADOW ST UNIT 9").otherwise("")
    t = read(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" -" * 50), tail).alias("text"))
    return t.select("doc_id", F.array_join(X.context_findings(F.col("text")), ",").alias("found"))


@query("leaked_names", r"""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS ws FROM documents),
n(name, a, b) AS (VALUES ('Thonre Is', 'thonre', 'is'), ('of The', 'of', 'the'), ('Ana Stone', 'ana', 'stone'))
SELECT doc_id, name FROM w JOIN n ON list_contains(ws, a) AND list_contains(ws, b)""")
def leaked_names(spark, d):
    return X.leaked_names(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", spark.createDataFrame([("Thonre Is",), ("of The",), ("Ana Stone",)], "name string"))


@query("nominated_facts", "SELECT 1 AS qid, p_partkey, p_name, p_partkey % 10 AS place FROM part WHERE p_partkey % 100 = 7")
def nominated_facts(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_name")
    near = part.filter("p_partkey % 100 = 7").select(F.lit(1).alias("qid"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10).alias("place"))
    return N.by_ids(part, "p_partkey", near, "id").drop("id")

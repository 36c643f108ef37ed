"""Named queries: rules, redaction, names, scoring, pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import people as P
from gristmill.operators import redact as X
from gristmill.operators import rules as U
from gristmill.operators import score as C
from gristmill.plans.registry import query
from gristmill.plans.search import read


def sql_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def sql_pattern(p: str) -> str:
    return p.replace("'", "''")


CATEGORY_SQL = "CASE " + " ".join(f"WHEN {sql_any('path', ws)} THEN '{n}'" for n, ws in U.CATEGORIES) + " ELSE 'general' END"


@query("admission_counts", f"""
WITH d AS (SELECT lower(p_name || ' ' || p_type) AS hay, lower(p_container) AS path, 2016 + p_partkey % 11 AS year FROM (SELECT p_name, p_type, p_brand AS p_container, p_partkey FROM part)),
c AS (SELECT *, {CATEGORY_SQL} AS category FROM d),
a AS (SELECT category, CASE WHEN {sql_any('hay', U.KEEP)} THEN true WHEN {sql_any('hay', U.JUNK)} OR {sql_any('hay', U.ADMIN)} OR category = 'finance' THEN false
  WHEN category = 'shifts' THEN NOT {sql_any('hay', U.GRIDS)} WHEN category IN ('water', 'power', 'bikes', 'burning_man_culture') THEN true ELSE year >= 2024 END AS admitted FROM c)
SELECT category, admitted, count(*) AS n FROM a GROUP BY ALL""")
def admission_counts(spark, d):
    p = read(spark, d, "part").select("p_name", "p_type", U.category_of(F.col("p_brand")).alias("category"), (2016 + F.col("p_partkey") % 11).alias("year"))
    ok = U.admits(F.col("p_name"), F.col("p_type"), F.col("category"), F.col("year"))
    return p.select("category", ok.alias("admitted")).groupBy("category", "admitted").agg(F.count("*").alias("n"))


@query("garbage_texts", r"""
SELECT doc_id, round(length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) / greatest(length(text), 1)::DOUBLE, 6) AS marks,
  length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) / greatest(length(text), 1)::DOUBLE > 0.15 OR NOT regexp_matches(text, '\p{L}') AS garbage FROM documents""")
def garbage_texts(spark, d):
    marks = F.length(F.regexp_replace("text", r"[\p{L}\p{N}\s]", "")) / F.greatest(F.length("text"), F.lit(1))
    return read(spark, d, "documents").select("doc_id", F.round(marks, 6).alias("marks"), U.garbage(F.col("text")).alias("garbage"))


@query("not_people", "SELECT n_nationkey::BIGINT AS id, " + " OR ".join(["length(trim(n_name)) < 2", *(f"regexp_matches(trim(n_name), '{p}')" for p in U.THINGS)]) + " AS thing FROM (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'Olive Oil' UNION ALL SELECT 101, 'OZ' UNION ALL SELECT 102, 'Oz' UNION ALL SELECT 103, '42')")
def not_people(spark, d):
    extra = spark.createDataFrame([(100, "Olive Oil"), (101, "OZ"), (102, "Oz"), (103, "42")], "id long, name string")
    names = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")).unionByName(extra)
    return names.select("id", U.not_a_person(F.col("name")).alias("thing"))


def _always_sql() -> str:
    out = "text"
    for p, to in X.ALWAYS:
        out = f"regexp_replace({out}, '{sql_pattern(p)}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return out


@query("redact_always", f"SELECT doc_id, sha256({_always_sql()}) AS digest, {_always_sql()} <> text AS changed FROM documents")
def redact_always(spark, d):
    t = X.always(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("digest"), (t != F.col("text")).alias("changed"))


@query("pii_scan", "SELECT doc_id, 'text' AS \"column\", finding FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS finding FROM documents WHERE regexp_matches(text, '{sql_pattern(p)}')" for n, p in X.GATE) + ")")
def pii_scan(spark, d):
    return X.findings(read(spark, d, "documents"), "doc_id", ["text"])


@query("redact_contextual")
def redact_contextual(spark, d):
    """No twin in SQL: replacements look at what stands before a match."""
    return X.redact(read(spark, d, "documents").select("doc_id", "text"), "text", ["Thonren Erwh", "Ana"]).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("name_variants", """
WITH n AS (SELECT c_custkey AS id, lower(regexp_replace(c_name, '[^A-Za-z0-9 ]', '', 'g')) AS name FROM customer)
SELECT a.id AS a_id, b.id AS b_id FROM n a JOIN n b ON a.id < b.id AND abs(length(a.name) - length(b.name)) <= 1 AND levenshtein(a.name, b.name) <= 1""")
def name_variants(spark, d):
    n = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.ascii_norm(F.col("c_name")).alias("name"))
    return P.near_spellings(n, n).filter("a_id < b_id")


@query("duplicate_names", """
WITH m AS (SELECT p_partkey AS person_id, p_name AS name, p_size AS messages FROM part),
k AS (SELECT *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS key FROM m)
SELECT person_id, first_value(person_id) OVER (PARTITION BY key ORDER BY messages DESC, person_id) AS survivor, key FROM k""".replace("\\\\", "\\"))
def duplicate_names(spark, d):
    return P.duplicate_names(read(spark, d, "part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"), F.col("p_size").alias("messages")))


@query("components", """
WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) USING KEY (node) AS (SELECT a, a FROM e GROUP BY a UNION
  SELECT e.b, min(r.root) FROM r JOIN e ON e.a = r.node JOIN recurring.r AS now ON now.node = e.b WHERE r.root < now.root GROUP BY e.b)
SELECT node::BIGINT AS node, root::BIGINT AS root FROM r""")
def components(spark, d):
    """Orders and parts, linked by all lines."""
    from gristmill.functions.shared import shared_dir

    lines = read(spark, d, "lineitem").filter("l_orderkey is not null and l_partkey is not null")
    return P.connected(lines.select((F.col("l_orderkey") * 2).cast("long").alias("a"), (F.col("l_partkey") * 2 + 1).cast("long").alias("b")), shared_dir(spark))


@query("jaccard_pairs", r"""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS ws FROM documents),
t AS (SELECT ws, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(ws) AS ws FROM w) GROUP BY ws),
x AS (SELECT rep, unnest(ws) AS term FROM t),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common FROM x a JOIN x b ON a.term = b.term AND a.rep < b.rep GROUP BY ALL)
SELECT a, b, round(common::DOUBLE / (len(wa.ws) + len(wb.ws) - common), 6) AS jaccard FROM c JOIN t wa ON wa.rep = a JOIN t wb ON wb.rep = b WHERE common::DOUBLE / (len(wa.ws) + len(wb.ws) - common) >= 0.8""")
def jaccard_pairs(spark, d):
    """Pairs of different word sets of whole documents; equal sets stand once, under their smallest id."""
    w = read(spark, d, "documents").select("doc_id", F.array_sort(F.array_distinct(T.words(F.col("text")))).alias("ws"))
    named = w.groupBy(F.sha2(F.array_join("ws", " "), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))  # words have no blanks
    return C.jaccard_pairs(w.join(named, "doc_id", "left_semi"), "doc_id", "ws", 0.8)


@query("ngram_copied", r"""
WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
g AS (SELECT DISTINCT array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark), LATERAL (SELECT unnest(generate_series(1, len(ws) - 7)) AS i)),
t AS (SELECT doc_id, array_to_string(ws[i:i + 7], ' ') AS g FROM a, LATERAL (SELECT unnest(generate_series(1, len(ws) - 7)) AS i))
SELECT doc_id, count(*) AS grams, count(*) FILTER (WHERE g IN (SELECT g FROM g)) AS copied FROM t GROUP BY doc_id""")
def ngram_copied(spark, d):
    return C.copied(read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "benchmark").select("text"), "doc_id", 8)


@query("invented_specifics", r"""
WITH t AS (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS facts, role FROM conversations),
s AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(answer, '[\p{L}\p{N}]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{2,}|\d{1,4}'))) AS s, regexp_extract_all(lower(coalesce(facts, '')), '[\p{L}\p{N}]+') AS f FROM t WHERE role = 'assistant')
SELECT conv_id, turn, len(list_filter(s, lambda x: NOT list_contains(f, lower(x)))) AS invented FROM s""")
def invented_specifics(spark, d):
    t = read(spark, d, "conversations").withColumn("facts", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = 'assistant'")
    return t.select("conv_id", "turn", F.size(C.invented(F.col("text"), F.coalesce("facts", F.lit("")))).cast("long").alias("invented"))


@query("answer_metrics", r"""
WITH c AS (SELECT role, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words, starts_with(lower(text), 'we ') AS we FROM conversations)
SELECT role, count(*) AS n, round(median(words), 6) AS median_words, round(avg(we::INT), 6) AS we_rate FROM c GROUP BY role""")
def answer_metrics(spark, d):
    w = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    c = read(spark, d, "conversations").select("role", w.alias("words"), F.lower("text").startswith("we ").cast("int").alias("we"))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.round(F.median("words"), 6).alias("median_words"), F.round(F.avg("we"), 6).alias("we_rate"))


@query("page_links", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages""")
def page_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))


@query("page_text", r"""
SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&mdash;', '—'), '&ndash;', '–'), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def page_text(spark, d):
    bare = F.regexp_replace(F.regexp_replace("html", "<(script|style)[^>]*>[^<]*</(script|style)>", " "), "<[^>]+>", " ")
    return read(spark, d, "pages").select("page_id", F.sha2(T.unescape_html(bare), 256).alias("digest"))


@query("tag_filters", """
SELECT tag, count(*) AS n FROM (SELECT unnest([event_type, 'k' || json_extract_string(props, '$.k')]) AS tag FROM events) GROUP BY tag HAVING count(*) >= 5""")
def tag_filters(spark, d):
    e = read(spark, d, "events").select(F.explode(F.array("event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k")))).alias("tag"))
    return e.groupBy("tag").agg(F.count("*").alias("n")).filter("n >= 5 and tag is not null")


@query("sentence_counts", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))::INT AS n FROM documents")
def sentence_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


@query("skeletons", r"""
WITH v AS (SELECT p_partkey, p_name, string_split(regexp_replace(lower(p_name), '[aeiouy]', '', 'g'), '') AS cs FROM part)
SELECT p_partkey, array_to_string(list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN i > 1 AND cs[i] = cs[i - 1] THEN '' ELSE cs[i] END), '') AS consonants,
  trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM v""")
def skeletons(spark, d):
    return read(spark, d, "part").select("p_partkey", T.skeleton(F.col("p_name")).alias("consonants"), T.slug(F.col("p_name")).alias("slug"))


@query("term_counter", r"""
SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}'))) AS term FROM conversations) GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 50""")
def term_counter(spark, d):
    c = read(spark, d, "conversations").select(F.explode(F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: w.rlike("^[A-Z][a-z]{3,}$"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "term").limit(50).filter("n >= 2")


@query("upload_checks", "SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 'no question' WHEN length(text) > 8000 THEN 'question too long' WHEN length(role) < 1 THEN 'no body' END AS reason FROM conversations")
def upload_checks(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", U.valid_upload(F.col("text"), F.col("role")).alias("reason"))


@query("chunked_documents")
def chunked_documents(spark, d):
    """Verbatim chunks at blank lines; checked by concatenation in the tests."""
    return read(spark, d, "documents").select("doc_id", F.posexplode(C.chunk_text(F.col("text"))).alias("n", "chunk"))

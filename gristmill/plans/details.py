"""Named queries: names, phrases, sheets, chats, cards; the small operators on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions import dates as D
from gristmill.functions import text as T
from gristmill.operators import compose as K
from gristmill.operators import knowledge as N
from gristmill.operators import people as P
from gristmill.operators import redact as X
from gristmill.operators import rules as U
from gristmill.operators import score as C
from gristmill.operators import sequences as S
from gristmill.plans.registry import query
from gristmill.plans.search import read
from gristmill.plans.words import sql_pattern
from gristmill.sources import chats, pages, sheets

SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


# --- names ---


@query("split_names", "SELECT p_partkey, split_part(p_name, ' ', 1) AS first, substr(p_name, strpos(p_name, ' ') + 1) AS last, p_brand AS nickname FROM part")
def split_names(spark, d):
    n = P.split_name(F.concat(F.lit("~ "), "p_name", F.lit(' "'), "p_brand", F.lit('"')))
    return read(spark, d, "part").select("p_partkey", n["first"].alias("first"), n["last"].alias("last"), n["nickname"].alias("nickname"))


@query("name_pairs", """
WITH n AS (SELECT min(p_partkey) AS id, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS l FROM part GROUP BY p_name),
m AS (SELECT id, f, l FROM n UNION ALL SELECT id + 1000000, left(f, 3), left(l, 1) FROM n)
SELECT a.id AS a_id, b.id AS b_id FROM m a JOIN m b ON (a.f = b.f OR starts_with(a.f, b.f) OR starts_with(b.f, a.f)) AND (a.l = b.l OR (length(a.l) = 1 OR length(b.l) = 1) AND left(a.l, 1) = left(b.l, 1))""")
def name_pairs(spark, d):
    """Distinct names, whole and abbreviated."""
    n = read(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.split("p_name", " ")[0].alias("first"), F.split("p_name", " ")[1].alias("last"))
    m = n.unionByName(n.select((F.col("id") + 1000000).alias("id"), F.substring("first", 1, 3).alias("first"), F.substring("last", 1, 1).alias("last")))
    return P.name_pairs(m, m)


@query("emails_read", r"SELECT doc_id, w AS raw, CASE WHEN regexp_full_match(lower(trim(w)), '[^@\s]+@[^@\s]+\.[^@\s]+') THEN lower(trim(w)) ELSE '' END AS email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\S*@\S*')) AS w FROM documents)")
def emails_read(spark, d):
    w = read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\S*@\S*"), F.lit(0))).alias("raw"))
    return w.select("doc_id", "raw", P.email_or_empty(F.col("raw")).alias("email"))


ANSWERS = ("Yesssss!", "yes plz", "not attending", "no", "NOPE", "Unlikely because", "50/50", "probably", "n", "0", "y", "100%", "confident", "lolyes", "", "later", "yes/hopefully", "I said no")
_ANSWERS = ", ".join(f"({k}, '{a}')" for k, a in enumerate(ANSWERS))


@query("statuses", rf"""
WITH a(k, raw) AS (VALUES {_ANSWERS}), t AS (SELECT p_partkey, trim(raw) AS s FROM part JOIN a ON p_partkey % {len(ANSWERS)} = k)
SELECT p_partkey, CASE WHEN s = '' THEN 'listed' WHEN regexp_matches(s, '(?i)\bnot\s+attending\b|^no\b|^n$|^0$') THEN 'not' WHEN regexp_matches(s, '(?i)50/50|maybe|hopeful|probably|unlikely|tbd|\?') THEN 'maybe'
  WHEN regexp_matches(s, '(?i)100%|^y(e+s+|ep|up)|^y$|confident|^iwbly$|lolyes|obvi') THEN 'attending' ELSE 'listed' END AS status FROM t""")
def statuses(spark, d):
    raw = F.element_at(T.strings(ANSWERS), (F.col("p_partkey") % len(ANSWERS) + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", P.status_of(raw, "listed").alias("status"))


@query("commitments", r"""
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 5 - 2)::VARCHAR || ' USD' WHEN 1 THEN 'paid ' || o_orderkey WHEN 2 THEN '$' || o_totalprice ELSE o_orderpriority END AS raw FROM orders),
x AS (SELECT *, regexp_replace(raw, '[^0-9.\-]', '', 'g') AS n FROM r)
SELECT o_orderkey, CASE WHEN regexp_full_match(n, '-?\d+(\.\d+)?') THEN n::DOUBLE > 0 ELSE regexp_matches(trim(raw), '(?i)^(y|yes|paid|venmo|cash|done)(\W|$)') END AS paid FROM x""")
def commitments(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat((k % 5 - 2).cast("string"), F.lit(" USD"))).when(k % 4 == 1, F.concat(F.lit("paid "), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))).otherwise(F.col("o_orderpriority"))
    return read(spark, d, "orders").select("o_orderkey", P.confirms(raw).alias("paid"))


@query("city_keys", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'sf' WHEN 1 THEN 'nyc' WHEN 2 THEN 'la' ELSE 'oak land' END AS city FROM customer")
def city_keys(spark, d):
    raw = F.element_at(T.strings(("San  Francisco", "New York City!", "LOS ANGELES", "Oak-land")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return read(spark, d, "customer").select("c_custkey", P.city_key(raw).alias("city"))


@query("name_words", "SELECT DISTINCT p_partkey AS person_id, w AS alias FROM (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE length(w) >= 2 AND lower(w) <> lower(p_name)")
def name_words(spark, d):
    return N.name_parts(read(spark, d, "part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name")))


@query("tidy_names", "SELECT c_custkey AS person_id, c_name AS name FROM customer")
def tidy_names(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("~ "), "c_name", F.lit(" <x@y.org>"))).otherwise(F.col("c_name")).alias("name"))
    return N.tidy(c)


@query("repointed", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey + 1 ELSE l_suppkey END AS person_id FROM lineitem")
def repointed(spark, d):
    s = read(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("person_id"), (F.col("s_suppkey") + 1).alias("survivor"))
    return P.repoint(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("person_id")), s, "person_id")


@query("identity_groups", "SELECT c_custkey AS id, CASE WHEN g IS NULL THEN c_custkey ELSE min(c_custkey) OVER (PARTITION BY g) END AS person FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_custkey % 30 END AS g FROM customer)")
def identity_groups(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return N.identity_groups(c, c.filter("id % 10 = 0").select("name", (F.col("id") % 30).alias("group")))


@query("unreserved_aliases", """
WITH a AS (SELECT p_partkey AS entity_id, p_brand AS alias FROM part UNION ALL SELECT p_partkey, 'FRANCE' FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT p_partkey, 'red widget' FROM part WHERE p_partkey % 5 = 0)
SELECT a.* FROM a WHERE lower(alias) NOT IN (SELECT lower(n_name) FROM nation) AND NOT EXISTS (FROM part p WHERE lower(p.p_name) = lower(alias) AND p.p_partkey <> a.entity_id)""")
def unreserved_aliases(spark, d):
    p = read(spark, d, "part")
    more = lambda n, word: p.filter(F.col("p_partkey") % n == 0).select(F.col("p_partkey").alias("entity_id"), F.lit(word).alias("alias"))
    a = p.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("alias")).unionByName(more(9, "FRANCE")).unionByName(more(5, "red widget"))
    return U.unreserved(a, p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")), read(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("people_filter", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')")
def people_filter(spark, d):
    return U.filter_people(read(spark, d, "customer"), " BUILD ", ("c_name", "c_mktsegment")).select("c_custkey")


@query("initials_and_hues", """
WITH h AS (SELECT p_partkey, p_name, list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(lower(p_name), ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: (h * 33 + b) % 18446744073709551616::HUGEINT) AS h FROM part)
SELECT p_partkey, upper(left(p_name, 1)) || upper(left(split_part(p_name, ' ', 2), 1)) AS initials, round(0.02::DOUBLE + (h % 1000)::DOUBLE / 1000 * 0.53::DOUBLE, 6) AS hue FROM h""")
def initials_and_hues(spark, d):
    return read(spark, d, "part").select("p_partkey", T.initials(F.col("p_name")).alias("initials"), T.hue(F.col("p_name")).alias("hue"))


@query("similar_names", """
WITH p AS (SELECT p_partkey, p_name AS a, lag(p_name) OVER (ORDER BY p_partkey) AS b FROM part), s AS (SELECT *, 1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b))::DOUBLE AS s FROM p WHERE b IS NOT NULL)
SELECT p_partkey, round(s, 6) AS similar, CASE WHEN a = b OR s > 0.95 THEN true WHEN starts_with(a, b || ' ') OR starts_with(b, a || ' ') THEN NULL ELSE false END AS same FROM s""")
def similar_names(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name")
    before = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.join(before, "p_partkey").select("p_partkey", F.round(T.similar(F.col("p_name"), F.col("b")), 6).alias("similar"), T.same_person(F.col("p_name"), F.col("b")).alias("same"))


# --- phrases ---


@query("phrases_held", r"""SELECT doc_id, regexp_matches(' ' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')) || ' ', '[^a-z0-9]of the[^a-z0-9]') AS held FROM documents""")
def phrases_held(spark, d):
    return read(spark, d, "documents").select("doc_id", T.holds_phrase(F.col("text"), F.lit(" OF  the ")).alias("held"))


@query("names_in_corpus", r"SELECT doc_id, contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ', ' the and ') AS found FROM documents")
def names_in_corpus(spark, d):
    return read(spark, d, "documents").select("doc_id", T.has_name(F.col("text"), F.lit("The And")).alias("found"))


@query("eval_refusals", "SELECT conv_id, turn, " + " OR ".join(f"regexp_matches(lower(text), '{sql_pattern(p)}')" for p in T.EVAL_REFUSALS) + " AS refusal FROM (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN ' I''m not sure.' ELSE '' END AS text FROM conversations)")
def eval_refusals(spark, d):
    t = F.concat("text", F.when(F.col("turn") % 3 == 0, " I'm not sure.").otherwise(""))
    return read(spark, d, "conversations").select("conv_id", "turn", T.eval_refusal(t).alias("refusal"))


@query("words_counted", r"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: w = 'the'))::INT AS n FROM documents")
def words_counted(spark, d):
    return read(spark, d, "documents").select("doc_id", T.count_word(F.col("text"), F.lit("the")).alias("n"))


@query("quotes_located", r"SELECT doc_id, sha256(regexp_extract(text, '\S+(\s+\S+){4}')) AS slice FROM documents WHERE regexp_matches(text, '\S+(\s+\S+){4}')")
def quotes_located(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", F.regexp_extract("text", r"\S+(\s+\S+){4}", 0).alias("q")).filter("q <> ''")
    return docs.select("doc_id", F.sha2(T.locate_quote(F.col("text"), T.squeeze(F.col("q"))), 256).alias("slice"))


@query("handles_stripped", rf"SELECT conv_id, turn, {SQUEEZED.format("regexp_replace(regexp_replace('@' || role || ' ' || text || ' @12345678', '@\\d{6,}', '', 'g'), '@[\\p{L}\\p{N}_]+', '', 'g')")} AS plain FROM conversations".replace("\\\\", "\\"))
def handles_stripped(spark, d):
    raw = F.concat(F.lit("@"), "role", F.lit(" "), "text", F.lit(" @12345678"))
    return read(spark, d, "conversations").select("conv_id", "turn", T.strip_handles(raw).alias("plain"))


@query("human_lists", "WITH n AS (SELECT r_regionkey, list(n_name ORDER BY n_name) AS l FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey) SELECT r_regionkey, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] END AS names FROM n")
def human_lists(spark, d):
    n = read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return n.select("r_regionkey", T.human_list(F.col("l")).alias("names"))


@query("clipped", r"SELECT doc_id, CASE WHEN length(text) <= 180 THEN text ELSE coalesce(nullif(regexp_extract(left(text, 180), '(?s)^(.*) ', 1), ''), left(text, 180)) || '…' END AS clipped FROM documents")
def clipped(spark, d):
    return read(spark, d, "documents").select("doc_id", T.clip(F.col("text")).alias("clipped"))


@query("years_in_paths", "SELECT event_id, nullif(regexp_extract('a/' || strftime(ts, '%Y-%m-%d') || '/19', '20[12][0-9]'), '')::INT AS year FROM events")
def years_in_paths(spark, d):
    return read(spark, d, "events").select("event_id", T.year_in(F.concat(F.lit("a/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("/19"))).alias("year"))


@query("plain_documents", r"""
WITH t AS (SELECT doc_id, 'Page 3 of 9' || chr(10) || text || chr(10) || '-- slide 2 --' || chr(10) || chr(10) || chr(10) || chr(10) || 'end' AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?im)^\s*(-+\s*)?(page|slide)\s+\d+(\s+of\s+\d+)?(\s*-+)?\s*$', '', 'g'),
  '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM t""")
def plain_documents(spark, d):
    t = F.concat(F.lit("Page 3 of 9\n"), "text", F.lit("\n-- slide 2 --\n\n\n\nend"))
    return read(spark, d, "documents").select("doc_id", F.sha2(T.plain_document(t), 256).alias("digest"))


@query("token_estimates", "SELECT doc_id, length(text) // 3 AS tokens, length(text) // 3 <= 8192 AS fits FROM documents")
def token_estimates(spark, d):
    n = T.estimated_tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", n.alias("tokens"), (n <= 8192).alias("fits"))


@query("year_spans", "SELECT o_custkey, CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN min(year(o_orderdate))::VARCHAR ELSE min(year(o_orderdate)) || '–' || max(year(o_orderdate)) END AS span FROM orders GROUP BY o_custkey")
def year_spans(spark, d):
    y = F.year("o_orderdate")
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.min(y).alias("a"), F.max(y).alias("b")).select("o_custkey", T.year_span(F.col("a"), F.col("b")).alias("span"))


@query("human_dates", "SELECT o_orderkey, strftime(o_orderdate, '%-d %b %Y') AS day FROM orders")
def human_dates(spark, d):
    return read(spark, d, "orders").select("o_orderkey", D.human_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))


@query("relation_phrases", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'a taught b' WHEN 'O' THEN 'a builds with b' ELSE 'a and b know each other' END AS phrase FROM orders")
def relation_phrases(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "mentor").when(F.col("o_orderstatus") == "O", "builds_with").otherwise("friend")
    return read(spark, d, "orders").select("o_orderkey", K.relation_phrase(kind, F.lit("a"), F.lit("b")).alias("phrase"))


@query("to_remember", r"SELECT conv_id, turn, regexp_matches(lower(trim(t)), '^(remember|make a note|note that|write down|save this|don''?t forget)\b') AS asks FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN ' Remember ' ELSE '' END || text AS t FROM conversations)")
def to_remember(spark, d):
    t = F.concat(F.when(F.col("turn") % 2 == 0, " Remember ").otherwise(""), "text")
    return read(spark, d, "conversations").select("conv_id", "turn", K.asks_to_remember(t).alias("asks"))


# --- rules and samples ---


@query("likes", "SELECT p_partkey, (lower(p_name) LIKE 'red%' OR lower(p_name) LIKE '%widget') AND NOT lower(p_name) LIKE '%bolt' AS fits FROM part")
def likes(spark, d):
    return read(spark, d, "part").select("p_partkey", U.like_any(F.col("p_name"), ("RED%", "%widget"), ("%bolt",)).alias("fits"))


@query("about_people", "SELECT p_partkey, NOT regexp_matches(n, '" + sql_pattern(U.NOT_ABOUT_PEOPLE) + "') AS people FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' Receipt 2024.csv' ELSE '.csv' END AS n FROM part)")
def about_people(spark, d):
    n = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " Receipt 2024.csv").otherwise(".csv"))
    return read(spark, d, "part").select("p_partkey", U.about_people(n).alias("people"))


@query("sheet_kinds", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'roster' WHEN p_partkey % 3 = 1 THEN 'shift' ELSE 'other' END AS kind, p_partkey % 3 < 2 AS usable FROM part")
def sheet_kinds(spark, d):
    k = F.col("p_partkey") % 3
    heads = F.when(k == 0, F.array(F.lit("Full NAME"), F.lit("e-mail / email"), F.col("p_name"))).when(k == 1, F.array(F.lit("Day"), F.col("p_name"))).otherwise(F.array(F.lit(" "), F.lit("")))
    return read(spark, d, "part").select("p_partkey", U.sheet_kind(heads).alias("kind"), U.usable_header(heads).alias("usable"))


@query("people_only", "SELECT p_partkey AS person_id FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 2 = 1")
def people_only(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("person_id"), F.when(F.col("p_partkey") % 2 == 0, "OZ").otherwise(F.col("p_name")).alias("name"))
    return U.people_only(p, p.filter("person_id % 4 = 0").select("person_id")).select("person_id")


@query("gendered_texts", r"SELECT conv_id, turn, regexp_matches(text || CASE WHEN turn % 2 = 0 THEN ' He went' ELSE ' theirs' END, '(?i)\b(he|him|his|she|her|hers|himself|herself)\b') AS gendered FROM conversations")
def gendered_texts(spark, d):
    t = F.concat("text", F.when(F.col("turn") % 2 == 0, " He went").otherwise(" theirs"))
    return read(spark, d, "conversations").select("conv_id", "turn", U.gendered(t).alias("gendered"))


@query("eligible_people", "SELECT o_custkey AS person_id, count(*) AS messages FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def eligible_people(spark, d):
    return U.eligible(read(spark, d, "orders").select(F.col("o_custkey").alias("person_id")), 12)


@query("current_cohort", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(year(o_orderdate)) = (SELECT max(year(o_orderdate)) FROM orders)")
def current_cohort(spark, d):
    c = read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.year("o_orderdate")).alias("years"))
    return U.current_cohort(c).select("o_custkey")


@query("event_matches", "SELECT event_id FROM events WHERE contains(lower(event_type || ' ' || props), '\"k\": 1') AND event_type = 'click'")
def event_matches(spark, d):
    e = read(spark, d, "events").select("event_id", F.lower(F.concat_ws(" ", "event_type", "props")).alias("haystack"), F.array("event_type").alias("tags"))
    return U.matches(e, '"K": 1', "click").select("event_id")


@query("ask_words", """
WITH w AS (SELECT p_partkey AS claim_id, i AS place, lower(unnest(string_split(p_name || ' ' || p_type || ' the 12345', ' '))) AS word, unnest(range(20)) AS i FROM part),
g AS (SELECT claim_id, word, min(place) AS place FROM (SELECT p_partkey AS claim_id, generate_subscripts(ws, 1) AS place, lower(unnest(ws)) AS word FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' the 12345', ' ') AS ws FROM part)) WHERE length(word) > 1 AND regexp_matches(word, '\\p{L}') AND word <> 'the' GROUP BY ALL),
f AS (SELECT g.* FROM g JOIN part ON p_partkey = claim_id WHERE word <> lower(split_part(p_name, ' ', 1)))
SELECT claim_id, word, place::INT AS place, row_number() OVER (PARTITION BY claim_id ORDER BY place, word)::INT AS n FROM f QUALIFY n <= 2""".replace("\\\\", "\\").replace("WITH w AS (SELECT p_partkey AS claim_id, i AS place, lower(unnest(string_split(p_name || ' ' || p_type || ' the 12345', ' '))) AS word, unnest(range(20)) AS i FROM part),\ng AS", "WITH g AS"))
def ask_words(spark, d):
    p = read(spark, d, "part")
    words = p.select(F.col("p_partkey").alias("claim_id"), F.posexplode(F.split(F.concat("p_name", F.lit(" "), "p_type", F.lit(" the 12345")), " ")).alias("place", "word")).withColumn("place", F.col("place") + 1)
    return U.ask_words(words, p.select(F.col("p_partkey").alias("claim_id"), F.split("p_name", " ")[0].alias("word")), cap=2)


@query("pass_histogram", "SELECT coalesce(CASE WHEN value > 20 THEN event_type END, '?') AS pass, count(*) AS n FROM events GROUP BY ALL")
def pass_histogram(spark, d):
    return S.histogram(read(spark, d, "events").select(F.when(F.col("value") > 20, F.col("event_type")).alias("pass")), "pass")


@query("hash_sample", "SELECT event_id FROM events ORDER BY md5(event_id::VARCHAR || ':7'), event_id LIMIT 100")
def hash_sample(spark, d):
    return S.sample(read(spark, d, "events").select("event_id"), 100, "event_id", "7")


@query("alive_rows", "SELECT event_id FROM events WHERE NOT value < 10")
def alive_rows(spark, d):
    return S.alive(read(spark, d, "events").select("event_id", F.when(F.col("value") < 10, F.col("ts")).alias("deleted_at"))).select("event_id")


@query("rewrites_judged", r"""
WITH r AS (SELECT conv_id, turn, text AS b, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN text || ' she' WHEN 2 THEN left(text, 3) ELSE text END AS a FROM conversations),
c AS (SELECT *, list_distinct(regexp_extract_all(b, '\b[A-Z][\p{L}]+')) AS cb, list_distinct(regexp_extract_all(a, '\b[A-Z][\p{L}]+')) AS ca FROM r)
SELECT conv_id, turn, CASE WHEN trim(a) = '' THEN 'empty' WHEN regexp_matches(a, '(?i)\b(he|him|his|she|her|hers|himself|herself)\b') THEN 'still gendered' WHEN length(a) < length(b) * 0.6 OR length(a) > length(b) * 1.4 THEN 'length'
  WHEN len(list_filter(cb, lambda w: NOT list_contains(ca, w) AND w NOT IN ('He', 'She', 'His', 'Her', 'Him'))) > 0 THEN 'lost a name' END AS reason FROM c""")
def rewrites_judged(spark, d):
    k, b = F.col("turn") % 4, F.col("text")
    after = F.when(k == 0, "").when(k == 1, F.concat(b, F.lit(" she"))).when(k == 2, F.substring(b, 1, 3)).otherwise(b)
    return read(spark, d, "conversations").select("conv_id", "turn", C.rewrite_rejection(b, after).alias("reason"))


@query("training_rows", """
WITH p AS (SELECT conv_id, turn, text AS q, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS a, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id, turn, to_json(q) AS q, to_json(a) AS a FROM p WHERE role = 'user' AND a IS NOT NULL)
SELECT conv_id, turn, sha256('{"contents":[{"role":"user","parts":[{"text":' || q || '}]},{"role":"model","parts":[{"text":' || a || '}]}]}') AS contents, sha256('{"prompt":' || q || ',"completion":' || a || '}') AS pair FROM r""")
def training_rows(spark, d):
    """Every question that was answered, in both forms."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, d, "conversations").withColumn("completion", F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w)))
    c = c.filter("role = 'user' and completion is not null").select("conv_id", "turn", F.col("text").alias("prompt"), "completion")
    both = C.training_rows(c.withColumn("p", F.col("prompt")).withColumn("c", F.col("completion"))).withColumnRenamed("row", "contents")
    both = C.training_rows(both.withColumnRenamed("p", "prompt").withColumnRenamed("c", "completion"), "pair")
    return both.select("conv_id", "turn", F.sha2("contents", 256).alias("contents"), F.sha2("row", 256).alias("pair"))


# --- sheets, chats, cards ---


@query("chat_messages", "SELECT conv_id::VARCHAR AS source, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role AS sender, '2024-01-02 09:' || lpad(turn::VARCHAR, 2, '0') || ':05' AS ts, trim(text) || CASE WHEN turn % 2 = 0 THEN chr(10) || 'second line' ELSE '' END AS body FROM conversations")
def chat_messages(spark, d):
    """Conversations written as an export, read back."""
    head = F.concat(F.lit("‎[1/2/24, 9:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":05 AM] "), "role", F.lit(": "), F.trim("text"), F.when(F.col("turn") % 2 == 0, "\nsecond line").otherwise(""))
    files = read(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", head.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return chats.classify(chats.messages(files)).select("source", "n", "sender", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "body")


@query("chat_senders", "SELECT role AS sender, count(*) AS messages, arg_min(turn, (conv_id, turn)) AS first_seen, max(turn) AS last_seen FROM conversations GROUP BY role")
def chat_senders(spark, d):
    c = read(spark, d, "conversations").select(F.col("role").alias("sender"), F.col("turn").alias("ts"), F.col("conv_id").alias("source"), F.col("turn").alias("n"))
    return chats.senders(c)


@query("sheet_text", """
WITH r AS (SELECT o_custkey::VARCHAR AS file, o_orderkey AS row, o_orderstatus || ' | ' || o_orderpriority || ' | M' AS line FROM orders),
s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY file ORDER BY row) AS spent FROM r), k AS (SELECT * FROM s WHERE spent - length(line) - 1 <= 200)
SELECT file, string_agg(line, chr(10) ORDER BY row) || CASE WHEN max(spent) > 200 THEN chr(10) || '[...]' ELSE '' END AS text FROM k GROUP BY file""")
def sheet_text(spark, d):
    c = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").alias("row"), F.posexplode(F.array("o_orderstatus", "o_orderpriority", F.lit("M"), F.lit(""))).alias("col", "cell"))
    return sheets.as_text(c, limit=200)


@query("sheet_samples", """SELECT n_regionkey AS k, '[' || string_agg('{"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS sample FROM (SELECT * FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) <= 3) GROUP BY n_regionkey""")
def sheet_samples(spark, d):
    return sheets.sample_json(read(spark, d, "nation").select(F.col("n_regionkey").alias("k"), "n_nationkey", "n_name"), "k", "n_nationkey", 3)


@query("shift_rows", "SELECT n_name AS day, 'kitchen' AS role, unnest(['Ana', 'Bo']) AS person FROM nation WHERE n_nationkey % 2 = 0")
def shift_rows(spark, d):
    n = read(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("day"), F.when(F.col("n_nationkey") % 2 == 0, " kitchen ").otherwise(" ").alias("role"), F.lit("Ana, TBD, Bo,").alias("people"))
    return sheets.shift_rows(n)


@query("attendance", """
WITH a AS (SELECT o_custkey, year(o_orderdate) AS y, CASE o_orderstatus WHEN 'F' THEN 'attending' WHEN 'O' THEN 'maybe' ELSE 'not' END AS s FROM orders),
b AS (SELECT o_custkey, y, arg_max(s, CASE s WHEN 'attending' THEN 3 WHEN 'maybe' THEN 2 ELSE 0 END) AS s FROM a GROUP BY ALL)
SELECT o_custkey::VARCHAR AS key, string_agg(y::VARCHAR, ',' ORDER BY y) AS years, string_agg(s, ',' ORDER BY y) AS statuses, count(*) FILTER (WHERE s = 'attending') AS attended FROM b GROUP BY o_custkey""")
def attendance(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "attending").when(F.col("o_orderstatus") == "O", "maybe").otherwise("not")
    a = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("email"), F.year("o_orderdate").alias("year"), status.alias("status"), F.lit("x").alias("first"), F.lit("y").alias("last"))
    r = sheets.roster(a)
    return r.select("key", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), F.array_join(F.transform("years", lambda y: F.element_at("statuses", y)), ",").alias("statuses"), "attended")


@query("head_counts", "SELECT year(o_orderdate)::INT AS year, count(DISTINCT o_custkey) AS people FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def head_counts(spark, d):
    a = read(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") == "F", "attending").otherwise("not").alias("status"), F.col("o_custkey").cast("string").alias("first"), F.lit("").alias("last"))
    return sheets.head_counts(a)


@query("document_sections", "SELECT doc_id, 1::BIGINT AS n, 'Head' AS heading, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body FROM documents UNION ALL SELECT doc_id, 2, 'Sub', sha256('more') FROM documents".replace("\\\\", "\\"))
def document_sections(spark, d):
    t = F.concat(F.lit("# Head {#x}\n"), F.regexp_replace("text", "(?m)^#", "="), F.lit("\n## Sub\nmore"))
    s = pages.sections(read(spark, d, "documents").select("doc_id", t.alias("text")))
    return s.filter("n > 0").select("doc_id", "n", "heading", F.sha2("body", 256).alias("body"))


@query("entity_cards", "SELECT p_partkey AS entity_id, p_brand AS aliases, row_number() OVER (ORDER BY p_size DESC, p_partkey)::INT AS place FROM part")
def entity_cards(spark, d):
    p = read(spark, d, "part")
    c = N.entity_cards(p.select(F.col("p_partkey").alias("entity_id"), F.col("p_size").alias("mention_count")), p.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("alias")))
    return c.select("entity_id", F.array_join("aliases", "|").alias("aliases"), "place")


@query("relation_lines", "SELECT s_suppkey AS person_id, n_name AS other, 'from' AS kind, true AS first FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_nationkey + 1000000, s_name, 'from', false FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def relation_lines(spark, d):
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    people = s.select(F.col("s_suppkey").cast("long").alias("person_id"), F.col("s_name").alias("name")).unionByName(n.select((F.col("n_nationkey") + 1000000).cast("long").alias("person_id"), F.col("n_name").alias("name")))
    edges = s.select(F.col("s_suppkey").cast("long").alias("person_a"), (F.col("s_nationkey") + 1000000).cast("long").alias("person_b"), F.lit("from").alias("kind"))
    return N.relation_lines(edges, people)


@query("known_names", "SELECT c_custkey AS person_id, c_name || '|' || c_mktsegment || '|' || 'nick' || c_custkey || '|z' AS names FROM customer")
def known_names(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), "c_name", "c_mktsegment")
    roster = c.select("person_id", F.col("c_mktsegment").alias("name"), F.concat(F.lit("nick"), F.col("person_id").cast("string")).alias("nickname"))
    aliases = c.select("person_id", F.lit(" z ").alias("alias")).unionByName(c.select("person_id", F.col("c_name").alias("alias")))
    return N.known_names(c.select("person_id", F.col("c_name").alias("name")), roster, aliases).select("person_id", F.array_join("names", "|").alias("names"))


@query("discovered_names", "SELECT o_orderpriority AS name, count(DISTINCT o_custkey) AS mention_count, arg_min(o_orderstatus, (o_custkey, o_orderkey)) AS kind FROM orders WHERE o_orderkey % 3 <> 2 GROUP BY o_orderpriority")
def discovered_names(spark, d):
    m = read(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("kind"))
    return N.discovered(m, m.filter("source_id % 3 <> 2").select("job_id", "source_id"))


@query("legacy_edges", """
SELECT c_name AS source, 'works_on' AS kind, c_mktsegment AS target, count(*) AS weight FROM customer GROUP BY ALL
UNION ALL SELECT o_custkey::VARCHAR, 'attended', year(o_orderdate)::VARCHAR, count(*) FROM orders GROUP BY ALL
UNION ALL SELECT l_returnflag, 'mentioned_with', 'Z' || l_linestatus, count(DISTINCT l_orderkey) FROM lineitem GROUP BY ALL""")
def legacy_edges(spark, d):
    shifts = read(spark, d, "customer").select(F.col("c_name").alias("person"), F.col("c_mktsegment").alias("shift"))
    attended = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("person"), F.year("o_orderdate").alias("year"))
    met = read(spark, d, "lineitem").select(F.concat(F.lit("Z"), "l_linestatus").alias("a"), F.col("l_returnflag").alias("b"), F.col("l_orderkey").alias("doc"))
    return N.legacy_edges(shifts, attended, met)


@query("answers_first", "SELECT 1 AS qid, 1 - (p_partkey % 2) AS tier, CASE WHEN p_partkey % 2 = 1 THEN -p_partkey ELSE p_partkey END AS id, p_size::DOUBLE AS score, row_number() OVER (ORDER BY 1 - (p_partkey % 2), p_size DESC, CASE WHEN p_partkey % 2 = 1 THEN -p_partkey ELSE p_partkey END)::INT AS place FROM part".replace("1 - (p_partkey % 2) AS tier", "(1 - (p_partkey % 2))::INT AS tier"))
def answers_first(spark, d):
    from gristmill.operators.retrieve import answers_first as first

    p = read(spark, d, "part").select(F.lit(1).alias("qid"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    return first(p.filter("id % 2 = 1"), p.filter("id % 2 = 0"))


@query("sanitized", r"""SELECT conv_id, turn, 0 AS left_over, CASE WHEN NOT regexp_matches(text, '[@0-9\p{Cf}]') THEN sha256(trim(regexp_replace(text || ' mail [email] or [phone]', '\s+', ' ', 'g'))) END AS digest FROM conversations""")
def sanitized(spark, d):
    """All turns with an address, a number and a handle added and taken out again: what is left of them, and what became of texts that had none."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "text", X.sanitize(F.concat("text", F.lit(" mail a.b@gmail.com or +1 415 555 0199 @someone"))).alias("t"))
    plain = ~F.col("text").rlike(r"[@0-9\p{Cf}]")
    return c.select("conv_id", "turn", F.size(X.pii_classes(F.col("t"))).alias("left_over"), F.when(plain, F.sha2("t", 256)).alias("digest"))


@query("contradiction_notes", """
WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS b, lag(o_orderdate::DATE) OVER w AS a, lag(o_orderkey) OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), x AS (SELECT *, date_diff('day', a, b) AS n FROM o WHERE a IS NOT NULL)
SELECT o_orderkey, strftime(a, '%-d %b %Y') || ': ' || k || ' — ' || CASE WHEN n <= 0 THEN 'the same day' WHEN n = 1 THEN 'the next day' WHEN n < 14 THEN n || ' days later' WHEN n <= 60 THEN 'a few weeks later' WHEN n <= 400 THEN 'months later' ELSE 'years later' END || ': ' || o_orderkey AS note FROM x""")
def contradiction_notes(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("b"), F.date_format(F.lag("o_orderdate").over(w), "yyyy-MM-dd").alias("a"), F.lag("o_orderkey").over(w).cast("string").alias("k")).filter("a is not null")
    return o.select("o_orderkey", K.contradiction_note(F.col("k"), F.col("o_orderkey").cast("string"), F.col("a"), F.col("b")).alias("note"))

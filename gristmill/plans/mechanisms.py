"""Named queries: matching, payloads, order statistics, merged tables, deliveries, caches, corrections, pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.shared import shared_dir, written
from gristmill.operators import matching as M
from gristmill.operators import payloads as J
from gristmill.operators import people as P
from gristmill.operators import quantiles as Q
from gristmill.operators import sequences as S
from gristmill.operators import speech as H
from gristmill.operators.evidence import fingerprint
from gristmill.plans.registry import query
from gristmill.plans.search import TERMS_SQL, first_word_sql, read, terms
from gristmill.sources.versions import MergedTable
from gristmill.streaming.outbox import AnswerCache, Outbox, store_once


def folder(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


ASCII_SQL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g'))"
GROUPS_SQL = "[" + ", ".join("[" + ", ".join(f"'{n}'" for n in g) + "]" for g in P.DIMINUTIVES) + "]"
FIRST_SQL = (
    "({0} <> '' AND {1} <> '' AND ({0} = {1} OR (length({0}) >= 2 AND length({1}) >= 2 AND (starts_with({0}, {1}) OR starts_with({1}, {0}))) "
    f"OR list_bool_or(list_transform({GROUPS_SQL}, lambda g: list_contains(g, {{0}}) AND list_contains(g, {{1}})))))"
)
INITIALS_SQL = "array_to_string(list_transform(string_split({0}, ' '), lambda w: left(w, 1)), '')"
SHORT_SQL = f"(length({{0}}) <= 3 AND contains({{1}}, ' ') AND {{0}} = {INITIALS_SQL.format('{1}')})"
SURNAME_SQL = f"({{0}} <> '' AND {{1}} <> '' AND ({{0}} = {{1}} OR ((length({{0}}) = 1 OR length({{1}}) = 1) AND left({{0}}, 1) = left({{1}}, 1)) OR {SHORT_SQL.format('{0}', '{1}')} OR {SHORT_SQL.format('{1}', '{0}')}))"


# --- matching ---


@query("chat_links")
def chat_links(spark, d):
    """Clients of one source linked one to one with those of the others, more sales first; held against going through the candidates in order."""
    return M.one_to_one(link_pairs(spark, d))


def link_pairs(spark, d):
    sold = read(spark, d, "sales").groupBy("client_id").agg(F.count("*").alias("messages"))
    c = read(spark, d, "clients").join(sold, "client_id", "left").select(F.col("client_id").alias("id"), "name", "source", F.coalesce("messages", F.lit(0).cast("long")).alias("messages"))
    n = P.split_name(F.col("name"))
    members = c.filter("source = 'crm'").select("id", n["first"].alias("first"), n["last"].alias("last"), F.lit(None).cast("string").alias("nickname"))
    return M.link_candidates(members, c.filter("source <> 'crm' or source is null").select("id", "name", "messages"))


@query("names_absorbed", f"""
WITH c AS (SELECT client_id AS id, {ASCII_SQL.format("coalesce(name, '')")} AS n, client_id IN (SELECT client_id FROM sales WHERE client_id IS NOT NULL) AS sold FROM clients),
o AS (SELECT * FROM c WHERE NOT sold AND length(n) >= 3), r AS (SELECT * FROM c WHERE sold AND n <> ''),
m AS (SELECT o.id AS a_id, r.id AS b_id FROM o JOIN r ON o.n <> r.n AND (list_has_all(string_split(r.n, ' '), string_split(o.n, ' '))
  OR (length(o.n) >= 8 AND length(r.n) >= 8 AND levenshtein(replace(o.n, ' ', ''), replace(r.n, ' ', '')) <= 1)))
SELECT a_id, min(b_id) AS b_id FROM m GROUP BY a_id HAVING count(*) = 1""")
def names_absorbed(spark, d):
    """Clients who bought nothing, and the one client each is another spelling of."""
    c = read(spark, d, "clients").select(F.col("client_id").alias("id"), "name")
    sold = read(spark, d, "sales").select(F.col("client_id").alias("id")).distinct()
    return M.absorbed(c.join(sold, "id", "left_anti"), c.join(sold, "id", "left_semi"))


@query("variants_merged", rf"""
WITH RECURSIVE c AS (SELECT client_id AS id, coalesce(split_part(name, ' ', 1), '') AS first, CASE WHEN source = 'store' OR name IS NULL OR strpos(name, ' ') = 0 THEN '' ELSE substr(name, strpos(name, ' ') + 1) END AS last, city FROM clients),
n AS (SELECT *, {ASCII_SQL.format('first')} AS f, {ASCII_SQL.format('last')} AS l,
  list_filter(list_transform(regexp_split_to_array(coalesce(city, ''), '[/,&]|\bor\b'), lambda x: trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda x: x <> '') AS places FROM c),
k AS (SELECT f, l, arg_min(trim(first || ' ' || last), id) AS written FROM n WHERE f <> '' GROUP BY f, l),
p AS (SELECT a.f AS af, a.l AS al, b.f AS bf, b.l AS bl, b.written FROM k a JOIN k b ON (a.f, a.l) <> (b.f, b.l) AND {FIRST_SQL.format('a.f', 'b.f')} AND (a.l = '' OR b.l = '' OR {SURNAME_SQL.format('a.l', 'b.l')})),
w(f, l, rf, rl) AS (SELECT f, l, f, l FROM k UNION SELECT p.bf, p.bl, w.rf, w.rl FROM w JOIN p ON p.af = w.f AND p.al = w.l),
g AS (SELECT f, l, min((rf, rl)) AS g, count(*) AS members FROM w GROUP BY f, l),
q AS (SELECT g.g, sum((SELECT count(*) FROM p WHERE p.af = g.f AND p.al = g.l)) = any_value(members) * (any_value(members) - 1) AS clique FROM g GROUP BY g.g),
s AS (SELECT n.*, g.g, coalesce(q.clique, false) AND n.f <> '' AS whole FROM n LEFT JOIN g USING (f, l) LEFT JOIN q ON q.g = g.g),
kept AS (SELECT g, arg_min(id, (-(length(first) + length(last)), id)) AS keep, count(*) AS size FROM s WHERE whole GROUP BY g),
fit AS (SELECT x.id, min(y.id) AS rescuer FROM s x JOIN p ON p.af = x.f AND p.al = x.l JOIN s y ON y.f = p.bf AND y.l = p.bl
  WHERE NOT x.whole AND x.f <> '' AND x.l = '' AND y.l <> '' AND list_has_any(x.places, y.places) GROUP BY x.id HAVING count(*) = 1),
others AS (SELECT af AS f, al AS l, string_agg(DISTINCT written, ', ' ORDER BY written) AS others FROM p GROUP BY af, al)
SELECT s.id, CASE WHEN s.whole THEN kept.keep ELSE coalesce(fit.rescuer, s.id) END AS person,
  CASE WHEN s.f = '' THEN 'alone' WHEN s.whole THEN CASE WHEN size > 1 THEN 'merged' ELSE 'alone' END WHEN fit.id IS NOT NULL THEN 'rescued' ELSE 'ambiguous' END AS how,
  CASE WHEN s.f <> '' AND NOT s.whole AND fit.id IS NULL THEN others.others END AS others
FROM s LEFT JOIN kept ON kept.g = s.g AND s.whole LEFT JOIN fit ON fit.id = s.id LEFT JOIN others ON others.f = s.f AND others.l = s.l""")
def variants_merged(spark, d):
    """Clients' names, those of shops without a surname: one person, rescued by a city, or ambiguous."""
    at = F.call_function("instr", F.col("name"), F.lit(" "))
    last = F.when((F.col("source") == "store") | F.col("name").isNull() | (at == 0), "").otherwise(F.call_function("substring", F.col("name"), at + 1))
    c = read(spark, d, "clients").select(F.col("client_id").alias("id"), F.coalesce(F.split("name", " ")[0], F.lit("")).alias("first"), last.alias("last"), "city")
    return M.merge_variants(c)


COMPARE_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^~\s*', ''), '^dr\.?\s+', ''), '^mr\.?\s+', ''), '^ms\.?\s+', ''), '\s*[(\[].*?[)\]]', '', 'g'), '[''"].*?[''"]', '', 'g'), '\d+', '', 'g'))"""


@query("duplicate_candidates", f"""
WITH c AS (SELECT client_id AS id, regexp_replace({COMPARE_SQL.format('name')}, '\\s+', ' ', 'g') AS n FROM clients WHERE name IS NOT NULL),
k AS (SELECT id, n, string_split(n, ' ')[-1] AS w FROM c WHERE n <> ''),
z AS (SELECT id, n, 0 AS pass, row_number() OVER (ORDER BY n, id) AS i FROM k UNION ALL SELECT id, n, 1, row_number() OVER (ORDER BY w || ' ' || n, id) FROM k),
m AS (SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM z x JOIN z y ON x.pass = y.pass AND y.i > x.i AND y.i <= x.i + 5),
v AS (SELECT a, b, x.n AS x, y.n AS y, string_split(x.n, ' ')[1] AS fx, string_split(y.n, ' ')[1] AS fy, CASE WHEN contains(x.n, ' ') THEN x.w ELSE '' END AS lx, CASE WHEN contains(y.n, ' ') THEN y.w ELSE '' END AS ly,
  1 - levenshtein(x.n, y.n) / greatest(length(x.n), length(y.n), 1)::DOUBLE AS ratio FROM m JOIN k x ON x.id = a JOIN k y ON y.id = b),
r AS (SELECT a, b, CASE WHEN length(x) < 2 OR length(y) < 2 THEN NULL WHEN x = y THEN 'equal' WHEN ratio > 0.95 THEN 'nearly equal'
  WHEN fx = fy AND lx <> '' AND ly <> '' THEN CASE WHEN lx = ly THEN 'full name' WHEN (length(lx) = 1 AND starts_with(ly, lx)) OR (length(ly) = 1 AND starts_with(lx, ly)) THEN 'initial' END
  WHEN fx = fy THEN 'given name alone' WHEN (contains(x, y) OR contains(y, x)) AND ratio > 0.7 THEN 'one within the other' END AS reason FROM v)
SELECT a, b, CASE WHEN reason IN ('equal', 'nearly equal', 'full name', 'initial') THEN 'auto' ELSE 'verify' END AS verdict, reason FROM r WHERE reason IS NOT NULL""")
def duplicate_candidates(spark, d):
    return M.duplicate_candidates(read(spark, d, "clients").select(F.col("client_id").alias("id"), "name").filter("name is not null"))


# --- payloads ---

OBJECT_SQL = "CASE WHEN json_valid(props) THEN json_type(props) = 'OBJECT' AND coalesce(json_type(props, '$.k'), 'NULL') IN ('NULL', 'UBIGINT', 'BIGINT') ELSE false END"
REASON_SQL = f"CASE WHEN props IS NULL OR trim(props) = '' THEN 'missing' WHEN NOT {OBJECT_SQL} THEN 'broken' WHEN json_extract_string(props, '$.k') IS NULL THEN 'incomplete' END"


@query("payload_outcomes", f"SELECT coalesce({REASON_SQL}, 'kept') AS outcome, count(*) AS n FROM clicks GROUP BY 1")
def payload_outcomes(spark, d):
    return J.counts(J.parsed(read(spark, d, "clicks"), "props", "click"))


@query("payload_items", f"""
WITH p AS (SELECT click_id, props FROM clicks WHERE {REASON_SQL} IS NULL)
SELECT click_id, json_extract(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.device.os') AS os, json_extract_string(props, '$.device.ver') AS ver,
  coalesce(array_to_string(json_extract_string(props, '$.tags[*]'), ','), '') AS tags, json_extract(i, '$.sku')::BIGINT AS sku, json_extract(i, '$.qty')::INTEGER AS qty
FROM p LEFT JOIN LATERAL (SELECT unnest(json_extract(props, '$.items[*]')) AS i) ON true""")
def payload_items(spark, d):
    """Nested payloads as rows: one for each item, and one for those without any."""
    p = J.kept(J.parsed(read(spark, d, "clicks").select("click_id", "props"), "props", "click"))
    tags = F.coalesce(F.array_join("payload.tags", ","), F.lit(""))
    return p.select("click_id", "payload.k", "payload.device.os", "payload.device.ver", tags.alias("tags"), F.explode_outer("payload.items").alias("i")).select("click_id", "k", "os", "ver", "tags", "i.sku", "i.qty")


@query("payload_broken", f"SELECT click_id, sha256(props) AS digest, {REASON_SQL} AS reason FROM clicks WHERE {REASON_SQL} IS NOT NULL")
def payload_broken(spark, d):
    p = J.parsed(read(spark, d, "clicks").select("click_id", "props"), "props", "click")
    return J.broken(p, "props", "click_id").select("click_id", F.sha2("props", 256).alias("digest"), "reason")


# --- order statistics ---


@query("amount_statistics", """
WITH l AS (SELECT flag, amount FROM sale_lines UNION ALL SELECT 'all', amount FROM sale_lines),
s AS (SELECT flag AS "group", list_sort(list(amount)) AS v FROM l WHERE amount IS NOT NULL AND NOT isnan(amount) GROUP BY flag)
SELECT "group", len(v) AS n, v[len(v) // 2 + 1] AS upper_median, v[(len(v) * 90 + 99) // 100] AS p90, v[(len(v) * 99 + 99) // 100] AS p99, v[1] AS least FROM s""")
def amount_statistics(spark, d):
    """Amounts by flag, and of all lines as one group."""
    lines = read(spark, d, "sale_lines").select("flag", "amount")
    both = lines.unionByName(lines.withColumn("flag", F.lit("all"))).withColumnRenamed("flag", "group")
    return Q.order_statistics(both, ["group"], "amount", {"upper_median": Q.upper_median, "p90": Q.nearest_rank(90), "p99": Q.nearest_rank(99), "least": lambda n: n - n + 1})


@query("journal_summary", r"""
WITH c AS (SELECT role, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words, text <> '' AND NOT regexp_matches(text, '[.!?"'')\]]\s*$') AS truncated FROM conversations),
m AS (SELECT role, list_sort(list(words) FILTER (WHERE text <> '')) AS v FROM c GROUP BY role)
SELECT role, count(*) AS turns, count(*) FILTER (WHERE text <> '') AS answered, count(*) FILTER (WHERE truncated) AS truncated, any_value(v[len(v) // 2 + 1])::INT AS median, max(words)::INT AS longest FROM c JOIN m USING (role) GROUP BY role""")
def journal_summary(spark, d):
    """Turns by who speaks: answered, cut off before the end of a sentence, the upper middle and the greatest number of words."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    cut = (F.col("text") != "") & ~F.col("text").rlike(r"[.!?\"')\]]\s*$")
    c = written(read(spark, d, "conversations").select("role", (F.col("text") != "").alias("answered"), words.alias("words"), cut.alias("cut")))
    sums = c.groupBy("role").agg(F.count("*").alias("turns"), F.count_if("answered").alias("answered"), F.count_if("cut").alias("truncated"), F.max("words").alias("longest"))
    middle = Q.order_statistics(c.filter("answered"), ["role"], "words", {"median": Q.upper_median})
    return sums.join(middle.drop("n"), "role", "left").select("role", "turns", "answered", "truncated", "median", "longest")


# --- merged tables, deliveries, caches ---


@query("mentions_merged", "SELECT client_id, count(*) AS mentions, arg_min(kind, (ts, click_id)) AS first_kind FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL GROUP BY client_id")
def mentions_merged(spark, d):
    """Clicks merged month by month into a table of counts; one month is merged again, as after a failure, and changes nothing."""
    clicks = read(spark, d, "clicks").filter("client_id is not null and kind is not null and ts is not null")
    table = MergedTable(spark, folder(spark), "client_id bigint, first_kind string, mentions bigint", ["client_id"])
    for m in ("2024-01", "2024-02", "2024-03", "2024-02", "2024-04", "later"):
        month = F.date_format("ts", "yyyy-MM")
        part = clicks.filter(month == m if m != "later" else ~month.isin("2024-01", "2024-02", "2024-03", "2024-04"))
        rows = part.groupBy("client_id").agg(F.min_by("kind", F.struct("ts", "click_id")).alias("first_kind"), F.count("*").alias("mentions"), F.min("ts").alias("at"))
        table.merge(rows, "add", m, order=["at"], add=["mentions"])
    return table.read()


@query("outbox_states", "SELECT status, coalesce(status = 'done', false) AS uploaded, count(*) AS n FROM (SELECT DISTINCT ON (sale_id) sale_id, status FROM sales WHERE sale_id IS NOT NULL ORDER BY sale_id, status NULLS FIRST) GROUP BY ALL")
def outbox_states(spark, d):
    """Sales sent in two batches to a receiver that acknowledges what is done; the first batch is sent twice and stored once."""
    sales = read(spark, d, "sales").filter("sale_id is not null").groupBy("sale_id").agg(F.min(F.struct("status")).alias("s")).select("sale_id", "s.status")
    out, base = Outbox(spark, folder(spark), "sale_id"), folder(spark)
    receive = store_once(spark, f"{base}/received", "sale_id bigint, status string", "sale_id")

    def send(batch):
        receive(batch.filter("status = 'done'"))
        return batch.filter("status = 'done'")

    for name, part in (("odd", "sale_id % 2 = 1"), ("odd", "sale_id % 2 = 1"), ("rest", "true")):
        out.deliver(out.pending(sales.filter(part), None), name, send)
    stored = spark.read.parquet(f"{base}/received").groupBy("status").agg(F.count("*").alias("stored"))
    counts = out.marked(sales).groupBy("status", "uploaded").agg(F.count("*").alias("n"))
    return counts.join(stored, "status", "left").filter("not uploaded or stored = n").select("status", "uploaded", "n")


@query("cache_two_runs", """
WITH j AS (SELECT text, min(conv_id * 100 + turn) AS one, count(*) AS n FROM conversations GROUP BY text), f AS (SELECT n, one % 3 = 0 AS bad FROM j)
SELECT 1 AS run, CASE WHEN bad THEN 'failed' ELSE 'fresh' END AS source, sum(n)::BIGINT AS jobs FROM f GROUP BY ALL
UNION ALL SELECT 2, CASE WHEN bad THEN 'fresh' ELSE 'stored' END, sum(n)::BIGINT FROM f GROUP BY ALL""")
def cache_two_runs(spark, d):
    """Turns asked twice of something that fails for a third of the texts the first time: only those are asked again."""
    c = read(spark, d, "conversations")
    jobs = written(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("job_id"), fingerprint(F.lit("m"), F.col("text")).alias("fingerprint"), F.col("text").alias("prompt")))
    bad = jobs.groupBy("fingerprint").agg(F.min("job_id").alias("one")).filter("one % 3 = 0").select("fingerprint", F.lit(True).alias("bad"))
    cache = AnswerCache(spark, folder(spark))
    first = cache.answered(jobs, lambda m: m.join(bad, "fingerprint", "left").select("fingerprint", F.when(F.col("bad"), None).otherwise(F.length("prompt").cast("string")).alias("payload")), "m")
    cache.compact()
    second = cache.answered(jobs, lambda m: m.select("fingerprint", F.length("prompt").cast("string").alias("payload")), "m")
    both = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    return both.groupBy("run", "source").agg(F.count("*").alias("jobs"))


# --- corrections and pages ---

HEARD = {"Thonberg": ("thon berg", "thornberg"), "Erer": ("errer", "ehrer")}


#: The SQL side counts edits by bytes, so each letter beyond ASCII gets a byte that no word has.
LETTERS_SQL = "translate({0}, 'èéñßêíçóöüäáúàâîôûëïùœæ¿¡', 'ABCDEFGHIJKLMNOPQRSTUVWXY')"


@query("transcripts_corrected", rf"""
WITH t AS (SELECT conv_id * 100 + turn AS id, text, unnest(string_split(text, ' ')) AS w FROM conversations),
b AS (SELECT id, lower(x) AS token FROM (SELECT id, regexp_replace(regexp_replace(w, '^[[:punct:]‘’“”…–—]+', ''), '[[:punct:]‘’“”…–—]+$', '') AS x FROM t)),
seen AS (SELECT token FROM b GROUP BY token HAVING count(DISTINCT id) >= 3),
v AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark) WHERE length(term) >= 5),
o AS (SELECT DISTINCT x AS token FROM (SELECT regexp_replace(regexp_replace(w, '^[[:punct:]‘’“”…–—]+', ''), '[[:punct:]‘’“”…–—]+$', '') AS x FROM t) WHERE length(x) >= 4 AND lower(x) NOT IN (SELECT token FROM seen) AND lower(x) NOT IN (SELECT term FROM v) AND x NOT IN ('Thonberg', 'Erer')),
k AS (SELECT token, term, levenshtein({LETTERS_SQL.format('lower(token)')}, {LETTERS_SQL.format('term')}) AS d FROM o JOIN v ON abs(length(token) - length(term)) <= 3),
sk AS (SELECT token, regexp_replace(lower(token), '[aeiouy]', '', 'g') AS s FROM o UNION SELECT term, regexp_replace(term, '[aeiouy]', '', 'g') FROM v),
one AS (SELECT token, array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i > 1 AND s[i] = s[i - 1] THEN '' ELSE s[i] END), '') AS s FROM sk),
n AS (SELECT k.*, x.s = y.s AS same FROM k JOIN one x ON x.token = k.token JOIN one y ON y.token = k.term WHERE d <= 2 OR (x.s = y.s AND d <= 3)),
m AS (SELECT token, arg_min(term, (d, NOT same, term)) AS term, arg_min(d, (d, NOT same, term)) AS d, arg_min(same, (d, NOT same, term)) AS same FROM n GROUP BY token)
SELECT DISTINCT token, term FROM m WHERE d <= CASE WHEN length(token) <= 5 THEN 1 ELSE 2 END OR same""")
def transcripts_corrected(spark, d):
    """What a correction of all turns by the words of the benchmark's passages changes; words of three turns or more are taken for real ones."""
    c = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    words = c.select("id", F.explode(F.array_distinct(F.transform(F.split("text", " "), lambda w: F.lower(H.bare(w))))).alias("word"))
    real = words.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3").select("word")
    vocabulary = read(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("term")).filter("length(term) >= 5").distinct()
    fixed = written(H.corrected(c, vocabulary, real, HEARD))
    before = c.join(fixed.filter("changed").select("id", F.col("text").alias("after")), "id")
    pairs = F.arrays_zip(F.transform(F.split("text", " "), H.bare).alias("token"), F.transform(F.split("after", " "), H.bare).alias("term"))
    return before.select(F.explode(pairs).alias("p")).select("p.token", "p.term").filter("token <> term").distinct()


@query("deep_page", "SELECT click_id, row_number() OVER (ORDER BY ts DESC NULLS LAST, click_id DESC) AS place FROM (SELECT click_id, ts FROM clicks WHERE click_id IS NOT NULL) QUALIFY place BETWEEN 15001 AND 15050".replace("QUALIFY place", "QUALIFY row_number() OVER (ORDER BY ts DESC NULLS LAST, click_id DESC)"))
def deep_page(spark, d):
    """Fifty clicks behind the newest fifteen thousand."""
    c = read(spark, d, "clicks").filter("click_id is not null").select("click_id", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("back"), (-F.col("click_id")).alias("tie"))
    return S.page_at(c.withColumn("none", F.col("back").isNull()), 15000, 50, "none", "back", "tie").select("click_id", "place")


@query("recalled_turns", f"""
WITH {TERMS_SQL},
c AS (SELECT conv_id * 100 + turn AS id, lower(text) AS low FROM conversations),
l AS (SELECT * FROM c QUALIFY row_number() OVER (ORDER BY id DESC) BETWEEN 4 AND 400),
h AS (SELECT qid, id, count(DISTINCT term) AS hits FROM l JOIN terms ON {first_word_sql('low', 'term')} GROUP BY ALL)
SELECT qid, id, hits, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, id DESC)::INT AS r FROM h QUALIFY row_number() OVER (PARTITION BY qid ORDER BY hits DESC, id DESC) <= 4""")
def recalled_turns(spark, d):
    c = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return S.recall(c, terms(spark))



"""Named queries: lines, sheets and replies; facts behind entities; listings, grids, stories and cards on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions.shared import written
from gristmill.operators import compose as K
from gristmill.operators import evidence as E
from gristmill.operators import knowledge as N
from gristmill.operators import matching as M
from gristmill.operators import renderers as W
from gristmill.operators import retrieve as R
from gristmill.operators import rules as U
from gristmill.plans.mechanisms import COMPARE_SQL
from gristmill.plans.registry import query
from gristmill.plans.search import QUESTIONS, TERMS_SQL, first_word_sql, read, terms
from gristmill.sources import chats, pages, sheets

# --- entities with their facts ---

ITEM_Q = ((1, "Which small plate was returned?"), (2, "large widget swapped or returned"), (3, "anything about b8"))
ITEM_TERMS = TERMS_SQL.replace(", ".join(f"({i}, '{q}')" for i, q in QUESTIONS), ", ".join(f"({i}, '{q}')" for i, q in ITEM_Q))
LINES_SQL = "l AS (SELECT item_id AS entity_id, sale_id * 1000 + line_no AS fact_id, min(flag || ' in a lot of ' || quantity) AS fact, min(strftime(shipped_at, '%Y-%m-%d')) AS asserted_on FROM sale_lines WHERE item_id IS NOT NULL AND sale_id IS NOT NULL AND line_no IS NOT NULL GROUP BY item_id, sale_id, line_no)"


def item_facts(spark, d):
    lines = read(spark, d, "sale_lines").filter("item_id is not null and sale_id is not null and line_no is not null")
    text = F.concat("flag", F.lit(" in a lot of "), F.col("quantity").cast("string"))
    each = lines.groupBy("item_id", "sale_id", "line_no").agg(F.min(text).alias("fact"), F.min(F.date_format("shipped_at", "yyyy-MM-dd")).alias("asserted_on"))
    return each.select(F.col("item_id").alias("entity_id"), (F.col("sale_id") * 1000 + F.col("line_no")).alias("fact_id"), "fact", "asserted_on")


@query("entity_search_facts", f"""
WITH {ITEM_TERMS}, {LINES_SQL},
e AS (SELECT item_id AS entity_id, lower(name) AS name, lower(coalesce(brand, '')) AS alias FROM items),
h AS (SELECT * FROM (SELECT qid, entity_id, row_number() OVER (PARTITION BY qid ORDER BY sum(n * (CASE WHEN name = term THEN 12 WHEN contains(name, term) THEN 6 ELSE 0 END + CASE WHEN alias = term THEN 8 ELSE 0 END)) DESC, entity_id) AS k,
  FROM e JOIN terms ON contains(name, term) OR contains(alias, term) GROUP BY qid, entity_id) WHERE k <= 3),
o AS (SELECT qid, entity_id, fact_id, sum(n)::BIGINT AS overlap FROM h JOIN l USING (entity_id) JOIN e USING (entity_id) JOIN terms USING (qid)
  WHERE NOT contains(name, term) AND NOT contains(alias, term) AND {first_word_sql('lower(fact)', 'term')} GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY qid, entity_id ORDER BY overlap DESC, fact_id)::INT AS r FROM o),
b AS (SELECT qid, entity_id, fact_id, 0 AS overlap, row_number() OVER (PARTITION BY qid, entity_id ORDER BY coalesce(asserted_on, '') DESC, fact_id)::INT AS r FROM h JOIN l USING (entity_id) WHERE NOT EXISTS (FROM o WHERE o.qid = h.qid AND o.entity_id = h.entity_id))
SELECT qid, entity_id, fact_id, overlap, r FROM m WHERE r <= 5 UNION ALL SELECT * FROM b WHERE r <= 4""")
def entity_search_facts(spark, d):
    """The items a question names, each with the facts that its other words pick, or its latest."""
    asked = R.question_terms(spark.createDataFrame(list(ITEM_Q), "qid int, question string"))
    entities = read(spark, d, "items").select(F.col("item_id").alias("entity_id"), "name", F.array(F.coalesce("brand", F.lit(""))).alias("aliases"))
    none = spark.createDataFrame([], "entity_id long, fact_id long, fact string")
    hits = written(R.search_entities(entities, none, asked).select("qid", "entity_id"))
    return R.entity_facts(hits, entities, item_facts(spark, d), asked)


# --- lines, sheets, replies ---


@query("layer_lines", f"""
WITH {LINES_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY fact_id) AS r FROM l),
f AS (SELECT entity_id, string_agg('- ' || fact || coalesce(' [' || asserted_on || ']', ''), chr(10) ORDER BY fact_id) FILTER (WHERE fact IS NOT NULL) AS lines FROM n WHERE r <= 4 GROUP BY entity_id)
SELECT 'camp' AS layer, item_id AS id, '- ' || name || coalesce(', ' || size, '') || CASE WHEN trim(coalesce(brand, '')) <> '' THEN ' (from ' || brand || ')' ELSE '' END AS line FROM items WHERE name IS NOT NULL
UNION ALL SELECT 'entities', item_id, name || ' (' || kind || '):' || chr(10) || lines FROM items JOIN f ON entity_id = item_id WHERE name IS NOT NULL AND kind IS NOT NULL AND lines IS NOT NULL
UNION ALL SELECT 'people', client_id, '- ' || name || ': ' || coalesce(nullif(concat_ws(', ', segment, city), ''), coalesce(source, '')) FROM clients WHERE name IS NOT NULL
UNION ALL SELECT 'lore', vendor_id, 'Story: ' || name || coalesce(', ' || nation_id, '') || ': ' || balance FROM vendors WHERE name IS NOT NULL AND balance IS NOT NULL""")
def layer_lines(spark, d):
    """One line or block for each row of four tables, as the layers of a sheet show them."""
    i, c, v = read(spark, d, "items").filter("name is not null"), read(spark, d, "clients").filter("name is not null"), read(spark, d, "vendors").filter("name is not null and balance is not null")
    facts = item_facts(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy("fact_id"))).filter("r <= 4 and fact is not null")
    facts = facts.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "fact", "asserted_on"))), lambda x: F.struct(x["fact"].alias("fact"), x["asserted_on"].alias("asserted_on"))).alias("facts"))
    camp = i.select(F.lit("camp").alias("layer"), F.col("item_id").alias("id"), W.fact_line(F.col("name"), F.col("size"), F.col("brand")).alias("line"))
    things = i.filter("kind is not null").join(facts, F.col("item_id") == F.col("entity_id")).select(F.lit("entities"), "item_id", F.array_join(W.entity_lines(F.col("name"), F.col("kind"), F.col("facts")), "\n"))
    topics = F.filter(F.array("segment", "city"), lambda t: t.isNotNull())
    people = c.select(F.lit("people"), "client_id", W.person_line(F.col("name"), topics, F.col("source")))
    lore = v.select(F.lit("lore"), "vendor_id", W.story_line(F.col("name"), F.col("nation_id"), F.col("balance").cast("string")))
    return camp.union(things).union(people).union(lore)


PARTS_SQL = """p AS (SELECT nation_id AS qid, 'camp' AS layer, balance AS rank, name AS text FROM vendors WHERE nation_id IS NOT NULL AND name IS NOT NULL
  UNION ALL SELECT nation_id, 'general', balance, name FROM (SELECT *, row_number() OVER (PARTITION BY nation_id ORDER BY balance NULLS FIRST, name) AS k FROM clients WHERE nation_id IS NOT NULL AND name IS NOT NULL) WHERE k <= 2
  UNION ALL SELECT nation_id, 'lore', balance, segment FROM clients WHERE nation_id IS NOT NULL AND segment IS NOT NULL)"""


def nation_parts(spark, d):
    v, c = read(spark, d, "vendors").filter("nation_id is not null and name is not null"), read(spark, d, "clients").filter("nation_id is not null")
    first = F.row_number().over(Window.partitionBy("nation_id").orderBy("balance", "name"))
    general = c.filter("name is not null").withColumn("k", first).filter("k <= 2")
    camp = v.select(F.col("nation_id").alias("qid"), F.lit("camp").alias("layer"), F.col("balance").alias("rank"), F.col("name").alias("text"))
    return camp.union(general.select("nation_id", F.lit("general"), "balance", "name")).union(c.filter("segment is not null").select("nation_id", F.lit("lore"), "balance", "segment"))


@query("template_replies", f"""
WITH {PARTS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY qid, layer ORDER BY rank NULLS FIRST, text) AS n, CASE layer WHEN 'camp' THEN 0 WHEN 'lore' THEN 4 ELSE 5 END AS place FROM p),
t AS (SELECT qid, string_agg(CASE WHEN layer = 'general' AND n = 1 THEN 'In general:' || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY place, n) AS reply FROM r WHERE n <= CASE layer WHEN 'camp' THEN 3 WHEN 'lore' THEN 1 ELSE 9 END GROUP BY qid)
SELECT n_nationkey::INTEGER AS qid, coalesce(reply, 'Nothing is on record about that.') AS reply FROM nation LEFT JOIN t ON qid = n_nationkey""")
def template_replies(spark, d):
    """A reply for each nation: its vendors first, then one of its clients' words, then what holds in general."""
    return W.replies(read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("qid")), nation_parts(spark, d))


@query("fixed_order_sheets", f"""
WITH {PARTS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY qid, layer ORDER BY rank NULLS FIRST, text) AS n FROM p),
s AS (SELECT qid, CASE layer WHEN 'camp' THEN 0 WHEN 'general' THEN 1 ELSE 2 END AS place, CASE WHEN layer = 'lore' THEN n ELSE 0 END AS part, CASE layer WHEN 'camp' THEN '# Vendors' || chr(10) ELSE '' END || string_agg('- ' || text, chr(10) ORDER BY n) AS section FROM r WHERE n <= 5 GROUP BY qid, layer, CASE WHEN layer = 'lore' THEN n ELSE 0 END),
b AS (SELECT *, sum(length(section) + 1) OVER w AS spent, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY qid ORDER BY place, part ROWS UNBOUNDED PRECEDING))
SELECT qid, string_agg(section, chr(10) ORDER BY place, part) AS sheet FROM b WHERE k = 1 OR spent <= 150 GROUP BY qid""")
def fixed_order_sheets(spark, d):
    """Sheets whose layers never change places, within 150 characters; stories are dropped one by one."""
    n = F.row_number().over(Window.partitionBy("qid", "layer").orderBy("rank", "text"))
    p = nation_parts(spark, d).withColumn("n", n).filter("n <= 5").select("qid", "layer", F.col("n").alias("rank"), F.array(F.concat(F.lit("- "), "text")).alias("lines"))
    return W.fixed_sheet(p, ("camp", "general", "lore"), 150, {"camp": "# Vendors"})


# --- stories, mentions, cards ---


@query("stories_validated", """
WITH s AS (SELECT conv_id, list(turn ORDER BY turn) AS turns, min(text) AS title, max(text) AS story FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, list_filter(turns, lambda t: t % 3 <> 2) AS sources, trim(title) AS title, trim(story) AS story FROM s)
SELECT conv_id AS id, CASE WHEN conv_id % 4 <> 0 THEN 2000 + conv_id % 20 END::INT AS year, CASE WHEN conv_id % 2 = 0 THEN 'user' ELSE '' END AS people, coalesce(array_to_string(nullif(sources, []), ','), '') AS sources,
  CASE WHEN title = '' OR story = '' THEN 'malformed' WHEN contains(title, '@') OR contains(story, '@') THEN 'handle' WHEN len(sources) < 2 THEN 'support' END AS reason FROM c""")
def stories_validated(spark, d):
    """A story told of each conversation, citing all its turns and one that nobody was shown; two thirds of the turns were shown."""
    c = read(spark, d, "conversations")
    s = c.groupBy("conv_id").agg(F.min("text").alias("title"), F.max("text").alias("story"), F.collect_list(F.col("turn").cast("long")).alias("cited"))
    year = F.when(F.col("conv_id") % 4 == 0, 1066).otherwise(2000 + F.col("conv_id") % 20).cast("int")
    people = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(" User "), F.lit("nobody"))).otherwise(F.array(F.lit("nobody")))
    s = s.select(F.col("conv_id").alias("id"), F.col("conv_id").alias("job_id"), "title", "story", year.alias("year"), people.alias("people"), F.concat("cited", F.array(F.lit(999).cast("long"))).alias("cited"))
    shown = c.filter("turn % 3 <> 2").select(F.col("conv_id").alias("job_id"), F.col("turn").cast("long").alias("source_id"))
    v = N.validate_stories(s, shown, c.select(F.col("role").alias("name")).distinct())
    return v.select("id", "year", F.when(F.size("people") > 0, F.lower(F.trim(F.array_join("people", "|")))).otherwise("").alias("people"), F.coalesce(F.array_join("sources", ","), F.lit("")).alias("sources"), "reason")


@query("stories_about", """
WITH p AS (SELECT item_id AS person_id, lower(trim(name)) AS p FROM items WHERE name IS NOT NULL),
e AS (SELECT p_partkey AS id, (2000 + p_size)::INT AS year, lower(trim(unnest(string_split(p_name || ', ' || p_brand, ',')))) AS e FROM part),
n AS (SELECT DISTINCT p FROM p), u AS (SELECT DISTINCT e FROM e WHERE e <> ''),
m AS (SELECT DISTINCT p, e FROM n JOIN u ON e = p OR split_part(e, ' ', 1) = p OR split_part(p, ' ', 1) = e),
h AS (SELECT DISTINCT p, id, year FROM m JOIN e USING (e)),
t AS (SELECT p, id, row_number() OVER (PARTITION BY p ORDER BY year DESC, id)::INT AS r FROM h)
SELECT person_id, id, r FROM p JOIN t USING (p) WHERE r <= 3""")
def stories_about(spark, d):
    """The newest three stories that name somebody; equal names are looked up once."""
    i = read(spark, d, "items").filter("name is not null").withColumn("k", F.lower(F.trim("name")))
    one = i.groupBy("k").agg(F.min("item_id").alias("person_id")).select("person_id", F.col("k").alias("name"))
    part = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (2000 + F.col("p_size")).cast("int").alias("year"), F.concat_ws(", ", "p_name", "p_brand").alias("people"))
    found = N.stories_about(part, one).join(one, "person_id").select(F.col("name").alias("k"), "id", "r")
    return i.select("k", F.col("item_id").alias("person_id")).join(found, "k").select("person_id", "id", "r")


@query("mentions_of", "SELECT conv_id, turn FROM conversations WHERE role <> 'user agent' AND (contains(lower(text), 'user agent') OR contains(lower(text), 'user') OR contains(lower(text), 'useragent'))")
def mentions_of(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("sender"), F.col("text").alias("body"))
    return chats.mentions(c, "user agent").select("conv_id", "turn")


@query("people_cards", r"""
WITH r AS (SELECT client_id AS person_id, name, segment AS role FROM clients WHERE source = 'crm' AND name IS NOT NULL),
c AS (SELECT client_id AS person_id, name, CASE WHEN balance > 3000 THEN city END AS portrait FROM clients WHERE client_id % 3 <> 0 AND name IS NOT NULL),
n AS (SELECT DISTINCT trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g')) AS k FROM r),
u AS (SELECT r.person_id, r.name, role, portrait, 1 AS on_roster FROM r LEFT JOIN c USING (person_id)
  UNION ALL SELECT person_id, name, NULL, portrait, 0 FROM c WHERE person_id NOT IN (SELECT person_id FROM r) AND trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g')) NOT IN (SELECT k FROM n))
SELECT *, (CASE WHEN portrait IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN role IS NOT NULL THEN 2 ELSE 0 END + on_roster)::INT AS tier,
  row_number() OVER (ORDER BY CASE WHEN portrait IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN role IS NOT NULL THEN 2 ELSE 0 END + on_roster DESC, name, person_id) AS place FROM u""")
def people_cards(spark, d):
    c = read(spark, d, "clients").filter("name is not null and client_id is not null")
    roster = c.filter("source = 'crm'").select(F.col("client_id").alias("person_id"), "name", F.col("segment").alias("role"))
    chat = c.filter("client_id % 3 <> 0").select(F.col("client_id").alias("person_id"), "name", F.lit(0).alias("messages"), F.when(F.col("balance") > 3000, F.col("city")).alias("portrait"))
    return K.people_cards(roster, chat).select("person_id", "name", "role", "portrait", "on_roster", "tier", "place")


@query("comparison_names", f"SELECT client_id, regexp_replace({COMPARE_SQL.format('name')}, '\\s+', ' ', 'g') AS norm FROM (SELECT client_id, 'Dr. ' || name || ' (the ' || coalesce(source, 'x') || ') 42' AS name FROM clients WHERE name IS NOT NULL)")
def comparison_names(spark, d):
    name = F.concat(F.lit("Dr. "), "name", F.lit(" (the "), F.coalesce("source", F.lit("x")), F.lit(") 42"))
    return read(spark, d, "clients").filter("name is not null").select("client_id", M.comparison_norm(name).alias("norm"))


@query("legacy_people", f"""SELECT stamp_id, length(trim(raw)) < 2 OR regexp_matches(raw, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{1,2}}:\\d{{2}})') OR regexp_matches(raw, '^\\d+(\\.\\d+)?$')
  OR (regexp_matches(regexp_replace(raw, '[\\s\\-()]', '', 'g'), '^[+\\d]+$') AND length(regexp_replace(raw, '\\D', '', 'g')) >= 7) OR regexp_matches(lower(raw), '({"|".join(U.FOOD)})') OR raw IS NULL AS garbage FROM stamps""")
def legacy_people(spark, d):
    """Which of the texts that stand where names should are none."""
    return read(spark, d, "stamps").select("stamp_id", U.legacy_garbage(F.col("raw")).alias("garbage"))


# --- listings and grids ---


@query("listing_slots", """
WITH e AS (SELECT n_nationkey AS event, n_name AS title FROM nation),
s AS (SELECT DISTINCT strftime(ts, '%m-%d') AS date, (user_id % 25)::INT AS event, CASE WHEN event_id % 5 = 0 THEN '' ELSE strftime(ts, '%H:00') END AS "at" FROM events),
t AS (SELECT *, bool_or("at" <> '') OVER (PARTITION BY event, date) AS timed FROM s)
SELECT t.event, title, date, "at", date = '' AS last FROM t JOIN e USING (event) WHERE NOT timed OR "at" <> ''""")
def listing_slots(spark, d):
    """A listing made of all events, a nation's each: repeats go, and untimed slots beside timed ones."""
    nations = read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.struct(F.col("n_name").alias("title"), F.lit("c").alias("camp"), F.array(F.lit("t")).alias("tags"), F.lit("about").alias("about")).alias("v"))
    titles = nations.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("events"))
    at = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.date_format("ts", "HH:00"))
    slot = read(spark, d, "events").select(F.date_format("ts", "MM-dd").alias("date"), F.struct((F.col("user_id") % 25).cast("int").alias("e"), at.alias("at"), F.lit(None).cast("string").alias("to")).alias("s")).distinct()
    days = slot.groupBy("date").agg(F.collect_list("s").alias("slots")).agg(F.collect_list(F.struct("date", "slots")).alias("days"))  # one listing, as it is published
    found = pages.occurrences(titles.crossJoin(F.broadcast(days)))  # one row each
    return found.select("event", "title", "date", "at", "last")


@query("grid_people", """
SELECT o_orderkey::VARCHAR AS file, 'cat' AS category, 'shift ' || l_linenumber AS shift, CASE l_linenumber % 3 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' ELSE 'Friday' END AS day, 'P' || l_partkey AS person FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def grid_people(spark, d):
    """Each order as a sign-up grid of its lines, three days wide, read back."""
    l = read(spark, d, "lineitem").join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.col("l_orderkey").cast("string").alias("file"), "l_linenumber", "l_partkey")
    k = F.col("l_linenumber") % 3
    cell = lambda row, col, text: F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), text.alias("cell"))
    body = l.select("file", F.explode(F.array(cell(F.col("l_linenumber") + 2, F.lit(0), F.concat(F.lit("shift "), F.col("l_linenumber").cast("string"))), cell(F.col("l_linenumber") + 2, k * 2 + 1, F.concat(F.lit("P"), F.col("l_partkey").cast("string"))))).alias("c"))
    files = read(spark, d, "orders").select("o_orderkey").distinct().select(F.col("o_orderkey").cast("string").alias("file"))
    heads = files.select("file", F.explode(F.array(*[cell(F.lit(1), F.lit(c), F.lit(t)) for c, t in ((1, "Monday"), (3, "Tuesday"), (5, "Friday"))], cell(F.lit(2), F.lit(0), F.lit("cat")))).alias("c"))
    return sheets.grid(body.unionByName(heads).select("file", "c.row", "c.col", "c.cell")).select("file", "category", "shift", "day", "person")




# --- answers, authors, yearly counts ---


@query("answers_found", f"""
WITH {TERMS_SQL},
a AS (SELECT conv_id * 100 + turn AS id, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS body FROM conversations),
n AS (SELECT * FROM a WHERE body IS NOT NULL QUALIFY row_number() OVER (ORDER BY id DESC) <= 400),
h AS (SELECT qid, id, count(DISTINCT term) AS hits FROM n JOIN terms ON {first_word_sql("lower(question || ' ' || body)", 'term')} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, id DESC)::INT AS rank FROM h)
SELECT qid, -id AS id, question AS topic, body AS fact, hits, rank FROM r JOIN n USING (id) WHERE rank <= 3""")
def answers_found(spark, d):
    """What people were asked and said, for the stated questions."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    a = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("question"), F.lead("text").over(w).alias("body")).filter("body is not null")
    return R.search_answers(a, terms(spark))


@query("authored_prompts", """
WITH l AS (SELECT client_id % 50 AS job, change_id, '[' || change_id || '] ' || coalesce(name, '?') || ': ' || coalesce(op, '') AS line FROM client_changes LEFT JOIN clients USING (client_id) WHERE client_id IS NOT NULL)
SELECT job::BIGINT AS job, sha256(string_agg(line, chr(10) ORDER BY change_id)) AS digest FROM l GROUP BY job""")
def authored_prompts(spark, d):
    """Changes as prompts of fifty jobs, each line under its client's name."""
    c = read(spark, d, "client_changes").filter("client_id is not null").withColumnRenamed("client_id", "person_id")
    rows = E.with_author(c, read(spark, d, "clients").select(F.col("client_id").alias("person_id"), "name"))
    line = F.concat(F.lit("["), F.col("change_id").cast("string"), F.lit("] "), "author", F.lit(": "), F.coalesce("op", F.lit("")))
    j = E.jobs(rows.withColumn("job", (F.col("person_id") % 50).cast("long")), "job", line, "change_id", "change_id")
    return j.select("job", F.sha2("prompt", 256).alias("digest"))


@query("yearly_facts", """
WITH c AS (SELECT month(sold_at)::INT AS y, client_id, sale_id FROM sales WHERE status = 'done' AND sold_at IS NOT NULL AND client_id IS NOT NULL AND sale_id IS NOT NULL),
k AS (SELECT y, count(DISTINCT client_id) AS n, count(DISTINCT sale_id) AS cited FROM c GROUP BY y)
SELECT y AS year, n || ' bought in ' || y AS fact, cited FROM k""")
def yearly_facts(spark, d):
    """How many clients bought in each month, with the number of sales that say so."""
    s = read(spark, d, "sales").filter("sale_id is not null").select(F.col("sale_id").alias("row_id"), F.month("sold_at").alias("year"), F.col("client_id").alias("person"), F.when(F.col("status") == "done", "attending").alias("status"))
    facts, evidence = E.yearly_counts(s, "bought")
    cited = evidence.groupBy(F.col("claim_id").cast("int").alias("year")).agg(F.count("*").alias("cited"))
    return facts.join(cited, "year").select("year", "fact", "cited")


@query("legacy_texts", r"""
WITH d AS (SELECT doc_id, text, source || ' ' || left(text, 40) AS title FROM documents)
SELECT doc_id, regexp_matches(title, '(?i)%s') AS title_out, %s OR length(regexp_replace(text, '[^{}\[\]",:]', '', 'g')) / greatest(length(text), 1)::DOUBLE > 0.15 AS content_out, %s OR starts_with(text, '~') OR starts_with(text, chr(8206)) AS system_line FROM d"""
% ("|".join(U.GARBAGE_TITLES), " OR ".join(f"contains(text, '{m}')" for m in U.GARBAGE_MARKS), " OR ".join(f"contains(lower(text), '{m}')" for m in U.SYSTEM_LINES)))
def legacy_texts(spark, d):
    """What a legacy import would leave out of all documents, and by which of its rules."""
    t = F.col("text")
    docs = read(spark, d, "documents").select("doc_id", "text", F.concat("source", F.lit(" "), F.substring("text", 1, 40)).alias("title"))
    return docs.select("doc_id", U.garbage_title(F.col("title")).alias("title_out"), U.garbage_content(t).alias("content_out"), U.system_message(t).alias("system_line"))


@query("pronouns_exempt", r"""
WITH p AS (SELECT conv_id AS person_id, string_agg(CASE turn %% 3 WHEN 0 THEN 'She said ' WHEN 1 THEN 'I''m a man. ' ELSE '' END || text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
SELECT person_id, regexp_matches(text, '(?i)\b(my pronouns|i''?m a (woman|man|guy|girl|dude)|as a (woman|man))\b') AS exempt FROM p WHERE regexp_matches(text, '(?i)\b(he|him|his|she|her|hers|himself|herself)\b')""".replace("%%", "%"))
def pronouns_exempt(spark, d):
    """Gendered texts, and whether those they are about say themselves how to call them."""
    said = F.concat(F.when(F.col("turn") % 3 == 0, "She said ").when(F.col("turn") % 3 == 1, "I'm a man. ").otherwise(""), "text")
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("person_id"), said.alias("body"), "turn")
    whole = c.groupBy("person_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "body"))), lambda x: x["body"]), " ").alias("text"))
    return U.partition_exempt(whole, c).select("person_id", "exempt")

"""Named queries: retrieval, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.dates import recency
from gristmill.operators import retrieve as R
from gristmill.operators import vector_ranks as K
from gristmill.operators import vectors as V
from gristmill.plans.registry import query

NOW = 2026
#: Stated queries are broadcast up to this number; more meet the vectors in several lots.
BROADCAST_QUERIES = 10_000
QUESTIONS = ((1, "Where is the thon and what about theand?"), (2, "Who was at the erer?"), (3, "tell me about der und die"), (4, "le la and les"))
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
TERMS_SQL = (
    "q(qid, question) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + "), "
    r"w AS (SELECT qid, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}]+')) AS term FROM q), "
    f"terms AS (SELECT qid, term, count(*) AS n FROM w WHERE length(term) > 1 AND NOT list_contains({STOP_SQL}, term) GROUP BY ALL)"
)


def read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "qid int, question string")


def terms(spark: SparkSession) -> DataFrame:
    return R.question_terms(questions(spark))


def first_word_sql(lower: str, term: str) -> str:
    """Twin of contains_word."""
    i = f"instr({lower}, {term})"
    return (
        f"({i} > 0 AND ({i} = 1 OR NOT regexp_matches(substr({lower}, {i} - 1, 1), '[\\p{{L}}\\p{{N}}]')) "
        f"AND NOT regexp_matches(substr({lower}, {i} + length({term}), 1), '[\\p{{L}}\\p{{N}}]'))"
    )


#: Twin of passages: from f(qid, doc_id, ...) and documents to pas(qid, doc_id, passage), readable ones only.
PASSAGES_SQL = f"""
pw AS (SELECT f.qid, f.doc_id, term, string_split(lower(text), term) AS parts FROM f JOIN documents USING (doc_id) JOIN terms ON terms.qid = f.qid WHERE {first_word_sql('lower(text)', 'term')}),
pp AS (SELECT qid, doc_id, term, len(parts) AS m, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM pw),
pq AS (SELECT qid, doc_id, term, i, m, sum(length(part)) OVER (PARTITION BY qid, doc_id, term ORDER BY i) + (i - 1) * length(term) AS p FROM pp),
pn AS (SELECT *, count(*) OVER (PARTITION BY qid, doc_id ORDER BY p RANGE BETWEEN 220 PRECEDING AND 220 FOLLOWING) AS near FROM pq WHERE i < m),
pa AS (SELECT qid, doc_id, arg_min(p, (-near, term, i))::BIGINT AS anchor FROM pn GROUP BY ALL),
pr AS (SELECT qid, doc_id, trim(regexp_replace(substr(text, greatest(anchor - 220, 0) + 1, least(anchor + 220, length(text)) - greatest(anchor - 220, 0)), '[ \n]+', ' ', 'g')) AS raw, anchor > 220 AS late, anchor + 220 < length(text) AS early FROM pa JOIN documents USING (doc_id)),
pl AS (SELECT *, late AND instr(raw, '.') BETWEEN 1 AND 90 AS led FROM pr),
pc AS (SELECT *, CASE WHEN led THEN trim(substr(raw, instr(raw, '.') + 1)) ELSE raw END AS w FROM pl),
pd AS (SELECT *, CASE WHEN late AND NOT led AND contains(w, ' ') THEN '… ' || regexp_replace(w, '^[^ ]* ', '') ELSE w END AS w2 FROM pc),
pe AS (SELECT qid, doc_id, CASE WHEN early AND contains(w2, ' ') THEN regexp_replace(w2, ' [^ ]*$', '') || ' …' ELSE w2 END AS passage FROM pd),
pas AS (SELECT * FROM pe WHERE len(list_filter(string_split(passage, ' '), lambda w: w <> '')) > 0 AND len(list_filter(string_split(passage, ' '), lambda w: length(w) > 25)) = 0
  AND (length(passage) - length(regexp_replace(passage, '[{{}}\\[\\]"]', '', 'g'))) / length(passage)::DOUBLE <= 0.02 AND (length(passage) - length(replace(passage, ' ', ''))) / length(passage)::DOUBLE > 1 / 12::DOUBLE)"""

RANK = "row_number() OVER (PARTITION BY qid ORDER BY {0})::INT AS rank"
DECAY = f"CASE WHEN {{0}} IS NULL OR {{0}} <= 0 THEN 0.6 ELSE greatest(0.35, pow(0.88, greatest(0, {NOW} - {{0}}))) END"


@query("terms_of_questions", f"""
SELECT conv_id, turn, list_aggregate(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'),
       lambda w: length(w) > 1 AND NOT list_contains({STOP_SQL}, w)), 'string_agg', ' ') AS terms
FROM conversations WHERE role = 'user'""")
def terms_of_questions(spark, d):
    t = F.array_join(T.terms(F.col("text")), " ")
    return read(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.when(t != "", t).alias("terms"))


@query("doc_search_topk", f"""
WITH {TERMS_SQL},
t AS (SELECT doc_id, length(text) AS n_chars, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
h AS (SELECT qid, doc_id, n_chars, count(*) AS occ, count(DISTINCT term) AS k FROM t JOIN terms USING (term) GROUP BY ALL),
s AS (SELECT qid, doc_id, round(least(occ::DOUBLE, 40) * 0.6 + least(occ * 1000.0::DOUBLE / greatest(n_chars, 1), 3) + CASE WHEN k >= 2 THEN k ELSE 0 END, 6) AS score FROM h),
r AS (SELECT *, {RANK.format('score DESC, doc_id')} FROM s WHERE score >= 4)
SELECT qid, doc_id, score, rank FROM r WHERE rank <= 2""")
def doc_search_topk(spark, d):
    """The flagship: documents for a list of questions."""
    return R.search_documents(read(spark, d, "documents").select("doc_id", "text"), terms(spark))


@query("doc_search_recency", f"""
WITH {TERMS_SQL},
d AS (SELECT doc_id, text, source AS title, lang AS category, 2016 + (doc_id % 11)::INT AS year FROM documents),
t AS (SELECT doc_id, length(text) AS n_chars, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM d),
h AS (SELECT qid, doc_id, n_chars, count(*) AS occ, count(DISTINCT term) AS k FROM t JOIN terms USING (term) GROUP BY ALL),
s AS (SELECT qid, doc_id, year, least(occ::DOUBLE, 40) * 0.6 + least(occ * 1000.0::DOUBLE / greatest(n_chars, 1), 3) + CASE WHEN k >= 2 THEN k ELSE 0 END AS s FROM h JOIN d USING (doc_id)),
f AS (SELECT qid, doc_id, round(s * {DECAY.format('year')}, 6) AS score FROM s WHERE round(s * {DECAY.format('year')}, 6) >= 4),{PASSAGES_SQL},
r AS (SELECT f.*, {RANK.format('score DESC, doc_id')} FROM f SEMI JOIN pas USING (qid, doc_id))
SELECT qid, doc_id, score, rank FROM r WHERE rank <= 2""")
def doc_search_recency(spark, d):
    """Documents with a readable passage, by score and year: those without one are skipped before places are given."""
    docs = read(spark, d, "documents").select("doc_id", "text", F.col("source").alias("title"), F.col("lang").alias("category"), (2016 + F.col("doc_id") % 11).cast("int").alias("year"))
    return R.search_documents(docs, terms(spark), now=NOW, readable=True).drop("passage")


PART_Q = ((1, "Do we have a red widget or a blue bolt?"), (2, "any small steel gear"), (3, "large brass"))
PART_TERMS = TERMS_SQL.replace(", ".join(f"({i}, '{q}')" for i, q in QUESTIONS), ", ".join(f"({i}, '{q}')" for i, q in PART_Q))


def part_terms(spark: SparkSession) -> DataFrame:
    return R.question_terms(spark.createDataFrame(list(PART_Q), "qid int, question string"))


@query("entity_search", f"""
WITH {PART_TERMS},
e AS (SELECT p_partkey AS entity_id, lower(p_name) AS name, lower(p_brand) AS alias FROM part),
m AS (SELECT qid, entity_id, term, n, CASE WHEN name = term THEN 12 WHEN contains(name, term) THEN 6 ELSE 0 END + CASE WHEN alias = term THEN 8 ELSE 0 END AS p
      FROM e JOIN terms ON contains(name, term) OR contains(alias, term)),
f AS (SELECT p_partkey AS entity_id, p_partkey AS fact_id, lower(p_type) AS fact FROM part),
o AS (SELECT qid, entity_id, sum(n) AS o FROM f JOIN terms ON {first_word_sql('fact', 'term')}
      WHERE NOT EXISTS (FROM m WHERE m.qid = terms.qid AND m.entity_id = f.entity_id AND m.term = terms.term) GROUP BY qid, entity_id, fact_id),
s AS (SELECT qid, entity_id, sum(p * n)::DOUBLE AS p FROM m GROUP BY ALL UNION ALL SELECT qid, entity_id, sum(o * o)::DOUBLE FROM o GROUP BY ALL),
t AS (SELECT qid, entity_id, sum(p) AS score FROM s GROUP BY ALL HAVING sum(p) > 0),
r AS (SELECT *, {RANK.format('score DESC, entity_id')} FROM t)
SELECT qid, entity_id, score, rank FROM r WHERE rank <= 3""")
def entity_search(spark, d):
    part = read(spark, d, "part")
    entities = part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))
    facts = part.select(F.col("p_partkey").alias("entity_id"), F.col("p_partkey").alias("fact_id"), F.col("p_type").alias("fact"))
    return R.search_entities(entities, facts, part_terms(spark))


SYN = ((3, "thon place"), (6, "erer"), (9, "und weg"), (12, "les gens"))


@query("fact_search_synonyms", f"""
WITH {TERMS_SQL},
f AS (SELECT doc_id AS fact_id, source AS topic, text AS fact, 2016 + (doc_id % 11)::INT AS year FROM documents),
y(fact_id, word) AS (VALUES {', '.join(f"({i}, '{w}')" for i, w in SYN)}),
yt AS (SELECT DISTINCT fact_id, t AS term FROM (SELECT fact_id, unnest(regexp_extract_all(lower(word), '[\\p{{L}}\\p{{N}}]+')) AS t FROM y) WHERE length(t) > 2),
m AS (SELECT qid, f.fact_id, terms.term, n, year, CASE WHEN lower(topic) = terms.term THEN 8 ELSE 0 END
        + CASE WHEN {first_word_sql('lower(fact)', 'terms.term')} THEN 3 WHEN yt.term IS NOT NULL THEN 2 ELSE 0 END AS p
      FROM f CROSS JOIN terms LEFT JOIN yt ON yt.fact_id = f.fact_id AND yt.term = terms.term),
s AS (SELECT qid, fact_id, round(sum(p * n) * any_value({DECAY.format('year')}), 6) AS score FROM m GROUP BY ALL HAVING sum(p) > 0),
r AS (SELECT *, {RANK.format('score DESC, fact_id')} FROM s)
SELECT qid, fact_id, score, rank FROM r WHERE rank <= 5""")
def fact_search_synonyms(spark, d):
    facts = read(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), F.col("source").alias("topic"), F.col("text").alias("fact"), (2016 + F.col("doc_id") % 11).cast("int").alias("year"))
    return R.search_facts(facts, spark.createDataFrame(list(SYN), "fact_id long, word string"), terms(spark), NOW)


@query("general_search", f"""
WITH {PART_TERMS},
g AS (SELECT p_partkey AS id, p_brand AS topic, p_name AS fact FROM part),
m AS (SELECT qid, id, n * CASE WHEN lower(topic) = term THEN 2.0 WHEN {first_word_sql('lower(fact)', 'term')} THEN 1.0 ELSE 0 END AS p FROM g CROSS JOIN terms),
s AS (SELECT qid, id, sum(p)::DOUBLE AS score FROM m GROUP BY ALL HAVING sum(p) > 0),
r AS (SELECT *, {RANK.format('score DESC, id')} FROM s)
SELECT qid, id, score, rank FROM r WHERE rank <= 2""")
def general_search(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("topic"), F.col("p_name").alias("fact"))
    return R.search_general(rows, part_terms(spark))


@query("people_search", f"""
WITH {PART_TERMS},
x AS (SELECT DISTINCT l_suppkey AS person_id, p_name AS topic, CASE WHEN p_size >= 35 THEN 'strong' WHEN p_size >= 15 THEN 'moderate' ELSE 'mentioned' END AS strength
      FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT person_id, topic, strength, qid, sum(n) AS m FROM x JOIN terms ON {first_word_sql('lower(topic)', 'term')} GROUP BY ALL),
k AS (SELECT s_suppkey AS person_id, s_name AS known_for FROM supplier),
km AS (SELECT qid, person_id, sum(n) AS m FROM k JOIN terms ON {first_word_sql('lower(known_for)', 'term')} GROUP BY ALL),
u AS (SELECT qid, person_id, m, m::DOUBLE / greatest(len(list_filter(string_split(lower(topic), ' '), lambda w: w <> '')), 1) AS c,
             m * CASE strength WHEN 'strong' THEN 3.0::DOUBLE WHEN 'moderate' THEN 2.0 ELSE 1.0 END AS s FROM e
      UNION ALL SELECT qid, person_id, m, 0.0, m * 2.0::DOUBLE FROM km),
s AS (SELECT qid, person_id, sum(m)::BIGINT AS matched, round(sum(c), 6) AS coverage, round(sum(s), 6) AS strength FROM u GROUP BY ALL),
r AS (SELECT *, {RANK.format('matched DESC, coverage DESC, strength DESC, person_id')} FROM s)
SELECT qid, person_id, matched, coverage, strength, rank FROM r WHERE rank <= 4""")
def people_search(spark, d):
    strength = F.when(F.col("p_size") >= 35, "strong").when(F.col("p_size") >= 15, "moderate").otherwise("mentioned")
    lines = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    x = lines.join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("person_id"), F.col("p_name").alias("topic"), strength.alias("strength")).distinct()
    known = read(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("known_for"))
    return R.search_people(x, known, part_terms(spark))


@query("story_search", f"""
WITH {TERMS_SQL},
g AS (SELECT conv_id * 100 + turn AS id, role AS title, text AS story, '' AS people FROM conversations),
b AS (SELECT id, unnest(regexp_extract_all(lower(story), '[\\p{{L}}\\p{{N}}]+')) AS term FROM g),
bs AS (SELECT qid, id, least(count(*), 3) * any_value(n) AS p FROM b JOIN terms USING (term) GROUP BY qid, id, term),
ts AS (SELECT qid, id, 3 * n AS p FROM g JOIN terms ON {first_word_sql('lower(title)', 'term')}),
s AS (SELECT qid, id, sum(p)::DOUBLE AS score FROM (FROM bs UNION ALL FROM ts) GROUP BY ALL HAVING sum(p) >= 2),
r AS (SELECT *, {RANK.format('score DESC, id')} FROM s)
SELECT qid, id, score, rank FROM r WHERE rank <= 2""")
def story_search(spark, d):
    stories = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("title"), F.col("text").alias("story"), F.lit("").alias("people"))
    return R.search_stories(stories, terms(spark))


@query("vector_topk", """
WITH q AS (SELECT vec_id AS qid, embedding AS query FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, vec_id, round(list_sum(list_transform(list_zip(embedding, query), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
        / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(query, lambda x: x::DOUBLE * x)))), 6) AS similarity
      FROM embeddings JOIN q ON vec_id <> qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id)::INT AS rank FROM s WHERE similarity >= 0.2)
SELECT qid, vec_id, similarity, rank FROM r WHERE rank <= 5""")
def vector_topk(spark, d):
    base = read(spark, d, "embeddings").select("vec_id", "embedding")
    return V.nearest(base, base.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), 5, floor=0.2)


@query("vector_health", """
SELECT count(*) AS vectors, count(DISTINCT len(embedding)) AS lengths,
       count(*) FILTER (WHERE len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS not_finite,
       count(*) FILTER (WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) - 1) > 1e-3) AS not_unit FROM embeddings""")
def vector_health(spark, d):
    return V.health(read(spark, d, "embeddings"))


@query("vector_floor_union", """
WITH q AS (SELECT vec_id AS qid, embedding AS query, label FROM embeddings WHERE vec_id % 50 = 0),
l AS (SELECT qid, vec_id AS id, (100 - row_number() OVER (PARTITION BY qid ORDER BY vec_id))::DOUBLE AS score FROM q JOIN embeddings e ON e.label = q.label AND vec_id <> qid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY vec_id) <= 3),
s AS (SELECT qid, vec_id AS id, round(list_sum(list_transform(list_zip(embedding, query), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
        / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(query, lambda x: x::DOUBLE * x)))), 6) AS similarity FROM embeddings JOIN q ON vec_id <> qid),
n AS (SELECT * FROM s WHERE similarity >= 0.2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) <= 10),
f AS (SELECT * FROM n WHERE NOT EXISTS (FROM l WHERE l.qid = n.qid AND l.id = n.id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) <= 2),
u AS (SELECT qid, id, 0 AS tier, score AS weight FROM l UNION ALL SELECT qid, id, 1, similarity FROM f)
SELECT qid, id, tier, weight, row_number() OVER (PARTITION BY qid ORDER BY tier, weight DESC, id)::INT AS place FROM u""")
def vector_floor_union(spark, d):
    """Rows found by label first, then the nearest by cosine that aren't among them."""
    from pyspark.sql import Window

    e = read(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"), "label")
    # of each label the four smallest ids, three rows of each at most: without a question's own, its first three are among them
    ids = e.groupBy("label", F.col("vec_id").alias("id")).agg(F.least(F.count("*"), F.lit(3)).cast("int").alias("times"))
    least = ids.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("id"))).filter("_r <= 4")
    same = least.select("label", "id", F.explode(F.sequence(F.lit(1), F.col("times")))).join(q.select("qid", "label"), "label").filter("id <> qid").select("qid", "id")
    n = F.row_number().over(Window.partitionBy("qid").orderBy("id"))
    lexical = same.withColumn("n", n).filter("n <= 3").select("qid", "id", (100 - F.col("n")).cast("double").alias("score"))
    near = V.nearest(e.select("vec_id", "embedding"), q.select("qid", "query"), 10, floor=0.2)
    return V.with_semantic(lexical, near.select("qid", F.col("vec_id").alias("id"), "similarity"))


@query("vector_percentiles", """
WITH q AS (SELECT vec_id AS qid, embedding AS query FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, label, list_sum(list_transform(list_zip(embedding, query), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS s FROM embeddings, q),
l AS (SELECT qid, label, list_sort(list(round(s, 6))) AS v FROM s GROUP BY ALL)
SELECT qid, label, len(v) AS n, v[len(v) // 2 + 1] AS median, v[(len(v) * 90 + 99) // 100] AS p90 FROM l""")
def vector_percentiles(spark, d):
    """Similarities of the stated queries with all vectors, by label: exact order statistics."""
    e = read(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    return K.order_statistics(e.select("label", "embedding"), q, {"median": K.upper_median, "p90": K.nearest_rank(90)}, lot=BROADCAST_QUERIES)


@query("alias_widening", f"""
WITH w AS (SELECT conv_id * 100 + turn AS qid, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM conversations WHERE role = 'user'),
terms AS (SELECT qid, term, count(*) AS n FROM w WHERE length(term) > 1 AND NOT list_contains({STOP_SQL}, term) GROUP BY ALL),
a AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS alias, p_brand || ' ' || p_type AS name FROM part UNION ALL VALUES ('thon', 'Anton Thonberg'), ('erer', 'The Erer House')),
m AS (SELECT DISTINCT qid, t AS term FROM (SELECT qid, unnest(list_filter(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 AND NOT list_contains({STOP_SQL}, w))) AS t FROM terms JOIN a ON alias = term))
SELECT qid, term, n FROM terms UNION ALL SELECT qid, term, 1 FROM m WHERE NOT EXISTS (FROM terms WHERE terms.qid = m.qid AND terms.term = m.term)""")
def alias_widening(spark, d):
    """The terms of all questions that were asked, with the words of the names that a term is another name of."""
    c = read(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), F.col("text").alias("question"))
    parts = read(spark, d, "part").select(F.split("p_name", " ")[0].alias("alias"), F.concat_ws(" ", "p_brand", "p_type").alias("name")).distinct()
    named = spark.createDataFrame([("thon", "Anton Thonberg"), ("erer", "The Erer House")], "alias string, name string")
    return R.widen(R.question_terms(c), parts.unionByName(named))


@query("recency_weights", f"SELECT doc_id, round({DECAY.format('y')}, 9) AS weight FROM (SELECT doc_id, nullif(2016 + (doc_id % 12)::INT, 2027) AS y FROM documents)")
def recency_weights(spark, d):
    y = F.nullif((2016 + F.col("doc_id") % 12).cast("int"), F.lit(2027))
    return read(spark, d, "documents").select("doc_id", F.round(recency(y, NOW), 9).alias("weight"))


DOCS_SQL = f"""{TERMS_SQL},
t AS (SELECT doc_id, length(text) AS n_chars, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
h AS (SELECT qid, doc_id, n_chars, count(*) AS occ, count(DISTINCT term) AS k FROM t JOIN terms USING (term) GROUP BY ALL),
s AS (SELECT qid, doc_id, round(least(occ::DOUBLE, 40) * 0.6 + least(occ * 1000.0::DOUBLE / greatest(n_chars, 1), 3) + CASE WHEN k >= 2 THEN k ELSE 0 END, 6) AS score FROM h),
f AS (SELECT * FROM s WHERE score >= 4),{PASSAGES_SQL},
r AS (SELECT f.*, passage, {RANK.format('score DESC, doc_id')} FROM f JOIN pas USING (qid, doc_id))"""
LEAD_SQL = (
    "CASE WHEN instr({0}, '##') > 0 THEN CASE WHEN length(substr({0}, instr({0}, '##') + 2)) > 80 THEN trim(substr({0}, instr({0}, '##') + 2)) ELSE {0} END "
    "WHEN instr({0}, '.') BETWEEN 1 AND 60 THEN trim(substr({0}, instr({0}, '.') + 1)) ELSE {0} END"
)


@query("passages", f"WITH {DOCS_SQL} SELECT qid, doc_id, rank, {LEAD_SQL.format('passage')} AS passage FROM r WHERE rank <= 2")
def passages(spark, d):
    """The densest readable window of each document found; documents without one are skipped before places are given."""
    return readable_documents(spark, d).select("qid", "doc_id", "rank", R.clean_lead(F.col("passage")).alias("passage"))


def readable_documents(spark, d):
    return R.search_documents(read(spark, d, "documents").select("doc_id", "text"), terms(spark), readable=True)


# --- words and meaning together ---


def question_vectors(spark, d):
    """(qid, query): the questions' vectors are those with the ids 50, 100, 150 ... of the table."""
    return read(spark, d, "embeddings").join(F.broadcast(questions(spark)), F.col("vec_id") == F.col("qid") * 50).select("qid", F.col("embedding").alias("query"))


def near_rows(spark, d, k: int, floor: float = 0.2):
    rows = read(spark, d, "embeddings").select("vec_id", "embedding")
    return V.nearest(rows, question_vectors(spark, d), k, floor).select("qid", F.col("vec_id").alias("id"), "similarity")


def near_sql(k: int) -> str:
    return f"""nq AS (SELECT qid, embedding AS query FROM q JOIN embeddings ON vec_id = qid * 50),
ns AS (SELECT qid, vec_id AS id, round(list_sum(list_transform(list_zip(embedding, query), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
        / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(query, lambda x: x::DOUBLE * x)))), 6) AS similarity FROM embeddings JOIN nq ON vec_id <> qid),
near AS (SELECT * FROM ns WHERE similarity >= 0.2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) <= {4 * k}),
lex AS (SELECT r.*, similarity FROM r LEFT JOIN near USING (qid, id)),
fresh AS (SELECT near.qid, near.id, near.similarity, row_number() OVER (PARTITION BY near.qid ORDER BY near.similarity DESC, near.id) AS n FROM near JOIN topics USING (id) WHERE coalesce(topic, '') <> 'roster' AND NOT EXISTS (FROM r WHERE r.qid = near.qid AND r.id = near.id)),
last AS (SELECT qid, max(rank) AS last FROM r GROUP BY qid)
SELECT qid::BIGINT AS qid, id, score, rank, similarity FROM lex UNION ALL SELECT qid::BIGINT, id, NULL, (coalesce(last, 0) + n)::INT, similarity FROM fresh LEFT JOIN last USING (qid) WHERE n <= 2"""


@query("fact_search_semantic", f"""
WITH {TERMS_SQL},
f AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'roster' ELSE source END AS topic, text AS fact, 2016 + (doc_id % 11)::INT AS year FROM documents),
topics AS (SELECT id, topic FROM f),
m AS (SELECT qid, f.id, terms.term, n, year, CASE WHEN lower(topic) = terms.term THEN 8 WHEN false THEN 0 ELSE 0 END + CASE WHEN {first_word_sql('lower(fact)', 'terms.term')} THEN 3 ELSE 0 END AS p FROM f CROSS JOIN terms),
s AS (SELECT qid, id, round(sum(p * n) * any_value({DECAY.format('year')}), 6) AS score FROM m GROUP BY ALL HAVING sum(p) > 0),
r AS (SELECT * FROM (SELECT *, {RANK.format('score DESC, id')} FROM s) WHERE rank <= 5),
{near_sql(5)}""")
def fact_search_semantic(spark, d):
    """Facts by words, then up to two by meaning that words don't reach; rows of the roster only by words."""
    topic = F.when(F.col("doc_id") % 3 == 0, "roster").otherwise(F.col("source"))
    facts = read(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), topic.alias("topic"), F.col("text").alias("fact"), (2016 + F.col("doc_id") % 11).cast("int").alias("year"))
    none = spark.createDataFrame([], "fact_id long, word string")
    return R.search_facts(facts, none, terms(spark), NOW, near=near_rows(spark, d, 40)).withColumnRenamed("fact_id", "id")


@query("story_search_semantic", f"""
WITH {TERMS_SQL},
g AS (SELECT conv_id * 100 + turn AS story_id, conv_id AS vec, turn, role AS title, text AS story FROM conversations),
u AS (SELECT *, vec AS id FROM g WHERE turn = 0),
topics AS (SELECT id, 'any' AS topic FROM u),
b AS (SELECT id, unnest(regexp_extract_all(lower(story), '[\\p{{L}}\\p{{N}}]+')) AS term FROM u),
bs AS (SELECT qid, id, least(count(*), 3) * any_value(n) AS p FROM b JOIN terms USING (term) GROUP BY qid, id, term),
ts AS (SELECT qid, id, 3 * n AS p FROM u JOIN terms ON {first_word_sql('lower(title)', 'term')}),
s AS (SELECT qid, id, sum(p)::DOUBLE AS score FROM (FROM bs UNION ALL FROM ts) GROUP BY ALL HAVING sum(p) >= 2),
r AS (SELECT * FROM (SELECT *, {RANK.format('score DESC, id')} FROM s) WHERE rank <= 2),
{near_sql(2)}""")
def story_search_semantic(spark, d):
    """Stories - the first turns of conversations - by words, then up to two by meaning."""
    stories = read(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("id"), F.col("role").alias("title"), F.col("text").alias("story"), F.lit("").alias("people"))
    near = near_rows(spark, d, 8).join(stories.select("id"), "id", "left_semi")
    return R.search_stories(stories, terms(spark), near=near)

"""Scored retrieval, many questions at once: every function takes terms(qid, term) and returns ranked rows by qid.

Word tests go through an inverted index (distinct words per row) and an equi-join on the term, so nothing is multiplied
out; names, topics and titles, where substrings count, are small vocabularies by nature and are matched by token as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.dates import recency
from gristmill.functions.shared import written
from gristmill.operators import vectors as V

#: Documents of each question whose passages are cut at first.
WIDTH = 32

#: Fixed lists: titles that mark a document as authoritative, and as paperwork.
MANUALS = ("manual", "potentially useful info", "binder", "handbook", "survival guide")
PAPERWORK = ("receipt", "invoice", "expense", "budget", "order", "costco", "walmart")


def question_terms(questions: DataFrame, previous: str | None = None) -> DataFrame:
    """(qid, term, n): distinct terms with their repeats. A question of fewer than two terms borrows its ``previous`` one's."""
    own = T.terms(F.col("question"))
    if previous:
        carried = T.terms(F.coalesce(F.col(previous), F.lit("")))
        own = F.when(F.size(own) < 2, F.concat(own, F.array_except(carried, own))).otherwise(own)
    return questions.select("qid", F.explode(own).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("n"))


def widen(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds the words of the canonical name of each alias that a term equals; the term itself stays."""
    found = terms.join(aliases.select(F.lower("alias").alias("term"), "name"), "term").select("qid", F.explode(T.terms(F.col("name"))).alias("term"))
    more = found.distinct().join(terms, ["qid", "term"], "left_anti").withColumn("n", F.lit(1).cast("long"))
    return terms.unionByName(more)


def word_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, hits): whole-word counts of every row's text."""
    return rows.select(key, F.explode(T.words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("hits"))


def term_hits(rows: DataFrame, terms: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, term, hits): the rows' whole-word counts of the questions' terms.

    A short vocabulary, counted first, is looked for inside each row, so that nothing but hits leaves the scan; a long one is met by a join.
    """
    vocabulary = [r["term"] for r in terms.select("term").distinct().limit(257).collect()]
    if len(vocabulary) <= 256:
        first = "".join(sorted({w[0] for w in vocabulary})) or "x"  # terms are letters and digits
        whole = rf"(?=[{first}])(?<!{T.WORD_CHARS})(?:{'|'.join(sorted(vocabulary)) or '(?!)'})(?!{T.WORD_CHARS})"
        mine = F.regexp_extract_all(F.lower(text), F.lit(whole), F.lit(0))
        found = rows.select(*keep, mine.alias("_mine")).filter(F.size("_mine") > 0)
        return found.select(*keep, "_mine", F.explode(F.array_distinct("_mine")).alias("term")).select(*keep, "term", F.size(F.filter("_mine", lambda w: w == F.col("term"))).cast("long").alias("hits"))
    return rows.select(*keep, F.explode(T.words(F.col(text))).alias("term")).join(terms.select("term").distinct(), "term").groupBy(*keep, "term").agg(F.count("*").alias("hits"))


def first_word_hits(rows: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(qid, key, term, n): terms whose first occurrence in the text is a whole word.

    The equi-join on words nominates; the first-occurrence test then decides on the row's own text, joined back by its key.
    """
    hits = term_hits(rows.select(key, text), terms, text, key).select(key, "term").distinct()
    both = hits.join(rows.select(key, F.lower(text).alias("_lower")), key)
    return both.filter(T.contains_word(F.col("_lower"), F.col("term"))).select(key, "term").distinct().join(_small(terms), "term").select("qid", key, "term", "n")


def _small(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= 10_000 else terms


def top(scored: DataFrame, k: int, key: str, *order: Column) -> DataFrame:
    """The first k of each question; ties go to the smaller key."""
    w = Window.partitionBy("qid").orderBy(*(order or (F.desc("score"),)), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def authority(title: Column, category: Column) -> Column:
    any_of = lambda marks: F.exists(T.strings(marks), lambda m: F.contains(title, m))
    return F.when(any_of(MANUALS), 14.0).otherwise(0.0) - F.when(any_of(PAPERWORK), 10.0).otherwise(0.0) + F.when(category == "operations", 2.0).otherwise(0.0)


def search_documents(docs: DataFrame, terms: DataFrame, now: int | None = None, k: int = 2, floor: float = 4.0, readable: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank). ``docs`` has doc_id and text; title, category and year count where it has them.

    Occurrences, capped, and their density; a bonus for two or more different terms; title and category matches; authority;
    then recency where ``now`` is given and the score is positive; at least ``floor``. ``readable``: documents without a readable
    passage are skipped before places are given, and the passage comes along.
    """
    small = _small(terms)
    names = docs.columns
    body = term_hits(docs.withColumn("n_chars", F.length("text")), terms, "text", "doc_id", "n_chars")
    hits = body.join(small, "term").groupBy("qid", "doc_id", "n_chars").agg(F.sum("hits").alias("occ"), F.count("*").alias("different"))
    per1k = F.col("occ") * 1000.0 / F.greatest(F.col("n_chars"), F.lit(1))
    base = F.least(F.col("occ").cast("double"), F.lit(40.0)) * 0.6 + F.least(per1k, F.lit(3.0)) + F.when(F.col("different") >= 2, F.col("different")).otherwise(0)
    scored = hits.select("qid", "doc_id", base.alias("body"))
    extra = [c for c in ("title", "category", "year") if c in names]
    if extra:
        side = docs.select("doc_id", *extra)
        if "title" in extra:
            titled = first_word_hits(docs, terms, "doc_id", "title").groupBy("qid", "doc_id").agg((F.count("*") * 6.0).alias("titled"))
            scored = scored.join(titled, ["qid", "doc_id"], "full")
        scored = scored.join(side, "doc_id")
        score = F.coalesce("body", F.lit(0.0)) + (F.coalesce("titled", F.lit(0.0)) if "title" in extra else F.lit(0.0))
        if "category" in extra:
            in_category = docs.select("doc_id", F.lower("category").alias("term")).join(small, "term").select("qid", "doc_id", F.lit(5.0).alias("filed"))
            scored = scored.join(in_category, ["qid", "doc_id"], "left")
            score = score + F.coalesce("filed", F.lit(0.0))
        title = F.lower(F.col("title")) if "title" in extra else F.lit("")
        category = F.lower(F.col("category")) if "category" in extra else F.lit("")
        score = score + authority(title, category)
        if now is not None and "year" in extra:
            score = F.when(score > 0, score * recency(F.col("year"), now)).otherwise(score)
    else:
        score = F.col("body")
    scored = scored.select("qid", "doc_id", F.round(score, 6).alias("score")).filter(F.col("score") >= floor)
    if readable:
        return first_readable(scored, docs, terms, k)
    return top(scored, k, "doc_id")


def first_readable(scored: DataFrame, docs: DataFrame, terms: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """(scored, passage, rank): the first k of each question that have a readable passage.

    Passages are cut for the first ``width`` of each question alone; for those questions that find fewer than k among them and have more, for
    the next, eight times as many, and so on to the last row. So texts are only cut where their places can still matter.
    """
    scored = written(scored)
    asked, found, low = scored, None, 0
    while True:
        band = written(top(asked, low + width, "doc_id").filter(F.col("rank") > low).drop("rank"))
        ids = band.select("qid", "doc_id").distinct()
        texts = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= 10_000 else ids, "doc_id")
        cut = written(band.join(passages(texts, terms), ["qid", "doc_id"]))
        found = cut if found is None else found.unionByName(cut)
        enough = found.groupBy("qid").count().filter(F.col("count") >= k)
        more = written(band.groupBy("qid").count().filter(F.col("count") >= width).join(enough, "qid", "left_anti").select("qid"))
        if more.isEmpty():
            return top(found, k, "doc_id")
        asked, low, width = scored.join(more, "qid", "left_semi"), low + width, width * 8


def search_entities(entities: DataFrame, facts: DataFrame, terms: DataFrame, k: int = 3) -> DataFrame:
    """(qid, entity_id, score, rank). Entities (entity_id, name, aliases), facts (entity_id, fact_id, fact).

    A name equal to a term 12, one that holds it 6, an alias equal to it 8; per fact, the square of the terms it has that no name has.
    """
    named = entities.select("entity_id", F.lower("name").alias("name"), F.transform("aliases", F.lower).alias("aliases"))
    each = named.join(_small(terms), F.contains(F.col("name"), F.col("term")) | F.exists("aliases", lambda a: F.contains(a, F.col("term"))))
    points = F.when(F.col("name") == F.col("term"), 12).when(F.contains(F.col("name"), F.col("term")), 6).otherwise(0) + F.when(F.array_contains("aliases", F.col("term")), 8).otherwise(0)
    by_name = each.groupBy("qid", "entity_id").agg(F.sum(points * F.col("n")).alias("score"))
    naming = each.select("qid", "entity_id", "term").distinct()
    own = facts.select(F.struct("entity_id", "fact_id").alias("_own"), "fact")  # entities may use one fact_id
    overlap = first_word_hits(own, terms, "_own", "fact").select("qid", "_own.*", "term", "n").join(naming, ["qid", "entity_id", "term"], "left_anti")
    by_fact = overlap.groupBy("qid", "entity_id", "fact_id").agg(F.sum("n").alias("o")).groupBy("qid", "entity_id").agg(F.sum(F.col("o") * F.col("o")).alias("score"))
    both = by_name.unionByName(by_fact).groupBy("qid", "entity_id").agg(F.sum("score").cast("double").alias("score"))
    return top(both.filter("score > 0"), k, "entity_id")


def entity_facts(hits: DataFrame, entities: DataFrame, facts: DataFrame, terms: DataFrame, k: int = 5, recent: int = 4) -> DataFrame:
    """(qid, entity_id, fact_id, overlap, r): the facts behind hits (qid, entity_id): those with most of the terms that no name of the entity
    holds, ``k`` at most; where none has any, the ``recent`` latest by asserted_on. Facts (entity_id, fact_id, fact, asserted_on)."""
    own = facts.join(hits.select("entity_id").distinct(), "entity_id", "left_semi")
    named = entities.join(hits.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", F.concat(F.array(F.lower("name")), F.transform("aliases", F.lower)).alias("names"))
    asked = hits.select("qid", "entity_id").join(terms, "qid").join(named, "entity_id").filter(~F.exists("names", lambda n: F.contains(n, F.col("term")))).select("qid", "entity_id", "term", "n")
    each = own.select(F.struct("entity_id", "fact_id", "fact").alias("_own"), "fact")  # entities may use one fact_id
    found = first_word_hits(each, terms, "_own", "fact").select("qid", "_own.*", "term").join(asked, ["qid", "entity_id", "term"])
    overlap = found.groupBy("qid", "entity_id", "fact_id").agg(F.sum("n").alias("overlap"))
    w = Window.partitionBy("qid", "entity_id")
    matched = overlap.withColumn("r", F.row_number().over(w.orderBy(F.desc("overlap"), "fact_id"))).filter(F.col("r") <= k)
    bare = hits.select("qid", "entity_id").join(matched.select("qid", "entity_id").distinct(), ["qid", "entity_id"], "left_anti")
    latest = bare.join(own.select("entity_id", "fact_id", F.coalesce("asserted_on", F.lit("")).alias("d")), "entity_id")
    latest = latest.withColumn("r", F.row_number().over(w.orderBy(F.desc("d"), "fact_id"))).filter(F.col("r") <= recent)
    return matched.unionByName(latest.select("qid", "entity_id", "fact_id", F.lit(0).cast("long").alias("overlap"), "r"))


def with_near(found: DataFrame, near: DataFrame, key: str, k: int, topics: DataFrame | None = None) -> DataFrame:
    """(qid, key, score, rank, similarity): ``found`` by words (qid, key, score, rank), then rows that are near by meaning alone.

    near (qid, id, similarity) are a vector search's hits for the same questions: their best 4 * k count. Those that words found, too, lend
    them their similarity; of the others the nearest two follow, but none whose topic is excluded where ``topics`` (id, topic) are given.
    """
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    close = near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 4 * k).select(F.col("qid").cast("long").alias("qid"), F.col("id").alias(key), "similarity")
    lexical = found.withColumn("qid", F.col("qid").cast("long")).join(close, ["qid", key], "left").select("qid", key, "score", "rank", "similarity")
    fresh = close.join(lexical.select("qid", key), ["qid", key], "left_anti")
    if topics is not None:
        fresh = V.outside_topics(fresh.withColumnRenamed(key, "id"), topics).withColumnRenamed("id", key)
    held = lexical.groupBy("qid").agg(F.max("rank").alias("last"))
    n = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), key))
    more = fresh.withColumn("n", n).filter(F.col("n") <= V.SEMANTIC_LIMIT).join(held, "qid", "left")
    more = more.select("qid", key, F.lit(None).cast("double").alias("score"), (F.coalesce("last", F.lit(0)) + F.col("n")).cast("int").alias("rank"), "similarity")
    return lexical.unionByName(more)


def search_facts(facts: DataFrame, synonyms: DataFrame, terms: DataFrame, now: int, k: int = 5, near: DataFrame | None = None) -> DataFrame:
    """(qid, fact_id, score, rank). Facts (fact_id, topic, fact, year), synonyms (fact_id, word): topic 8, text 3, else synonym 2; times recency.

    With ``near`` (qid, id, similarity), facts of like meaning follow, and similarity is a column (``with_near``).
    """
    small = _small(terms)
    topic = facts.select("fact_id", F.lower("topic").alias("term")).join(small, "term").select("qid", "fact_id", (F.col("n") * 8.0).alias("p"))
    in_text = first_word_hits(facts, terms, "fact_id", "fact")
    asked = synonyms.select("fact_id", F.explode(T.words(F.col("word"))).alias("term")).filter(F.length("term") > 2).distinct().join(small, "term")
    asked = asked.join(in_text.select("qid", "fact_id", "term"), ["qid", "fact_id", "term"], "left_anti").select("qid", "fact_id", (F.col("n") * 2.0).alias("p"))
    total = topic.unionByName(in_text.select("qid", "fact_id", (F.col("n") * 3.0).alias("p"))).unionByName(asked).groupBy("qid", "fact_id").agg(F.sum("p").alias("p"))
    scored = total.join(facts.select("fact_id", "year"), "fact_id").select("qid", "fact_id", F.round(F.col("p") * recency(F.col("year"), now), 6).alias("score"))
    found = top(scored, k, "fact_id")
    return found if near is None else with_near(found, near, "fact_id", k, facts.select(F.col("fact_id").alias("id"), "topic"))


def search_general(rows: DataFrame, terms: DataFrame, k: int = 2) -> DataFrame:
    """(qid, id, score, rank). Rows (id, topic, fact): a topic equal to a term 2, else a fact that has it 1."""
    has = first_word_hits(rows, terms, "id", "fact").select("qid", "id", "term", "n")
    equal = rows.select("id", F.lower("topic").alias("term")).join(_small(terms), "term").select("qid", "id", "term", "n")
    p = equal.select("qid", "id", (F.col("n") * 2.0).alias("p")).unionByName(has.join(equal, ["qid", "id", "term"], "left_anti").select("qid", "id", F.col("n").cast("double").alias("p")))
    return top(p.groupBy("qid", "id").agg(F.sum("p").alias("score")), k, "id")


def search_people(expertise: DataFrame, profiles: DataFrame, terms: DataFrame, k: int = 4) -> DataFrame:
    """(qid, person_id, matched, coverage, strength, rank). Expertise (person_id, topic, strength), profiles (person_id, known_for)."""
    topics = expertise.withColumn("_id", F.concat_ws("\x01", F.col("person_id").cast("string"), "topic", "strength"))
    hit = first_word_hits(topics, terms, "_id", "topic").groupBy("qid", "_id").agg(F.sum("n").alias("m"))
    weight = F.when(F.col("strength") == "strong", 3.0).when(F.col("strength") == "moderate", 2.0).otherwise(1.0)
    length = F.greatest(F.size(F.filter(F.split(F.lower("topic"), " "), lambda w: w != "")), F.lit(1))
    by_topic = hit.join(topics, "_id").select("qid", "person_id", "m", (F.col("m") / length).alias("c"), (F.col("m") * weight).alias("s"))
    known = first_word_hits(profiles, terms, "person_id", "known_for").groupBy("qid", "person_id").agg(F.sum("n").alias("m"))
    both = by_topic.unionByName(known.select("qid", "person_id", "m", F.lit(0.0).alias("c"), (F.col("m") * 2.0).alias("s")))
    sums = both.groupBy("qid", "person_id").agg(F.sum("m").alias("matched"), F.round(F.sum("c"), 6).alias("coverage"), F.round(F.sum("s"), 6).alias("strength"))
    return top(sums, k, "person_id", F.desc("matched"), F.desc("coverage"), F.desc("strength"))


def search_stories(stories: DataFrame, terms: DataFrame, k: int = 2, floor: float = 2.0, near: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank). Stories (id, title, story, people): title 3, people 2, body one per occurrence up to 3. ``near`` as for facts."""
    parts = [first_word_hits(stories, terms, "id", c).select("qid", "id", (F.col("n") * p).alias("p")) for c, p in (("title", 3.0), ("people", 2.0))]
    body = term_hits(stories, terms, "story", "id").join(_small(terms), "term").select("qid", "id", (F.least(F.col("hits"), F.lit(3)) * F.col("n")).cast("double").alias("p"))
    total = parts[0].unionByName(parts[1]).unionByName(body).groupBy("qid", "id").agg(F.sum("p").alias("score"))
    found = top(total.filter(F.col("score") >= floor), k, "id")
    return found if near is None else with_near(found, near, "id", k)


def search_answers(answers: DataFrame, terms: DataFrame, k: int = 3, within: int = 400) -> DataFrame:
    """(qid, id, topic, fact, hits, rank) of what people answered: answers (id, question, body), the newest ``within``.

    Question and body are both searched, for an answer seldom repeats the words it was asked with; only the body is a fact, and the id is
    negative, so that it never meets that of a fact that was there before.
    """
    newest = answers.orderBy(F.desc("id")).limit(within).withColumn("hay", F.concat_ws(" ", "question", "body"))
    found = first_word_hits(newest, terms, "id", "hay").groupBy("qid", "id").agg(F.countDistinct("term").alias("hits"))
    w = Window.partitionBy("qid").orderBy(F.desc("hits"), F.desc("id"))
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.join(newest, "id").select("qid", (-F.col("id")).alias("id"), F.col("question").alias("topic"), F.col("body").alias("fact"), "hits", "rank")


def answers_first(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Answers people gave ahead of facts that shipped: (qid, source, id, score, place)."""
    both = answers.select("qid", F.lit(0).alias("tier"), (-F.col("id")).alias("id"), "score").unionByName(facts.select("qid", F.lit(1).alias("tier"), "id", "score"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("tier", F.desc("score"), "id")))


def passages(found: DataFrame, terms: DataFrame, radius: int = 220) -> DataFrame:
    """(qid, doc_id, passage) of (qid, doc_id, text): the window around the occurrence with most occurrences near it, ellipses at cut ends.

    Rows without a readable window are left out. Every place of every term whose first occurrence is a whole word counts: places are
    running sums of the lengths between matches, and a sliding range counts the neighbours, so long texts cost no squares.
    """
    per = terms.select("qid", "term").distinct()
    rows = found.select("qid", "doc_id", "text").join(per, "qid").withColumn("low", F.lower("text")).filter(T.contains_word(F.col("low"), F.col("term")))
    gaps = F.transform(F.split("low", F.concat(F.lit(r"\Q"), F.col("term"), F.lit(r"\E")), -1), F.length)
    each = rows.select("qid", "doc_id", "term", F.posexplode(gaps).alias("n", "gap"), F.size(gaps).alias("parts")).filter(F.col("n") < F.col("parts") - 1)
    along = Window.partitionBy("qid", "doc_id", "term").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = each.withColumn("p", F.sum(F.col("gap") + F.length("term")).over(along) - F.length("term"))
    near = F.count("*").over(Window.partitionBy("qid", "doc_id").orderBy("p").rangeBetween(-radius, radius))
    best = at.withColumn("near", near).groupBy("qid", "doc_id").agg(F.min_by("p", F.struct(-F.col("near"), "term", "n")).cast("int").alias("anchor"))
    cut = found.select("qid", "doc_id", "text").join(best, ["qid", "doc_id"])
    start, end = F.greatest(F.col("anchor") - radius, F.lit(0)), F.least(F.col("anchor") + radius, F.length("text"))
    raw = F.trim(F.regexp_replace(F.call_function("substring", F.col("text"), start + 1, end - start), "[ \n]+", " "))
    w = cut.select("qid", "doc_id", raw.alias("raw"), (start > 0).alias("late"), (end < F.length("text")).alias("early"))
    dot = F.call_function("instr", F.col("raw"), F.lit("."))
    led = F.col("late") & (dot > 0) & (dot <= 90)
    window = F.when(led, F.trim(F.call_function("substring", F.col("raw"), dot + 1))).otherwise(F.col("raw"))
    window = F.when(F.col("late") & ~led & F.contains(window, F.lit(" ")), F.concat(F.lit("… "), F.regexp_replace(window, "^[^ ]* ", ""))).otherwise(window)
    window = F.when(F.col("early") & F.contains(window, F.lit(" ")), F.concat(F.regexp_replace(window, " [^ ]*$", ""), F.lit(" …"))).otherwise(window)
    return w.select("qid", "doc_id", window.alias("passage")).filter(T.readable(F.col("passage")))


def clean_lead(text: Column) -> Column:
    """A passage without the tail of a sentence it opens with: what follows its first heading, if over 80 characters do; with no
    heading what follows a full stop among the first 60 characters."""
    heading, stop = F.call_function("instr", text, F.lit("##")), F.call_function("instr", text, F.lit("."))
    after = F.call_function("substring", text, heading + 2)
    return (
        F.when(heading > 0, F.when(F.length(after) > 80, F.trim(after)).otherwise(text))
        .when((stop > 0) & (stop <= 60), F.trim(F.call_function("substring", text, stop + 1)))
        .otherwise(text)
    )


def attributed(hits: DataFrame, evidence: DataFrame, documents: DataFrame, people: DataFrame, claim_table: str, source_table: str = "document") -> DataFrame:
    """Hits (qid, fact_id) with the document and author behind them: the first evidence row of ``claim_table`` whose source is in
    ``source_table``. Both conditions stand in the joins, so a hit without evidence stays, with nulls, and equal ids of other tables never meet.
    """
    own = evidence.filter((F.col("claim_table") == claim_table) & (F.col("source_table") == source_table)).groupBy("claim_id").agg(F.min("source_id").alias("source_id"))
    cited = hits.join(own, hits["fact_id"] == own["claim_id"], "left").drop("claim_id")
    return cited.join(documents.withColumnRenamed("doc_id", "source_id"), "source_id", "left").join(people, "person_id", "left")

"""Entities, people's records and stories: cards, merging, validation, neighbours.

Pairwise merging until nothing changes depends on the order of pairs. Here links are found once and components taken: what
chains together merges together, whatever the order. Components can be larger than stepwise merging would make them (a merged
row is compared by its survivor's text alone there); a case in the tests shows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.shared import written
from gristmill.operators import set_join
from gristmill.operators.gaps import assign_sequence
from gristmill.operators.people import connected

#: Fixed list: words that don't tell one story from another.
STORY_STOP = (
    "that", "this", "with", "from", "they", "them", "their", "there", "were", "have", "been", "when", "what", "then", "than", "into",
    "about", "after", "before", "over", "under", "very", "much", "camp", "year", "would", "could", "still", "which", "because",
)
MIN_SUPPORT = 2
YEARS = (2000, 2026)


# --- entities ---


def entity_links(entities: DataFrame) -> DataFrame:
    """(a, b, same_kind): entities whose names are equal, case aside, or of which one is among the other's aliases.

    Of n equal names of one kind each is linked to the smallest id, which joins the same components as all pairs would; kinds
    that clash are linked by their smallest ids.
    """
    names = entities.select("entity_id", "kind", F.lower(F.trim("name")).alias("key"))
    least = names.groupBy("key", "kind").agg(F.min("entity_id").alias("b"))
    aliases = entities.select("entity_id", "kind", F.explode("aliases").alias("key")).withColumn("key", F.lower(F.trim("key"))).distinct()
    equal = names.join(least, ["key", "kind"]).select(F.col("b").alias("x"), F.col("entity_id").alias("y"), F.lit(True).alias("same_kind"))
    kinds = least.groupBy("key").agg(F.min(F.struct("b", "kind")).alias("one"))
    clash = least.join(kinds, "key").filter(F.col("kind") != F.col("one.kind")).select(F.col("one.b").alias("x"), F.col("b").alias("y"), F.lit(False).alias("same_kind"))
    alias = least.withColumnRenamed("kind", "named").join(aliases, "key").select(F.col("b").alias("x"), F.col("entity_id").alias("y"), (F.col("named") == F.col("kind")).alias("same_kind"))
    all_ = equal.unionByName(clash).unionByName(alias).filter("x <> y")
    return all_.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "same_kind").distinct()


def merge_entities(entities: DataFrame, shared_dir: str) -> tuple[DataFrame, DataFrame]:
    """(entity_id, survivor) and the clashes (a, b) of kind, which are reported and not merged. The most mentioned survives, then the first name."""
    links = entity_links(entities)
    labels = connected(links.filter("same_kind").select("a", "b"), shared_dir)
    grouped = entities.join(labels, entities["entity_id"] == labels["node"], "left").withColumn("g", F.coalesce("root", "entity_id"))
    w = Window.partitionBy("g").orderBy(F.desc("mention_count"), F.lower("name"), "name", "entity_id")
    return grouped.select("entity_id", F.first("entity_id").over(w).alias("survivor")), links.filter("not same_kind").select("a", "b")


def facts_by_category(facts: DataFrame, categories: tuple[str, ...], rest: str = "history") -> DataFrame:
    """(entity_id, category, facts): oldest first; an unknown or missing category is ``rest``."""
    known = F.when(F.col("category").isin(*categories), F.col("category")).otherwise(F.lit(rest))
    return facts.groupBy("entity_id", known.alias("category")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("asserted_on", F.lit("")).alias("d"), "fact_id", "fact"))), lambda x: x["fact"]).alias("facts"))


def entity_cards(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """All entities by mentions, each with its sorted aliases, in one plan."""
    names = aliases.groupBy("entity_id").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    cards = entities.join(names, "entity_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return assign_sequence(cards, 0, F.desc("mention_count"), F.col("entity_id")).withColumn("place", F.col("seq").cast("int")).drop("seq")


def lookup(entities: DataFrame, aliases: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, entity_id): the entity of that name, else of that alias: two equi-joins in place of an OR."""
    q = queries.select("qid", F.lower("query").alias("key"))
    by_name = q.join(entities.select("entity_id", F.lower("name").alias("key")), "key").select("qid", "entity_id", F.lit(0).alias("tier"))
    by_alias = q.join(aliases.select("entity_id", F.lower("alias").alias("key")), "key").select("qid", "entity_id", F.lit(1).alias("tier"))
    return by_name.unionByName(by_alias).groupBy("qid").agg(F.min_by("entity_id", F.struct("tier", "entity_id")).alias("entity_id"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other, kind): edges seen from both ends."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "kind").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "kind"))


def discovered(mentions: DataFrame, shown: DataFrame) -> DataFrame:
    """(name, kind, mention_count) from (job_id, source_id, name, kind): only rows the job was shown; counted by job; the first job names the kind."""
    ok = mentions.join(shown.select("job_id", "source_id"), ["job_id", "source_id"], "left_semi")
    return ok.groupBy("name").agg(F.countDistinct("job_id").alias("mention_count"), F.min_by("kind", F.struct("job_id", "source_id")).alias("kind"))


# --- people ---


def known_names(people: DataFrame, roster: DataFrame, aliases: DataFrame) -> DataFrame:
    """(person_id, names): every name a person is called: own, roster, nickname, aliases; without repeats."""
    sources = people.select("person_id", F.lit(0).alias("k"), "name")
    sources = sources.unionByName(roster.select("person_id", F.lit(1).alias("k"), "name")).unionByName(roster.select("person_id", F.lit(2).alias("k"), F.col("nickname").alias("name"))).unionByName(aliases.select("person_id", F.lit(3).alias("k"), F.col("alias").alias("name")))
    clean = sources.withColumn("name", F.trim("name")).filter("name <> ''").groupBy("person_id", "name").agg(F.min("k").alias("k"))
    return clean.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("names"))


def portraits(names: DataFrame, people: DataFrame, terms: DataFrame, gated: bool = True) -> DataFrame:
    """(qid, person_id, second): who a question names best, ties to more messages, with the runner-up.

    Gated: none where a term is left over that the best name doesn't have, unless two are named.
    """
    hay = names.select("person_id", F.lower(F.array_join("names", " ")).alias("hay"), F.explode(F.array_distinct(F.flatten(F.transform("names", T.words)))).alias("term"))
    hit = hay.join(F.broadcast(terms), "term").filter(T.contains_word(F.col("hay"), F.col("term")))
    per = hit.groupBy("qid", "person_id").agg(F.sum("n").alias("matched"), F.countDistinct("term").alias("different")).join(people.select("person_id", "messages"), "person_id")
    w = Window.partitionBy("qid").orderBy(F.desc("matched"), F.desc("messages"), "person_id")
    ranked = per.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("person_id").over(w)).filter("r = 1")
    asked = terms.groupBy("qid").agg(F.count("*").alias("terms"))
    out = ranked.join(asked, "qid")
    if gated:
        out = out.filter(F.col("second").isNotNull() | (F.col("different") == F.col("terms")))
    return out.select("qid", "person_id", "second")


def top_expertise(expertise: DataFrame, n: int = 3) -> DataFrame:
    """(person_id, topics): strong before the rest; "moderate" and "mentioned" tie, as they always have."""
    w = Window.partitionBy("person_id").orderBy(F.when(F.col("strength") == "strong", 0).when(F.col("strength") == "medium", 1).otherwise(2), "topic")
    first = expertise.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    return first.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "topic"))), lambda x: x["topic"]).alias("topics"))


def relation_lines(edges: DataFrame, people: DataFrame) -> DataFrame:
    """(person_id, other, kind): both people of a tie, seen from each."""
    a, b = people.alias("pa"), people.alias("pb")
    named = edges.join(a, F.col("person_a") == F.col("pa.person_id")).join(b, F.col("person_b") == F.col("pb.person_id"))
    one = named.select(F.col("person_a").alias("person_id"), F.col("pb.name").alias("other"), "kind", F.lit(True).alias("first"))
    return one.unionByName(named.select(F.col("person_b").alias("person_id"), F.col("pa.name").alias("other"), "kind", F.lit(False).alias("first")))


def stories_about(stories: DataFrame, people: DataFrame, n: int = 3) -> DataFrame:
    """(person_id, id, r): stories whose list has the name, or the first word of either for the other; newest first."""
    entry = stories.select("id", "title", F.coalesce("year", F.lit(0)).alias("year"), F.explode(F.split(F.coalesce("people", F.lit("")), ",")).alias("e")).withColumn("e", F.lower(F.trim("e"))).filter("e <> ''")
    p = people.select("person_id", F.lower(F.trim("name")).alias("p"))
    word = lambda c: F.regexp_extract(c, "^([^ ]*)", 1)
    keys = lambda c: F.array_distinct(F.array(c, word(c)))
    met = entry.withColumn("k", F.explode(keys(F.col("e")))).join(p.withColumn("k", F.explode(keys(F.col("p")))), "k")
    hit = met.filter((F.col("e") == F.col("p")) | (word(F.col("e")) == F.col("p")) | (word(F.col("p")) == F.col("e"))).select("person_id", "id", "year").distinct()
    return hit.withColumn("r", F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("year"), "id"))).filter(F.col("r") <= n)


def name_parts(people: DataFrame) -> DataFrame:
    """(person_id, alias): the words of names of several words."""
    from gristmill.operators.rules import alias_ok

    words = people.select("person_id", "name", F.split(F.trim("name"), r"\s+").alias("ws")).filter(F.size("ws") > 1)
    return words.select("person_id", "name", F.explode("ws").alias("alias")).filter(alias_ok(F.col("alias"), F.col("name"))).select("person_id", "alias").distinct()


def tidy(people: DataFrame) -> DataFrame:
    """Names without decoration or a trailing address, unless a clean row of that name exists."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("name", r"^[~\s]+", ""), r"[\s(<]*\S+@\S+[>)]?\s*$", ""))
    t = people.withColumn("_c", clean)
    taken = people.select(F.lower("name").alias("_k"), F.col("person_id").alias("_p"))
    hit = t.filter("_c <> name").join(taken, F.lower("_c") == F.col("_k")).filter("_p <> person_id").select("person_id").distinct().withColumn("_taken", F.lit(True))
    out = t.join(hit, "person_id", "left").withColumn("name", F.when(F.col("_taken").isNull() & (F.col("_c") != ""), F.col("_c")).otherwise(F.col("name")))
    return out.select(people.columns)


def cluster_appearances(rows: DataFrame, shared_dir: str) -> DataFrame:
    """(id, person): appearances (id, first, last, email) in stages: one email or, with surnames, one full name are one person; then rows without
    an address join the one person of their first name and initial, and those without a surname the one of their first name; others stay apart.

    The stages take the place of the order of rows, and what two candidates share joins neither.
    """
    n = rows.select("id", T.ascii_norm(F.col("first")).alias("f"), T.ascii_norm(F.col("last")).alias("l"), F.lower("email").alias("email"))

    def star(key: Column, keep: Column) -> DataFrame:
        r = n.filter(keep).withColumn("k", key)
        return r.join(r.groupBy("k").agg(F.min("id").alias("b")), "k").select(F.col("id").alias("a"), "b").filter("a <> b")

    full = F.concat_ws(" ", "f", "l")
    edges = star(F.col("email"), F.col("email") != "").unionByName(star(full, (F.col("l") != "") & (F.col("f") != "")))
    labels = connected(edges, shared_dir)
    base = n.join(labels, n["id"] == labels["node"], "left").withColumn("person", F.coalesce("root", "id")).drop("node", "root")
    held = base.filter("email <> ''").select("person").distinct().withColumn("held", F.lit(True))
    base = base.join(held, "person", "left").withColumn("held", F.coalesce("held", F.lit(False)))

    def only(key: Column, keep: Column) -> DataFrame:
        return base.filter(F.col("held") & keep).withColumn("k", key).groupBy("k").agg(F.min("person").alias("to"), F.countDistinct("person").alias("n")).filter("n = 1").drop("n")

    initial = F.concat_ws(" ", "f", F.substring("l", 1, 1))
    loose = base.filter(~F.col("held"))
    by_initial = loose.filter("l <> ''").withColumn("k", initial).join(only(initial, F.col("l") != ""), "k").select("id", "to")
    by_first = loose.filter("l = ''").withColumn("k", F.col("f")).join(only(F.col("f"), F.lit(True)), "k").select("id", "to")
    return base.join(by_initial.unionByName(by_first), "id", "left").select("id", F.coalesce("to", "person").alias("person"))


def identity_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Hand-written groups (group, name): all their people become the smallest id among them."""
    named = rows.join(groups.select(F.lower("name").alias("_k"), "group"), F.lower("name") == F.col("_k"), "left")
    return named.select("id", F.coalesce(F.min("id").over(Window.partitionBy("group")), F.col("id")).alias("grouped"), "group").select("id", F.when(F.col("group").isNull(), F.col("id")).otherwise(F.col("grouped")).alias("person"))


# --- stories ---


def validate_stories(stories: DataFrame, shown: DataFrame, names: DataFrame) -> DataFrame:
    """Adds reason, sources and kept people to (id, job_id, title, story, year, people array, cited array).

    Citations outside the job's rows go; two are needed; handles disqualify; unknown names and years outside ``YEARS`` go.
    """
    cited = stories.select("id", "job_id", F.explode("cited").alias("source_id")).distinct().join(shown, ["job_id", "source_id"], "left_semi")
    support = cited.groupBy("id").agg(F.sort_array(F.collect_set("source_id")).alias("sources"))
    person = stories.select("id", F.posexplode("people").alias("k", "person"))
    own = names.select(F.lower(F.trim("name")).alias("n")).distinct()
    real = person.join(own, F.lower(F.trim("person")) == F.col("n"), "left_semi").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "person"))), lambda x: x["person"]).alias("real"))
    out = stories.join(support, "id", "left").join(real, "id", "left")
    none = F.array().cast("array<string>")
    reason = (
        F.when((F.trim(F.coalesce("title", F.lit(""))) == "") | (F.trim(F.coalesce("story", F.lit(""))) == ""), F.lit("malformed"))
        .when(F.contains("title", F.lit("@")) | F.contains("story", F.lit("@")), F.lit("handle"))
        .when(F.coalesce(F.size("sources"), F.lit(0)) < MIN_SUPPORT, F.lit("support"))
    )
    year = F.when(F.col("year").between(*YEARS), F.col("year"))
    return out.select("id", "title", "story", year.alias("year"), F.coalesce("real", none).alias("people"), "sources", reason.alias("reason"))


def signature(title: Column, story: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", title, story)), F.lit("[a-z0-9']+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~F.array_contains(T.strings(STORY_STOP), w)))


def consolidate_stories(stories: DataFrame, shared_dir: str, floor: float = 0.5) -> DataFrame:
    """Retellings merge: signatures similar by ``floor`` or more, years not at odds. The best cited telling survives, then the longest, then the
    first title; people and sources are pooled."""
    s = stories.select("id", "year", F.array_sort(signature(F.col("title"), F.col("story"))).alias("sig")).filter(F.size("sig") > 0)
    s = written(s.withColumn("h", F.sha2(F.array_join("sig", " "), 256)))  # words have no blanks
    one = written(s.groupBy("h", "year").agg(F.min("id").alias("a")))  # equal ones of one year are one node
    copies = s.join(one, (s["h"] == one["h"]) & s["year"].eqNullSafe(one["year"])).select("a", F.col("id").alias("b")).filter("a <> b")
    nodes = s.join(one.select(F.col("a").alias("id")), "id", "left_semi")
    near = set_join.similar(nodes, "id", "sig", floor, agree="year", spanning=True)
    labels = connected(near.select("a", "b").unionByName(copies), shared_dir)
    g = stories.join(labels, stories["id"] == labels["node"], "left").withColumn("g", F.coalesce("root", "id"))
    rank = F.struct(-F.size("sources"), -F.length("story"), F.lower("title"), F.col("id"))
    return g.groupBy("g").agg(
        F.min_by("id", rank).alias("id"),
        F.min_by("title", rank).alias("title"),
        F.min_by("story", rank).alias("story"),
        F.min_by("year", F.struct(F.col("year").isNull(), rank)).alias("year"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("people")))).alias("people"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.count("*").alias("tellings"),
    ).drop("g")


def derived_uuid(seed: Column, name: Column) -> Column:
    """A version-5 shaped UUID from SHA-256 of "seed:name"."""
    h = F.sha2(F.concat(seed, F.lit(":"), name), 256)
    sub = lambda i, n: F.substring(h, i, n)
    nibble = F.lower(F.hex(F.conv(sub(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(sub(1, 8), F.lit("-"), sub(9, 4), F.lit("-5"), sub(14, 3), F.lit("-"), nibble, sub(18, 3), F.lit("-"), sub(21, 12))


def legacy_edges(shifts: DataFrame, attended: DataFrame, mentions: DataFrame) -> DataFrame:
    """(source, kind, target, weight): people work on shifts, attended years, and are mentioned with each other, once per pair and source."""
    works = shifts.groupBy(F.col("person").alias("source"), F.col("shift").alias("target")).agg(F.count("*").alias("weight")).withColumn("kind", F.lit("works_on"))
    years = attended.groupBy(F.col("person").alias("source"), F.col("year").cast("string").alias("target")).agg(F.count("*").alias("weight")).withColumn("kind", F.lit("attended"))
    met = mentions.groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).agg(F.countDistinct("doc").alias("weight")).filter("source <> target").withColumn("kind", F.lit("mentioned_with"))
    return works.unionByName(years).unionByName(met).select("source", "kind", "target", "weight")


def manual_facts(facts: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hand-written facts (name, fact) with the entity of exactly that name, and those that no entity has."""
    named = entities.groupBy("name").agg(F.min("entity_id").alias("entity_id"))
    return facts.join(named, "name"), facts.join(named, "name", "left_anti")


def by_ids(rows: DataFrame, key: str, nominated: DataFrame, id_: str) -> DataFrame:
    """The rows that a search has nominated, with the question and place they were nominated at."""
    return nominated.join(rows, nominated[id_] == rows[key])

"""Fact sheets: layers ranked by how much of the question they cover, then spent against a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.dates import gap_phrase, human_date
from gristmill.operators.gaps import assign_sequence
from gristmill.operators.sequences import within_budget

BUDGET = 4000

#: Order of the layers; whether one is shown even when empty.
LAYERS = (("camp", True), ("docs", False), ("entities", False), ("people", False), ("lore", False))

#: A header for each layer when it leads the sheet, and another where it follows (None: no header there). Any mapping of this form will do.
HEADERS = {
    "camp": ("# Records kept by the group (most relevant)", "# Records kept by the group"),
    "docs": ("# Documents (most relevant)", None),
    "entities": ("# Things on file (most relevant)", None),
    "people": ("# Who to ask (most relevant)", "# Who to ask"),
    "lore": ("# Stories (most relevant)", None),
}


def coverage(text: Column, terms: Column) -> Column:
    """How many of the distinct terms the text has."""
    return T.let(F.lower(text), lambda low: F.size(F.filter(F.array_distinct(terms), lambda t: T.contains_word(low, t))))


def semantic_coverage(similarity: Column) -> Column:
    return F.when(similarity >= 0.52, 2).when(similarity >= 0.45, 1).otherwise(0)


def rank_layers(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, layer, coverage, place): layers by their best row's coverage, then the fixed order. rows: (qid, layer, line, text [, similarity])."""
    order = F.create_map(*[F.lit(x) for k, (n, _) in enumerate(LAYERS) for x in (n, k)])
    per = terms.groupBy("qid").agg(F.collect_set("term").alias("terms"))
    c = coverage(F.col("text"), F.col("terms"))
    if "similarity" in rows.columns:
        c = F.greatest(c, F.when(F.col("layer") == "camp", semantic_coverage(F.col("similarity"))).otherwise(0))
    best = rows.join(per, "qid").groupBy("qid", "layer").agg(F.max(c).alias("coverage"))
    forced = per.select("qid", F.explode(F.array(*[F.lit(n) for n, always in LAYERS if always])).alias("layer"))
    best = forced.join(best, ["qid", "layer"], "full").withColumn("coverage", F.coalesce("coverage", F.lit(0)))
    w = Window.partitionBy("qid").orderBy(F.desc("coverage"), order[F.col("layer")])
    return best.withColumn("place", F.row_number().over(w))


def fact_sheet(rows: DataFrame, terms: DataFrame, budget: int = BUDGET, headers: dict[str, tuple[str | None, str | None]] | None = None) -> DataFrame:
    """(qid, sheet): each layer a section in rank order under its header; sections until the budget is spent."""
    ranked = rank_layers(rows, terms)
    head = lambda k: F.create_map(*[F.lit(x) for n, h in (headers or HEADERS).items() for x in (n, h[k])])[F.col("layer")]
    header = F.when(F.col("place") == 1, head(0)).otherwise(head(1))
    lines = rows.groupBy("qid", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))
    parts = ranked.join(lines, ["qid", "layer"], "left")
    shown = F.concat(F.when(header.isNotNull(), F.array(header)).otherwise(F.array().cast("array<string>")), F.coalesce("lines", F.array().cast("array<string>")))
    parts = parts.withColumn("section", shown).filter(F.size("section") > 0)
    cost = F.aggregate("section", F.lit(0), lambda s, x: s + F.length(x) + 1)
    kept = within_budget(parts, cost, budget, "qid", "place")
    return kept.groupBy("qid").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda x: x["section"])), "\n").alias("sheet"))


def subjects(rows: DataFrame, least: int = 3, n: int = 4) -> DataFrame:
    """(qid, note): the first subjects of a question whose facts cover several things."""
    first = rows.groupBy("qid", F.lower("subject").alias("k")).agg(F.min_by("subject", "rank").alias("subject"), F.min("rank").alias("rank"))
    listed = first.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "subject"))).alias("s")).filter(F.size("s") >= least)
    return listed.select("qid", F.array_join(F.slice(F.col("s.subject"), 1, n), "; ").alias("note"))


def attribution(name: Column, group: Column, iso: Column) -> Column:
    """name · group · date, without what is missing."""
    return F.concat_ws(" · ", F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(group), F.lit("")), human_date(iso))


def relation_phrase(kind: Column, a: Column, b: Column) -> Column:
    """Mentors have a direction; other ties don't."""
    return (
        F.when(kind == "mentor", F.concat(a, F.lit(" taught "), b))
        .when(kind == "builds_with", F.concat(a, F.lit(" builds with "), b))
        .when(kind == "chapter", F.concat(a, F.lit(" and "), b, F.lit(" are in the same chapter")))
        .otherwise(F.concat(a, F.lit(" and "), b, F.lit(" know each other")))
    )


def history(turns: DataFrame, question: str, n: int = 4) -> DataFrame:
    """The last n turns, without refusals and near repeats of the question, each clipped."""
    kept = turns.filter(~T.is_refusal(F.col("answer")) & ~T.near_repeat(F.col("question"), F.lit(question)))
    return kept.orderBy(F.desc("asked_at"), F.desc("id")).limit(n).select("id", "asked_at", T.clip(F.col("question")).alias("question"), T.clip(F.col("answer")).alias("answer"))


def contradiction_note(earlier: Column, later: Column, first: Column, second: Column) -> Column:
    return F.concat(human_date(first), F.lit(": "), earlier, F.lit(" — "), gap_phrase(F.to_date(first), F.to_date(second)), F.lit(": "), later)


def people_cards(roster: DataFrame, chat: DataFrame) -> DataFrame:
    """Roster rows with what chat knows of them, then chat people whom no roster row claims or names; richer cards first."""
    cards = roster.join(chat.select("person_id", F.col("name").alias("chat_name"), "messages", "portrait"), "person_id", "left")
    rest = chat.join(roster.select("person_id"), "person_id", "left_anti")
    rest = rest.withColumn("_k", T.letter_norm(F.col("name"))).join(roster.select(T.letter_norm(F.col("name")).alias("_k")).distinct(), "_k", "left_anti")
    both = cards.select("person_id", "name", "role", "portrait", F.lit(1).alias("on_roster")).unionByName(rest.select("person_id", "name", F.lit(None).cast("string").alias("role"), "portrait", F.lit(0).alias("on_roster")))
    score = F.when(F.col("portrait").isNotNull(), 4).otherwise(0) + F.when(F.col("role").isNotNull(), 2).otherwise(0) + F.col("on_roster")
    return assign_sequence(both.withColumn("tier", score), 0, F.desc("tier"), F.col("name"), F.col("person_id")).withColumn("place", F.col("seq").cast("int")).drop("seq")


def asks_to_remember(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(r"^(?:remember|make a note|note that|write down|save this|don'?t forget)\b")

"""Lines of a sheet by layer, sheets in a fixed order, and replies put together without a model: columns and small groups.

Wording is data: ``WORDING`` may be replaced key by key. Every other part of a line is a row's own value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.dates import gap_phrase
from gristmill.operators.sequences import within_budget

WORDING = {
    "source": " (from {0})", "year": ", {0}", "document": "From “{0}”:", "entity": "{0} ({1}):", "dated": " [{0}]", "known": "Known for {0}",
    "writes": "Writes like this: {0}", "quote": "Says: “{0}”", "cares": "Cares about {0}", "ask": "Can be asked about {0}", "stories": "Is in these stories: {0}",
    "story": "Story: {0}{1}: {2}", "general": "In general:", "clash": "There are two answers, and it was never settled.", "later": "Then, {0}: {1}",
    "nothing": "(nothing is on record)", "blank": "Nothing is on record about that.",
}


def phrase(name: str, *parts: Column, wording: dict[str, str] | None = None) -> Column:
    """The wording of that name with its places filled; null where a part is."""
    pieces, text = [], (wording or WORDING)[name]
    for k, p in enumerate(parts):
        before, text = text.split(f"{{{k}}}", 1)
        pieces += [F.lit(before), p]
    return F.concat(*pieces, F.lit(text))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _filled(c: Column) -> Column:
    return F.when(F.trim(_or_empty(c)) != "", c)


def fact_line(fact: Column, year: Column, source: Column) -> Column:
    """A fact with its year and where it is from, if those are known."""
    return F.concat(F.lit("- "), fact, _or_empty(phrase("year", year.cast("string"))), _or_empty(phrase("source", _filled(source))))


def document_lines(title: Column, passage: Column) -> Column:
    return F.array(phrase("document", title), F.concat(F.lit("- "), passage))


def entity_lines(name: Column, kind: Column, facts: Column) -> Column:
    """A thing and its facts, array<struct<fact, asserted_on>>, each with its date where it has one."""
    each = F.transform(facts, lambda f: F.concat(F.lit("- "), f["fact"], _or_empty(phrase("dated", f["asserted_on"]))))
    return F.concat(F.array(phrase("entity", name, kind)), each)


def person_line(name: Column, topics: Column, known_for: Column, n: int = 3) -> Column:
    """Whom to ask, and why: the first topics, else what they are known for."""
    why = F.array_join(F.slice(F.coalesce(topics, F.array().cast("array<string>")), 1, n), ", ")
    return F.concat(F.lit("- "), name, F.lit(": "), F.when(why != "", why).otherwise(_or_empty(known_for)))


def about_lines(p: Column) -> Column:
    """A person's portrait (pair array, known_for, persona, shows_up_as, voice, quote, cares_about, expertise array, stories array, relations array,
    role): who they are first; the role only where nothing else is known."""
    line = lambda c: F.array(F.concat(F.lit("- "), c))
    joined = lambda f: _filled(F.array_join(F.coalesce(p[f], F.array().cast("array<string>")), "; "))
    parts = [
        F.transform(F.coalesce(p["pair"], F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)),
        line(phrase("known", _filled(p["known_for"]))), line(_filled(p["persona"])), line(_filled(p["shows_up_as"])), line(phrase("writes", _filled(p["voice"]))),
        line(phrase("quote", _filled(p["quote"]))), line(phrase("cares", _filled(p["cares_about"]))), line(phrase("ask", joined("expertise"))),
        line(phrase("stories", joined("stories"))), line(joined("relations")),
    ]
    lines = F.filter(F.concat(*parts), lambda x: x.isNotNull())
    return F.when((F.size(lines) == 0) & _filled(p["role"]).isNotNull(), line(p["role"])).otherwise(lines)


def story_line(title: Column, year: Column, story: Column) -> Column:
    return phrase("story", title, _or_empty(phrase("year", year.cast("string"))), story)


def fixed_sheet(sections: DataFrame, order: tuple[str, ...], budget: int, headers: dict[str, str] | None = None) -> DataFrame:
    """(qid, sheet) of sections (qid, layer, rank, lines array): layers in a fixed order, stories each by itself, until the budget is spent."""
    place = F.create_map(*[F.lit(x) for k, n in enumerate(order) for x in (n, k)])[F.col("layer")]
    head = F.create_map(*[F.lit(x) for kv in (headers or {"": ""}).items() for x in kv])[F.col("layer")]
    own = sections.filter(place.isNotNull()).withColumn("part", F.when(F.col("layer") == "lore", F.col("rank")).otherwise(0)).withColumn("place", place)
    joined = own.groupBy("qid", "place", "part", "layer").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "lines"))), lambda x: x["lines"])).alias("lines"))
    joined = joined.withColumn("lines", F.concat(F.filter(F.array(head), lambda h: h.isNotNull()), "lines")).filter(F.size("lines") > 0)
    cost = F.aggregate("lines", F.lit(0), lambda s, x: s + F.length(x) + 1)
    kept = within_budget(joined, cost, budget, "qid", "place", "part")
    return kept.groupBy("qid").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "part", "lines"))), lambda x: x["lines"])), "\n").alias("sheet"))


def hit_reply(facts: Column, summary: Column) -> Column:
    """What is said about a thing with facts, array<struct<fact_id, category, asserted_on, negated, fact>> in order: two facts of one category on different
    dates that contradict each other come alone; else the first three, or the summary."""
    first = lambda c: F.get(c, F.lit(0))
    against = lambda a: F.filter(facts, lambda b: (b["fact_id"] > a["fact_id"]) & (a["category"] == b["category"]) & (a["asserted_on"] != b["asserted_on"]) & (a["negated"] != b["negated"]))
    clashing = F.filter(facts, lambda a: F.size(against(a)) > 0)
    pair = F.transform(F.slice(clashing, 1, 1), lambda a: F.struct(a.alias("a"), first(against(a)).alias("b")))
    one, two = first(pair)["a"], first(pair)["b"]
    turned = one["asserted_on"] > two["asserted_on"]
    dated = lambda x: F.concat(x["fact"], phrase("dated", x["asserted_on"]))
    early, late = F.when(turned, two).otherwise(one), F.when(turned, one).otherwise(two)
    gap = gap_phrase(F.to_date(early["asserted_on"]), F.to_date(late["asserted_on"]))
    clash = F.array(F.lit(WORDING["clash"]), dated(early), phrase("later", gap, late["fact"]))
    plain = F.when(F.size(facts) > 0, F.transform(F.slice(facts, 1, 3), lambda f: f["fact"])).otherwise(F.array(_or_empty(summary)))
    return F.array_join(F.when(F.size(pair) > 0, clash).otherwise(plain), "\n\n")


def replies(questions: DataFrame, parts: DataFrame, order: tuple[str, ...] = ("camp", "entities", "docs", "about", "lore", "general"), limits: dict[str, int] | None = None) -> DataFrame:
    """(qid, reply) of every question: parts (qid, layer, rank, text) in order of authority, so many of each layer; a fixed answer where there are none."""
    most = {"camp": 3, "entities": 1, "docs": 1, "about": 1, "lore": 1} | (limits or {})
    place = F.create_map(*[F.lit(x) for k, n in enumerate(order) for x in (n, k)])[F.col("layer")]
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in most.items() for x in kv])[F.col("layer")], F.lit(1 << 30))
    from pyspark.sql import Window

    ranked = parts.withColumn("n", F.row_number().over(Window.partitionBy("qid", "layer").orderBy("rank", "text"))).filter(place.isNotNull() & (F.col("n") <= limit))
    text = F.when((F.col("layer") == "general") & (F.col("n") == 1), F.concat(F.lit(WORDING["general"] + "\n"), "text")).otherwise(F.col("text"))
    joined = ranked.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "n", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("reply"))
    return questions.select("qid").join(joined, "qid", "left").withColumn("reply", F.coalesce("reply", F.lit(WORDING["blank"])))

"""Lines, sheets, replies, facts behind entities, and places along hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import evidence as E
from gristmill.operators import renderers as W
from gristmill.operators import retrieve as R
from gristmill.operators import rules as U
from gristmill.operators import sequences as S
from gristmill.plans import answers  # noqa: F401


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_lines_leave_out_what_is_missing(spark):
    text = lambda v: F.lit(v).cast("string")
    assert one(spark, W.fact_line(F.lit("We camp"), F.lit(2019), F.lit("Handbook"))) == "- We camp, 2019 (from Handbook)"
    assert one(spark, W.fact_line(F.lit("We camp"), F.lit(None).cast("int"), F.lit(" "))) == "- We camp"
    facts = F.array(F.struct(F.lit("old").alias("fact"), text("2019-01-01").alias("asserted_on")), F.struct(F.lit("new").alias("fact"), text(None).alias("asserted_on")))
    assert one(spark, W.entity_lines(F.lit("Doll"), F.lit("trailer"), facts)) == ["Doll (trailer):", "- old [2019-01-01]", "- new"]
    none = F.array().cast("array<string>")
    assert one(spark, W.person_line(F.lit("Ana"), none, F.lit("bikes"))) == "- Ana: bikes"
    assert one(spark, W.person_line(F.lit("Ana"), F.array(*map(F.lit, "abcd")), F.lit("bikes"))) == "- Ana: a, b, c"
    assert one(spark, W.story_line(F.lit("The flood"), F.lit(None).cast("int"), F.lit("It rained."))) == "Story: The flood: It rained."


def test_a_role_only_speaks_for_those_of_whom_nothing_else_is_known(spark):
    portrait = "pair array<string>, known_for string, persona string, shows_up_as string, voice string, quote string, cares_about string, expertise array<string>, stories array<string>, relations array<string>, role string"
    rows = [(["met in 2012"], "soup", None, "", "short", "No.", None, ["bikes", "water"], None, ["taught Bo"], "cook"), (None, None, "", None, None, None, None, [], None, None, "cook")]
    got = [r.x for r in spark.createDataFrame(rows, portrait).select(W.about_lines(F.struct("*")).alias("x")).collect()]
    assert got == [["- met in 2012", "- Known for soup", "- Writes like this: short", "- Says: “No.”", "- Can be asked about bikes; water", "- taught Bo"], ["- cook"]]


def test_a_contradiction_is_all_that_is_said(spark):
    schema = "facts array<struct<fact_id long, category string, asserted_on string, negated boolean, fact string>>, summary string"
    plain = [(1, "where", "2019-01-01", False, "In the shed"), (2, "rule", "2020-01-01", True, "No fires"), (3, "where", "2019-05-01", False, "Behind it"), (4, "how", None, False, "By hand")]
    clash = [plain[0], (2, "where", "2019-01-11", True, "Not in the shed"), plain[3]]
    turned = [(1, "where", "2019-01-11", True, "Not in the shed"), (2, "where", "2019-01-01", False, "In the shed")]
    rows = [(plain, "s"), (clash, "s"), (turned, "s"), ([], "Only a summary"), ([], None)]
    got = [r.x for r in spark.createDataFrame(rows, schema).select(W.hit_reply(F.col("facts"), F.col("summary")).alias("x")).collect()]
    assert got[0] == "In the shed\n\nNo fires\n\nBehind it"
    assert got[1] == got[2] == "There are two answers, and it was never settled.\n\nIn the shed [2019-01-01]\n\nThen, 10 days later: Not in the shed"
    assert got[3:] == ["Only a summary", ""]


def test_replies_keep_authority_and_limits(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid int")
    parts = [(1, "general", 1, "g1"), (1, "general", 2, "g2"), *[(1, "camp", k, f"c{k}") for k in range(5)], (1, "docs", 2, "d2"), (1, "docs", 1, "d1"), (1, "odd", 1, "x")]
    got = {r.qid: r.reply for r in W.replies(q, spark.createDataFrame(parts, "qid int, layer string, rank int, text string")).collect()}
    assert got == {1: "c0\n\nc1\n\nc2\n\nd1\n\nIn general:\ng1\n\ng2", 2: "Nothing is on record about that."}


def test_fixed_sheets_drop_stories_one_by_one(spark):
    rows = [(1, "camp", 1, ["- a"]), (1, "lore", 2, ["- story two"]), (1, "lore", 1, ["- story one"]), (1, "docs", 1, [])]
    df = spark.createDataFrame(rows, "qid int, layer string, rank int, lines array<string>")
    sheet = lambda budget: W.fixed_sheet(df, ("camp", "docs", "lore"), budget, {"camp": "# C"}).first().sheet
    assert sheet(1000) == "# C\n- a\n- story one\n- story two" and sheet(25) == "# C\n- a\n- story one" and sheet(1) == "# C\n- a"


def test_entity_facts(spark):
    entities = spark.createDataFrame([(1, "Blue Bus", ["coach"]), (2, "Shed", [])], "entity_id long, name string, aliases array<string>")
    facts = [(k, 1, f"blue bus fact {k}", f"2019-01-{k:02d}") for k in range(1, 8)] + [(8, 1, "the ladder is on the blue bus", None), (9, 1, "a ladder and a lock", "2020-01-01"), (10, 2, "shed", None), (11, 2, "shed two", "2018-01-01")]
    df = spark.createDataFrame([(e, f, t, d) for f, e, t, d in facts], "entity_id long, fact_id long, fact string, asserted_on string")
    terms = spark.createDataFrame([(1, "blue", 1), (1, "ladder", 1), (1, "lock", 1), (2, "shed", 1)], "qid int, term string, n long")
    hits = spark.createDataFrame([(1, 1), (2, 2), (2, 1)], "qid int, entity_id long")
    got = sorted(tuple(r) for r in R.entity_facts(hits, entities, df, terms).collect())
    assert got == [(1, 1, 8, 1, 2), (1, 1, 9, 2, 1), (2, 1, 5, 0, 4), (2, 1, 6, 0, 3), (2, 1, 7, 0, 2), (2, 1, 9, 0, 1), (2, 2, 10, 0, 2), (2, 2, 11, 0, 1)]


def test_legacy_garbage(spark):
    names = {"Ana Luna": False, "Oz": False, "": True, "x": True, "2019-08-20 list": True, "8:30": True, "115.75": True, "+1 (415) 555-0199": True, "123-45": False, "a.b@example.org": True, "Account Statement May": True, "carrots (sliced)": True, None: True}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", U.legacy_garbage(F.col("n")).alias("g"))
    assert {r.n: r.g for r in df.collect()} == names


@pytest.mark.parametrize("partitions", ["1", "4", "13"])
def test_running_over_hot_and_null_keys(spark, partitions):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), k, rng.randint(0, 9)) for k in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.id: (r.n, r.spent) for r in S.running(spark.createDataFrame(rows, "k string, id long, c long"), "k", "id", cost=F.col("c")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    seen, want = {}, {}
    for k, i, c in rows:
        n, s = seen.get(k, (0, 0))
        seen[k] = want[i] = (n + 1, s + c)
    assert got == want


def test_cited_rows_must_be_there(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string")
    cited = lambda *ids: spark.createDataFrame([(i,) for i in ids], "source_id long")
    assert sorted(r.id for r in E.cited_or_fail(cited(1, 3, 3), rows, "id").collect()) == [1, 3]
    with pytest.raises(ValueError, match=r"missing: \[7, 9\]"):
        E.cited_or_fail(cited(9, 1, 7), rows, "id")


def test_yearly_counts_cite_every_row(spark):
    rows = [(1, 2019, "a", "attending"), (2, 2019, "a", "attending"), (3, 2019, "b", "maybe"), (4, 2020, "b", "attending"), (5, None, "c", "attending")]
    facts, evidence = E.yearly_counts(spark.createDataFrame(rows, "row_id long, year int, person string, status string"))
    assert sorted((r.year, r.fact) for r in facts.collect()) == [(2019, "1 people came in 2019"), (2020, "1 people came in 2020")]
    assert sorted(tuple(r) for r in evidence.collect()) == [(2019, 1), (2019, 2), (2020, 4)]


def test_answers_are_found_by_what_was_asked(spark):
    rows = [(1, "Where is the medkit", "In the bus, left side"), (2, "who cooks", "Ana"), (3, "medkit?", "Moved to the shed")]
    terms = spark.createDataFrame([(1, "medkit", 1), (1, "bus", 1)], "qid int, term string, n long")
    got = R.search_answers(spark.createDataFrame(rows, "id long, question string, body string"), terms).orderBy("rank").collect()
    assert [(r.id, r.fact, r.hits) for r in got] == [(-1, "In the bus, left side", 2), (-3, "Moved to the shed", 1)]


def test_legacy_rules(spark):
    rows = [("Costco May receipt", "Cashier: 12", "Ana joined using a group link"), ("Handbook", "plain words", "~ Ana"), ("Water", '{"a":[1,2],"b":{}}', "we left the group tent"), ("", "", "")]
    df = spark.createDataFrame(rows, "title string, text string, chat string")
    got = [tuple(r) for r in df.select(U.garbage_title(F.col("title")), U.garbage_content(F.col("text")), U.system_message(F.col("chat"))).collect()]
    assert got == [(True, True, True), (False, False, True), (False, True, True), (False, False, False)]


def test_exemption_takes_ones_own_words(spark):
    rows = spark.createDataFrame([(1, "She builds"), (2, "He cooks"), (3, "They cook")], "person_id int, text string")
    said = spark.createDataFrame([(1, "as a woman I say"), (2, "she is great"), (3, "my pronouns are they")], "person_id int, body string")
    assert {r.person_id: r.exempt for r in U.partition_exempt(rows, said).collect()} == {1: True, 2: False}


def test_opening_hour(spark):
    from gristmill.sources import pages

    days = spark.createDataFrame([("08-27", [1]), ("08-28", []), ("", [1, 2])], "date string, slots array<int>")
    assert [pages.opening_hour(days, t, 7).first().hour for t in ("08-27", "08-28", "09-01")] == ["07:00", None, None]
    assert pages.opening_hour(days.limit(0), "08-27", 7).first().hour is None


def test_entities_that_share_a_fact_id(spark):
    entities = spark.createDataFrame([(1, "Bus", []), (2, "Shed", [])], "entity_id long, name string, aliases array<string>")
    facts = spark.createDataFrame([(1, 5, "a ladder", "2020"), (2, 5, "a lock", "2019")], "entity_id long, fact_id long, fact string, asserted_on string")
    terms = spark.createDataFrame([(1, "ladder", 1)], "qid int, term string, n long")
    hits = spark.createDataFrame([(1, 1), (1, 2)], "qid int, entity_id long")
    assert sorted(tuple(r) for r in R.entity_facts(hits, entities, facts, terms).collect()) == [(1, 1, 5, 1, 1), (1, 2, 5, 0, 1)]
    assert [r.entity_id for r in R.search_entities(entities, facts, terms).collect()] == [1]

"""Operators on literal rows, against brute force where there is one."""

import itertools

import pytest
from pyspark.sql import functions as F

from gristmill.operators import compose as K
from gristmill.operators import evidence as E
from gristmill.operators import gaps as G
from gristmill.operators import people as P
from gristmill.operators import redact as X
from gristmill.operators import retrieve as R
from gristmill.operators import rules as U
from gristmill.operators import score as C
from gristmill.operators import sequences as S
from gristmill.operators import vectors as V

L = F.lit


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_admission_order(spark):
    ok = lambda t, c, y: value(spark, U.admits(L(t), L("f.md"), L(c), L(y).cast("int")))
    assert ok("Med kit shopping list", "finance", 2010)
    assert not ok("Shopping list", "water", 2026)
    assert not ok("Art car insurance", "water", 2026)
    assert ok("Evap pond", "water", None) and ok("Plan", "general", 2025) and not ok("Plan", "general", None)
    assert ok("On site shifts", "shifts", 2018) and not ok("Shifts sign-up", "shifts", 2026)


def test_names_that_are_not_people(spark):
    assert [value(spark, U.not_a_person(L(n))) for n in ("OZ", "Oz", "Olive oils", "42", "A", "Ana")] == [True, False, True, True, True, False]
    people = spark.createDataFrame([(1, "OZ"), (2, "Sugar"), (3, "Ana")], "person_id long, name string")
    wrote = spark.createDataFrame([(1,)], "person_id long")
    assert {r.person_id for r in U.people_only(people, wrote).collect()} == {1, 3}


def test_first_names_and_surnames(spark):
    first = lambda a, b: value(spark, P.first_names_agree(L(a), L(b)))
    last = lambda a, b: value(spark, P.surnames_agree(L(a), L(b)))
    assert first("Don", "Donald") and first("Bob", "Robert") and first("James/Jimmy", "Jim") and not first("Aron", "Amos") and not first("", "Bo")
    assert last("Z", "Zola") and last("MC", "Moreno Castro") and last("Li", "li") and not last("Li", "Lima") and not last("", "Li")


def test_name_pairs_lose_none(spark):
    firsts = ["Bob", "Robert", "Rob", "Ana", "Anna", "Al", "Alexander", "James/Jimmy", "Jim", "Don", "Donald", "B"]
    lasts = ["Li", "L", "Moreno Castro", "MC"]
    rows = [(i, f, l) for i, (f, l) in enumerate(itertools.product(firsts, lasts))]
    df = spark.createDataFrame(rows, "id long, first string, last string")
    got = {(r.a_id, r.b_id) for r in P.name_pairs(df, df).collect()}
    a, b = df.toDF("a", "af", "al"), df.toDF("b", "bf", "bl")
    want = {(r.a, r.b) for r in a.join(b, P.first_names_agree(F.col("af"), F.col("bf")) & P.surnames_agree(F.col("al"), F.col("bl"))).collect()}
    assert got == want


def test_near_spellings_and_terms(spark):
    words = ["lanford", "lanfor", "lanfords", "lenfordx", "kerrigan", "kerigan", "kerriga", "woodmanson", "woodmansen"]
    df = spark.createDataFrame(list(enumerate(words)), "id long, name string")
    got = {(r.a_id, r.b_id) for r in P.near_spellings(df, df, least=6).collect()}
    both = df.toDF("a", "x").join(df.toDF("b", "y"), (F.col("a") != F.col("b")) & (F.levenshtein("x", "y") <= 1))
    assert got == {(r.a, r.b) for r in both.collect()}
    tokens = spark.createDataFrame([("genratar",), ("pump",), ("pimp",), ("zzzz",)], "token string")
    vocabulary = spark.createDataFrame([("Generator",), ("Pump",)], "term string")
    assert {r.token: r.term for r in P.nearest_term(tokens, vocabulary).collect()} == {"genratar": "Generator", "pump": "Pump", "pimp": "Pump"}


def test_components_and_cliques(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8), (8, 9), *[(k, k + 1) for k in range(20, 60)]], "a long, b long")
    labels = P.connected(edges, str(tmp_path))
    got = {r.node: r.root for r in labels.collect()}
    assert got[3] == 1 and got[9] == 7 and got[60] == 20 and len(got) == 47
    assert {r.root: (r.size, r.clique) for r in P.cliques(edges, labels).collect()} == {1: (3, True), 7: (3, False), 20: (41, False)}


def test_duplicates_and_references(spark):
    people = spark.createDataFrame([(1, "Ana Stone", 3), (2, "~ ana  stone", 9), (3, "Bo", 0)], "person_id long, name string, messages int")
    m = P.duplicate_names(people)
    assert {r.person_id: r.survivor for r in m.collect()} == {1: 2, 2: 2, 3: 3}
    refs = spark.createDataFrame([(1, "x"), (3, "y"), (8, "z")], "person_id long, t string")
    assert sorted(r.person_id for r in P.repoint(refs, m, "person_id").collect()) == [2, 3, 8]


def test_statuses_and_commitments(spark):
    s = lambda t: value(spark, P.status_of(L(t), "listed"))
    assert [s(x) for x in ("Yesssss!", "not attending", "no", "yes/hopefully", "", "Unlikely because", "50/50", "I said no", "100%")] == ["attending", "not", "not", "maybe", "listed", "maybe", "maybe", "listed", "attending"]
    c = lambda t: value(spark, P.confirms(L(t)))
    assert [c(x) for x in ("420", "0", "NO DUES", "Refunded", "paid", "✓", "")] == [True, False, False, False, True, True, False]
    n = value(spark, P.split_name(L("~ Jen 'Comet' Calder Ray")))
    assert (n["first"], n["last"], n["nickname"]) == ("Jen", "Calder Ray", "Comet")


VANISH = [
    "Last 4 digits: 2775", "Visa ending in 1014", "order 111-1234567-7654321", "Routing Number: 123456789", "4242 4242 4242 4242",
    "write to someone@gmail.com", "Ana's cell number is +1 415 555 0199", "Phone: +15555550100.", "Ana - 415-555-0199",
    "Shipping Address: Ana, 1272 LONG MEADOW ST UNIT 19, SPRING VALLEY, CA 94107-4405",
]
SURVIVE = [
    "The yard is at 12 Main Street, come early", "Bake for 45 minutes at 350", "gate code 4471", "Acme Rentals LLC phone: 775-555-0100",
    "call the yard on 775-555-0100", "open 2024-08-25 to 2024-09-02", "mail sales@acmerentals.com", "id 1724630400",
]


def test_redaction_both_ways(spark):
    rows = spark.createDataFrame(list(enumerate([*VANISH, *SURVIVE, None])), "id int, text string")
    got = {r.id: r.text for r in X.redact(rows, "text", ["Ana Stone", "S"]).collect()}
    for k, t in enumerate(VANISH):
        assert got[k] != t and ("removed]" in got[k] or "****" in got[k]), t
    for k, t in enumerate(SURVIVE, len(VANISH)):
        assert got[k] == t
    assert got[len(VANISH) + len(SURVIVE)] is None
    long = spark.createDataFrame([(1, "x " * 60 + "Ana Stone's cell number is +1 415 555 0199 " + "y " * 60 + "call the yard on 775-555-0100 Billing address 12 Main Street " + "z " * 300 + "14 Main Street")], "id int, text string")
    t = X.redact(long, "text", ["Ana Stone"]).first().text
    assert "+1 415" not in t and "775-555-0100" in t and "12 Main" not in t and "14 Main Street" in t


def test_only_candidates_are_redacted_in_python(spark):
    """Each kind of contact and cue alone, in letters, digits and blanks that Java and Python take differently, against the rules on every text."""
    texts = [*VANISH, *SURVIVE, "plain words only", "", "Shipping\u2003Address: 12 Main Street", "\u017fhip\x1cto 12 Main Street", "b\u0131ll\u00a0to 14 Main Street, Ana", "Ana - \u0664\u0661\u0665 555 0199 12", "Ana - \U00011f51\U00011f52\U00011f53 555 0199",
             "12 Main Street, payment\u2009method: cash", "14 Main Street SHIPP\u0130NG SPEED", "delivery\ninformation 9 Long Lane"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rules = X.Contextual(X.roster_tokens(["Ana Stone"]))
    clean = {r.id: r.t for r in rows.select("id", X.always(F.col("text")).alias("t")).collect()}
    assert {r.id: r.text for r in X.redact(rows, "text", ["Ana Stone"]).collect()} == {k: rules(t) for k, t in clean.items()}
    assert sum(rules(t) != t for t in clean.values()) >= 12
    plan = X.redact(rows, "text", ["Ana Stone"])._jdf.queryExecution().executedPlan().toString()
    assert "contextual(CASE WHEN (" in plan  # no more is sent to Python


def test_gate_and_leaks(spark):
    rows = spark.createDataFrame([(1, "card 4242424242424242", "x@gmail.com"), (2, "fine", None)], "id int, a string, b string")
    assert sorted((r.column, r.finding) for r in X.findings(rows, "id", ["a", "b"]).collect()) == [("a", "card number"), ("b", "personal email")]
    names = spark.createDataFrame([("Ana Stone",), ("Bo Li",)], "name string")
    texts = spark.createDataFrame([(1, "stone said ana"), (2, "bo went")], "id int, text string")
    assert [(r.id, r.name) for r in X.leaked_names(texts, "id", "text", names).collect()] == [(1, "Ana Stone")]


def test_evidence(spark):
    claims = spark.createDataFrame([(1,), (2,)], "id long")
    ev = spark.createDataFrame([("fact", 1, "doc", 9), ("fact", 1, "gone", 1), ("fact", 2, "doc", 8)], "claim_table string, claim_id long, source_table string, source_id long")
    assert E.unevidenced({"fact": (claims, "id")}, ev.filter("claim_id = 1")).collect()[0].claim_id == 2
    docs = spark.createDataFrame([(9, "The pump is old")], "id long, text string")
    assert sorted((r.source_table, r.source_id) for r in E.dangling(ev, {"doc": (docs, "id")}).collect()) == [("doc", 8), ("gone", 1)]
    with pytest.raises(E.IntegrityError):
        E.demand_empty(E.dangling(ev, {"doc": (docs, "id")}), "dangling")
    cited = spark.createDataFrame([("j", 1, 9, "the PUMP"), ("j", 2, 9, "the tap"), ("j", 3, 7, "x")], "job_id string, claim_id long, source_id long, quote string")
    shown = spark.createDataFrame([("j", 9)], "job_id string, source_id long")
    assert {r.claim_id: r.reason for r in E.check_citations(cited, shown, docs.toDF("source_id", "text")).collect()} == {1: None, 2: "quote not in source", 3: "id not shown"}


def test_first_contradiction(spark):
    import random

    f = [(1, 1, "a", "2023-01-01", "There is water"), (1, 2, "a", "2024-01-01", "There is no water"), (1, 3, "b", "2024-01-01", "never"), (2, 4, "a", "2024-01-01", "not here"), (1, 5, None, "2020-01-01", "not")]
    rng = random.Random(2)
    f += [(k, 10 + n, "c", f"2024-01-0{rng.randint(1, 3)}", rng.choice(("no water", "water"))) for n, k in enumerate(rng.choices(range(3, 30), k=200))]
    df = spark.createDataFrame(f, "entity_id int, fact_id int, category string, asserted_on string, fact string")
    want = {}
    for a in sorted(f, key=lambda x: x[1]):
        for b in sorted(f, key=lambda x: x[1]):
            if a[1] < b[1] and a[2] and a[0] == b[0] and a[2] == b[2] and a[3] != b[3] and ("no" in a[4]) != ("no" in b[4]):
                want.setdefault((a[0], a[2]), (a[1], b[1]) if a[3] < b[3] else (b[1], a[1]))
    assert {(r.entity_id, r.category): (r.earlier, r.later) for r in E.contradictions(df).collect()} == want


def test_numbers_have_no_gap(spark):
    rows = spark.range(300_000).select((F.col("id") % 1000).alias("k"), "id", F.rand(3).alias("x"))
    for on in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", on)
        got = G.assign_sequence(rows, 500, "x", "id")
        r = got.agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.countDistinct("seq").alias("n"), F.count("*").alias("m")).first()
        assert (r.a, r.b, r.n, r.m) == (501, 300_500, 300_000, 300_000)
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_budget_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate((3000, 2000, 10))] + [(2, 0, 9000), (2, 1, 1)], "q int, k int, n int")
    assert sorted((r.q, r.k) for r in S.within_budget(rows, F.col("n"), 4000, "q", "k").collect()) == [(1, 0), (2, 0)]


def test_session_edges(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 01:30:00", "2024-01-01 03:00:01", None]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(times)], "u int, k int, t string").withColumn("t", F.to_timestamp("t"))
    assert [r.session for r in S.sessions(rows, "u", "t", "k").orderBy("k").collect()] == [1, 1, 2, 3]
    many = spark.createDataFrame([(1, k, "2024-01-01 00:00:00") for k in range(65)], "u int, k int, t string").withColumn("t", F.to_timestamp("t"))
    assert [r["count"] for r in S.sessions(many, "u", "t", "k").groupBy("part").count().orderBy("part").collect()] == [30, 30, 5]


def test_month_windows_fold(spark):
    rows = [("g", f"2024-{m:02d}-05") for m, n in ((1, 100), (2, 60), (3, 160), (4, 20)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, d string").withColumn("d", F.to_date("d"))
    assert sorted((r.first_month, r.last_month, r.rows) for r in S.month_windows(df, "g", "d").collect()) == [("2024-01", "2024-02", 160), ("2024-03", "2024-04", 180)]
    thin = spark.createDataFrame([("g", "2024-01-01")], "g string, d string").withColumn("d", F.to_date("d"))
    assert [r.rows for r in S.month_windows(thin, "g", "d").collect()] == [1]


def test_gap_rollup_and_review(spark):
    log = spark.createDataFrame([("Where is the pump?", 1, 1, True), ("where's the pump", 5, 2, True), ("fine", 2, 3, False)], "question string, asked_at int, id int, gap boolean")
    r = G.rollup(log, spark.createDataFrame([("WHERE is the pump", "approved")], "question string, status string")).collect()
    assert [(x.asks, x.question, x.answered) for x in r] == [(2, "where's the pump", True)]
    events = spark.createDataFrame([(1, 7, "pending"), (2, 7, "approved"), (3, 7, "approved"), (4, 8, "approved"), (5, 8, "rejected")], "seq long, id long, status string")
    assert sorted((x.id, x.status, x.approved_seq) for x in G.review(events).collect()) == [(7, "approved", 2), (8, "rejected", 4)]


def test_passages(spark):
    body = "Intro words. " * 40 + "The pump is by the tank. Prime the pump before use. " + "After words here. " * 40
    many = "pump here " * 3000 + "x " * 400 + "pump pump pump prime"  # beyond any fixed number of places
    found = spark.createDataFrame([(1, 1, body), (1, 2, "nothing of the kind"), (1, 3, "the pump"), (1, 4, "{}[]" * 30 + " pump"), (1, 5, many)], "qid int, doc_id int, text string")
    terms = spark.createDataFrame([(1, "pump", 1), (1, "prime", 1)], "qid int, term string, n long")
    got = {r.doc_id: r.passage for r in R.passages(found, terms).collect()}
    assert set(got) == {1, 3, 5} and got[3] == "the pump"
    assert "Prime the pump" in got[1] and got[1].endswith(" …") and len(got[1]) < 460
    docs = spark.createDataFrame([(k, "pump " * n + tail) for k, (n, tail) in enumerate(((30, "{}[] " * 200), (20, "is here now"), (15, "is there too")))], "doc_id int, text string")
    assert sorted(r.doc_id for r in R.search_documents(docs, terms, k=2).collect()) == [0, 1]
    assert [(r.doc_id, r["rank"]) for r in R.search_documents(docs, terms, k=2, readable=True).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_search_borrows_and_widens(spark):
    q = spark.createDataFrame([(1, "and Zed?", "where is the pump"), (2, "red pump tank", "x")], "qid int, question string, before string")
    t = R.question_terms(q, "before")
    assert {(r.qid, r.term) for r in t.collect()} == {(1, "zed"), (1, "pump"), (2, "red"), (2, "pump"), (2, "tank")}
    wide = R.widen(t, spark.createDataFrame([("Zed", "Pavel B")], "alias string, name string"))
    assert (1, "pavel") in {(r.qid, r.term) for r in wide.collect()}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "m"), (2, [0.9, 0.1], "m"), (3, [1.0, 0.0], "other"), (4, [float("nan"), 0.0], "m"), (5, [1.0], "m"), (6, [0.0, 1.0], "m")], "vec_id long, embedding array<float>, model string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "m")], "qid long, query array<float>, model string")
    assert [r.vec_id for r in V.nearest(rows, q, 5, dim=2).collect()] == [2]
    assert value(spark, V.normalise(F.array(L(3.0), L(4.0)))) == [0.6, 0.8] and value(spark, V.normalise(F.array(L(0.0)))) == [0.0]


def test_sheets_rank_and_spend(spark):
    rows = spark.createDataFrame([(1, "docs", 1, "- pump doc", "pump tank"), (1, "lore", 1, "- story", "pump"), (1, "camp", 1, "- fact", "none")], "qid int, layer string, rank int, line string, text string")
    terms = spark.createDataFrame([(1, "pump", 1), (1, "tank", 1)], "qid int, term string, n long")
    sheet = K.fact_sheet(rows, terms).first().sheet.split("\n")
    assert sheet == [K.HEADERS["docs"][0], "- pump doc", "- story", K.HEADERS["camp"][1], "- fact"]
    own = K.fact_sheet(rows, terms, headers={"docs": ("D", None), "camp": ("C", "c"), "lore": (None, None)}).first().sheet.split("\n")
    assert own == ["D", "- pump doc", "- story", "c", "- fact"]
    assert K.fact_sheet(rows, terms, budget=46).first().sheet.split("\n") == sheet[:2]


def test_chunks_are_the_text(spark):
    text = "para one\n\n" + "x" * 130 + "\n\nlast\n \nend"
    got = value(spark, C.chunk_text(L(text), 50))
    assert "".join(got) == text and max(map(len, got)) <= 50


def test_rewrites_and_cases(spark):
    r = lambda a, b: value(spark, C.rewrite_rejection(L(a), L(b)))
    assert r("He runs Camp Kitchen", "They run Camp Kitchen") is None
    assert r("He runs Camp Kitchen", "She runs Camp Kitchen") == "still gendered"
    assert r("He runs Camp Kitchen", "They") == "length" and r("He runs Camp Kitchen", "They run the Kitchen") == "lost a name"
    v = lambda a, m, n, f: value(spark, C.case_verdict(L(a), F.array(L(m)), F.array(L(n)), L(f)))
    assert [v("Pumps here", "pump", "tank", False), v("I don't know", "pump", "tank", False), v("I don't know", "pump", "tank", True), v("tank and pump", "pump", "tank", False), v("x", "pump", "y", False)] == ["pass", "refused", "pass", "forbidden", "missing"]


def test_ask_words(spark):
    words = spark.createDataFrame([(1, k, w) for k, w in enumerate(["the", "Medkit", "medkit", "id 12345", "bandage", "pump"])], "claim_id int, place int, word string")
    present = spark.createDataFrame([(1, "pump")], "claim_id int, word string")
    assert [r.word for r in U.ask_words(words, present).orderBy("n").collect()] == ["medkit", "bandage"]


def test_unreserved_meets_a_name_once(spark):
    """One alias that is many entities' name: each alias meets one row for that name."""
    same = spark.range(2000).select(F.col("id").alias("entity_id"), L("Red Widget").alias("name"))
    free = U.unreserved(same.select("entity_id", L("red widget").alias("alias")).unionByName(spark.createDataFrame([(7, "own"), (8, None), (8, "Ann"), (None, "red widget")], "entity_id long, alias string")), same.unionByName(spark.createDataFrame([(7, "Own")], "entity_id long, name string")), spark.createDataFrame([("ann",)], "name string"))
    assert sorted(map(tuple, free.collect()), key=str) == [(7, "own"), (8, None), (None, "red widget")]
    joined = free._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in joined and "Join Inner" not in joined and "min(_other" in joined


def test_rewrites_next_to_other_scripts(spark):
    """As in SQL, only ASCII letters, digits and _ make a word go on."""
    r = lambda a, b: value(spark, C.rewrite_rejection(L(a), L(b)))
    assert r("bon\u00e9 runs", "bon\u00e9he runs") == "still gendered" and r("bon xhe runs", "bon xhe runs") is None
    assert r("\u00e9Camp is on", "\u00e9kamp is on") == "lost a name" and r("xCamp is on", "xkamp is on") is None


def test_near_spellings_of_copies(spark):
    """Rows of one name join their names' pairs; keys are never broadcast, whatever size the planner takes them for."""
    names = ["annabella", "annabela", "robertson", "annabella"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names * 2)], "id long, name string")
    got = P.near_spellings(df, df)
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    close = lambda a, b: a == b or {a, b} == {"annabella", "annabela"}
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in range(8) for b in range(8) if a != b and close((names * 2)[a], (names * 2)[b])]
    twice = spark.createDataFrame([(1, "annabella"), (1, "annabela"), (2, "annabella")], "id long, name string")
    assert sorted(map(tuple, P.near_spellings(twice, twice).collect())) == [(1, 2), (2, 1)]


def test_places_go_to_readable_documents_however_far_behind(spark, monkeypatch):
    from gristmill.operators import retrieve as R

    cut = []
    monkeypatch.setattr(R, "passages", lambda found, terms, of=R.passages: cut.append(found.count()) or of(found, terms))
    good, bad = "the pump stands here and the pump runs all day for us", "pump " + "x" * 40
    rows = [(k, good if k in (70, 75) else bad) for k in range(80)] + [(100 + k, "lamp " + good.replace("pump", "lamp")) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = spark.createDataFrame([(1, "pump", 1), (2, "lamp", 1)], "qid int, term string, n long")
    scored = spark.createDataFrame([(1 if k < 80 else 2, k, 1000.0 - k) for k, _ in rows], "qid int, doc_id long, score double")
    got = {(r.qid, r.rank): r.doc_id for r in R.first_readable(scored, docs, terms, 2, width=4).collect()}
    assert got == {(1, 1): 70, (1, 2): 75, (2, 1): 100, (2, 2): 101}
    assert cut == [8, 32, 44]  # question 2 is served by its first four


def test_sharing_counts_pairs_where_their_member_is(spark):
    import random
    from collections import Counter

    from gristmill.operators import gaps as G

    rng = random.Random(5)
    rows = sorted({(rng.randrange(12), rng.randrange(9)) for _ in range(60)} | {(k, 99) for k in range(12)})
    met = [(a, b, p) for a, p in rows for b, q in rows if p == q and a < b]
    n = Counter((a, b) for a, b, _ in met)
    want = sorted((a, b, c, min(p for x, y, p in met if (x, y) == (a, b))) for (a, b), c in n.items())
    df = G.sharing(spark.createDataFrame(rows, "s long, p long"), "s", "p", pairs=10)
    assert sorted(tuple(r) for r in df.collect()) == want
    assert df.rdd.getNumPartitions() >= len(met) // 10  # more pairs, more tasks


def test_floor_union_takes_three_of_a_label(spark, tmp_path):
    from gristmill.plans.search import vector_floor_union

    v = lambda k: [1.0, float(k % 7), float(k % 3)]
    rows = [(k, v(k), k % 2 if k < 120 else None) for k in range(0, 130)] + [(2, v(2), 0), (50, v(50), 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.qid, r.id, r.weight) for r in vector_floor_union(spark, str(tmp_path)).collect() if r.tier == 0)
    assert [x for x in got if x[0] == 100] == [(100, 0, 99.0), (100, 2, 97.0), (100, 2, 98.0)]
    plan = vector_floor_union(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "times" in plan  # few ids of a label meet its questions, not all rows

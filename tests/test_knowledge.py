"""Entities, people and stories by hand."""

from gristmill.operators import knowledge as N
from gristmill.operators.matching import one_to_one


def test_merge_chains_and_kinds(spark, tmp_path):
    rows = [(1, "Glimmerel", "camp", ["x"], 3), (2, "glimmaerel", "camp", ["glimmerel"], 9), (3, "GLIMMEREL", "camp", [], 1), (4, "glimmerel", "vehicle", [], 99), (5, "other", "camp", [], 1)]
    e = spark.createDataFrame(rows, "entity_id long, name string, kind string, aliases array<string>, mention_count int")
    merged, clashes = N.merge_entities(e, str(tmp_path))
    assert {r.entity_id: r.survivor for r in merged.collect()} == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5}
    assert {(r.a, r.b) for r in clashes.collect()} == {(1, 4), (2, 4)}


def test_appearances_in_stages(spark, tmp_path):
    rows = [(1, "Ana", "Stone", "a@x"), (2, "Ana", "Stone", ""), (3, "Ana", "S", ""), (4, "Ana", "", ""), (5, "Bo", "Li", "b@x"), (6, "Bo", "Lima", "c@x"), (7, "Bo", "L", ""), (8, "Bo", "", ""), (9, "Anna", "Stone-K", "a@x"), (10, "Cy", "", "")]
    got = {r.id: r.person for r in N.cluster_appearances(spark.createDataFrame(rows, "id long, first string, last string, email string"), str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 9: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8, 10: 10}


def test_stories(spark, tmp_path):
    base = "generator caught fire beside kitchen while everybody danced until sunrise"
    rows = [
        (1, "j", "Fire", base + " and it was loud", 2019, ["Ana"], [1, 2, 9]),
        (2, "j", "The fire", base, None, ["Bo", "Nobody"], [1, 2, 3]),
        (3, "j", "Fire again", base, 2023, ["Ana"], [1, 2]),
        (4, "j", "At @handle", base, 2019, [], [1, 2]),
        (5, "j", "Thin", base, 1999, [], [1, 77]),
    ]
    s = spark.createDataFrame(rows, "id long, job_id string, title string, story string, year int, people array<string>, cited array<long>")
    shown = spark.createDataFrame([("j", k) for k in (1, 2, 3)], "job_id string, source_id long")
    names = spark.createDataFrame([("ana",), ("Bo",)], "name string")
    v = {r.id: r for r in N.validate_stories(s, shown, names).collect()}
    assert {k: r.reason for k, r in v.items()} == {1: None, 2: None, 3: None, 4: "handle", 5: "support"}
    assert v[2].people == ["Bo"] and v[1].sources == [1, 2]
    good = N.validate_stories(s, shown, names).filter("reason is null and id in (1, 2)").drop("reason")
    one = N.consolidate_stories(good, str(tmp_path)).collect()
    assert [(r.id, r.year, r.people, r.sources, r.tellings) for r in one] == [(2, 2019, ["Ana", "Bo"], [1, 2, 3], 2)]
    # years at odds keep 1 and 3 apart, but 2, which has none, links both: components are larger than pairwise merging
    all_ = N.consolidate_stories(N.validate_stories(s, shown, names).filter("reason is null").drop("reason"), str(tmp_path)).collect()
    assert [r.tellings for r in all_] == [3]


def test_people_records(spark):
    people = spark.createDataFrame([(1, "Pavel Bart", 9), (2, "Bo", 3), (3, "~ Cy cy@x.org", 1)], "person_id long, name string, messages int")
    roster = spark.createDataFrame([(1, "Pavel Bartosh", "Comet")], "person_id long, name string, nickname string")
    aliases = spark.createDataFrame([(1, "Zed"), (1, "Pavel Bart")], "person_id long, alias string")
    names = N.known_names(people, roster, aliases)
    assert {r.person_id: r.names for r in names.collect()}[1] == ["Pavel Bart", "Pavel Bartosh", "Comet", "Zed"]
    terms = spark.createDataFrame([(1, "zed", 1), (2, "zed", 1), (2, "pump", 1), (3, "zed", 1), (3, "bo", 1)], "qid int, term string, n long")
    assert {r.qid: (r.person_id, r.second) for r in N.portraits(names, people, terms).collect()} == {1: (1, None), 3: (1, 2)}
    stories = spark.createDataFrame([(1, "a", 2019, "Pavel, Bo Li"), (2, "b", 2023, "Pavel Bart"), (3, "c", None, "Boris")], "id long, title string, year int, people string")
    assert {(r.person_id, r.id, r.r) for r in N.stories_about(stories, people).collect()} == {(1, 2, 1), (1, 1, 2), (2, 1, 1)}
    assert {r.person_id: r.name for r in N.tidy(people).collect()}[3] == "Cy"
    assert {(r.person_id, r.alias) for r in N.name_parts(people).collect()} >= {(1, "Pavel"), (1, "Bart")}
    got = one_to_one(spark.createDataFrame([(1, 1, 5), (1, 2, 4), (2, 1, 4), (2, 2, 1)], "a_id long, b_id long, score int"))
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == [(1, 1), (2, 2)]
    expertise = spark.createDataFrame([(1, "power", "moderate"), (1, "art", "mentioned"), (1, "water", "strong"), (1, "zoo", "mentioned")], "person_id long, topic string, strength string")
    assert N.top_expertise(expertise).first().topics == ["water", "art", "power"]

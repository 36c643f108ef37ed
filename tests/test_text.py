"""Text functions on literal rows, quirks included."""

import pytest
from pyspark.sql import functions as F

from gristmill.functions import dates as D
from gristmill.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


L = F.lit


def test_terms(spark):
    assert value(spark, T.terms(L("Where's the médkit, and the generator generator? x"))) == ["médkit", "generator", "generator"]
    assert value(spark, T.terms(L("what is the"))) == []


@pytest.mark.parametrize(
    ("text", "word", "want"),
    [("the tap is on", "tap", True), ("tapas and a tap", "tap", False), ("a tap and tapas", "tap", True), ("taps", "tap", False), ("(tap)", "tap", True), ("étap", "tap", False), ("", "tap", False)],
)
def test_whole_word_of_the_first_occurrence_only(spark, text, word, want):
    assert value(spark, T.contains_word(L(text), L(word))) is want


def test_counts_every_whole_word(spark):
    assert value(spark, T.count_word(L("tapas, a tap, Tap. taps"), L("tap"))) == 2


def test_gap_keys(spark):
    same = ["Where's the medkit?", "where is the medkit", "WHERE’s THE medkit"]
    assert len({value(spark, T.gap_key(L(q))) for q in same}) == 1
    assert value(spark, T.normalise_question(L("water and power"))) == value(spark, T.normalise_question(L("power and water")))
    assert value(spark, T.normalise_question(L("what is the?"))) == "what is the"


def test_refusals(spark):
    assert value(spark, T.is_refusal(L("Well, I do not know that.")))
    assert value(spark, T.is_refusal(L("I don’t have a fact for it")))
    assert not value(spark, T.is_refusal(L("I know that it is here")))


def test_quotes(spark):
    text = L("She said\n  The  Pump  is  old. Twice.")
    assert value(spark, T.quote_verified(text, L("the pump is OLD")))
    assert value(spark, T.locate_quote(text, L("the pump is OLD"))) == "The  Pump  is  old"
    assert value(spark, T.locate_quote(text, L("no such"))) is None
    assert value(spark, T.locate_quote(L("a.c abc"), L("a.c"))) == "a.c"


def test_norms_and_skeletons(spark):
    assert value(spark, T.ascii_norm(L("  Éva O'Neil-2 "))) == "va oneil2"
    assert value(spark, T.letter_norm(L("Éva O'Neil"))) == "éva o neil"
    assert value(spark, T.skeleton(L("Balloon"))) == "bln"
    assert value(spark, T.slug(L("  Crème Brûlée!  "))) == "creme-brulee"
    assert value(spark, T.undouble(L("Tea Time Tea Time"))) == "Tea Time"
    assert value(spark, T.undouble(L("TeaTea"))) == "Tea"
    assert value(spark, T.undouble(L("Tea"))) == "Tea"
    assert value(spark, T.unescape_html(L("a &amp; b&nbsp;&#39;c&#39;"))) == "a & b 'c'"


def test_small_ones(spark):
    assert value(spark, T.year_in(L("x/2023 plan 2019.md"))) == 2023 and value(spark, T.year_in(L("none"))) is None
    assert value(spark, T.human_list(F.array(L("a"), L("b"), L("c")))) == "a, b and c" and value(spark, T.human_list(F.array(L("a")))) == "a"
    assert value(spark, T.clip(L("word " * 60), 20)) == "word word word word…"
    assert value(spark, T.near_repeat(L("where is the pump"), L("the old pump")))
    assert not value(spark, T.near_repeat(L("pump"), L("water")))
    assert value(spark, T.strip_handles(L("hi ⁨@⁩ @bob there"))).split() [-1] == "there"
    assert value(spark, T.readable(L("plain words in a row"))) and not value(spark, T.readable(L("x" * 26 + " a b c d")))
    assert value(spark, T.jaccard(F.array(L("a"), L("b")), F.array(L("b"), L("c")))) == pytest.approx(1 / 3)
    assert value(spark, T.sentences(L("One. Two! Three"))) == ["One.", "Two!", "Three"]


def test_decay_and_dates(spark):
    assert value(spark, D.recency(L(2026), 2026)) == 1.0
    assert value(spark, D.recency(L(2024), 2026)) == pytest.approx(0.88**2)
    assert value(spark, D.recency(L(1990), 2026)) == 0.35
    assert value(spark, D.recency(L(None).cast("int"), 2026)) == 0.6
    assert value(spark, D.human_date(L("2024-03-05T10:00"))) == "5 Mar 2024"
    day = lambda s: F.to_date(L(s))
    for b, want in (("2024-01-01", "the same day"), ("2024-01-02", "the next day"), ("2024-01-14", "13 days later"), ("2024-02-01", "a few weeks later"), ("2024-06-01", "months later"), ("2026-01-01", "years later")):
        assert value(spark, D.gap_phrase(day("2024-01-01"), day(b))) == want


def test_hue_wraps_in_64_bits(spark):
    from pyspark.sql import functions as F

    from gristmill.functions import text as T

    def brute(name):
        h = 5381
        for b in name.lower().encode():
            h = (h * 33 + b) % 2**64
        return round(0.02 + h % 1000 / 1000 * 0.53, 6)

    names = ["", "a", "Ana Luna", "ANA LUNA", "Zoë Marchetti-Überall the Third of Nowhere", "é" * 60]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.hue(F.col("n")).alias("h")).collect()
    assert {r.n: r.h for r in got} == {n: brute(n) for n in names}

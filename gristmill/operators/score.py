"""Scores of answers and texts: overlap, invention, near-identity, chunks, training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import set_join

#: Fixed pattern: a word that is capitalised, or a number.
SPECIFIC = r"^(?:[A-Z][a-z]{2,}|\d{1,4})$"


def invented(answer: Column, facts: Column, common: tuple[str, ...] = ()) -> Column:
    """Distinct specifics of the answer that the facts don't have."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(answer, F.lit(f"{T.WORD_CHARS}+"), F.lit(0)), lambda w: w.rlike(SPECIFIC)))
    kept = T.let(T.words(facts), lambda given: F.filter(found, lambda s: ~F.array_contains(given, F.lower(s))))
    return F.array_except(kept, T.strings(common)) if common else kept


def copied(texts: DataFrame, sources: DataFrame, key: str, n: int) -> DataFrame:
    """(key, grams, copied): n-word runs of each text, and those that a source has.

    Runs are counted in their row; those whose 64-bit hash a source has - an equi-join on the hash - are then told apart by the run itself.
    """
    runs = T.word_runs(T.words(F.col("text")), n)
    own = texts.select(F.monotonically_increasing_id().alias("_row"), key, runs.alias("runs")).select("_row", key, F.size("runs").cast("long").alias("grams"), F.explode_outer("runs").alias("gram"))
    known = sources.select(F.explode(runs).alias("gram")).distinct().select(F.xxhash64("gram").alias("h"), F.col("gram").alias("_known"))
    hashed = own.select("_row", key, "grams", F.xxhash64("gram").alias("h"), "gram")
    hit = hashed.join(F.broadcast(known) if known.count() <= 500_000 else known, "h", "left")
    return hit.groupBy("_row", key, "grams").agg(F.count_if(F.col("gram") == F.col("_known")).alias("copied")).filter("grams > 0").drop("_row")


def jaccard_pairs(rows: DataFrame, key: str, tokens: str, floor: float) -> DataFrame:
    """(a, b, jaccard) at ``floor`` or more, each pair once (``set_join``)."""
    return set_join.similar(rows, key, tokens, floor).withColumn("jaccard", F.round("jaccard", 6))


def chunk_text(text: Column, target: int = 6000) -> Column:
    """Verbatim slices of about ``target`` characters, cut at blank lines; longer paragraphs are cut hard. Together they are the text."""
    marked = F.regexp_replace(text, "(\n[ \t]*\n)", "$1\x00")
    paragraphs = F.split(marked, "\x00")
    hard = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(p) - 1) / target), F.lit(0)).cast("int")), lambda i: F.call_function("substring", p, i * target + 1, F.lit(target)))))

    def step(acc, p):
        fits = F.length(acc["open"]) + F.length(p) <= target
        return F.struct(
            F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(fits | (acc["open"] == ""), F.concat(acc["open"], p)).otherwise(p).alias("open"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.filter(F.aggregate(hard, start, step, lambda a: F.concat(a["done"], F.array(a["open"]))), lambda c: c != "")


def rewrite_rejection(before: Column, after: Column) -> Column:
    """Why a rewrite isn't acceptable; null if it is."""
    from gristmill.operators.rules import gendered

    caps = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(T.ASCII_EDGE_BEFORE + r"[A-Z][\p{L}]+"), F.lit(0)))
    return (
        F.when(after.isNull() | (F.trim(after) == ""), F.lit("empty"))
        .when(gendered(after), F.lit("still gendered"))
        .when((F.length(after) < F.length(before) * 0.6) | (F.length(after) > F.length(before) * 1.4), F.lit("length"))
        .when(F.size(F.filter(F.array_except(caps(before), caps(after)), lambda w: ~w.isin("He", "She", "His", "Her", "Him"))) > 0, F.lit("lost a name"))
    )


def case_verdict(answer: Column, must: Column, must_not: Column, may_refuse: Column) -> Column:
    """pass, or what is wrong: a refusal that isn't allowed, a missing mention (substrings count, so plurals do), a forbidden one."""
    low = F.lower(answer)
    has = lambda w: F.contains(low, F.lower(w))
    refused = T.is_refusal(answer)
    return (
        F.when(refused & ~F.coalesce(may_refuse, F.lit(False)), F.lit("refused"))
        .when(refused, F.lit("pass"))
        .when(F.exists(must, lambda w: ~has(w)), F.lit("missing"))
        .when(F.exists(must_not, lambda w: has(w)), F.lit("forbidden"))
        .otherwise(F.lit("pass"))
    )


def training_rows(pairs: DataFrame, form: str = "contents") -> DataFrame:
    """``pairs`` without prompt and completion and with row, the pair as one JSON text: ``contents``, turns of user and model, or
    ``pair``, the two by their names."""
    if form == "contents":
        turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.array(F.struct(F.col(c).alias("text"))).alias("parts"))
        row = F.to_json(F.struct(F.array(turn("user", "prompt"), turn("model", "completion")).alias("contents")))
    elif form == "pair":
        row = F.to_json(F.struct("prompt", "completion"))
    else:
        raise ValueError(form)
    return pairs.withColumn("row", row).drop("prompt", "completion")


def drop_reasons(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds reason: the first rule that a row breaks; null where it breaks none."""
    chain = F
    for name, broken in rules:
        chain = chain.when(broken, F.lit(name))
    return rows.withColumn("reason", chain)

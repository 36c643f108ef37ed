"""Correction of transcripts: a fixed map of phrases, then words that are none, each to the nearest word of a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators.people import deletions

EDGES = r"^[\p{Punct}‘’“”…–—]+|[\p{Punct}‘’“”…–—]+$"
LEAST = 4


def fixed_map(text: Column, heard: dict[str, tuple[str, ...]]) -> Column:
    """Whole words and phrases that are always misheard, in the map's order, case aside."""
    for canonical, wrongs in heard.items():
        for wrong in wrongs:
            text = F.regexp_replace(text, F.lit(rf"(?iu)(?<!{T.WORD_CHARS})\Q{wrong}\E(?!{T.WORD_CHARS})"), F.lit(canonical.replace("\\", "\\\\").replace("$", "\\$")))
    return text


def bare(word: Column) -> Column:
    """A word without the marks around it."""
    return F.regexp_replace(word, EDGES, "")


def nominated(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, term, d, same): pairs within two edits, or with equal consonants and within three, met through keys of two deletions and skeletons."""
    two = lambda c: F.array_distinct(F.flatten(F.transform(deletions(c), deletions)))
    keys = lambda c: F.concat(F.transform(two(c), lambda k: F.concat(F.lit("d:"), k)), F.array(F.concat(F.lit("s:"), T.skeleton(c))))
    low = F.lower("token")
    x = tokens.select("token").distinct().select("token", F.explode(keys(low)).alias("key"))
    y = vocabulary.select("term").distinct().select("term", F.explode(keys(F.lower("term"))).alias("key"))
    met = x.join(y, "key").select("token", "term").distinct()
    met = met.withColumn("d", F.levenshtein(low, F.lower("term"))).withColumn("same", T.skeleton(F.col("token")) == T.skeleton(F.col("term")))
    return met.filter((F.col("d") <= 2) | (F.col("same") & (F.col("d") <= 3)))


def nearest(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, term): the nearest term - ties to equal consonants, then by spelling - if that is near enough: one edit up to five letters, else
    two, or equal consonants and three."""
    best = nominated(tokens, vocabulary).groupBy("token").agg(F.min(F.struct("d", (~F.col("same")).alias("other"), "term")).alias("m"))
    near = (F.col("m.d") <= F.when(F.length("token") <= 5, 1).otherwise(2)) | ~F.col("m.other")
    return best.filter(near).select("token", F.col("m.term").alias("term"))


def corrected(texts: DataFrame, vocabulary: DataFrame, real: DataFrame, heard: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id, text, changed) of texts (id, text): vocabulary (term) has single words, real (word) those that are words and stay as they are.

    Words are told apart by blanks and put together again in their order; only their different spellings meet the vocabulary, and only
    what changes comes back to its text. Words of up to three letters, canonical ones and those of the vocabulary stay.
    """
    heard = heard or {}
    before = texts.select("id", "text", fixed_map(F.col("text"), heard).alias("fixed"))
    terms = vocabulary.filter(~F.contains("term", F.lit(" "))).select("term").distinct()
    token = before.select("id", F.explode(F.array_distinct(F.transform(F.split("fixed", " "), bare))).alias("token"))
    token = token.filter((F.length("token") >= LEAST) & ~F.col("token").isin(*heard) if heard else F.length("token") >= LEAST)
    known = terms.select(F.lower("term").alias("_w")).unionByName(real.select(F.lower("word").alias("_w"))).distinct()
    odd = token.select("token").distinct().join(known, F.lower("token") == F.col("_w"), "left_anti")
    found = nearest(odd, terms)
    per = token.join(found, "token").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "term"))).alias("terms"))
    both = before.join(per, "id", "left")
    place = lambda w: T.let(bare(w), lambda b: F.when(F.map_contains_key("terms", b), F.replace(w, b, F.element_at("terms", b))).otherwise(w))
    out = F.when(F.col("terms").isNull(), F.col("fixed")).otherwise(F.array_join(F.transform(F.split("fixed", " "), place), " "))
    return both.select("id", out.alias("text"), (~out.eqNullSafe(F.col("text"))).alias("changed"))

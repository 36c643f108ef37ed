"""Claims and their evidence: completeness, existence, citations, gates, build comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T


class IntegrityError(ValueError):
    """A check found rows that it doesn't allow."""


def demand_empty(found: DataFrame, what: str, sample: int = 5) -> None:
    rows = found.limit(sample).collect()
    if rows:
        raise IntegrityError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def unevidenced(claims: dict[str, tuple[DataFrame, str]], evidence: DataFrame) -> DataFrame:
    """(claim_table, claim_id) of claims without an evidence row; claims: table name to (rows, its key column)."""
    parts = []
    for name, (rows, key) in claims.items():
        own = evidence.filter(F.col("claim_table") == name).select(F.col("claim_id").alias(key))
        parts.append(rows.join(own, key, "left_anti").select(F.lit(name).alias("claim_table"), F.col(key).cast("long").alias("claim_id")))
    return reduce(DataFrame.unionByName, parts)


def dangling(evidence: DataFrame, sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Evidence rows whose source row, or source table, isn't there."""
    known = [evidence.filter(F.col("source_table") == n).join(rows.select(F.col(key).alias("source_id")), "source_id", "left_anti").select(evidence.columns) for n, (rows, key) in sources.items()]
    return reduce(DataFrame.unionByName, [*known, evidence.filter(~F.col("source_table").isin(list(sources)))])


def cited_subset(rows: DataFrame, evidence: DataFrame, table: str, key: str) -> DataFrame:
    return rows.join(evidence.filter(F.col("source_table") == table).select(F.col("source_id").alias(key)), key, "left_semi")


def check_citations(claims: DataFrame, shown: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds reason: null where the cited row was shown to the job and holds the quote.

    claims: (job_id, claim_id, source_id, quote); shown: (job_id, source_id); sources: (source_id, text).
    """
    seen = claims.join(shown.select("job_id", "source_id", F.lit(True).alias("_shown")), ["job_id", "source_id"], "left").join(sources, "source_id", "left")
    reason = (
        F.when(F.col("_shown").isNull(), F.lit("id not shown"))
        .when(F.col("text").isNull(), F.lit("no such source"))
        .when(~F.coalesce(T.quote_verified(F.col("text"), F.col("quote")), F.lit(False)), F.lit("quote not in source"))
    )
    return seen.withColumn("reason", reason).drop("_shown", "text")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows of recomputed keys give way to the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over the parts, a zero byte after each."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\x00"))]), 256)


def cache_misses(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Jobs whose fingerprint has no stored success."""
    return jobs.join(cache.filter("payload is not null").select("fingerprint"), "fingerprint", "left_anti")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()])


def shrinkage(now: DataFrame, baseline: DataFrame, limit: float = 0.25) -> DataFrame:
    """(table, rows, baseline, verdict): ok, new, vanished, or shrunk by ``limit`` or more."""
    both = now.select("table", "rows").join(baseline.select("table", F.col("rows").alias("baseline")), "table", "full")
    verdict = (
        F.when(F.col("baseline").isNull(), F.lit("new"))
        .when(F.col("rows").isNull() | ((F.col("rows") == 0) & (F.col("baseline") > 0)), F.lit("vanished"))
        .when(F.col("rows") <= F.col("baseline") * (1 - limit), F.lit("shrunk"))
        .otherwise(F.lit("ok"))
    )
    return both.withColumn("verdict", verdict)


def failure_rate(results: DataFrame, failed: Column, limit: float) -> DataFrame:
    """One row: total, failed, rate, passes."""
    return results.agg(F.count("*").alias("total"), F.count_if(failed).alias("failed")).withColumn("rate", F.round(F.col("failed") / F.greatest(F.col("total"), F.lit(1)), 6)).withColumn("passes", F.col("rate") <= limit)


def contradictions(facts: DataFrame) -> DataFrame:
    """(entity_id, category, earlier, later): of one entity's facts of one category the first, by fact_id, that a later one contradicts
    - exactly one of them negated, on another date - with the first such later one. Sums per date and kind decide; no pairs are made.
    """
    negated = F.exists(F.array(*[F.lit(x) for x in ("no ", "not ", "never ", "zero ", "none")]), lambda n: F.contains(F.lower("fact"), n))
    f = facts.filter("category is not null and asserted_on is not null").select("entity_id", "category", "fact_id", "asserted_on", negated.alias("neg"))
    key = ["entity_id", "category"]
    # the last fact of each kind, and the last on another date than that: a fact has a later opponent unless both come before it
    per_day = f.groupBy(*key, "neg", "asserted_on").agg(F.max("fact_id").alias("last"))
    ends = per_day.groupBy(*key, "neg").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("last", "asserted_on")))), 1, 2).alias("ends"))
    against = f.join(ends.select(*key, (~F.col("neg")).alias("neg"), "ends"), [*key, "neg"])
    open_ = F.exists("ends", lambda e: (e["last"] > F.col("fact_id")) & (e["asserted_on"] != F.col("asserted_on")))
    first = against.filter(open_).groupBy(*key).agg(F.min(F.struct("fact_id", "asserted_on", "neg")).alias("a"))
    met = f.join(first, key).filter((F.col("fact_id") > F.col("a.fact_id")) & (F.col("neg") != F.col("a.neg")) & (F.col("asserted_on") != F.col("a.asserted_on")))
    pair = met.groupBy(*key).agg(F.min(F.struct("fact_id", "asserted_on")).alias("b"), F.first("a").alias("a"))
    older = F.col("a.asserted_on") < F.col("b.asserted_on")
    return pair.select(*key, F.when(older, F.col("a.fact_id")).otherwise(F.col("b.fact_id")).alias("earlier"), F.when(older, F.col("b.fact_id")).otherwise(F.col("a.fact_id")).alias("later"))


def counted_strength(rows: DataFrame, *key: str) -> DataFrame:
    """mentioned, moderate or strong by distinct verified sources: 1, 2, 3 or more."""
    n = F.countDistinct("source_id").alias("sources")
    return rows.groupBy(*key).agg(n).withColumn("strength", F.when(F.col("sources") >= 3, "strong").when(F.col("sources") == 2, "moderate").otherwise("mentioned"))


def jobs(rows: DataFrame, job: str, line: Column, row_id: str, *order: str) -> DataFrame:
    """(job, prompt, shown): the rendered lines of each job in order and the exact ids it shows."""
    packed = rows.select(job, F.struct(*[F.col(c) for c in order], F.col(row_id).alias("_id"), line.alias("_line")).alias("r"))
    return packed.groupBy(job).agg(F.sort_array(F.collect_list("r")).alias("rs")).select(job, F.array_join(F.col("rs._line"), "\n").alias("prompt"), F.col("rs._id").alias("shown"))


def with_author(rows: DataFrame, people: DataFrame, unknown: str = "?") -> DataFrame:
    """``rows`` (person_id, ...) with author: the name in ``people`` (person_id, name); rows of nobody known stay, under ``unknown``."""
    return rows.join(people.select("person_id", F.col("name").alias("author")), "person_id", "left").withColumn("author", F.coalesce("author", F.lit(unknown)))


def yearly_counts(appearances: DataFrame, what: str = "people came") -> tuple[DataFrame, DataFrame]:
    """(year, people, fact), one for each year, and its evidence (claim_id, source_id): every row counted of appearances (row_id, year, person, status).

    A person counts once a year, however many rows say so; all of them are cited, as rows and not in one list.
    """
    came = appearances.filter("status = 'attending' and year is not null and person is not null")
    counts = came.groupBy("year").agg(F.countDistinct("person").alias("people"))
    facts = counts.withColumn("fact", F.concat(F.col("people").cast("string"), F.lit(f" {what} in "), F.col("year").cast("string")))
    return facts, came.select(F.col("year").cast("long").alias("claim_id"), F.col("row_id").alias("source_id")).distinct()


def cited_or_fail(cited: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of ``rows`` that ``cited`` (source_id) names; raises, with some of the ids, where any isn't there."""
    wanted = cited.select("source_id").distinct()
    lost = [r["source_id"] for r in wanted.join(rows.select(F.col(key).alias("source_id")), "source_id", "left_anti").orderBy("source_id").limit(10).collect()]
    if lost:
        raise ValueError(f"cited rows are missing: {lost}")
    return rows.join(wanted.select(F.col("source_id").alias(key)), key, "left_semi")

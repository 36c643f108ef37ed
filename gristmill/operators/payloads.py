"""Payloads of JSON text against schemas kept as data: what parses leaves as columns, what doesn't is kept apart with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_RAW = "_corrupt"

#: Schemas of structured answers, by kind of claim: nested lists of records, as DDL. What must be there is told apart below.
SCHEMAS = {
    "entities": "entities array<struct<name string, kind string, aliases array<string>, source_id bigint, quote string>>",
    "entity_record": "summary string, facts array<struct<category string, fact string, asserted_on string, source_ids array<bigint>, quote string>>",
    "document_facts": "facts array<struct<topic string, category string, fact string, year int, ask_words array<string>, quote string>>",
    "profile": "summary string, known_for string, source_ids array<bigint>, expertise array<struct<topic string, strength string, source_ids array<bigint>>>",
    "stories": "stories array<struct<title string, story string, year int, people array<string>, source_ids array<bigint>>>",
    "click": "k bigint, device struct<os string, ver string>, tags array<string>, items array<struct<sku bigint, qty int>>",
}
REQUIRED = {
    "entities": ("entities",), "entity_record": ("summary", "facts"), "document_facts": ("facts",),
    "profile": ("summary", "expertise"), "stories": ("stories",), "click": ("k",),
}


def parsed(rows: DataFrame, column: str, kind: str, schema: str | None = None, required: tuple[str, ...] | None = None) -> DataFrame:
    """``rows`` with payload, a struct, and reason: null where the payload can be used.

    ``missing``: null or blank; ``broken``: no JSON object, or of other types than the schema's; ``incomplete``: a required field is absent or
    null. The payload of a row with a reason is null: a part of an answer isn't one.
    """
    fields = StructType.fromDDL(schema or SCHEMAS[kind])
    required = REQUIRED.get(kind, ()) if required is None else required
    raw = F.col(column)
    got = F.from_json(raw, StructType([*fields, StructField(_RAW, StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW})
    out = rows.withColumn("_p", got)
    lacking = [F.col(f"_p.`{f}`").isNull() for f in required]
    incomplete = F.lit(False)
    for x in lacking:
        incomplete = incomplete | x
    reason = F.when(raw.isNull() | (F.trim(raw) == ""), "missing").when(F.col("_p").isNull() | F.col(f"_p.{_RAW}").isNotNull(), "broken").when(incomplete, "incomplete")
    out = out.withColumn("reason", reason)
    whole = F.struct(*[F.col(f"_p.`{f.name}`").alias(f.name) for f in fields])
    return out.withColumn("payload", F.when(F.col("reason").isNull(), whole)).drop("_p")


def kept(parsed_rows: DataFrame) -> DataFrame:
    return parsed_rows.filter("reason is null").drop("reason")


def broken(parsed_rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """The rows apart: what came, whole, and why it wasn't used."""
    return parsed_rows.filter("reason is not null").select(*keep, column, "reason")


def counts(parsed_rows: DataFrame) -> DataFrame:
    """(outcome, n), one row for each outcome that occurs: kept or the reason."""
    return parsed_rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


def encoded(payload: Column) -> Column:
    """The text of a payload, fields that are null left out."""
    return F.to_json(payload)


def by_job(results: DataFrame, jobs: DataFrame, kind: str) -> DataFrame:
    """(job_id, payload, reason) of every job of ``jobs``, whatever came back: results (job_id, response, error); an error or no answer is
    ``failed``, and nothing disappears."""
    answered = parsed(results.filter("error is null and response is not null"), "response", kind).select("job_id", "payload", "reason")
    one = answered.groupBy("job_id").agg(F.min_by(F.struct("payload", "reason"), F.col("reason").isNotNull()).alias("r")).select("job_id", "r.*")
    joined = jobs.select("job_id").join(one.withColumn("_came", F.lit(True)), "job_id", "left")
    return joined.select("job_id", "payload", F.when(F.col("_came").isNull(), "failed").otherwise(F.col("reason")).alias("reason"))

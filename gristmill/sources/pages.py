"""Saved pages, event listings, documents, journals and blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T

LISTING = "events array<struct<title:string,camp:string,address:string,tags:array<string>,about:string>>, days array<struct<name:string,date:string,slots:array<struct<e:int,at:string,to:string>>>>"


def read_wrapped_json(spark: SparkSession, path: str, schema: str, encoding: str = "utf-8") -> DataFrame:
    """JSON from the first brace to the last of each file, whatever script is wrapped around it."""
    raw = spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("t"))
    body = F.regexp_extract("t", r"(?s)(\{.*\})", 1)
    return raw.select(F.from_json(body, schema).alias("j")).select("j.*")


def tables_in(pages: DataFrame) -> DataFrame:
    """(page_id, row, col, cell): cells of HTML tables, tags stripped, entities read."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cells = rows.select("page_id", "row", F.posexplode(F.regexp_extract_all("tr", F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("col", "raw"))
    return cells.select("page_id", "row", "col", T.unescape_html(F.regexp_replace("raw", "<[^>]+>", " ")).alias("cell"))


def occurrences(listing: DataFrame) -> DataFrame:
    """(event, title, camp, tags, date, at, to, haystack) from one listing: slots point at events by place.

    Exact repeats go; an untimed slot goes where its event has a timed one on that date; undated ones come last.
    """
    events = listing.select(F.posexplode("events").alias("event", "v")).select("event", "v.*")
    slots = listing.select(F.explode("days").alias("d")).select("d.date", F.explode("d.slots").alias("s")).select("date", F.col("s.e").alias("event"), F.coalesce("s.at", F.lit("")).alias("at"), F.coalesce("s.to", F.lit("")).alias("to")).distinct()
    timed = F.max(F.col("at") != "").over(Window.partitionBy("event", "date"))
    kept = slots.withColumn("_timed", timed).filter(~F.col("_timed") | (F.col("at") != "")).drop("_timed")
    hay = F.lower(F.concat_ws(" ", "title", "camp", "about", F.array_join("tags", " ")))
    return events.select("event", T.undouble(F.col("title")).alias("title"), "camp", "tags", hay.alias("haystack")).join(kept, "event").withColumn("last", F.col("date") == "")


def listing_days(slots: DataFrame) -> DataFrame:
    """(date, slots): each day's slots in order of time."""
    return slots.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("at", "event", "to"))).alias("slots"))


def opening_day(days: DataFrame, today: str, least: int = 10) -> DataFrame:
    """One row: today if it is listed, else the first day with ``least`` slots, else the first."""
    d = days.withColumn("n", F.size("slots")).filter("date <> ''")
    order = F.when(F.col("date") == today, 0).when(F.col("n") >= least, 1).otherwise(2)
    return d.agg(F.min_by("date", F.struct(order, "date")).alias("date"))


def opening_hour(days: DataFrame, today: str, hour: int) -> DataFrame:
    """One row: the hour to open the day at where today is listed, else null - then a day opens from its top."""
    listed = F.max(F.when((F.col("date") == today) & (F.size("slots") > 0), True).otherwise(False))
    return days.agg(F.when(F.coalesce(listed, F.lit(False)), F.lit(f"{hour:02d}:00")).alias("hour"))


def with_descriptions(items: DataFrame, about: DataFrame) -> DataFrame:
    """Items (name, about) with the fuller text of a second list where it has one; the first of each name, case aside."""
    fuller = about.groupBy(F.lower("name").alias("k")).agg(F.first("about", ignorenulls=True).alias("more"))
    out = items.withColumn("k", F.lower("name")).join(fuller, "k", "left").withColumn("about", F.coalesce("more", "about"))
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy("place"))).filter("_n = 1").drop("_n", "k", "more")


def markdown(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """(file, text): three or more newlines become two; short files go."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace(F.regexp_replace("value", "\n{3,}", "\n\n"), r"^\s+|\s+$", "").alias("text"))
    return raw.filter(F.length("text") >= least)


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, n, heading, body): Markdown lines grouped under the heading above them."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.col("line").rlike(r"^#{1,6} ")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = lines.withColumn("n", F.sum(head.cast("int")).over(w).cast("long"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return g.groupBy("doc_id", "n").agg(F.max(F.when(head, F.regexp_replace("line", r"^#+ +|\s*\{#[^}]*\}$", ""))).alias("heading"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))


def docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): paragraphs of Word files as Markdown; headings by style."""
    import io
    import re
    import zipfile

    from gristmill.functions.workers import importable

    importable(spark)

    def of(batches):
        import pandas as pd

        for b in batches:
            out = []
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    xml = z.read("word/document.xml").decode("utf-8")
                lines = []
                for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S):
                    words = "".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p))
                    level = re.search(r'<w:pStyle w:val="Heading(\d)"', p)
                    item = "<w:numPr>" in p
                    if words.strip():
                        lines.append("#" * int(level[1]) + " " + words if level else "- " + words if item else words)
                out.append("\n\n".join(lines))
            yield pd.DataFrame({"path": b["path"], "text": out})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(of, "path string, text string")


def journal(files: DataFrame) -> DataFrame:
    """(source, n, question, facts, answer, model) from (source, text): blocks between rules; the model's name carries on."""
    blocks = files.select("source", F.posexplode(F.split("text", "\n----\n")).alias("n", "block"))
    part = lambda p: F.nullif(F.trim(F.regexp_extract("block", p, 1)), F.lit(""))
    t = blocks.select(
        "source",
        "n",
        part("QUESTION: (.+)").alias("question"),
        F.coalesce(part(r"(?s)FACTS GIVEN:\n(.*?)(?=\n\[|\nANSWERED:)"), part(r"(?s)EMPTY-HANDED, COLOUR GIVEN:\n(.*?)(?=\n\[|\nANSWERED:)")).alias("facts"),
        part(r"(?s)ANSWERED:\n(.*)").alias("answer"),
        part("MODEL: (.+)").alias("model"),
    )
    w = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.withColumn("model", F.last("model", ignorenulls=True).over(w)).filter("question is not null and facts is not null and answer is not null")


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, length, content): each content once, whatever its names."""
    b = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), "length", "content")
    return b.dropDuplicates(["sha256"])


def constants(spark: SparkSession, rows: list[tuple[str, str]], source: str) -> DataFrame:
    """(topic, fact, source): background facts that ship with the engine."""
    return spark.createDataFrame(rows, "topic string, fact string").withColumn("source", F.lit(source))

"""Chat exports: messages from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed patterns of the export format: a header line, an attachment, a media placeholder, bidirectional marks.
HEADER = r"^[‎‏]*\[(\d{1,2}/\d{1,2}/\d{2,4}),\s+(\d{1,2}:\d{2}:\d{2}\s*[AP]M)\]\s+([^:]+):\s*(.*)$"
ATTACHED = r"<attached:\s*([^>]+)>"
OMITTED = r"[‎‏]?\b(?:image|video|audio|sticker|GIF|document|Contact card) omitted\b"
MARKS = r"‎‏‪-‮⁦-⁩"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): one row per file, named after it."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(?:.*/)?([^/]*?)(?:\.[^.]*)?$", 1)
    return files.select(name.alias("source"), F.col("value").alias("text"))


def unzip(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of every text member of zip archives; each archive is one row, unpacked where it was read."""
    import io
    import zipfile

    from gristmill.functions.workers import importable

    importable(spark)

    def of(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        if member.endswith(".txt"):
                            rows.append((name.rsplit("/", 1)[-1].removesuffix(".zip"), z.read(member).decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["source", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(of, "source string, text string")


def messages(files: DataFrame) -> DataFrame:
    """(source, n, sender, ts, body) from (source, text): a header starts a message, other lines continue it.

    Two-digit years first, then four. Lines before the first header are dropped. Within one file only.
    """
    lines = files.select("source", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("pos", "line"))
    head = F.col("line").rlike(HEADER)
    w = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = lines.withColumn("head", head).withColumn("n", F.sum(head.cast("int")).over(w)).filter("n > 0")
    part = lambda k: F.regexp_extract("line", HEADER, k)
    text = F.struct("pos", F.when(F.col("head"), part(4)).otherwise(F.col("line")).alias("t"))
    whole = cut.groupBy("source", "n").agg(
        F.max(F.when(F.col("head"), F.trim(part(3)))).alias("sender"),
        F.max(F.when(F.col("head"), F.concat(part(1), F.lit(" "), F.regexp_replace(part(2), r"\s*([AP]M)$", " $1")))).alias("stamp"),
        F.array_sort(F.collect_list(text)).alias("ts"),
    )
    stamp = F.coalesce(*[F.call_function("try_to_timestamp", F.col("stamp"), F.lit(f)) for f in ("M/d/yy h:mm:ss a", "M/d/yyyy h:mm:ss a")])
    return whole.select("source", F.col("n").cast("long").alias("n"), "sender", stamp.alias("ts"), F.array_join(F.col("ts.t"), "\n").alias("body"))


def classify(raw: DataFrame) -> DataFrame:
    """Messages without notices and empties: adds media_ref; a body that opens with a mark is a notice unless a file is attached."""
    ref = F.nullif(F.trim(F.regexp_extract("body", ATTACHED, 1)), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace("body", ATTACHED, ""), OMITTED, "")
    clean = F.trim(F.regexp_replace(rest, rf"^[{MARKS}\s]+|[{MARKS}\s]+$", ""))
    notice = F.regexp_replace(rest, r"^\s+", "").rlike(rf"^[{MARKS}]")
    return raw.withColumn("media_ref", ref).withColumn("_notice", notice).withColumn("body", clean).filter(F.col("media_ref").isNotNull() | (~F.col("_notice") & (F.col("body") != ""))).drop("_notice")


def senders(msgs: DataFrame) -> DataFrame:
    """(sender, messages, first_seen, last_seen): first is the first in file order, last the latest in time."""
    return msgs.groupBy("sender").agg(F.count("*").alias("messages"), F.min_by("ts", F.struct("source", "n")).alias("first_seen"), F.max("ts").alias("last_seen"))


def drop_rate(raw_lines: int, kept: int, limit: float = 0.09) -> float:
    """The share of raw lines that gave no message; beyond ``limit`` it raises."""
    rate = 1 - kept / max(raw_lines, 1)
    if rate > limit:
        raise ValueError(f"{rate:.1%} of lines dropped; {limit:.0%} at most")
    return rate


def mentions(msgs: DataFrame, name: str) -> DataFrame:
    """Messages by others that hold the name, its first word, or it without spaces, case aside."""
    forms = {name.lower(), name.split()[0].lower(), name.replace(" ", "").lower()}
    low = F.lower("body")
    return msgs.filter((F.col("sender") != name) & F.exists(F.array(*[F.lit(f) for f in sorted(forms)]), lambda f: F.contains(low, f)))

"""Line deduplication: range-partitioned hashes, first occurrences, compressed keep bitmaps.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.
Keys of ``min_chars`` code points or more that are found in ``min_docs``
documents or more lose all their lines, except in the largest doc_id that
holds them. Everything is DataFrame expressions.

1. Texts are split and hashed once: each line whose key counts becomes a row of
   hashes, document and position in a table in the shared folder; the first line
   of a key in its document is marked.
2. Marked rows are summed per (hash, salt) with map-side combine, so that a line
   found in a third of all documents reaches the range exchange as ``SALTS``
   rows at most. Those partial sums are range-partitioned by hash, with a
   secondary sort by document, largest first, and position: the first row of a
   hash, in stream order, is the occurrence that stays; a running sum over the
   same order gives the count of documents. One row per repeated hash is left.
3. Line rows meet those keys; a line goes where its document isn't the one that
   stays. Keys that hold more than one in ``SHARE`` of all line rows, ``SHARE``
   keys at most, are broadcast, so that no task gets all rows of a frequent line;
   the others meet by hash. Per document the positions become a sparse bitmap:
   64-bit words, the zero ones left out.
4. ``apply_bitmaps`` cuts texts by their bitmaps.

Defined results: a null or empty text is one empty line and keeps it; a line
that repeats inside one document counts that document once and its lines fall
or stay together; every row counts as a document, and rows that share a doc_id
share its rank (all of them hold the largest id or none does), while their
bitmaps are told apart by a hash of the text; an empty table gives an empty
table; extra columns pass through ``apply_bitmaps`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import let
from gristmill.llm.common import SPACE, ascii_lower, materialise

SALTS = 64
SHARE = 1000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, text_key, h1, h2, at, marked): one row per line whose key counts, with 128 bits of the key; the first of a key in its text is marked."""

    def hashed(line: Column, at: Column) -> Column:
        row = lambda key: F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), at.alias("at"))
        return let(F.trim(line, F.lit(SPACE)), lambda bare: F.when(F.length(bare) >= min_chars, let(ascii_lower(bare), row)))

    def mark(rows: Column) -> Column:
        before = lambda k: F.get(rows, k - 1)  # noqa: E731  null for the first
        new = lambda x, k: ~(x["h1"].eqNullSafe(before(k)["h1"]) & x["h2"].eqNullSafe(before(k)["h2"]))
        return F.transform(rows, lambda x, k: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["at"].alias("at"), new(x, k).alias("marked")))

    found = F.filter(F.transform(_lines(F.col("text")), hashed), lambda h: h.isNotNull())
    per = docs.select("doc_id", F.xxhash64("text").alias("text_key"), let(F.sort_array(found), mark).alias("lines"))  # before the explode: the text isn't hashed per line
    return per.select("doc_id", "text_key", F.explode("lines").alias("l")).select("doc_id", "text_key", "l.*")


def repeated_keys(rows: DataFrame, min_docs: int = 3) -> DataFrame:
    """(h1, h2, stays, docs): one row per key found in ``min_docs`` documents, with the largest doc_id that holds it."""
    place = F.struct("doc_id", (-F.col("at")).alias("back"))
    sums = rows.filter("marked").groupBy("h1", "h2", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.max(place).alias("first"), F.count("*").alias("n"))
    ranged = sums.repartitionByRange(F.col("h1"), F.col("h2"))
    stream = Window.partitionBy("h1", "h2").orderBy(F.desc("first"), "salt")
    whole = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        ranged.select("h1", "h2", F.col("first.doc_id").alias("stays"), F.row_number().over(stream).alias("nth"), F.sum("n").over(whole).alias("docs"))
        .filter((F.col("nth") == 1) & (F.col("docs") >= min_docs))
        .drop("nth")
    )


def keep_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """(doc_id, text_key, bitmap): for each document that loses lines, a bit per lost line in sparse 64-bit words."""
    rows = materialise(line_rows(docs, min_chars))
    keys = materialise(repeated_keys(rows, min_docs))
    often = F.col("docs") * SHARE > rows.count()
    hot, rest = F.broadcast(keys.filter(often).drop("docs")), keys.filter(~often).drop("docs")  # docs add up to all rows at most
    at = rows.drop("marked")
    met = at.join(hot, ["h1", "h2"]).unionByName(at.join(hot, ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"]))
    lost = met.filter(F.col("doc_id") < F.col("stays"))
    words = (
        lost.groupBy("doc_id", "text_key", (F.col("at") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 64)).alias("bits"))
    )
    return words.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with n_lines and n_dropped, its texts without the lines whose bits are set."""
    names = docs.columns
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", F.xxhash64("text").alias("text_key"))
    joined = left.join(bitmaps, ["doc_id", "text_key"], "left")
    lines = _lines(F.col("row.text"))
    sparse = F.map_from_entries(F.col("bitmap"))
    last = F.element_at("bitmap", -1)["word"]
    dense = F.when(F.col("bitmap").isNotNull(), F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(sparse[w], F.lit(0).cast("long"))))
    cut = joined.select("row", lines.alias("lines"), dense.alias("dense"))
    bit = lambda i: F.call_function("shiftright", F.coalesce(F.get("dense", (i / 64).cast("int")), F.lit(0).cast("long")), i % 64).bitwiseAND(F.lit(1).cast("long"))
    kept = F.when(F.col("dense").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: bit(i) == 0))
    done = cut.withColumn("kept", kept)
    text = F.array_join("kept", "\n")
    return done.select(
        *[(text if c == "text" else F.col("row")[c]).alias(c) for c in names],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` without repeated lines, with n_lines and n_dropped."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars))


def op6_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, u.i AS pos, u.line AS line,
         translate(trim(u.line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
       LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) AS i) u),
r AS (SELECT k, max(doc_id) AS stays FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT l.*, r.k IS NOT NULL AND l.doc_id < r.stays AS dropped FROM l LEFT JOIN r USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

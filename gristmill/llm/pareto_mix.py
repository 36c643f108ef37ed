"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words: its weight's share of all words, at most ``max_repeat`` times the source's own words, the
excess shared again by weight. The whole copies that all of a source's documents are due are allocated for certain. The words
then left are drawn, one more copy of a document at most, with probabilities that rise with the square root of its size class
(powers of two): long documents fill a target with fewer cuts, short ones still have their chance. Per source the scale is the
one at which the expected words are the words left; classes whose probability would pass 1 are allocated for certain, and the
scale is that of the others.

Documents are ranked by their random odds over their inclusion odds, (u / (1 - u)) / (p / (1 - p)), u a pseudo-random number
of the document (md5 of seed, doc_id and text, so reruns agree on any layout), and taken in that order until the words left
are spent: a fixed-size sample with size counted in words, off by half the document at the cut at most.

Ranks are never sorted as a whole: the rank r as 48 bits of r / (1 + r) falls into ``BINS`` bins, whose sums per source are
small; the bin that holds the cut is opened again into ``BINS`` bins, ``LEVELS`` times, and only the documents in the last bin
are put in order. The hottest source costs no more than any other. ``mix`` decides by the rows' places in their files, so no
text is shuffled while those decisions are small enough to be broadcast.

Defined results: null texts have size 0; documents of size 0 take whole copies only (0 words in any case); a null source is one
source, last in order; a null doc_id is one like any other; rows repeated exactly are told apart by a counter among them, each
with a u of its own; ties in rank go by u, doc_id, then place; an empty table gives an empty one; extra columns don't disturb
(``mix`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import chosen_rows, materialise, rows_with_ids, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3.0
BINS = 256
LEVELS = 3
SALTS = 64
SEED = "mix"
_TOP = 1 << 48


def _bits48(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def uniform(seed: str) -> Column:
    """A 48-bit integer of the document's id and text."""
    return _bits48(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target): shares by weight, capped; the level of the caps in closed form over the sources.

    A source's cap over its weight is where the common level stops lifting it. In ascending order of that
    ratio, the first k are capped if the level left for the others reaches beyond them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_repeat).withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    all_ = Window.partitionBy(F.lit(0))
    s = (
        s.withColumn("total", F.sum("source_size").over(all_))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_from", F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("w_from"))
    )
    # the first source, in that order, that its level doesn't lift above its cap sets the level of all after it
    s = s.withColumn("nth", F.row_number().over(up))
    s = s.withColumn("common", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(all_)["level"])
    target = F.when(F.col("common").isNull() | (F.col("ratio") < F.col("common")), F.col("cap")).otherwise(F.col("common") * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def size_class(size: Column) -> Column:
    """floor(log2(size)), -1 for 0."""
    return F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(-1)


def inclusion(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """(id, cls, sure, p): per source and size class one more copy for certain, or the probability of it. per: (id, left)."""
    words = sizes.groupBy("id", size_class(F.col("size")).alias("cls")).agg(F.sum("size").alias("words")).filter("cls >= 0")
    measure = F.sqrt(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cls")).cast("double"))
    down = Window.partitionBy("id").orderBy(F.desc("cls"))
    c = words.join(per.select("id", "left"), "id").withColumn("m", measure)
    c = c.withColumn("before", F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("from", F.sum(F.col("words") * F.col("m")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    c = c.withColumn("scale", (F.col("left") - F.col("before")) / F.col("from"))
    # from the largest class down, the first that its scale doesn't lift above 1 sets the scale of all below it
    first = F.max(F.when(F.col("scale") * F.col("m") <= 1, F.struct("cls", "scale"))).over(Window.partitionBy("id"))
    sure = first.isNull() | (F.col("cls") > first["cls"])
    return c.select("id", "cls", "words", sure.alias("sure"), F.when(sure, 0.0).otherwise(F.greatest(first["scale"] * F.col("m"), F.lit(0.0))).alias("p"))


def _told_apart(sizes: DataFrame) -> DataFrame:
    """``sizes`` with a u of its own for each of several equal rows: numbered by place, in ``SALTS`` parts whose counts are summed up."""
    key = F.xxhash64("doc_id", "id", "u").alias("k")
    repeated = materialise(sizes.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select("k"))
    if repeated.isEmpty():
        return sizes
    salt = F.pmod(F.hash("_file", "_place"), F.lit(SALTS)).alias("salt")
    some = sizes.select("_file", "_place", key, salt).join(repeated, "k", "left_semi")
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("k", "salt").orderBy("_file", "_place")))
    parts = some.groupBy("k", "salt").agg(F.count("*").alias("size"))
    parts = parts.select("k", "salt", F.coalesce(F.sum("size").over(Window.partitionBy("k").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("upto"))
    nth = some.join(parts, ["k", "salt"]).select("_file", "_place", (F.col("upto") + F.col("n") - 1).alias("nth"))
    again = _bits48(F.concat_ws(":", F.col("u").cast("string"), F.col("nth").cast("string")))
    return materialise(sizes.join(nth, ["_file", "_place"], "left").withColumn("u", F.when(F.col("nth") > 0, again).otherwise(F.col("u"))).drop("nth"))


def draws(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """(_file, _place, doc_id, source, size, source_size, target, copies), one row per row of ``rows_with_ids``."""
    flat = rows.select("_file", "_place", "_row.doc_id", "_row.source", "_row.text")
    id_ = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("id")
    sizes = _told_apart(materialise(flat.select("_file", "_place", "doc_id", "source", id_, uniform(seed).alias("u"), word_count(F.col("text")).alias("size"))))
    per = targets(sizes, weights, max_repeat)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("whole", F.floor(rate + 1e-12))
    per = materialise(per.withColumn("left", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))).withColumn("id", id_).drop("source"))
    few = per.count() <= 100_000
    small = lambda df: F.broadcast(df) if few else df  # noqa: E731  a row per source, or up to 63 per source and class
    classes = materialise(inclusion(sizes, per))
    x = (F.col("u") + 0.5) / float(_TOP)
    mine, others = x * (1 - F.col("p")), (1 - x) * F.col("p")
    rank = F.least(F.floor(mine / (mine + others) * float(_TOP)), F.lit(_TOP - 1))  # r / (1 + r), r the random odds over the inclusion odds
    ranked = sizes.withColumn("cls", size_class(F.col("size"))).join(small(classes.select("id", "cls", "sure", "p")), ["id", "cls"], "left")
    ranked = ranked.withColumn("rank", F.when(F.col("p") > 0, rank))
    drawn = ranked.filter("rank is not null").select("id", "doc_id", "u", "size", "rank", "_file", "_place")

    sure = classes.filter("sure").groupBy("id").agg(F.sum("words").alias("sure_words"))
    left = per.join(sure, "id", "left").select("id", (F.col("left") - F.coalesce("sure_words", F.lit(0))).alias("left"))
    cut = left.withColumn("prefix", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        shift = 48 - 8 * level
        bin_ = F.shiftright("rank", shift)
        inside = drawn if level == 1 else drawn.join(small(cut.select("id", "prefix")), (drawn["id"] == cut["id"]) & (F.shiftright("rank", shift + 8) == cut["prefix"])).select(drawn["*"])
        sums = inside.groupBy("id", bin_.alias("prefix")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("id").orderBy("prefix")
        sums = sums.join(cut.select("id", "left"), "id").withColumn("upto", F.sum("words").over(run))
        # the first bin whose running sum goes beyond what is left; where none does, all bins are taken
        cut = materialise(
            sums.filter(F.col("upto") > F.col("left"))
            .groupBy("id")
            .agg(F.min_by(F.struct("prefix", (F.col("left") - F.col("upto") + F.col("words")).alias("left")), "prefix").alias("b"))
            .select("id", F.col("b.prefix").alias("prefix"), F.col("b.left").alias("left"))
        )
    shift = 48 - 8 * LEVELS
    order = ("rank", "u", "doc_id", "_file", "_place")
    last = drawn.join(small(cut), (drawn["id"] == cut["id"]) & (F.shiftright("rank", shift) == cut["prefix"])).select(drawn["*"], cut["left"])
    last = last.withColumn("upto", F.sum("size").over(Window.partitionBy("id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # up to the cut, and the document across it if that ends nearer the target
    edge = last.filter((F.col("upto") - F.col("left")) <= F.col("size") / 2.0).groupBy("id").agg(F.max(F.struct(*order)).alias("edge"))
    ends = per.select("id", "source_size", "target", "whole").join(cut.select("id", "prefix"), "id", "left").join(edge, "id", "left")
    more = (
        F.when(F.coalesce("sure", F.lit(False)), F.lit(True))
        .when(F.col("rank").isNull(), F.lit(False))
        .when(F.col("prefix").isNull() | (F.shiftright("rank", shift) < F.col("prefix")), F.lit(True))
        .when(F.shiftright("rank", shift) > F.col("prefix"), F.lit(False))
        .otherwise(F.coalesce(F.struct(*order) <= F.col("edge"), F.lit(False)))
    )
    return ranked.join(small(ends), "id").select("_file", "_place", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + more.cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """``docs`` mixed: every row as many times as it is drawn, all columns kept."""
    rows = rows_with_ids(docs)
    times = draws(rows, weights, max_repeat, seed).select("_file", "_place", F.col("copies").cast("byte").alias("_times"))
    out = chosen_rows(rows, times)
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_n")).select("_row.*")


def op10_pareto_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return draws(rows_with_ids(docs)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP10_SQL = r"""
WITH e AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS u0,
         row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS nth
  FROM documents),
d AS (SELECT doc_id, source, size, CASE WHEN size > 0 THEN length(bin(size)) - 1 ELSE -1 END AS cls,
             CASE WHEN nth = 0 THEN u0 ELSE ('0x' || substr(md5(u0 || ':' || nth), 1, 12))::BIGINT END AS u FROM e),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w,
             source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM p),
r AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
             row_number() OVER (ORDER BY ratio, source NULLS LAST) AS nth FROM r),
c AS (SELECT *, arg_min(level, nth) FILTER (WHERE level <= ratio) OVER () AS common FROM l),
t AS (SELECT source, source_size, CASE WHEN common IS NULL OR ratio < common THEN cap ELSE common * w END AS target FROM c),
g AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12) AS whole FROM t),
k AS (SELECT *, greatest(target - whole * source_size, 0) AS room FROM g),
s AS (SELECT d.source, cls, sum(size)::BIGINT AS words, any_value(room) AS room, sqrt((1::BIGINT << cls)::DOUBLE) AS m
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source WHERE cls >= 0 GROUP BY d.source, cls),
x AS (SELECT *, (room - coalesce(sum(words) OVER (PARTITION BY source ORDER BY cls DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(words * m) OVER (PARTITION BY source ORDER BY cls DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM s),
y AS (SELECT *, max(cls) FILTER (WHERE scale * m <= 1) OVER (PARTITION BY source) AS lead,
             arg_max(scale, cls) FILTER (WHERE scale * m <= 1) OVER (PARTITION BY source) AS best FROM x),
z AS (SELECT source, cls, words, lead IS NULL OR cls > lead AS sure, CASE WHEN lead IS NULL OR cls > lead THEN 0 ELSE greatest(best * m, 0) END AS p FROM y),
n AS (SELECT k.*, room - coalesce((SELECT sum(words) FROM z WHERE sure AND z.source IS NOT DISTINCT FROM k.source), 0) AS room2 FROM k),
o AS (SELECT d.*, coalesce(z.sure, false) AS sure, z.p AS p, n.source_size, n.target, n.whole, n.room2, (d.u + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS q
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN z ON d.source IS NOT DISTINCT FROM z.source AND d.cls = z.cls),
v AS (SELECT *, CASE WHEN p > 0 THEN least(floor(q * (1 - p) / (q * (1 - p) + (1 - q) * p) * 281474976710656.0::DOUBLE), 281474976710655) END AS rank FROM o),
a AS (SELECT *, sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, u, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM v)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       ((whole + CASE WHEN sure OR rank IS NOT NULL AND (upto <= room2 OR upto - room2 <= size / 2.0) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM a
"""

"""Ordered data: sessions, merged windows, chunks, caps, runs, budgets, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.shared import written


def sessions(rows: DataFrame, key: str, ts: str, tie: str, gap: str = "90 minutes", cap: int = 30) -> DataFrame:
    """Adds session and part: a new session after a longer gap or a missing time; parts of ``cap`` rows at most."""
    w = Window.partitionBy(key).orderBy(F.col(ts).asc_nulls_last(), tie)
    before = F.lag(ts).over(w)
    new = before.isNull() | F.col(ts).isNull() | (F.col(ts) > before + F.expr(f"interval {gap}"))
    marked = rows.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w).cast("long"))
    n = F.row_number().over(Window.partitionBy(key, "session").orderBy(F.col(ts).asc_nulls_last(), tie))
    return marked.withColumn("part", F.floor((n - 1) / cap).cast("long")).drop("_new")


def kept_sessions(rows: DataFrame, key: str, text: str | None = None, min_rows: int = 4, min_words: int = 0) -> DataFrame:
    """(key, session, part, rows, words) of the parts with enough rows and words."""
    n_words = F.sum(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))) if text else F.lit(0)
    return rows.groupBy(key, "session", "part").agg(F.count("*").alias("rows"), n_words.cast("long").alias("words")).filter((F.col("rows") >= min_rows) & (F.col("words") >= min_words))


def month_windows(rows: DataFrame, key: str, ts: str, floor: int = 150) -> DataFrame:
    """(key, first_month, last_month, rows): months merged forward until ``floor`` rows; a thin tail joins the window before it.

    Only monthly counts are folded: one short array per key.
    """
    counts = rows.groupBy(key, F.date_format(F.date_trunc("month", ts), "yyyy-MM").alias("m")).agg(F.count("*").alias("n"))
    folded = counts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("m", "n"))).alias("months"))
    one = "struct<first:string,last:string,n:bigint>"

    def step(acc, x):
        grown = F.struct(F.coalesce(acc["open"]["first"], x["m"]).alias("first"), x["m"].alias("last"), (F.coalesce(acc["open"]["n"], F.lit(0).cast("long")) + x["n"]).alias("n"))
        full = grown["n"] >= floor
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.lit(None).cast(one)).otherwise(grown).alias("open"),
        )

    def close(acc):
        last = F.element_at(acc["done"], -1)
        joined = F.struct(last["first"].alias("first"), acc["open"]["last"].alias("last"), (last["n"] + acc["open"]["n"]).alias("n"))
        rest = F.slice(acc["done"], F.lit(1), F.greatest(F.size(acc["done"]) - 1, F.lit(0)))
        return F.when(acc["open"].isNull(), acc["done"]).when(F.size(acc["done"]) == 0, F.array(acc["open"])).otherwise(F.concat(rest, F.array(joined)))

    start = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("open"))
    return folded.select(key, F.explode(F.aggregate("months", start, step, close)).alias("w")).select(key, F.col("w.first").alias("first_month"), F.col("w.last").alias("last_month"), F.col("w.n").alias("rows"))


def running(rows: DataFrame, key: str, *order: str, cost: Column | None = None) -> DataFrame:
    """Adds n, each row's place from 1 in its key's order, and with ``cost`` spent, the costs up to and with it.

    Rows are dealt by ranges of key and order and written once; what the ranges before hold of a key is added to what a range counts by itself,
    so a key of any size is many tasks' work. There is one number for each range and key that meet.
    """
    columns = rows.columns
    dealt = written(rows.withColumn("_cost", cost if cost is not None else F.lit(0)).repartitionByRange(key, *order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p", F.col(key).alias("_k")).agg(F.count("*").alias("_c"), F.sum("_cost").alias("_s")).withColumnRenamed("_p", "_q")
    before = Window.partitionBy("_k").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_q", "_k", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    inside = Window.partitionBy("_p", key).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.withColumn("_n", F.row_number().over(inside)).withColumn("_upto", F.sum("_cost").over(upto))
    met = own.join(base, (F.col("_p") == F.col("_q")) & F.col(key).eqNullSafe(F.col("_k")))
    out = met.withColumn("n", F.col("_n") + F.col("_n0")).withColumn("spent", F.col("_upto") + F.col("_s0"))
    return out.select(*columns, "n", *(["spent"] if cost is not None else []))


def chunks(rows: DataFrame, size: int, key: str, *order: str) -> DataFrame:
    """Adds chunk: contiguous runs of ``size`` rows of each key."""
    return running(rows, key, *order).withColumn("chunk", F.floor((F.col("n") - 1) / size).cast("long")).drop("n")


def most_recent(rows: DataFrame, n: int, key: str, ts: str, tie: str) -> DataFrame:
    """The latest n rows of each key, with their place in time."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))
    return rows.withColumn("_back", back).filter(F.col("_back") <= n).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(ts, tie))).drop("_back")


def fill_down(rows: DataFrame, column: str, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def runs(rows: DataFrame, label: str, key: str, *order: str) -> DataFrame:
    """Adds run: consecutive rows with one label, numbered in order."""
    w = Window.partitionBy(key).orderBy(*order)
    change = (~F.col(label).eqNullSafe(F.lag(label).over(w))) | (F.row_number().over(w) == 1)
    return rows.withColumn("_c", change.cast("int")).withColumn("run", F.sum("_c").over(w).cast("long")).drop("_c")


def within_budget(sections: DataFrame, cost: Column, budget: int, key: str, *order: str, large: bool = False) -> DataFrame:
    """Sections in order until one overflows; it and all after it fall. The first is always admitted. ``large``: a key may have any number of them."""
    if large:
        out = running(sections, key, *order, cost=cost)
        return out.filter((F.col("n") == 1) | (F.col("spent") <= budget)).drop("n")
    w = Window.partitionBy(key).orderBy(*order)
    so_far = F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = sections.withColumn("_cost", cost).withColumn("_n", F.row_number().over(w)).withColumn("spent", so_far)
    return out.filter((F.col("_n") == 1) | (F.col("spent") <= budget)).drop("_cost", "_n")


def stratified_split(rows: DataFrame, key: str, row_id: str, share: float, seed: str) -> DataFrame:
    """Adds held_out: in each stratum the first floor(n * share) rows by a seeded hash."""
    columns = rows.columns
    placed = running(rows.withColumn("_order", F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")))), key, "_order", row_id)
    total = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_of"))
    return placed.join(total, F.col(key).eqNullSafe(F.col("_k"))).withColumn("held_out", F.col("n") <= F.floor(F.col("_of") * share)).select(*columns, "held_out")


def page(rows: DataFrame, cursor: str, since: int, limit: int, least: int = 1, most: int = 500) -> DataFrame:
    """Rows after a cursor, oldest first; the limit is clamped."""
    return rows.filter(F.col(cursor) > since).orderBy(cursor).limit(max(least, min(most, limit)))


def latest_edition(rows: DataFrame, edition: str) -> DataFrame:
    newest = rows.agg(F.max(edition).alias("_newest"))
    return rows.join(F.broadcast(newest), rows[edition] == F.col("_newest")).drop("_newest")  # one row


def round_robin(rows: DataFrame, name: str, caps: dict[str, int], total: int) -> DataFrame:
    """Names by source in the order of ``caps``, each source's share capped, case aside once only, ``total`` at most."""
    order = F.create_map(*[x for k, s in enumerate(caps) for x in (F.lit(s), F.lit(k))])
    cap = F.create_map(*[x for s, c in caps.items() for x in (F.lit(s), F.lit(c))])
    ranked = rows.withColumn("_tier", order[F.col("source")])
    ranked = ranked.withColumn("_dup", F.row_number().over(Window.partitionBy(F.lower(name)).orderBy("_tier", "rank", name))).filter("_dup = 1")
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("rank", name))).filter(F.col("_n") <= cap[F.col("source")])
    return ranked.withColumn("place", F.row_number().over(Window.orderBy("_tier", "rank", name))).filter(F.col("place") <= total).drop("_tier", "_dup", "_n")


def sample(rows: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """n rows, in an order that a seeded hash of the key gives: random for any purpose, and the same again."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def alive(rows: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    """Rows without a tombstone: deletion marks, it doesn't remove."""
    return rows.filter(F.col(deleted).isNull())


def histogram(rows: DataFrame, label: str, missing: str = "?") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(label), F.lit(missing)).alias(label)).agg(F.count("*").alias("n"))


def page_at(rows: DataFrame, offset: int, limit: int, *order: str) -> DataFrame:
    """``limit`` rows behind the first ``offset`` in the order of columns, with their place: rows are numbered by the sizes of ranges, so the
    last page costs what the first does, and no task sorts more than its range."""
    from gristmill.operators.gaps import assign_sequence

    return assign_sequence(rows, 0, *order).withColumnRenamed("seq", "place").filter(F.col("place").between(offset + 1, offset + limit))


def recall(turns: DataFrame, terms: DataFrame, limit: int = 4, skip: int = 3, within: int = 400) -> DataFrame:
    """(qid, id, hits, r) of turns (id, text): those that have most of a question's terms as whole words, newest first among equals, from the
    last ``within`` but not the last ``skip`` of them."""
    from gristmill.operators.retrieve import first_word_hits

    last = turns.orderBy(F.desc("id")).limit(within)  # bounded: what one may remember
    newest = turns.orderBy(F.desc("id")).limit(skip).select("id")
    hits = first_word_hits(last.join(newest, "id", "left_anti"), terms, "id", "text").groupBy("qid", "id").agg(F.countDistinct("term").alias("hits"))
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hits"), F.desc("id")))).filter(F.col("r") <= limit)

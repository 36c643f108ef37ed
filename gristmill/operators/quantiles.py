"""Exact order statistics of groups of any size, by counts of values in bins that are opened around the rank.

``percentile`` and ``median`` gather all different values of a group in one task. Here values are counted first, where they are; each
round cuts a statistic's open range into ``BINS`` bins, adds their counts up and goes on with the bin that holds the rank, until that
bin holds one value. No task sees more of a group than its bins, so one group may hold all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.shared import written

BINS = 1024
SALT = 32


def upper_median(n: Column) -> Column:
    """The place, from 1, of the upper of two middle values."""
    return F.call_function("div", n, F.lit(2)) + 1


def nearest_rank(share: int) -> callable:
    """The place of the ``share``-th percentile by nearest rank: the smallest value that ``share`` in 100 rows don't exceed."""
    return lambda n: F.greatest(F.call_function("div", n * share + 99, F.lit(100)), F.lit(1).cast("long"))


def order_statistics(rows: DataFrame, key: list[str], value: str, places: dict[str, callable], bins: int = BINS) -> DataFrame:
    """(key, n, one column for each of ``places``): the value at a place, from 1, that is a function of the group's rows n.

    Null values and NaN don't count; a null key is a group; a place outside of 1 to n has a null value.
    """
    kind = dict(rows.dtypes)[value]
    v = F.col(value)
    kept = rows.filter(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], v.alias("v"))
    k = [f"_k{i}" for i in range(len(key))]
    counted = written(kept.groupBy(*k, "v").agg(F.count("*").alias("c"))).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))
    groups = written(counted.groupBy(*k).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    wanted = groups.select(*k, "lo", "hi", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("place")) for name, place in places.items()])).alias("p"), "n")
    state = written(wanted.select(*k, "lo", "hi", "p.name", "p.place", "n").filter("place between 1 and n").drop("n"))
    done = []
    while True:
        done.append(state.filter("lo = hi"))
        open_ = state.filter("lo < hi")
        if open_.isEmpty():
            break
        salted = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        same = [salted[c].eqNullSafe(counted[c]) for c in k]
        on = salted["salt"] == counted["salt"]
        for c in same:
            on = on & c
        met = counted.join(salted, on & (counted["v"] >= salted["lo"]) & (counted["v"] <= salted["hi"])).select(*[counted[c] for c in k], "name", "place", "v", "c", "lo", "hi")
        half = lambda c: F.col(c).cast("double") / 2  # noqa: E731  # differences of halves stay finite
        at = F.least(F.floor((half("v") - half("lo")) / (half("hi") - half("lo")) * bins), F.lit(bins - 1)).cast("int")
        # the ends stay by themselves, so a bin is always narrower than what it was cut from
        at = F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), bins).otherwise(F.coalesce(at, F.lit(0)))
        sums = met.groupBy(*k, "name", "place", at.alias("bin")).agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = sums.withColumn("upto", F.sum("c").over(Window.partitionBy(*k, "name").orderBy("bin")))
        held = upto.filter((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("c") < F.col("place")))
        state = written(held.select(*k, "lo", "hi", "name", (F.col("place") - F.col("upto") + F.col("c")).alias("place")))
    found = done[0]
    for f in done[1:]:
        found = found.unionByName(f)
    wide = found.groupBy(*k).agg(*[F.max(F.when(F.col("name") == name, F.col("lo"))).cast(kind).alias(name) for name in places])
    on = F.lit(True)
    g, w = groups.alias("g"), wide.alias("w")
    for c in k:
        on = on & F.col(f"g.{c}").eqNullSafe(F.col(f"w.{c}"))
    return g.join(w, on, "left").select(*[F.col(f"g.{c}").alias(name) for c, name in zip(k, key, strict=True)], "n", *[F.col(f"w.{name}") for name in places])

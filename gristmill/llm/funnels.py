"""Ordered funnels over skewed clients: counts of attempts by step and exact percentiles of the times between steps.

A funnel is four kinds in order and an excluded kind. Each row of the first kind starts an attempt; the next step is the
client's earliest row of its kind later than the previous step. It is reached unless it is over ``GAP`` microseconds later, or an
excluded row lies after the previous step and not after the next.

1. Distinct rows are dealt out by ranges of (client, time) into chunks of about ``CHUNK`` rows, so a client with a third of
   all rows becomes many chunks, cut wherever its rows are dense.
2. ``_chunk`` (applyInPandas): (client, time) becomes a rank, each kind a sorted int64 array of ranks; ``searchsorted`` on
   the right side chains the steps of all attempts of a chunk and finds the excluded rows. Clients that lie inside a chunk are
   done there: ``numpy.partition`` selects their percentiles.
3. A chunk's first and last client may go on beside it. An attempt that is still looking for step s at the chunk's end lands
   on the same row as all others of that funnel and step: the first of its kind in the chunks behind. So each chunk tells for its
   first client, for each funnel and step, where one that comes in looking for that step gets to (nine short lists), and
   ``_landings`` chains those lists backwards over the chunks that begin within ``STEPS - 1`` gaps of an end. Only these lists
   meet, grouped by client and hour: about one per ``CHUNK`` rows.
4. ``_resolve`` adds what was still open and counts each chunk's times by their upper bits (``numpy.unique``). The bins of all
   chunks of a client add up, the percentile's bin is opened by the next bits and then by the last; no group holds more rows than
   there are bins, 2^``BITS``.

Defined results: a row with a null client, kind or time doesn't count, and neither do repeats; rows of one time are not later
than each other; a funnel and client without a first step has no row; a step that no attempt reaches has a null percentile; an
empty table gives an empty result; other columns of the table are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import importable, materialise

FUNNELS = {
    "A": (("view", "click", "view", "purchase"), "error"),
    "B": (("signup", "view", "click", "purchase"), "error"),
    "C": (("click", "click", "purchase", "view"), "signup"),
}
STEPS = 4
GAP = 60 * 60 * 1_000_000
SHARE = 90
CHUNK = 1 << 17
BITS = 11

_INSIDE, _BORDER, _ENTRY, _ASKS = range(4)
_NONE = np.iinfo(np.int64).max
_TIMES = [f"d{s}" for s in range(2, STEPS + 1)]
_OPEN = [f"p{s}" for s in range(2, STEPS + 1)]
_N = [f"n{s}" for s in range(1, STEPS + 1)]
_T = [f"t{s}" for s in range(2, STEPS + 1)]
_BINS = [f"{c}{s}" for s in range(2, STEPS + 1) for c in "bc"]

Funnels = dict[str, tuple[tuple[str, ...], str]]


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    since = c.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def events(rows: DataFrame, funnels: Funnels) -> tuple[DataFrame, list[str]]:
    """Distinct (client, kind byte, t) of the kinds that ``funnels`` name; the kinds by number."""
    kinds = sorted({k for steps, bar in funnels.values() for k in (*steps, bar)})
    number = F.create_map(*[F.lit(x) for pair in enumerate(kinds) for x in pair[::-1]])[F.col("kind")].cast("byte")
    own = rows.filter(F.col("client").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(kinds))
    return own.select("client", number.alias("kind"), micros(F.col("ts")).alias("t")).distinct(), kinds


def rank_of(n: int | Column) -> int | Column:
    """The place, from 1, of the SHARE-th percentile among n sorted values."""
    return (n * SHARE + 99) // 100 if isinstance(n, int) else F.call_function("div", n * SHARE + 99, F.lit(100))


class _Ranks:
    """The rows of a chunk as ranks of (client, time): one rank for all kinds of a client at one time."""

    def __init__(self, pdf: pd.DataFrame, kinds: int) -> None:
        owner, self.clients = pd.factorize(pdf["client"], sort=True)
        t, kind = pdf["t"].to_numpy(np.int64), pdf["kind"].to_numpy()
        order = np.lexsort((t, owner))
        owner, t, kind = owner[order], t[order], kind[order]
        new = np.ones(len(t), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (t[1:] != t[:-1])
        rank = np.cumsum(new) - 1
        self.owner, self.t = owner[new], t[new]
        self.of = [np.sort(rank[kind == k]).astype(np.int64) for k in range(kinds)]
        self.last = len(self.clients) - 1

    def after(self, kind: int, at: np.ndarray) -> np.ndarray:
        """The rank of the client's next row of a kind later than each rank, or _NONE."""
        of = self.of[kind]
        place = np.searchsorted(of, at, side="right")
        found = np.full(len(at), _NONE)
        inside = np.flatnonzero(place < len(of))
        rank = of[place[inside]]
        own = self.owner[rank] == self.owner[at[inside]]
        found[inside[own]] = rank[own]
        return found

    def step(self, at: np.ndarray, kind: int, bar: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which attempts reach the next step, its ranks for those, and which may reach it behind the chunk."""
        to, barred = self.after(kind, at), self.after(bar, at)
        reached = (to != _NONE) & (barred > to)
        reached[reached] = self.t[to[reached]] - self.t[at[reached]] <= GAP
        going_on = (to == _NONE) & (barred == _NONE) & (self.owner[at] == self.last) & (self.t[-1] - self.t[at] <= GAP)
        return reached, to[reached], going_on

    def entry(self, steps: list[int], bar: int, s: int) -> list[int]:
        """Where an attempt of the first client gets to that comes in looking for step s: 1 if it goes on behind the chunk, then times."""
        first = lambda of: of[0] if len(of) and self.owner[of[0]] == 0 else _NONE
        to, barred = first(self.of[steps[s - 1]]), first(self.of[bar])
        if to == _NONE or barred <= to:
            return [int(to == _NONE and barred == _NONE)]
        at, times, on = np.array([to]), [int(self.t[to])], False
        while s + len(times) <= STEPS and not on:
            reached, to, going_on = self.step(at, steps[s + len(times) - 1], bar)
            if not reached[0]:
                on = bool(going_on[0])
                break
            times.append(int(self.t[to[0]]))
            at = to
        return [int(on), *times]


def _chunk(funnels: Funnels, kinds: list[str]):
    coded = [([kinds.index(k) for k in steps], kinds.index(bar)) for steps, bar in funnels.values()]

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _Ranks(pdf, len(kinds))
        chunk, out = int(pdf["chunk"].iloc[0]), []
        row = lambda role, client, **more: out.append({"role": role, "client": r.clients[client], "chunk": chunk} | more)
        asks = False
        for f, (steps, bar) in enumerate(coded):
            at = r.of[steps[0]]
            owners, times, still = [r.owner[at]], [], []
            for kind in steps[1:]:
                reached, to, going_on = r.step(at, kind, bar)
                still.append(r.t[at[going_on]])
                times.append(r.t[to] - r.t[at[reached]])
                at = to
                owners.append(r.owner[at])
            asks = asks or any(len(x) for x in still)
            edges = [np.searchsorted(o, np.arange(len(r.clients) + 1)) for o in owners]
            counts = np.array([np.diff(e) for e in edges])
            for c in np.flatnonzero(counts[0]).tolist():
                n = counts[:, c].tolist()
                own = [d[e[c] : e[c + 1]] for d, e in zip(times, edges[1:], strict=True)]
                if 0 < c < r.last:
                    q = [int(np.partition(d, rank_of(len(d)) - 1)[rank_of(len(d)) - 1]) if len(d) else None for d in own]
                    row(_INSIDE, c, funnel=f, **dict(zip(_N, n, strict=True)), **dict(zip(_T, q, strict=True)))
                else:
                    open_ = still if c == r.last else [[]] * len(still)
                    row(_BORDER, c, funnel=f, **dict(zip(_N, n, strict=True)), **dict(zip(_TIMES, own, strict=True)), **dict(zip(_OPEN, open_, strict=True)))
        hour = int(r.t[0]) // GAP
        row(_ENTRY, 0, hours=list(range(hour - STEPS + 1, hour + 1)), entry=[r.entry(steps, bar, s) for steps, bar in coded for s in range(2, STEPS + 1)])
        if asks:
            row(_ASKS, r.last, hours=[int(r.t[-1]) // GAP])
        kind = {"client": None, "role": "int32", "chunk": "int32"} | {c: "Int64" for c in ("funnel", *_N, *_T)}
        columns = ["role", "client", "chunk", "funnel", *_N, *_T, *_TIMES, *_OPEN, "hours", "entry"]
        return pd.DataFrame({c: pd.Series([x.get(c) for x in out], dtype=kind.get(c, "object")) for c in columns})

    return of


def _landings(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk that asks: per funnel and step the times that one looking for that step at the chunk's end gets to."""
    lists, out = None, []
    rows = pdf.sort_values(["chunk", "role"], ascending=False)  # of one chunk, it asks before its own entries count
    for role, chunk, entry in zip(rows["role"], rows["chunk"], rows["entry"], strict=True):
        if role == _ASKS:
            if lists is not None:
                out.append((pdf["client"].iloc[0], chunk, lists))
            continue
        entry = [list(map(int, x)) for x in entry]
        behind, lists = lists or [[]] * len(entry), []
        for k, (on, *times) in enumerate(entry):
            if on:
                more = behind[k + len(times)]
                times = times + more if not times or (more and more[0] - times[-1] <= GAP) else times
            lists.append(times)
    return pd.DataFrame(out, columns=["client", "chunk", "lands"])


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts and times of a chunk's border rows with those that the attempts still open there get to."""
    out = []
    for row in pdf.to_dict("records"):
        n, times = [int(row[c]) for c in _N], [[row[c]] for c in _TIMES]
        for k in range(STEPS - 1) if row["lands"] is not None else ():
            lands, waiting = row["lands"][int(row["funnel"]) * (STEPS - 1) + k], np.asarray(row[_OPEN[k]], np.int64)
            if not len(lands) or not len(waiting):
                continue
            first = lands[0] - waiting
            first = first[first <= GAP]
            for j, d in enumerate([first, *[np.full(len(first), b - a) for a, b in zip(lands[:-1], lands[1:], strict=True)]]):
                n[k + 1 + j] += len(first)
                times[k + j].append(d)
        whole = [np.concatenate([np.asarray(x, np.int64) for x in d]) for d in times]
        bins = [np.unique(d >> 2 * BITS, return_counts=True) for d in whole]
        out.append((row["client"], row["chunk"], row["funnel"], *n, *whole, *[x for pair in bins for x in pair]))
    return pd.DataFrame(out, columns=["client", "chunk", "funnel", *_N, *_TIMES, *_BINS])


def percentiles(resolved: DataFrame, totals: DataFrame) -> DataFrame:
    """(client, funnel, t2, t3, t4): the rank_of(n)-th smallest of each step's times, by counts of their upper bits, then of the next and the last."""
    key = ["client", "funnel", "step"]

    def by_step(*columns: Callable[[int], Column]) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(s + 2).alias("step"), *[c(s + 2) for c in columns]) for s in range(STEPS - 1)])).alias("x")

    def holding(rows: DataFrame) -> DataFrame:
        """Of each key's rows (bin, n, place) the first whose running sum of n reaches place, and the place within it."""
        rows = rows.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("bin")))
        return rows.filter((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place"))).select(*key, "bin", (F.col("place") - F.col("upto") + F.col("n")).alias("place"))

    place = totals.select("client", "funnel", by_step(lambda s: rank_of(F.col(f"n{s}")).alias("place"))).select("client", "funnel", "x.*")
    bins = resolved.select("client", "funnel", by_step(lambda s: F.arrays_zip(F.col(f"b{s}").alias("bin"), F.col(f"c{s}").alias("n")).alias("of"))).select("client", "funnel", "x.step", F.inline("x.of"))
    chosen = materialise(holding(bins.groupBy(*key, "bin").agg(F.sum("n").alias("n")).join(place, key)))

    wide = chosen.groupBy("client", "funnel").agg(*[F.max(F.when(F.col("step") == s, F.col("bin"))).alias(f"o{s}") for s in range(2, STEPS + 1)])
    where = resolved.select("client", "chunk", "funnel").join(wide, ["client", "funnel"])  # short rows; the times meet them by chunk
    inside = lambda s: F.filter(f"d{s}", lambda d: F.shiftright(d, 2 * BITS) == F.col(f"o{s}")).alias("d")
    times = resolved.join(where, ["client", "chunk", "funnel"]).select("client", "funnel", by_step(inside)).select("client", "funnel", "x.step", F.explode("x.d").alias("d"))
    counted = materialise(times.groupBy(*key, "d").agg(F.count("*").alias("n")))
    middle = counted.groupBy(*key, F.shiftright("d", BITS).alias("bin")).agg(F.sum("n").alias("n"))
    middle = holding(middle.join(chosen.drop("bin"), key))
    last = counted.withColumn("high", F.shiftright("d", BITS)).join(middle.withColumnRenamed("bin", "high"), [*key, "high"]).withColumnRenamed("d", "bin")
    return holding(last).groupBy("client", "funnel").agg(*[F.max(F.when(F.col("step") == s, F.col("bin"))).alias(f"t{s}") for s in range(2, STEPS + 1)])


def funnel_counts(rows: DataFrame, funnels: Funnels | None = None, chunk: int = CHUNK) -> DataFrame:
    """(funnel, client, n1 to n4, deepest, t2 to t4, same_depth) of rows (client, kind, ts without a zone)."""
    funnels = funnels or FUNNELS
    importable(rows.sparkSession)
    found, kinds = events(rows, funnels)
    found = materialise(found)
    kind_of = found.schema["client"].dataType.simpleString()
    dealt = found.repartitionByRange(max(1, math.ceil(found.count() / chunk)), "client", "t").withColumn("chunk", F.spark_partition_id())
    longs = lambda names, of="long": ", ".join(f"{c} {of}" for c in names)
    schema = f"role int, client {kind_of}, chunk int, funnel int, {longs(_N)}, {longs(_T)}, {longs([*_TIMES, *_OPEN, 'hours'], 'array<long>')}, entry array<array<long>>"
    chunks = materialise(dealt.groupBy("chunk").applyInPandas(_chunk(funnels, kinds), schema))

    tells = chunks.filter(F.col("role").isin(_ENTRY, _ASKS)).select("client", F.explode("hours").alias("hour"), "role", "chunk", "entry")
    lands = tells.groupBy("client", "hour").applyInPandas(_landings, f"client {kind_of}, chunk int, lands array<array<long>>")
    borders = chunks.filter(F.col("role") == _BORDER).select("client", "chunk", "funnel", *_N, *_TIMES, *_OPEN)
    resolved = borders.join(lands, ["client", "chunk"], "left").groupBy("client", "chunk").applyInPandas(_resolve, f"client {kind_of}, chunk int, funnel int, {longs(_N)}, {longs([*_TIMES, *_BINS], 'array<long>')}")
    resolved = materialise(resolved)
    totals = resolved.groupBy("client", "funnel").agg(*[F.sum(c).alias(c) for c in _N])
    split = totals.join(percentiles(resolved, totals), ["client", "funnel"], "left")

    columns = ["client", "funnel", *_N, *_T]
    both = materialise(chunks.filter(F.col("role") == _INSIDE).select(*columns).unionByName(split.select(*columns)))
    deepest = sum((F.col(c) > 0).cast("int") for c in _N)
    both = both.withColumn("deepest", deepest)
    depths = both.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))  # a row for each funnel and step
    name = F.get(F.array(*[F.lit(k) for k in funnels]), F.col("funnel"))
    return both.join(F.broadcast(depths), ["funnel", "deepest"]).select(name.alias("funnel"), "client", *_N, "deepest", *_T, "same_depth")


def op12_funnels(spark, sf_dir):
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet").select(F.col("client_id").alias("client"), "kind", "ts")
    return funnel_counts(clicks).withColumnRenamed("client", "client_id")


def _sql() -> str:
    steps = ", ".join(f"('{f}', {s + 1}, '{k}')" for f, (kinds, _) in FUNNELS.items() for s, k in enumerate(kinds))
    bars = ", ".join(f"('{f}', '{bar}')" for f, (_, bar) in FUNNELS.items())
    chain = "".join(
        f""",
a{s} AS MATERIALIZED (
  SELECT a.* EXCLUDE (t), n.t - a.t AS d{s}, n.t FROM a{s - 1} a
  ASOF LEFT JOIN (SELECT * FROM w WHERE s = {s}) n ON a.funnel = n.funnel AND a.client_id = n.client_id AND a.t < n.t
  ASOF LEFT JOIN x ON a.funnel = x.funnel AND a.client_id = x.client_id AND a.t < x.t
  WHERE n.t - a.t <= {GAP} AND (x.t IS NULL OR x.t > n.t))"""
        for s in range(2, STEPS + 1)
    )
    counts = "".join(f", g{s} AS (SELECT funnel, client_id, count(*) AS n, list_sort(list(d{s})) AS d FROM a{s} GROUP BY ALL)" for s in range(2, STEPS + 1))
    joins = " ".join(f"LEFT JOIN g{s} USING (funnel, client_id)" for s in range(2, STEPS + 1))
    n = ", ".join(f"coalesce(g{s}.n, 0) AS n{s}" for s in range(2, STEPS + 1))
    t = ", ".join(f"g{s}.d[({SHARE} * g{s}.n + 99) // 100] AS t{s}" for s in range(2, STEPS + 1))
    return f"""
WITH steps(funnel, s, kind) AS (VALUES {steps}), bars(funnel, kind) AS (VALUES {bars}),
e AS MATERIALIZED (SELECT DISTINCT client_id, kind, epoch_us(ts) AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL),
w AS MATERIALIZED (SELECT funnel, s, client_id, t FROM e JOIN steps USING (kind)),
x AS MATERIALIZED (SELECT funnel, client_id, t FROM e JOIN bars USING (kind)),
a1 AS (SELECT funnel, client_id, t FROM w WHERE s = 1){chain}{counts},
g1 AS (SELECT funnel, client_id, count(*) AS n FROM a1 GROUP BY ALL),
r AS (SELECT funnel, client_id, g1.n AS n1, {n}, {t} FROM g1 {joins}),
f AS (SELECT *, (1 + (n2 > 0)::INTEGER + (n3 > 0)::INTEGER + (n4 > 0)::INTEGER)::INTEGER AS deepest FROM r)
SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM f
"""


OP12_SQL = _sql()

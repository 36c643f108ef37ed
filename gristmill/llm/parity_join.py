"""Jaccard join of word n-grams through parity sketches.

Two documents link at a Jaccard similarity of ``NUM`` / ``DEN`` or more of their sets of ``WORDS``-word shingles (ASCII-lower-cased
words). With sizes a and b that allows a symmetric difference of (a + b) * (DEN - NUM) / (DEN + NUM) shingles.

1. ``sets``: equal sets are one node, named by a 64-bit hash; one text of each goes on.
2. ``sketches``: XOR leaves of two sets what only one of them has. ``BITS`` parity bits of a set (each shingle flips one) differ between
   two sets in as many bits at most as the sets differ in shingles. The same holds for wider symbols: each shingle's hash is XORed
   into one of d + 1 symbols, where d is the largest difference that links in the sets' size band; so of two sets that link at
   least one symbol agrees, and the symbols are the keys of an equi-join (pigeonhole). Bands grow by a quarter; a set that a larger
   one could link with from the next band joins that band, too.
3. ``links``: of each shared symbol one node meets all others; what sizes and parity bits don't rule out is verified by whole sets,
   written once, and what links is one component. That repeats, with nodes by more orders, while the symbols that several components share
   still hold over ``PER_ROW`` pairs for each of their rows. Then all pairs of different components meet. Symbols that would still give over
   ``CROSS`` such pairs - few shingles, or ones that a passage in many documents brings along - are joined with a second,
   independent deal of the shingles: a pair that links agrees on a symbol of that as well.
4. Components are named by their smallest doc_id.

No pair that links is missed; two different shingles or sets of n are taken for equal with a probability of about n^2 / 2^65.

Defined results: null or empty text, or one without words, is an empty set and linked with nothing, not even its like; fewer
words than ``WORDS`` form one shingle; repeated rows are equal sets, each with a row of its own; a null doc_id names a component
only where no other is in it; an empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import chosen_rows, map_texts, materialise, rows_with_ids
from gristmill.llm.shingle_near import FEW, SKETCH, node_name, overlapping, sets_of, shingle_sets, sketch
from gristmill.llm.simhash_gray import components, name_components

WORDS = 3
NUM, DEN = 9, 10
BITS = SKETCH * 64
CROSS = 1 << 21
ORDERS = 4
PER_ROW = 256
U = np.uint64
_M1, _M2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_SKETCHES = [f"k{i}" for i in range(SKETCH)]
_HALF = U(0xFFFFFFFF)


def size_bands(least: int = NUM // (DEN - NUM), most: int = 1 << 40) -> np.ndarray:
    """The smallest size of each band. Smaller sets than ``least`` link with equal ones only."""
    bounds = [least]
    while bounds[-1] < most:
        bounds.append(-(-5 * bounds[-1] // 4))
    return np.array(bounds, np.int64)


BANDS = size_bands()


def bands_of(n: int) -> list[int]:
    """The bands where a set of n shingles can meet those it may link with."""
    if n < BANDS[0]:
        return []
    own = int(np.searchsorted(BANDS, n, side="right")) - 1
    return [own, own + 1] if DEN * n >= NUM * BANDS[own + 1] else [own]


def blocks_of(band: int) -> int:
    """One symbol more than two sets of the band that link can differ in."""
    return int(2 * (BANDS[band + 1] - 1) * (DEN - NUM) // (DEN + NUM)) + 1


def symbols(s: np.ndarray, blocks: int, second: bool = False) -> np.ndarray:
    """XOR of the hashes that fall into each block: by their upper halves, or by their lower ones for the second deal."""
    place = ((s & _HALF if second else s >> U(32)) * U(blocks)) >> U(32)
    if second:
        order = np.argsort(place, kind="stable")
        s, place = s[order], place[order]
    upto = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(s)))
    edge = np.searchsorted(place, np.arange(blocks + 1, dtype=np.uint64))
    return upto[edge[1:]] ^ upto[edge[:-1]]


def keys(s: np.ndarray, band: int, second: bool = False) -> np.ndarray:
    """The set's join keys in a band: each symbol mixed with the band and its place there."""
    x = symbols(s, blocks_of(band), second)
    x = (x ^ (np.arange(len(x), dtype=np.uint64) + U(band << 40) + U(1)) * _M1) * _M2
    x ^= x >> U(32)
    return (x * _M1).view(np.int64)


def sets(docs: DataFrame) -> DataFrame:
    """(the columns of ``docs`` but text, fp, n): the name and size of each document's set."""

    def of(texts: list[str | None], _) -> dict[str, list]:
        found = [(node_name(s), len(s)) for s in shingle_sets(texts, WORDS)]
        return {"fp": [f for f, _ in found], "n": [n for _, n in found]}

    return map_texts(docs, "fp long, n long", lambda: of)


def sketches(texts: DataFrame) -> DataFrame:
    """(node, n, k0 ..., keys, more): size, parity bits and keys by band, by either deal of the shingles."""

    def of(texts: list[str | None], _) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("node", "n", *_SKETCHES, "keys", "more")}
        for s in shingle_sets(texts, WORDS):
            out["node"].append(node_name(s))
            out["n"].append(len(s))
            for c, v in zip(_SKETCHES, sketch(s).tolist(), strict=True):
                out[c].append(v)
            out["keys"].append([keys(s, b) for b in bands_of(len(s))])
            out["more"].append([keys(s, b, True) for b in bands_of(len(s))])
        return out

    return map_texts(texts, "node long, n long, " + ", ".join(f"{k} long" for k in _SKETCHES) + ", keys array<array<long>>, more array<array<long>>", lambda: of)


def _may_link(a: str, b: str) -> Column:
    """Whether sizes and parity bits leave room for a link."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum(F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in _SKETCHES)
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & ((DEN + NUM) * apart <= (DEN - NUM) * (n + m))


def _open(rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, float]:
    """``rows`` with their components, and pairs, of the keys that several components share; the number of pairs of different components."""
    each = materialise(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    by_root = each.groupBy("key", "root").agg(F.count("*").cast("double").alias("c"))
    pairs = materialise(by_root.groupBy("key").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs")).filter("pairs > 0"))
    return each.join(pairs, "key"), pairs.agg(F.sum("pairs")).first()[0] or 0.0


def _star(rows: DataFrame, orders: int) -> DataFrame:
    """(a, b): of each key one node, a, with all others of other components that it may link with. Keys take their node by one of ``orders``
    random orders, so a cluster whose members don't all link with each other is met from several of them."""
    rows = rows.select("key", "node", "root", "n", *_SKETCHES).repartition("key")  # dealt out once, for both sides
    way = F.pmod(F.xxhash64("key", F.lit(orders)), F.lit(orders))
    first = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", way), "node", "root", "n", *_SKETCHES)).alias("c"))
    centre = first.select("key", *[F.col(f"c.{x}").alias(x) for x in ("node", "root", "n", *_SKETCHES)])
    other = rows.alias("x").join(centre.alias("y"), "key").filter((F.col("x.root") != F.col("y.root")) & _may_link("x", "y"))
    return other.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct()


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets (node, s) link. Up to ``FEW`` of them, counted, go to where the sets are: then b's set moves once for
    each pair, a's once for all."""
    pairs, share = materialise(pairs), (NUM, DEN + NUM)
    if pairs.count() > FEW:
        return overlapping(pairs, whole, share)
    left = whole.join(F.broadcast(pairs.select(F.col("a").alias("node")).distinct()), "node", "left_semi").toDF("a", "sa")
    both = whole.toDF("b", "sb").join(F.broadcast(pairs), "b").join(left, "a")
    return materialise(both.filter(share[1] * F.size(F.array_intersect("sa", "sb")) >= share[0] * (F.size("sa") + F.size("sb"))).select("a", "b"))


def links(texts: DataFrame, cross: int = CROSS) -> DataFrame:
    """(node, root) of every linked node. texts: one text of each node."""
    first = materialise(sketches(texts))
    about = first.select("node", "n", *_SKETCHES)
    rows = first.select("node", F.posexplode("keys").alias("slot", "own")).select("node", "slot", F.explode("own").alias("key")).repartition("key")
    # the same columns on either side of the join, so that the keys are dealt out once
    shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("slot").alias("top")).filter("low < high and top >= 0").select("key")
    rows = materialise(rows.join(shared, "key").join(about, "node"))
    whole = sets_of(texts, rows.select("node").distinct(), WORDS)
    n = rows.count()

    each, edges, roots, orders = rows.withColumn("root", F.col("node")), None, None, ORDERS
    while True:
        found = _verified(_star(each, orders), whole)
        fresh = not found.isEmpty()
        edges = found if edges is None else edges.unionByName(found)
        roots = components(edges) if fresh or roots is None else roots
        each, pairs = _open(rows, roots)
        if pairs <= PER_ROW * n or not fresh or orders >= ORDERS**4:
            break
        orders *= ORDERS

    left = each
    if not each.filter(F.col("pairs") > cross).isEmpty():
        again = each.filter(F.col("pairs") > cross).join(first.select("node", "more"), "node")
        again = again.select(*[c for c in each.columns if c != "key"], F.posexplode(F.get("more", F.col("slot"))).alias("at", "other"), "key").withColumn("key", F.xxhash64("key", "other"))
        left = each.filter(F.col("pairs") <= cross).unionByName(again.select(*each.columns))
    apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y")
    pairs = left.alias("x").join(left.alias("y"), (F.col("x.key") == F.col("y.key")) & apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    found = _verified(pairs, whole)
    return roots if found.isEmpty() else components(edges.unionByName(found))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n, component_id), one row per row of ``docs`` (doc_id, text)."""
    rows = rows_with_ids(docs)
    found = materialise(sets(rows.select("_file", "_place", F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"))))
    full = found.filter("n > 0")
    one = full.groupBy("fp").agg(F.min(F.struct("_file", "_place")).alias("one")).select("one.*", F.lit(1).cast("byte").alias("_times"))
    named = name_components(full, links(chosen_rows(rows, one).select("_row.text")))
    empty = found.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    return named.select("doc_id", "n", "component_id").unionByName(empty.select("doc_id", "n", "component_id"))


def op13_parity_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).withColumnRenamed("n", "n_shingles").select("doc_id", "n_shingles", "component_id")

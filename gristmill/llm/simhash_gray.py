"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints link at ``MAX_DIFF`` or fewer differing bits; linked fingerprints
form components, named by their smallest doc_id.

* ``fingerprints``: ASCII-lower-cased words, ``WORDS``-word shingles with
  repeats, XXH64 (seed 42) of each; a bit is 1 if set in over half of them.
* ``links``: equal fingerprints are one node. Two fingerprints that differ in
  MAX_DIFF bits agree on one of MAX_DIFF + 1 blocks of bits, so each node goes
  to one partition per block, rotated so that the block leads, and sorted by
  Gray rank: neighbours in that order share most of their bits. Groups with a
  common block are split once more by blocks of the bits left where they exceed
  ``GROUP`` nodes (twice at most); the same argument holds for those bits.
* In a partition runs of ``FAN`` neighbours become index nodes with the mask of
  the bits they share and the pattern of those bits; runs of index nodes become
  upper nodes, and what an upper node holds is masked out below it. A search
  adds up the differences on its way down and drops a node, with all below it,
  once they exceed MAX_DIFF, or once all of it is known to be in the query's
  own component; so a cluster of n near copies costs about n steps, not n * n.
  Links leave the partition as a spanning forest.
* ``components``: large-star and small-star rounds on the links, each written to
  the shared folder, until nothing changes.

Defined results: null or empty text, or one without words, has fingerprint 0,
linked like any other; fewer words than ``WORDS`` form one shingle; repeated rows
and ties share a component; a null doc_id counts as a document and names a component (as null) only where no other is in
it; an empty table gives an empty one; other columns, whatever their names, are left alone by ``near_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import chosen_rows, importable, map_texts, materialise, rows_with_ids

WORDS = 3
SEED = 42
MAX_DIFF = 2
FAN = 8
GROUP = 512
U = np.uint64


def fingerprint(text: str | None, words: int = WORDS) -> int:
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)]
    a, counts = np.array(hashes, "<u8"), np.zeros(64, np.int64)
    for k in range(0, len(a), 1 << 16):
        counts += np.unpackbits(a[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(a), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(the columns of ``docs`` but text, fp): fp's 64 bits as a long."""
    return map_texts(docs, "fp long", lambda: lambda texts, _: {"fp": np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)})


def gray_rank(c: Column) -> Column:
    """The place of a bit string in Gray order: each bit becomes the parity of the bits from the top down to it."""
    for s in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, s))
    return c


def _lead(c: Column, at: int, width: int, fixed: int) -> Column:
    """Moves ``width`` bits, ``at`` bits below the ``fixed`` leading ones, to just behind those."""
    if at == 0:
        return c
    rest = 64 - fixed
    low = c if fixed == 0 else c.bitwiseAND(F.lit((1 << rest) - 1).cast("long"))
    high = F.lit(0).cast("long") if fixed == 0 else c.bitwiseAND(F.lit(-(1 << rest)).cast("long"))
    mask = F.lit((1 << rest) - 1 if fixed else -1).cast("long")
    turned = F.shiftleft(low, at).bitwiseOR(F.shiftrightunsigned(low, rest - at)).bitwiseAND(mask)
    return high.bitwiseOR(turned)


def _blocks(nodes: DataFrame, fixed: int, blocks: int) -> tuple[DataFrame, int]:
    """Each node once per block of the bits behind the ``fixed`` ones; the bits that then agree in a group."""
    rest = 64 - fixed
    width = rest // blocks
    turns = F.array(*[F.struct(F.concat("path", F.lit(f"{k}")).alias("path"), _lead(F.col("bits"), k * width, width, fixed).alias("bits")) for k in range(blocks)])
    out = nodes.select("fp", F.explode(turns).alias("t")).select("fp", "t.path", "t.bits")
    return out.withColumn("key", F.shiftrightunsigned("bits", 64 - fixed - width)), fixed + width


def links(fps: DataFrame, max_diff: int = MAX_DIFF, group: int = GROUP) -> DataFrame:
    """(a, b): a spanning forest, within each partition, of the pairs of different fingerprints at ``max_diff`` bits or fewer."""
    nodes = fps.select("fp").distinct().select("fp", F.lit("").alias("path"), F.col("fp").alias("bits"))
    ready, fixed = [], 0
    for level in range(3):
        rows, fixed = _blocks(nodes, fixed, max_diff + 1)
        if level == 2:
            ready.append(rows.withColumn("fixed", F.lit(fixed)))
            break
        large = rows.groupBy("path", "key").count().filter(F.col("count") > group).drop("count")
        rows = rows.join(large.withColumn("large", F.lit(True)), ["path", "key"], "left")
        ready.append(rows.filter("large is null").drop("large").withColumn("fixed", F.lit(fixed)))
        nodes = rows.filter("large").select("fp", "path", "bits")
    rows = ready[0].unionByName(ready[1]).unionByName(ready[2]).select("path", "key", "fixed", gray_rank(F.col("bits")).alias("rank"), "fp")
    importable(fps.sparkSession)
    dealt = rows.repartition("path", "key").sortWithinPartitions("path", "key", "rank")
    return dealt.mapInPandas(_search_all(max_diff), "a long, b long")


def _search_all(max_diff: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            if held and (held[-1]["path"].iloc[-1], held[-1]["key"].iloc[-1]) == (b["path"].iloc[-1], b["key"].iloc[-1]):
                held.append(b)  # one group goes on through the whole batch
                continue
            rest = ((b["path"] == b["path"].iloc[-1]) & (b["key"] == b["key"].iloc[-1])).to_numpy()
            yield from _groups(pd.concat([*held, b[~rest]]), max_diff)
            held = [b[rest]]
        if held:
            yield from _groups(pd.concat(held), max_diff)

    return of


def _groups(rows: pd.DataFrame, max_diff: int) -> Iterator[pd.DataFrame]:
    if len(rows) < 2:
        return
    path, key = rows["path"].to_numpy(), rows["key"].to_numpy()
    new = np.concatenate(([True], (path[1:] != path[:-1]) | (key[1:] != key[:-1])))
    size = np.diff(np.append(np.flatnonzero(new), len(rows)))
    alone = np.repeat(size == 1, size)
    rows, path = rows[~alone], path[~alone]
    for p in pd.unique(path):  # nodes of one path are turned alike, so their bits can share one index
        part = rows[path == p]
        rank = part["rank"].to_numpy().view(np.uint64)
        bits = rank ^ (rank >> U(1))
        fixed = int(part["fixed"].iloc[0])
        order = np.argsort(rank, kind="stable")
        fp = part["fp"].to_numpy()[order]
        root = linked(bits[order], max_diff, fixed)
        off = np.flatnonzero(root != np.arange(len(root)))
        if len(off):
            yield pd.DataFrame({"a": fp[off], "b": fp[root[off]]})


def gray_index(bits: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pattern and mask of each level's nodes over fingerprints in Gray order; level 0 is the fingerprints themselves."""
    ones, any_ = bits, bits
    pattern, mask = [bits], [np.full(len(bits), ~U(0))]
    while len(ones) > FAN:
        at = np.arange(0, len(ones), FAN)
        ones, any_ = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(any_, at)
        pattern.append(ones)
        mask.append(~(ones ^ any_))
    own = [m & ~np.repeat(up, FAN)[: len(m)] for m, up in zip(mask[:-1], mask[1:], strict=True)]  # what an upper node holds is factored out below it
    return pattern, [*own, mask[-1]]


def linked(bits: np.ndarray, max_diff: int = MAX_DIFF, fixed: int = 0) -> np.ndarray:
    """For each of the fingerprints in Gray order the smallest place in its component, by links within ``max_diff`` bits
    that agree on the ``fixed`` leading bits."""
    n = len(bits)
    pattern, mask = gray_index(bits)
    lead = U(0) if fixed == 0 else ~U(0) << U(64 - fixed)
    comp = np.arange(n)
    done, step = 0, 16
    while done < n:
        queries = np.arange(done, min(n, done + step))
        low, high = [comp], [comp]  # a node lies in one component where these agree
        for k in range(1, len(mask)):
            at = np.arange(0, len(low[-1]), FAN)
            low.append(np.minimum.reduceat(low[-1], at))
            high.append(np.maximum.reduceat(high[-1], at))
        top = len(mask) - 1
        q, node = np.repeat(queries, len(mask[top])), np.tile(np.arange(len(mask[top])), len(queries))
        diff = np.zeros(len(q), np.int64)
        for k in range(top, -1, -1):
            x = (bits[q] ^ pattern[k][node]) & mask[k][node]
            diff = diff + np.bitwise_count(x)
            last = (node + 1) * FAN**k - 1
            keep = (diff <= max_diff) & (x & lead == 0) & (last > q) & ~((low[k][node] == high[k][node]) & (low[k][node] == comp[q]))
            q, node, diff = q[keep], node[keep], diff[keep]
            if k:
                size = len(mask[k - 1])
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                q, diff = np.repeat(q, FAN), np.repeat(diff, FAN)
                inside = child < size
                q, node, diff = q[inside], child[inside], diff[inside]
        comp = _merge(comp, q, node)
        done += len(queries)
        step = min(step * 4, 4096)
    return comp


def _merge(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after linking a[i] with b[i]; each is named by its smallest place."""
    while len(a):
        x, y = comp[a], comp[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        parent = np.arange(len(comp))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        comp = parent[comp]
    return comp


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by alternating stars."""
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = materialise(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select("b", "b").distinct())


def name_components(fps: DataFrame, roots: DataFrame) -> DataFrame:
    """``fps`` with component_id, the smallest doc_id of the component that fp is in by ``roots``."""
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, words: int = WORDS, max_diff: int = MAX_DIFF) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``."""
    fps = materialise(fingerprints(docs.select("doc_id", "text"), words))
    return name_components(fps, components(links(fps, max_diff)))


def keep_one(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Of ``rows_with_ids`` those that ``named`` (_file, _place, doc_id, component_id) keeps: one row of each component's first document.

    What stays leaves as one array of bits per file. Where all files' arrays are small together, which is counted first, they
    are broadcast, and no text is shuffled; else they are joined.
    """
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_file", "_place")).alias("one")).select("one._file", "one._place")
    return chosen_rows(rows, first.withColumn("_times", F.lit(1).cast("byte"))).select("_row.*")


def near_dedup(docs: DataFrame, words: int = WORDS, max_diff: int = MAX_DIFF) -> DataFrame:
    """``docs`` with one document of each component: the one that names it."""
    rows = rows_with_ids(docs)
    fps = materialise(fingerprints(rows.select("_file", "_place", F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text")), words))
    return keep_one(rows, name_components(fps, components(links(fps, max_diff))))


def op2_simhash_gray(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

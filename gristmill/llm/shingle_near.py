"""SimHash near-dedup confirmed by shingles: the pipeline's near stage.

Documents link at a Jaccard similarity of 4/5 or more of their sets of ``WORDS``-word shingles (ASCII-lower-cased words);
linked documents form components, and ``near_dedup`` keeps the smallest doc_id of each. SimHash fingerprints of the shingles
go through the Gray-order index of ``simhash_gray``, which nominates at ``MAX_DIFF`` bits. Two texts at 4/5 differ in about ten of
64 bits, where no index is selective, so the fingerprints alone would lose most such pairs; a prefix filter over the shingles
finds what they can't, and no pair is missed. Every link is confirmed by the whole sets.

1. ``nodes``: equal sets are one node, with a fingerprint. Shingles are counted by ``BUCKETS`` buckets of their hashes.
2. ``prefixes``: a set's shingles in the order of (bucket's count, hash); any two sets that link share one of the first
   n - ceil(4/5 n) + 1. Shingles in many documents come last, so they nominate next to nothing. ``SKETCH`` * 64 parity bits
   of the whole set go along: two sets differ in as many shingles at least as their sketches differ in bits.
3. The index's pairs are confirmed, and per shared shingle those of the set with the fewest rarer shingles with all others;
   what is linked so is one component. Then each set is compared with all sets of other components. What a pair's places,
   sizes and sketches rule out leaves no row.
4. ``confirmed``: whole sets, computed anew and written for the sets that are in pairs.

Defined results: null or empty text, or one without words, is the empty set, and empty sets are equal; fewer words than
``WORDS`` form one shingle; repeated rows are equal sets; a null doc_id counts as a document and stays only where no other is
in its component; an empty table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm import simhash_gray
from gristmill.llm.common import chosen_rows, map_texts, materialise, release, rows_with_ids
from gristmill.llm.simhash_gray import MAX_DIFF, SEED, components, keep_one, name_components
from gristmill.llm.wordhash import hashes, split

WORDS = 5
BUCKETS = 1 << 20
SKETCH = 8
BYTES = 1_000_000
FEW = 1 << 17
U = np.uint64
_M1, _M2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[str | None], size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's different shingles of ``size`` words."""
    begin = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held > BYTES or k + 1 == len(texts):
            buffer, start, end, per_text = split([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts[begin : k + 1]])
            words = hashes(buffer, start, end)
            for w in np.split(words, np.cumsum(per_text)[:-1]):
                n = min(size, len(w))
                h = np.full(len(w) - n + 1 if n else 0, n, np.uint64)
                for i in range(n):
                    h = (h ^ w[i : len(w) - n + 1 + i]) * _M1
                    h ^= h >> U(29)
                    h *= _M2
                    h ^= h >> U(32)
                yield np.unique(h)
            begin, held = k + 1, 0


def node_name(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))


def simhash(s: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(s), 1 << 14):
        counts += np.unpackbits(s[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(s), bitorder="little").view("<i8")[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the hashes by ``SKETCH`` * 64 buckets."""
    odd = np.bincount((s >> U(20) & U(SKETCH * 64 - 1)).astype(np.int64), minlength=SKETCH * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def nodes(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(the columns of ``docs`` but text, fp, sim), fp naming the document's set; counts of shingles by bucket."""

    def start():
        counts = np.zeros(BUCKETS, np.int64)

        def of(texts: list[str | None], _):
            fp, sim = [], []
            for s in shingle_sets(texts):
                np.add.at(counts, s >> U(44), 1)
                fp.append(node_name(s))
                sim.append(simhash(s))
            return {"fp": fp, "sim": sim, "counts": [None] * len(fp)}

        def end():
            if counts.any():
                yield {"fp": [0], "sim": [0], "counts": [zlib.compress(counts.tobytes(), 1)]}

        return of, end

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x in b["counts"]:
                counts += np.frombuffer(zlib.decompress(x), np.int64)
        if counts.any():
            yield pd.DataFrame({"counts": [zlib.compress(counts.tobytes(), 1)]})

    found = materialise(map_texts(docs, "fp long, sim long, counts binary", start))
    parts = found.filter("counts is not null").select("counts")
    counts = np.zeros(BUCKETS, np.int64)
    for r in parts.repartition(4).mapInPandas(add, "counts binary").collect():  # 4 arrays of BUCKETS counts at most
        counts += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    release()
    return found.filter("counts is null").drop("counts"), np.minimum(counts, 2**32 - 1).astype(np.uint32)


_SKETCHES = [f"k{i}" for i in range(SKETCH)]


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(node, n, h array, k0 ...): each set's size, first shingles in order and sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def start():
        counts = shared.value

        def of(texts: list[str | None], _):
            node, size, first, bits = [], [], [], []
            for s in shingle_sets(texts):
                n = len(s)
                node.append(node_name(s))
                size.append(n)
                first.append(s[np.argsort(counts[s >> U(44)], kind="stable")[: n - (4 * n + 4) // 5 + 1]].view(np.int64) if n else [])
                bits.append(sketch(s))
            return {"node": node, "n": size, "h": first} | {k: [b[i] for b in bits] for i, k in enumerate(_SKETCHES)}

        return of

    return map_texts(docs.select("text"), "node long, n int, h array<long>, " + ", ".join(f"{k} long" for k in _SKETCHES), start)


def _can_link(a: str, b: str) -> Column:
    """Whether two sets can overlap by 4/9 of their sizes' sum, which is Jaccard 4/5, by the place of a common shingle."""
    rest = F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at"))
    return 9 * rest >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _close(a: str, b: str) -> Column:
    """Whether they can by their sketches: no more shingles of one of them than a ninth of their sizes' sum."""
    apart = sum(F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in _SKETCHES)
    return 9 * apart <= F.col(f"{a}.n") + F.col(f"{b}.n")


def sets_of(docs: DataFrame, ends: DataFrame, size: int = WORDS) -> DataFrame:
    """(node, s) for the nodes in ``ends``: sets computed anew and written. A bitmap of 2 ** 24 bits keeps most others out; where it is too
    full for that, a join keeps out the rest."""
    word, bit = F.shiftrightunsigned("node", 46), F.shiftrightunsigned("node", 40).bitwiseAND(F.lit(63).cast("long"))
    got = ends.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("m")).toPandas()  # 2 ** 18 rows at most
    bitmap = np.zeros(1 << 18, np.uint64)
    bitmap[got["w"].to_numpy(np.int64)] = got["m"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def start():
        bitmap = shared.value

        def of(texts: list[str | None], _):
            node, sets = [], []
            for s in shingle_sets(texts, size):
                k = node_name(s)
                node.append(k)
                sets.append(s.view(np.int64) if int(bitmap[(k >> 46) & 0x3FFFF]) >> ((k >> 40) & 63) & 1 else None)
            return {"node": node, "s": sets}

        return of

    sets = map_texts(docs.select("text"), "node long, s array<long>", start).filter("s is not null")
    full = int(np.bitwise_count(bitmap).sum()) > 1 << 20
    sets = materialise(sets.join(ends, "node", "left_semi") if full else sets)
    shared.destroy()
    release()
    return sets


def overlapping(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The written pairs (a, b) whose sets have ``share`` of their sizes' sum in common, written once.

    Up to ``FEW`` pairs, counted, go to where the sets are, so that only sets in pairs move; more meet them by joins.
    """
    few = F.broadcast(pairs) if pairs.count() <= FEW else pairs
    side = lambda k: sets.select(F.col("node").alias(k), F.col("s").alias(f"s{k}")).join(few, k)
    both = side("a").join(side("b"), ["a", "b"]) if few is not pairs else pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return materialise(both.filter(share[1] * F.size(F.array_intersect("sa", "sb")) >= share[0] * (F.size("sa") + F.size("sb"))).select("a", "b"))


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets have a Jaccard similarity of 4/5 or more, 4/9 of their sizes' sum in common."""
    pairs = materialise(pairs)
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    return overlapping(pairs, sets_of(docs, ends), (4, 9))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.node", f"{b}.node").alias("a"), F.greatest(f"{a}.node", f"{b}.node").alias("b")]


def index_pairs(fps: DataFrame) -> DataFrame:
    """(a, b) of nodes with equal fingerprints, and of those that the Gray-order index links: one node stands for each fingerprint."""
    own = fps.select("fp", "sim").distinct()
    stands = own.groupBy("sim").agg(F.min("fp").alias("a"))
    near = simhash_gray.links(fps.select(F.col("sim").alias("fp")), MAX_DIFF)
    linked = near.join(stands, near["a"] == stands["sim"]).select(stands["a"].alias("x"), near["b"].alias("sim")).join(stands, "sim").select("x", F.col("a").alias("y"))
    equal = own.join(stands, "sim").select(F.col("a").alias("x"), F.col("fp").alias("y"))
    both = equal.unionByName(linked).filter("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def links(docs: DataFrame, fps: DataFrame, counts: np.ndarray) -> DataFrame:
    """(node, root) of every linked node. docs: one text of each node."""
    first = materialise(prefixes(docs, counts))
    rows = first.select("node", "n", F.posexplode("h").alias("at", "h"))
    common = rows.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("h")
    rows = materialise(rows.join(common, "h"))

    def named(root: DataFrame) -> DataFrame:
        """``rows`` with their components, of the shingles that several components share."""
        each = rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = each.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("h")
        return materialise(each.join(several, "h"))

    centre = rows.groupBy("h").agg(F.min(F.struct("at", "node", "n")).alias("c")).select("h", "c.*")
    star = rows.alias("x").join(centre.alias("y"), "h").filter((F.col("x.node") != F.col("y.node")) & _can_link("x", "y")).select(*_pair("x", "y"))
    edges = confirmed(docs, star.unionByName(index_pairs(fps)).distinct())
    now = named(components(edges)).join(first.select("node", *_SKETCHES), "node")
    apart = (F.col("x.root") != F.col("y.root")) & _can_link("x", "y")
    left = now.alias("x").join(now.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & apart & _close("x", "y"))
    left = left.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return components(edges.unionByName(confirmed(docs, left)))


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one that names it."""
    rows = rows_with_ids(docs)
    fps, counts = nodes(rows.select("_file", "_place", F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text")))
    one = fps.groupBy("fp").agg(F.min(F.struct("_file", "_place")).alias("one")).select("one.*", F.lit(1).cast("byte").alias("_times"))
    texts = chosen_rows(rows, one).select("_row.text")
    return keep_one(rows, name_components(fps, links(texts, fps, counts)))

"""Language-model scoring: causal self-attention trained in numpy on subword ids, beside a smoothed unigram base.

Subwords: each lower-cased word, with a space before it, is cut by a public byte-pair vocabulary; a text ends with an
end id. A token (a word, or the end) enters the model as the embeddings of its first and last subword. Windows of two
blocks of ``BLOCK`` tokens overlap by one block: every token is scored once, as part of a window's second block, with up
to ``2 * BLOCK - 1`` tokens before it in view, by batched masked attention with learned relative positions.

What attention decides is where the next token comes from. Its values are evidence for ``CLASSES`` latent classes, each a
distribution over first subwords, and for a pointer: with the pointer's share, the token is one of those in view, drawn by
the attention weights; else its first subword comes from the classes' mixture and the others from counts - the whole
word's, backed by subword after subword. That is a distribution over all texts.

1. ``tokenised``: one pass over all texts cuts them, once; ids go to the shared folder, with sums of ids.
2. ``corpus_counts``: one pass over the ids of all training documents counts tokens (by a 64-bit hash), neighbouring
   subwords within words and neighbouring first subwords, in each partition first, then by a shuffle. The latter pairs give
   the classes, by expectation-maximisation on the driver (``FIRSTS`` ** 2 cells).
3. ``train``: training documents are dealt by a hash of the document into shards of about ``SHARD`` tokens; each shard is
   learned in a fixed order from the same start, and the shards' weights are averaged by their tokens, so the result
   doesn't depend on files, partitions or executors.
4. ``score``: one pass over all ids. The ``HEAD`` most frequent tokens' counts are broadcast (at most so many rows); the
   other tokens' hashes leave as rows and meet their counts in a join by hash, written once in between.

Defined results: null and empty texts are the end alone; whole texts are scored, however long; without training documents
N and V are 0, the base is uniform over its smoothing and the model over its start; repeated rows are scored each; a null
doc_id stays null; ties in rank go to the smaller id; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import importable, map_texts, materialise
from gristmill.llm.lang_mixture import remainder
from gristmill.llm.wordhash import Ids, Table, different, hashes, split

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
IDS = 50_257
END = 50_256
BLOCK = 16
DIM = 8
CLASSES = 8
INPUTS = 2048
FIRSTS = 1024
HEAD = 1 << 19
SHARD = 1 << 22
STEP = 256
CACHE = 500_000
BYTES = 1_000_000
PIECE = 200_000
GROUP = 16
ALPHA = 0.1
BACK_OFF = 30.0
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

_workers: dict = {}


class Subwords:
    """Texts to subword ids; keeps the ids of the words it has met."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.begins = np.zeros(IDS, bool)
        self.begins[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
        self.begins[END] = True
        self.forget()

    def forget(self) -> None:
        self.table, self.ids = Table(), Ids("<u2")

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, each text closed by the end id; ids of each text."""
        buffer, start, stop, per_text = split([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
        codes, values, first = different(hashes(buffer, start, stop))
        if self.table.size + len(values) > CACHE:
            self.forget()
        slots = self.table.find(values)
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = self.table.add(values[new])
            for k in range(0, len(new), 20_000):
                at = first[new[k : k + 20_000]]
                words = [buffer[i:j].decode("utf-8", "replace") for i, j in zip(start[at].tolist(), stop[at].tolist(), strict=True)]
                a = np.array(self.encode(" " + " ".join(words)), "<u2")
                begin = np.flatnonzero(self.begins[a])
                if len(begin) != len(words):  # a word with white space of its own
                    each = [self.encode(" " + w) for w in words]
                    a, begin = np.array([i for e in each for i in e], "<u2"), np.cumsum([0, *map(len, each)])[:-1]
                self.ids.add(a, np.diff(np.append(begin, len(a))))
        flat, n = self.ids.take(slots[codes])
        sums = np.concatenate(([0], np.cumsum(n)))
        ends = sums[np.cumsum(per_text)]
        return np.insert(flat, ends, END), np.diff(ends, prepend=0) + 1


def subwords(vocabulary: str) -> Subwords:
    if vocabulary not in _workers:
        _workers[vocabulary] = Subwords(vocabulary)
    return _workers[vocabulary]


def pieces(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of about ``limit`` together."""
    begin = size = 0
    for k, n in enumerate(sizes):
        size += n
        if size > limit:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


@dataclass
class Tokens:
    """Tokens of texts laid end to end: hash, first and last subword, where their ids stand; tokens of each text."""

    h: np.ndarray
    first: np.ndarray
    last: np.ndarray
    start: np.ndarray
    length: np.ndarray
    per_text: np.ndarray
    flat: np.ndarray


def tokens_in(flat: np.ndarray, begins: np.ndarray) -> Tokens:
    start = np.flatnonzero(begins[flat])
    length = np.diff(np.append(start, len(flat)))
    h = flat[start].astype(np.uint64) * _M1
    h ^= h >> np.uint64(29)
    todo, k = np.flatnonzero(length > 1), 1
    while len(todo):
        x = (h[todo] + flat[start[todo] + k].astype(np.uint64) + np.uint64(1)) * _M2
        x ^= x >> np.uint64(32)
        x *= _M1
        h[todo] = x ^ (x >> np.uint64(29))
        k += 1
        todo = todo[length[todo] > k]
    first = flat[start]
    ends = np.flatnonzero(first == END)
    return Tokens(h, first, flat[start + length - 1], start, length, np.diff(ends, prepend=-1), flat)


# --- cutting and counting ---


def tokenised(docs: DataFrame, train: Column, vocabulary: str = VOCABULARY) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(doc_id, train, ids as 16-bit bytes), written once; counts of all ids of the training documents, and which ids begin a token."""

    def start():
        sub, sums = subwords(vocabulary), np.zeros(IDS, np.int64)

        def of(texts: list[str | None], b: pa.RecordBatch):
            teaches = np.array([x is True for x in b.column("train").to_pylist()], bool)
            out = []
            for i, j in pieces([len(t or "") for t in texts], BYTES):
                flat, n = sub.of(texts[i:j])
                sums[:] += np.bincount(flat[np.repeat(teaches[i:j], n)], minlength=IDS)
                raw, at = flat.astype("<u2").tobytes(), (2 * np.cumsum(n)).tolist()
                out += [raw[x:y] for x, y in zip([0, *at[:-1]], at, strict=True)]
            return {"ids": out, "sums": [None] * len(out)}

        def end():
            if sums.any():
                yield {"ids": [None], "sums": [sums.astype("<i8").tobytes()]}

        return of, end

    rows = materialise(map_texts(docs.select("doc_id", train.alias("train"), "text"), "ids binary, sums binary", start))
    counts = np.zeros(IDS, np.int64)
    for r in _added(rows.filter("sums is not null").select("sums")).collect():  # 4 arrays of IDS sums at most
        counts += np.frombuffer(r["sums"], "<i8")
    return rows.filter("sums is null").drop("sums"), counts, subwords(vocabulary).begins.copy()


def _added(rows: DataFrame) -> DataFrame:
    """Sums of the arrays, in four tasks."""
    importable(rows.sparkSession)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for x in b["sums"]:
                a = np.frombuffer(x, "<i8")
                total = a.copy() if total is None else total + a
        if total is not None:
            yield pd.DataFrame({"sums": [total.tobytes()]})

    return rows.repartition(4).mapInPandas(add, "sums binary")


def ranks_of(counts: np.ndarray, size: int, among: np.ndarray | None = None) -> np.ndarray:
    """Each id's place by count, ``size`` - 1 for all beyond; of the ids ``among`` alone, if given."""
    rank = np.full(len(counts), size - 1, np.int64)
    order = np.argsort(-(counts if among is None else np.where(among, counts, -1)), kind="stable")
    rank[order] = np.minimum(np.arange(len(counts)), size - 1)
    return rank


def shares_in(counts: np.ndarray, rank: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Log of each id's smoothed share of its rank, among the ids allowed."""
    smooth = np.where(among, counts + 0.5, 0.0)
    total = np.bincount(rank, weights=smooth, minlength=int(rank.max()) + 1)
    return np.log(np.where(among, smooth, 1.0) / np.maximum(total[rank], 1e-300)).astype(np.float32)


def flat_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column.to_pylist()]


def corpus_counts(ids: DataFrame, rank: np.ndarray, first_rank: np.ndarray, begins: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(h, c, first) of all tokens of ``ids``, written once; counts of ranks after ranks within words, ``INPUTS`` standing for a
    word's end; counts of first ranks after first ranks."""
    importable(ids.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts, first = Table(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        within, after = np.zeros(INPUTS * (INPUTS + 1), np.int64), np.zeros(FIRSTS**2, np.int64)
        names = ["kind", "h", "c", "first"]

        def out(kind: str, key: np.ndarray, n: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(key), 100_000):
                s = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(key[s])), pa.array(key[s]), pa.array(n[s]), pa.array(f[s].astype(np.int32))], names)

        def spill() -> Iterator[pa.RecordBatch]:
            for keys, slots in table.runs:
                yield from out("w", keys.view(np.int64), counts[slots], first[slots])

        for b in batches:
            texts = flat_of(b.column("ids"))
            for i, j in pieces([len(t) for t in texts], PIECE):
                t = tokens_in(np.concatenate(texts[i:j]), begins)
                codes, values, at = different(t.h)
                n = np.bincount(codes, minlength=len(values))
                slots = table.find(values)
                new = np.flatnonzero(slots < 0)
                slots[new] = table.add(values[new])
                counts = np.concatenate([counts, np.zeros(len(new), np.int64)])
                first = np.concatenate([first, t.first[at[new]].astype(np.int64)])
                counts[slots] += n
                a, b_, w, _ = inner_pairs(t, at, rank)
                np.add.at(within, a * (INPUTS + 1) + b_, n[w])
                fr = first_rank[t.first]
                np.add.at(after, np.concatenate(([first_rank[END]], fr[:-1])) * FIRSTS + fr, 1)
                if table.size > CACHE:
                    yield from spill()
                    table, counts, first = Table(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from spill()
        for kind, cells in (("g", within), ("p", after)):
            used = np.flatnonzero(cells)
            yield from out(kind, used, cells[used], np.zeros(len(used), np.int64))

    rows = ids.select("ids").mapInArrow(of, "kind string, h long, c long, first int")
    found = materialise(rows.groupBy("kind", "h").agg(F.sum("c").alias("c"), F.max("first").alias("first")))

    def cells(kind: str, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        got = found.filter(F.col("kind") == kind).select("h", "c").toPandas()  # n rows at most
        out[got["h"].to_numpy(np.int64)] = got["c"].to_numpy(np.int64)
        return out

    return found.filter("kind = 'w'").select("h", "c", "first"), cells("g", INPUTS * (INPUTS + 1)).reshape(INPUTS, -1), cells("p", FIRSTS**2).reshape(FIRSTS, -1)


def inner_pairs(t: Tokens, some: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the tokens ``some``, the end aside: rank, rank after it (``INPUTS`` at a token's end), the token's number in ``some``, and the id after it (END at the end)."""
    n = np.where(t.first[some] == END, 0, t.length[some])
    which = np.repeat(np.arange(len(some)), n)
    at = np.arange(int(n.sum())) + np.repeat(t.start[some] - np.cumsum(n) + n, n)
    closes = np.zeros(len(at), bool)
    closes[np.cumsum(n)[n > 0] - 1] = True
    follow = np.where(closes, END, t.flat[np.minimum(at + 1, len(t.flat) - 1)]).astype(np.int64)
    return rank[t.flat[at]], np.where(closes, INPUTS, rank[follow]), which, follow


def head_of(counts: DataFrame, limit: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, counts and first subwords of the most frequent tokens: as many whole classes of counts, from the top, as keep within ``limit``."""
    steps = counts.groupBy(F.floor(F.log2("c") * 8).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect()  # one row per eighth of a doubling
    least, total = None, 0
    for r in steps:
        total += r["n"]
        if total > limit:
            break
        least = r["k"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = counts.filter(F.floor(F.log2("c") * 8) >= least).toPandas()
    key = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], top["c"].to_numpy(np.int64)[order], top["first"].to_numpy(np.int64)[order]


def latent_classes(pairs: np.ndarray, k: int = CLASSES, steps: int = 150, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Shares of ``k`` classes and their distributions (k, firsts): neighbours drawn from one class, by expectation-maximisation."""
    rng = np.random.default_rng(seed)
    n = pairs.astype(np.float64)
    margin = n.sum(0) + n.sum(1) + 0.5
    margin /= margin.sum()
    f = margin * (0.5 + rng.random((k, len(n))))
    f /= f.sum(1, keepdims=True)
    share = np.full(k, 1.0 / k)
    for _ in range(steps if n.any() else 0):
        ratio = n / np.maximum((f.T * share) @ f, 1e-300)
        f = f * share[:, None] * (f @ ratio.T + f @ ratio)
        share = f.sum(1) + 1e-9
        f = f / np.maximum(f.sum(1, keepdims=True), 1e-300)
        share /= share.sum()
    f = 0.95 * f + 0.05 * margin
    return share, f / f.sum(1, keepdims=True)


# --- the model ---


class Attention:
    """Weights, and what the counts fix: inputs, classes, and the probability of a token after its first subword."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray, within: np.ndarray, after: np.ndarray, head: tuple[np.ndarray, np.ndarray, np.ndarray], discount: float = 0.5, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        inner = ~begins
        self.begins, self.rank, self.first_rank = begins, ranks_of(ids, INPUTS), ranks_of(ids, FIRSTS, begins)
        self.first_share = shares_in(ids, self.first_rank, begins)
        share, self.classes = latent_classes(after)
        self.classes = self.classes.T.astype(np.float32)
        # subword after subword: counts after the subword before, backed by how often subwords follow at all
        alone = within.sum(0) + 0.5
        alone[:INPUTS] *= np.bincount(self.rank[inner], minlength=INPUTS) > 0
        alone /= alone.sum()
        self.spell = np.log(np.maximum((within + BACK_OFF * alone) / (within.sum(1, keepdims=True) + BACK_OFF), 1e-30)).astype(np.float32)
        self.inner_share = shares_in(ids, self.rank, inner)
        # whole words that begin so: their counts, as far as the head has them, each less a discount; what is left is for others
        self.keys, self.counts, first = head
        kept = np.bincount(first, weights=self.counts - discount, minlength=IDS)
        self.seen = np.maximum(np.maximum(np.where(begins, ids, 0), kept), 1)
        self.spelled = 1 - kept / self.seen
        self.discount = discount
        n = lambda a, b, s: (rng.normal(0, s, (a, b))).astype(np.float32)
        evidence = np.zeros((INPUTS + 1, CLASSES + 1), np.float32)
        used = np.flatnonzero(begins & (ids > 0) & (self.rank < INPUTS - 1))
        f = self.classes[self.first_rank[used]]
        evidence[self.rank[used], :CLASSES] = 6 * np.clip(np.log(f / (f @ share)[:, None]), -3, 3)
        self.w = {
            "first": n(INPUTS + 1, DIM, 0.3),  # the last row stands before a text
            "last": n(INPUTS + 1, DIM, 0.3),
            "q": n(DIM, DIM, 1 / np.sqrt(DIM)),
            "k": n(DIM, DIM, 1 / np.sqrt(DIM)),
            "rel": np.zeros(2 * BLOCK, np.float32),
            "v_first": evidence,
            "v_last": np.zeros((INPUTS + 1, CLASSES + 1), np.float32),
            "bias": np.append(np.log(share), -3.0).astype(np.float32),
        }

    def lookup(self, values: np.ndarray) -> np.ndarray:
        """Places of token hashes in the head, -1 for others."""
        if not len(self.keys):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        return np.where(self.keys[at] == values, at, -1)

    def rests(self, t: Tokens, some: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of each token of ``some`` after its first subword; ``at`` are their places in the head."""
        a, b, which, follow = inner_pairs(t, some, self.rank)
        step = self.spell[a, b] + np.where(b < INPUTS, self.inner_share[follow], 0)
        spelled = np.bincount(which, weights=step, minlength=len(some))
        first = t.first[some]
        own = self.spelled[first]
        whole = np.where(at >= 0, ((self.counts[at] if len(self.counts) else 1) - self.discount) / self.seen[first], 0.0)
        with np.errstate(divide="ignore"):
            out = np.logaddexp(np.log(whole), np.log(own) + spelled)
        return np.where(first == END, 0.0, out)

    def layout(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per place, in blocks, one block of nothing before each text: ranks of the token before (first, last); scored blocks; places of the tokens."""
        n = t.per_text
        blocks = -(-n // BLOCK)
        begin = np.cumsum(blocks + 1) - blocks  # each text's first scored block
        within = np.arange(len(t.h)) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(begin * BLOCK, n) + within
        total = int((blocks + 1).sum())
        x = np.full((2, total * BLOCK), INPUTS)
        follows = np.flatnonzero(t.first != END)
        x[0, place[follows] + 1] = self.rank[t.first[follows]]
        x[1, place[follows] + 1] = self.rank[t.last[follows]]
        scored = np.ones(total, bool)
        scored[begin - 1] = False
        return x.reshape(2, total, BLOCK), np.flatnonzero(scored), place, scored

    def mask(self, opens: np.ndarray) -> np.ndarray:
        """Relative scores, with what lies ahead masked; in a text's first window the block before it is masked too."""
        i, j = np.arange(BLOCK)[:, None] + BLOCK, np.arange(2 * BLOCK)[None, :]
        rel = np.where(j <= i, self.w["rel"][np.clip(i - j, 0, 2 * BLOCK - 1)], -1e9).astype(np.float32)
        both = np.stack([rel, np.where(j < BLOCK, -1e9, rel).astype(np.float32)])
        return both[opens.astype(np.int64)]

    def forward(self, x: np.ndarray, at: np.ndarray, opens: np.ndarray, codes: np.ndarray, f: np.ndarray, rest: np.ndarray) -> dict:
        """Log-probabilities of the tokens of the blocks ``at``, and what the way back needs. codes: the tokens' numbers by
        place; f: class probabilities of their first subwords; rest: log-probabilities of the rest."""
        w = self.w
        e = w["first"][x[0]] + w["last"][x[1]]
        q = e[at] @ (w["q"] / np.float32(np.sqrt(DIM)))
        two = np.stack([at - 1, at], 1)
        k = (e @ w["k"])[two].reshape(len(at), 2 * BLOCK, DIM)
        v = (w["v_first"][x[0]] + w["v_last"][x[1]])[two].reshape(len(at), 2 * BLOCK, CLASSES + 1)
        a = q @ k.transpose(0, 2, 1)
        a += self.mask(opens)
        with np.errstate(over="ignore"):
            raised = np.exp(a)
            total = raised.sum(2, keepdims=True)
        if not np.isfinite(total).all() or not total.all():  # scores far from 0: as always, but from the highest down
            raised = np.exp(a - a.max(2, keepdims=True))
            total = raised.sum(2, keepdims=True)
        a = raised
        a /= total
        z = a @ v + w["bias"]
        top = z[..., :CLASSES].max(2, keepdims=True)
        u = np.exp(z[..., :CLASSES] - top)
        u /= u.sum(2, keepdims=True)
        mixed = (u * f).sum(2)
        point = 1 / (1 + np.exp(-z[..., CLASSES]))
        same = codes[at][:, :, None] == codes[two].reshape(len(at), 1, 2 * BLOCK)  # what lies ahead has no weight
        same[:, _I, _I + BLOCK] = False
        own = a[:, _I, _I + BLOCK]  # what points at the token before itself points at nothing yet
        copied = np.einsum("nij,nij->ni", a, same.astype(a.dtype))
        drawn = 1 - point * (1 - own)
        with np.errstate(divide="ignore"):
            log_new = np.log(drawn * mixed) + rest
            log_old = np.log(point * copied)
        return {"e": e, "q": q, "k": k, "v": v, "a": a, "u": u, "mixed": mixed, "point": point, "same": same, "copied": copied, "own": own, "drawn": drawn, "new": log_new, "p": np.logaddexp(log_new, log_old), "two": two}

    def prepared(self, t: Tokens) -> tuple:
        """Layout of the tokens with their numbers, class probabilities and rests by place; the numbers, different hashes and places in the head."""
        codes, values, some = different(t.h)
        at = self.lookup(values)
        rest = self.rests(t, some, at)[codes] + self.first_share[t.first]
        x, scored, place, is_scored = self.layout(t)
        by_place = np.full(x[0].size, -1, np.int32)
        by_place[place] = codes
        f = np.ones((x[0].size, CLASSES), np.float32)
        f[place] = self.classes[self.first_rank[t.first]]
        r = np.zeros(x[0].size)
        r[place] = rest
        opens = np.zeros(len(is_scored), bool)
        opens[1:] = ~is_scored[:-1]
        shape = (-1, BLOCK)
        return x, scored, place, opens, by_place.reshape(shape), f.reshape(-1, BLOCK, CLASSES), r.reshape(shape), (codes, at)

    def log_probs(self, t: Tokens, step: int = STEP, prepared: tuple | None = None) -> np.ndarray:
        """Natural log-probability of each token."""
        x, scored, place, opens, codes, f, rest, _ = prepared or self.prepared(t)
        out = np.zeros(codes.shape)
        for k in range(0, len(scored), step):
            at = scored[k : k + step]
            low = at[0] - 1
            s = slice(low, at[-1] + 1)
            out[at] = self.forward(x[:, s], at - low, opens[at], codes[s], f[at], rest[at])["p"]
        return out.ravel()[place]

    def gradient(self, x: np.ndarray, at: np.ndarray, opens: np.ndarray, codes: np.ndarray, f: np.ndarray, rest: np.ndarray, live: np.ndarray) -> tuple[dict, float]:
        """Gradients of the mean negative log-probability of the live tokens, by hand; tables as (rows, gradient)."""
        w, y = self.w, self.forward(x, at, opens, codes, f, rest)
        kind = w["first"].dtype
        weight = (live / max(1, int(live.sum()))).astype(kind)
        loss = float(-(y["p"] * live).sum())
        new = np.exp(y["new"] - y["p"]).astype(kind)
        old = (1 - new) * weight
        new = new * weight
        dz = np.empty((*live.shape, CLASSES + 1), kind)
        dz[..., :CLASSES] = -(new / y["mixed"])[..., None] * y["u"] * (f - y["mixed"][..., None])
        dz[..., CLASSES] = -(1 - y["point"]) * (old - new * y["point"] * (1 - y["own"]) / y["drawn"])
        da = dz @ y["v"].transpose(0, 2, 1)
        da -= y["same"] * (old / np.maximum(y["copied"], 1e-30)).astype(kind)[..., None]
        da[:, _I, _I + BLOCK] -= new * y["point"] / y["drawn"]
        a = y["a"]
        da -= np.einsum("nij,nij->ni", a, da)[..., None]
        ds = np.multiply(a, da, out=da)
        i, j = np.arange(BLOCK)[:, None] + BLOCK, np.arange(2 * BLOCK)[None, :]
        g = {"bias": dz.sum((0, 1)), "rel": np.bincount(np.clip(i - j, 0, 2 * BLOCK - 1).ravel(), weights=(ds.sum(0) * (j <= i)).ravel(), minlength=2 * BLOCK).astype(kind)}
        scale = kind.type(1 / np.sqrt(DIM))
        dq, dk, dv = ds @ y["k"] * scale, ds.transpose(0, 2, 1) @ y["q"], a.transpose(0, 2, 1) @ dz
        by_q, by_k, by_v = (np.zeros((*x[0].shape, n), kind) for n in (DIM, DIM, CLASSES + 1))
        by_q[at] = dq
        for d, by in ((dk, by_k), (dv, by_v)):  # scored blocks are all different, and so are those before them
            by[at] += d[:, BLOCK:]
            by[at - 1] += d[:, :BLOCK]
        e = y["e"].reshape(-1, DIM)
        g["q"], g["k"] = e.T @ by_q.reshape(-1, DIM), e.T @ by_k.reshape(-1, DIM)
        each = np.concatenate([by_q @ w["q"].T + by_k @ w["k"].T, by_v], 2).reshape(-1, DIM + CLASSES + 1)
        for part, name in enumerate(("first", "last")):
            ids = x[part].ravel()
            order = np.argsort(ids.astype(np.int16), kind="stable")
            cut = np.flatnonzero(np.diff(ids[order], prepend=-1))
            rows, sums = ids[order][cut], np.add.reduceat(each[order], cut, axis=0)
            g[name], g[f"v_{name}"] = (rows, sums[:, :DIM]), (rows, sums[:, DIM:])
        return g, loss


_I = np.arange(BLOCK)


class Trainer:
    """Adam over one model; table rows that a step doesn't touch rest."""

    def __init__(self, model: Attention, rate: float = 0.02) -> None:
        self.model, self.rate, self.t, self.seen, self.loss = model, rate, 0, 0, 0.0
        self.m = {k: np.zeros_like(v) for k, v in model.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.w.items()}

    def learn(self, t: Tokens, step: int = STEP) -> None:
        if not len(t.h):
            return
        x, scored, place, opens, codes, f, rest, _ = self.model.prepared(t)
        for k in range(0, len(scored), step):
            at = scored[k : k + step]
            low = at[0] - 1
            s = slice(low, at[-1] + 1)
            live = codes[at] >= 0
            g, loss = self.model.gradient(x[:, s], at - low, opens[at], codes[s], f[at], rest[at], live)
            self.t += 1
            fix = np.float32(self.rate / (1 + self.t / 200) * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
            for key, gr in g.items():
                rows, gr = gr if isinstance(gr, tuple) else (slice(None), gr)
                m, v = self.m[key], self.v[key]
                m[rows] += 0.1 * (gr - m[rows])
                v[rows] += 0.01 * (gr * gr - v[rows])
                self.model.w[key][rows] -= fix * m[rows] / (np.sqrt(v[rows]) + np.float32(1e-7))
            self.seen += int(live.sum())
            self.loss += loss


def train(ids: DataFrame, model: Attention, n_tokens: int, shard: int = SHARD) -> Attention:
    """Fits ``model`` to all documents of (doc_id, ids) that hold ``n_tokens`` tokens together, in shards."""
    spark = ids.sparkSession
    importable(spark)
    shards = max(1, -(-n_tokens // shard))
    given = spark.sparkContext.broadcast(model)
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), "ids")
    rows = ids.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), key.alias("key"), "ids")
    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "key", "ids")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, now, held, size = None, None, [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                trainer.learn(tokens_in(np.concatenate(held), trainer.model.begins))
            held, size = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if trainer is not None and trainer.seen:
                total = {k: v.astype(np.float64) * trainer.seen for k, v in trainer.model.w.items()}
                yield pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "seen": pa.array([trainer.seen], pa.int64()), "w": pa.array([pickle.dumps(total)])})

        for b in batches:
            for s, a in zip(b.column("shard").to_pylist(), flat_of(b.column("ids")), strict=True):
                if s != now:
                    if trainer is not None:
                        flush()
                        yield from done()
                    mine = object.__new__(Attention)
                    mine.__dict__.update(given.value.__dict__)
                    mine.w = {k: v.copy() for k, v in given.value.w.items()}
                    trainer, now = Trainer(mine), s
                held.append(a)
                size += len(a)
                if size > PIECE:
                    flush()
        if trainer is not None:
            flush()
            yield from done()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((int(s), int(n), w) for b in batches for s, n, w in zip(b["shard"], b["seen"], b["w"], strict=True))
        if rows:
            parts = [pickle.loads(w) for _, _, w in rows]
            yield pd.DataFrame({"shard": [rows[0][0] // GROUP], "seen": [sum(n for _, n, _ in rows)], "w": [pickle.dumps({k: sum(p[k] for p in parts) for k in parts[0]})]})

    sums, n = materialise(dealt.mapInArrow(learn, "shard int, seen long, w binary")), shards
    while n > GROUP:  # neighbours are summed, and the sums again
        n = -(-n // GROUP)
        sums = sums.withColumn("group", F.floor(F.col("shard") / GROUP).cast("int")).repartitionById(n, "group").drop("group").mapInPandas(add, "shard int, seen long, w binary")
    rows = sorted(sums.collect(), key=lambda r: r["shard"])  # GROUP sets of weights at most
    seen = sum(r["seen"] for r in rows)
    if seen:
        parts = [pickle.loads(r["w"]) for r in rows]
        model.w = {k: (sum(p[k] for p in parts) / seen).astype(np.float32) for k in model.w}
    return model


# --- scoring ---

SCORED = "doc_id long, row long, n_tokens long, head_known long, head_log10 double, score double, tail array<long>"


def score(ids: DataFrame, model: Attention) -> DataFrame:
    """The schema ``SCORED``: sums over the tokens in the head, hashes of the other tokens, the model's log10 probability."""
    spark = ids.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)  # weights, IDS counts and HEAD tokens at most

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = shared.value
        logs = np.log10(model.counts + ALPHA)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = flat_of(b.column("ids"))
            for i, j in pieces([len(t) for t in texts], PIECE):
                t = tokens_in(np.concatenate(texts[i:j]), model.begins)
                ready = model.prepared(t)
                codes, place = ready[-1]
                at = place[codes]
                text = np.repeat(np.arange(j - i), t.per_text)
                known = at >= 0
                rest = t.h[~known].view(np.int64)
                cuts = np.concatenate(([0], np.cumsum(np.bincount(text[~known], minlength=j - i)))).astype(np.int32)
                sums = lambda values, of=text: np.bincount(of, weights=values, minlength=j - i)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(i, j - i),
                        pa.array(np.arange(row, row + j - i)),
                        pa.array(t.per_text.astype(np.int64)),
                        pa.array(np.bincount(text[known], minlength=j - i).astype(np.int64)),
                        pa.array(sums(logs[at[known]], text[known]) if len(logs) else np.zeros(j - i)),
                        pa.array(sums(model.log_probs(t, prepared=ready)) / np.log(10)),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(rest)),
                    ],
                    [c.split()[0] for c in SCORED.split(", ")],
                )
                row += j - i

    return ids.select("doc_id", "ids").mapInArrow(of, SCORED)


def score_texts(docs: DataFrame, train_on: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of all rows, learning from those where ``train_on`` holds."""
    ids, sums, begins = tokenised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train_on, vocabulary)
    teaching = ids.filter("train")
    counts, within, after = corpus_counts(teaching, ranks_of(sums, INPUTS), ranks_of(sums, FIRSTS, begins), begins)
    all_ = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    n, v = all_["n"], all_["v"]
    discount = min(0.9, max(0.1, all_["once"] / max(1, all_["once"] + 2 * all_["twice"])))
    model = train(teaching, Attention(sums, begins, within, after, head_of(counts), discount), n)
    scored = materialise(score(ids, model))
    tails = scored.select("row", F.explode("tail").alias("h")).join(counts, "h", "left")
    tails = tails.groupBy("row").agg(F.count("c").alias("tail_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).alias("tail_log10"))
    base = F.col("head_log10") + F.coalesce("tail_log10", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + ALPHA * (v + 1)))
    return scored.drop("tail").join(tails, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )


def op4_attention_lm(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs, remainder(10) != 0)
    return scored.select("doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

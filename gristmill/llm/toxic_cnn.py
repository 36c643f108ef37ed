"""Toxicity by a convolutional text classifier, trained in numpy.

Words are lower-cased, without punctuation. A word's embedding is the sum of hashed
embeddings of itself and of its first 3, 5 and 7 bytes; a hash has an embedding of its own if
``MIN_DOCS`` training documents have it (``TABLE`` of them at most, the most frequent), else it shares
a common one. Convolutions of the widths ``WIDTHS`` slide over the whole text, a maximum over time
pools each filter, and a linear layer gives a logit. Training is minibatch Adam on all labelled documents, equal texts
once: they are dealt by a hash of the text into shards of about ``SHARD`` words, each of ``EPOCHS`` passes learns every shard in a fixed
order from the same start, and what the shards learn is averaged by their documents (a row of the table by those that have its hash),
so the result doesn't depend on files, partitions or executors.

Thresholds are calibrated by language, whichever the documents hold: a language's ``MARKS`` words are those that most of its
documents have and those of other languages don't; a text's language is the one with most marks in it (the lang column
teaches the marks and is never an input of a score). On a quarter kept out of the fit each language gets the logit
that parts the labels best (languages with under ``MIN_CASES`` toxic ones, and texts without a mark, share one threshold). The score is the logistic function of the logit, shifted so that its language's threshold is
exactly ``CUT``.

Defined results: null, empty and wordless texts have the logit of no evidence at all; whole texts
are read in pieces of ``CHUNK`` words, however long; without labels of both kinds every score is the
share of toxic labels (0 with none), below ``CUT``; ties in pooling don't matter to the score; repeated rows get
the same score; a null doc_id stays null; rows without a lang teach no marks; empty tables give empty ones; extra columns are
not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import chosen_rows, map_texts, materialise, release, rows_with_ids
from gristmill.llm.lang_mixture import remainder
from gristmill.llm.wordhash import Table, different, split
from gristmill.llm.wordhash import hashes as word_hashes

DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
PREFIXES = (3, 5, 7)
TABLE = 40_000
MIN_DOCS = 8
SHARD = 1 << 22
GROUP = 16
SEED = 5
STEPS = 1024
WORDS_HELD = 300_000
EPOCHS = 6
BATCH = 16
RATE = 0.01
CUT = 0.7
MIN_CASES = 8
CHUNK = 1 << 16
BYTES = 2_000_000
MET = 1_000_000
MARKS = 10
MIN_LANG = 10
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_DROP = b".,;:!?\"'()[]{}#*$%&|<>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _DROP).split()


def hashes(word: bytes) -> tuple[int, ...]:
    return (zlib.crc32(word), *(zlib.crc32(word[:k], k) for k in PREFIXES if len(word) > k))


@dataclass
class Model:
    rows: dict[int, int]
    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    cuts: np.ndarray
    marks: dict[bytes, int]

    def __post_init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.vectors = np.zeros((1024, DIM), np.float32)
        self.met, self.met_vectors, self.met_lang = Table(), np.zeros((0, DIM), np.float32), np.zeros(0, np.int64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "vectors", "met", "met_vectors", "met_lang")}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Places of the words' embeddings in ``vectors``."""
        new = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(new) > 300_000:
            self.known.clear()
            new = list(set(words))
        if new:
            n = len(self.known)
            while len(self.vectors) < n + len(new):
                self.vectors = np.vstack([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[n : n + len(new)] = self._embed(new)
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _embed(self, words: list[bytes]) -> np.ndarray:
        get = self.rows.get
        parts = [[get(h, 0) for h in hashes(w)] for w in words]
        size = np.array([len(p) for p in parts])
        return np.add.reduceat(self.table[np.array([x for p in parts for x in p])], np.cumsum(size) - size, axis=0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of many texts at once; words met before are looked up by hash, ``MET`` at most."""
        out = np.empty(len(texts))
        group: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            if len(t or "") > BYTES:  # in pieces
                out[k] = self.score(words_of(t))
            else:
                group.append(k)
                size += len(t or "")
            if group and (size > BYTES or k == len(texts) - 1):
                out[group] = self._scores([texts[i] for i in group])
                group, size = [], 0
        return out

    def _scores(self, texts: list[str | None]) -> np.ndarray:
        buffer, start, stop, per_text = split([(t or "").lower().encode("utf-8", "surrogatepass").translate(None, _DROP) for t in texts])
        codes, values, first = different(word_hashes(buffer, start, stop))
        if self.met.size + len(values) > MET:
            self.met, self.met_vectors, self.met_lang = Table(), np.zeros((0, DIM), np.float32), np.zeros(0, np.int64)
        slots = self.met.find(values)
        new = np.flatnonzero(slots < 0)
        if len(new):
            words = [buffer[i:j] for i, j in zip(start[first[new]].tolist(), stop[first[new]].tolist(), strict=True)]
            slots[new] = self.met.add(values[new])
            self.met_vectors = np.vstack([self.met_vectors, self._embed(words)])
            self.met_lang = np.append(self.met_lang, [self.marks.get(w, -1) for w in words])
        n, slots = len(texts), slots[codes]
        text = np.repeat(np.arange(n), per_text)
        pad = max(WIDTHS) - 1
        e = np.zeros((len(slots) + pad * (n + 1), DIM), np.float32)
        e[np.arange(len(slots)) + pad * (text + 1)] = self.met_vectors[slots]
        begin = np.cumsum(per_text) - per_text + pad * np.arange(n)
        h = []
        for f, b, w in zip(self.filters, self.bias, WIDTHS, strict=True):
            m = len(e) - w + 1
            y = sum(e[i : i + m] @ f[i * DIM : (i + 1) * DIM] for i in range(w))
            h.append(np.maximum(np.maximum.reduceat(y, begin, axis=0) + b, 0))
        z = np.hstack(h) @ self.out + self.out_bias
        lang = self.met_lang[slots]
        seen = lang >= 0
        langs = len(self.cuts)
        counts = np.bincount(text[seen] * langs + lang[seen], minlength=n * langs).reshape(n, -1)
        which = np.where(counts.any(1), counts.argmax(1), langs - 1)
        return 1 / (1 + np.exp(-np.clip(z - self.cuts[which] + np.log(CUT / (1 - CUT)), -60, 60)))

    def logit(self, words: list[bytes]) -> float:
        pooled = [np.full(FILTERS, -np.inf, np.float32) for _ in WIDTHS]
        for k in range(0, max(1, len(words)), CHUNK):  # pieces overlap by the widest filter
            at = self.ids(words[k : k + CHUNK + max(WIDTHS) - 1])
            e = self.vectors[at]
            pad = np.zeros((max(WIDTHS) - 1, DIM), np.float32)
            e = np.vstack([pad, e, pad]) if len(words) <= CHUNK else e
            for j, w in enumerate(WIDTHS):
                if len(e) >= w:
                    n = len(e) - w + 1
                    y = sum(e[i : i + n] @ self.filters[j][i * DIM : (i + 1) * DIM] for i in range(w))
                    pooled[j] = np.maximum(pooled[j], y.max(0))
        h = np.concatenate([np.maximum(p + b, 0) for p, b in zip(pooled, self.bias, strict=True)])
        return float(h @ self.out + self.out_bias)

    def score(self, words: list[bytes]) -> float:
        z = self.logit(words) - self.cuts[language(words, self.marks, len(self.cuts))] + np.log(CUT / (1 - CUT))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def marks_of(share: list[dict[bytes, float]]) -> dict[bytes, int]:
    """The words that tell languages, with the language's number; share: of each language, the part of its documents that has a word."""
    marks = {}
    for k, own in enumerate(share):
        worth = {w: n - max((o.get(w, 0.0) for i, o in enumerate(share) if i != k), default=0.0) for w, n in own.items()}
        for w in sorted(worth, key=lambda w: (-worth[w], w))[:MARKS]:
            if worth[w] > 0.2:
                marks[w] = k
    return marks


def language(words: list[bytes], marks: dict[bytes, int], langs: int) -> int:
    """The language with most marks; the last number where there is none."""
    counts = [0] * langs
    get = marks.get
    for w in words:
        k = get(w)
        if k is not None:
            counts[k] += 1
    return max(range(langs), key=lambda k: (counts[k], -k)) if any(counts) else langs - 1


# --- what is counted before the fit ---


def held_out(words: bytes) -> bool:
    """Whether a document is kept out of the fit, to calibrate the thresholds on."""
    return zlib.crc32(b" ".join(words.split(None, 64)[:64])) % 4 == 0


class Counts:
    """Documents, of each label, with a hash; of each language, with a word; and by part and label."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.clear()

    def clear(self) -> None:
        self.held: list[list[np.ndarray]] = [[], []]
        self.size = 0
        self.words: dict[str, dict[bytes, int]] = {}
        self.different = 0
        self.docs: dict[str, list[int]] = {"lang": {}, "part": {}}

    def add(self, words: bytes, toxic: int, lang: str | None) -> None:
        own = set(words.split())
        known, get = self.known, self.known.get
        if len(known) > WORDS_HELD:
            known.clear()
        found: list[int] = []
        for w in own:
            h = get(w)
            if h is None:
                h = known[w] = hashes(w)
            found.extend(h)
        h = np.sort(np.array(found, np.int64))
        self.held[toxic].append(h[np.flatnonzero(np.diff(h, prepend=-1))])
        self.size += len(self.held[toxic][-1])
        part = f"{int(held_out(words))} {toxic}"
        self.docs["part"][part] = self.docs["part"].get(part, 0) + 1
        if lang is not None:
            self.docs["lang"][lang] = self.docs["lang"].get(lang, 0) + 1
            mine = self.words.setdefault(lang, {})
            get, before = mine.get, len(mine)
            for w in own:
                mine[w] = get(w, 0) + 1
            self.different += len(mine) - before

    def full(self) -> bool:
        return self.size > 1 << 22 or self.different > WORDS_HELD

    def rows(self) -> list[tuple[str, bytes, int, int, int]]:
        """(kind, name, hash, n0, n1): what is counted since the last call."""
        out = [("part", k.encode(), 0, n, 0) for k, n in self.docs["part"].items()] + [("lang", k.encode("utf-8", "surrogatepass"), 0, n, 0) for k, n in self.docs["lang"].items()]
        out += [("word", x.encode("utf-8", "surrogatepass") + b"\n" + w, 0, n, 0) for x, own in self.words.items() for w, n in own.items()]
        both = [np.unique(np.concatenate(h), return_counts=True) if h else (np.zeros(0, np.int64),) * 2 for h in self.held]
        every = np.union1d(both[0][0], both[1][0])
        n = np.zeros((2, len(every)), np.int64)
        for k, (h, c) in enumerate(both):
            n[k, np.searchsorted(every, h)] = c
        out += [("hash", b"", h, x, y) for h, x, y in zip(every.tolist(), n[0].tolist(), n[1].tolist(), strict=True)]
        self.clear()
        return out


@dataclass
class Known:
    """What the fit starts from: places of hashes in the table, with their documents of each label; marks; documents by part and label."""

    rows: dict[int, int]
    seen: np.ndarray
    marks: dict[bytes, int]
    langs: int
    parts: dict[str, int]

    @classmethod
    def of(cls, hashed: list[tuple[int, int, int]], langs: dict[str, int], words: dict[str, dict[bytes, int]], parts: dict[str, int]) -> Known:
        common = sorted(hashed, key=lambda r: (-r[1] - r[2], r[0]))[:TABLE]
        names = sorted(x for x, n in langs.items() if n >= MIN_LANG)
        marks = marks_of([{w: n / langs[x] for w, n in words.get(x, {}).items()} for x in names])
        return cls({h: k + 1 for k, (h, _, _) in enumerate(common)}, np.array([[0, 0], *[r[1:] for r in common]], np.int64).T, marks, len(names) + 1, parts)

    def n(self, toxic: int) -> int:
        return sum(n for k, n in self.parts.items() if k.endswith(f" {toxic}"))

    @property
    def holds(self) -> bool:
        """Whether the part kept out has toxic documents, and the other one documents of both labels."""
        return all(self.parts.get(k) for k in ("1 1", "0 1", "0 0"))


# --- the fit ---


def begun(known: Known, seed: int) -> dict:
    rng = np.random.default_rng(seed)
    m = {
        "table": rng.normal(0, 0.05, (len(known.rows) + 1, DIM)).astype(np.float32),
        "filters": [rng.normal(0, 0.3 / np.sqrt(w), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        "bias": [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        "out": rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }
    m["table"][0] = 0
    # the first dimension starts from how much more often toxic documents have the hash
    down, up = known.seen + 0.5
    m["table"][1:, 0] += np.clip(np.log(up / max(known.n(1), 1)) - np.log(down / max(known.n(0), 1)), -2, 4)[1:].astype(np.float32) * 0.5
    return m


def packed(docs: list[tuple[bytes, int]], known: Known) -> dict:
    """Documents of one shard for the fit: words as places among the document's different ones, and those as places in the shard's list of
    words, which has the places of their hashes."""
    docs = sorted(docs, key=lambda d: (zlib.crc32(d[0]), d))
    index: dict[bytes, int] = {}
    ids, own, lang = [], [], []
    for ws, _ in docs:
        words = ws.split()
        mine: dict[bytes, int] = {}
        ids.append(np.array([mine.setdefault(w, len(mine)) for w in words], np.int32))
        own.append(np.array([index.setdefault(w, len(index)) for w in mine], np.int32))
        lang.append(language(words, known.marks, known.langs))
    get = known.rows.get
    flat = np.zeros((len(index), 1 + len(PREFIXES)), np.int32)  # a place for each hash, 0 where there is none
    for k, w in enumerate(index):
        for i, h in enumerate(hashes(w)):
            flat[k, i] = get(h, 0)
    held = np.array([held_out(ws) for ws, _ in docs], bool) & known.holds
    weight = np.zeros(len(known.rows) + 1)  # documents to learn from that have a hash
    for mine in (x for x, h in zip(own, held, strict=True) if not h):
        has = np.zeros(len(weight), bool)
        has[flat[mine]] = True
        weight += has
    none = [np.zeros(0, np.int32)]
    return {
        "ids": np.concatenate(ids + none),
        "long": np.array([len(x) for x in ids], np.int64),
        "own": np.concatenate(own + none),
        "different": np.array([len(x) for x in own], np.int64),
        "y": np.array([t for _, t in docs], np.float32),
        "held": held,
        "lang": np.array(lang, np.int64),
        "flat": flat,
        "weight": weight,
    }


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the runs of these lengths."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


class Shard:
    """The documents of a shard, laid out batch by batch."""

    def __init__(self, pack: dict) -> None:
        self.__dict__.update(pack)
        self.at, self.own_at = np.cumsum(self.long) - self.long, np.cumsum(self.different) - self.different

    def forward(self, some: np.ndarray, m: dict) -> tuple:
        """Pooled activations of documents laid end to end, with two rows of zeros around each, and what the way back needs."""
        pad = max(WIDTHS) - 1
        long = self.long[some]
        starts = np.cumsum(long + pad) - long - pad
        n = self.different[some]
        words, step = self.own[np.repeat(self.own_at[some], n) + _within(n)], _within(long)
        where = np.zeros(int(long.sum()) + pad * (len(some) + 1), np.int64)  # 0: none, else a word's place from 1
        where[np.repeat(starts + pad, long) + step] = self.ids[np.repeat(self.at[some], long) + step] + np.repeat(np.cumsum(n) - n + 1, long)
        e = np.zeros((len(words) + 1, DIM), np.float32)
        for k in range(self.flat.shape[1]):
            e[1:] += m["table"][self.flat[words, k]]
        h, at, on = [], [], []
        stops = np.append(starts[1:], len(where))
        for j, w in enumerate(WIDTHS):
            n = len(where) - w + 1
            y = np.zeros((FILTERS, n), np.float32)
            for i in range(w):
                y += (m["filters"][j][i * DIM : (i + 1) * DIM].T @ e.T)[:, where[i : i + n]]
            top = np.empty((len(some), FILTERS), np.int64)
            for d, (s, t) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
                top[d] = s + y[:, s : min(t, n)].argmax(1)
            best = y[np.arange(FILTERS), top] + m["bias"][j]
            h.append(np.maximum(best, 0))
            at.append(top)
            on.append(best > 0)
        return np.hstack(h), at, on, where, words, e

    def logits(self, some: np.ndarray, m: dict) -> np.ndarray:
        out = np.empty(len(some))
        for b in range(0, len(some), BATCH):
            out[b : b + BATCH] = self.forward(some[b : b + BATCH], m)[0] @ m["out"] + m["out_bias"][0]
        return out

    def learned(self, m: dict, seed: list[int]) -> dict:
        """``m`` after one pass over the documents that aren't kept out, by minibatch Adam; a row of the table moves where it is in a maximum."""
        m = {k: [a.copy() for a in v] if isinstance(v, list) else v.copy() for k, v in m.items()}
        state = {k: [(np.zeros_like(a), np.zeros_like(a)) for a in (v if isinstance(v, list) else [v])] for k, v in m.items()}
        times = np.zeros(len(m["table"]), np.int64)
        order = np.flatnonzero(~self.held)
        np.random.default_rng(seed).shuffle(order)
        for step, b in enumerate(range(0, len(order), BATCH), 1):
            some = order[b : b + BATCH]
            h, at, on, where, words, e = self.forward(some, m)
            z = h @ m["out"] + m["out_bias"][0]
            g = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - self.y[some]) / len(some)).astype(np.float32)
            grads = {"out": [h.T @ g], "out_bias": [np.array([g.sum()], np.float32)], "filters": [], "bias": []}
            gh = g[:, None] * m["out"]
            places, backs = [], []
            for j, w in enumerate(WIDTHS):
                gt = gh[:, j * FILTERS : (j + 1) * FILTERS] * on[j]
                grads["bias"].append(gt.sum(0))
                gf = np.zeros_like(m["filters"][j])
                for i in range(w):
                    place = where[at[j] + i]
                    gf[i * DIM : (i + 1) * DIM] = np.einsum("df,dfk->kf", gt, e[place])
                    use = (place > 0) & (gt != 0)
                    places.append(place[use] - 1)
                    backs.append((gt[:, :, None] * m["filters"][j][i * DIM : (i + 1) * DIM].T[None])[use])
                grads["filters"].append(gf)
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * RATE
            for k, gs in grads.items():
                for i, gr in enumerate(gs):
                    a, (s, v) = m[k][i] if isinstance(m[k], list) else m[k], state[k][i]
                    s += 0.1 * (gr - s)
                    v += 0.001 * (gr * gr - v)
                    a -= fix * s / (np.sqrt(v) + 1e-6)
            place, back = np.concatenate(places), np.concatenate(backs)
            flat = self.flat[words[place]].ravel()
            first = np.argsort(flat, kind="stable")
            flat = flat[first]
            last = np.flatnonzero(np.diff(flat, append=-1))
            touched = flat[last]
            upto = np.cumsum(np.repeat(back, self.flat.shape[1], axis=0)[first], axis=0, dtype=np.float64)[last]
            gr = np.diff(upto, axis=0, prepend=np.zeros((1, DIM))).astype(np.float32)
            s, v = state["table"][0]  # rows of this batch alone
            s[touched] += 0.1 * (gr - s[touched])
            v[touched] += 0.001 * (gr * gr - v[touched])
            times[touched] += 1  # a row has steps of its own
            own = (np.sqrt(1 - 0.999 ** times[touched]) / (1 - 0.9 ** times[touched]) * RATE).astype(np.float32)[:, None]
            m["table"][touched] -= own * s[touched] / (np.sqrt(v[touched]) + 1e-6)
            m["table"][0] = 0
        return m

    def moved(self, m: dict, seed: list[int]) -> dict:
        """What a pass adds to ``m``, times the documents that are behind it: of a row of the table, those that have its hash."""
        now = self.learned(m, seed)
        weight, n = self.weight, float((~self.held).sum())
        return {
            "n": n, "weight": weight, "table": (now["table"] - m["table"]) * weight[:, None].astype(np.float32), "out": (now["out"].astype(np.float64) - m["out"]) * n, "out_bias": (now["out_bias"].astype(np.float64) - m["out_bias"]) * n,
            "filters": [(a.astype(np.float64) - b) * n for a, b in zip(now["filters"], m["filters"], strict=True)], "bias": [(a.astype(np.float64) - b) * n for a, b in zip(now["bias"], m["bias"], strict=True)],
        }

    def cases(self, m: dict, known: Known) -> np.ndarray:
        """(language, logit in 1 / ``STEPS``, label, documents) of the part kept out, or of all where none is."""
        tell = np.flatnonzero(self.held) if known.holds else np.arange(len(self.long))
        z = np.rint(np.clip(self.logits(tell, m), -60, 60) * STEPS).astype(np.int64)
        rows = np.stack([self.lang[tell], z, self.y[tell].astype(np.int64)], 1)
        found, n = np.unique(rows, axis=0, return_counts=True)
        return np.column_stack([found, n])


def sum_of(parts: list[dict]) -> dict:
    """Sums of ``moved`` in the order given."""
    added = lambda vs: sum(np.asarray(v, np.float64) for v in vs)
    return {k: [added(p[k][i] for p in parts) for i in range(len(v))] if isinstance(v, list) else added(p[k] for p in parts) for k, v in parts[0].items()}


def averaged(m: dict, moved: dict) -> dict:
    n, weight = max(float(moved["n"]), 1.0), np.maximum(moved["weight"], 1.0)[:, None]
    plus = lambda a, d, n: (a + d / n).astype(np.float32)
    return {k: [plus(a, d, n) for a, d in zip(v, moved[k], strict=True)] if isinstance(v, list) else plus(v, moved[k], weight if k == "table" else n) for k, v in m.items()}


def modelled(known: Known, m: dict, cases: np.ndarray) -> Model:
    """The model with its thresholds; cases: (language, logit in 1 / ``STEPS``, label, documents)."""
    total = known.n(0) + known.n(1)
    cuts = np.zeros(known.langs)
    if not known.n(0) or not known.n(1):
        rate = min(known.n(1) / total if total else 0.0, 0.69)
        m["out"][:] = 0
        m["out_bias"][0] = np.log(max(rate, 1e-9) / (1 - rate))
        cuts[:] = np.log(CUT / (1 - CUT))
    else:
        lang, z, y, n = cases[:, 0], cases[:, 1] / STEPS, cases[:, 2], cases[:, 3]
        everywhere = _cut(z, y, n)
        for k in range(known.langs):
            own = lang == k
            enough = n[own & (y == 1)].sum() >= MIN_CASES and (own & (y == 0)).any()
            cuts[k] = _cut(z[own], y[own], n[own]) if enough else everywhere
    return Model(known.rows, m["table"], m["filters"], m["bias"], m["out"], float(m["out_bias"][0]), cuts, known.marks)


def _cut(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The logit midway in the widest gap among those with the fewest errors, a false alarm counting four times."""
    values, at = np.unique(z, return_inverse=True)
    toxic, other = (np.bincount(at, n * (y == k), len(values)) for k in (1, 0))
    missed = np.concatenate(([0], np.cumsum(toxic)))
    false = other.sum() - np.concatenate(([0], np.cumsum(other)))
    cost = missed + 4 * false
    gap = np.diff(np.concatenate(([values[0] - 2], values, [values[-1] + 2])))
    edge = np.concatenate(([values[0] - 2], values, [values[-1] + 2]))
    best = max(np.flatnonzero(cost == cost.min()), key=lambda k: gap[k])
    return float((edge[best] + edge[best + 1]) / 2)


def fit(docs: list[tuple[list[bytes], int]], langs: list[str | None] | None = None, seed: int = SEED) -> Model:
    """A model from (words, toxic) of whole documents that are all here, and their languages where they are known: what ``train`` does, as one shard."""
    counts, cases = Counts(), [(b" ".join(ws), t, x) for (ws, t), x in zip(docs, langs or [None] * len(docs), strict=True)]
    for c in cases:
        counts.add(*c)
    rows = counts.rows()
    by = lambda kind: [r for r in rows if r[0] == kind]
    known = _known([(h, a, b) for _, _, h, a, b in by("hash") if a + b >= MIN_DOCS], *[{r[1]: r[3] for r in by(kind)} for kind in ("lang", "word", "part")])
    m, shard = begun(known, seed), Shard(packed([c[:2] for c in cases], known))
    if known.n(0) and known.n(1):
        for k in range(EPOCHS):
            m = averaged(m, sum_of([shard.moved(m, [seed, k, 0])]))
    return modelled(known, m, shard.cases(m, known))


def _known(hashed: list[tuple[int, int, int]], langs: dict[bytes, int], words: dict[bytes, int], parts: dict[bytes, int]) -> Known:
    text = lambda x: x.decode("utf-8", "surrogatepass")
    own: dict[str, dict[bytes, int]] = {}
    for key, n in words.items():
        x, w = key.rsplit(b"\n", 1)
        if 4 * n >= langs[x]:
            own.setdefault(text(x), {})[w] = n
    return Known.of(hashed, {text(x): n for x, n in langs.items()}, own, {text(k): n for k, n in parts.items()})


# --- the fit on all labelled documents ---


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(words, toxic, lang) of each different labelled document, with key and n, a hash and the number of its words; written."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = rows_with_ids(docs.select("doc_id", "text", lang.cast("string").alias("lang")))
    bits = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bit_or(F.col("toxic").cast("int") + 1).alias("bits"))
    places = rows.select("_file", "_place", F.col("_row.doc_id").alias("doc_id")).join(bits, "doc_id").select("_file", "_place", F.col("bits").cast("byte").alias("_times"))
    found = chosen_rows(rows, places).select(F.col("_row.text").alias("text"), F.col("_row.lang").alias("lang"), F.col("_times").alias("bits"))

    def start():
        def of(texts: list[str | None], _):
            words = [b" ".join(words_of(t)) for t in texts]
            return {"words": words, "h": [xxhash.xxh3_128_digest(w) for w in words], "n": [w.count(b" ") + 1 if w else 0 for w in words]}

        return of

    rows = rows_with_ids(materialise(map_texts(found, "words binary, h binary, n int", start)))
    one = rows.groupBy(F.col("_row.h").alias("h"), F.col("_row.lang").alias("lang")).agg(F.min(F.struct("_file", "_place")).alias("one"), F.bit_or("_row.bits").alias("_times"))
    out = chosen_rows(rows, one.select("one.*", F.col("_times").cast("byte").alias("_times")))
    kinds = F.when(F.col("_times") == 1, F.array(F.lit(0))).when(F.col("_times") == 2, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    return out.select(F.col("_row.words").alias("words"), F.explode(kinds).alias("toxic"), F.col("_row.lang").alias("lang"), F.xxhash64("_row.h").alias("key"), F.col("_row.n").alias("n"))


def counted(cases: DataFrame) -> Known:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*counts.rows(), strict=True), _COUNTED, strict=True)], names=["kind", "name", "h", "a", "b"])

        for b in batches:
            for w, t, x in zip(*[b.column(c).to_pylist() for c in ("words", "toxic", "lang")], strict=True):
                counts.add(w, t, x)
                if counts.full():
                    yield out()
        if counts.docs["part"]:
            yield out()
        del counts
        release()

    rows = cases.select("words", "toxic", "lang").mapInArrow(of, "kind string, name binary, h long, a long, b long")
    sums = materialise(rows.groupBy("kind", "name", "h").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    named = lambda kind: {bytes(r["name"]): r["a"] for r in sums.filter(F.col("kind") == kind).collect()}
    langs = named("lang")  # one for each language
    own = cases.sparkSession.createDataFrame([(x, n) for x, n in langs.items() if n >= MIN_LANG], "lang binary, n long")
    words = sums.filter("kind = 'word'").withColumn("lang", F.expr("substring(name, 1, length(name) - instr(reverse(decode(name, 'ISO-8859-1')), '\n'))"))
    words = words.join(F.broadcast(own), "lang").filter(4 * F.col("a") >= F.col("n"))  # four times a document's different words at most
    common = sums.filter((F.col("kind") == "hash") & (F.col("a") + F.col("b") >= MIN_DOCS)).orderBy(F.desc(F.col("a") + F.col("b")), "h").limit(TABLE)
    return _known([(r["h"], r["a"], r["b"]) for r in common.collect()], langs, {bytes(r["name"]): r["a"] for r in words.collect()}, named("part"))


_COUNTED = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64())


def packs(cases: DataFrame, known: Known, shard: int) -> tuple[DataFrame, int]:
    """(shard, pack): a row for each ``shard`` words or so, dealt by a hash of the text; written, and the number of shards."""
    spark = cases.sparkSession
    shared = spark.sparkContext.broadcast(known)
    n = max(1, -(-(cases.agg(F.sum("n")).first()[0] or 0) // shard))
    dealt = cases.select(F.pmod("key", F.lit(n)).cast("int").alias("shard"), "words", "toxic").repartitionById(n, "shard").sortWithinPartitions("shard")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pickle.dumps(packed(held, shared.value))], pa.binary())], names=["shard", "pack"])

        for b in batches:
            for s, w, t in zip(*[b.column(c).to_pylist() for c in ("shard", "words", "toxic")], strict=True):
                if s != now and held:
                    yield out()
                    held = []
                now = s
                held.append((w, t))
        if held:
            yield out()
        del held
        release()

    return materialise(dealt.mapInArrow(of, "shard int, pack binary")), n


def over(packs: DataFrame, of: Callable[[int, Shard], bytes]) -> DataFrame:
    """(shard, out): ``of`` each shard, one at a time; written."""
    spark = packs.sparkSession

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, p in zip(b.column("shard").to_pylist(), b.column("pack"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([of(s, Shard(pickle.loads(p.as_buffer())))], pa.binary())], names=["shard", "out"])
        release()

    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, "1")  # of this write alone: a row is a shard
    try:
        return materialise(packs.mapInArrow(each, "shard int, out binary"))
    finally:
        spark.conf.set(ARROW_ROWS, before)


def summed(moved: DataFrame, n: int) -> dict:
    """The sum of all shards' ``moved``, in the order of shards: neighbours are summed, and the sums again, so that one reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((s, p.as_py()) for b in batches for s, p in zip(b.column("shard").to_pylist(), b.column("out"), strict=True))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0] // GROUP], pa.int32()), pa.array([pickle.dumps(sum_of([pickle.loads(p) for _, p in rows]))], pa.binary())], names=["shard", "out"])

    while n > 1:
        n = -(-n // GROUP)
        moved = moved.withColumn("group", F.floor(F.col("shard") / GROUP).cast("int")).repartitionById(n, "group").drop("group").mapInArrow(add, "shard int, out binary")
    return pickle.loads(moved.first()["out"])


def train(docs: DataFrame, labels: DataFrame, shard: int = SHARD, seed: int = SEED) -> Model:
    """Fits on all labelled documents; a column ``lang`` of ``docs`` teaches the marks of languages.

    Each pass goes over all shards of about ``shard`` words from one start, and what they learn is averaged by their documents.
    """
    spark = docs.sparkSession
    cases = materialise(labelled(docs, labels))
    known = counted(cases)
    m = begun(known, seed)
    if not known.n(0) or not known.n(1):
        return modelled(known, m, np.zeros((0, 4), np.int64))
    dealt, n = packs(cases, known, shard)
    for k in range(EPOCHS):
        given = spark.sparkContext.broadcast(m)
        m = averaged(m, sum_of([summed(over(dealt, lambda s, x: pickle.dumps(x.moved(given.value, [seed, k, s]))), n)]))  # noqa: B023
        given.destroy()
    given, told = spark.sparkContext.broadcast(m), spark.sparkContext.broadcast(known)
    found = over(dealt, lambda s, x: x.cases(given.value, told.value).astype("<i8").tobytes())

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column("out"):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.frombuffer(p.as_buffer(), "<i8").reshape(-1, 4).T.copy()], names=["lang", "z", "y", "n"])

    cases = found.mapInArrow(unpack, "lang long, z long, y long, n long").groupBy("lang", "z", "y").agg(F.sum("n").alias("n"))
    rows = sorted(tuple(r) for r in cases.collect())  # 240 * STEPS for each language at most
    return modelled(known, m, np.array(rows, np.int64).reshape(-1, 4))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLE rows at most

    def start():
        def of(texts: list[str | None], _):
            score = shared.value.scores(texts)
            return {"score": score, "predicted": (score >= CUT).astype(np.int32)}

        return of

    return map_texts(docs.select("doc_id", "text"), "score double, predicted int", start)


def op5_toxic_cnn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.filter(remainder(3) != 1), labels.filter(remainder(3) != 1))
    return predict(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")

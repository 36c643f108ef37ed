"""Language identification by multilingual mixture inference.

Counts of hashed byte n-grams of lower-cased letters give each language a
distribution, smoothed; they cover every training document. A document is a mixture of
languages: expectation-maximisation over its n-gram counts estimates the
proportions. Its language set grows from the best single language, in order of
the proportions under all languages, as long as a further language raises the
log-likelihood by more than ``PENALTY`` times half the log of the n-gram count (a
stricter BIC). The prediction is the set's language with the largest share, the
score that share.

Texts are worked on together: one array holds all n-grams of many texts, and sums run over each text's part of it.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything when nothing was
learned; a text with a letter but too short for an n-gram gets the language with most n-grams learned, its share of them as
score; whole texts are counted, however long; ties go to the first language in order of code points; repeated rows get the
same result; rows with a null lang or text teach nothing; a null doc_id stays null; an empty table gives an empty one; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import importable, map_texts

GRAM = 4
BUCKETS = 1 << 14
SMOOTH = 0.5
PENALTY = 4.0
STEPS = 12
UNKNOWN = "und"
CHARS = 400_000

_LETTER = regex.compile(r"\p{L}")
#: Bytes that aren't part of a letter become a space; UTF-8's own bytes stay.
_TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(texts: list[str], gram: int = GRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, with spaces around words, and the text each is of; those that begin with two spaces are left out."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass").translate(_TABLE) + b" " for t in texts]
    a = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    n = max(0, len(a) - gram + 1)
    h = np.zeros(n, np.uint32)
    for k in range(gram):
        h = h * np.uint32(0x01000193) + a[k : k + n]
    h ^= h >> np.uint32(15)
    text = np.repeat(np.arange(len(raw)), size)[:n]
    inside = np.arange(n) + gram <= np.cumsum(size)[text]
    keep = inside & ((a[:n] != 32) | (a[1 : n + 1] != 32))
    return (h[keep] & np.uint32(buckets - 1)).astype(np.int64), text[keep]


def groups(texts: list[str], chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chars`` characters together."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > chars or k + 1 == len(texts):
            yield begin, k + 1
            begin, size = k + 1, 0


@dataclass
class Learned:
    """Languages in order of code points, their n-gram log-probabilities (languages, buckets) and their shares of all n-grams."""

    langs: list[str]
    logs: np.ndarray
    shares: np.ndarray


def learn(docs: DataFrame, gram: int = GRAM, buckets: int = BUCKETS) -> Learned:
    """From all rows of (text, lang)."""
    importable(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for i, j in groups(texts):
                g, text = grams(texts[i:j], gram, buckets)
                names = {x: k for k, x in enumerate(dict.fromkeys(langs[i:j]))}
                which = np.array([names[x] for x in langs[i:j]])[text]
                per = np.bincount(which * buckets + g, minlength=len(names) * buckets).reshape(-1, buckets)
                for x, k in names.items():
                    counts[x] = counts.get(x, 0) + per[k]
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "gram", "n"])

    rows = docs.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(of, "lang string, gram long, n long")
    found = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # languages * buckets rows at most
    langs = sorted(found["lang"].unique())
    counts = np.full((len(langs), buckets), SMOOTH)
    where = {x: k for k, x in enumerate(langs)}
    np.add.at(counts, (found["lang"].map(where).to_numpy(np.int64), found["gram"].to_numpy(np.int64)), found["n"].to_numpy(float))
    total = counts.sum(1)
    return Learned(langs, np.log(counts / total[:, None]), total / max(total.sum(), 1))


def mixtures(n: np.ndarray, p: np.ndarray, begin: np.ndarray, allowed: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (languages, texts) and log-likelihoods of the mixtures of the ``allowed`` languages. p: the n-grams' probabilities
    (languages, n-grams), n their counts; text k's n-grams go from begin[k] to begin[k + 1]."""
    size = np.diff(np.append(begin, len(n)))
    total = np.add.reduceat(n, begin)
    share = allowed / allowed.sum(0)
    for _ in range(steps):
        joint = np.repeat(share, size, axis=1) * p
        joint *= n / joint.sum(0)
        share = np.add.reduceat(joint, begin, axis=1) / total
    return share, np.add.reduceat(n * np.log((np.repeat(share, size, axis=1) * p).sum(0)), begin)


def identify(texts: list[str | None], model: Learned) -> list[tuple[str, float, str]]:
    """(language, share, the set with its shares) of each text."""
    out: list[tuple[str, float, str]] = [(UNKNOWN, 0.0, "")] * len(texts)
    known = [k for k, t in enumerate(texts) if model.langs and t and _LETTER.search(t)]
    some = [texts[k] for k in known]
    for i, j in groups(some, max(1, CHARS * 8 // max(8, len(model.langs)))):
        for k, found in zip(known[i:j], _identify(some[i:j], model), strict=True):
            out[k] = found
    return out


def _identify(texts: list[str], model: Learned) -> list[tuple[str, float, str]]:
    langs, top = model.langs, int(model.shares.argmax())
    out = [(langs[top], float(model.shares[top]), f"{langs[top]}:{model.shares[top]:.3f}")] * len(texts)
    g, text = grams(texts)
    if not len(g):
        return out
    key, n = np.unique(text * BUCKETS + g, return_counts=True)
    n = n.astype(float)
    text, g = key // BUCKETS, key % BUCKETS
    some, begin = np.unique(text, return_index=True)  # the texts that have an n-gram
    logs = model.logs[:, g]
    single = np.add.reduceat(logs * n, begin, axis=1)
    best = single.argmax(0)
    d, p = np.arange(len(some)), np.exp(logs)
    del logs
    chosen = np.zeros((len(langs), len(some)))
    chosen[best, d] = 1
    share, like = chosen.copy(), single[best, d]
    if len(langs) > 1:
        first = mixtures(n, p, begin, np.ones_like(chosen))[0]
        first[best, d] = np.inf  # in order of these shares languages are tried
        order = np.argsort(-first, axis=0, kind="stable")
        total = np.add.reduceat(n, begin)
        size = np.diff(np.append(begin, len(n)))
        active = d
        for r in range(1, len(langs)):
            grown = chosen[:, active].copy()
            grown[order[r, active], np.arange(len(active))] = 1
            if len(active) == len(some):
                more, up = mixtures(n, p, begin, grown)
            else:
                at = np.repeat(begin[active] - np.cumsum(size[active]) + size[active], size[active]) + np.arange(int(size[active].sum()))
                more, up = mixtures(n[at], p[:, at], np.cumsum(size[active]) - size[active], grown)
            better = up - like[active] > PENALTY * 0.5 * np.log(total[active] + 1)
            active, more, up, grown = active[better], more[:, better], up[better], grown[:, better]
            if not len(active):
                break
            chosen[:, active], share[:, active], like[active] = grown, more, up
    for k, t in enumerate(some):
        mine = [int(x) for x in np.flatnonzero(chosen[:, k])]
        mine.sort(key=lambda x: (x != best[k], -share[x, k], x))
        lead = max(mine, key=lambda x: (share[x, k], -x))
        out[t] = (langs[lead], float(min(1.0, share[lead, k])), ",".join(f"{langs[x]}:{share[x, k]:.3f}" for x in mine))
    return out


def predict(docs: DataFrame, model: Learned) -> DataFrame:
    """(doc_id, lang_pred, score, lang_set)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages * buckets numbers

    def start():
        def of(texts: list[str | None], _):
            got = identify(texts, shared.value)
            return dict(zip(("lang_pred", "score", "lang_set"), map(list, zip(*got, strict=True)), strict=True)) if got else {"lang_pred": [], "score": [], "lang_set": []}

        return of

    return map_texts(docs.select("doc_id", "text"), "lang_pred string, score double, lang_set string", start)


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, by the contract's modulus."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op9_lang_mixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, learn(docs.filter(remainder(3) != 1)))
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "lang_set")

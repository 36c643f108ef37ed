"""Quality rules: base counts, and a linear-chain CRF over the lines of a text.

Each line with a word is content (1) or boilerplate (0). The CRF's emission is
linear in features of the line (shares of symbols, capitals, digits and
exclamation marks, words inside repeated windows, equality to an earlier line,
length, sentence end); its chain has a start and a 2 x 2 transition score. Viterbi
decoding labels the lines of a whole text, and the share of words on content
lines decides: ``kept`` where it reaches ``min_content``.

``train`` fits the CRF by gradient ascent on the exact log-likelihood
(forward-backward), over a sample of at most ``TRAIN_DOCS`` documents of each quality,
chosen by hash of doc_id. Documents are labelled, lines are not: lines of good
documents are content; a logistic fit of lines against their document's label then
tells which lines of bad documents are boilerplate. Without labels of both
kinds ``PRIOR_WEIGHTS`` hold.

Base counts, over words ``[^\\x20\\x09-\\x0D]+``: word_chars, n_symbols (``[#*$%&|<>]``),
n_dup_lines (lines with a word, equal to an earlier line), n_repeat_words (words in
3-word windows found twice or more). base_failed: fewer than 50 words, or more
than half of the words in repeated windows; such documents aren't kept.

Defined results: null, empty and wordless texts have no words and fail the base;
whole texts are read, however long; ties in decoding go to content; repeated
rows get the same verdict; a null doc_id stays null; an empty table gives an empty one; extra columns
pass through ``filter_quality`` untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import map_texts, release

SYMBOLS = b"#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
MIN_CONTENT = 0.5
TRAIN_DOCS = 1500
FEATURES = ("bias", "symbols", "capitals", "digits", "exclaims", "repeated", "duplicate", "short", "long_words", "sentence_end")
PRIOR_WEIGHTS = np.array([2.0, -30.0, -4.0, -4.0, -20.0, -4.0, -3.0, 0.0, 0.0, 0.5])
PRIOR_TRANSITIONS = np.array([[0.5, -0.5], [-0.5, 0.5]])

_WS = b" \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"


def repeated_words(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window that is found twice or more."""
    n, ids = len(words), {}
    inside = np.zeros(n, bool)
    if n <= window:
        return inside
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    _, key = np.unique(a[: n - 1] * len(ids) + a[1:], return_inverse=True)  # exact: pairs first, then triples
    key = key.astype(np.int64)
    for k in range(2, window):
        _, key = np.unique(key[: n - k] * len(ids) + a[k:], return_inverse=True)
    twice = np.bincount(key)[key] > 1
    for k in range(window):
        inside[k : k + len(twice)] |= twice
    return inside


def describe(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); features and words of each line with a word."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    per_line = [x.split() for x in lines]
    words = [w for ws in per_line for w in ws]
    repeated = repeated_words(words)
    upto = np.concatenate(([0], np.cumsum(repeated)))
    seen: set[bytes] = set()
    rows, sizes, at, dups = [], [], 0, 0
    for x, ws in zip(lines, per_line, strict=True):
        if not ws:
            continue
        n, k = len(x), len(ws)
        dup = x in seen
        seen.add(x)
        dups += dup
        chars = n - (len(x) - len(x.translate(None, _WS)))
        part = lambda drop: (n - len(x.translate(None, drop))) / chars  # noqa: B023, E731
        rows.append((1.0, part(SYMBOLS), part(_CAPITALS), part(_DIGITS), part(b"!"), (upto[at + k] - upto[at]) / k, float(dup), 1.0 / k, min(chars / k, 30) / 30, float(ws[-1][-1:] in b".!?")))
        sizes.append(k)
        at += k
    counts = (len(words), len(text or "") - (len(raw) - len(raw.translate(None, _WS))), len(raw) - len(raw.translate(None, SYMBOLS)), dups, int(upto[-1]))
    return counts, np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


class Crf:
    """Two states; the boilerplate emission is 0."""

    def __init__(self, weights: np.ndarray = PRIOR_WEIGHTS, transitions: np.ndarray = PRIOR_TRANSITIONS, start: float = 0.0, min_content: float = MIN_CONTENT) -> None:
        self.weights, self.transitions, self.start, self.min_content = weights, transitions, start, min_content

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: 1 for content."""
        n = len(features)
        if not n:
            return np.zeros(0, np.int64)
        emit = (features @ self.weights).tolist()
        (t00, t01), (t10, t11) = self.transitions.tolist()
        a, b = 0.0, self.start + emit[0]
        back = []
        for e in emit[1:]:
            a0, a1, b0, b1 = a + t00, b + t10, a + t01, b + t11
            back.append((int(a1 >= a0), int(b1 >= b0)))
            a, b = max(a0, a1), max(b0, b1) + e
        state = int(b >= a)
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return np.array(out[::-1])

    def content_share(self, features: np.ndarray, sizes: np.ndarray) -> float:
        return float(sizes[self.decode(features) == 1].sum() / sizes.sum()) if len(sizes) else 0.0


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 25, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
    return w


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 80, ridge: float = 1.0) -> Crf:
    """A CRF from (features, sizes, quality) of whole documents."""
    docs = [d for d in docs if len(d[0])]
    good = np.array([d[2] for d in docs], bool)
    if not len(docs) or good.all() or not good.any():
        return Crf()
    x = np.vstack([d[0] for d in docs])
    length = np.array([len(d[0]) for d in docs])
    doc_good = np.repeat(good, length)
    weight = np.where(doc_good, 1 / max(1, doc_good.sum()), 1 / max(1, (~doc_good).sum())) * len(x) / 2
    y = doc_good.astype(float)
    for _ in range(3):  # a bad document's lines that look like content are content
        w = _logistic(x, y, weight)
        y = np.where(doc_good, 1.0, (x @ w > 0).astype(float))
        if not (y == 0).any():
            break
    order = np.argsort(-length, kind="stable")
    first = np.concatenate(([0], np.cumsum(length)[:-1]))[order]
    size, top = length[order], int(length.max())
    live = [int((size > t).sum()) for t in range(top)]
    weights, trans, start = w.copy(), PRIOR_TRANSITIONS.copy(), 0.0
    lab = y.astype(int)
    velocity = None
    for _ in range(steps):
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ weights
        alpha, beta = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        at = first
        alpha[at] = emit[at] + np.array([0.0, start])
        for t in range(1, top):
            n = live[t]
            cur, prev = at[:n] + t, at[:n] + t - 1
            s = alpha[prev][:, :, None] + trans
            m = s.max(1)
            alpha[cur] = m + np.log(np.exp(s - m[:, None, :]).sum(1)) + emit[cur]
        pair = np.zeros((2, 2))
        ends = first + size - 1
        m = alpha[ends].max(1)
        z = m + np.log(np.exp(alpha[ends] - m[:, None]).sum(1))
        for t in range(top - 1, 0, -1):
            n = live[t]
            cur, prev = at[:n] + t, at[:n] + t - 1
            right = (emit[cur] + beta[cur])[:, None, :] + trans
            m = right.max(2)
            beta[prev] = m + np.log(np.exp(right - m[:, :, None]).sum(2))
            pair += np.exp(alpha[prev][:, :, None] + right - z[:n, None, None]).sum(0)
        zs = np.empty(len(x))
        for k, (f, s) in enumerate(zip(first, size, strict=True)):
            zs[f : f + s] = z[k]
        p1 = np.exp(alpha[:, 1] + beta[:, 1] - zs)
        seen = np.zeros((2, 2))
        inner = np.ones(len(x), bool)
        inner[first] = False
        cur = np.flatnonzero(inner)
        np.add.at(seen, (lab[cur - 1], lab[cur]), 1)
        g = np.concatenate([x.T @ (lab - p1) - ridge * weights, (seen - pair - ridge * trans).ravel(), [(lab[first] - p1[first]).sum() - ridge * start]]) / len(docs)
        velocity = g if velocity is None else 0.8 * velocity + g
        step = 0.3 * velocity
        weights = weights + step[: len(weights)]
        trans = trans + step[len(weights) : -1].reshape(2, 2)
        start += float(step[-1])
    crf = Crf(weights, trans, start)
    shares = np.array([crf.content_share(d[0], d[1]) for d in docs])
    # the cut that tells the labels apart best among those that keep 99 of 100 good documents
    cuts = [c for c in np.linspace(0.05, 0.95, 19) if (shares[good] >= c).mean() >= 0.99]
    if cuts:
        crf.min_content = float(max(cuts, key=lambda c: ((shares[~good] < c).mean(), -abs(c - MIN_CONTENT))))
    return crf


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Crf:
    """Fits on at most ``limit`` labelled documents of each quality."""
    ids = labels.select("doc_id", "quality").dropna()
    some = [ids.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for q in (0, 1)]
    some = F.broadcast(some[0].unionAll(some[1]))  # 2 * limit ids at most

    def start():
        def of(texts: list[str | None], _):
            got = [describe(t) for t in texts]
            return {"features": [f.astype(np.float32).ravel() for _, f, _ in got], "sizes": [s for _, _, s in got]}

        return of

    rows = map_texts(docs.select("doc_id", "text").join(some, "doc_id").select("text", F.col("quality").cast("int").alias("quality")), "features array<float>, sizes array<long>", start)
    found = [(np.asarray(r.features, np.float64).reshape(-1, len(FEATURES)), np.asarray(r.sizes), int(r.quality)) for r in rows.toPandas().itertuples()]
    found.sort(key=lambda d: (d[2], len(d[0]), d[0].sum()))  # an order that doesn't depend on the layout
    crf = fit(found)
    del rows, found
    release()
    return crf


JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"


def _judged(docs: DataFrame, crf: Crf) -> DataFrame:
    """The columns of ``docs`` by position, as _0, _1 and so on, and those of ``JUDGED``; nothing is shuffled."""
    names = [c.split()[0] for c in JUDGED.split(", ")]

    def start():
        def of(texts: list[str | None], _):
            rows = []
            for t in texts:
                counts, features, sizes = describe(t)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > 50 * counts[0]
                share = crf.content_share(features, sizes)
                rows.append((*counts, share, failed, not failed and share >= crf.min_content))
            return {n: [r[k] for r in rows] for k, n in enumerate(names)}

        return of

    own = docs.columns
    flat = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(own)], F.col("`text`").alias("text"))
    return map_texts(flat, JUDGED, start)


def judge(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id and the columns of ``JUDGED``."""
    out = _judged(docs, crf)
    return out.select(F.col(f"_{docs.columns.index('doc_id')}").alias("doc_id"), *[c.split()[0] for c in JUDGED.split(", ")])


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    out = _judged(docs, train(docs, labels)).filter("kept")
    return out.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def op8_crf_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, train(docs, labels))

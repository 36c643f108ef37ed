"""The language model: its sums, its gradients, and that its result doesn't depend on how rows are laid out."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import attention_lm as A


def frame(spark, docs, parts=None):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return df.repartition(parts) if parts else df


def prose(n, seed=1):
    rng = random.Random(seed)
    word = lambda s: "".join(rng.choices(s, k=rng.randint(2, 8)))
    vocabularies = [[word("theandorisg") for _ in range(300)], [word("lesquepouriv") for _ in range(300)]]
    return [(k, " ".join(rng.choice(vocabularies[k % 2]) for _ in range(rng.randint(3, 120)))) for k in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    docs = frame(spark, prose(300))
    ids, sums, begins = A.tokenised(docs, F.lit(True))
    counts, within, after = A.corpus_counts(ids, A.ranks_of(sums, A.INPUTS), A.ranks_of(sums, A.FIRSTS, begins), begins)
    return A.Attention(sums, begins, within, after, A.head_of(counts), 0.5)


def tokens(model, texts):
    return A.tokens_in(A.subwords(A.VOCABULARY).of(texts)[0], model.begins)


def test_sums_cover_all_training_texts(spark):
    docs = [*prose(40), (90, "early " * 5000 + "late " * 6000), (91, None), (92, "not to be learned " * 50)]
    ids, sums, begins = A.tokenised(frame(spark, docs, 5), F.col("doc_id") != 92)
    sub, want = A.Subwords(A.VOCABULARY), np.zeros(A.IDS, np.int64)
    for k, t in docs:
        if k != 92:
            want += np.bincount(sub.of([t])[0], minlength=A.IDS)
    assert sums.tolist() == want.tolist() and ids.count() == len(docs)
    counts, within, after = A.corpus_counts(ids.filter("train"), A.ranks_of(sums, A.INPUTS), A.ranks_of(sums, A.FIRSTS, begins), begins)
    words = [w for k, t in docs if k != 92 for w in (t or "").split()]
    assert sorted(r.c for r in counts.collect()) == sorted([*(words.count(w) for w in set(words)), len(docs) - 1])
    assert after.sum() == len(words) + len(docs) - 1 and within.sum() == sums[~begins].sum() + len(words)


def test_tokens_keep_words_apart():
    texts = ["one two  one\ttwo", "", "a\xa0b c", "longerword" * 30, "é 日本語 x"]
    sub = A.Subwords(A.VOCABULARY)
    flat, n = sub.of(texts)
    t = A.tokens_in(flat, sub.begins)
    words = [[*x.split(" \t"[0]), None] for x in ("one two one two", "", "a\xa0b c", "longerword" * 30, "é 日本語 x")]
    words = [[w for w in ws if w != ""] for ws in words]
    assert t.per_text.tolist() == [len(w) for w in words] and n.sum() == len(flat)
    each = [w for ws in words for w in ws]
    assert all((t.h[i] == t.h[j]) == (each[i] == each[j]) for i in range(len(each)) for j in range(i))


def test_it_is_a_distribution(model):
    assert np.allclose(model.classes.sum(0), 1, atol=1e-5)
    used = np.bincount(model.first_rank[model.begins], weights=np.exp(model.first_share[model.begins].astype(float)), minlength=A.FIRSTS)
    assert np.allclose(used[used > 0], 1, atol=1e-4)
    assert np.allclose(np.exp(model.spell.astype(float)).sum(1), 1, atol=1e-3)
    inner = ~model.begins
    used = np.bincount(model.rank[inner], weights=np.exp(model.inner_share[inner].astype(float)), minlength=A.INPUTS)
    assert np.allclose(used[used > 0], 1, atol=1e-4)
    kept = np.zeros(A.IDS)
    first = {}
    sub = A.subwords(A.VOCABULARY)
    for _, t in prose(300):
        x = A.tokens_in(sub.of([t])[0], model.begins)
        first |= dict(zip(x.h.tolist(), x.first.tolist(), strict=True))
    for h, c in zip(model.keys.tolist(), model.counts.tolist(), strict=True):
        kept[first[h]] += (c - model.discount) / model.seen[first[h]]
    some = kept > 0
    assert np.allclose(kept[some] + model.spelled[some], 1)


def slow_log_probs(model, t):
    """Token after token, by the definition."""
    w = {k: v.astype(float) for k, v in model.w.items()}
    codes, values, some = A.different(t.h)
    rest = model.rests(t, some, model.lookup(values))[codes] + model.first_share[t.first]
    out, at = [], 0
    for n in t.per_text.tolist():
        for i in range(n):
            keys = range(max(0, (i // A.BLOCK - 1) * A.BLOCK), i + 1)
            rank = lambda j, of, at=at: A.INPUTS if j == 0 else model.rank[of[at + j - 1]]
            e = lambda j: w["first"][rank(j, t.first)] + w["last"][rank(j, t.last)]
            v = lambda j: w["v_first"][rank(j, t.first)] + w["v_last"][rank(j, t.last)]
            a = np.array([e(i) @ w["q"] @ (e(j) @ w["k"]) / math.sqrt(A.DIM) + w["rel"][i - j] for j in keys])
            a = np.exp(a - a.max())
            a /= a.sum()
            z = sum(x * v(j) for x, j in zip(a, keys, strict=True)) + w["bias"]
            u = np.exp(z[: A.CLASSES] - z[: A.CLASSES].max())
            u /= u.sum()
            point = 1 / (1 + math.exp(-z[A.CLASSES]))
            new = (1 - point * (1 - a[-1])) * (u @ model.classes[model.first_rank[t.first[at + i]]]) * math.exp(rest[at + i])
            old = point * sum(x for x, j in zip(a, keys, strict=True) if j < i and t.h[at + j] == t.h[at + i])
            out.append(math.log(new + old))
        at += n
    return np.array(out)


def test_scores_by_definition(model):
    rng = np.random.default_rng(3)
    model.w["rel"] = rng.normal(0, 1, 2 * A.BLOCK).astype(np.float32)
    texts = [t for _, t in prose(300)[:6]] + ["", None, "the the the the " * 12, "unseen0815 words"]
    t = tokens(model, texts)
    got = model.log_probs(t, step=3)
    assert np.allclose(got, slow_log_probs(model, t), rtol=2e-4, atol=2e-4)
    alone = np.concatenate([model.log_probs(tokens(model, [x])) for x in texts])
    assert np.allclose(got, alone, rtol=1e-4, atol=1e-4)
    changed = tokens(model, [texts[0] + " entirely other words behind"])  # what comes later doesn't matter
    n = len(texts[0].split())
    assert np.allclose(model.log_probs(changed)[:n], got[:n], rtol=1e-4, atol=1e-4)


def test_gradients(model):
    rng = np.random.default_rng(2)
    t = tokens(model, [x for _, x in prose(300)[:4]] + ["the the the the " * 12])
    x, scored, _, opens, codes, f, rest, _ = model.prepared(t)
    keep = model.w
    model.w = {k: v.astype(np.float64) for k, v in keep.items()}
    try:
        args = (x, scored, opens[scored], codes, f[scored], rest[scored], codes[scored] >= 0)
        g, _ = model.gradient(*args)
        for k, w in model.w.items():
            for _ in range(3):
                if isinstance(g[k], tuple):
                    row = int(rng.integers(len(g[k][0])))
                    at = (int(g[k][0][row]), int(rng.integers(w.shape[1])))
                    got = g[k][1][row, at[1]]
                else:
                    at = np.unravel_index(int(rng.integers(w.size)), w.shape)
                    got = g[k][at]
                was = w[at]
                w[at] = was + 1e-4
                up = model.gradient(*args)[1]
                w[at] = was - 1e-4
                down = model.gradient(*args)[1]
                w[at] = was
                assert got == pytest.approx((up - down) / 2e-4 / (codes[scored] >= 0).sum(), rel=2e-3, abs=1e-7), k
    finally:
        model.w = keep


def test_layout_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD", 2000)
    monkeypatch.setattr(A.train, "__defaults__", (2000,))
    docs = [*prose(200), (0, "repeated id with another text"), (3, prose(4)[3][1])]
    train = F.col("doc_id") % 10 != 0
    key = lambda df: sorted((r.doc_id, r.n_tokens, round(r.score, 6)) for r in df.collect())
    one, six = (key(A.score_texts(frame(spark, docs, p), train)) for p in (1, 6))
    assert one == six


def test_better_than_its_base(spark):
    docs = prose(900, 7)
    df = A.score_texts(frame(spark, docs), F.col("doc_id") % 10 != 0).filter("doc_id % 10 = 0")
    r = df.agg(F.sum("score").alias("model"), F.sum("base_score").alias("base")).first()
    assert r.model > r.base


def test_every_document_reaches_the_weights(spark, model):
    docs = frame(spark, prose(60))
    ids, _, _ = A.tokenised(docs, F.lit(True))
    n = sum(len(t.split()) + 1 for _, t in prose(60))
    seen = []
    first = {k: v.copy() for k, v in model.w.items()}
    A.train(ids, model, n, 500)
    seen.append(all((model.w[k] != v).any() for k, v in first.items()))
    assert seen == [True]

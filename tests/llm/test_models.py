"""Quality, language, toxicity and language-model operators: brute force for what is counted, held-out accuracy for what is learned."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from gristmill.llm import attention_lm as A
from gristmill.llm import crf_quality as Q
from gristmill.llm import lang_mixture as M
from gristmill.llm import toxic_cnn as T
from gristmill.llm import wordhash as W

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, kept string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], SCHEMA)


def texts(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


ODD = [None, "", "\n \n", "one", "a b c a b c", "x y z w", "é È #$% <b>|</b>\nsame line here\nsame line here\n", "the cat sat " * 900, "\x1c odd"]


def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dups += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dups, len(inside)


def test_quality_counts(spark):
    docs = dict(enumerate([*ODD, *list(texts(spark).values())[:150]]))
    got = {r.doc_id: r for r in Q.judge(frame(spark, list(docs.items())), Q.Crf()).collect()}
    for k, t in docs.items():
        r, want = got[k], brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)[:80]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        crf = Q.Crf(rng.normal(size=len(Q.FEATURES)), rng.normal(size=(2, 2)), float(rng.normal()))
        x = rng.normal(size=(n, len(Q.FEATURES)))
        e = x @ crf.weights

        def worth(path):
            return crf.start * path[0] + sum(e[i] * s for i, s in enumerate(path)) + sum(crf.transitions[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(worth([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert worth(crf.decode(x).tolist()) == pytest.approx(best)


def test_quality_verdicts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    crf = Q.train(docs, labels)
    rows = Q.judge(docs, crf).join(labels, "doc_id").filter("not base_failed").select("quality", "kept").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.97
    assert np.mean([not r.kept for r in rows if r.quality == 0]) > 0.9
    empty = frame(spark, [])
    assert Q.train(empty, labels).weights is Q.PRIOR_WEIGHTS and Q.filter_quality(empty, labels).count() == 0
    assert Q.filter_quality(docs.withColumn("_row", docs.doc_id), labels).columns == [*docs.columns, "_row"]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = M.learn(docs.filter(M.remainder(3) != 1))
    assert np.allclose(np.exp(model.logs).sum(1), 1)
    rows = M.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(M.remainder(3) == 1).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_mixtures_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = M.learn(docs)
    by = {l: " ".join(r.text for r in docs.filter(docs.lang == l).limit(6).collect())[:6000] for l in ("de", "fr")}
    mixed = by["de"][:4000] + " " + by["fr"][:2000]
    pred, share, found = M.identify([mixed], model)[0]
    assert pred == "de" and 0.5 < share < 0.85 and "fr" in found
    got = {r.doc_id: (r.lang_pred, r.score) for r in M.predict(frame(spark, [(1, None), (2, ""), (3, "123 456 !!"), (4, by["de"])]), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "de"
    empty = M.learn(frame(spark, []))
    assert empty.langs == [] and M.identify(["words"], empty) == [("und", 0.0, "")]


def test_mixtures_reach_the_best_proportions(spark):
    """Expectation-maximisation against a search over the proportions of two languages, text by text and together."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = M.learn(docs)
    some = [t for t in texts(spark).values() if t][:40]
    together = M.identify([*some, "x", None, some[0]], model)
    assert together[:40] == [M.identify([t], model)[0] for t in some] and together[42] == together[0]
    de, fr = (model.langs.index(x) for x in ("de", "fr"))
    a = [r.text[:1500] for r in docs.filter("lang = 'de'").limit(3).collect()]
    b = [r.text[:900] for r in docs.filter("lang = 'fr'").limit(3).collect()]
    for x, y in zip(a, b, strict=True):
        g, _ = M.grams([x + " " + y])
        at, n = np.unique(g, return_counts=True)
        p = np.exp(model.logs[[de, fr]][:, at])
        share, like = M.mixtures(n.astype(float), p, np.array([0]), np.ones((2, 1)), steps=200)
        tried = np.linspace(0, 1, 2001)[1:-1]
        likes = [float(n @ np.log(s * p[0] + (1 - s) * p[1])) for s in tried]
        assert abs(share[0, 0] - tried[int(np.argmax(likes))]) < 2e-3 and like[0] >= max(likes) - 1e-6


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = T.train(docs.filter(M.remainder(3) != 1).select("doc_id", "text", "lang"), labels.filter(M.remainder(3) != 1))
    rows = T.predict(docs.filter(M.remainder(3) == 1), model).join(labels, "doc_id").collect()
    assert np.mean([r.predicted for r in rows if r.toxic == 1]) > 0.8
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.03
    odd = {r.doc_id: r for r in T.predict(frame(spark, [(k, t) for k, t in enumerate(ODD)]), model).collect()}
    assert all(0 <= r.score <= 1 for r in odd.values()) and odd[0].score == odd[1].score == odd[2].score < T.CUT


def test_toxicity_batches_equal_single_texts():
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "the", "der"]
    docs = [([rng.choice(words).encode() for _ in range(30)] + ([b"vile"] if k % 3 == 0 else []), int(k % 3 == 0)) for k in range(90)]
    model = T.fit(docs)
    some = [" ".join(w.decode() for w in ws) for ws, _ in docs[:20]] + ["", None, "the"]
    assert np.allclose(model.scores(some), [model.score(T.words_of(t)) for t in some], atol=1e-6)
    assert np.mean([(model.score(ws) >= T.CUT) == bool(y) for ws, y in docs]) > 0.95
    langs = T.fit([([b"der", b"und", rng.choice(words).encode()], 0) for _ in range(20)] + [([b"le", b"la"], 1) for _ in range(20)], ["de"] * 20 + ["fr"] * 20)
    assert langs.marks[b"der"] == langs.marks[b"und"] == 0 and langs.marks[b"la"] == 1 and len(langs.cuts) == 3
    flat = T.fit([([b"a"], 0)] * 5)
    assert flat.scores(["a", ""]).max() < T.CUT and T.fit([]).scores(["a"])[0] < T.CUT


def test_lm_scores(spark, monkeypatch):
    docs = frame(spark, [*[(10_000 + k, t) for k, t in enumerate(ODD)], *list(texts(spark).items())[:200]])
    head_of = A.head_of
    monkeypatch.setattr(A, "head_of", lambda c: head_of(c, 500))  # most words take the other way
    rows = {r.doc_id: r for r in A.score_texts(docs, M.remainder(10) != 0).collect()}
    words = {r.doc_id: WORD.findall("".join(c.lower() if c.isascii() else c for c in r.text or "")) for r in docs.select("doc_id", "text").collect()}
    train = {k for k in words if zlib.crc32(str(k).encode()) % 10}
    count = collections.Counter(w for k in train for w in words[k])
    n, v = sum(count.values()) + len(train), len(count) + 1
    for k, ws in words.items():
        r = rows[k]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    empty = frame(spark, [])
    assert A.score_texts(empty, M.remainder(10) != 0).count() == 0


def test_word_hashes():
    some = [t.encode() for t in ("a bb  a\tccc", "", "x" * 70 + " " + "x" * 71, "é a")]
    buffer, start, end, per = W.split(some)
    words = [buffer[i:j] for i, j in zip(start, end, strict=True)]
    assert words == [w for t in some for w in t.split()] and per.tolist() == [4, 0, 2, 2]
    h = W.hashes(buffer, start, end)
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    table = W.Table()
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    for part in np.array_split(keys, 37):
        table.add(part)
    assert table.find(keys).tolist() == list(range(len(keys))) and (table.find(keys + np.uint64(1)) == -1).mean() > 0.99


def test_table_takes_batches_without_new_keys():
    table = W.Table()
    none = np.zeros(0, np.uint64)
    assert table.add(none).tolist() == [] and table.find(np.array([3], np.uint64)).tolist() == [-1]
    table.add(np.array([5, 3], np.uint64))
    assert table.add(none).tolist() == [] and table.find(np.array([3, 4, 5], np.uint64)).tolist() == [1, -1, 0]
    assert table.add(np.array([4], np.uint64)).tolist() == [2]


def test_toxicity_learns_all_labelled_documents(spark):
    """Words in as few documents as may have a row count, wherever these stand; several shards, and any partitions, give one model."""
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    texts = [" ".join([*rng.choices(words, k=rng.randint(5, 20)), f"rare{k % 350}", *(["vile"] if k % 10 == 0 else []), str(k)]) for k in range(2800)]
    docs = [(k, t, ("de", "fr")[k % 2]) for k, t in enumerate(texts)] + [(5000, texts[0], "de"), (5001, None, None), (5002, "no label", "de"), (None, "nobody's", "de")]
    labels = [(k, int(k % 10 == 0)) for k in range(2800)] + [(3, 0), (3, None), (5000, 1), (5001, 0), (None, 1), (7, 5), (9999, 1)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    cases = T.labelled(d, y)
    assert sorted((bytes(r.words), r.toxic) for r in cases.collect()) == sorted({(b" ".join(T.words_of(t)), int(k % 10 == 0)) for k, t in enumerate(texts)} | {(b"", 0)})
    one = T.train(d.repartition(1), y)
    assert sum(zlib.crc32(f"rare{k}".encode()) in one.rows for k in range(350)) == 350  # each in 8 documents
    some = [*texts[:40], "vile", "alpha", None]
    same = T.fit([(T.words_of(t), int(k % 10 == 0)) for k, t in enumerate(texts)] + [([], 0)], [("de", "fr")[k % 2] for k in range(2800)] + [None])
    assert (one.scores(some) == same.scores(some)).all()
    assert np.mean([(s >= T.CUT) == (k % 10 == 0) for k, s in enumerate(one.scores(texts))]) > 0.99
    several = [T.train(d.repartition(n), y, shard=4000).scores(some) for n in (1, 6)]
    assert (several[0] == several[1]).all() and (several[0][:40] >= T.CUT).tolist() == [k % 10 == 0 for k in range(40)]

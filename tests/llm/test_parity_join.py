"""The parity-sketch join against all pairs by brute force; the pigeonhole and the lower bound by themselves."""

import collections
import random
import re

import numpy as np
import pytest
from oracle import differences

from gristmill.llm import parity_join as P
from gristmill.llm import shingle_near as N
from gristmill.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute(docs):
    sets = [(k, shingles(t)) for k, t in docs]
    own = {}
    for k, s in sets:
        own.setdefault(s, []).append(k)
    keys = [s for s in own if s]
    up = {s: s for s in keys}

    def top(s):
        while up[s] is not s:
            s = up[s]
        return s

    holders = collections.defaultdict(list)
    for i, s in enumerate(keys):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(keys):
        for j, inter in collections.Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * inter >= 90 * (len(s) + len(keys[j]) - inter):
                up[top(s)] = top(keys[j])
    ids = collections.defaultdict(list)
    for s in keys:
        ids[top(s)] += own[s]
    least = {t: min((k for k in v if k is not None), default=None) for t, v in ids.items()}
    return sorted(((k, len(s), least[top(s)] if s else k) for k, s in sets), key=repr)


def found(spark, docs, **options):
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fp string").repartition(3)
    return sorted((tuple(r) for r in P.near_duplicates(df.select("doc_id", "text")).collect()), key=repr)


def odd_docs(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = [word() for _ in range(60)]
    docs = [(900, None), (901, ""), (902, " \n\t "), (903, "One two"), (904, "one  TWO"), (905, "two one"), (906, "x"), (907, "X"), (908, "é É"), (909, "é é"), (None, "one two"), (None, "nobody else has this text")]
    for n in (9, 11, 12, 13, 25, 60, 100, 300, 1000, 3000):
        for edits in (0, 1, 2, 3, 5, 9, 17, 30):
            first = [word() for _ in range(n)]
            other = list(first)
            for k in rng.sample(range(n), min(n, edits)):
                other[k] = word()
            docs += [(len(docs), " ".join(first)), (len(docs) + 1, " ".join(other)), (len(docs) + 2, " ".join(first[: n - edits // 2]).upper())]
    base = [word() for _ in range(300)]
    for _ in range(80):  # a cluster of copies of copies
        base = base if rng.random() < 0.6 else list(other)
        other = list(base)
        for k in rng.sample(range(300), rng.randint(1, 5)):
            other[k] = word()
        docs.append((2000 + len(docs), " ".join(other)))
    docs += [(5000 + k, " ".join(passage + [word() for _ in range(rng.randint(2, 12))])) for k in range(60)]  # a passage in common
    return docs + docs[40:44] * 2


@pytest.mark.parametrize("cross", [P.CROSS, 3])
def test_against_all_pairs(spark, monkeypatch, cross):
    """With cross = 3 nearly every shared symbol is dealt a second time."""
    monkeypatch.setattr(P.links, "__defaults__", (cross,))
    docs = odd_docs(cross)
    got, want = found(spark, docs), brute(docs)
    assert got == want
    sizes = collections.Counter(c for _, n, c in want if n)
    assert sizes.most_common(1)[0][1] > 20 and len(sizes) > 100


def test_many_pairs_meet_by_joins(spark, monkeypatch):
    monkeypatch.setattr(P, "FEW", 0)
    docs = odd_docs(2)[-160:]
    assert found(spark, docs) == brute(docs)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op13_parity_join"](spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs)
    assert differences(got, ORACLE_SQL["op13_parity_join"], sf) == []


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("n", [9, 10, 12, 40, 333])
def test_linked_sets_share_a_key_in_either_deal(n):
    """At the largest difference that links, whatever it is: equal sizes, and one set within the other."""
    rng = np.random.default_rng(n)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for m, add in ((n // 19, n // 19), (n // 10, 0), (0, n // 9)):
            b = np.unique(np.concatenate((a[m:], rng.integers(0, 2**63, add).astype(np.uint64))))
            if 19 * len(np.intersect1d(a, b)) < 9 * (len(a) + len(b)):
                continue
            both = set(P.bands_of(len(a))) & set(P.bands_of(len(b)))
            for second in (False, True):
                assert both and any(set(P.keys(a, k, second).tolist()) & set(P.keys(b, k, second).tolist()) for k in both)
            bits = np.bitwise_count(N.sketch(a).view(np.uint64) ^ N.sketch(b).view(np.uint64)).sum()
            assert bits <= len(np.setxor1d(a, b))

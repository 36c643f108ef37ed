"""The near stage against all pairs by brute force."""

import random

import corpus_pipeline as C
from gristmill.llm import shingle_near as N
from tests_llm_brute import brute_near as brute

SF = "/root/testdata/sf0.001"


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def kept(spark, docs):
    return sorted(r.doc_id for r in C.STAGES[2][1](spark, frame(spark, docs), SF).collect())


def test_edited_copies_go(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = [word() for _ in range(40)]
    docs = [(900, None), (901, ""), (902, "One two"), (903, "one  TWO"), (904, "two one")]
    for n in (60, 100, 300, 1000):
        for edits in (1, 2, 3, 6, 12, 25):
            first = [word() for _ in range(n)]
            other = list(first)
            for k in rng.sample(range(n), edits):
                other[k] = word()
            docs += [(len(docs), " ".join(first)), (len(docs) + 1, " ".join(other))]
    base = [word() for _ in range(200)]
    for _ in range(60):  # a cluster: copies of copies, too
        base = base if rng.random() < 0.5 else list(other)
        other = list(base)
        for k in rng.sample(range(200), rng.randint(1, 7)):
            other[k] = word()
        docs.append((2000 + len(docs), " ".join(other)))
    docs += [(5000 + k, " ".join(passage + [word() for _ in range(20)])) for k in range(40)]
    want = brute(docs)
    assert kept(spark, docs) == want and len(want) < len(docs) - 20


def test_near_stage_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert kept(spark, docs) == brute(docs)
    assert N.near_dedup(frame(spark, [])).count() == 0


def test_nothing_hangs_on_what_the_index_nominates(spark, monkeypatch):
    """All fingerprints equal, so the index names pairs with one stand-in alone, which is like nobody: the others are found all the same."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    docs = [(k, " ".join(word() for _ in range(80))) for k in range(30)]
    docs += [(100 + k, " ".join([*t.split()[:78], word(), word()])) for k, t in docs[:20]]
    want = brute(docs)
    assert len(want) == 30
    monkeypatch.setattr(N, "simhash", lambda s: 0)
    assert kept(spark, docs) == want
    monkeypatch.setattr(N, "index_pairs", lambda fps: fps.selectExpr("fp AS a", "fp AS b").limit(0))
    assert kept(spark, docs) == want

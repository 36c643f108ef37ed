"""The pipeline stage by stage against brute force, and the registry."""

import collections

import numpy as np

import corpus_pipeline as C
from gristmill.llm import crf_quality as Q
from gristmill.llm import packing as K
from gristmill.llm import queries
from gristmill.llm import pareto_mix as X
from gristmill.llm.common import materialise, word_count
from tests_llm_brute import brute_lines, brute_near

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    quality, lines, near, mixing, packing = (f for _, f in C.STAGES)

    one = materialise(quality(spark, docs, SF))
    crf = Q.train(docs, labels)
    want = set()
    for k, r in rows.items():
        counts, features, sizes = Q.describe(r.text)
        if counts[0] >= Q.MIN_WORDS and 100 * counts[4] <= 50 * counts[0] and crf.content_share(features, sizes) >= crf.min_content:
            want.add(k)
    kept = {r.doc_id: r for r in one.collect()}
    assert set(kept) == want and one.columns == columns and all(kept[k] == rows[k] for k in want)

    two = materialise(lines(spark, one, SF))
    assert {r.doc_id: r.text for r in two.collect()} == brute_lines([(k, r.text) for k, r in kept.items()])
    assert all(r.n_chars == len(r.text) for r in two.collect()) and two.columns == columns

    three = materialise(near(spark, two, SF))
    t = sorted((r.doc_id, r.text) for r in two.collect())
    assert sorted(r.doc_id for r in three.collect()) == brute_near(t) and three.columns == columns

    four = materialise(mixing(spark, three, SF))
    times = collections.Counter(r.doc_id for r in four.collect())
    assert set(times) <= {r.doc_id for r in three.collect()} and max(times.values()) <= 3 and four.columns == columns
    words = {r.doc_id: len(r.text.split()) for r in three.collect()}
    taken = collections.Counter()
    for r in three.collect():
        taken[r.source] += words[r.doc_id] * times[r.doc_id]
    for r in X.targets(three.select("source", word_count(three.text).alias("size"))).collect():
        assert abs(taken[r.source] - r.target) <= max(words[x.doc_id] for x in three.collect() if x.source == r.source) / 2 + 1

    five = packing(spark, four, SF).collect()
    ids = K.WordIds(K.VOCABULARY).tokenizer
    size = {r.doc_id: len(ids.encode(r.text, add_special_tokens=False).ids) + 1 for r in three.collect()}
    assert sum(r.length for r in five) == sum(size[k] * n for k, n in times.items())
    at = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in five)
    assert [a for a, _ in at] == np.concatenate(([0], np.cumsum([n for _, n in at])[:-1])).tolist()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, extra columns with clashing names: what each stage returns is as its docstring says."""
    base = " ".join(f"word{k} of some length" for k in range(40))
    rows = [(1, base, "en", "a"), (1, base, "en", "a"), (None, base + " more", "en", None), (2, None, None, None), (3, "", "en", "a"), (4, base.replace("word7", "other"), "en", "b"), (5, "a different text entirely " * 9, "en", "b")]
    df = spark.createDataFrame([(*r, len(r[1] or ""), "f", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _file string, _place int, fp int")
    df.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, SF)
        if k < len(C.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.count()
    kept = C.STAGES[2][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 5]
    assert sum(r.doc_id is None for r in C.STAGES[1][1](spark, docs, SF).collect()) == 1


def test_pipeline_on_nothing(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_registry():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert [n for n, _ in C.STAGES] == ["quality", "lines", "near", "mixing", "packing"]


def test_sql_twins(spark):
    from oracle import differences

    for name, sql in queries.ORACLE_SQL.items():
        assert differences(queries.QUERIES[name](spark, SF), sql, SF) == [], name

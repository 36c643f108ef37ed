"""Line dedup, SimHash near-dedup and mixing against brute force."""

import random
import time

import numpy as np
import pytest

from gristmill.llm import line_dedup as L
from gristmill.llm import pareto_mix as X
from gristmill.llm import simhash_gray as S
from gristmill.llm.common import chosen_rows, rows_with_ids
from tests_llm_brute import brute_components, brute_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bitmap string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], SCHEMA)


def line_docs():
    rng = random.Random(1)
    pool = [f"line number {k} of a shared passage {'É' if k % 3 else 'x'}" for k in range(30)] + ["short", "", "  "]
    docs = [(k, "\n".join(rng.choice((str.upper, str, lambda s: f" \t{s}\r"))(rng.choice(pool)) for _ in range(rng.randrange(0, 200 if k == 7 else 12)))) for k in range(60)]
    return [*docs, (100, None), (101, ""), (102, "\n\n"), (103, pool[0] + "\n" + pool[0])]


def test_line_dedup(spark):
    docs = line_docs()
    got = {r.doc_id: r for r in L.dedup_lines(frame(spark, docs)).collect()}
    want = brute_lines(docs)
    assert {k: r.text for k, r in got.items()} == want
    for k, t in docs:
        assert got[k].n_lines == (t or "").count("\n") + 1
    assert L.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_hot_line(spark):
    docs = [(k, "the same licence line in all of them\nown " + str(k)) for k in range(500)]
    got = {r.doc_id: r.text for r in L.dedup_lines(frame(spark, docs)).collect()}
    assert got == brute_lines(docs)


def test_line_dedup_long_texts(spark):
    own = "\n".join(f"one of many lines number {k}" for k in range(60000))
    docs = [(1, own + "\nq" * 3), (2, "\n".join(["a line that one text repeats"] * 5000)), (3, own), (4, own), (5, "a line that one text repeats")]
    began = time.time()
    got = {r.doc_id: r.text for r in L.dedup_lines(frame(spark, docs)).collect()}
    assert time.time() - began < 60  # texts are hashed once, not once per line
    assert got == brute_lines(docs)


def test_line_rows_mark_a_key_once(spark):
    text = "the first line of the text\nshort\nThe First Line of the text \nanother line of the text"
    rows = sorted((r.at, r.marked) for r in L.line_rows(frame(spark, [(1, text)])).collect())
    assert rows == [(0, True), (2, False), (3, True)]


@pytest.mark.parametrize("group", [512, 3])
def test_links_find_every_component(spark, group):
    rng = random.Random(2)
    fps = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            for _ in range(rng.randrange(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps += [0, 1, 3, 7, 2**64 - 1]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    roots = {r.node: r.root for r in S.components(S.links(df, group=group)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    got = [roots.get(s, s) for s in signed]
    want = brute_components(fps)
    assert len(set(got)) == len(set(want))
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def test_dense_cluster_needs_few_steps():
    base = random.Random(4).getrandbits(64)
    near = np.array(sorted({base ^ (1 << a) for a in range(64)} | {base}), np.uint64)
    rank = near.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    assert set(S.linked(near[np.argsort(rank)])) == {0}


def test_fingerprint_contract():
    import xxhash

    def slow(text):
        w = [x for x in (text or "").encode().lower().split()]
        if not w:
            return 0
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in (None, "", " \n", "One", "one two", "a b c", "A b C d e f g", "x y z " * 50, "é È ñ Ñ"):
        assert S.fingerprint(t) == slow(t), t


def test_near_dedup_keeps_one(spark):
    base = " ".join(f"w{k}" for k in range(2000))
    docs = [(5, base), (3, base), (3, base), (9, base.replace("w7 ", "W7 ")), (11, "other words entirely here now"), (12, None), (13, "")]
    got = sorted((r.doc_id, r.component_id) for r in S.near_duplicates(frame(spark, docs)).collect())
    assert got == [(3, 3), (3, 3), (5, 3), (9, 3), (11, 11), (12, 12), (13, 12)]
    assert sorted(r.doc_id for r in S.near_dedup(frame(spark, docs)).collect()) == [3, 11, 12]
    assert S.near_duplicates(frame(spark, [])).count() == 0


def mix_docs(n=3000):
    rng = random.Random(6)
    source = lambda k: None if k % 50 == 0 else ("hot" if k % 3 == 0 else f"s{k % 7}")
    return [(k, " ".join("w" * rng.randrange(1, 60)), "en", source(k)) for k in range(n)] + [(n, None, "en", "empty"), (n + 1, "", "en", "empty")]


def test_mix_meets_targets(spark):
    docs = mix_docs()
    rows = X.draws(rows_with_ids(frame(spark, docs))).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.source, [0, 0, r.target, 0])
        sizes[r.source][0] += r.size
        sizes[r.source][1] += r.size * r.copies
        sizes[r.source][3] = max(sizes[r.source][3], r.size)
        assert 0 <= r.copies <= 3
    total = sum(s for s, *_ in sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:
        left = total - sum(3 * sizes[s][0] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s, t in share.items() if t > 3 * sizes[s][0]}
        if not over:
            break
        capped |= over
    for s in order:
        want = 3 * sizes[s][0] if s in capped else share[s]
        assert sizes[s][2] == pytest.approx(want)
        assert abs(sizes[s][1] - want) <= sizes[s][3] / 2 + 1e-6
    again = X.draws(rows_with_ids(frame(spark, list(reversed(docs))))).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in rows)
    mixed = X.mix(frame(spark, docs))
    assert mixed.count() == sum(r.copies for r in rows) and mixed.columns == frame(spark, docs).columns


def test_mix_of_nothing(spark):
    assert X.draws(rows_with_ids(frame(spark, []))).count() == 0
    assert [r.copies for r in X.draws(rows_with_ids(frame(spark, [(1, None), (2, "")]))).collect()] == [0, 0]
    same = X.draws(rows_with_ids(frame(spark, [(1, "a b c", "en", "s")] * 4))).collect()
    assert sum(r.size * r.copies for r in same) == 12


def test_equal_rows_are_drawn_one_by_one(spark):
    """2,000 equal rows: their source is within one document of its target."""
    docs = [(1, "a b c d e f g h i j", "en", "a")] * 2000 + [(k, " ".join("w" * 30), "en", "b") for k in range(2, 400)]
    rows = X.draws(rows_with_ids(frame(spark, docs))).collect()
    for source, largest in (("a", 10), ("b", 30)):
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= largest
    once = sorted((r.doc_id, r.copies) for r in rows)
    assert once == sorted((r.doc_id, r.copies) for r in X.draws(rows_with_ids(frame(spark, docs[::-1]).repartition(7))).collect())


def test_inclusion_follows_size(spark):
    """Long documents are drawn more often than short ones, as often as their probabilities say, and the rank decides who."""
    rng = random.Random(3)
    docs = [(k, " ".join("w" * rng.choice((4, 16, 64, 256))), "en", "s" if k % 2 else "t") for k in range(4000)]
    rows = X.draws(rows_with_ids(frame(spark, docs))).collect()
    extra, left, words = {}, {}, {}
    for r in rows:
        whole = int(r.target / r.source_size + 1e-12)
        extra.setdefault((r.source, r.size), []).append(r.copies - whole)
        left[r.source] = r.target - whole * r.source_size
        words[r.source] = words.get(r.source, 0) + r.size**1.5
    for (source, size), got in extra.items():
        p = left[source] * size**0.5 / words[source]  # no class reaches 1 here
        assert 0 < p < 1 and abs(np.mean(got) - p) < 4 * (p * (1 - p) / len(got)) ** 0.5


def test_rows_by_place(spark, tmp_path):
    frame(spark, [(k, f"t{k}") for k in range(3000)]).repartition(3).write.parquet(str(tmp_path / "d"))
    rows = rows_with_ids(spark.read.parquet(str(tmp_path / "d")))
    times = rows.filter("_row.doc_id % 3 > 0").selectExpr("_file", "_place", "cast(_row.doc_id % 3 as byte) as _times")
    for limit in (1 << 25, 0):
        got = sorted((r["_row"]["doc_id"], r["_times"]) for r in chosen_rows(rows, times, limit).collect())
        assert got == [(k, k % 3) for k in range(3000) if k % 3]
    twice = frame(spark, [(1, "a")]).unionAll(frame(spark, [(1, "a")]))  # not a scan: written first
    assert rows_with_ids(twice).select("_file", "_place").distinct().count() == 2

import math

import numpy as np

from riskframe.llm import ann
from riskframe.sources.tables import table


def brute(rows, every, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in good:
        if q % every:
            continue
        a = np.array(a)
        sims = sorted((-float(a @ np.array(b) / (np.linalg.norm(a) * np.linalg.norm(b))), i) for i, b in good if i != q and len(b) == len(a))
        out[q] = sims[:k]
    return out


def recall(got, want):
    near = {}
    for r in got:
        near.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q, sims in want.items():
        rows = sorted(near.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(sims) + 1))
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(rows, rows[1:]))
        edge = sims[-1][0] if sims else 0
        hits += sum(-r.score <= edge + 1e-9 for r in rows)
        total += len(sims)
    return hits / max(total, 1)


def test_recall_on_the_given_vectors(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert recall(ann.neighbours(df).collect(), brute(rows, 50, 5)) >= 0.9


def test_recall_with_all_leaves(spark):
    """Enough vectors to fill every leaf, random but around centres, as embeddings are."""
    rng = np.random.default_rng(17)
    centres = rng.standard_normal((40, 64))
    vectors = (centres[rng.integers(0, 40, 5000)] + rng.standard_normal((5000, 64))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    assert len(rows) > ann.TREES * ann.LEAF_ROWS * 2 ** ann.DEPTH // 4
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert recall(ann.neighbours(df, every=200).collect(), brute(rows, 200, 5)) >= 0.9


def test_odd_vectors_and_large_classes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0, None] + [0.0] * 6), (2004, [float("nan")] * 8),
             (2005, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (2010, [1.0, 2.0]), rows[0], rows[50], (2050, [2.0, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, leaf int")
    want = {q: s for q, s in brute(rows, 50, 5).items() if q != 2010}
    for block in (8192, 40):
        got = ann.neighbours(df, visits=10_000, block=block).collect()
        assert recall(got, want) == 1.0
        by = {(r.query_id, r["rank"]): r.vec_id for r in got}
        assert [by[1100, i] for i in range(1, 6)] == [1000, 1001, 1002, 1003, 1004]
        assert by[1000, 1] == 1001


def test_empty_and_tiny(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.neighbours(df).collect() == []
    one = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert ann.neighbours(one).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.neighbours(two).collect()] == [(0, 1, 7, 0.0)]

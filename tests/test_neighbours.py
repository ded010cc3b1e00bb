"""Exact neighbours and synthetic rows against plain loops on small, awkward tables."""

import math
import random

from riskframe.operators import neighbours as N
from riskframe.operators import oversample as O


def brute(queries, points, k):
    out = []
    for qi, qv in queries:
        near = sorted((sum_squares(qv, pv), pi) for pi, pv in points if pi != qi)[:k]
        out += [(qi, r + 1, pi, math.sqrt(sq)) for r, (sq, pi) in enumerate(near)]
    return sorted(out)


def sum_squares(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return total


def rows_with_ties(n, seed):
    rng = random.Random(seed)
    rows = [(i, (float(rng.randrange(6)), float(rng.randrange(4)), rng.choice([0.0, 0.5]))) for i in range(n)]
    rows += [(1000 + i, (2.0, 2.0, 0.0)) for i in range(n)]                # a large group of copies
    rows += [(5000 + i, (rng.gauss(50, 20), rng.gauss(0, 1), rng.random() * 1e6)) for i in range(n)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, *v) for i, v in rows], "event_id long, a double, b double, c double")


def test_equals_brute_force_whatever_the_blocks(spark):
    rows = rows_with_ties(60, 4)
    df = frame(spark, rows)
    queries = [r for r in rows if r[0] % 3 == 0]
    want = brute(queries, rows, 4)
    for pivots, block in ((64, 2048), (5, 7), (1, 1)):
        got = N.knn_join(df.where("event_id % 3 = 0"), df, ["a", "b", "c"], 4, pivots=pivots, block=block)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_a_block_with_many_visitors_is_copied(spark, monkeypatch):
    monkeypatch.setattr(N, "VISITORS", 10)
    rows = rows_with_ties(40, 9)
    df = frame(spark, rows)
    got = N.knn_join(df, df, ["a", "b", "c"], 2, pivots=3, block=50)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, rows, 2)


def test_absent_values_few_points_and_empty(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, float("nan"), 1.0), (3, 1.0, 1.0), (4, 1.0, 3.0), (None, 1.0, 1.0), (5, float("inf"), 0.0)],
                               "event_id long, a double, v double")
    assert sorted(tuple(r) for r in N.knn_join(df, df, ["a", "v"], 3).collect()) == [(3, 1, 4, 2.0), (4, 1, 3, 2.0)]
    none = df.where("event_id > 10")
    assert N.knn_join(df, none, ["a", "v"], 3).collect() == [] and N.knn_join(none, df, ["a", "v"], 3).collect() == []
    assert len(N.knn_join(df, df, ["a", "v"], 5, itself=True).collect()) == 4


def classes(spark, n_many, n_few, seed=2):
    rng = random.Random(seed)
    rows = [(i, 0, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(n_many)] + [(900 + i, 1, rng.gauss(1, 1), rng.gauss(1, 1)) for i in range(n_few)]
    return rows, spark.createDataFrame(rows, "event_id long, Class int, a double, b double")


def test_smote_balances_between_neighbours(spark):
    rows, df = classes(spark, 97, 12)
    at = {r[0]: r[2:] for r in rows}
    near = {}
    for q, _, p, _ in brute([(i, at[i]) for i in at if i >= 900], [(i, at[i]) for i in at if i >= 900], 5):
        near.setdefault(q, set()).add(p)
    made = O.smote(df, "Class", ["a", "b"]).collect()
    assert len(made) == 85
    assert max(sum(r.event_id == i for r in made) for i in near) - min(sum(r.event_id == i for r in made) for i in near) <= 1
    for r in made:
        assert r.neighbour in near[r.event_id] and 0 <= r.share < 1
        assert r.a == at[r.event_id][0] + r.share * (at[r.neighbour][0] - at[r.event_id][0])
    whole = O.balanced(df, O.smote(df, "Class", ["a", "b"]), "Class", ["a", "b"]).collect()
    assert len({r.event_id for r in whole}) == len(whole) == 194 and sum(r.Class for r in whole) == 97


def test_no_minority_or_a_single_row_gives_nothing(spark):
    for many, few in ((5, 1), (5, 0), (0, 4), (3, 8)):
        _, df = classes(spark, many, few)
        assert O.smote(df, "Class", ["a", "b"]).collect() == []


def test_tomek_links_are_mutual_and_opposite(spark):
    rows, df = classes(spark, 60, 40, 8)
    nearest = {q: p for q, _, p, _ in brute([(r[0], r[2:]) for r in rows], [(r[0], r[2:]) for r in rows], 1)}
    cls = {r[0]: r[1] for r in rows}
    want = sorted((a, b) for a, b in nearest.items() if a < b and nearest[b] == a and cls[a] != cls[b])
    assert want and sorted(tuple(r) for r in O.tomek_links(df, "Class", ["a", "b"]).collect()) == want


def test_vectors_of_queries_and_points_are_written_once(spark, monkeypatch):
    """Points are cut into blocks once for both joins of the Tomek links; pairs of query and block are written without a vector each."""
    rng = random.Random(11)
    rows = [(i, i % 3 == 0, *[rng.gauss(0, 1) for _ in range(3)]) for i in range(400)]
    df = spark.createDataFrame([(i, int(c), *v) for i, c, *v in rows], "event_id long, Class int, a double, b double, c double")
    kept = {}

    def noted(frame, tag):
        kept.setdefault(tag, []).append(out := whole(frame, tag))
        return out
    whole = N.written
    monkeypatch.setattr(N, "written", noted)
    got = {tuple(r) for r in O.tomek_links(df, "Class", ["a", "b", "c"]).collect()}
    nearest = {i: min((sum((x - y) ** 2 for x, y in zip(v, w)), j) for j, _, *w in rows if j != i)[1] for i, _, *v in rows}
    label = {i: c for i, c, *_ in rows}
    assert got == {(i, j) for i, j in nearest.items() if i < j and nearest[j] == i and label[i] != label[j]}
    assert len(kept["knn-blocks"]) == 1 and "knn-home" not in kept
    small = N.Points(df, ["a", "b", "c"], block=8)
    assert N.knn_join(df, small, ["a", "b", "c"], 3).count() == 1200
    assert max(len(r.blocks) for r in kept["knn-rest"][-1].collect()) > 1 and kept["knn-rest"][-1].count() <= 400

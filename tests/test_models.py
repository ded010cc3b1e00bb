"""Mappers, saved models, stacking, tuning, tree structure and Shapley values on small tables."""

import itertools
import math
import random
import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from riskframe.functions.dims import V_NAMES
from riskframe.functions.ranking import depth_bucket
from riskframe.operators import ensemble, mapper, metrics, models, persist, sampling, shapley, surrogate, trees


def mapping_frame(spark, n=300):
    rng = np.random.default_rng(42)
    x = rng.standard_normal((n, 8))
    y = x @ rng.standard_normal((8, 28)) * 0.35 + 0.3 * rng.standard_normal((n, 28))
    rows = [(i, x[i].tolist(), *y[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "request_id long, x array<double>, " + ", ".join(f"{v} double" for v in V_NAMES)) \
        .withColumn("features", array_to_vector("x"))


def test_mapper_errors_persistence_and_spread(spark, tmp_path):
    df = mapping_frame(spark)
    train, test = df.where("request_id % 5 <> 0"), df.where("request_id % 5 = 0")
    model = mapper.MultiOutputRegressor("forest", V_NAMES, trees=8, depth=5).fit(train)
    rows = mapper.errors(model.transform(test), V_NAMES).collect()
    assert len(rows) == 28 and all(r.n == 60 for r in rows)
    assert np.mean([r.mse for r in rows]) < 2 and np.mean([r.mae for r in rows]) < 1 and np.mean([r["corr"] for r in rows]) > 0.3
    path = str(tmp_path / "mapper")
    model.save(path)
    again = mapper.MultiOutputModel.load(spark, path)
    first = {r.request_id: r.estimate for r in model.transform(test).collect()}
    assert first == {r.request_id: r.estimate for r in again.transform(test).collect()}
    some = again
    some.targets, some.models, some.means, some.stds = some.targets[:2], some.models[:2], some.means[:2], some.stds[:2]
    for r in some.tree_spread(test, "request_id", path).collect():
        want = first[r.request_id][V_NAMES.index(r.target)]
        assert abs(r.estimate - want) < 1e-9 and r["std"] > 0
    shares = {}
    for r in again.importance([f"f{i}" for i in range(8)]).collect():
        shares.setdefault(r.target, []).append(r.importance)
    assert all(abs(sum(v) - 1) < 1e-9 for v in shares.values()) and "all" in shares


def test_mapper_caches_node_numbers_and_grows_the_same_trees(spark):
    df, some = mapping_frame(spark), V_NAMES[:2]
    fit = mapper.MultiOutputRegressor("forest", some, trees=4, depth=5)
    grown = fit._regressor()
    assert grown.getCacheNodeIds()
    own = df.select("features", F.col("V1").alias("label")).coalesce(1).cache()
    assert grown.fit(own).toDebugString.split("\n")[1:] == grown.copy({grown.cacheNodeIds: False}).fit(own).toDebugString.split("\n")[1:]


def test_mapper_writes_and_reads_targets_side_by_side(spark, tmp_path, monkeypatch):
    df, some = mapping_frame(spark, 60), V_NAMES[:2]
    model = mapper.MultiOutputRegressor("forest", some, trees=2, depth=2).fit(df)
    gate = threading.Barrier(2, timeout=60)           # two at once, or the test ends here

    class Writer:
        def __init__(self, of):
            self.of = of

        def write(self):
            gate.wait()
            return self.of.write()
    model.models = [Writer(m) for m in model.models]
    model.save(str(tmp_path / "m"))
    load = mapper.RandomForestRegressionModel.load

    def gated(path):
        gate.wait()
        return load(path)
    monkeypatch.setattr(mapper.RandomForestRegressionModel, "load", gated)
    again = mapper.MultiOutputModel.load(spark, str(tmp_path / "m"))
    assert again.targets == some and [m.totalNumNodes for m in again.models] == [w.of.totalNumNodes for w in model.models]


def test_boosted_mapper_search_and_training_run(spark):
    df = mapping_frame(spark)
    some = V_NAMES[:2]
    grid = [{"trees": 1, "depth": 1}, {"trees": 8, "depth": 3, "step": 0.3}]
    found = {r.candidate: r for r in mapper.tune_mapper(df, "boosted", grid, "request_id", some, n_rows=150).collect()}
    assert set(found) == {0, 1} and found[1].is_best and not found[0].is_best and found[0].mean_score < found[1].mean_score < 0
    train, validation, test = df.where("request_id % 10 < 7"), df.where("request_id % 10 = 7"), df.where("request_id % 10 > 7")
    fits = {"forest": lambda t: mapper.MultiOutputRegressor("forest", some, trees=4, depth=4).fit(t),
            "boosted": lambda t: mapper.MultiOutputRegressor("boosted", some, **grid[1]).fit(t)}

    def broken(_):
        raise ValueError("no such thing")
    models = {n: f(train) for n, f in fits.items()}
    got = {r.model: r for r in mapper.train_run(train, validation, test, {n: lambda _, m=m: m for n, m in models.items()} | {"broken": broken}, "request_id", some).collect()}
    assert set(got) == {"forest", "boosted", "ensemble", "broken"}
    assert all((r.n_train, r.n_validation, r.n_test) == (210, 30, 60) for r in got.values())
    assert "no such thing" in got["broken"].error and got["broken"].mse is None and not got["broken"].is_best

    def by_hand(rows):
        y = np.array([[r[t] for t in some] for r in rows.orderBy("request_id").collect()])
        return y, {n: np.array([r.estimate for r in m.transform(rows).orderBy("request_id").collect()]) for n, m in models.items()}
    y, e = by_hand(validation)
    corr = lambda a, b: np.mean([np.corrcoef(a[:, i], b[:, i])[0, 1] for i in range(2)])
    score = {n: corr(y, v) - 0.1 * np.mean((y - v) ** 2) for n, v in e.items()}
    low = min(score.values())
    score = {n: v - low + 0.1 if low < 0 else v for n, v in score.items()}
    weight = {n: v / sum(score.values()) for n, v in score.items()}
    y, e = by_hand(test)
    e["ensemble"] = sum(weight[n] * e[n] for n in weight)
    for n, v in e.items():
        assert abs(got[n].mse - np.mean((y - v) ** 2)) < 1e-9 and abs(got[n].mae - np.mean(np.abs(y - v))) < 1e-9
        assert abs(got[n]["corr"] - corr(y, v)) < 1e-9
        assert n == "ensemble" or abs(got[n].weight - weight[n]) < 1e-9
    assert got[min(e, key=lambda n: np.mean((y - e[n]) ** 2))].is_best and sum(r.is_best for r in got.values()) == 1
    alone = mapper.train_run(train, validation, test.limit(0), {"forest": lambda _: models["forest"], "broken": broken}, "request_id", some).collect()
    assert {r.model for r in alone} == {"forest", "broken"} and all(r.mse is None and not r.is_best for r in alone)
    assert [r.error is not None for r in mapper.train_run(train, validation, test, {"broken": broken}, "request_id", some).collect()] == [True]


def test_weights_and_combinations(spark):
    scores = lambda *xs: spark.createDataFrame([(f"m{i}", x) for i, x in enumerate(xs)], "member string, score double")
    got = lambda *xs: [round(r.weight, 9) for r in mapper.ensemble_weights(scores(*xs)).orderBy("member").collect()]
    assert got(0.6, 0.2) == [0.75, 0.25]
    assert got(0.3, -0.2) == [round(0.6 / 0.7, 9), round(0.1 / 0.7, 9)]
    assert got(None, 0.2) == [0.5, 0.5] and got(0.0, 0.0) == [0.5, 0.5]
    w = mapper.ensemble_weights(scores(0.6, 0.2))
    df = spark.createDataFrame([(1, (1.0, 0.9), (5.0, 0.8)), (2, (1.0, 0.6), (5.0, 0.65)), (3, (1.0, None), (5.0, 0.0)), (4, (1.0, 0.7), (5.0, 0.7))],
                               "id int, m0 struct<value: double, confidence: double>, m1 struct<value: double, confidence: double>")
    out = df.select("id", *[mapper.combine(["m0", "m1"], w, h).alias(h) for h in ("weighted_average", "confidence_weighted", "best_model")]).orderBy("id").collect()
    assert [round(r.weighted_average, 9) for r in out] == [2.0] * 4
    assert [round(r.confidence_weighted, 9) for r in out] == [round((.75 * .9 + 5 * .25 * .8) / (.75 * .9 + .25 * .8), 9), round((.75 * .6 + 5 * .25 * .65) / (.75 * .6 + .25 * .65), 9), 1.0, 2.0]
    assert [round(r.best_model, 9) for r in out] == [1.0, 2.0, 2.0, 1.0]


def labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, a, b, int(rng.random() < 1 / (1 + math.exp(-(2 * a - b - 1.5))))))
    return spark.createDataFrame(rows, "event_id long, a double, b double, Class int")


def test_out_of_fold_scores_come_from_models_that_never_saw_the_row(spark):
    df = labelled(spark, 120)

    def memory(frame):
        seen = frame.select("event_id", F.lit(1.0).alias("p"))
        return lambda rows: rows.select("event_id").join(seen, "event_id", "left").select("event_id", F.coalesce("p", F.lit(0.0)).alias("p"))

    def own_label(frame):
        return lambda rows: rows.select("event_id", F.col("a").alias("p"))
    oof = ensemble.out_of_fold(df, {"memory": memory, "signal": own_label}, "Class", "event_id").collect()
    assert len(oof) == 120 and {r.fold for r in oof} == {0, 1, 2}
    assert all(r.memory == 0.0 for r in oof)
    scored = ensemble.stack(df, {"memory": memory, "signal": own_label}, "Class", "event_id")(df)
    assert metrics.roc_auc(scored.join(df.select("event_id", F.col("Class").alias("y")), "event_id")).first().roc_auc > 0.65


def test_grid_scores_are_the_average_precision_of_each_fold(spark):
    df = labelled(spark).withColumn("label", F.col("Class").cast("double"))
    lr = LogisticRegression(featuresCol="features", labelCol="label")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), lr])
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 5.0]).build()
    got = ensemble.tune_grid(df, pipe, grid, "Class", "event_id").orderBy("candidate").collect()
    folds = sampling.stratified_kfold(df, "Class", "event_id", k=3).cache()
    for i, params in enumerate(grid):
        scores = []
        for f in range(3):
            held = pipe.copy(params).fit(folds.where(F.col("fold") != f)).transform(folds.where(F.col("fold") == f))
            scored = held.select(F.col("Class").alias("y"), vector_to_array("probability")[1].alias("p"))
            scores.append(metrics.average_precision(scored).first().average_precision)
        assert abs(got[i].mean_score - sum(scores) / 3) < 1e-9
    assert [r.is_best for r in got].count(True) == 1


def test_grid_fits_what_candidates_share_once_a_fold(spark, monkeypatch):
    df = labelled(spark).withColumn("label", F.col("Class").cast("double"))
    lr = LogisticRegression(featuresCol="features", labelCol="label")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), lr])
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 1.0]).addGrid(lr.maxIter, [200, 1, 100]).build()
    calls = {"scaler": 0, "logistic": 0, "judged": 0}

    def counted(owner, name, kind):
        whole = getattr(owner, name)

        def call(*a, **k):
            calls[kind] += 1
            return whole(*a, **k)
        monkeypatch.setattr(owner, name, call)
    counted(StandardScaler, "_fit", "scaler")
    counted(LogisticRegression, "_fit", "logistic")
    counted(metrics, "average_precision", "judged")
    got = ensemble.tune_grid(df, pipe, grid, "Class", "event_id").orderBy("candidate").collect()
    # one iteration is not enough, a hundred are: the fit with two hundred would be the same
    assert calls == {"scaler": 3, "logistic": 12, "judged": 3}
    monkeypatch.undo()
    folds = sampling.stratified_kfold(df, "Class", "event_id", k=3).cache()
    for i, params in enumerate(grid):
        scores = []
        for f in range(3):
            held = pipe.copy(params).fit(folds.where(F.col("fold") != f)).transform(folds.where(F.col("fold") == f))
            scores.append(metrics.average_precision(held.select(F.col("Class").alias("y"), vector_to_array("probability")[1].alias("p"))).first().average_precision)
        assert abs(got[i].mean_score - np.mean(scores)) < 1e-9 and abs(got[i].std_score - np.std(scores)) < 1e-9
        assert got[i].params == {"regParam": str(params[lr.regParam]), "maxIter": str(params[lr.maxIter])}
    best = max(round(r.mean_score, 12) for r in got)
    assert [r.candidate for r in got if r.is_best] == [min(r.candidate for r in got if round(r.mean_score, 12) == best)]


def test_depth_bucket_counts_the_bounds_below(spark):
    rng = random.Random(8)
    values = [rng.gauss(0, 1) for _ in range(700)] + [0.25] * 200 + [None, float("nan"), float("-inf"), float("inf")]
    for some in (values, values[:3], [None, None], [1.0] * 5):
        df = spark.createDataFrame([(v,) for v in some], "p double")
        bounds = df.select(F.percentile_approx("p", [i / 256 for i in range(1, 256)], 10_000)).first()[0]
        for r in depth_bucket(df, "p").collect():
            assert r._depth == (0 if r.p is None else 255 if math.isnan(r.p) and not math.isnan(bounds[-1]) else sum(b < r.p for b in bounds))


def test_saved_model_scores_alike_and_is_found(spark, tmp_path):
    df = labelled(spark)
    fits = []

    def fit():
        fits.append(1)
        return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), LogisticRegression(labelCol="Class")]).fit(df)
    first, second = (persist.stored(spark, str(tmp_path), "small", "logistic_regression", ["a", "b"], fit, note="x") for _ in range(2))
    assert fits == [1]
    a, b = ([tuple(r.probability) for r in m.transform(df).orderBy("event_id").collect()] for m in (first, second))
    assert a == b
    row = persist.metadata(spark, persist.model_path(spark, str(tmp_path), "small")).first()
    assert row.features == ["a", "b"] and row.stages[-1] == "LogisticRegressionModel" and row.details == '{"note": "x"}'
    assert not persist.exists(spark, str(tmp_path / "nothing"))


def test_tree_structure_equals_the_debug_text(spark, tmp_path):
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(labelled(spark))
    model = GBTClassifier(labelCol="Class", maxIter=5, maxDepth=3, seed=1).fit(df)
    model.write().save(str(tmp_path / "gbt"))
    nodes = trees.node_table(spark, str(tmp_path / "gbt"))
    text = model.toDebugString
    got = {r.feature: r.splits for r in trees.feature_structure(nodes, ["a", "b", "unused"]).collect()}
    assert got == {"a": text.count("If (feature 0"), "b": text.count("If (feature 1"), "unused": 0}
    per = trees.tree_complexity(nodes).orderBy("tree").collect()
    assert [(r.nodes, r.depth) for r in per] == [(t.numNodes, t.depth) for t in model.trees]
    assert all(r.leaves == (r.nodes + 1) // 2 for r in per)
    leaves = trees.leaf_index(model, df, "event_id").collect()
    assert all(len(r.leaf) == 5 and all(0 <= x < p.leaves for x, p in zip(r.leaf, per)) for r in leaves)


def test_shapley_sums_and_equals_the_exact_values(spark):
    features = ["a", "b", "c", "d"]
    rng = random.Random(4)
    rows = [(i, *[rng.gauss(0, 1) for _ in features]) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, c double, d double")
    f = lambda a, b, c, d: a * b + 2 * c - c * d * d + 0.5

    def score(frame):
        v = vector_to_array("raw")
        return frame.withColumn("p", v[0] * v[1] + 2 * v[2] - v[2] * v[3] * v[3] + 0.5)
    ground = shapley.background_rows(df, features, "event_id", 3)
    assert len(ground) == 3
    exact = {r.event_id: r for r in shapley.shapley(df, features, score, ground, permutations=24, every_background=True).collect()}
    for i, *x in rows:
        want = [0.0] * 4
        for order in itertools.permutations(range(4)):
            for b in ground:
                now, was = list(b), f(*b)
                for j in order:
                    now[j] = x[j]
                    want[j] += (f(*now) - was) / (24 * 3)
                    was = f(*now)
        assert all(abs(g - w) < 1e-9 for g, w in zip(exact[i].contributions, want))
        assert abs(exact[i].base - sum(f(*b) for b in ground) / 3) < 1e-9
    for r in shapley.shapley(df, features, score, ground, permutations=5).collect():
        x = next(row[1:] for row in rows if row[0] == r.event_id)
        assert abs(r.base + sum(r.contributions) - r.prediction) < 1e-9 and abs(r.prediction - f(*x)) < 1e-9


def test_local_surrogate_of_a_linear_score(spark):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 3), 2.0, None if i == 7 else rng.random()) for i in range(40)] + [(3, 9.0, 1.0, 2.0, 0.5)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, c double, d double").repartition(3)
    names, weight = ["a", "b", "c", "d"], [0.5, -0.25, 4.0, 0.0]
    linear = lambda f: f.withColumn("p", sum((vector_to_array("raw")[i] * w for i, w in enumerate(weight)), F.lit(1.0)))
    got = surrogate.local_surrogate(df, names, linear, samples=24).collect()
    assert len(got) == len(rows)
    scale = [float(np.std([r[i + 1] or 0.0 for r in rows])) for i in range(4)]
    want = sorted((r[0], round(1 + sum(w * (v or 0.0) for w, v in zip(weight, r[1:])), 6)) for r in rows)
    assert sorted((r.event_id, round(r.prediction, 6)) for r in got) == want
    for r in got:
        assert np.allclose(r.coefficients, [w * s for w, s in zip(weight, scale)], atol=1e-5) and abs(r.intercept - r.prediction) < 1e-5 and r.r2 > 0.999999
    still = surrogate.local_surrogate(df, names, lambda f: f.withColumn("p", F.lit(0.25)), samples=24).collect()
    assert all(abs(r.intercept - 0.25) < 1e-6 and np.allclose(r.coefficients, 0, atol=1e-6) and math.isnan(r.r2) for r in still)
    assert surrogate.local_surrogate(df.where("false"), names, linear, samples=24).count() == 0


def test_normal_draws_are_the_hashes_of_spark(spark):
    ids = [0, 1, -7, 1 << 40, None]
    want = spark.createDataFrame([(i, m, f) for i in ids for m in range(3) for f in range(4)], "id long, m int, f int") \
        .select(*[F.pmod(F.xxhash64("id", "m", "f", F.lit(2 * 42 + k)), F.lit(1 << 53)).alias(f"u{k}") for k in range(2)]).collect()
    u = np.array([[(r.u0 + 1) / ((1 << 53) + 1), (r.u1 + 1) / ((1 << 53) + 1)] for r in want]).reshape(len(ids), 3, 4, 2)
    z = np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * math.pi * u[..., 1])
    z[:, 0] = 0
    known = np.array([i is not None for i in ids])
    assert np.allclose(surrogate.normals(np.array([i or 0 for i in ids], np.int64), known, 3, 4, 42), z, atol=1e-12)


def test_explainers_make_points_in_arrays_and_sum_where_they_are(spark):
    """The walk of a row leaves its task as sums, and no expression is evaluated per point and feature."""
    df = spark.createDataFrame([(i, float(i), 1.0, 2.0) for i in [1, 2, 3, 3]], "event_id long, a double, b double, c double")
    names = ["a", "b", "c"]
    score = lambda f: f.withColumn("p", vector_to_array("raw")[0] + 2 * vector_to_array("raw")[2])
    values = shapley.shapley(df, names, score, [[0.0, 0.0, 0.0]], "event_id")
    for plan in (x._jdf.queryExecution().optimizedPlan().toString() for x in (values, surrogate.local_surrogate(df, names, score, samples=8))):
        assert plan.count("MapInArrow") == 2 and "lambda" not in plan and "Generate" not in plan
    got = {r.event_id: r for r in values.collect()}
    assert sorted(got) == [1, 2, 3]                                  # rows of one id are one row
    assert all(np.allclose(got[i].contributions, [i, 0, 4]) and got[i].base == 0 for i in got)
    moved = lambda f: score(f).orderBy("p")
    for rows, by, said in ((df, moved, "score has moved rows"), (df.withColumn("c", F.lit(None).cast("double")), score, "a feature is null")):
        with pytest.raises(Exception, match=said):
            shapley.shapley(rows, names, by, [[0.0, 0.0, 0.0]], "event_id").collect()


def test_saved_forests_are_walked_as_spark_walks_them(spark, tmp_path, monkeypatch):
    df, some = mapping_frame(spark, 80), V_NAMES[:2]
    odd = spark.createDataFrame([(900, [float("nan")] * 8), (901, [0.0] * 8), (902, [float("inf")] * 8)], "request_id long, x array<double>")
    rows = df.select("request_id", "x").union(odd).withColumn("features", array_to_vector("x"))
    model = mapper.MultiOutputRegressor("forest", some, trees=5, depth=4).fit(df)
    got = lambda m: {r.request_id: r.estimate for r in m.transform(rows).collect()}
    want = got(model)
    model.save(str(tmp_path / "m"))

    def unread(path):
        raise AssertionError("a forest's trees come from its node tables")
    monkeypatch.setattr(mapper.RandomForestRegressionModel, "load", unread)
    again = mapper.MultiOutputModel.load(spark, str(tmp_path / "m"))
    assert got(again) == want == got(model) and len(want) == 83
    per = {t: np.array([[tree.predict(r.features) for tree in m.trees] for r in rows.orderBy("request_id").collect()]) * s + mean
           for t, m, mean, s in zip(some, model.models, model.means, model.stds)}
    order = sorted(want)
    for r in again.tree_spread(rows, "request_id", str(tmp_path / "m")).collect():
        x = per[r.target][order.index(r.request_id)]
        assert abs(r.estimate - x.mean()) < 1e-9 and abs(r["std"] - x.std()) < 1e-9
    assert again.tree_spread(rows, "request_id", str(tmp_path / "m"))._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_large_written_tables_are_not_shuffled_for_a_fit(spark, tmp_path, monkeypatch):
    spark.range(0, 400, 1, 6).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda **o: models.packed(df, 400, **o)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 1, true" in plan(scanned=True)                 # a small one is dealt evenly
    monkeypatch.setattr(models, "MOST_ROWS", 100)
    assert "Repartition 4, false" in plan(scanned=True) and "Repartition 4, true" in plan()
    assert models.packed(df, 400, scanned=True).count() == 400


def test_forests_cache_node_numbers_up_to_a_bound(spark, monkeypatch):
    df = labelled(spark)
    kept = models.train(df, ["a", "b"], "random_forest", trees=3, depth=4)
    monkeypatch.setattr(models, "NODE_NUMBERS", 100)
    walked = models.train(df, ["a", "b"], "random_forest", trees=3, depth=4)
    assert kept.stages[-1].getCacheNodeIds() and not walked.stages[-1].getCacheNodeIds()
    assert kept.stages[-1].toDebugString.split("\n")[1:] == walked.stages[-1].toDebugString.split("\n")[1:]


def test_train_all_fits_members_side_by_side(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0), (i * 37 % 100) / 100) for i in range(50)], "event_id long, Class int, x double")
    gate = threading.Barrier(2, timeout=60)           # two at once, or both fail here

    def member(_):
        gate.wait()
        return lambda rows: rows.withColumn("p", F.col("x"))
    got = ensemble.train_all(df, df, {"a": member, "b": member}, "Class", "event_id").collect()
    assert sorted(r.model for r in got) == ["a", "b", "ensemble"] and all(r.error is None for r in got)


def test_a_model_that_was_just_fitted_is_not_read_back(spark, tmp_path, monkeypatch):
    df, read = labelled(spark, 60), []
    fit = lambda: Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), LogisticRegression(labelCol="Class")]).fit(df)
    load = persist.load_model
    monkeypatch.setattr(persist, "load_model", lambda *a: read.append(1) or load(*a))
    for times in (0, 1):
        persist.stored(spark, str(tmp_path), "fresh", "logistic_regression", ["a", "b"], fit)
        assert len(read) == times


def test_train_all_skips_failures(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0), (i * 37 % 100) / 100) for i in range(200)], "event_id long, Class int, x double")

    def broken(_):
        raise RuntimeError("no such model")
    members = {"same": lambda _: lambda rows: rows.withColumn("p", F.col("x")), "broken": broken,
               "oracle": lambda _: lambda rows: rows.withColumn("p", F.col("Class").cast("double"))}
    got = {r.model: r for r in ensemble.train_all(df, df, members, "Class", "event_id").collect()}
    assert set(got) == {"same", "broken", "oracle", "ensemble"}
    assert got["broken"].error.startswith("RuntimeError") and got["broken"].average_precision is None
    # the mean of a perfect and any other score is perfect here as well: of equals the first name is best
    assert round(got["oracle"].average_precision, 9) == round(got["ensemble"].average_precision, 9) == 1.0 and got["same"].n == 200
    assert [m for m, r in got.items() if r.is_best] == ["ensemble"]
    alone = ensemble.train_all(df, df, {"same": members["same"]}, "Class", "event_id").collect()
    assert [r.model for r in alone] == ["same"] and alone[0].is_best
    assert [r.model for r in ensemble.train_all(df, df, {"broken": broken}, "Class", "event_id").collect()] == ["broken"]

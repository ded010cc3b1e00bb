"""Catalog: Spark ML training, tuning, scoring, explanation and clustering
(T01-T03, T05, T06, T08-T10, T14-T19, S10, X02, X03, X08, E09, E16)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from riskframe.functions.dims import FEATURES, V_NAMES
from riskframe.operators import align, bounds, ensemble, mapper, persist, serving, shapley, surrogate, trees
from riskframe.operators import confidence as C
from riskframe.operators import features as fe
from riskframe.operators import metrics as M
from riskframe.operators import models as ML
from riskframe.operators import sampling
from riskframe.operators.neighbours import spread, written
from riskframe.plans import q_confidence
from riskframe.plans.catalog import query
from riskframe.sources import views


def _split(spark, sf):
    t = views.txn(spark, sf).select("event_id", *FEATURES, "Class")
    s = written(sampling.stratified_split(t, "Class", "event_id", 0.2, 42), "split")
    return s.filter("split = 'train'"), s.filter("split = 'test'")


#: (kind, options) of the stored models; the options are the library's defaults, in full.
MODELS = {"logistic_regression": {"max_iter": 1000}, "random_forest": {"trees": 200, "depth": 15}, "boosted": {"trees": 200, "depth": 6}}


def _model(spark, sf, kind, train=None):
    """The saved model of this kind; fitted on the train split on first use."""
    def fit():
        return ML.train(train if train is not None else _split(spark, sf)[0], FEATURES, kind, **MODELS[kind])
    return persist.stored(spark, sf, kind, kind, FEATURES, fit, **MODELS[kind])


def _train_eval(spark, sf, kind):
    train, test = _split(spark, sf)
    sc = written(ML.score(_model(spark, sf, kind, train), spread(test)).withColumn("model", F.lit(kind)), "scores")     # read several times
    return M.evaluation_record(sc, groups=["model"])


@query("train_logistic")
def train_logistic(spark, sf):
    """Weighted logistic regression; test-split evaluation record."""
    return _train_eval(spark, sf, "logistic_regression")


@query("train_forest")
def train_forest(spark, sf):
    """Weighted random forest, 200 trees of depth 15."""
    return _train_eval(spark, sf, "random_forest")


@query("train_boosted")
def train_boosted(spark, sf):
    """Gradient-boosted trees, 200 of depth 6."""
    return _train_eval(spark, sf, "boosted")


@query("score_transactions")
def score_transactions(spark, sf):
    """Aligned features (P01), the saved model's scores of every transaction, R01 risk fields."""
    model = _model(spark, sf, "logistic_regression")
    s = ML.score(model, align.align_features(views.txn(spark, sf), FEATURES, keep=["event_id", "Class"]))
    return s.withColumn("risk_score", F.col("p") * 100).withColumn("risk_level", F.when(F.col("p") > 0.5, "HIGH").otherwise("LOW"))


@query("model_persist")
def model_persist(spark, sf):
    """Per saved model its metadata and how far the scores of two separate loads differ at most (0)."""
    kind = "logistic_regression"
    _model(spark, sf, kind)
    path = persist.model_path(spark, sf, kind)
    t = written(views.txn(spark, sf).select("event_id", *FEATURES), "txn")
    a, b = (ML.score(persist.load_model(spark, path), t).select("event_id", F.col("p").alias(n)) for n in ("a", "b"))
    diff = a.join(b, "event_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_difference"))
    m = persist.metadata(spark, path)
    return m.select("name", "model_type", F.size("features").alias("n_features"), F.array_join("stages", ",").alias("stages"), "details",
                    diff.select("n_rows").scalar().alias("n_rows"), diff.select("max_difference").scalar().alias("max_difference"))


def _member(kind, **options):
    def train(df):
        model = ML.train(df, FEATURES, kind, scanned=True, **options)
        return lambda rows: ML.score(model, rows)
    return train


@query("stack")
def stack(spark, sf):
    """Logistic, forest and boosted members, out-of-fold over three folds, logistic on top; test-split evaluation record.
    Members are smaller than the stored models because each is fitted four times."""
    train, test = _split(spark, sf)
    members = {"logistic": _member("logistic_regression"), "forest": _member("random_forest", trees=50, depth=8), "boosted": _member("boosted", trees=20, depth=4)}
    scored = ensemble.stack(train.drop("split"), members, "Class", "event_id")(test)
    sc = scored.join(test.select("event_id", F.col("Class").alias("y")), "event_id").withColumn("model", F.lit("stack"))
    return M.evaluation_record(sc, groups=["model"])


@query("tune_grid")
def tune_grid(spark, sf):
    """Logistic regression over C and iterations, three stratified folds, average precision."""
    train, _ = _split(spark, sf)
    x = written(sampling.attach_class_weights(train, "Class").withColumn("label", F.col("Class").cast("double")), "tune")
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", standardization=False)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), lr])
    n = x.count()
    grid = ParamGridBuilder().addGrid(lr.regParam, [1.0 / (c * n) for c in (0.1, 1.0, 10.0, 100.0)]).addGrid(lr.maxIter, [1000, 2000]).build()
    out = ensemble.tune_grid(x, pipe, grid, "Class", "event_id")
    return out.select("candidate", F.col("params")["regParam"].alias("reg_param"), F.col("params")["maxIter"].alias("max_iter"), "mean_score", "std_score", "is_best")


def _mapping_split(spark, sf):
    rows = mapper.request_features(views.mapping_rows(spark, sf)).select("request_id", "features", *V_NAMES)
    return written(sampling.three_way_split(rows, "request_id", 0.2, 0.1), "mapping")


#: (kind, options) of the stored mappers; each option set is fitted 28 times, once a component.
MAPPERS = {"mapper_forest": ("forest", {}), "mapper_boosted": ("boosted", {"trees": 20, "depth": 4, "step": 0.3})}


def _mapper(spark, sf, rows=None, name="mapper_forest"):
    """The saved mapper of this name, fitted on the train split on first use."""
    path = persist.model_path(spark, sf, name)
    if not persist.exists(spark, path):
        rows = rows if rows is not None else _mapping_split(spark, sf).where("split = 'train'")
        kind, options = MAPPERS[name]
        model = mapper.MultiOutputRegressor(kind, V_NAMES, **options).fit(rows)
        model.save(path)
        return model
    return mapper.MultiOutputModel.load(spark, path)


@query("mapper_forest")
def mapper_forest(spark, sf):
    """28 forests from the request fields to the components; errors on the test split."""
    return _mapper_errors(spark, sf, "mapper_forest")


def _mapper_errors(spark, sf, name):
    rows = _mapping_split(spark, sf)
    return mapper.errors(_mapper(spark, sf, rows.where("split = 'train'"), name).transform(spread(rows.where("split = 'test'"))), V_NAMES)


@query("mapper_boosted")
def mapper_boosted(spark, sf):
    """28 boosted regressors (20 trees of depth 4, step 0.3); errors on the test split."""
    return _mapper_errors(spark, sf, "mapper_boosted")


@query("mapping_train_run")
def mapping_train_run(spark, sf):
    """70/10/20 split, both mappers, their ensemble weighted on the validation rows, and the run record."""
    rows = _mapping_split(spark, sf)
    parts = [rows.where(F.col("split") == p).drop("split") for p in ("train", "validation", "test")]
    stored = lambda name: lambda train: _mapper(spark, sf, train, name)
    return mapper.train_run(*parts, {"forest": stored("mapper_forest"), "boosted": stored("mapper_boosted")}, "request_id")


#: Stand-in member estimates of component i: shares of V_i and of the next component, and a confidence per row.
_MEMBERS = {"forest": 0.9, "boosted": 0.7, "neural": -0.5}


def _conf_sql(j):
    return f"((event_id * {[7, 11, 13][j]}) % 100) / 100.0::DOUBLE"


def _est(i, share):
    return f"({share!r}::DOUBLE * V{i} + {round(1 - share, 1)!r}::DOUBLE * V{i % 28 + 1})"


_PER_SQL = "per AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS member, 'V{i}' AS target, avg((V{i} - {_est(i, s)}) * (V{i} - {_est(i, s)})) AS mse, corr(V{i}, {_est(i, s)}) AS corr FROM txn"
    for m, s in _MEMBERS.items() for i in range(1, 29)) + ")"
_WEIGHT_SQL = f"""{_PER_SQL}, sc AS (SELECT member, coalesce(avg(corr), 0.0) - 0.1 * avg(mse) AS score FROM per GROUP BY member),
mv AS (SELECT member, score, CASE WHEN min(score) OVER () < 0 THEN score - min(score) OVER () + 0.1 ELSE score END AS s FROM sc),
wt AS (SELECT member, score, s / sum(s) OVER () AS weight FROM mv)"""


def _member_frame(spark, sf):
    """event_id, V1..V28 and, per member, the array of its 28 estimates."""
    t = views.txn(spark, sf)
    est = lambda i, s: F.lit(s) * F.col(f"V{i}") + F.lit(round(1 - s, 1)) * F.col(f"V{i % 28 + 1}")
    return written(t.select("event_id", *V_NAMES, *[F.array(*[est(i, s) for i in range(1, 29)]).alias(m) for m, s in _MEMBERS.items()]), "members")


def _member_weights(rows):
    per = None
    for m in _MEMBERS:
        e = mapper.errors(rows, V_NAMES, m).withColumn("member", F.lit(m))
        per = e if per is None else per.union(e)
    return mapper.ensemble_weights(mapper.member_scores(per))


@query("ensemble_weights", f"WITH {_WEIGHT_SQL} SELECT member, round(score, 6) AS score, round(weight, 6) AS weight FROM wt")
def ensemble_weights(spark, sf):
    """Weights of three members from their errors on all components."""
    return _member_weights(_member_frame(spark, sf)).select("member", F.round("score", 6).alias("score"), F.round("weight", 6).alias("weight"))


def _combine_sql():
    w = {m: f"(SELECT weight FROM wt WHERE member = '{m}')" for m in _MEMBERS}
    conf = {m: _conf_sql(j) for j, m in enumerate(_MEMBERS)}
    top = f"greatest({', '.join(conf.values())})"

    def row(i):
        est = {m: _est(i, s) for m, s in _MEMBERS.items()}
        plain = f"({' + '.join(f'{w[m]} * {est[m]}' for m in est)}) / ({' + '.join(w[m] for m in est)})"
        sure = f"({' + '.join(f'{w[m]} * {conf[m]} * {est[m]}' for m in est)}) / nullif({' + '.join(f'{w[m]} * {conf[m]}' for m in est)}, 0)"
        best = " ".join(f"WHEN {conf[m]} = {top} THEN {est[m]}" for m in est)
        return f"""SELECT event_id, 'V{i}' AS component, round({plain}, 6) AS weighted_average, round({sure}, 6) AS confidence_weighted,
          round(CASE WHEN {top} >= 0.7 THEN CASE {best} END ELSE {plain} END, 6) AS best_model FROM txn"""
    return f"WITH {_WEIGHT_SQL} " + " UNION ALL ".join(row(i) for i in range(1, 29))


@query("ensemble_combine", _combine_sql())
def ensemble_combine(spark, sf):
    """The three ways to combine three members' estimates of every component."""
    rows = _member_frame(spark, sf)
    weights = written(_member_weights(rows), "weights")
    conf = [(F.col("event_id") * k) % 100 / F.lit(100.0) for k in (7, 11, 13)]
    long = rows.select("event_id", *[c.alias(f"_c{j}") for j, c in enumerate(conf)], F.posexplode(F.arrays_zip(*_MEMBERS)).alias("i", "e"))
    long = long.select("event_id", F.concat(F.lit("V"), (F.col("i") + 1).cast("string")).alias("component"),
                       *[F.struct(F.col("e")[m].alias("value"), F.col(f"_c{j}").alias("confidence")).alias(m) for j, m in enumerate(_MEMBERS)])
    return long.select("event_id", "component", *[F.round(mapper.combine(list(_MEMBERS), weights, how), 6).alias(how)
                                                  for how in ("weighted_average", "confidence_weighted", "best_model")])


@query("mapper_importance")
def mapper_importance(spark, sf):
    """Importance of the request fields, per component and in the mean."""
    return _mapper(spark, sf).importance()


@query("forest_uncertainty")
def forest_uncertainty(spark, sf):
    """Mean and spread of the mapper's trees for every request and component."""
    rows = mapper.request_features(spread(views.requests(spark, sf)))
    return _mapper(spark, sf).tree_spread(rows, "request_id", persist.model_path(spark, sf, "mapper_forest"))


@query("tree_structure")
def tree_structure(spark, sf):
    """Splits, mean gain and mean cover of every feature in the saved boosted model."""
    _model(spark, sf, "boosted")
    return trees.feature_structure(_boosted_nodes(spark, sf), FEATURES)


@query("tree_complexity")
def tree_complexity(spark, sf):
    """Nodes, leaves and depth of every tree of the saved boosted model."""
    _model(spark, sf, "boosted")
    return trees.tree_complexity(_boosted_nodes(spark, sf))


def _boosted_nodes(spark, sf):
    model = _model(spark, sf, "boosted")
    return trees.node_table(spark, f"{persist.model_path(spark, sf, 'boosted')}/model/stages/{len(model.stages) - 1}_{model.stages[-1].uid}")


@query("shapley_sampling")
def shapley_sampling(spark, sf):
    """Every transaction explained for the saved logistic model: 4 orders, 50 background rows."""
    model = _model(spark, sf, "logistic_regression")
    t = written(spread(views.txn(spark, sf).select("event_id", *FEATURES)), "txn")
    by = PipelineModel(model.stages[1:])
    score = lambda df: by.transform(df).withColumn("p", vector_to_array("probability")[1])
    values = shapley.shapley(t, FEATURES, score, shapley.background_rows(t, FEATURES, "event_id"))
    return shapley.long_form(values, FEATURES)


@query("cluster_transactions")
def cluster_transactions(spark, sf):
    """E09 + E10 + E16: k-means clusters, their merchant labels, and the assignment."""
    t = views.txn(spark, sf)
    model = ML.cluster_transactions(t)
    assigned = model.transform(t).select("event_id", "Amount", "Class", "cluster")
    labels = fe.label_clusters(assigned)
    return ML.cluster_assign(model, t, labels).select("event_id", "cluster", "merchant_category")


@query("cluster_assign")
def cluster_assign(spark, sf):
    """Every transaction assigned by the stored cluster model and its stored category labels."""
    cols = ["Amount", "Time", "V1", "V2", "V3", "V4", "V5"]
    t = views.txn(spark, sf)
    model = persist.stored(spark, sf, "clusters", "kmeans", cols, lambda: ML.cluster_transactions(t))
    labels = written(fe.label_clusters(model.transform(t).select("Amount", "Class", "cluster")), "cluster-labels")
    return ML.cluster_assign(model, t, labels).select("event_id", "cluster", "merchant_category")


@query("score_requests")
def score_requests(spark, sf):
    """Every request end to end; a rejected one has its errors and no score."""
    history = C.historical_confidence(q_confidence.history(spark, sf))
    results, errors = serving.score_requests(spread(views.requests(spark, sf)), {"forest": _mapper(spark, sf)}, bounds.feature_bounds(views.txn(spark, sf)),
                                             {"logistic_regression": _model(spark, sf, "logistic_regression")}, history)
    return results.unionByName(errors, allowMissingColumns=True)


@query("explanation_batch")
def explanation_batch(spark, sf):
    """Every transaction with prediction, probability, risk score and attributions (X04 with the saved model's absolute coefficients)."""
    model = _model(spark, sf, "logistic_regression")
    weights = dict(zip(FEATURES, (abs(float(v)) for v in model.stages[-1].coefficients.toArray())))
    t = align.align_features(views.txn(spark, sf), FEATURES, keep=["event_id"])
    out = model.transform(t).withColumn("p", vector_to_array("probability")[1])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(weights[c]) * vector_to_array("features")[i]).alias("contribution")) for i, c in enumerate(FEATURES)])
    return out.select("event_id", F.lit("logistic_regression").alias("model"), F.col("prediction").cast("int").alias("prediction"), F.col("p").alias("probability"),
                      (F.col("p") * 100).alias("risk_score"), F.lit(0.5).alias("base"), parts.alias("attributions"))


@query("train_all")
def train_all(spark, sf):
    """The stored logistic, forest and boosted models (T01-T03) and their mean score, on the test split."""
    train, test = _split(spark, sf)
    stored = lambda kind: lambda df: lambda rows: ML.score(_model(spark, sf, kind, df), rows)
    return ensemble.train_all(train.drop("split"), test.drop("split"), {kind: stored(kind) for kind in MODELS}, "Class", "event_id")


@query("local_surrogate")
def local_surrogate(spark, sf):
    """Linear surrogate of the saved logistic model around every transaction."""
    by = PipelineModel(_model(spark, sf, "logistic_regression").stages[1:])
    t = written(spread(views.txn(spark, sf).select("event_id", *FEATURES)), "txn")
    return surrogate.local_surrogate(t, FEATURES, lambda df: by.transform(df).withColumn("p", vector_to_array("probability")[1]))

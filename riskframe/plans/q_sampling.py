"""Catalog: splits, samples and class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.columns import rnd
from riskframe.operators import sampling
from riskframe.plans.catalog import query
from riskframe.sources import views

_MD5 = "md5('42_' || event_id::VARCHAR)"


def _base(spark, sf):
    return views.txn(spark, sf).select("event_id", "Class")


@query("stratified_split", f"""
SELECT event_id, Class, CASE WHEN row_number() OVER (PARTITION BY Class ORDER BY {_MD5}, event_id)
  <= round(0.2 * count(*) OVER (PARTITION BY Class)) THEN 'test' ELSE 'train' END AS split FROM txn""")
def stratified_split(spark, sf):
    return sampling.stratified_split(_base(spark, sf), "Class", "event_id", 0.2, 42)


@query("three_way_split", f"""
WITH r AS (SELECT event_id, Class, row_number() OVER (ORDER BY {_MD5}, event_id) AS rn,
                  round(0.2 * count(*) OVER ()) AS nt, count(*) OVER () AS n FROM txn)
SELECT event_id, Class, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + round({0.1 / 0.8!r} * (n - nt)) THEN 'validation'
  ELSE 'train' END AS split FROM r""")
def three_way_split(spark, sf):
    return sampling.three_way_split(_base(spark, sf), "event_id", 0.2, 0.1, 42)


@query("prefix_split", """
SELECT event_id, Class, CASE WHEN row_number() OVER (ORDER BY event_id) <= floor(0.8 * count(*) OVER ())
  THEN 'train' ELSE 'validation' END AS split FROM txn""")
def prefix_split(spark, sf):
    return sampling.prefix_split(_base(spark, sf), "event_id", 0.8)


@query("stratified_kfold", "SELECT event_id, fold, Class FROM folds")
def stratified_kfold(spark, sf):
    return views.folds(spark, sf).select("event_id", "fold", "Class")


@query("sample_n", f"SELECT event_id, Class FROM txn ORDER BY {_MD5}, event_id LIMIT 1000")
def sample_n(spark, sf):
    return sampling.sample_n(_base(spark, sf), "event_id", 1000, 42)


@query("class_weights", """
SELECT Class, count(*) AS n_class, round((SELECT count(*) FROM txn) / (count(*) OVER () * count(*)), 9) AS weight
FROM txn GROUP BY Class""")
def class_weights(spark, sf):
    w = sampling.class_weights(_base(spark, sf), "Class")
    return w.select("Class", "n_class", rnd("weight", 9).alias("weight"))


@query("attach_class_weights", """
WITH w AS (SELECT Class, (SELECT count(*) FROM txn) / (count(*) OVER () * count(*)) AS weight FROM txn GROUP BY Class)
SELECT t.event_id, t.Class, round(w.weight, 9) AS weight FROM txn t JOIN w ON t.Class = w.Class""")
def attach_class_weights(spark, sf):
    x = sampling.attach_class_weights(_base(spark, sf), "Class")
    return x.select("event_id", "Class", rnd("weight", 9).alias("weight"))


@query("pos_weight", """
SELECT count(*) AS n, sum(Class)::BIGINT AS n_pos, (count(*) - sum(Class))::BIGINT AS n_neg,
  round((1 - sum(Class) / count(*)) / (sum(Class) / count(*)), 9) AS pos_weight_rate,
  round((count(*) - sum(Class)) / sum(Class), 9) AS pos_weight_ratio FROM txn""")
def pos_weight(spark, sf):
    x = sampling.pos_weight(_base(spark, sf), "Class")
    return x.select("n", "n_pos", "n_neg", rnd("pos_weight_rate", 9).alias("pos_weight_rate"),
                    rnd("pos_weight_ratio", 9).alias("pos_weight_ratio"))


@query("undersample", f"""
WITH r AS (SELECT event_id, Class, row_number() OVER (PARTITION BY Class ORDER BY {_MD5}, event_id) AS rn FROM txn)
SELECT event_id, Class FROM r WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM txn GROUP BY Class))""")
def undersample(spark, sf):
    return sampling.undersample(_base(spark, sf), "Class", "event_id", 42)

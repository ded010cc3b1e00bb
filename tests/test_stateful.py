"""Keyed state over several batches, late rows, and restarts from a checkpoint."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from riskframe.operators import drift
from riskframe.streaming import stateful as SF
from riskframe.streaming import streams as S

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, k string, ts timestamp_ntz, v double"


class Feed:
    """A folder of files that a stream takes one by one, in the order in which they were written."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0
        os.makedirs(self.path)

    def add(self, rows):
        part = f"{self.path}-{self.n}.tmp"
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(part)
        file = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        target = f"{self.path}/{self.n:04d}.parquet"
        os.replace(f"{part}/{file}", target)
        os.utime(target, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_repeats_count_once_within_an_hour_over_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    feed.add([(1, "a", at(0), 0.0), (2, "a", at(10), 0.0), (3, "b", at(5), 0.0), (4, "b", at(5), 0.0)])
    feed.add([(5, "a", at(3599), 0.0), (6, "c", at(3000), 0.0)])
    feed.add([(7, "a", at(3600), 0.0), (8, "a", at(3700), 0.0), (9, "a", at(7300), 0.0)])
    feed.add([(10, "z", at(50_000), 0.0)])
    feed.add([(11, "c", at(50_100), 0.0), (12, "c", at(4000), 0.0)])            # 12 is far behind the watermark
    out = S.run_to_table(SF.stream_dedup(feed.stream(), ["k"], "id"))
    assert sorted((r.k, r.id) for r in out.collect()) == [("a", 1), ("a", 7), ("a", 9), ("b", 3), ("c", 6), ("c", 11), ("z", 10)]


def test_first_within_is_the_greedy_choice():
    rng = random.Random(6)
    for _ in range(50):
        times = sorted(rng.randrange(0, 400) for _ in range(rng.randrange(0, 40)))
        last = rng.choice([None, 30])
        want, held = [], last
        for i, t in enumerate(times):
            if held is None or t - held >= 60:
                want.append(i)
                held = t
        assert SF.first_within(np.array(times, dtype=np.int64), last, 60) == want


def test_many_keys_of_a_bucket_are_counted_as_one_by_one():
    rng = random.Random(8)
    for _ in range(50):
        n, ttl = rng.randrange(1, 60), 60
        codes = np.array([rng.randrange(6) for _ in range(n)])
        us = np.array([rng.randrange(400) for _ in range(n)], dtype=np.int64)
        held = np.zeros(n, dtype=bool)
        for c in range(3):                                                      # some keys have a time already
            held[np.flatnonzero(codes == c)[:1]] = True
        order, counted = SF.counted_rows(codes, us, np.arange(n), held, ttl)
        want = set()
        for c in range(6):
            last = next((us[i] for i in range(n) if codes[i] == c and held[i]), None)
            mine = sorted((us[i], i) for i in range(n) if codes[i] == c and not held[i])
            want |= {mine[j][1] for j in SF.first_within(np.array([t for t, _ in mine], dtype=np.int64), last, ttl)}
        assert set(order[counted].tolist()) == want


def test_state_is_dealt_over_a_bounded_number_of_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SF, "BUCKETS", 2, raising=False)
    feed = Feed(spark, tmp_path / "in")
    keys = [f"k{i}" for i in range(20)] + [None]
    feed.add([(i, k, at(i), 0.0) for i, k in enumerate(keys)] + [(500, "k1", None, 0.0)])
    feed.add([(100 + i, k, at(1800 + i), 0.0) for i, k in enumerate(keys)])
    feed.add([(200 + i, k, at(3600 + 2 * i), 0.0) for i, k in enumerate(keys)])
    stream = feed.stream().select("id", "ts", F.struct("k").alias("s"), "k", F.length("k").cast("long").alias("size"), F.col("k").cast("binary").alias("b"))
    out = SF.stream_dedup(stream, ["k", "size", "b"], "id")
    assert "[bucket" in out._jdf.queryExecution().analyzed().toString()         # one call a bucket, not one a key
    assert dict(out.dtypes) == {"k": "string", "size": "bigint", "b": "binary", "id": "bigint", "event_time": "timestamp"}
    got = sorted((r.id, r.k, r["size"], bytes(r.b) if r.b is not None else None) for r in S.run_to_table(out).collect())
    assert got == [(n + i, k, k and len(k), k and k.encode()) for n in (0, 200) for i, k in enumerate(keys)]


def test_recent_rows_go_on_from_the_checkpoint(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice(["m1", "m1", "m1", "m2"]), at(rng.randrange(5000)), float(i % 13)) for i in range(400)] + [(900, "m3", at(1), 2.0)]
    feed, root = Feed(spark, tmp_path / "in"), str(tmp_path / "run")
    for part in (rows[:90], rows[90:200]):
        feed.add(part)
    run = lambda: SF.recent_rows(SF.stream_recent(feed.stream(), "k", "id", "v", 25), "k", 25, root)
    assert run().count() == 50
    for part in (rows[200:310], rows[310:]):
        feed.add(part)
    got = run()
    ids = {k: [r.id for r in got.where(F.col("k") == k).orderBy(F.desc("us"), "id").collect()] for k in ("m1", "m2", "m3")}
    for k, mine in ids.items():
        assert mine == [r[0] for r in sorted((r for r in rows if r[1] == k), key=lambda r: (-r[2].timestamp(), r[0]))[:25]]
    p50 = {r.k: r.p50 for r in SF.latency_summary(got, "k").collect()}
    value = dict((r[0], r[3]) for r in rows)
    assert all(abs(p50[k] - float(np.median([value[i] for i in ids[k]]))) < 1e-9 for k in ids)


def test_windows_equal_the_batch_score_and_late_rows_are_dropped(spark, tmp_path):
    base = spark.createDataFrame([(float(i), float(i % 3)) for i in range(20)], "a double, b double")
    feed = Feed(spark, tmp_path / "in")
    feed.add([(i, "x", at(600 * i), 9.5 + i) for i in range(6)])                # the first hour
    feed.add([(i, "x", at(3600 + 600 * i), 9.5) for i in range(6)])             # the second
    feed.add([(50, "x", at(30_000), 9.5)])
    feed.add([(51, "x", at(100), 1e9)])                                         # its window has closed
    rows = feed.stream().select("ts", F.col("v").alias("a"), (F.col("v") - 9).alias("b"))
    out = S.run_to_table(SF.stream_drift(rows, SF.baseline_row(base, ["a", "b"]), ["a", "b"], 0.1)).orderBy("window_start").collect()
    assert [r.n for r in out] == [6, 6]
    for r, shift in zip(out, (range(6), [0] * 6)):
        now = spark.createDataFrame([(9.5 + s, 0.5 + s) for s in shift], "a double, b double")
        want = drift.drift_zscore(now, base, ["a", "b"]).first().drift_score
        assert abs(r.drift_score - want) < 1e-12 and r.alert == (want > 0.1)


def test_two_sinks_get_every_row_once(spark, tmp_path):
    feed, root = Feed(spark, tmp_path / "in"), str(tmp_path / "run")
    feed.add([(1, "a", at(0), 1.0), (2, "a", at(1), -1.0)])
    feed.add([(3, "a", at(2), -2.0)])
    rows = lambda: feed.stream().select("id", (F.col("v") < 0).alias("quarantined"))
    SF.to_sinks(rows(), root=root)
    feed.add([(4, "a", at(3), 5.0)])
    good, bad = SF.to_sinks(rows(), root=root)
    assert sorted(r.id for r in good.collect()) == [1, 4] and sorted(r.id for r in bad.collect()) == [2, 3]

"""Streams with keyed state: repeats within a time to live (ST03), the latest rows of a key
(ST07), windows against a baseline (ST05), saved models on streams (ST02), two sinks (ST01).

All of them go on from their checkpoint: a batch that runs again writes its own folder again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskframe.session import checkpoint_dir

#: Parts of a key's state, so that a key that holds most rows is spread over tasks.
SALTS = 16

#: States that the keys of ``stream_dedup`` are dealt over; part of the checkpoint's meaning, so it stays.
BUCKETS = 4096


def _root(df: DataFrame, root: str | None) -> str:
    return root or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/streams/{uuid.uuid4().hex}"


def _drain(df: DataFrame, root: str, each, mode: str) -> None:
    """Feed all that has arrived to ``each`` (batch, batch id) and stop."""
    df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def first_within(times: np.ndarray, last: int | None, ttl: int) -> list[int]:
    """Places in sorted ``times`` that count: each at least ``ttl`` after the one counted before it."""
    out, at = [], 0 if last is None else int(np.searchsorted(times, last + ttl))
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + ttl))
    return out


def counted_rows(codes: np.ndarray, us: np.ndarray, ids: np.ndarray, held: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, counted): the order by key, time and id, a key's held time first, and which of the rows in it count.

    A row at least ``ttl`` after the row before it counts whatever came earlier; only keys that have another row are walked.
    """
    order = np.lexsort((ids, us, ~held, codes))
    codes, us, held = codes[order], us[order], held[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    sizes = np.diff(np.r_[starts, len(codes)])
    # a row before its key's held time is as good as at that time
    at = np.where(np.repeat(held[starts], sizes), np.maximum(us, np.repeat(us[starts], sizes)), us)
    counted = np.r_[True, at[1:] - at[:-1] >= ttl]
    counted[starts] = True
    for i in np.flatnonzero(~np.logical_and.reduceat(counted, starts)):
        a, b = starts[i], starts[i] + sizes[i]
        counted[a:b] = False
        if held[a]:
            counted[a + 1 + np.array(first_within(at[a + 1:b], int(at[a]), ttl), dtype=np.int64)] = True
        else:
            counted[a + np.array(first_within(at[a:b], None, ttl), dtype=np.int64)] = True
    return order, counted & ~held


def stream_dedup(rows: DataFrame, keys: list[str], id_col: str, time_col: str = "ts", ttl_seconds: int = 3600, watermark: str = "1 hour") -> DataFrame:
    """ST03: (keys, id_col, time): the rows that count; a row equal in ``keys`` to one counted less than the time to live before does not.

    Keys are dealt over ``BUCKETS`` states, so that a call works on many keys at once; a state holds one time per key,
    which goes once the watermark is past its time to live.  Keys travel as text and come back in their own types.
    Rows without a time or later than the watermark are dropped; a row that comes after a later one of its
    key has counted is a repeat.  Rows of one time count by the smallest id.
    """
    ttl = ttl_seconds * 1_000_000
    kinds = {k: rows.schema[k].dataType for k in keys}
    text = lambda k: F.base64(k) if kinds[k].simpleString() == "binary" else F.col(k).cast("string")
    back = lambda k: F.unbase64(k) if kinds[k].simpleString() == "binary" else F.col(k).cast(kinds[k])
    r = rows.where(F.col(time_col).isNotNull()) \
        .select(*[text(k).alias(k) for k in keys], F.col(id_col).cast("long").alias(id_col), F.col(time_col).cast("timestamp").alias("event_time")) \
        .withWatermark("event_time", watermark) \
        .select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket"), *keys, id_col, "event_time", F.unix_micros("event_time").alias("us"))

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        kept = pd.DataFrame(dict(zip([*keys, "us"], state.get)) if state.exists else {c: [] for c in [*keys, "us"]})
        new = [] if state.hasTimedOut else [p[[*keys, "us", id_col]] for p in parts]
        if not state.hasTimedOut:
            x = pd.concat([kept.assign(**{id_col: -1}), *new], ignore_index=True) if len(kept) else pd.concat(new, ignore_index=True)
            codes = x.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            held = np.arange(len(x)) < len(kept)
            order, counted = counted_rows(codes, x["us"].to_numpy(dtype=np.int64), x[id_col].to_numpy(), held, ttl)
            x, held, codes = x.iloc[order], held[order], codes[order]
            if counted.any():
                yield x.loc[counted, [*keys, id_col, "us"]]
            # the latest counted time of every key, or the held one
            known = np.flatnonzero(counted | held)
            last = np.r_[codes[known][1:] != codes[known][:-1], True]
            kept = x.iloc[known[last]][[*keys, "us"]]
        kept = kept[kept["us"] + ttl > now]
        if kept.empty:
            state.remove()
            return
        state.update((*[[None if pd.isna(v) else v for v in kept[k]] for k in keys], [int(v) for v in kept["us"]]))
        state.setTimeoutTimestamp(max((int(kept["us"].min()) + ttl) // 1000, state.getCurrentWatermarkMs() + 1))
    names = ", ".join(f"`{k}` string" for k in keys)
    lists = ", ".join(f"`{k}` array<string>" for k in keys)
    out = r.groupBy("bucket").applyInPandasWithState(count, f"{names}, `{id_col}` long, us long", f"{lists}, us array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*[back(k).alias(k) for k in keys], id_col, F.timestamp_micros("us").alias("event_time"))


def stream_recent(rows: DataFrame, key: str, id_col: str, value: str, n: int, time_col: str = "ts") -> DataFrame:
    """ST07: per key and salt the ring buffer (us, ids, vals) of its latest ``n`` rows, emitted when it changes (update mode).

    The latest rows of a key are among the latest of its salts.
    """
    r = rows.select(F.col(key).cast("string").alias(key), F.col(id_col).cast("long").alias("id"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("us"),
                    F.col(value).cast("double").alias("val")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))

    def keep(key_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, ids, vals = (np.array(x) for x in state.get) if state.exists else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for p in parts:                                    # one chunk and one buffer at a time
            us, ids, vals = (np.concatenate((a, p[c].to_numpy())) for a, c in ((us, "us"), (ids, "id"), (vals, "val")))
            last = np.lexsort((ids, -us))[:n]
            us, ids, vals = us[last], ids[last], vals[last]
        state.update((us.tolist(), ids.tolist(), vals.tolist()))
        yield pd.DataFrame({key: [key_[0]], "salt": [key_[1]], "us": [us.tolist()], "ids": [ids.tolist()], "vals": [vals.tolist()]})
    schema = "us array<long>, ids array<long>, vals array<double>"
    return r.groupBy(key, "salt").applyInPandasWithState(keep, f"{key} string, salt int, {schema}", schema, "update", GroupStateTimeout.NoTimeout)


def recent_rows(stream: DataFrame, key: str, n: int, root: str | None = None) -> DataFrame:
    """Feed ``stream_recent`` all that has arrived; (key, id, us, val) of the latest ``n`` rows of every key so far.

    With the same ``root`` a later call goes on from where this one ended.
    """
    root = _root(stream, root)
    _drain(stream, root, lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/out/batch={i}"), "update")
    spark = stream.sparkSession
    out = spark.read.schema(f"{key} string, salt int, us array<long>, ids array<long>, vals array<double>, batch long").option("basePath", f"{root}/out").parquet(f"{root}/out")
    newest = out.groupBy(key, "salt").agg(F.max_by(F.struct("us", "ids", "vals"), "batch").alias("b"))
    rows = newest.select(key, F.explode(F.arrays_zip("b.us", "b.ids", "b.vals")).alias("x")).select(key, F.col("x.ids").alias("id"), F.col("x.us").alias("us"), F.col("x.vals").alias("val"))
    order = Window.partitionBy(key).orderBy(F.desc("us"), "id")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def latency_summary(recent: DataFrame, key: str) -> DataFrame:
    """A10's figures over the recent rows of each key."""
    return recent.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("val").alias("mean_ms"),
                                   *[F.percentile("val", q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)])


def baseline_row(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population std of every column."""
    return df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def stream_drift(rows: DataFrame, baseline: DataFrame, cols: list[str], threshold: float, time_col: str = "ts", window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """ST05: (window_start, n, drift_score, alert) of every closed window: D01 of the window's means against a static one-row baseline."""
    r = rows.withColumn("event_time", F.col(time_col).cast("timestamp")).withWatermark("event_time", watermark)
    w = r.groupBy(F.window("event_time", window).alias("w")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"now_{c}") for c in cols])
    j = w.withColumn("_k", F.lit(1)).join(F.broadcast(baseline.withColumn("_k", F.lit(1))), "_k")
    part = lambda c: F.when(F.col(f"std_{c}") > 0, F.least(F.abs(F.col(f"now_{c}") - F.col(f"mean_{c}")) / F.col(f"std_{c}") / 3, F.lit(1.0))).otherwise(0.0)
    score = sum([part(c) for c in cols[1:]], part(cols[0])) / F.lit(float(len(cols)))
    return j.select(F.col("w.start").alias("window_start"), "n", score.alias("drift_score"), (score > threshold).alias("alert"))


def to_sinks(rows: DataFrame, quarantined: str = "quarantined", root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """ST01: every batch goes to two sinks, one of accepted rows and one of quarantined ones; both as frames.

    A batch that is run again overwrites its own folders, so each row arrives once.
    """
    root = _root(rows, root)

    def split(batch: DataFrame, i: int) -> None:
        batch.persist()
        batch.where(~F.col(quarantined)).write.mode("overwrite").parquet(f"{root}/accepted/batch={i}")
        batch.where(F.col(quarantined)).write.mode("overwrite").parquet(f"{root}/quarantine/batch={i}")
        batch.unpersist()
    _drain(rows, root, split, "append")
    read = rows.sparkSession.read.schema(rows.schema)
    return tuple(read.option("basePath", f"{root}/{s}").parquet(f"{root}/{s}") for s in ("accepted", "quarantine"))

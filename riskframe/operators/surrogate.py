"""Local linear surrogates of any scoring function."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from riskframe.operators.shapley import dense, lists

SAMPLES = 128
#: Keeps the normal equations solvable where a feature does not vary; far below any weight.
RIDGE = 1e-9
#: Draws that are made at a time: their arrays fit a processor's cache.
_DRAWS = 1 << 16
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def _finished(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h


def hashed_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of a long, after columns that gave ``seed`` (42 for none)."""
    h = seed + (_P5 + np.uint64(8)) ^ _rotated(value.view(np.uint64) * _P2, 31) * _P1
    return _finished(_rotated(h, 27) * _P1 + _P4)


def hashed_int(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """As ``hashed_long``, of an int."""
    h = seed + (_P5 + np.uint64(4)) ^ value.astype(np.uint32).astype(np.uint64) * _P1
    return _finished(_rotated(h, 23) * _P2 + _P3)


def normals(ids: np.ndarray, known: np.ndarray, samples: int, n: int, seed: int) -> np.ndarray:
    """(rows x samples x n) standard normal draws that a row's id, the sample and the feature fix; sample 0 is all zero.

    Rows that are not ``known`` have no id and draw alike.
    """
    start = np.full(len(ids), 42, np.uint64)
    start = np.where(known, hashed_long(ids, start), start)
    h = hashed_int(np.arange(samples), start[:, None])
    h = hashed_int(np.arange(n), h[:, :, None])

    def uniform(k):
        last = hashed_int(np.array([2 * seed + k]), h) & np.uint64((1 << 53) - 1)
        return (last + np.uint64(1)).astype(np.float64) / float((1 << 53) + 1)
    z = np.sqrt(-2.0 * np.log(uniform(0))) * np.cos(2 * math.pi * uniform(1))
    z[:, 0] = 0.0
    return z


def fit_samples(z: np.ndarray, p: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, intercepts, R2) of weighted linear fits: ``z`` is rows x samples x features, ``p`` rows x samples.

    R2 is NaN where the scores do not vary.
    """
    w = np.exp(-0.5 * (z * z).sum(axis=2) / (width * width))
    a = np.concatenate([np.ones((*p.shape, 1)), z], axis=2)
    aw = a * w[:, :, None]
    turned = aw.transpose(0, 2, 1)
    beta = np.linalg.solve(turned @ a + RIDGE * np.eye(a.shape[2]), turned @ p[:, :, None])
    residual = p - (a @ beta)[:, :, 0]
    beta = beta[:, :, 0]
    spread = p - ((w * p).sum(axis=1) / w.sum(axis=1))[:, None]
    total = (w * spread * spread).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = np.where(total > 1e-18, 1 - (w * residual * residual).sum(axis=1) / total, np.nan)
    return beta[:, 1:], beta[:, 0], r2


def local_surrogate(rows: DataFrame, features: list[str], score: Callable[[DataFrame], DataFrame], id_col: str = "event_id", samples: int = SAMPLES,
                    seed: int = 42) -> DataFrame:
    """(id_col, prediction, coefficients array, intercept, r2): how the score moves around every row.

    ``samples`` points (the row itself first) lie around a row, each feature moved by a
    seeded normal draw times its standard deviation; closer points weigh more, with a
    width of 3/4 of the root of the number of features.  Coefficients are per standard
    deviation, in the order of ``features``.  ``score`` adds a column p to a frame with the
    vector ``raw``, row by row: a row's points then follow one another within a task, so
    they are fitted there and nothing is shuffled.  A null feature counts as 0.
    """
    n = len(features)
    if samples <= n + 1:
        raise ValueError("fewer samples than coefficients")
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    scale = rows.select(F.array(*[F.coalesce(F.stddev_pop(value(c)), F.lit(0.0)) for c in features])).scalar()
    x = rows.select(F.col(id_col).cast("long").alias(id_col), F.array(*[value(c) for c in features]).alias("x")).withColumn("sd", scale)

    def around(batches):
        """(id_col, z as bytes, raw): the points around each row, one after another."""
        step = max(1, _DRAWS // (samples * n))
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            at, sd = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, 1, n) for i in (1, 2))
            for s in range(0, batch.num_rows, step):
                some = slice(s, s + step)
                z = normals(ids[some], known[some], samples, n, seed)
                points = z.shape[0] * samples
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[some], samples), mask=~np.repeat(known[some], samples)),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * n), points, [None, pa.py_buffer(z.tobytes())]).cast(pa.binary()),
                     dense((at[some] + z * sd[some]).reshape(-1, n))], [id_col, "z", "raw"])
    drawn = x.mapInArrow(around, StructType([StructField(id_col, LongType()), StructField("z", BinaryType()), StructField("raw", VectorUDT())]))
    points = score(drawn).select(id_col, "z", F.col("p").cast("double").alias("p"))
    width = 0.75 * math.sqrt(n)

    def solve(batches):
        ids, z, p = pa.array([], pa.int64()), np.empty((0, n)), np.empty(0)
        for batch in batches:
            ids = pa.concat_arrays([ids, batch.column(0)])
            z = np.concatenate([z, _doubles(batch.column(1)).reshape(-1, n)])
            p = np.concatenate([p, batch.column(2).to_numpy(zero_copy_only=False)])
            whole = len(p) // samples
            if whole:
                end = whole * samples
                at = p[:end].reshape(whole, samples)
                coefficients, intercept, r2 = fit_samples(z[:end].reshape(whole, samples, n), at, width)
                yield pa.RecordBatch.from_arrays(
                    [ids[:end:samples], pa.array(at[:, 0]), lists(coefficients), pa.array(intercept), pa.array(r2)], [id_col, "prediction", "coefficients", "intercept", "r2"])
                ids, z, p = ids[end:], z[end:], p[end:]
    return points.mapInArrow(solve, f"{id_col} long, prediction double, coefficients array<double>, intercept double, r2 double")


def _doubles(column: pa.Array) -> np.ndarray:
    """The doubles of a column of bytes, which has no nulls, one value after another."""
    if not len(column):
        return np.empty(0)
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(np.float64)

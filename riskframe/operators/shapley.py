"""Model-agnostic Shapley values by sampled permutations."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

BACKGROUND = 50
#: Points that are made at a time.
_POINTS = 1 << 12


def lists(values: np.ndarray) -> pa.ListArray:
    """An Arrow column of arrays, one for each row of ``values``."""
    count, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, (count + 1) * width, width, dtype=np.int32), pa.array(values.reshape(-1)))


def dense(values: np.ndarray) -> pa.StructArray:
    """An Arrow column of dense vectors (``VectorUDT``), one for each row of ``values``."""
    count = len(values)
    return pa.StructArray.from_arrays([pa.array(np.ones(count, np.int8)), pa.nulls(count, pa.int32()), pa.nulls(count, pa.list_(pa.int32())), lists(values)],
                                      ["type", "size", "indices", "values"])


def background_rows(df: DataFrame, features: list[str], id_col: str, n: int = BACKGROUND, seed: int = 42) -> list[list[float]]:
    """At most ``n`` rows in md5 order of their ids: a bounded sample that stands for absent features."""
    rows = df.select(F.md5(F.concat(F.lit(f"{seed}_"), F.col(id_col).cast("string"))).alias("_k"), id_col, F.array(*[F.col(c).cast("double") for c in features]).alias("v"))
    return [list(r.v) for r in rows.orderBy("_k", id_col).limit(min(n, BACKGROUND)).collect()]


def orders(n_features: int, permutations: int, seed: int = 42) -> list[list[int]]:
    """Seeded orders of the features, every second one the reverse of the one before; all of them if there are no more."""
    if permutations >= math.factorial(min(n_features, 12)) and n_features <= 12:
        return [list(p) for p in itertools.permutations(range(n_features))]
    rng, out = random.Random(seed), []
    while len(out) < permutations:
        p = list(range(n_features))
        rng.shuffle(p)
        out += [p, p[::-1]]
    return out[:permutations]


def shapley(rows: DataFrame, features: list[str], score: Callable[[DataFrame], DataFrame], background: list[list[float]], id_col: str = "event_id",
            permutations: int = 4, every_background: bool = False, seed: int = 42) -> DataFrame:
    """(id_col, base, prediction, contributions array in the order of ``features``); base + sum = prediction.

    ``score`` adds a column p to a frame with the vector column ``raw``, row by row and
    without dealing rows anew.  Per row and order, features go one by one from a background
    row (drawn by a hash of the id, or all of them) to the row's own value; the change of p
    belongs to the feature that moved.  A row's steps follow one another within a task, so
    they are added up there and only sums leave it.  A null feature is an error.
    """
    if not background:
        raise ValueError("no background rows")
    n, some = len(features), orders(len(features), permutations, seed)
    ground, n_ground = np.array(background, np.float64), len(background)
    moved = np.array(some)                                    # order: the feature that moves at each step
    own = np.argsort(moved, axis=1)[:, None, :] < np.arange(n + 1)[None, :, None]     # order, step, feature: has it moved?
    walks = len(some) * (n_ground if every_background else 1)
    steps = walks * (n + 1)
    id_type = rows.schema[id_col].dataType
    drawn = F.array(*[F.pmod(F.xxhash64(id_col, F.lit(m), F.lit(seed)), F.lit(n_ground)).cast("int") for m in range(len(some))])
    x = rows.select(id_col, F.array(*[F.col(c).cast("double") for c in features]).alias("x"), drawn.alias("b"))

    def mixed(batches):
        """(id_col, at, raw): the points of each row, one after another; ``at`` counts them."""
        at, most = 0, max(1, _POINTS // steps)
        for batch in batches:
            values = batch.column(1).flatten()
            if values.null_count:
                raise ValueError("a feature is null")
            values = values.to_numpy(zero_copy_only=False).reshape(-1, 1, 1, 1, n)
            if every_background:
                others = np.broadcast_to(ground[None, None, :, None, :], (batch.num_rows, 1, n_ground, 1, n))
            else:
                others = ground[batch.column(2).flatten().to_numpy(zero_copy_only=False)].reshape(-1, len(some), 1, 1, n)
            for s in range(0, batch.num_rows, most):
                few = min(most, batch.num_rows - s)
                raw = np.where(own[None, :, None], values[s:s + few], others[s:s + few]).reshape(-1, n)
                points = few * steps
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(s, s + few), steps))), pa.array(np.arange(at, at + points)), dense(raw)],
                                                 [id_col, "at", "raw"])
                at += points
    made = x.mapInArrow(mixed, StructType([StructField(id_col, id_type), StructField("at", LongType()), StructField("raw", VectorUDT())]))
    stepped = score(made).select(id_col, "at", F.col("p").cast("double").alias("p"))

    def added(batches):
        """(id_col, base, prediction, parts): the sums of each row's walks."""
        left = None
        for batch in batches:
            if left is not None:
                batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            whole = batch.num_rows // steps
            left = batch.slice(whole * steps)
            if not whole:
                continue
            at = batch.column(1).to_numpy()[:whole * steps]
            if at[0] % steps or (np.diff(at) != 1).any():
                raise ValueError("score has moved rows")
            p = batch.column(2).to_numpy(zero_copy_only=False)[:whole * steps].reshape(whole, len(some), -1, n + 1)
            change = np.diff(p, axis=3).sum(axis=2)
            parts = np.zeros((whole, n))
            for m, order in enumerate(moved):
                parts[:, order] += change[:, m]
            ends = p.sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0)[:whole * steps:steps], pa.array(ends[:, 0]), pa.array(ends[:, n]),
                                              lists(parts)], [id_col, "base", "prediction", "parts"])
        if left is not None and left.num_rows:
            raise ValueError("score has moved rows")
    sums = stepped.mapInArrow(added, StructType([StructField(id_col, id_type), StructField("base", DoubleType()), StructField("prediction", DoubleType()),
                                                 StructField("parts", ArrayType(DoubleType()))]))
    runs = F.count(F.lit(1)) * F.lit(walks)
    return sums.groupBy(id_col).agg((F.sum("base") / runs).alias("base"), (F.sum("prediction") / runs).alias("prediction"),
                                    F.array(*[F.sum(F.col("parts")[i]) / runs for i in range(n)]).alias("contributions"))


def long_form(values: DataFrame, features: list[str], id_col: str = "event_id") -> DataFrame:
    """(id_col, feature, contribution, base, prediction), one row per feature."""
    return values.select(id_col, "base", "prediction", F.posexplode("contributions").alias("i", "contribution")) \
        .select(id_col, F.get(F.array(*[F.lit(f) for f in features]), F.col("i")).alias("feature"), "contribution", "base", "prediction")

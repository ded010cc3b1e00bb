"""Quality by importance resampling of hashed n-gram models.

Two bags of hashed n-grams are estimated: one of target text (documents labelled good) and
one of the raw corpus (all documents).  A document's log weight is the mean log ratio per
n-gram of its probability under both, times 100; Gumbel noise is added and the k largest keys are the sample.
N-grams are words, word pairs and pairs of word shapes with a mark for a repeated word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskframe.llm.common import cut, texts, unused

#: Buckets of words, word pairs and shape pairs.
BUCKETS = (1 << 15, 1 << 15, 1 << 12)
#: Good documents that the target model takes at most: those with the smallest hashes of their ids.
TARGET_ROWS = 50_000
#: Pseudo-count of a bucket, as a share of the corpus model.
SMOOTH = 1.0
#: n-grams that a document's log weight is scaled to, so that weights of short and long texts compare.
LENGTH = 100.0
SEED = 17

_OFFSETS = np.concatenate(([0], np.cumsum(BUCKETS)))


def _kinds() -> np.ndarray:
    """Kind of a byte: 1 lower case and non-ASCII, 2 upper case, 3 digit, else its own."""
    kind = np.arange(256, dtype=np.uint64) + 4
    kind[0x80:] = kind[0x61:0x7B] = 1
    kind[0x41:0x5B] = 2
    kind[0x30:0x3A] = 3
    return kind


_KIND = _kinds()
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint64)
_GAP = np.isin(np.arange(256), (0x20, 9, 10, 11, 12, 13))
_CHUNK = 1 << 18


def _mix(x: np.ndarray, n: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)


def grams(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram of whole texts; words end at ASCII white space."""
    data = np.frombuffer(b" ".join(texts_) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts_), np.int64, len(texts_)) + 1)
    gap = _GAP[data]
    start = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    stop = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
    n = stop - start
    power = np.cumprod(np.full(int(n.max()), 0x100000001B3, np.uint64))
    inside = np.flatnonzero(~gap)
    first = np.cumsum(n) - n
    letters = data[inside]
    word = np.add.reduceat(_LOWER[letters] * power[inside - np.repeat(start, n)], first)
    upper = np.add.reduceat((_KIND[letters] == 2).astype(np.int64), first)
    lower = np.add.reduceat((_KIND[letters] == 1).astype(np.int64), first)
    size = np.digitize(n, (3, 12, 30)).astype(np.uint64)
    shape = ((_KIND[data[start]] * np.uint64(263) + _KIND[data[stop - 1]]) * np.uint64(2)
             + ((upper > 1) & (lower == 0)).astype(np.uint64)) * np.uint64(4) + size
    doc = np.searchsorted(ends, start, "right")
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    a, b = word[pair], word[pair + 1]
    odd = np.uint64(0x9E3779B97F4A7C55)
    return (np.concatenate((doc, doc[pair], doc[pair])),
            np.concatenate((_mix(word, BUCKETS[0]), _mix(a * odd + b, BUCKETS[1]) + _OFFSETS[1],
                            _mix((shape[pair] * odd + shape[pair + 1]) * np.uint64(2) + (a == b).astype(np.uint64), BUCKETS[2]) + _OFFSETS[2])))


def _pieces(column) -> Iterator[list[bytes]]:
    """The texts of a batch in groups of about a quarter of a megabyte, one at a time; a longer text is a group of its own."""
    held, size = [], 0
    for value in column.cast(pa.binary()):
        text = value.as_py()
        if held and size + len(text) > _CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def counts(docs: DataFrame, good: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts per bucket over all documents and over those whose id is in ``good``.

    ``good`` holds TARGET_ROWS ids at most and is broadcast; every task adds up its own
    documents, so it sends one row per bucket it saw, however long they are.
    """
    def run(batches):
        raw, target = np.zeros(_OFFSETS[-1], np.int64), np.zeros(_OFFSETS[-1], np.int64)
        for batch in batches:
            good_here, at = np.array(batch.column(1).to_pylist(), bool), 0
            for group in _pieces(batch.column(0)):
                doc, bucket = grams(group)
                raw += np.bincount(bucket, minlength=_OFFSETS[-1])
                target += np.bincount(bucket[good_here[at + doc]], minlength=_OFFSETS[-1])
                at += len(group)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    marked = docs.join(F.broadcast(good.withColumn("good", F.lit(True))), "doc_id", "left") \
        .select("text", F.coalesce("good", F.lit(False)).alias("good"))
    per_bucket = marked.mapInArrow(run, "bucket long, raw long, target long") \
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(_OFFSETS[-1]), np.zeros(_OFFSETS[-1])
    for r in per_bucket.collect():          # at most sum(BUCKETS) rows
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of every bucket; both smoothed towards the corpus."""
    out = np.zeros(len(raw))
    for a, b in zip(_OFFSETS[:-1], _OFFSETS[1:]):
        r, t = raw[a:b], target[a:b]
        if r.sum() == 0 or t.sum() == 0:
            continue
        p = (r + SMOOTH) / (r + SMOOTH).sum()
        q = (t + SMOOTH * len(t) * p) / (t.sum() + SMOOTH * len(t))
        out[a:b] = np.log(q) - np.log(p)
    return out


def score(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", length: float = LENGTH, out: str = "log_weight") -> DataFrame:
    """``docs`` with ``out``, the log weight: its mean log ratio per n-gram times ``length``; 0 without n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    at = docs.columns.index(text_col)

    def run(batches):
        table = shared.value
        for batch in batches:
            parts = []
            for group in _pieces(batch.column(at).fill_null("")):
                doc, bucket = grams(group)
                total = np.bincount(doc, weights=table[bucket], minlength=len(group))
                parts.append(length * total / np.maximum(np.bincount(doc, minlength=len(group)), 1))
            weight = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight, pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise, a function of the id and the seed."""
    bits = F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11).cast("double")
    return -F.log(-F.log((bits + 0.5) / F.lit(float(1 << 53))))


def threshold(weights: DataFrame, labels: DataFrame) -> float | None:
    """The log weight that parts labelled good from labelled bad documents best: the middle of the best gap.

    Weights are counted in steps of 1/8 between -1000 and 1000, so the driver gets that
    many rows at most.  None unless both kinds are present.
    """
    step = F.greatest(F.least(F.floor(F.col("log_weight") * 8), F.lit(8000)), F.lit(-8000))
    rows = weights.join(labels.select("doc_id", "quality"), "doc_id").where("quality IS NOT NULL") \
        .groupBy(step.alias("step")).agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"),
                                         F.sum((F.col("quality") <= 0).cast("long")).alias("bad")).orderBy("step").collect()
    n_good, n_bad = sum(r.good for r in rows), sum(r.bad for r in rows)
    if not n_good or not n_bad:
        return None
    best, at, good_below, bad_below = -1.0, [], 0, 0
    for i, r in enumerate(rows):
        good_below, bad_below = good_below + r.good, bad_below + r.bad
        right = bad_below / n_bad + 1 - good_below / n_good
        edge = (r.step + 1 + (rows[i + 1].step if i + 1 < len(rows) else r.step + 1)) / 16
        if right > best + 1e-12:
            best, at = right, [edge]
    return at[0]


def kth_largest(keys: DataFrame, k: int, steps: int = 1024) -> float:
    """A value with at least ``k`` keys at or above it and, but for ties, no more: counting passes over ``key``."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while hi > lo:
        width = (hi - lo) / steps
        if lo + width == lo or width <= 0:
            break
        part = F.least(F.floor((F.col("key") - F.lit(lo)) / F.lit(width)), F.lit(steps - 1))
        rows = keys.where((F.col("key") >= lo) & (F.col("key") <= hi)).groupBy(part.alias("part")) \
            .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("part")).collect()
        for r in rows:
            if above + r.n >= k:
                done = above + r.n == k
                lo, hi = r.lo, r.hi
                break
            above += r.n
        if done:
            return lo
    return lo


def sample(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS, k: int | None = None) -> tuple[DataFrame, float, np.ndarray]:
    """Scored documents (doc_id, log_weight, key), the key from which they are sampled, and the log ratios.

    Without ``k``, the sample is as large as the number of documents at or above the
    threshold that the labels give, counted over all documents; without labels of both
    kinds it is the whole table.  Documents tied at the last key are all sampled.  Null
    and empty texts have no n-grams and weight 0.  Repeated rows are scored and kept
    alike; labels of unknown documents, null ids and null labels are ignored; an empty
    table gives no rows.
    """
    rows = texts(docs)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL").distinct()
    good = marks.where("quality > 0").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(target_rows)
    ratio = log_ratio(*counts(rows, good))
    scored = cut(score(rows, ratio).select("doc_id", "log_weight", (F.col("log_weight") + gumbel(F.col("doc_id"))).alias("key")), "quality")
    if k is None:
        edge = threshold(scored, marks)
        k = scored.count() if edge is None else scored.where(F.col("log_weight") >= edge).count()
    if k <= 0 or scored.isEmpty():
        return scored, float("inf"), ratio
    return scored, kth_largest(scored, k), ratio


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, log_weight, key, kept) of every row of ``docs``."""
    scored, edge, _ = sample(docs, labels, **options)
    return scored.withColumn("kept", F.col("key") >= F.lit(edge))


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that are sampled, all columns kept.

    Rows are judged one by one as in ``classify``, in a pass without a shuffle.
    """
    _, edge, ratio = sample(docs, labels, **options)
    name = unused("_quality_log_weight", docs)
    return score(docs, ratio, out=name) \
        .where(F.col(name) + gumbel(F.col("doc_id").cast("long")) >= F.lit(edge)).drop(name)

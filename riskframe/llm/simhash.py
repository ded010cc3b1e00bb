"""SimHash near-duplicates: pigeonhole blocks of a 64-bit fingerprint, Hamming check, components.

A pair that differs in at most three bits agrees on at least three of six blocks, so
every such pair shares one of the twenty keys that name three blocks and their bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import cut, texts, unused
from riskframe.llm.graph import components

SHINGLE = 3
MAX_BITS = 3
BLOCKS = 6
#: Fingerprints of one key that are compared in one task; larger keys get longer keys.
GROUP = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of whole ``text``: XXH64 (seed 42) of its word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], 42) for s, e in zip(starts[: len(words) - shingle + 1].tolist(),
                                                       ends[shingle - 1:].tolist())]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at: at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist()))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, hash of the text, fp long) of every row; null and empty texts have fingerprint zero."""
    def run(batches):
        for batch in batches:
            out = [_signed(fingerprint(t, shingle)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.int64())], ["doc_id", "hash", "fp"])
    return texts(docs).withColumn("hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, hash long, fp long")


def _block_edges(blocks: int, bits: int = 64) -> list[int]:
    return [bits * i // blocks for i in range(blocks + 1)]


def _keys(max_bits: int, width: int = 64, blocks: int | None = None) -> list[int]:
    """Bit masks; fingerprints at ``max_bits`` or fewer apart agree under at least one."""
    blocks = blocks or 2 * max_bits
    edges = _block_edges(blocks, width)
    return [sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in pick)
            for pick in combinations(range(blocks), blocks - max_bits)]


def _spread(mask: int, bits: list[int]) -> int:
    return sum(1 << b for i, b in enumerate(bits) if mask >> i & 1)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _spanning(fps: np.ndarray, max_bits: int):
    """Edges that connect what is linked within ``fps`` (distinct), one per joined member."""
    left = fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _popcount((left ^ x).view(np.uint64)) <= max_bits
            if near.any():
                got = left[near]
                left = left[~near]
                queue.extend(got)
                yield np.full(len(got), x), got


def _grouped(batches, limit: int):
    """(key, fps or None, whole) per key of rows sorted by key; keys beyond ``limit`` come in parts."""
    key, held, big = None, [], False
    for batch in batches:
        keys = batch.column(0).to_numpy()
        fps = batch.column(1).to_numpy()
        if not len(keys):
            continue
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if key is None or keys[s] != key:
                if held:
                    yield key, np.concatenate(held), not big
                key, held, big = keys[s], [], False
            held.append(fps[s:e])
            if sum(map(len, held)) > limit:
                yield key, np.concatenate(held), False
                held, big = [], True
    if held:
        yield key, np.concatenate(held), not big


def _link_stage(keyed: DataFrame, max_bits: int, limit: int, tag: str) -> DataFrame:
    """Spanning edges of each key's group; members of groups beyond ``limit`` come back as rows."""
    def run(batches):
        a, b, again = [], [], []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int32())])

        def out():
            n = np.concatenate(a) if a else np.empty(0, np.int64)
            m = np.concatenate(b) if b else np.empty(0, np.int64)
            k = np.concatenate(again) if again else np.empty(0, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(k, pa.int32())], schema=schema)
        for key, fps, whole in _grouped(batches, limit):
            if whole:
                if len(fps) < 2:
                    continue
                for x, y in _spanning(fps, max_bits):
                    a.append(x)
                    b.append(y)
                    again.append(np.full(len(x), -1, np.int32))
            else:
                a.append(fps)
                b.append(fps)
                again.append(np.full(len(fps), int(key) & 0xFF, np.int32))
            if len(a) > 2000:
                yield out()
                a, b, again = [], [], []
        yield out()

    return cut(keyed.repartition("key").sortWithinPartitions("key")
               .select("key", "fp").mapInArrow(run, "a long, b long, mask int"), tag)


def _with_keys(fps: DataFrame, masks: list[int]) -> DataFrame:
    """One row per mask; the key's low byte is the mask's number, the rest hashes the masked bits."""
    parts = [F.shiftleft(F.xxhash64(F.col("fp").bitwiseAND(F.lit(_signed(m))), F.lit(i)), 8).bitwiseOR(F.lit(i).cast("long"))
             for i, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*parts)).alias("key"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs at ``max_bits`` or fewer.

    Only a spanning set of the links inside a key's group leaves a task.  A group of more
    than ``group`` fingerprints is keyed again on three sixths of its free bits; the bits
    still free are then 16 at most, so a group has at most 65,536 distinct members.
    """
    masks = _keys(max_bits)
    first = _link_stage(_with_keys(fps, masks), max_bits, group, "simhash-links")
    edges = first.where("mask < 0").select("a", "b")
    dense = first.where("mask >= 0").select(F.col("a").alias("fp"), "mask").distinct()
    if dense.isEmpty():
        return edges
    longer = []
    for i, m in enumerate(masks):
        free = [b for b in range(64) if not m >> b & 1]
        longer += [(i, _signed(m | _spread(s, free))) for s in _keys(max_bits, len(free))]
    table = F.create_map(*[x for i in range(len(masks)) for x in
                           (F.lit(i), F.array(*[F.lit(v) for j, v in longer if j == i]))])
    again = dense.select("fp", F.explode(table[F.col("mask")]).alias("m")) \
        .select("fp", F.xxhash64(F.col("fp").bitwiseAND(F.col("m")), "m").alias("key"))
    return edges.union(_link_stage(again, max_bits, 1 << 62, "simhash-dense").select("a", "b"))


def _groups(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """(doc_id, hash, fp, component_id) of every row."""
    fps = cut(fingerprints(docs, shingle), "simhash-fp")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    comp = components(links(least.select("fp"), max_bits), "simhash-cc")
    named = least.join(comp, least.fp == comp.node, "left") \
        .select(least.fp.alias("fp"), F.coalesce("root", least.fp).alias("root"), "doc_id")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return fps.join(named.join(smallest, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and link like any other.  Equal
    fingerprints are collapsed before keys are made, so copies cost one row.  Repeated
    rows are kept; a null doc_id never names a component unless all its ids are null.
    Other columns are ignored; an empty table gives an empty table.
    """
    return _groups(docs, shingle, max_bits) \
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) whose doc_id is the smallest of their group; null ids stay."""
    own, own_hash = unused("_id", docs), unused("_hash", docs)
    losers = _groups(docs, shingle, max_bits).where("component_id < doc_id") \
        .select(F.col("doc_id").alias(own), F.col("hash").alias(own_hash)).distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.join(losers, (docs["doc_id"].cast("long") == F.col(own)) & (F.xxhash64(text) == F.col(own_hash)), "left_anti")

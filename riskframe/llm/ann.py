"""Approximate nearest neighbours: a forest of random-projection trees.

The forest is fitted on a bounded sample: every node projects on the line between two
centres drawn at random and splits at the median.  All vectors are put into their leaves.
A query walks all trees through one priority queue ordered by the distance to the planes
it has crossed, and its leaves' members are ranked by their exact cosine.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import cut

#: Vectors the forest is fitted on at most: those with the smallest hashes.
FIT_ROWS = 16_384
TREES = 8
#: Splits from root to leaf at most; a leaf keeps LEAF_ROWS sample rows or more.
DEPTH, LEAF_ROWS = 7, 16
#: Leaves that a query visits over all trees.
VISITS = 112
#: Members of a leaf that one task compares; larger leaves are dealt into blocks.
BLOCK = 8192


def _split(rows: np.ndarray, rng) -> tuple[np.ndarray, float] | None:
    """Plane (normal, offset) between two random centres moved to their halves' means."""
    a, b = rows[rng.choice(len(rows), 2, replace=False)]
    for _ in range(4):
        near = rows[rng.choice(len(rows), min(len(rows), 400), replace=False)]
        side = near @ (a - b) > (a @ a - b @ b) / 2
        if side.all() or not side.any():
            break
        a, b = near[side].mean(0), near[~side].mean(0)
    normal = a - b
    if not np.abs(normal).max() > 0:
        normal = rng.standard_normal(rows.shape[1])
    normal = normal / np.linalg.norm(normal)
    at = rows @ normal
    middle = float(np.median(at))
    if not (at > middle).any():
        return None
    return normal, middle


class Forest:
    """Planes and children of all trees in flat arrays; a node without children is a leaf."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, leaf_rows: int, seed: int = 5):
        self.normal, self.offset, self.child, self.roots = [], [], [], []
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        for _ in range(trees):
            self.roots.append(self._grow(sample, depth, leaf_rows, rng))
        self.normal = np.array(self.normal).reshape(-1, self.dim)
        self.offset = np.array(self.offset)

    def _grow(self, rows, depth, leaf_rows, rng) -> int:
        node = len(self.child)
        self.normal.append(np.zeros(self.dim))
        self.offset.append(0.0)
        self.child.append(None)
        plane = _split(rows, rng) if depth > 0 and len(rows) >= 2 * leaf_rows else None
        if plane is not None:
            self.normal[node], self.offset[node] = plane
            right = rows @ plane[0] > plane[1]
            self.child[node] = (self._grow(rows[~right], depth - 1, leaf_rows, rng), self._grow(rows[right], depth - 1, leaf_rows, rng))
        return node

    def margins(self, unit: np.ndarray) -> np.ndarray:
        return (unit[:, None, :] * self.normal[None]).sum(2) - self.offset if len(unit) == 1 else unit @ self.normal.T - self.offset

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree."""
        out = np.empty((len(unit), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(unit)))]
            while todo:
                node, at = todo.pop()
                if self.child[node] is None:
                    out[at, t] = node
                elif len(at):
                    right = unit[at] @ self.normal[node] > self.offset[node]
                    todo += [(self.child[node][0], at[~right]), (self.child[node][1], at[right])]
        return out

    def search(self, unit: np.ndarray, visits: int) -> list[int]:
        """Leaves in the order of one queue over all trees: least distance to a crossed plane first."""
        margin = self.normal @ unit - self.offset
        queue, found = [(0.0, root) for root in self.roots], []
        while queue and len(found) < visits:
            far, node = heapq.heappop(queue)
            if self.child[node] is None:
                found.append(node)
                continue
            m = margin[node]
            left, right = self.child[node]
            heapq.heappush(queue, (far, right if m > 0 else left))
            heapq.heappush(queue, (max(far, abs(m)), left if m > 0 else right))
        return found


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec array<double>) of the rows that take part."""
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")) \
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0)) \
        .withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _leaf_rows(classes: DataFrame, forest, dim: int, visits: int | None, blocks) -> DataFrame:
    """Rows (leaf, block, kind, class_id, ids, vec): members in their leaves, or queries in all they visit.

    ``blocks`` maps a leaf to the number of blocks its members are dealt into; queries
    go to every block.
    """
    schema = pa.schema([("leaf", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("class_id", pa.int64()),
                        ("ids", pa.list_(pa.int64())), ("vec", pa.list_(pa.float64()))])

    def run(batches):
        trees = forest.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, unit = batch.column(0).to_numpy(), _units(_matrix(batch.column(2), dim))
            if visits is None:
                leaf = trees.leaves(unit).ravel()
                row = np.repeat(np.arange(len(ids)), len(trees.roots))
                block = (ids[row] // 7919) % np.array([blocks.get(x, 1) for x in leaf.tolist()] or [1])
            else:
                hits = [(i, x, k) for i in range(len(ids)) for x in trees.search(unit[i], visits) for k in range(blocks.get(x, 1))]
                row, leaf, block = (np.array(c, np.int64) for c in zip(*hits))
            for at in range(0, len(row), 20_000):
                r = row[at:at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[at:at + 20_000], pa.int32()), pa.array(block[at:at + 20_000], pa.int32()),
                     pa.array(np.full(len(r), visits is not None, np.int32)), pa.array(ids[r]),
                     batch.column(1).take(pa.array(r)), batch.column(2).take(pa.array(r))], schema=schema)
    return classes.select("class_id", "ids", "vec") \
        .mapInArrow(run, "leaf int, block int, kind int, class_id long, ids array<long>, vec array<double>")


def _rank(batches, dim: int, k: int):
    """Rows sorted by leaf, block and kind: the k + 1 best ids of every block for each query class."""
    schema = pa.schema([("class_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    now, vecs, ids, norms = None, [], [], None
    for batch in batches:
        leaf, block, kind = (batch.column(i).to_numpy() for i in range(3))
        matrix = _matrix(batch.column(5), dim)
        matrix = matrix / np.abs(matrix).max(1, keepdims=True) if len(matrix) else matrix
        id_lists, who = batch.column(4).to_pylist(), batch.column(3).to_pylist()
        out = []
        for i in range(batch.num_rows):
            if (leaf[i], block[i]) != now:
                now, vecs, ids, norms = (leaf[i], block[i]), [], [], None
            if kind[i] == 0:
                vecs.append(matrix[i])
                ids.append(id_lists[i])
                continue
            if len(vecs) == 0:
                continue
            if norms is None:
                vecs = np.array(vecs)
                norms = np.sqrt((vecs * vecs).sum(1))
            q = matrix[i]
            cos = (vecs * q).sum(1) / (norms * np.sqrt((q * q).sum()))
            near = np.argpartition(-cos, k)[:k + 1] if len(cos) > k + 1 else np.arange(len(cos))
            near = np.flatnonzero(cos >= cos[near].min())           # all that tie with the last
            best = sorted((-cos[j], v) for j in near.tolist() for v in ids[j])[:k + 1]
            out += [(who[i], v, -c) for c, v in best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5, fit_rows: int = FIT_ROWS, trees: int = TREES,
               depth: int = DEPTH, visits: int = VISITS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every vec_id divisible by ``every``.

    Nearness is the cosine in double precision, ties go to the smaller vec_id; a query's
    own id is no candidate.  Equal vectors are one class that carries its k + 1 smallest
    ids, which are the only ones that can be among anyone's k nearest; so a vector that
    very many rows share is searched and compared once.  Rows with a null id, or a vector
    that is null, empty, zero or has null or non-finite components, take no part, nor do
    vectors whose length is not the sample's most frequent; repeated rows of an id and a
    vector count once.  An empty table, or one without a query, gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).distinct()
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    classes = cut(rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
                  .groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
                  .select(F.col("ids")[0].alias("class_id"), "ids", "vec",
                          F.concat_ws(",", F.transform("vec", lambda x: x.cast("string"))).alias("same")), "ann-classes")
    sample = [r.vec for r in classes.orderBy(F.xxhash64("vec"), "class_id").limit(fit_rows).select("vec").collect()]
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return none
    sizes = [len(v) for v in sample]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n))
    fit = _units(np.array([v for v in sample if len(v) == dim]))
    forest = spark.sparkContext.broadcast(Forest(fit, trees, depth, LEAF_ROWS))
    classes = classes.where(F.size("vec") == dim)
    members = _leaf_rows(classes, forest, dim, None, {})
    counts = members.groupBy("leaf").count().where(F.col("count") > block).collect()      # a row per large leaf: the forest's size at most
    blocks = {r.leaf: -(-r["count"] // block) for r in counts}
    if blocks:
        members = _leaf_rows(classes, forest, dim, None, blocks)
    asked = rows.where((F.pmod("vec_id", F.lit(every)) == 0) & (F.size("vec") == dim)) \
        .select(F.col("vec_id").alias("query_id"), F.concat_ws(",", F.transform("vec", lambda x: x.cast("string"))).alias("same"))
    wanted = classes.join(asked.select("same").distinct(), "same", "left_semi")
    queries = _leaf_rows(wanted, forest, dim, visits, blocks)
    found = members.unionByName(queries).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind") \
        .mapInArrow(lambda b: _rank(b, dim, k), "class_id long, vec_id long, score double") \
        .groupBy("class_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("class_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    per_query = asked.join(classes.select("same", "class_id"), "same").select("query_id", "class_id").distinct() \
        .join(best, "class_id").where("query_id <> vec_id") \
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return per_query.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact k nearest neighbours by Euclidean distance, by partitions with distance bounds.

Points go to the nearest of a few pivots and are cut, in the order of their distance to
it, into blocks of bounded size.  A query first meets the block nearest to it; the k-th
distance found there bounds which other blocks can hold anything nearer (triangle
inequality to the pivots), and only those are visited.  The pivots are a bounded sample
and decide on speed alone; every block that a bound can't rule out is compared.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import checkpoint_dir

#: Pivots at most; rows of a block; queries that meet one copy of a block; queries compared at once.
PIVOTS, BLOCK, VISITORS, STEP = 64, 2048, 1 << 15, 512
#: Bounds are widened by this, so that rounding never rules out a block.
SLACK = 1e-9


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read again."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt evenly (or by ``keys``) over at least two tasks a core, for work on each row that is far larger than the row.

    A small file is one partition, and that work would be one task's; the number is given, so that
    small partitions are not put together again.
    """
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def vectors(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """(id, v): rows whose id is present and whose values are all present and finite."""
    values = [F.col(c).cast("double") for c in cols]
    fit = F.col(id_col).isNotNull()
    for v in values:
        fit = fit & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return df.where(fit).select(F.col(id_col).cast("long").alias("id"), F.array(*values).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, summed column by column from the first."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i, None] - b[None, :, i]
        out += d * d
    return out


def _to_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, dist): the nearest pivot and the distance to it."""
    def run(batches):
        for batch in batches:
            d = np.sqrt(_squares(_matrix(batch.column(1), pivots.shape[1]), pivots))
            cell = d.argmin(1) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "dist"])
    return rows.mapInArrow(run, "id long, v array<double>, cell int, dist double")


def _blocks(points: DataFrame, width: int, size: int) -> DataFrame:
    """(block, cell, low, high, n, ids, data): blocks of a cell's points in the order of their distance to the pivot."""
    def run(batches):
        part, made, cell, held = TaskContext.get().partitionId(), 0, None, []

        def block():
            ids = np.array([h[0] for h in held], np.int64)
            order = np.argsort(ids, kind="stable")
            data = np.array([h[1] for h in held])[order]
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + made]), pa.array([cell], pa.int32()), pa.array([held[0][2]]), pa.array([held[-1][2]]), pa.array([len(held)]),
                pa.array([ids[order].tolist()], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary())],
                ["block", "cell", "low", "high", "n", "ids", "data"])
        for batch in batches:
            for i, v, c, d in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), width), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if held and (c != cell or len(held) == size):
                    yield block()
                    made, held = made + 1, []
                cell = c
                held.append((i, v, d))
        if held:
            yield block()
    return points.repartitionByRange("cell", "dist").sortWithinPartitions("cell", "dist") \
        .mapInArrow(run, "block long, cell int, low double, high double, n long, ids array<long>, data binary")


def _best(sq: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k smallest finite values, ties to the smaller id."""
    kk = min(k, sq.shape[1])
    edge = np.partition(sq, kk - 1, axis=1)[:, kk - 1]
    r, c = np.nonzero((sq <= edge[:, None]) & np.isfinite(sq))
    order = np.lexsort((ids[c], sq[r, c], r))
    r, c = r[order], c[order]
    start = np.searchsorted(r, r)
    keep = np.arange(len(r)) - start < kk
    return r[keep], c[keep]


def _visit(pairs: DataFrame, blocks: DataFrame, width: int, k: int, itself: bool) -> DataFrame:
    """(query, point, sq): each visiting query's k nearest points of each block it visits.

    ``pairs`` (id, v, block).  Blocks with many visitors are copied, one copy for at most
    about VISITORS of them; a task holds one block and STEP queries at a time.  The table of
    copies, a row per block, is broadcast, so that the vectors are shuffled once.
    """
    copies = F.broadcast(pairs.select("block").groupBy("block").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("copies")))
    visitors = pairs.join(copies, "block").select(
        "block", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), "id", "v",
        F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("data"))
    hosts = blocks.join(copies, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"),
        F.lit(None).cast("array<double>").alias("v"), "ids", "data")

    def run(batches):
        ids = data = None
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)])) if len(kinds) else []
            for s, e in zip(edges[:-1], edges[1:]):
                if kinds[s] == 0:                     # only the last block of a run has visitors behind it
                    ids = np.asarray(batch.column(3)[e - 1].values, np.int64)
                    data = np.frombuffer(batch.column(4)[e - 1].as_py()).reshape(-1, width)
                    continue
                for at in range(s, e, STEP):
                    some = batch.slice(at, min(STEP, e - at))
                    mine = some.column(1).to_numpy()
                    sq = _squares(_matrix(some.column(2), width), data)
                    if not itself:
                        sq[mine[:, None] == ids[None, :]] = np.inf
                    r, c = _best(sq, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(mine[r]), pa.array(ids[c]), pa.array(sq[r, c])], ["query", "point", "sq"])
    return visitors.union(hosts).repartition("block", "copy").sortWithinPartitions("block", "copy", "kind") \
        .select("kind", "id", "v", "ids", "data").mapInArrow(run, "query long, point long, sq double")


def _smallest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("sq", "point")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Points:
    """The points of ``knn_join`` cut into blocks, which several joins can share."""

    def __init__(self, points: DataFrame, cols: list[str], id_col: str = "event_id", pivots: int = PIVOTS, block: int = BLOCK):
        p = vectors(points, id_col, cols)
        self.width = len(cols)
        self.centres = np.array([r.v for r in p.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()])   # at most ``pivots`` rows
        if len(self.centres):
            self.between = np.sqrt(_squares(self.centres, self.centres))
            self.blocks = written(_blocks(_to_pivots(p, self.centres), self.width, block), "knn-blocks")
            rows: dict[int, list] = {}                      # a row per block, in the order of the distance to the pivot
            for r in self.blocks.select("block", "cell", "low", "high").orderBy("cell", "low", "high", "block").collect():
                rows.setdefault(r.cell, []).append((r.low, r.high, r.block))
            self.by_cell = {c: tuple(np.array(x) for x in zip(*r)) for c, r in rows.items()}


def knn_join(queries: DataFrame, points: DataFrame | Points, cols: list[str], k: int, id_col: str = "event_id", itself: bool = False,
             pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query, rank, point, distance): the k nearest ``points`` of every row of ``queries``.

    Distances are Euclidean over ``cols``, ties go to the smaller id; a point with the
    query's own id counts only with ``itself``.  Rows with an absent or non-finite value
    take no part; a query finds fewer than k rows where there are no more points.
    """
    width = len(cols)
    q, p = vectors(queries, id_col, cols), points if isinstance(points, Points) else Points(points, cols, id_col, pivots, block)
    if not len(p.centres):
        return q.sparkSession.createDataFrame([], "query long, rank int, point long, distance double")
    centres, between, blocks, by_cell = p.centres, p.between, p.blocks, p.by_cell
    reach = {c: (low[0], high.max()) for c, (low, high, _) in by_cell.items()}

    def homes(batches):
        """(id, v, home): the block of the query's own cell that is nearest in distance to the pivot."""
        for batch in batches:
            d = np.sqrt(_squares(_matrix(batch.column(1), width), centres))
            own = d.argmin(1) if len(d) else np.empty(0, np.int64)
            home = np.full(len(d), -1, np.int64)
            for c, (lows, highs, names) in by_cell.items():
                at = np.flatnonzero(own == c)
                if len(at):
                    i = np.minimum(np.searchsorted(highs, d[at, c]), len(highs) - 1)
                    before = np.maximum(i - 1, 0)
                    home[at] = names[np.where(np.abs(d[at, c] - highs[before]) < np.maximum(lows[i] - d[at, c], 0.0), before, i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home, mask=home < 0)], ["id", "v", "home"])

    # First visit: that block; a query's vector is written once.
    asked = written(q.mapInArrow(homes, "id long, v array<double>, home long"), "knn-queries")
    first = written(_smallest(_visit(asked.where("home IS NOT NULL").select("id", "v", F.col("home").alias("block")), blocks, width, k, itself), k), "knn-first")
    bound = first.where(F.col("rank") == k).select(F.col("query").alias("id"), F.sqrt("sq").alias("bound"))

    def cells(batches):
        """(id, v, blocks): each query with the blocks, other than its first, that the bound can't rule out."""
        for batch in batches:
            d = np.sqrt(_squares(_matrix(batch.column(1), width), centres))
            theta = np.array([np.inf if b is None else b for b in batch.column(3).to_pylist()])
            home = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
            wide = theta * (1 + SLACK) + SLACK
            own = d.argmin(1) if len(d) else np.empty(0, np.int64)
            d_own = d[np.arange(len(d)), own]
            who, what = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for c, (low, high) in reach.items():
                # Points of cell c are no nearer to the query than its distance to the plane between both pivots.
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(between[own, c] > 0, (d[:, c] ** 2 - d_own ** 2) / (2 * between[own, c]), 0.0)
                at = np.flatnonzero((d[:, c] - wide <= high * (1 + SLACK)) & (d[:, c] + wide >= low * (1 - SLACK)) & (plane * (1 - SLACK) - SLACK * d[:, c] <= wide))
                if len(at):
                    lows, highs, blocks_of = by_cell[c]
                    first_at = np.searchsorted(highs * (1 + SLACK), d[at, c] - wide[at], side="left")
                    count = np.maximum(np.searchsorted(lows * (1 - SLACK), d[at, c] + wide[at], side="right") - first_at, 0)
                    row = np.repeat(at, count)
                    found = blocks_of[np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first_at, count)]
                    other = found != home[row]
                    who.append(row[other])
                    what.append(found[other])
            who, what = np.concatenate(who), np.concatenate(what)
            if len(who):
                order = np.argsort(who, kind="stable")
                rows, count = np.unique(who, return_counts=True)
                some = batch.take(pa.array(rows))
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(count))).astype(np.int32), pa.array(what[order], pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), lists], ["id", "v", "blocks"])
    # a query's vector is written once more here, whatever the number of its blocks
    more = written(asked.join(bound, "id", "left").select("id", "v", "home", "bound")
                   .mapInArrow(cells, "id long, v array<double>, blocks array<long>"), "knn-rest")
    rest = _visit(more.select("id", "v", F.explode("blocks").alias("block")), blocks, width, k, itself)
    return _smallest(first.select("query", "point", "sq").union(rest), k) \
        .select("query", F.col("rank").cast("int").alias("rank"), "point", F.sqrt("sq").alias("distance"))

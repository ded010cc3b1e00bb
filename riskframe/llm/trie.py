"""Prefix trie of conversations by vertical bitmaps, built in shards of sorted conversations.

Equal conversations are one sequence with a weight.  Sequences are cut into ranges of
their sorted order, so a first turn that many share is spread over tasks.  Inside a shard
every (position, turn) has a bitset of the sequences that hold it there; a depth-first walk
intersects a node's bitset with postings for its children, and weighted popcounts count
members.  Only the nodes on a shard's first and last path can go on in another shard; they
are carried on inside a task and merged over tasks in rounds.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import cut

#: Sequences and turns of one shard at most (a longer sequence is a shard of its own).
SHARD_ROWS = 4096
SHARD_TURNS = 1 << 17
#: Conversation ids of one block of an end list.
BLOCK_BITS = 10
#: Task results that one task merges in a round.
FAN_IN = 64
SALTS = 32
#: Bytes of a turn's digest.
DIGEST = 16
SHARED_EVERY, SHARED_MOST = 20, 4

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
ROOT = bytes(DIGEST)
_NODE = "depth long, key binary, parent binary, conv_id long, n_convs long, words long, ends string, n_children long, n_leaves long, saved long"
NODE_SCHEMA = f"{_NODE}, closed boolean, was_open boolean, parent_conv_id long, first boolean, last boolean, part long"
_NAMES = [c.split(" ")[0] for c in NODE_SCHEMA.split(", ")]
DEPTH, KEY, PARENT, CONV, N, WORDS, ENDS, CHILDREN, LEAVES, SAVED = range(10)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<digest, words>>): one row per conversation, by turn, null first, ties by digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
                 F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).alias("x"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x")) \
        .select("conv_id", F.transform("x", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def shared_openings(ordered: DataFrame, every: int = SHARED_EVERY, most: int = SHARED_MOST) -> DataFrame:
    """Conversations whose first h turns come from the conversation at the last multiple of ``every``; h is crc32 of the id modulo ``most``."""
    donors = ordered.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, most - 1).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = ordered.withColumns({"donor": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(donors, "donor", "left")
    own = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return rows.select("conv_id", F.when(F.col("opening").isNull(), own).otherwise(F.concat(F.expr("slice(opening, 1, h)"), own)).alias("turns"))


def sequences(turns: DataFrame) -> DataFrame:
    """(path, words, n, conv_id, ends): each distinct sequence with its members' number, smallest id and hash of ids.

    Members are gathered in blocks of 2^BLOCK_BITS ids at most; the blocks of a sequence
    pass through one task in order, one at a time, because SHA-256 is sequential.
    """
    blocks = turns.select(F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.words").alias("words"), "conv_id") \
        .groupBy("path", F.shiftright("conv_id", BLOCK_BITS).alias("block")) \
        .agg(F.first("words").alias("words"), F.sort_array(F.collect_list("conv_id")).alias("ids"))

    def run(batches):
        path = None
        for batch in batches:
            out = []
            for p, words, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = ",".join(map(str, ids)).encode()
                if p == path:
                    sha.update(b"," + text)
                    n += len(ids)
                else:
                    if path is not None:
                        out.append((path, held, n, least, sha.hexdigest()))
                    path, held, n, least, sha = p, words, len(ids), ids[0], hashlib.sha256(text)
            yield made(out)
        if path is not None:
            yield made([(path, held, n, least, sha.hexdigest())])

    def made(rows):
        cols = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.int64()),
                                           pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())], ["path", "words", "n", "conv_id", "ends"])
    return blocks.repartition("path").sortWithinPartitions("path", "block").select("path", "words", "ids") \
        .mapInArrow(run, "path binary, words array<long>, n long, conv_id long, ends string")


def _keys(path: bytes) -> list[bytes]:
    """Key of every prefix of ``path``: a chain of 128-bit hashes over its turns."""
    out = [ROOT]
    for i in range(0, len(path), DIGEST):
        out.append(hashlib.blake2b(out[-1] + path[i: i + DIGEST], digest_size=DIGEST).digest())
    return out


def _bits(numbers) -> int:
    out = bytearray((max(numbers) >> 3) + 1)
    for i in numbers:
        out[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(out, "little")


def walk(rows: list[tuple]) -> list[list]:
    """Nodes of the trie of one shard's distinct sequences (path, words, n, conv_id, ends), parents first."""
    rows = sorted(rows, key=lambda r: r[3])                 # the lowest bit is the smallest member
    turns = [[p[i: i + DIGEST] for i in range(0, len(p), DIGEST)] for p, *_ in rows]
    holders: dict[tuple, list[int]] = {}
    for i, t in enumerate(turns):
        for d, x in enumerate(t):
            holders.setdefault((d, x), []).append(i)
        holders.setdefault((len(t), None), []).append(i)    # ends
    postings = {k: _bits(v) for k, v in holders.items()}
    weights = [r[2] for r in rows]
    planes = [_bits(on) for b in range(max(weights).bit_length()) if (on := [i for i, w in enumerate(weights) if w >> b & 1] or [len(rows)])]
    inside = (1 << len(rows)) - 1
    planes = [p & inside for p in planes]
    out, stack = [], [(inside, 0, ROOT, None)]
    while stack:
        bits, depth, key, parent = stack.pop()
        low = (bits & -bits).bit_length() - 1
        end = bits & postings.get((depth, None), 0)         # distinct sequences: one at most ends here
        out.append([depth, key, parent, rows[low][3], sum((bits & p).bit_count() << b for b, p in enumerate(planes)),
                    rows[low][1][depth - 1] if depth else 0, rows[end.bit_length() - 1][4] if end else None, 0, 0, 0])
        bits ^= end
        while bits:
            turn = turns[(bits & -bits).bit_length() - 1][depth]
            child = bits & postings[depth, turn]
            stack.append((child, depth + 1, hashlib.blake2b(key + turn, digest_size=DIGEST).digest(), key))
            bits ^= child
    return out


class Open:
    """Nodes that may still get members; parents of open nodes are open."""

    def __init__(self):
        self.nodes: dict[bytes, list] = {}
        self.carried: set[bytes] = set()

    def add(self, node: list) -> None:
        have = self.nodes.get(node[KEY])
        if have is None:
            self.nodes[node[KEY]] = list(node)
            return
        have[CONV] = min(have[CONV], node[CONV])
        have[ENDS] = have[ENDS] or node[ENDS]
        for i in (N, CHILDREN, LEAVES, SAVED):
            have[i] += node[i]

    def close(self, keep: set[bytes]) -> list[tuple]:
        """Rows of the nodes outside ``keep``, which are whole; their sums go to their parents."""
        done = sorted((x for x in self.nodes.values() if x[KEY] not in keep), key=lambda x: -x[DEPTH])
        rows = []
        for x in done:
            x[LEAVES] = x[LEAVES] if x[CHILDREN] else 1
            x[SAVED] += (x[N] - 1) * x[WORDS]
            above = self.nodes.get(x[PARENT]) if x[PARENT] is not None else None
            if above is not None:
                above[CHILDREN] += 1
                above[LEAVES] += x[LEAVES]
                above[SAVED] += x[SAVED]
            known = above[CONV] if above is not None and x[PARENT] not in keep else None
            rows.append((*x, True, x[KEY] in self.carried, known, False, False, None))
        for x in done:
            del self.nodes[x[KEY]]
        self.carried = set(self.nodes)
        return rows

    def left(self, first: set[bytes], last: set[bytes], part: int) -> list[tuple]:
        return [(*x, False, True, None, x[KEY] in first, x[KEY] in last, part) for x in self.nodes.values()]


_ARROW = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}[t])
                    for n, t in (c.split(" ") for c in NODE_SCHEMA.split(", "))])


def _batches(rows: list[tuple]):
    for i in range(0, len(rows), 1 << 16):
        cols = zip(*rows[i: i + (1 << 16)])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def _sharded(shard_rows: int):
    """Nodes of one range of sorted sequences: whole ones, and the open ones of its first and last path."""
    def run(batches):
        state, first, last, held, turns = Open(), None, None, [], 0

        def done():
            for node in walk(held):
                state.add(node)
            return state.close(first | last)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and (len(held) >= shard_rows or turns + len(row[1]) > SHARD_TURNS):
                    last = set(_keys(held[-1][0]))
                    yield from _batches(done())
                    held, turns = [], 0
                if first is None:
                    first = set(_keys(row[0]))
                held.append(row)
                turns += len(row[1])
        if held:
            last = set(_keys(held[-1][0]))
            yield from _batches(done())
            yield from _batches(state.left(first, last, TaskContext.get().partitionId()))
    return run


def _merged(final: bool, fan_in: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        state = Open()
        part = int(frame["part"].iloc[0]) // fan_in
        whose = frame["part"].to_numpy()
        rows = list(frame[_NAMES].itertuples(index=False, name=None))
        for r in rows:
            state.add([None if c is None or c != c else c for c in r[:10]])
        first = {r[KEY] for r in rows if r[13] and r[15] == whose.min()}
        last = {r[KEY] for r in rows if r[14] and r[15] == whose.max()}
        state.carried = set(state.nodes)
        out = state.close(set() if final else first | last) + state.left(first, last, part)
        return pd.DataFrame(out, columns=_NAMES, dtype=object)
    return run


def trie(turns: DataFrame, shard_rows: int = SHARD_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``turns`` (conv_id, turns array<struct<digest hex, words>>) has one row per
    conversation.  A node is a distinct sequence of first turns, named by its smallest
    member and its depth; the root has depth 0.  Turns are equal if their 128-bit digests
    are.  A conversation without turns is a member of the root alone; an empty table has
    no node at all.
    """
    seqs = cut(sequences(turns), "trie-sequences")
    ranged = seqs.repartitionByRange("path").sortWithinPartitions("path")
    made = [cut(ranged.mapInArrow(_sharded(shard_rows), NODE_SCHEMA), "trie-nodes")]
    while True:
        parts = made[-1].where("NOT closed").agg(F.min("part"), F.max("part")).first()
        if parts[0] is None:
            break
        final = parts[0] // fan_in == parts[1] // fan_in
        made.append(cut(made[-1].where("NOT closed").withColumn("group", F.expr(f"part div {fan_in}")).groupBy("group")
                        .applyInPandas(_merged(final, fan_in), NODE_SCHEMA), "trie-open"))
        if final:
            break
    nodes = made[0].where("closed")
    for more in made[1:]:
        nodes = nodes.union(more.where("closed"))
    # Nodes below an open node learn its smallest member now; a node with many children is salted.
    above = nodes.where("was_open").select(F.col("key").alias("parent"), F.col("conv_id").alias("above"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt: Column = F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int")
    under = nodes.where("parent_conv_id IS NULL AND depth > 0").withColumn("salt", salt).join(above, ["parent", "salt"], "left")
    columns = lambda parent: ["conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                              F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256")]
    return nodes.where("parent_conv_id IS NOT NULL OR depth = 0").select(*columns(F.col("parent_conv_id"))).union(under.select(*columns(F.col("above"))))


def conversation_trie(conversations: DataFrame, **options) -> DataFrame:
    """``trie`` of ``conversations`` (conv_id, turn, role, text) with shared openings.

    Null roles and texts are empty, a null turn comes first, turns of equal number are
    ordered by their digests, rows without conv_id belong to no conversation, repeated
    rows are turns of their own, other columns are ignored.
    """
    return trie(cut(shared_openings(cut(ordered_turns(conversations), "trie-turns")), "trie-rebuilt"), **options)


#: The same in DuckDB; crc32 by its bits.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS ds, list(words ORDER BY turn NULLS FIRST, digest) AS ws FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, ds, ws, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
           lambda c: list_prepend(ascii(c)::BIGINT, list_transform(range(8), lambda i: -1::BIGINT))))),
         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT) % 4 AS h
  FROM own),
reb AS (
  SELECT c.conv_id, list_concat(coalesce(d.ds, [])[1: h], c.ds[h + 1:]) AS ds, list_concat(coalesce(d.ws, [])[1: h], c.ws[h + 1:]) AS ws
  FROM crc c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 20),
pre AS (SELECT conv_id, len(ds) AS n, d, ds[1: d] AS p, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS d FROM reb)),
node AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(w) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM pre GROUP BY d, p),
mem AS (SELECT pre.conv_id AS member, pre.d, node.conv_id AS node_conv FROM pre JOIN node ON node.d = pre.d AND node.p = pre.p),
named AS (SELECT node.*, mem.node_conv AS parent_conv_id FROM node LEFT JOIN mem ON mem.member = node.conv_id AND mem.d = node.d - 1),
kids AS (SELECT parent_conv_id, d - 1 AS d, count(*) AS n_children FROM named WHERE d > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM named n LEFT JOIN kids k ON k.parent_conv_id = n.conv_id AND k.d = n.d),
sub AS (
  SELECT mem.node_conv AS conv_id, mem.d, sum(c.saved)::BIGINT AS saved_tokens, (count(*) FILTER (c.n_children = 0))::BIGINT AS n_leaves
  FROM counted c JOIN mem ON mem.member = c.conv_id AND mem.d <= c.d GROUP BY ALL)
SELECT c.conv_id, c.d AS depth, c.parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN sub s ON s.conv_id = c.conv_id AND s.d = c.d
"""

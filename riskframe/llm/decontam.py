"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items.

Symbols are words.  For the windows of one length ``m``, blocks are pairs of words (one
word where ``m`` is 1).  The shift table holds, for every block of any window, how far its
last occurrence lies from the window's end; a block of no window allows a shift of
``m - 1`` words.  A shift of zero leads to the bucket of windows that end in the block,
and comparing all words confirms an occurrence.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import cut, texts

WINDOW = 10
#: UTF-8 bytes of distinct windows that one pass over the documents carries to its tasks.
PASS_BYTES = 8 << 20

#: Bytes 0-9, a-z and all from 0x80 are word bytes, A-Z are lower-cased, the rest separate.
_WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
              for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of the whole text: maximal runs of digits, letters and non-ASCII, A-Z lowered."""
    return text.translate(_WORD).split()


def windows_of(text: bytes, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` consecutive words; a shorter, non-empty item is one window."""
    words = words_of(text)
    if not words:
        return []
    if len(words) < size:
        return [tuple(words)]
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]


class WuManber:
    """Shift table and suffix buckets of windows of one length."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.m, self.block = m, min(2, m)
        self.safe = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, m + 1):
                key = words[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.safe), m - end)
            self.bucket[words[m - self.block:]].append((words, items))

    def find(self, words: list[bytes]):
        """(start, item ids) of every occurrence of a window in ``words``."""
        m, block, safe, shift, n = self.m, self.block, self.safe, self.shift, len(words)
        at = m
        while at <= n:
            key = tuple(words[at - block:at])
            step = shift.get(key, safe)
            if step:
                at += step
                continue
            for pattern, items in self.bucket[key]:
                if words[at - m] == pattern[0] and tuple(words[at - m:at]) == pattern:
                    yield at - m, items
            at += 1


def build(rows: list[tuple[bytes, list[int]]]) -> list[WuManber]:
    """One searcher per window length; ``rows`` are (words joined by a space, item numbers)."""
    by_length: dict[int, dict] = defaultdict(dict)
    for joined, items in rows:
        words = tuple(joined.split(b" "))
        by_length[len(words)][words] = items
    return [WuManber(m, patterns) for m, patterns in sorted(by_length.items())]


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows (window binary, items array<string>) of the benchmark's whole texts."""
    def run(batches):
        for batch in batches:
            ids, wins = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for w in set(windows_of(text, size)):
                    ids.append(item)
                    wins.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.binary())], ["item", "window"])
    items = texts(benchmark, "item_id").select(F.col("doc_id").cast("string"), "text")
    return items.mapInArrow(run, "item string, window binary") \
        .groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _passes(benchmark: DataFrame, size: int, pass_bytes: int) -> list[DataFrame]:
    """The windows in parts whose bytes are within ``pass_bytes``, checked by a count first."""
    wins = windows(benchmark, size)
    total = wins.agg(F.sum(F.length("window") + F.length(F.concat_ws(",", "items")) + F.lit(64))).first()[0] or 0
    n = 1 + total * 2 // pass_bytes if total > pass_bytes else 1
    return [wins.where(F.pmod(F.xxhash64("window"), F.lit(n)) == i) for i in range(n)]


def _scan(docs: DataFrame, searchers: list[WuManber], text: bool) -> DataFrame:
    """One pass over (doc_id, text) and, from earlier passes, (hits, items); ``text`` keeps the text."""
    shared = docs.sparkSession.sparkContext.broadcast(searchers)
    earlier = "hits" in docs.columns
    fields = [("doc_id", pa.int64())] + [("text", pa.string())] * text + [
        ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]

    def run(batches):
        tables = shared.value
        for batch in batches:
            n_words, hits, items = [], [], []
            bodies = batch.column("text").cast(pa.binary()).to_pylist()
            old_hits = batch.column("hits").to_pylist() if earlier else [()] * len(bodies)
            old_items = batch.column("items").to_pylist() if earlier else [()] * len(bodies)
            for body, old, names in zip(bodies, old_hits, old_items):
                words = words_of(body)
                found, starts = set(names), set()
                for table in tables:
                    for at, ids in table.find(words):
                        found.update(ids)
                        starts.add((at, table.m))
                covered, reach = [], 0
                for at, m in sorted(starts):
                    covered.extend(range(max(at, reach), at + m))
                    reach = max(reach, at + m)
                n_words.append(len(words))
                hits.append(sorted({*covered, *old}) if old else covered)
                items.append(sorted(found))
            columns = [batch.column("doc_id")] + [batch.column("text").cast(pa.string())] * text
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                 pa.array(items, pa.list_(pa.string()))], schema=pa.schema(fields))
    return docs.mapInArrow(run, "doc_id long, " + "text string, " * text
                           + "n_words long, hits array<int>, items array<string>")


def search(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, n_words, hits, items) of every document row.

    ``hits`` are the positions of words inside any occurrence of a window, ``items`` the
    sorted ids (as strings) of items with an occurring window.  The windows reach the
    tasks in parts of checked size: a larger benchmark takes more passes of the same
    narrow kind, without a shuffle.  Null and empty texts have no words; items without
    words have no window; windows that repeat within or across items count once per item;
    repeated document rows each get a row; items with a null id hit words but are not
    listed.  Other columns are ignored; empty tables give no rows or no hits.
    """
    found = texts(docs)
    parts = _passes(benchmark, size, pass_bytes)
    for i, part in enumerate(parts):
        rows = [(bytes(r.window), list(r["items"])) for r in part.collect()]
        last = i == len(parts) - 1
        found = _scan(found, build(rows), text=not last)
        if not last:
            found = cut(found, "decontam-pass")
    return found


def digest(found: DataFrame) -> DataFrame:
    """Counts and the hash of the item list for every searched document."""
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, pass_bytes: int = PASS_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, all columns kept, in passes without a shuffle."""
    at = docs.columns.index(text_col)

    def without(shared):
        def run(batches):
            for batch in batches:
                bodies = (words_of(t) for t in batch.column(at).fill_null("").cast(pa.binary()).to_pylist())
                yield batch.filter(pa.array([not any(True for t in shared.value for _ in t.find(w)) for w in bodies], pa.bool_()))
        return run
    for part in _passes(benchmark, size, pass_bytes):
        rows = [(bytes(r.window), list(r["items"])) for r in part.collect()]
        docs = docs.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(build(rows))), docs.schema)
    return docs


#: DuckDB text of the query: both sides by windows of 10 words, exact join, union of ranges.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     ms AS (SELECT DISTINCT m FROM bw),
     dw AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
            FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
     hit AS (SELECT rid, dw.m, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
     pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY rid),
     its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS lst
             FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(lst, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""

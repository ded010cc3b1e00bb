"""Phrase collocations by streaming estimation: counted phrases in prefix and in suffix order.

Phrases are counted order by order; an order is counted only where both of its shorter
phrases can be frequent.  The counts of one order then stand in prefix order beside those
of the order below, and in suffix order beside the same, and sorted merges of the streams
give every phrase the counts of all its first parts, of all its last parts, and of the
phrases that extend it by a word on either side.  No table of counts is looked up by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import cut

LONGEST = 5
LEAST = 100
TOP = 2000
#: The bitmap of phrases that may be frequent has 2^27 bits, 16 MB, at any corpus size.
BITMAP_BITS = 27
#: Bytes that a task holds before it sends its counts on, and bytes that it looks at in one step.
FLUSH = 8 << 20
SLICE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A-Z lower-cased, piece ends become \n, tabs become blanks.
_CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x0A if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


_LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _extend(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(left * _ODD + word)


def _slices(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of about SLICE bytes, cut at ends of pieces only."""
    at = 0
    while at < len(text):
        end = text.find(b"\n", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _scan(part: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop, number of the piece and 64-bit hash of every word of a cleaned text that ends with a blank or \\n."""
    data = np.frombuffer(part, np.uint8)
    cut_ = data == 0x0A
    gap = cut_ | (data == 0x20)
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return start, start, start, np.empty(0, np.uint64)
    n = stop - start
    inside = np.flatnonzero(~gap)
    first = np.cumsum(n) - n
    power = np.cumprod(np.full(int(n.max()), 0x100000001B3, np.uint64))
    h = np.add.reduceat(_LETTER[data[inside]] * power[np.arange(len(inside)) - np.repeat(first, n)], first)
    return start, stop, np.cumsum(cut_)[start], _mix(h)


def _distinct(data: np.ndarray, start: np.ndarray, stop: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of the words, equal for equal words only: words of equal hash are compared byte by byte."""
    code, _ = pd.factorize(h)
    first = np.empty(len(h), np.int64)
    first[code[::-1]] = np.arange(len(h))[::-1]
    rep, n = first[code], stop - start
    same = np.array_equal(n, n[rep])
    for at in range(0, len(h) if same else 0, 1 << 17):
        some = slice(at, at + (1 << 17))
        k = n[some]
        step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        if not np.array_equal(data[np.repeat(start[some], k) + step], data[np.repeat(start[rep[some]], k) + step]):
            same = False
            break
    if not same:
        code, _ = pd.factorize(np.array([data[s:e].tobytes() for s, e in zip(start, stop)], object))
    return code


def _seen(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class _Held:
    """Cleaned texts of one task by language."""

    def __init__(self, order: int, bitmap: np.ndarray | None):
        self.order, self.bitmap = order, bitmap
        self.clear()

    def clear(self) -> None:
        self.parts, self.size = {}, 0

    def add(self, lang: str, text: bytes) -> None:
        for part in _slices(text.translate(_CLEAN)):
            self.parts.setdefault(lang, []).append(part + b"\n")
            self.size += len(part) + 1

    def counted(self) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        """(lang, phrases, counts) of the order's phrases that can be frequent; for words also the number of all words, under no name."""
        for lang, parts in self.parts.items():
            yield lang, *self._count(lang, parts)

    def _count(self, lang: str, parts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        order, found, at, piece = self.order, [], 0, 0
        steps = _joined(parts)
        whole = b"".join(steps)
        for step in steps:
            start, stop, pieces, h = _scan(step)
            found.append((start + at, stop + at, pieces + piece, h))
            at, piece = at + len(step), piece + step.count(b"\n")
        start, stop, pieces, h = (np.concatenate(x) for x in zip(*found))
        data = np.frombuffer(whole, np.uint8)
        if order == 1:
            id_ = _distinct(data, start, stop, h)
            count = np.bincount(id_)
            first = np.empty(len(count), np.int64)
            first[id_[::-1]] = np.arange(len(id_))[::-1]
            return [b"", *[whole[s:e] for s, e in zip(start[first].tolist(), stop[first].tolist())]], np.append(len(id_), count)
        n = len(h) - order + 1
        if n < 1:
            return [], np.empty(0, np.int64)
        # Hashes of the phrases one word shorter; a phrase counts where both of its own can be frequent.
        shorter = _mix(h ^ np.uint64(xxhash.xxh64_intdigest(lang)))
        for i in range(1, order - 1):
            shorter = _extend(shorter[:-1], h[i:])
        seen = _seen(self.bitmap, shorter)
        at = np.flatnonzero(seen[:n] & seen[1: n + 1] & (pieces[:n] == pieces[order - 1:]))
        if not len(at):
            return [], np.empty(0, np.int64)
        used = np.zeros(len(h), bool)
        for i in range(order):
            used[at + i] = True
        used = np.flatnonzero(used)
        id_ = np.zeros(len(h), np.int64)
        id_[used] = _distinct(data, start[used], stop[used], h[used])
        key = id_[at]
        for i in range(1, order):
            key, _ = pd.factorize(key * len(used) + id_[at + i])
        count = np.bincount(key)
        first = np.empty(len(count), np.int64)
        first[key[::-1]] = at[::-1]
        last = first + order - 1
        names = [whole[s:e] for s, e in zip(start[first].tolist(), stop[last].tolist())]
        length = sum(stop[first + i] - start[first + i] for i in range(order)) + order - 1
        for i in np.flatnonzero(stop[last] - start[first] != length).tolist():
            names[i] = b" ".join(names[i].split())          # more than one blank between words
        return names, count


def _joined(parts: list[bytes]) -> list[bytes]:
    """``parts`` put together to about SLICE bytes each."""
    out, held, size = [], [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= SLICE:
            out.append(b"".join(held))
            held, size = [], 0
    return out + [b"".join(held)] if held else out


def _counts(docs: DataFrame, order: int, shared) -> DataFrame:
    """(lang, phrase, f): counts over all of ``docs`` (lang, text) of the phrases of one order."""
    def run(batches):
        held = _Held(order, None if shared is None else np.frombuffer(shared.value, np.uint8))

        def flushed():
            for lang, names, count in held.counted():
                for i in range(0, len(names), 1 << 16):
                    some = names[i: i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()),
                                                      pa.array(count[i: i + (1 << 16)], pa.int64())], ["lang", "phrase", "f"])
            held.clear()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                held.add(lang, text.as_py())
                if held.size > FLUSH:
                    yield from flushed()
        yield from flushed()
    return docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bitmap(phrases: DataFrame) -> bytes:
    """Bits of the hashes of ``phrases`` (lang, phrase): 16 MB whatever their number, the driver gets words of 64 bits."""
    def run(batches):
        for batch in batches:
            _, _, piece, h = _scan(b"\n".join(batch.column(1).cast(pa.binary()).to_pylist()) + b"\n")
            seeds = np.array([xxhash.xxh64_intdigest(x) for x in batch.column(0).to_pylist()], np.uint64)
            first = np.searchsorted(piece, np.arange(batch.num_rows))
            size = np.diff(first, append=len(piece))
            out = _mix(h[first] ^ seeds)
            for i in range(1, int(size.max(initial=1))):
                more = np.flatnonzero(size > i)
                out[more] = _extend(out[more], h[first[more] + i])
            yield pa.RecordBatch.from_arrays([pa.array((out >> np.uint64(64 - BITMAP_BITS)).astype(np.int64))], ["bit"])
    words = phrases.mapInArrow(run, "bit long").groupBy(F.expr("bit div 64").alias("at")) \
        .agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(1 << BITMAP_BITS - 6, np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Per order, (lang, phrase, f) of the phrases with f >= ``least``; and (lang, n), all words of a language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    orders, shared = [], None
    for order in range(1, longest + 1):
        found = cut(_counts(rows, order, shared).where((F.col("f") >= least) | (F.col("phrase") == "")), f"phrases-{order}")
        orders.append(found.where("phrase <> ''"))
        if order == 1:
            totals = found.where("phrase = ''").select("lang", F.col("f").alias("n"))
        if shared is not None:
            shared.unpersist()
        if order < longest:
            shared = spark.sparkContext.broadcast(_bitmap(orders[-1]))
    return orders, totals


def _prefix(phrase: str = "phrase") -> Column:
    return F.regexp_extract(phrase, r"^([\s\S]*) [^ ]*$", 1)


def _suffix(phrase: str = "phrase") -> Column:
    return F.expr(f"substring({phrase}, instr({phrase}, ' ') + 1)")


def _beside(orders: list[DataFrame], side: str, part: Column, grow) -> tuple[DataFrame, DataFrame]:
    """One pass over the orders in the order of ``part``, the phrase less one word.

    Gives (lang, phrase, f, parts) of all phrases of two words or more, ``parts`` with the
    counts of all shorter parts on that side, and (lang, phrase) of those that an
    extension by one word on the other side equals in count.
    """
    none = F.array().cast("array<bigint>")
    below = orders[0].select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"), none.alias("part_parts"))
    streams, equalled = [], []
    for rows in orders[1:]:
        both = cut(rows.withColumn("part", part).join(below.hint("merge"), ["lang", "part"]), f"phrases-{side}")
        equalled.append(both.where("f = part_f").select("lang", F.col("part").alias("phrase")))
        stream = both.select("lang", "phrase", "f", grow(F.col("part_parts"), F.array("part_f")).alias("parts"))
        streams.append(stream)
        below = stream.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"), F.col("parts").alias("part_parts"))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return union(streams), union(equalled).distinct()


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of ``docs`` (lang, text).

    Null texts are empty, a null language is ``und``; repeated rows count as often as they
    stand there; very long texts are counted whole; ties in score go to the larger count,
    then to the phrase that is smaller in UTF-8 byte order; other columns are ignored; an
    empty table, or one without a phrase of ``least`` occurrences, gives no rows.
    A phrase longer by two words or more that equals a phrase in count has one between
    them that does too, so extensions by one word decide on all.
    """
    orders, totals = frequent(docs, least, longest)
    first, right = _beside(orders, "prefix", _prefix(), lambda parts, f: F.concat(parts, f))
    last, left = _beside(orders, "suffix", _suffix(), lambda parts, f: F.concat(f, parts))
    both = first.select("lang", "phrase", F.col("f").alias("a"), F.col("parts").alias("ls")) \
        .join(last.select("lang", "phrase", F.col("parts").alias("rs")).hint("merge"), ["lang", "phrase"])
    kept = both.join(right.union(left).distinct().hint("merge"), ["lang", "phrase"], "left_anti").join(totals, "lang")
    exact = lambda c: c.cast("decimal(19,0)")
    cuts = F.transform(F.arrays_zip("ls", "rs"), lambda x, k: F.struct(
        F.call_function("div", exact(F.lit(1000)) * exact(F.col("a")) * exact(F.col("n")), exact(x["ls"]) * exact(x["rs"])).cast("long").alias("score"),
        k.alias("k"), x["ls"].alias("l"), x["rs"].alias("r")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("cut", F.array_min(cuts)) \
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score") \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same over the table in DuckDB: words numbered within pieces, phrases by lead().
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT coalesce(lang, 'und') AS lang,
           list_filter(regexp_split_to_array(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                        '[.,;:!?\x0A-\x0D]')), '[\x20\x09]'), lambda w: w <> '') AS words
    FROM documents) WHERE len(words) > 0),
grams AS (
  SELECT lang, k, words[i: i + k - 1] AS p FROM (
    SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE k <= len(words))),
counts AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY lang, k, p HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
parts AS (SELECT lang, k, p, f, unnest(range(1, k)) AS c FROM counts WHERE k > 1),
scored AS (
  SELECT s.lang, s.p, s.f AS a, s.c, x.f AS l, y.f AS r, n, ((1000::HUGEINT * s.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM parts s JOIN counts x ON x.lang = s.lang AND x.p = s.p[1: s.c] JOIN counts y ON y.lang = s.lang AND y.p = s.p[s.c + 1:]
  JOIN totals t ON t.lang = s.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
inner_parts AS (
  SELECT lang, f, p[i: i + m - 1] AS p FROM (
    SELECT lang, p, f, k, m, unnest(range(1, k - m + 2)) AS i FROM counts, (SELECT unnest([2, 3, 4]) AS m) WHERE m < k)),
dropped AS (SELECT DISTINCT i.lang, i.p FROM inner_parts i JOIN counts c ON c.lang = i.lang AND c.p = i.p WHERE 100 * i.f >= 100 * c.f),
named AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM best WHERE (lang, p) NOT IN (SELECT (lang, p) FROM dropped))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM named) WHERE rank <= 2000
"""

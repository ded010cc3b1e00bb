"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in parallel.  A chunk of neighbouring documents keeps, for each
document, the positions of its words in the chunk's own word list; the lists meet by word,
every distinct word is encoded once, its ids are joined to the id-to-piece table, and both
go back to the chunks by position.  Only word numbers and distinct words are shuffled.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import shuffle_width, texts

#: Characters of text in one chunk; a longer document is a chunk of its own.
CHUNK_CHARS = 48_000_000
#: Bytes of the tokenizer file that tasks may be sent.
TOKENIZER_BYTES = 64 << 20

#: Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Beyond these ranges the ``regex`` module knows newer letters than the tokenizer does,
#: and the tokenizer's own splitter is used.
_RARE = regex.compile("[^\\x00-՗‐-⁯₠-₿　-ヿ一-龥가-힣]")

#: Beyond these characters a text needs the ``regex`` module; for all others the same pattern is written out in plain
#: character classes, which the standard module matches in less than half the time.
_UNCOMMON = re.compile("[^\\x00-\u024f\u2010-\u2027]")


def _common_pattern() -> str:
    """PATTERN for texts without uncommon characters."""
    chars = [chr(c) for c in range(0x250)]
    kind = lambda k: "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == k)
    letter, number, space = kind("L"), kind("N"), "\t-\r \x85\xa0"
    return (f" ?[{letter}]++| ?[{number}]++|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{number}]++|[{space}]+(?![^{space}])|[{space}]+")


def read_tokenizer(path: str) -> str:
    """The tokenizer file's text without truncation and padding; it may not exceed the bound."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["truncation"] = spec["padding"] = None
    text = json.dumps(spec)
    if len(text) > TOKENIZER_BYTES:
        raise ValueError(f"tokenizer file over {TOKENIZER_BYTES} bytes")
    return text


def _tokenizer(spec: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_str(spec)


class Splitter:
    """Words of a text as the tokenizer splits it; added tokens are words of their own."""

    def __init__(self, spec: str):
        tok = _tokenizer(spec)
        own = json.loads(spec)["pre_tokenizer"]
        if own["type"] != "ByteLevel" or own["add_prefix_space"] or not own["use_regex"] or tok.normalizer is not None:
            raise ValueError("only byte-level tokenizers without normalizer are split here")
        self.find = regex.compile(PATTERN).findall
        self.find_common = re.compile(_common_pattern()).findall
        self.slow = tok.pre_tokenizer
        added = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = set(added)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or _UNCOMMON.search(text) is None:
            return self.find_common(text)
        if _RARE.search(text) is None:
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.slow.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(t in text for t in self.added):
            return self._plain(text)
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(part)
            elif part:
                out.extend(self._plain(part))
        return out


def piece_table(tok) -> dict[int, bytes]:
    """id -> bytes of every piece: the byte alphabet maps each printable character to a byte."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    char = {chr(b): b for b in keep}
    char |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(keep))}
    return {i: bytes(char[c] for c in piece) if all(c in char for c in piece) else piece.encode()
            for piece, i in tok.get_vocab(with_added_tokens=True).items()}


def pack(values: np.ndarray) -> bytes:
    """Non-negative numbers as bytes of seven bits, low bits first; the high bit says that more follow."""
    return _packed(values)[0]


def pack_all(lists: list[np.ndarray]) -> list[bytes]:
    """``pack`` of every list, all at once."""
    data, ends = _packed(np.concatenate(lists))
    edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum([len(x) for x in lists])))].tolist()
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The packed numbers and the end of each."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for j in range(5):
        has = size > j
        if not has.any():
            break
        out[start[has] + j] = (values[has] >> 7 * j) & 127 | (size[has] > j + 1) << 7
    return out.tobytes(), start + size


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    start = np.concatenate(([0], np.flatnonzero(raw < 128)[:-1] + 1))
    count = np.diff(np.concatenate((start, [len(raw)])))
    place = np.arange(len(raw)) - np.repeat(start, count)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, start)


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _by_count(counts: np.ndarray) -> np.ndarray:
    """New number of each word: frequent words first, so that most places take one byte."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return rank


def _mark(words, rank: np.ndarray) -> int:
    """Digest of a chunk's word list in order, with the numbers: equal for both readings of the same rows."""
    digest = xxhash.xxh64("\0".join(words).encode("utf-8", "replace"))
    digest.update(rank.tobytes())
    return digest.intdigest() - (1 << 63)


def _walk(docs: DataFrame, schema: str, shared, chunk_chars: int, start, add, close) -> DataFrame:
    """Walk every partition's texts in chunks of about ``chunk_chars``; ``close`` yields a chunk's batches."""
    def run(batches):
        split = Splitter(shared.value)
        state, chars, part, seq = start(), 0, 0, 0
        for batch in batches:
            for doc, text, part in zip(*(c.to_pylist() for c in batch.columns)):
                if chars and chars + len(text) > chunk_chars:
                    yield from close(state, (part << 32) + seq)
                    state, chars, seq = start(), 0, seq + 1
                add(state, doc, split(text))
                chars += len(text)
        yield from close(state, (part << 32) + seq)

    return docs.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, schema)


def _places(docs: DataFrame, shared, chunk_chars: int) -> DataFrame:
    """(chunk, size, mark, doc_id, at): every document's word numbers, packed; ``size`` counts the chunk's words, ``mark`` is their digest."""
    def add(state, doc, words):
        numbers, ids, at = state
        ids.append(doc)
        at.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))

    def close(state, chunk):
        numbers, ids, at = state
        if not ids:
            return
        rank = _by_count(np.bincount(np.concatenate(at), minlength=len(numbers)))
        mark = _mark(numbers, rank)
        for i in range(0, len(ids), 500):
            n = len(ids[i:i + 500])
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array([len(numbers)] * n, pa.int32()), pa.array([mark] * n, pa.int64()),
                                              pa.array(ids[i:i + 500], pa.int64()), pa.array(pack_all([rank[a] for a in at[i:i + 500]]), pa.binary())],
                                             ["chunk", "size", "mark", "doc_id", "at"])

    return _walk(docs, "chunk long, size int, mark long, doc_id long, at binary", shared, chunk_chars, lambda: (_Numbers(), [], []), add, close)


def _words(docs: DataFrame, shared, chunk_chars: int, buckets: int) -> DataFrame:
    """(chunk, size, mark, bucket, word[], at): the chunk's distinct words by hash bucket, with their numbers."""
    def close(state, chunk):
        if not state:
            return
        rank = _by_count(np.fromiter(state.values(), np.int64, len(state)))
        mark = _mark(state, rank)
        by_bucket = defaultdict(lambda: ([], []))
        digest = xxhash.xxh32_intdigest
        for word, number in zip(state, rank.tolist()):
            words, places = by_bucket[digest(word.encode("utf-8", "replace")) % buckets]
            words.append(word)
            places.append(number)
        for bucket, (words, places) in by_bucket.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([len(state)], pa.int32()), pa.array([mark], pa.int64()), pa.array([bucket], pa.int32()),
                                              pa.array([words], pa.list_(pa.string())), pa.array([pack(np.array(places))], pa.binary())],
                                             ["chunk", "size", "mark", "bucket", "word", "at"])

    return _walk(docs, "chunk long, size int, mark long, bucket int, word array<string>, at binary", shared, chunk_chars,
                 Counter, lambda state, doc, words: state.update(words), close)


def _encode_words(words: DataFrame, shared) -> DataFrame:
    """Per bucket: every distinct word once through the tokenizer; its ids go back to each chunk."""
    def run(batches):
        tok = _tokenizer(shared.value)
        known: dict[str, list[int]] = {}
        now = None
        for batch in batches:
            for chunk, size, mark, bucket, word, at in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    known, now = {}, bucket
                new = [w for w in word if w not in known]
                known.update((w, e.ids) for w, e in zip(new, tok.encode_batch_fast(new, add_special_tokens=False)))
                got = [known[w] for w in word]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([size], pa.int32()), pa.array([mark], pa.int64()), pa.array([at], pa.binary()),
                     pa.array([pack(np.fromiter(map(len, got), np.int64, len(got)))], pa.binary()),
                     pa.array([pack(np.array([x for i in got for x in i], np.int64))], pa.binary())], ["chunk", "size", "mark", "at", "n", "ids"])

    return words.repartition("bucket").sortWithinPartitions("bucket") \
        .mapInArrow(run, "chunk long, size int, mark long, at binary, n binary, ids binary")


def _ragged(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of flat[start : start + count] over all rows."""
    ends = np.cumsum(count)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(start - ends + count, count)]


class _Lists:
    """A chunk's word list: the ids of the word with each number."""

    def __init__(self, size: int, mark: int):
        self.size, self.mark, self.seen, self.held = size, mark, 0, 0
        self.n, self.start, self.ids = np.zeros(size, np.int64), np.zeros(size, np.int64), []

    def add(self, at, n, ids):
        self.n[at] = n
        self.start[at] = self.held + np.cumsum(n) - n
        self.ids.append(ids.astype(np.int32))
        self.held += len(ids)
        self.seen += len(at)

    def close(self):
        if self.seen != self.size:
            raise RuntimeError("a chunk and its word list differ: the input gave other rows when it was read again")
        self.ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.int32)


class _Pieces:
    """The id-to-piece table as flat bytes, joined to ids by position."""

    def __init__(self, tok):
        table = piece_table(tok)
        pieces = [table.get(i, b"") for i in range(max(table) + 1)]
        self.n = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        return _ragged(self.bytes, self.start[ids], self.n[ids]).tobytes().decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer_path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row of ``docs`` (doc_id, text).

    ``ids`` are those of the tokenizers library without special tokens added, ``decoded``
    is the text of those ids.  Null is the empty text, with no ids; repeated rows each get
    a row, null doc_ids stay; other columns are ignored; an empty table gives no rows.
    ``docs`` must give the same rows in the same order when read twice, as a scan of a
    table does; if it does not, the job fails instead of joining wrong positions: both
    readings of a chunk carry a digest of its word list in order.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    rows = texts(docs)
    none = F.lit(None)
    lists = _encode_words(_words(rows, shared, chunk_chars, 2 * shuffle_width(spark)), shared) \
        .select("chunk", F.lit(0).alias("kind"), "size", "mark", none.cast("long").alias("doc_id"), "at", "n", "ids")
    places = _places(rows, shared, chunk_chars) \
        .select("chunk", F.lit(1).alias("kind"), "size", "mark", "doc_id", "at", none.cast("binary").alias("n"), none.cast("binary").alias("ids"))

    def run(batches):
        pieces, now, table = _Pieces(_tokenizer(shared.value)), None, None
        for batch in batches:
            doc, ids, text, weight = [], [], [], 0
            for chunk, kind, size, mark, doc_id, at, n, word_ids in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != now:
                    now, table = chunk, _Lists(size if kind == 0 else 0, mark)
                if kind == 0 and mark == table.mark:
                    table.add(unpack(at), unpack(n), unpack(word_ids))
                    continue
                if (size, mark) != (table.size, table.mark):
                    raise RuntimeError("a chunk and its word list differ: the input gave other rows when it was read again")
                if isinstance(table.ids, list):
                    table.close()
                number = unpack(at)
                doc.append(doc_id)
                ids.append(_ragged(table.ids, table.start[number], table.n[number]))
                text.append(pieces.decode(ids[-1]))
                weight += len(text[-1]) + 4 * len(ids[-1])
                if weight > 4 << 20:
                    yield _out(doc, ids, text)
                    doc, ids, text, weight = [], [], [], 0
            yield _out(doc, ids, text)

    return lists.unionByName(places).repartition("chunk").sortWithinPartitions("chunk", "kind") \
        .mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _out(doc, ids, text) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())],
                                      ["doc_id", "ids", "decoded"])


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

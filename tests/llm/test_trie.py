import hashlib
import random
import re
import zlib

import pytest

from riskframe.llm import trie


def brute(rows):
    """The contract with Python tuples: every prefix of every rebuilt conversation in one dictionary."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + t[h:])
    members, ends = {}, {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
        ends.setdefault(t, []).append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        listed = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids), len(leaves),
                    sum((len(members[x]) - 1) * words(x) for x in below), hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def fixture(seed, n):
    rng = random.Random(seed)
    texts = ["hi", "hello there", None, "", "a  b\tc", "ok", "É é"]
    rows = []
    for c in rng.sample(range(-45, 400), n):
        for k in range(rng.choice([1, 1, 2, 3, 4, 9])):
            rows.append((c, rng.choice([k, k, k, None, 2]), rng.choice(["user", "user", "bot", None]), rng.choice(texts[:3] if k < 2 else texts)))
    rows += [(c, k, "user", f"t{k} same") for c in range(1000, 1120) for k in range(5)]         # one very common conversation
    rows += [(2000, k, "user", "long") for k in range(300)] + [(None, 0, "user", "nobody")] + rows[:3]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_matches_brute_force_over_shards_and_rounds(spark, many_partitions):
    rows = fixture(2, 90)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for options in ({}, {"shard_rows": 3, "fan_in": 2}):
        got = trie.conversation_trie(df, **options).collect()
        assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == want


def test_walk_gives_weighted_popcounts():
    d = lambda *x: b"".join(bytes([i]) * 16 for i in x)
    rows = [(d(1, 2), [3, 4], 5, 20, "e1"), (d(1), [3], 2, 7, "e2"), (d(1, 3), [3, 1], 6, 9, "e3"), (b"", [], 1, 30, "e4")]
    got = sorted((x[trie.DEPTH], x[trie.CONV], x[trie.N], x[trie.WORDS], x[trie.ENDS]) for x in trie.walk(rows))
    assert got == [(0, 7, 14, 0, "e4"), (1, 7, 13, 3, "e2"), (2, 9, 6, 1, "e3"), (2, 20, 5, 4, "e1")]


def test_ends_over_blocks(spark):
    """Ids of one sequence in several blocks, also below zero, are hashed in numeric order."""
    ids = [-3000, -5, -1, 0, 3, 1023, 1024, 5000, 10_000]
    df = spark.createDataFrame([(i, [("00" * 16, 2)]) for i in ids], "conv_id long, turns array<struct<digest: string, words: long>>")
    rows = trie.trie(df).collect()
    assert sorted((r.depth, r.conv_id, r.n_convs, r.saved_tokens) for r in rows) == [(0, -3000, 9, 16), (1, -3000, 9, 16)]
    assert {r.ends_sha256 for r in rows} == {trie.EMPTY_SHA, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()}


def test_empty_turnless_and_clashing(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    # crc32("1") % 4 == 3: without its donor the only turn goes, and the conversation is turnless.
    df = spark.createDataFrame([(1, 0, "user", "x", 5, "k")], SCHEMA + ", depth long, digest string")
    assert [tuple(r)[:7] for r in trie.conversation_trie(df).collect()] == [(1, 0, None, 1, 0, 1, 0)]

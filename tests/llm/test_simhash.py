import random

import xxhash

from riskframe.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ")
             .replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, bits=3):
    ids = list(range(len(fps)))
    root = ids[:]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in ids:
        for j in ids[:i]:
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "Béta", "gam ma", "d", "É", "eps", "zz", "1"]
    base = " ".join(rng.choice(words) for _ in range(120))
    docs = [None, "", " \t ", "one", "two Words", "ONE", "a b c", base, base.upper(), base]
    for _ in range(40):
        w = base.split(" ")
        w[rng.randrange(len(w))] = rng.choice(words)
        docs.append(" \n".join(w))
    docs += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    docs.append("x " * 200_000)
    rows = [(i, t, "noise") for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for t in docs]
    assert [got[i].fingerprint for i in range(len(docs))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(docs))] == brute_components(fps)


def test_dense_groups_take_longer_keys(spark):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:
        x = rng.choice(list(fps)) if rng.random() < .5 else rng.getrandbits(64)
        for _ in range(rng.randrange(0, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    whole = brute_components(fps)
    for group in (4096, 3):
        from riskframe.llm.graph import components
        root = {r.node: r.root for r in components(simhash.links(df, group=group)).collect()}
        ours = [root.get(simhash._signed(f), simhash._signed(f)) for f in fps]
        assert len(set(zip(ours, whole))) == len(set(ours)) == len(set(whole))


def test_empty_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "solo text here")],
                               "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 4), (4, 4), (4, 4)]
    assert simhash.keep_one(df).count() == 4

import random
import re
from collections import Counter

import numpy as np

from riskframe.llm import phrases


def brute(rows, least, longest=5, top=2000):
    """The contract, with a counter of every phrase of every length."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[\x20\x09]", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i: i + k])] += 1
    cand = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    dropped = {(lang, p[i: i + m]) for (lang, p), c in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
               if f[lang, p[i: i + m]] <= c}
    out = []
    for (lang, p), a in cand.items():
        if (lang, p) not in dropped:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            out.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(mine[:top])]
    return sorted(ranked)


def fixture():
    rng = random.Random(11)
    words = ["the", "Cat", "sat", "É", "éa", "\x00", "x ", "b", "on-the", "𝄞"]
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "fr", None, "und"])
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b", "!"]) for _ in range(rng.randrange(0, 60)))
        rows.append((lang, text))
    rows += [("en", None), ("en", ""), (None, "  ,. "), ("de", "a a a a a a a"), ("en", "new york city hall " * 9), rows[3], rows[3]]
    return rows


def test_matches_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, r[0], r[1], "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string")
    for least, top in ((4, 2000), (9, 5)):
        got = sorted(tuple(r) for r in phrases.collocations(df, least=least, top=top).collect())
        assert got == brute(rows, least, top=top)
        assert got


def test_empty_and_nothing_frequent(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", "a b c")], df.schema)).collect() == []


def test_score_passes_64_bits(spark):
    rows = [("en", "p q")] * 3
    df = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.collocations(df, least=2).collect()
    assert [(r.phrase, r.score) for r in got] == [("p q", 2000)]
    big = 9_000_000_000_000
    exact = spark.range(1).selectExpr(f"CAST(CAST(1000 AS DECIMAL(19,0)) * CAST({big} AS DECIMAL(19,0)) * CAST({big * 7} AS DECIMAL(19,0)) "
                                      f"div (CAST({big} AS DECIMAL(19,0)) * CAST({big} AS DECIMAL(19,0))) AS BIGINT) AS s").first().s
    assert exact == 7000


def test_long_texts_are_cut_between_pieces_only(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 7)
    text = b"one two three\nfour five\nsix seven eight nine ten\n\nx"
    assert b"".join(phrases._slices(text)) == text
    whole, parts = phrases._Held(1, None), phrases._Held(1, None)
    parts.add("en", text)
    monkeypatch.setattr(phrases, "SLICE", 1 << 20)
    whole.add("en", text)
    counted = [{name: int(c) for _, names, count in h.counted() for name, c in zip(names, count)} for h in (whole, parts)]
    assert counted[0] == counted[1]
    assert counted[0][b""] == 11


def test_the_bitmap_only_saves_work(spark):
    """With every bit set, all phrases are counted; what is frequent stays the same."""
    rows = fixture()
    df = spark.createDataFrame(rows, "lang string, text string")
    full = spark.sparkContext.broadcast(np.full(1 << phrases.BITMAP_BITS - 3, 255, np.uint8).tobytes())
    clean = df.selectExpr("coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text")
    orders, _ = phrases.frequent(df, least=4)
    for k in (2, 4):
        want = {(r.lang, r.phrase, r.f) for r in phrases._counts(clean, k, full).where("f >= 4").collect()}
        assert {tuple(r) for r in orders[k - 1].collect()} == want

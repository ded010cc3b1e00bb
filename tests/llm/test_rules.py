import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from riskframe.llm import queries, rules
from riskframe.sources.tables import table


def brute(text):
    """The contract's counts, one character and one window at a time."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i: i + 5]) for i in range(len(words) - 4)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def slow_posterior(votes, n):
    """EM as written in the module's docstrings, with plain loops."""
    total, k = sum(n), len(votes[0])
    w = rules.PRIOR * total
    p = [0.1 if 1 in v else 0.9 for v in votes]
    for _ in range(rules.ROUNDS):
        share = (sum(a * b for a, b in zip(n, p)) + w * rules.START_GOOD) / (total + w)
        a, b = [], []
        for r in range(k):
            yes = [(x * q, v[r]) for x, q, v in zip(n, p, votes) if v[r]]
            no = [(x * (1 - q), v[r]) for x, q, v in zip(n, p, votes) if v[r]]
            good = (sum(x for x, v in yes if v == 2) + w * rules.START_RIGHT_GOOD) / (sum(x for x, _ in yes) + w)
            bad = (sum(x for x, v in no if v == 1) + w * rules.START_RIGHT_BAD) / (sum(x for x, _ in no) + w)
            a.append(min(max(good, rules.LEAST_RIGHT_GOOD), 1 - 1e-4))
            b.append(min(max(bad, 1 - a[-1]), 1 - 1e-4))
        new = []
        for v in votes:
            odds = math.log(share / (1 - share))
            for r in range(k):
                odds += {0: 0.0, 1: math.log((1 - a[r]) / b[r]), 2: math.log(a[r] / (1 - b[r]))}[v[r]]
            new.append(1 / (1 + math.exp(-odds)))
        p = new
    return p


def texts():
    rng = random.Random(3)
    words = ["alpha", "Béta", "c", "#x", "$$", "É,", "line wide", "\x00", "z%"]
    out = [None, "", " \t\n\x0b\x0c\r ", "one", "a b c d e a b c d e", "a a a a a a", "x y\nx y\n\n \nx y", "x \nx", "   "]
    for _ in range(60):
        line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))
        lines = [line() for _ in range(rng.randrange(1, 8))]
        out.append("\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))))
    return out + [" ".join(rng.choice(words[:3]) for _ in range(400))]


def test_counts_match_brute_force():
    for t in texts():
        assert rules.measure(t or "")[:5] == brute(t), t


def test_windows_of_equal_hash_are_compared(monkeypatch):
    monkeypatch.setattr(rules.np, "unique", lambda x, real=np.unique, **kw: real(x * 0 if x.dtype == np.uint64 else x, **kw))
    assert rules.repeated_words(np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 8])) == 10
    assert rules.repeated_words(np.arange(40)) == 0


def test_query_matches_slow_em(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    docs.select("doc_id", "text").union(extra).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_rules(spark, str(tmp_path)).collect()}
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = brute(r.text)
        assert tuple(got[r.doc_id][c] for c in rules.COUNTS) == want
        assert got[r.doc_id].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    measured = rules.measures(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    coded = {r.doc_id: r.code for r in measured.select("doc_id", rules.pattern().alias("code")).collect()}
    codes = sorted(set(coded.values()))
    votes = [[c // 3 ** i % 3 for i in range(len(rules.RULES))] for c in codes]
    slow = dict(zip(codes, slow_posterior(votes, [list(coded.values()).count(c) for c in codes])))
    for i, r in got.items():
        assert abs(r.quality - slow[coded[i]]) < 1e-6
        assert r.kept == (not r.base_failed and r.quality >= rules.KEEP)


def test_verdicts_agree_with_labels_that_em_never_sees(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    rows = rules.judge(docs).where("NOT base_failed").select("doc_id", "kept").join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").collect()
    good = [r.kept for r in rows if r.label == 1]
    bad = [r.kept for r in rows if r.label == 0]
    assert sum(good) / len(good) > 0.995
    assert sum(bad) / len(bad) < 0.05


def test_a_rule_that_fires_at_random_is_not_trusted():
    rng = np.random.default_rng(1)
    bad_doc = rng.random(20_000) < 0.2
    votes = np.where(rng.random((20_000, 5)) < np.where(bad_doc, 0.7, 0.01)[:, None], 1, 2)
    votes[:, 4] = np.where(rng.random(20_000) < 0.02, 1, 2)
    rows, n = np.unique(votes, axis=0, return_counts=True)
    model = rules.fit(rows, n.astype(float))
    assert abs(model.good - 0.8) < 0.02
    assert all(model.right_bad[:4] > 0.6) and model.right_bad[4] < 0.1


def test_empty_repeated_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rules.judge(df).collect() == []
    rows = [(1, "a b", 7, "x"), (1, "a b", 7, "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long, code string")
    got = sorted((r.doc_id or -1, r.n_words, r.kept) for r in rules.judge(df).collect())
    assert got == [(-1, 0, False), (1, 2, False), (1, 2, False)]

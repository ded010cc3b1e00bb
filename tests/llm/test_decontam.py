import hashlib
import random
import re

from riskframe.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = []
    for item, text in items:
        w = words(text)
        if w:
            m = min(10, len(w))
            wins += [(item, w[i:i + m]) for i in range(len(w) - m + 1)]
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    if item is not None:
                        ids.add(str(item))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "Cé", "d1", "E"]
    some = lambda n: (rng.choice([" ", "-", "\n", ", "])).join(rng.choice(vocab) for _ in range(n))
    items = [(1, some(14)), (2, some(10)), (10, "a"), (11, "b Cé"), (3, some(25)), (4, ""), (5, None), (6, " .. "),
             (None, some(12)), (7, "a b a"), (8, "a b a")]
    items.append((9, items[0][1]))
    docs = [(i, some(rng.randrange(0, 80))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "?!"), (103, "x " + items[4][1] + " y"), (103, "x"), (None, items[1][1].upper()),
             (104, "a " * 30_000), (105, "xay É" + items[0][1] + "z")]
    d = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame([(i, t, "n") for i, t in items], "item_id long, text string, n_words string")
    for size in (8 << 20, 700):
        got = decontam.digest(decontam.search(d, b, pass_bytes=size)).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontam.digest(decontam.search(d, b)).collect()] == [(1, 3, 0, 0)]
    assert decontam.search(d.limit(0), d.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert decontam.clean(d, d.withColumnRenamed("doc_id", "item_id")).collect() == []

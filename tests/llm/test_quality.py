import numpy as np

from riskframe.llm import quality
from riskframe.sources.tables import table

SF = "/root/testdata/sf0.01"


def brute_grams(text):
    """n-grams by plain words: (word), (word, word), and pairs of shapes."""
    gaps = " \t\n\r\x0b\x0c"
    for c in gaps:
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    return len(words) + 2 * max(len(words) - 1, 0), low


def test_gram_counts_and_equal_words():
    texts_ = [t.encode() for t in ("", "one", "One two", " a  b\n\na b ", "É " * 5, "x" * 300_000 + " y")]
    doc, bucket = quality.grams(texts_)
    for i, t in enumerate(texts_):
        n, low = brute_grams(t.decode())
        assert (doc == i).sum() == n
    alone = [np.sort(quality.grams([t])[1]) for t in texts_]
    assert all((np.sort(bucket[doc == i]) == alone[i]).all() for i in range(len(texts_)))
    assert set(quality.grams([b"ABC"])[1]) == set(quality.grams([b"abc"])[1])


def test_model_is_the_count_ratio(spark):
    docs = table(spark, SF, "documents")
    rows = quality.texts(docs)
    good = table(spark, SF, "labels").where("quality = 1").select("doc_id")
    raw, target = quality.counts(rows, good)
    ids = {r.doc_id for r in good.collect()}
    want_raw, want_target = np.zeros_like(raw), np.zeros_like(raw)
    for r in docs.collect():
        seen = np.bincount(quality.grams([(r.text or "").encode()])[1], minlength=len(raw))
        want_raw += seen
        want_target += seen * (r.doc_id in ids)
    assert (raw == want_raw).all() and (target == want_target).all()


def test_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    half = quality.F.pmod(quality.F.xxhash64("doc_id"), quality.F.lit(2)) == 0
    kept = {r.doc_id for r in quality.keep(docs, labels.where(half)).select("doc_id").collect()}
    held = labels.where(~half).collect()
    good, bad = [r.doc_id for r in held if r.quality == 1], [r.doc_id for r in held if r.quality == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i not in kept for i in bad) >= 0.95 * len(bad)


def test_top_k_is_exact(spark):
    scored, edge, _ = quality.sample(table(spark, SF, "documents"), table(spark, SF, "labels"), k=333)
    keys = sorted((r.key for r in scored.select("key").collect()), reverse=True)
    assert edge == keys[332] and sum(k >= edge for k in keys) == 333


def test_nulls_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "a b c", "k"), (3, "a b c", "k"), (None, "x y", "k")], "doc_id long, text string, key string")
    labels = spark.createDataFrame([(3, 1), (None, 0), (99, 0), (2, None)], "doc_id long, quality int")
    assert quality.classify(docs, labels).where("kept").count() == 5
    assert quality.keep(docs, labels).count() == 5
    assert quality.keep(docs, labels.limit(0)).count() == 5
    assert quality.keep(docs, labels, k=0).count() == 0
    assert quality.classify(docs.limit(0), labels).collect() == []

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from riskframe.llm import bpe, lines, quality, simhash
from riskframe.sources.tables import table
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_lines import brute as repeated
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, out[-1], SF)
        if name != "tokens":
            assert got.columns == columns, name
            got = lines.cut(got, "test")
        out.append(got)
    rows = [{r.doc_id: r.text for r in d.collect()} for d in out[:5]]
    kept = {r.doc_id for r in quality.classify(docs, table(spark, SF, "labels")).where("kept").collect()}
    assert set(rows[1]) == kept and all(rows[1][i] == rows[0][i] for i in kept)
    bad = {r.doc_id for r in table(spark, SF, "labels").where("quality = 0").collect()}
    good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
    assert not bad & kept and good <= kept

    before = sorted(rows[1].items())
    gone = repeated(before)
    assert rows[2] == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(d, ())) for d, (i, t) in enumerate(before)}

    ids = sorted(rows[2])
    comp = brute_components([brute_fingerprint(rows[2][i]) for i in ids])
    assert rows[3] == {ids[c]: rows[2][ids[c]] for c in set(comp)}

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = {r[0] for r in leaks(list(rows[3].items()), items) if r[-1]}
    assert rows[4] == {i: t for i, t in rows[3].items() if i not in hit}

    tok = Tokenizer.from_str(bpe.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    want = set()
    for i, t in rows[4].items():
        e = tok.encode(t, add_special_tokens=False).ids
        want.add((i, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert {tuple(r) for r in out[5].collect()} == want
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_odd_rows_pass_every_stage(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, None), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (3, "c d e f", "en", "s", 3),
                                  (None, "q " * 50_000, "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = lines.cut(stage(spark, now, SF), "test")
        assert set(now.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert simhash.keep_one(docs).where("doc_id = 3").count() == 3


def test_stages_take_columns_with_their_own_names(spark):
    """The helpers' column names, in any case, are just more columns of the input."""
    from pyspark.sql import functions as F

    from riskframe.llm import lines, quality, simhash
    rows = [(i, f"some plain words number {i} stand here\nand a second line", i, "h", "g", 0.5) for i in range(12)] + [(50, "some plain words number 3 stand here\nand a second line", 1, "h", "g", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long, _hash string, _GONE string, _quality_log_weight double")
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    for out in (simhash.keep_one(df), lines.clean(df), quality.keep(df, labels)):
        assert out.columns == df.columns and out.collect()

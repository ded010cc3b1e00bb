import hashlib
import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskframe.llm import bpe
from riskframe.sources.tables import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def reference(text):
    t = Tokenizer.from_str(bpe.read_tokenizer(PATH))
    ids = t.encode(text or "", add_special_tokens=False).ids
    back = t.decode(ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(back)


ODD = [None, "", " ", "\n\n  x", "a   b\t\tc \n d", "it's we'll I'D ''s !'s", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>c",
       "<|endoftext", "\u0000\u0001 tab\x1c\x85  x", "中文字 テスト 한국어", "é ՘ࡠ \U0001F600\U0001F469‍\U0001F4BB",
       "1234567890 12.5e-3 ²³", "a" * 50_000, "ab " * 50_000, "�﻿", "x" * 3 + "\n" * 5, "ÀÉ ñandú straße"]


def test_odd_texts_match_the_library(spark):
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(ODD)] + [(0, None, "n"), (None, "a b", "m")],
                               "doc_id long, text string, ids string")
    for size in (24_000_000, 50):
        got = bpe.encode_decode(df.coalesce(2), PATH, size)
        rows = [tuple(r) for r in bpe.digest(got).collect()]
        assert len(rows) == len(ODD) + 2
        by = {r[0]: r[1:] for r in rows}
        for i, t in enumerate(ODD):
            assert by[i] == reference(t), (i, t)
        assert by[None] == reference("a b")


def test_whole_documents_round_trip(spark):
    docs = table(spark, SF, "documents")
    want = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.encode_decode(docs, PATH)
    assert {r.doc_id: r.decoded for r in got.select("doc_id", "decoded").collect()} == want
    by = {r[0]: tuple(r[1:]) for r in bpe.digest(got).collect()}
    assert all(by[i] == reference(t) for i, t in list(want.items())[:60])


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_splitter_agrees_on_every_character():
    spec = bpe.read_tokenizer(PATH)
    split, tok = bpe.Splitter(spec), Tokenizer.from_str(spec)
    for c in [*range(0xD800), *range(0xE000, 0x20000, 7)]:
        s = f"a{chr(c)}a{chr(c)} {chr(c)}1{chr(c)}{chr(c)} !{chr(c)}"
        assert split(s) == [s[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(s)], hex(c)


def test_other_order_at_the_second_reading_fails_the_job(spark):
    """As many distinct words in every reading, but in another order."""
    def shuffled(frames):
        for x in frames:
            yield x.sample(frac=1, random_state=int.from_bytes(os.urandom(4)))
    words = [(i, f"w{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}") for i in range(300)]
    docs = spark.createDataFrame(words, "doc_id long, text string").coalesce(1).mapInPandas(shuffled, "doc_id long, text string")
    with pytest.raises(Exception, match="the input gave other rows when it was read again"):
        bpe.encode_decode(docs, PATH).collect()


def test_common_texts_are_split_as_the_tokenizer_does():
    import random
    split = bpe.Splitter(bpe.read_tokenizer(PATH))
    rng = random.Random(3)
    chars = [chr(c) for c in range(0x250)] + [chr(c) for c in range(0x2010, 0x2028)] + list("   ''sstl12 aé\n\t") * 20
    for _ in range(5000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(1, 16)))
        assert split._plain(text) == split.find_common(text) == [text[a:b] for _, (a, b) in split.slow.pre_tokenize_str(text)], text


def test_lists_packed_together_are_those_packed_alone():
    import numpy as np
    lists = [np.array(x, np.int64) for x in ([], [0, 127, 128], [], [1 << 21, 5], [1 << 28])]
    assert bpe.pack_all(lists) == [bpe.pack(x) for x in lists]

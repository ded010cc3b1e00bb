import hashlib
import re

from riskframe.llm import pii
from riskframe.sources.tables import table

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "phone": 8 <= len(digits) <= 15,
                  "card": 16 <= len(digits) <= 19 and luhn(digits)}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


ODD = [None, "", "a@b.c_d@e.f", "x..a@b-c.d.e..f@g", "@@a@b.cc@d.ee", "é a%+-._@x.y É\U0001F600 1.2.3.4.5.6.7.8", "0001.255.256.1 1.2.3.0255",
       "4111 1111 1111 1111", "4111-1111-1111-1111-000", "41111111111111111111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 x", "+1 (845) 555-9055 +12345678",
       "+1..........2", "+12 345 678 901 234 567", "\U0001F600+49 30 1234567\n+1", "a" * 60_000, "a." * 30_000 + "@" + "b." * 20_000 + "c",
       "1 " * 40_000, "1." * 40_000 + "1", "ab@cd.ef " * 300, "me(at)host.com or jo at site dot org", "call 212-555-0199 or (415) 555-0100 4111.1111.1111.1111",
       "fe80:0:0:0:1:2:3:4 email: kim [at] mail [dot] net"]


def check(rows, texts_):
    for i, t in enumerate(texts_):
        want = brute(t)
        r = rows[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS], (i, t and t[:80])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (i, t and t[:80])
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_base_spans_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(ODD)], "doc_id long, text string, spans string")
    check({r.doc_id: r for r in pii.digest(pii.detect(df)).collect()}, ODD)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts_ = [r.text for r in docs.orderBy("doc_id").collect()]
    check({r.doc_id: r for r in pii.digest(pii.detect(docs)).collect()}, texts_)


def test_added_spans(spark):
    rows = [(i, f"Please write an e-mail to user{i} [at] mail{i} [dot] com now, tel 212-555-01{i:02} ok, id 999 12 0 12 0") for i in range(60)]
    rows += [(100 + i, f"item 113-442-99{i:02}x") for i in range(5)]
    got = {r.doc_id: r for r in pii.digest(pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i in range(60):
        text, spans = rows[i][1], [s.split(":") for s in got[i].spans.split(",")]
        found = {(k, text[int(s):int(e)]) for k, s, e in spans}
        assert found == {("email", f"user{i} [at] mail{i} [dot] com"), ("phone", f"212-555-01{i:02}")}
        assert (got[i].n_email, got[i].n_phone, got[i].base_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert all(got[100 + i].spans == "" for i in range(5))


def test_base_spans_teach_and_decoys_stay_out(spark):
    """Many base phones without context, real local numbers with it, and as many decoys: the classes don't change places."""
    rows = [(i, f"see +1 212 555 {1000 + i} there") for i in range(300)]
    rows += [(1000 + i, f"call me on phone 212-555-{2000 + i} today") for i in range(80)]
    rows += [(2000 + i, f"lot 113-142-{3000 + i} part") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.candidates(df)
    state = next(r.state for r in pii.reliabilities(found).collect() if r.kind == "phone")
    assert state.a0 > 0.9 and state.b0 < 0.1 and 0.4 < state.p < 0.6
    got = {r.doc_id: r for r in pii.digest(pii.detect(df)).collect()}
    assert all(got[i].n_phone == 1 and got[i].spans.count("phone") == 1 for i in range(300))
    caught = sum("phone" in got[1000 + i].spans for i in range(80))
    wrong = sum("phone" in got[2000 + i].spans for i in range(80))
    assert caught / 80 > 0.95 and wrong / 80 < 0.05


def test_reliabilities_match_plain_em(spark):
    import itertools
    votes = {v: 1 + 10 * sum(v) ** 3 + 37 * (v[0] == v[1]) for v in itertools.product((False, True), repeat=3)}
    rows = [([("phone", 0, 1, False, list(v), ["f"])],) for v, n in votes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "found array<struct<kind:string,start:bigint,end:bigint,base:boolean,votes:array<boolean>,features:array<string>>>")
    got = pii.reliabilities(df).first().state
    p, a, b = .5, [.8] * 3, [.2] * 3
    for _ in range(pii.ROUNDS):
        post = {}
        for v in votes:
            y, z = p, 1 - p
            for i in range(3):
                y, z = y * (a[i] if v[i] else 1 - a[i]), z * (b[i] if v[i] else 1 - b[i])
            post[v] = y / (y + z)
        n = sum(votes.values())
        n1 = sum(votes[v] * post[v] for v in votes)
        p = (n1 + 1) / (n + 2)
        a = [(sum(votes[v] * post[v] for v in votes if v[i]) + 1) / (n1 + 2) for i in range(3)]
        b = [(sum(votes[v] * (1 - post[v]) for v in votes if v[i]) + 1) / (n - n1 + 2) for i in range(3)]
    assert all(abs(x - y) < 1e-9 for x, y in zip([got.p, got.a0, got.a1, got.a2, got.b0, got.b1, got.b2], [p, *a, *b]))


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_email) for r in pii.digest(pii.detect(df)).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert pii.detect(df.limit(0)).collect() == []

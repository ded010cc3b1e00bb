import random

from riskframe.llm import pages, urls


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcdef") for _ in range(rng.randrange(12))]
        keep = pages.unshared(a, b)
        gone = [x for x, k in zip(a, keep) if not k]
        assert len(gone) == brute_lcs(a, b)
        it = iter(b)
        assert all(x in it for x in gone)


def test_lines_repeated_in_great_numbers_are_aligned_whole(monkeypatch):
    rng = random.Random(4)
    a, b = ([rng.choice("abcd" * 9 + "xyz") for _ in range(4_600)] for _ in range(2))
    assert sum(a.count(x) * b.count(x) for x in set(a)) > pages.MATCHES
    gone = [x for x, k in zip(a, pages.unshared(a, b)) if not k]
    it = iter(b)
    assert all(x in it for x in gone)
    with monkeypatch.context() as m:
        m.setattr(pages, "MATCHES", 1 << 60)
        assert len(gone) == pages.unshared(a, b).count(False)
        m.setattr(pages, "MATCHES", 0)
        for _ in range(300):
            a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(25))] for _ in range(2))
            gone = [x for x, k in zip(a, pages.unshared(a, b)) if not k]
            it = iter(b)
            assert len(gone) == brute_lcs(a, b) and all(x in it for x in gone)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{a:b}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy</div>
<article><h1>Head &lt;1&gt;</h1><p>One <b>two</b>
three&nbsp;&eacute;<br>four<p>five<div class="cookie-notice">Cookies!</div><ul><li>x<li>y</ul><form><p>mail</p></form>
<section id="comments"><p>First!</p></section></article><aside>side</aside><footer>&copy; me</footer></body></html>"""


def test_markup_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", PAGE, "z"), (2, None, None, "z"), (3, "x", "", "z"), (4, "http://a.b/d", "plain & <b>text", "z"),
                                (1, "http://a.b/c", PAGE, "z"), (None, "http://q/", "<p>a</p>" * 30_000, "z")],
                               "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in pages.extract(df).collect()}
    assert got[1].text == "Head <1>\nOne two three é four\nfive\nx\ny"
    assert got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].url, got[3].text, got[4].text) == ("", None, "", "plain & text")
    assert got[None].n_chars == 59_999
    assert pages.extract(df).count() == 6
    assert pages.extract(df.limit(0)).collect() == []


def test_unmarked_pages_lose_what_neighbours_share(spark):
    html = lambda i: f"<body><div>Home</div><div>News</div><div>Story {i}</div><div>Body {i * i}</div><div>All rights</div></body>"
    rows = [(i, f"http://h.com/x/{i:03}", html(i)) for i in range(50)] + [(99, "http://other.com/", html(99))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (4096, 16):
        got = {r.page_id: r.text for r in pages.extract(df, size).collect()}
        assert all(got[i] == f"Story {i}\nBody {i * i}" for i in range(50))
        assert got[99].split("\n")[0] == "Home"
    mirror = spark.createDataFrame([(1, "http://m/a", html(1)), (2, "http://m/b", html(1))], "page_id long, url string, html string")
    assert {r.text.count("\n") for r in pages.extract(mirror).collect()} == {4}


def test_neighbours_decide_on_marked_pages_too(spark):
    """An article's lines stay, shared or not; shared ones outside go, unshared ones stay; an article of comments is none."""
    html = lambda i, kind: f"<body><div>Home</div><div>By {i}</div><{kind}><p>Story {i} {'s' * 40}</p><p>Join us</p></{kind}></body>"
    said = lambda i: f"<body><div>Home</div><div>Story {i}</div><article class='comment'><p>Nice {i}</p></article><article id='comment-{i}'>Bad {i}</article></body>"
    copy = lambda i: f"<body><div>Home</div><article class='post comments-open'><p>{'a' * 50}</p><p>{'b' * 50}</p><p>Edited {i}</p></article></body>"
    teaser = lambda i: f"<body><article><p>Buy now</p></article><div>Story {i} {'s' * 40}</div></body>"
    rows = [(i, f"http://a.com/{i}", html(i, "article")) for i in range(5)] + [(10 + i, f"http://b.com/{i}", said(i)) for i in range(5)] \
        + [(20 + i, f"http://c.com/{i}", copy(i)) for i in range(5)] + [(30 + i, f"http://d.com/{i}", teaser(i)) for i in range(5)] \
        + [(40, "http://e.com/", html(0, "article"))]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == f"By {i}\nStory {i} {'s' * 40}\nJoin us"
        assert got[10 + i] == f"Story {i}"
        assert got[20 + i] == f"{'a' * 50}\n{'b' * 50}\nEdited {i}"
        assert got[30 + i] == f"Buy now\nStory {i} {'s' * 40}"
    assert got[40] == f"Story 0 {'s' * 40}\nJoin us"


def test_articles_that_share_lines_stay_whole(spark):
    """Neighbours share a licence line, a title and a short paragraph; each keeps its own."""
    body = lambda i: ["Same title", f"Text {i} {'w' * (i * 7 + 1)}", "Les.", "Text under a free licence."]
    html = lambda i: "<body><div>Home</div><main><h1>{}</h1><p>{}</p><p>{}</p><p>{}</p></main><div>Imprint</div></body>".format(*body(i))
    df = spark.createDataFrame([(i, f"http://h.org/a/{i:02}", html(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == {i: "\n".join(body(i)) for i in range(12)}


def brute_neighbours(rows):
    """id -> (text, n_shared) by one pass over all pages in order."""
    out, order = {}, sorted(rows, key=lambda r: (r[1].split("/")[2], r[1].split("/", 3)[3], r[0]))
    lines = [pages.lines_of(r[2]) for r in order]
    plain = [[t for t, _ in x] for x in lines]
    hosts = [r[1].split("/")[2] for r in order]
    for i, row in enumerate(order):
        near = [j for j in (*range(i - 1, -1, -1), *range(i + 1, len(order))) if hosts[j] == hosts[i] and plain[j] != plain[i]]
        other = plain[near[0]] if near else None
        out[row[0]] = pages.main_text(lines[i], other), pages.unshared(plain[i], other).count(False) if near else 0
    return out


def test_size_of_parts_changes_no_neighbour(spark):
    """Sections share lines, runs of mirror pages go over several parts, hosts begin and end inside parts."""
    rng = random.Random(3)
    rows = []
    for host in ("a", "b", "c", "d"):
        n = 0
        while n < rng.choice((3, 40, 60)):
            body = f"<div>Home</div><div>Part {n // 7}</div><div>Is {rng.randrange(4)}</div>" + "<article>x</article>" * rng.randrange(2)
            for _ in range(rng.choice((1, 1, 1, 2, 9, 30))):
                rows.append((len(rows), f"http://{host}.com/s{n // 7:02}/{n:03}", body + "<!-- -->" * rng.randrange(2)))
                n += 1
    rows += [(len(rows) + i, f"http://m.com/{i:03}", f"<div>mirror</div><!-- {i} -->") for i in range(20)]
    rows += [(len(rows) + i, f"http://n.com/{i:03}", "<div>mirror</div>" if i < 19 else "<div>End</div><div>mirror</div>") for i in range(20)]
    want = brute_neighbours(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).cache()
    for size in (2, 8, 10, 4096):
        assert {r.page_id: (r.text, r.n_shared) for r in pages.extract(df, size).collect()} == want


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(r), r, v) for v, r in urls.RULES for h, p in [r.split("/", 1)]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_match_brute_force(spark):
    odd = [None, "", "x", "://", "http://", "HTTP://A.ORG", "http://A.ORG/", "ftp://Example.org/en/12#a", "http://example.org/en/2",
           "http://badexample.org/es/", "http://x.example.org/es/?q", "http://a.com/de/x://y.org/", "http://a.com?x=/fr/", "http://É.com/fr/é",
           "http://com/fr/", "http://a.com/fr", "nothing\nhttp://org/\nx", "http://a.net/" + "a1" * 20_000]
    df = spark.createDataFrame([(i, u, "n") for i, u in enumerate(odd)] + [(None, "http://z.org/", "n")], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert len(got) == len(odd) + 1
    for i, u in enumerate(odd):
        host, path, rule, verdict = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).collect() == []


def test_trees_on_held_out_urls(spark):
    """Neither the trees nor the suffix statistics see a held-out URL's label."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    held_out = urls.F.pmod(urls.F.xxhash64("page_id"), urls.F.lit(4)) == 0
    rows = urls.features(df, learn=~held_out).where("label IS NOT NULL").cache()
    model = urls.fit(rows.where(~held_out))
    held = model.transform(rows.where(held_out)).select("label", "prediction").collect()
    assert len(held) > 100 and sum(r.label == r.prediction for r in held) >= 0.85 * len(held)

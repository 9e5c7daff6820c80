import random
from urllib.parse import urljoin, urlsplit

import pytest
from quern.llm import url_filter
from test_chat_url_warc_quality import judged


def edges(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {(r.a, r.b) for r in url_filter.link_edges(df).collect()}


def node(url):
    x = urlsplit(url)
    return f"{x.scheme.replace('https', 'http')}://{x.netloc.lower()}{x.path or '/'}" + ("?" + x.query if x.query else "")


def test_relative_targets(spark):
    refs = ["page.html", "?id=2", "#x", "./p", "../p", "../../../p", "a/./b/../c", ".", "..", "x/..", "a/", "/r/../s", "/q?x=/../y", "//h.net/z", "http://o.org/w", "p?u=http://no.net/", "a:b/c", "mailto:m@h.net"]
    for i, at in enumerate(["http://e.com", "https://e.com/", "http://e.com/d/f/g.html?k=1", "http://e.com/d/f/"]):
        urls = [at.replace("e.com", f"e{i}.com")] * len(refs)
        got = edges(spark, [(u, f'<link rel="canonical" href="{r}">') for u, r in zip(urls, refs, strict=True)])
        assert got == {(node(u), node(urljoin(u, r))) for u, r in zip(urls, refs, strict=True) if not r.startswith(("a:", "mailto:"))}
    based = '<base target=x><BASE href="../n/"><link rel=canonical href=p.html>'
    assert edges(spark, [("http://e.com/d/f/g", based)]) == {("http://e.com/d/f/g", "http://e.com/d/n/p.html")}


def test_values(spark):
    """Quotes of both kinds, none, blanks inside, and character references."""
    tags = ['<link rel=canonical href="/a?x=1&amp;y=2">', "<link rel=canonical href='/a?q=\"&#38;amp;'>", "<link rel=canonical href=/b>", '<link href=" /c d " rel="canonical">', "<meta http-equiv=refresh content='3; URL=/e?f&amp;g'>", '<meta http-equiv="refresh" content="3;url=\'/h\'">']
    got = edges(spark, [("HTTP://E.com", t) for t in tags])
    assert {b for _, b in got} == {f"http://e.com{x}" for x in ("/a?x=1&y=2", '/a?q="&amp;', "/b", "/c d", "/e?f&g", "/h")}
    assert {a for a, _ in got} == {"http://e.com/"}


def test_all_tags_count_and_decide(spark):
    many = '<link rel="canonical" href="one"><link rel="canonical" href="two"><meta http-equiv="refresh" content="9"><meta http-equiv="refresh" content="0; url=three">'
    assert edges(spark, [("http://e.com/d/", many)]) == {("http://e.com/d/", f"http://e.com/d/{x}") for x in ("one", "two", "three")}
    pages = [(1, "http://b.net/x/y", '<link rel=canonical href="z">'), (2, "http://b.net/x/z", '<meta http-equiv=refresh content="0; url=?q"><link rel=canonical href="http://c.de/1"><link rel=canonical href="http://c.de/2">'), (3, "http://c.de/2", None), (4, "http://c.de/3", "")]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}
    lone = [(1, "http://c.de/a/b", '<meta http-equiv="refresh" content="0; url=../k">'), (2, "http://c.de/k", '<link rel=canonical href="//bad.net/">')]
    assert {r.verdict for r in url_filter.judge_urls(spark.createDataFrame(lone, "page_id long, url string, html string")).collect()} == {"block"}


def test_query_strings_are_not_one_page(spark):
    link = '<link rel=canonical href="http://bad.net/z">'
    pages = [(1, "http://a.com/p?id=1", link), (2, "http://a.com/p?id=2", ""), (3, "http://a.com/p", ""), (4, "http://a.com/p?id=1#top", ""), (5, "http://A.com", '<link rel=canonical href="http://a.com/p?id=1">'), (6, "http://a.com/", "")]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block"}


@pytest.mark.parametrize("hot", [1, 1000])
def test_against_union_find(spark, monkeypatch, hot):
    """Random links with query strings, a chain of 500 redirects, a page that a third of all rows are, and allow before block."""
    import quern.llm.common as common

    monkeypatch.setattr(common, "HOT_SHARE", hot)
    rng = random.Random(12)
    hosts = ["bad.net", "w.example.net", "a.com", "b.org", "c.de", "example.com"]
    urls = sorted({f"http://{rng.choice(hosts)}/{rng.choice(['de/', 'fr/', 'en/', ''])}{rng.randrange(9)}" + rng.choice(["", "?q=1", "?q=2"]) for _ in range(150)})
    pages = [(i, rng.choice(urls), f'<link rel="canonical" href="{rng.choice(urls)}">' if rng.random() < 0.3 else None) for i in range(300)] + [(1000 + i, urls[0], "") for i in range(150)]
    chain = [f"http://long.de/{i}" for i in range(501)]
    pages += [(2000 + i, u, "") for i, u in enumerate(chain[::50])]
    moves = list(zip(chain, chain[1:], strict=False)) + [(chain[250], "http://x.net/")]
    up: dict[str, str] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, u, h in pages:
        if h:
            up[root(node(u))] = root(node(h.split('"')[3]))
    for a, b in moves:
        up[root(node(a))] = root(node(b))
    sides: dict[str, set] = {}
    for x in list(up):
        sides.setdefault(root(x), set()).add(judged(x, url_filter.RULES)[3])
    df, red = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(moves, "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df, redirects=red).collect()}
    for i, u, _ in pages:
        own, near = judged(u, url_filter.RULES)[3], sides.get(root(node(u)), set())
        assert got[i] == (own or ("allow" if "allow" in near else "block" if "block" in near else "allow")), (i, u)
    assert got[2000] == got[2010] == "block"

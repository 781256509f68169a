"""Selectors, articles, players and directories of hand-made pages against a plain reading of the same trees."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import html as H
from sparkloom.operators import companies as OC, mapping as M, urls as OU


def frame(spark, *pages):
    rows = [(i, p[0], p[1]) if isinstance(p, tuple) else (i, "https://n.example.com/a/b", p) for i, p in enumerate(pages)]
    return H.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))


class Node:
    def __init__(self, tag, attrs, children):
        self.tag, self.attrs, self.children = tag, attrs, children

    def html(self):
        attrs = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>{''.join(c if isinstance(c, str) else c.html() for c in self.children)}</{self.tag}>"

    def text(self):
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self, above=()):
        yield self, above
        for c in self.children:
            if not isinstance(c, str):
                yield from c.walk((*above, self))


def meets(node, step):
    """One step of a selector, read apart from the library's reading."""
    import re

    tag = re.match(r"[a-z0-9]*", step)[0]
    if tag and node.tag != tag:
        return False
    if any(c not in node.attrs.get("class", "").split() for c in re.findall(r"\.([\w-]+)", re.sub(r"\[.*?\]", "", step))):
        return False
    for name, part, exact in ((n, p, e) for n, p, e in re.findall(r'\[([\w-]+)(?:\*="([^"]*)"|="([^"]*)")?\]', step)):
        if name not in node.attrs or part and part not in node.attrs[name] or exact and node.attrs[name] != exact:
            return False
    return True


def chosen(root, selector):
    *before, last = selector.split()
    for node, above in root.walk():
        rest = list(before)
        for a in reversed(above):
            if rest and meets(a, rest[-1]):
                rest.pop()
        if not rest and meets(node, last):
            yield node


def test_selectors_on_random_trees(spark):
    rnd = random.Random(11)
    classes = ["byline", "author", "article-meta", "x-byline-y", "publish-date", "tags", "tag", "title", "breadcrumb", "category", "awards", "question", "player-info", "all-pro"]

    def tree(depth):
        attrs = {}
        if rnd.random() < 0.7:
            attrs["class"] = " ".join(rnd.sample(classes, rnd.randint(1, 2)))
        if rnd.random() < 0.2:
            attrs[rnd.choice(["rel", "property", "name", "datetime"])] = rnd.choice(["author", "article:author", "og:description"])
        kids = [tree(depth - 1) if depth and rnd.random() < 0.6 else f"w{rnd.randint(0, 99)}" for _ in range(rnd.randint(1, 3))]
        return Node(rnd.choice(["span", "b", "i", "em"]) if depth < 3 else rnd.choice(["span", "b"]), attrs, kids)

    roots = [tree(4) for _ in range(60)]
    got = {r.page_id: r.found for r in frame(spark, *[r.html() for r in roots]).collect()}
    for i, root in enumerate(roots):
        for selector in H.SELECTORS:
            want = [(n.text().strip(), n.attrs.get("content") or n.attrs.get("datetime")) for n in chosen(root, selector)]
            assert [(x.text, x.value) for x in got[i].get(selector, [])] == want, selector


ARTICLE = """<html><head><title>Site</title><meta property="og:title" content="Other"><meta property="article:modified_time" content="2024-03-05T10:00:00Z"><meta name="keywords" content="a, b">
<meta name="description" content="Short."></head><body><h1 class="page-title"> Big News </h1><p class="byline">By Jo Roe</p><span class="author">Jo Roe</span><time datetime="March 4, 2024">x</time><div class="tags"><a>b</a><a>c</a></div>
<nav class="breadcrumb"><a>Home</a><a>World</a></nav><article><figure><img src="/i.png" width="640" height="12px" alt="I" title="T"><figcaption>Seen</figcaption></figure><img src="k.png" title="Only"><p>one two</p></article><img src="/out.png"></body></html>"""


def test_article_fields(spark):
    long = "<article>" + "word " * 3000 + "</article>"
    a, b, c = H.article_confidence(H.extract_article(frame(spark, ARTICLE, long, "<p>x</p>"))).orderBy("page_id").collect()
    assert (a.title, a.byline, a.author, a.published, a.modified, a.excerpt, a.category) == ("Big News", "By Jo Roe", "Jo Roe", "2024-03-04T00:00:00.000Z", "2024-03-05T10:00:00.000Z", "Short.", "Home")
    assert [tuple(i) for i in a.images] == [("https://n.example.com/i.png", "I", "Seen", 640, 12), ("https://n.example.com/a/k.png", None, "Only", None, None)]
    assert a.tags == ["a", "b", "c", "bc"] and a.confidence == 0.8
    assert (b.word_count, b.reading_time, len(b.content)) == (3000, 15, 5000) and c.published is None and c.images == []
    whole = H.extract_article(frame(spark, long), max_len=None).first()
    assert len(whole.content) == 5 * 3000 - 1


def test_dates(spark):
    texts = ["2024-02-01", "2024-02-01T05:06:07+02:00", "Feb 1, 2024", "1 February 2024", "2/1/2024", "Thu, 1 Feb 2024 00:00:00 GMT", "soon", None, ""]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(H.iso_date(F.col("t")).alias("d")).collect()]
    assert got == ["2024-02-01T00:00:00.000Z", "2024-02-01T03:06:07.000Z", *["2024-02-01T00:00:00.000Z"] * 4, None, None, None]


PLAYER = """<h1>Pat Doe</h1><div class="necro-jersey">QB #12</div><div class="player-info"><p>Height: 6'3"</p><p>Weight: 225 lbs</p></div><div class="bio-section">Born: May 4, Springfield, Ohio</div>
<div class="player-info">Draft: 2001 SEA 2 40</div><ul class="awards">MVP 2003, Pro Bowl; MVP 2003
All-Pro</ul><div class="faq">Where is he from? Ohio. When? 2001</div>
<table class="x"><tr><th>Year</th><th>Yds</th><th></th></tr><tr><td>2001</td><td>3,000</td><td>1e3</td></tr></table><table><tr><td>Career</td><td>9</td></tr><tr><td>5</td><td>.5</td></tr></table><table><tr><td>Postseason</td></tr><tr><td>NaN</td></tr></table>"""


def test_player_pages(spark):
    parsed = frame(spark, PLAYER, "<p>nothing</p>")
    bio, none = H.extract_player_bio(parsed).orderBy("page_id").collect()
    assert (bio.name, bio.position, bio.jersey, bio.height, bio.weight, bio.born, bio.birth_place) == ("Pat Doe", "QB", "12", "6'3\"", "225", "May 4", "Springfield, Ohio")
    assert tuple(bio.draft_info) == (2001, "SEA", 2, 40) and bio.achievements == ["MVP 2003", "Pro Bowl", "All-Pro"]
    assert bio.answers["Where is he from"] and none.draft_info is None and none.achievements == [] and none.answers == {}
    stats = {r.table_idx: (r.table_type, r.stats, r.numbers) for r in H.extract_stat_tables(parsed.filter("page_id = 0")).collect()}
    assert stats[0] == ("season", {"Year": "2001", "Yds": "3,000", "col2": "1e3"}, {"Year": 2001.0, "col2": 1000.0})
    assert stats[1] == ("career", {"Career": "5", "9": ".5"}, {"Career": 5.0, "9": 0.5}) and stats[2] == ("playoffs", {"Postseason": "NaN"}, {})
    tables = H.player_tables(parsed)
    assert [tuple(r)[2:] for r in tables["draft_info"].collect()] == [("Pat Doe", 2001, "SEA", 2, 40)] and tables["achievements"].count() == 3


def test_directories_of_two_sites(spark):
    rows = "<table><tr><td>Address 1 Main</td><td>Site a.com</td><td>Name of A</td></tr><tr><td>x</td></tr></table>"
    parsed = frame(spark, ("https://www.thomasnet.com/x", rows), ("https://d2pbuyersguide.com/x", rows), ("https://any.org", rows), ("https://notthomasnet.com", rows * 2))
    got = {(r.page_id, r.pos): (r.name, r.contact, r.website) for r in H.extract_companies(parsed).collect()}
    plain = ("Address 1 Main", "Site a.com", "Name of A")
    assert got == {(0, 0): ("Name of A", "Address 1 Main", "Site a.com"), (1, 0): plain, (2, 0): plain, (3, 0): plain, (3, 1 << 32): plain}
    report = OC.directory_report(OC.supplier_directory(H.extract_companies(parsed)), parsed.select("url", F.lit("t").alias("title"), F.lit(None).cast("string").alias("description")))
    assert {r.url: r.n_companies for r in report.collect()}["https://www.thomasnet.com/x"] == 1 and report.count() == 4
    out = tempfile.mkdtemp(prefix="spark-")
    OC.export_directory(spark.createDataFrame([("=A", "1, 2", "https://a", "u")], "name string, contact string, website string, url string"), f"{out}/csv")
    assert spark.read.csv(f"{out}/csv", header=True).first().name == "'=A"


def test_caps_are_options(spark):
    page = "".join(f'<h2>{"h" * 300}</h2><a href="/p{i}">x</a>' for i in range(30))
    parsed = frame(spark, page)
    assert H.extract_links(parsed).count() == 20 and H.extract_links(parsed, cap=None).count() == 30
    assert H.extract_headings(parsed).agg(F.max(F.length("text"))).first()[0] == 200 and H.extract_headings(parsed, None, None).agg(F.sum(F.length("text"))).first()[0] == 9000


def test_news_from_discovery_to_statistics(spark):
    deal = "<article><h1>Deal</h1><p>Acme Corp. acquired Beta Holdings for $5.5 million on March 3, 2024.</p></article>"
    pages = spark.createDataFrame([(1, "u1", deal), (2, "u2", "<article><p>Nothing.</p></article>"), (3, "u9", deal)], "page_id long, url string, html string")
    found = spark.createDataFrame([("u1", "feed"), ("u2", "feed"), ("u3", "list")], "url string, source string")
    got = {r.url: (r.success, r.source, r.deal_value) for r in H.ma_news(pages, found=found).collect()}
    assert got == {"u1": (True, "feed", 5.5e6), "u2": (True, "feed", None), "u3": (False, "list", None)}


def test_intake_report(spark):
    urls = ["http://www.a.com/x/", "https://https://a.com/x", "a.com/x", "https://b.org/", "nope nope", None]
    got = {(r.section, r.key): r.n for r in OU.intake_report(spark.createDataFrame(list(enumerate(urls)), "idx long, url string"), ("a.com",)).collect()}
    assert got["repair", "total"] == 6 and got["repair", "changed"] >= 3 and sum(n for (s, _), n in got.items() if s == "category") == sum(n for (s, _), n in got.items() if s == "status") == 6


def test_mapping_suggestions(spark, monkeypatch):
    headers = spark.createDataFrame([("Company Nam", 0), ("Web", 1), ("zz", 2)], "header string, pos int")
    defs = spark.createDataFrame([("company", ["Company Name"], True), ("website", ["Website", "Web Page"], False), ("name", ["Name"], False)], "target_field string, source_headers array<string>, required boolean")
    used = spark.createDataFrame([("name",)], "target_field string")
    got = {(r.header, r.rank): r.target_field for r in M.suggest_mappings(headers, defs, used).collect()}
    assert got[("Company Nam", 1)] == "company" and got[("Web", 1)] == "website" and ("zz", 1) not in got
    assert M.auto_map_headers(headers, defs.limit(0)).filter("target_field is null").count() == 3
    monkeypatch.setattr(M, "MOST_NAMES", 2)
    with pytest.raises(ValueError):
        M.auto_map_headers(headers, defs)
    assert M.column_by_synonyms(["My Firm", "Company"], ("Firm", "Company")) == "Company" and M.column_by_synonyms(["x", "The Firm"], ("Firm",)) == "The Firm"


def test_pages_are_parsed_in_bounded_blocks(spark):
    """A task gives the parts of one block at a time, and those that were asked for are the same as all."""
    assert list(H._blocks([10] * 1200)) == [(0, 500), (500, 1000), (1000, 1200)] and list(H._blocks([])) == []
    assert list(H._blocks([1, 3 << 20, 1, 700_000, 700_000])) == [(0, 1), (1, 2), (2, 4), (4, 5)]
    html = '<title>T</title><article class="content post"><h1>A <a href="/b">b</a></h1><p class="tag">one<p>two</article><table><tr><th>x<td>y</table><li class="card"><a href="c">d</a></li>'
    rows = spark.createDataFrame([(i, "http://x.com/", html if i % 9 else None) for i in range(1100)], "page_id long, url string, html string").coalesce(1)
    whole = {r.page_id: r for r in H.parse_pages(rows).collect()}
    assert len(whole) == 1100 and whole[1].links and whole[1].tables and whole[0].error == "no html"
    for parts in (("links",), ("headings",), ("blocks",), ("marks",), ("links", "body"), H.FOR_ARTICLES, H.FOR_BIOS, H.FOR_TABLES, H.FOR_COMPANIES):
        some = H.parse_pages(rows, parts=parts)
        assert set(some.columns) == {"page_id", "url", "error", *parts}
        assert all(r[c] == whole[r.page_id][c] for r in some.filter("page_id < 3").collect() for c in some.columns)


def test_players_are_parsed_once(spark):
    """The tables of players share one parse, which is stored."""
    tables = H.player_tables(H.parse_pages(spark.createDataFrame([(1, "http://x.com/", "<h1>P</h1>")], "page_id long, url string, html string")))
    assert not any("MapInPandas" in t._jdf.queryExecution().toString() for t in tables.values())


def test_patterns_of_players_run_once(spark):
    """What is stored are the biographies: no table tries the patterns on the pages' elements again."""
    tables = H.player_tables(frame(spark, PLAYER, PLAYER.replace("2001 SEA 2 40", "2001 none"), None))
    assert not any("regexp_extract" in tables[name]._jdf.queryExecution().toString() for name in ("players", "draft_info", "achievements", "answers"))
    assert [tuple(r)[3:] for r in tables["draft_info"].collect()] == [(2001, "SEA", 2, 40)]
    assert {r.page_id: r.name for r in tables["players"].collect()} == {0: "Pat Doe", 1: "Pat Doe", 2: None} and tables["statistics"].count() == 2 * 6

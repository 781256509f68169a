"""Operators on small frames, plain-Python replays, streaming equal to batch."""

import os
import tempfile
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import html as H, urls as U
from sparkloom.operators import companies as OC, crawl_logs as L, lines as LN, mapping as M, players as P, robots as R, urls as OU
from sparkloom.sources import io as IO
from sparkloom.streaming import stateful as S


def test_dedupe_and_intake(spark):
    urls = ["https://example.com/page", "https://example.com/page", "https://example.com/page?utm_source=test", "https://example.com/other", "http://localhost", "ftp://example.com", "nope", None]
    df = spark.createDataFrame(list(enumerate(urls)), "idx long, url string").repartition(3)
    got = {r.idx: (r.category, r.status, r.first_idx) for r in OU.url_intake(df).collect()}
    assert got == {0: ("valid", "valid", 0), 1: ("valid", "duplicate", 0), 2: ("valid", "duplicate", 0), 3: ("valid", "valid", 3), 4: ("private_host", "invalid", None), 5: ("invalid_protocol", "invalid", None), 6: ("malformed", "invalid", None), 7: ("malformed", "invalid", None)}


def test_enhanced_validation(spark):
    df = spark.createDataFrame([("example.com/login/",), ("https://www.amazon.com/x",), ("http://127.0.0.1/",), ("https://en.wikipedia.org/wiki/A?ref=x#y",)], "url string")
    rows = OU.validate_urls_enhanced(df).collect()
    assert [r.category for r in rows] == ["valid", "scraping_blocked", "invalid_domain", "valid"]
    assert rows[0].formatted == "https://example.com/login" and len(rows[0].warnings) == 1 and rows[3].formatted == "https://en.wikipedia.org/wiki/A" and rows[3].warnings == ["Domain is known to be scraping-friendly"]


@pytest.mark.parametrize("text,path,allowed", [
    ("User-agent: *\nDisallow: /private", "/private/page", False), ("User-agent: *\nDisallow: /private", "/public", True), ("User-agent: *\nDisallow: /folder\nAllow: /folder/public.html", "/folder/public.html", True),
    ("User-agent: *\nDisallow: /a*z", "/abcz", False), ("User-agent: evil\nDisallow: /", "/x", True), ("User-agent: bot\nDisallow:\nUser-agent: *\nDisallow: /x", "/x", False), ("", "/x", True), ("User-agent: *\nDisallow: /p$", "/p", True),
])
def test_robots(spark, text, path, allowed):
    rules = R.parse_robots(spark.createDataFrame([("h", text)], "host string, content string"), "bot/1.0")
    urls = spark.createDataFrame([("h", path), ("other", path)], "host string, path string")
    assert {r.host: r.allowed for r in R.robots_filter(urls, rules).collect()} == {"h": allowed, "other": True}


def test_unique_slugs_with_natural_numbers(spark):
    names = ["Smith", "Smith 1", "Smith", "Smith", "Jones", "Jones", "Smith 1", "Smith_1"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string").repartition(3)
    got = {r.i: r.player_id for r in P.unique_slug(df, "name", "i").collect()}
    taken, want = set(), {}
    for i, n in enumerate(names):
        slug = "".join(c for c in n.lower() if c.isalnum() or c == " ").replace(" ", "_")
        out, k = slug, 1
        while out in taken:
            out, k = f"{slug}_{k}", k + 1
        taken.add(out)
        want[i] = out
    assert got == want and len(set(got.values())) == len(names)


def plain_slugs(names):
    taken, out = set(), []
    for n in names:
        slug = "".join(c for c in (n or "").lower() if c.isascii() and c.isalnum() or c == " ").strip().replace(" ", "_")
        own, k = slug, 1
        while own in taken:
            own, k = f"{slug}_{k}", k + 1
        taken.add(own)
        out.append(own)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_unique_slugs_of_families(spark, seed):
    import random

    rnd = random.Random(seed)
    shapes = ["smith", "smith 1", "smith 2", "smith 1 1", "smith 1 2", "smith 3", "jones", "jones 5", "lee 2", "lee 02", "smith 12"]
    names = [rnd.choice(["smith"] * rnd.choice([1, 12]) + shapes) for _ in range(150)] + [None, "", "lee"]
    rnd.shuffle(names)
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string").repartition(4)
    got = [r.player_id for r in P.unique_slug(df, "name", "i").orderBy("i").collect()]
    assert got == plain_slugs([(n or "") for n in names]) and len(set(got)) == len(names)


def test_unique_slugs_of_one_name(spark):
    df = spark.range(4000).select(F.col("id").alias("i"), F.lit("Pat Doe").alias("name"))
    got = [r.player_id for r in P.unique_slug(df, "name", "i").orderBy("i").collect()]
    assert got == ["pat_doe", *[f"pat_doe_{k}" for k in range(1, 4000)]] and P.unique_slug(df.limit(0), "name", "i").count() == 0


def test_season_team(spark):
    seasons = spark.createDataFrame([("OAK", 1990), ("OAK", 1996), ("OAK", 2021), ("TEN", 1990), ("SEA", 2001), ("2TM", 2001), (None, 2001), ("XXX", 2001)], "team string, season int")
    static = spark.createDataFrame([("SEA", "Seattle Seahawks", "SEA")], "code string, team_full string, team_abbrs string")
    got = [(r.team_full, r.team_abbrs) for r in P.season_team(seasons, P.team_history(spark), static).collect()]
    assert got == [("Los Angeles Raiders", "LAI"), ("Oakland Raiders", "OAK"), ("Las Vegas Raiders", "LVR"), ("Unknown Team (TEN)", "TEN"), ("Seattle Seahawks", "SEA"), ("Multiple Teams", "MULT"), ("Multiple Teams", "MULT"), ("Unknown Team (XXX)", "XXX")]


def test_header_mapping(spark):
    headers = spark.createDataFrame([("Company Name", 0), ("company", 1), ("Web Site", 2), ("zzz", 3)], "header string, pos int")
    defs = spark.createDataFrame([("company", ["Company Name", "Company"], True), ("website", ["Website", "URL"], True), ("phone", ["Phone"], True)], "target_field string, source_headers array<string>, required boolean")
    mapped = M.auto_map_headers(headers, defs)
    assert {r.header: r.target_field for r in mapped.collect()} == {"Company Name": "company", "company": None, "Web Site": "website", "zzz": None}
    s = M.mapping_summary(mapped, defs).first()
    assert s.missing_required == ["phone"] and s.mapped == 2 and s.confidence == pytest.approx(0.8)
    bad = spark.createDataFrame([("a", "company"), ("b", "company"), ("c", "nope")], "header string, target_field string")
    assert sorted((r.check, r.field) for r in M.validate_mapping(bad, defs).collect()) == [("duplicate_target", "company"), ("missing_required", "phone"), ("missing_required", "website"), ("unknown_target", "nope")]
    assert M.mapping_confidence(bad, defs).first().confidence == pytest.approx(0.6 + 0.4 / 3)


def test_pick_columns_prefers_websites(spark):
    sheet = spark.createDataFrame([("Acme", "https://app.sourcescrub.com/?url=https%3A%2F%2Facme.com", "https://www.acme.com/x"), ("Beta", "https://app.sourcescrub.com/companies/1", "")], ["Company Name", "Search URL", "Website"])
    assert M.pick_columns(sheet)["website"] == "Website" and M.pick_columns(sheet)["company"] == "Company Name"
    only = sheet.drop("Website")
    assert [(r.Company, r.Website) for r in OC.target_list(only).collect()] == [("Acme", "https://acme.com"), ("Beta", "—")]
    assert M.report_columns(spark.createDataFrame([("x", "", "y")], "b string, c string, a string"), [{"target_field": "b", "required": True}, {"target_field": "c"}, {"target_field": "a"}]) == ["b", "a"]
    rows = M.mapped_rows(spark.createDataFrame([(" acme ", None)], "n string, s string"), {"n": "name", "s": "state"}, [{"target_field": "name", "transform": "trim,titleCase"}, {"target_field": "state", "default_value": "texas", "transform": "normalizeState"}]).first()
    assert (rows.name, rows.state) == ("Acme", "TX")


def test_page_scores(spark):
    text = "Pat Doe had 300 yards in 9 games of the 2001 season; career stats show 20 touchdowns. Born in Ohio."
    r = spark.createDataFrame([(text,), (None,)], "t string").select(H.sports_validation(F.col("t")).alias("v")).collect()
    assert (r[0].v.score, r[0].v.valid, r[0].v.failed) == (6, True, []) and (r[1].v.score, r[1].v.valid) == (0, False)
    row = spark.createDataFrame([("A", "QB", "6-2", None, "x", "", "r1", {"a": "b"}, ["s"], None, [])], "name string, position string, height string, weight string, birth_date string, college string, draft string, career map<string, string>, seasons array<string>, playoffs map<string, string>, achievements array<string>")
    assert H.structured_quality(row).first().quality == 20 + 15 + 10 + 15 + 10 + 10
    block = "word " * 60
    pages = spark.createDataFrame([(1, "u", f"<body><article><h1>T</h1><p>{block}</p></article><div class='content'><p>short</p></div></body>")], "page_id long, url string, html string")
    best = H.main_content_score(H.parse_pages(pages)).first()
    assert best.method == "article" and best.score == 30 + 80 + 0.5 * len(best.text) + 2 * 61 + 200


PAGE = """<html lang="en"><head><title>List</title><meta name="author" content="Jo"></head><body><h1>Makers</h1><p>Intro <b>text<p>Page 2 of 7
<table class="directory"><tr><th>Company</th><th>Contact</th><th>Website</th></tr><tr><td>Acme &amp; Co</td><td>(212) 555-0100</td><td>www.acme.com</td></tr><tr><td>acme co</td><td></td></tr><tr><td>Beta</td><td>x</td></tr></table>
<a href="/next" rel="next">Next</a> <a href="#x">skip</a> <a href="https://o.org/">o</a><a href="/next">again</a><script>var a="<p>no</p>";</script></body>"""
STATS = """<html><body><h1 itemprop="name">Pat Doe</h1><div class="player-info"><p>Position: QB</p><p>6-2, 225 lbs</p><p>College: Test State. </p></div>
<table class="stats_table" id="passing_career"><tr><th>Year</th><th>Team</th><th>Yds</th></tr><tr><td>2001</td><td>SEA</td><td>3,000</td></tr></table></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "https://x.com/suppliers/a/b", PAGE), (2, "https://x.com/player/D/x.htm", STATS), (3, "https://x.com/", None)], "page_id long, url string, html string")
    parsed = H.parse_pages(pages).cache()
    assert {r.page_id: r.type for r in H.content_type(parsed).collect()} == {1: "news", 2: "sports", 3: "generic"}
    companies = H.extract_companies(parsed.filter("page_id = 1"))
    assert [(r.name, r.contact, r.website) for r in companies.orderBy("pos").collect()] == [("Acme & Co", "(212) 555-0100", "www.acme.com"), ("acme co", "", None), ("Beta", "x", None)]
    kept = OC.supplier_directory(companies)
    assert sorted(r.name for r in kept.collect()) == ["Acme & Co", "Beta"] and kept.filter("name like 'Acme%'").first().website == "https://www.acme.com"
    links = [(r.pos, r.href) for r in H.extract_links(parsed.filter("page_id = 1")).collect()]
    assert links == [(0, "https://x.com/next"), (1, "https://o.org/")]
    p = H.extract_pagination(parsed.filter("page_id = 1")).first()
    assert (p.has_next, p.next_url, p.current_page, p.total_pages) == (True, "https://x.com/next", 2, 7)
    assert [r.text for r in H.extract_headings(parsed.filter("page_id = 1")).collect()] == ["Makers"]
    assert H.extract_meta(parsed).first().content == "Jo"
    assert parsed.filter("page_id = 1").first().paragraphs == ["Intro text", "Page 2 of 7"]
    stat = H.extract_stat_tables(parsed.filter("page_id = 2")).first()
    assert stat.table_type == "career" and stat.stats == {"Year": "2001", "Team": "SEA", "Yds": "3,000"}
    bio = H.extract_player_bio(parsed.filter("page_id = 2")).first()
    assert (bio.name, bio.position, bio.height, bio.weight, bio.college) == ("Pat Doe", "QB", "6-2", "225", "Test State")
    tables = H.player_tables(parsed)
    assert H.wide_statistics(tables["statistics"], ["Yds", "Team"]).filter("page_id = 2").first().Team == "SEA"
    article = H.article_confidence(H.extract_article(parsed)).filter("page_id = 1").first()
    assert article.title == "Makers" and article.author == "Jo" and article.reading_time == 1
    assert parsed.filter("page_id = 3").first().error == "no html"


def test_line_scan(spark):
    docs = spark.createDataFrame([(1, "a\ntoken = \"abcdef0123456789\"\nx@y.org"), (2, "Licensed under MIT"), (3, None)], "doc_id long, text string")
    assert sorted((r.rule, r.doc_id, r.line) for r in LN.line_pattern_scan(docs).collect()) == [("email", 1, 3), ("license", 2, 1), ("secret", 1, 2)]


def test_ma_stats(spark):
    df = spark.createDataFrame([(True, 70, 5e6), (True, 30, None), (False, None, None)], "success boolean, confidence int, deal_value double")
    r = L.ma_stats(df).first()
    assert (r.total, r.successful, r.failed, r.ma_detected, r.deals_with_value) == (3, 2, 1, 1, 1) and L.ma_detected(df, 70).count() == 1


def test_error_report(spark):
    rows = [("h", "[500] Upstream 429")] * 28 + [("h", "[500] Circuit h is open")] * 7
    got = {(r.dim, r.value): (r.n, float(r.pct)) for r in L.error_log_report(spark.createDataFrame(rows, "host string, message string")).collect()}
    assert got[("message", "[500] Upstream 429")] == (28, 80.0) and got[("host", "h")] == (35, 100.0) and got[("status", "500")] == (35, 100.0)


def test_window_limit(spark):
    base = pd.Timestamp("2024-01-01")
    rows = [(f"h{i % 3}" if i % 7 else "hot", (base + pd.Timedelta(milliseconds=137 * i * (1 + i % 7))).to_pydatetime(), i) for i in range(400)] + [(None, base.to_pydatetime(), 400 + i) for i in range(8)]
    df = spark.createDataFrame(rows, "host string, ts timestamp, i int").repartition(5)
    got = {r.i: (r.allowed, r.remaining, r.retry_after_s) for r in OU.fixed_window_limit(df, "host", 5, 10_000, ("i",)).collect()}
    seen, want = {}, {}
    for host, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        ms = int(pd.Timestamp(ts).value // 10**6)
        n = seen[host, ms // 10_000] = seen.get((host, ms // 10_000), 0) + 1
        want[i] = (n <= 5, max(5 - n, 0), 0 if n <= 5 else -(-((ms // 10_000 + 1) * 10_000 - ms) // 1000))
    assert got == want


def test_window_limit_rounds_to_milliseconds(spark):
    at = [pd.Timestamp(f"2024-01-01 00:00:{t}").to_pydatetime() for t in ("01.999499", "01.999500", "02.000000", "09.999500")]
    df = spark.createDataFrame(list(zip("aaab", at, range(4))), "host string, ts timestamp, i int")
    got = {r.i: (r.allowed, r.remaining, r.retry_after_s) for r in OU.fixed_window_limit(df, "host", 0, 10_000, ("i",)).collect()}
    assert got == {0: (False, 0, 9), 1: (False, 0, 8), 2: (False, 0, 8), 3: (False, 0, 10)}  # the last is in the next window


def test_sources_and_sinks(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    with open(f"{d}/urls.txt", "w") as f:
        f.write("# list\n\n https://a.com \nhttps://b.com\n")
    assert [r.url for r in IO.read_url_list(spark, f"{d}/urls.txt").orderBy("idx").collect()] == ["https://a.com", "https://b.com"]
    df = spark.createDataFrame([("=1+1", 'say "hi", ok\nyes', 3)], "a string, b string, n int")
    IO.write_csv(df, f"{d}/csv")
    back = IO.read_company_csv(spark, f"{d}/csv").first()
    assert (back.a, back.b, back.n) == ("'=1+1", 'say "hi", ok\nyes', "3")
    with open(f"{d}/feed.xml", "w") as f:
        f.write('<rss><channel><item><title>T</title><link>https://a.com/1</link><pubDate>x</pubDate><description>D</description></item></channel><entry><title>E</title><link href="https://a.com/2"/><updated>2024</updated></entry></rss>')
    assert sorted(r.url for r in IO.read_feeds(spark, f"{d}/feed.xml", "s").collect()) == ["https://a.com/1", "https://a.com/2"]
    with open(f"{d}/map.xml", "w") as f:
        f.write("<urlset><url><loc>https://a.com/3</loc></url></urlset>")
    assert IO.read_sitemaps(spark, f"{d}/map.xml", "s").first().url == "https://a.com/3"
    os.mkdir(f"{d}/docs")
    with zipfile.ZipFile(f"{d}/docs/a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>One &amp; </w:t><w:t>two</w:t></w:r></w:p><w:p></w:p><w:p a='1'><w:t xml:space='preserve'>Three</w:t></w:p></w:document>")
    with open(f"{d}/docs/b.docm", "w") as f:
        f.write("x")
    got = sorted((r.path.rsplit("/", 1)[1], r.para_idx or 0, r.text, r.error is None) for r in IO.read_docx_paragraphs(spark, f"{d}/docs").collect())
    assert got == [("a.docx", 0, "One & two", True), ("a.docx", 1, "Three", True), ("b.docm", 0, None, False)]
    with open(f"{d}/players.json", "w") as f:
        f.write('{"players": [{"id": "1", "profile": {"name": "A"}}, {"id": "2"}]}')
    assert [r.raw.id for r in IO.read_players_json(spark, f"{d}/players.json").orderBy("player_idx").collect()] == ["1", "2"]


def test_streams_equal_batch(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    rows = [(f"https://a.com/{i % 5}?utm_source=x{i}", i % 3 != 0, "t", 1, "", i, i, f"s{i % 2}") for i in range(20)]
    df = spark.createDataFrame(rows, "url string, success boolean, title string, contentLength int, contentPreview string, processingTime long, timestamp long, sessionId string")
    df.limit(10).coalesce(1).write.json(f"{d}/in", mode="append")
    S.stream_results_to_table(spark, f"{d}/in", f"{d}/out", f"{d}/cp").awaitTermination()
    df.subtract(df.limit(10)).coalesce(1).write.json(f"{d}/in", mode="append")
    S.stream_results_to_table(spark, f"{d}/in", f"{d}/out", f"{d}/cp").awaitTermination()
    S.stream_results_to_table(spark, f"{d}/in", f"{d}/out", f"{d}/cp").awaitTermination()
    assert spark.read.parquet(f"{d}/out").count() == 20
    stream = IO.read_results_jsonl(spark, f"{d}/in", streaming=True).withColumn("ts", F.timestamp_millis("timestamp"))
    q = S.stream_dedupe_urls(stream).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 5
    counters = S.stream_request_counters(stream.select("ts", F.col("sessionId").alias("job_id"), "success", F.col("processingTime").cast("double").alias("response_time_ms")))
    q = counters.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.job_id: (r.total, r.failed) for r in spark.table("counted").collect()} == {"s0": (10, 4), "s1": (10, 3)}


def test_trivia_dataset(spark, sf_dir):
    from sparkloom.plans import queries as Q

    tables = P.trivia_dataset(Q.raw_players(spark, sf_dir), P.team_history(spark), spark.createDataFrame([], "code string, team_full string, team_abbrs string"), season_min=1990)
    seasons, players = tables["seasons"].cache(), tables["players"].cache()
    assert players.count() == players.select("player_id").distinct().count() > 0
    assert sum(tables[f"{p}_seasons"].count() for p in ("qb", "rb", "wr", "te")) == seasons.count()
    assert tables["eligibility"].count() == players.count()
    assert {r.check for r in tables["checks"].collect()} <= {"range"}


def test_rules_of_a_table_are_one_scan(spark):
    players = spark.createDataFrame([("a_1", "A"), ("a_1", ""), ("B", None)], "player_id string, full_name string")
    seasons = spark.createDataFrame([("a_1", 1996, 20.0, 3.0), ("c", 2000, None, 22.0), (None, 2000, 20.0, 3.0)], "player_id string, season int, age double, games double")
    checks = P.dataset_checks({"players": players, "seasons": seasons})
    assert checks._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 5
    assert sorted(tuple(map(str, r[:3])) for r in checks.collect()) == sorted([
        ("players", "pattern", "B"), ("players", "unique", "a_1"), ("players", "required", ""), ("players", "required", "None"), ("seasons", "range", "1996"), ("seasons", "range", "None"), ("seasons", "range", "22.0"),
        ("seasons", "required", "None"), ("seasons", "reference", "c"), ("seasons", "reference", "None"),
    ])


def test_statistics_that_are_there_are_read_once(spark):
    columns = ["player_id", "season", "age", "team_full", "team_abbrs", "games", "games_started", "awards", "multi_team"]
    rows = spark.createDataFrame([("WR", {"Yds": "1,234", "Rec": "x", "Att": ""}), ("WR", None)], "position string, stats map<string, string>").withColumns({c: F.lit(1) for c in columns})
    made = P.position_stats(rows, "WR")
    assert {(r.Yds, r.Rec, r.Att, r.Tgt) for r in made.collect()} == {(1234.0, 0.0, None, 0.0), (None, 0.0, None, 0.0)}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 3


def test_seasons_of_far_keys_stay_in_order(spark, tmp_path):
    from sparkloom.plans import queries as Q

    spark.sql("SELECT 1L AS c_custkey, 'A' AS c_name, 'x' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    orders = "SELECT id AS o_orderkey, 1L AS o_custkey, DATE'1995-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority, 5.0D AS o_totalprice FROM VALUES (6000000002L), (1L), (3000000000L) AS t(id)"
    spark.sql(orders).write.parquet(f"{tmp_path}/orders.parquet")
    assert [s.Age for s in Q.raw_players(spark, tmp_path).first().seasons] == ["21", "20", "22"]


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("idx"), "url")
    one, seven = (sorted(map(str, OU.url_intake(pages.repartition(n)).collect())) for n in (1, 7))
    assert one == seven
    assert U.normalize_url is not None


def test_contract_queries_read_the_whole_texts(spark, tmp_path):
    from sparkloom.plans import queries as Q

    rows = [(5, "Plain words.\n\nBoth parties keep it.\n\nThe term is 60 months, perpetual."), (11, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in Q.scl23_term_and_burden(spark, tmp_path).collect()) == [(5, 60, 46), (11, -1, 0)]
    assert [tuple(r) for r in Q.job9_contract_review(spark, tmp_path).select("doc_id", "clause_type", "operation").collect()] == [(5, "Term", "replace")]
    texts = {r.doc_id: r.text for r in Q.job10_apply_suggestions(spark, tmp_path).collect()}
    assert texts == {5: "Nothing here.\n\nPlain words.\n\nBoth parties keep it.\n\nThe term is 24 months, perpetual.", 11: "Nothing here."}
    assert {r.doc_id: r.score for r in Q.job11_playbook_review(spark, tmp_path).collect()} == {5: 12, 11: 12}
    assert [tuple(r) for r in Q.agg16_checklist_coverage(spark, tmp_path).select("doc_id", "term_ok").collect()] == [(5, True)]


def test_column_shape_counts_all_rows(spark):
    sheet = spark.range(1000).select(F.when(F.col("id") < 250, "plain").otherwise("https://a.example.com/x").alias("Link"))
    row = M.column_shape(sheet).first()
    assert (row.n, float(row.url_share), row.top_host) == (1000, 0.75, "a.example.com")
    assert M.column_shape(sheet, 200).first().n == 200


def test_summaries_fall_back_in_order(spark):
    rows = [("A", "a.com", "x" * 20 + " described at some length " * 2, "s", "p", "m", "i"), ("B", None, "", " s ", "p", "m", "i"), (None, "b.org", None, "", "p", "m", "i"), ("D", None, None, None, None, "", "i"), (None, None, None, None, None, None, None)]
    sheet = spark.createDataFrame(rows, "`Company Name` string, Website string, Description string, Specialties string, Products string, `End Markets` string, Industry string")
    got = [tuple(r) for r in OC.target_list(sheet).collect()]
    assert got[0][2].startswith("xxx") and [g[0] for g in got if g[1] != "https://b.org"] == ["A", "B", "D", "—"]
    assert got[3] == ("D", "—", "i") and got[4] == ("—", "—", OC.NO_DETAILS) and all(g[2] for g in got)


def test_source_of_url_keeps_every_row_once(spark):
    from sparkloom.operators import urls as OU

    df = spark.createDataFrame([("https://A.com/x",), ("https://A.com/x",), (None,), ("https://b.org",)], "url string").repartition(3)
    sources = spark.createDataFrame([("b", "b.org", 1), ("a", "a.com/x", 0), ("late", "a.com", 2), ("none", None, 3)], "key string, base_url string, pos int")
    assert sorted((r.url or "", r.source) for r in OU.source_of_url(df, sources).collect()) == [("", "custom"), ("https://A.com/x", "a"), ("https://A.com/x", "a"), ("https://b.org", "b")]
    with pytest.raises(ValueError):
        OU.source_of_url(df, sources, most=2)


def test_crawl_report_has_the_optional_sections(spark):
    from sparkloom.operators import crawl_logs as L

    rows = [("https://a.com/1", True, False, 5.0, None, 3, None), ("https://a.com/page/2", False, False, 7.0, "[500] x", None, "HTTP_500"), ("https://b.com/", False, False, 9.0, "timeout", 0, "TIMEOUT")]
    df = spark.createDataFrame(rows, "url string, success boolean, skipped boolean, response_time double, error string, n_companies int, error_type string")
    got = {(r.section, r.key): (r.n, r.value) for r in L.crawl_report(df).collect()}
    assert got["companies", "average"] == (3, 3.0) and got["retry", "TIMEOUT"] == (1, 0.0) and got["error_pattern", "server_error 500"] == (1, None)
    assert got["host", "a.com"] == (1, 50.0) and got["status", "500"] == (1, 50.0) and got["time", "median"] == (None, 7.0) and got["pattern", "/page/*"] == (1, 1.0)
    empty = {(r.section, r.key): (r.n, r.value) for r in L.crawl_report(df.limit(0)).collect()}
    assert empty["summary", "total"] == (None, 0.0) and empty["category", "timeout"] == (0, None) and empty["time", "median"] == (None, None) and empty["companies", "average"] == (0, 0.0)
    assert {r.category: (r.n, r.examples) for r in L.errors_by_category(df).collect()} == {"server_error": (1, ["https://a.com/page/2"]), "timeout": (1, ["https://b.com/"])}


def test_crawl_report_scans_once(spark, monkeypatch):
    """All sections come from what one aggregate over the results stored."""
    frames, stored = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: frames.append(df) or stored(df, name))
    df = spark.createDataFrame([("https://a.com/1", True, False, 5.0, None)], "url string, success boolean, skipped boolean, response_time double, error string")
    L.crawl_report(df)
    assert len(frames) == 1 and "Expand" in frames[0]._jdf.queryExecution().executedPlan().toString()


def test_upper_median(spark):
    import random

    from sparkloom.operators import ordered

    rnd = random.Random(5)
    rows = [(rnd.choice("aaaaaabc") if rnd.random() < 0.9 else None, rnd.choice([None, 1.5, 2.0, rnd.random()])) for _ in range(4001)] + [("none", None)]
    got = {r.k: r.v for r in ordered.upper_median(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v").collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: sorted(v)[len(v) // 2] for k, v in groups.items()}
    assert ordered.upper_median(spark.createDataFrame(rows, "k string, v double"), [], "v").first().v == sorted(v for _, v in rows if v is not None)[sum(len(v) for v in groups.values()) // 2]


def test_trailing_counts_of_a_hot_key(spark):
    import random

    rnd = random.Random(6)
    rows = [("hot" if rnd.random() < 0.8 else rnd.choice(["a", None]), rnd.choice([rnd.randint(-5000, 5000), 77, 78, None]), i) for i in range(2500)]
    df = spark.createDataFrame(rows, "host string, ms long, i int").withColumn("ts", F.timestamp_millis("ms")).repartition(6)
    got = {r.i: (r.n_window, r.n_burst) for r in OU.requests_in_window(df, "host", "ts", 600, 50).collect()}
    near = lambda h, t, span: sum(k == h and (u is None if t is None else u is not None and t - span < u <= t) for k, u, _ in rows)
    assert got == {i: (near(h, t, 600), near(h, t, 50)) for h, t, i in rows}


def test_progress_of_a_hot_batch(spark):
    df = spark.range(3000).select(F.lit("b").alias("batch"), F.col("id").alias("i"), (F.col("id") % 3 != 0).alias("success")).repartition(7)
    got = sorted((r.i, r.completed, r.errors, r.percent) for r in L.progress(df, "batch", ["i"]).collect())
    assert got == [(i, i + 1, i // 3 + 1, int((i + 1) / 30 + 0.5)) for i in range(3000)]


def test_evidence_is_cut_from_around_the_first_match(spark):
    """The same as one pattern with 160 characters on either side, which is slow on long texts."""
    import random
    import re

    from sparkloom.functions import contracts as K

    rnd = random.Random(8)
    words = ["Term", "perpetual", "alpha", "beta.", "line\n", "PERPETUAL"]
    texts = [" ".join(rnd.choice(words if i % 3 else words[2:5]) for _ in range(rnd.choice([5, 60, 400]))) for i in range(60)] + [None, "", "x" * 5000 + "term" + "y" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = [{"id": "a", "require": ["/\\bterm\\b/i"], "forbid": ["perpetual"]}, {"id": "b", "forbid": ["Perpetual"]}, {"id": "c"}]
    got = {(r.doc_id, r.rule_id): (r.status, r.evidence) for r in K.evaluate_playbook(docs, rules).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        term, gone = re.search(r"(?i)\bterm\b", text), re.search("(?i)perpetual", text)
        near = lambda p: (m := re.search(f"(?is)(.{{0,160}}(?:{p}).{{0,160}})", text)) and re.sub(r"\s+", " ", m[1]).strip() or None
        assert got[i, "a"] == ("pass" if term and not gone else "fail", near(r"\bterm\b") if len(text) < 9000 else None)
        assert got[i, "b"] == ("fail" if gone else "pass", near("perpetual")) and got[i, "c"] == ("review", None)


def test_section_coverage(spark):
    from sparkloom.functions import contracts as K

    docs = spark.createDataFrame([(1, "Both use best  efforts; the liability is perpetual. " + "z" * 100), (2, None), (3, "Courts of a proprietary kind; terms, indemnif")], "doc_id long, text string")
    got = {r.doc_id: (r.score, {k for k, v in r.sections.items() if v}, [(i.id, i.severity, i.context) for i in r.issues]) for r in K.section_coverage(docs).collect()}
    whole = docs.first().text
    assert got[1] == (80, {"Limitation of Liability"}, [("fb-best-efforts", 60, whole[:49].strip()), ("fb-term-perpetual", 80, whole[1:81].strip())])
    assert got[2] == (100, set(), []) and got[3] == (100, {"Confidentiality", "Governing Law", "Indemnification"}, [])

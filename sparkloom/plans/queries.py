"""Queries over the given tables: each applies one operator; ORACLE has its SQL, written from the meaning alone."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import companies as C, contracts as K, html as H, news as N, text as T, urls as U
from ..shared import dealt, fresh_path, spread, stored
from ..sources import io as IO
from ..operators import companies as OC, crawl_logs as L, lines as LN, mapping as M, players as P, robots as R, urls as OU
from ..streaming import stateful as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- URLs over pages.url; some made invalid by page_id so that every verdict occurs

_ODD = """CASE WHEN page_id % 11 = 0 THEN replace(replace(url, 'https://', 'ftp://'), 'http://', 'ftp://') WHEN page_id % 13 = 0 THEN replace(replace(url, 'https://', ''), 'http://', '')
          WHEN page_id % 17 = 0 THEN 'http://localhost/x' ELSE url END"""
_RX = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\s]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PARTS = f"""SELECT *, lower(regexp_extract(u, '{_RX}', 1)) AS sch, lower(regexp_extract(u, '{_RX}', 2)) AS hst, CASE WHEN regexp_extract(u, '{_RX}', 4) = '' THEN '/' ELSE regexp_extract(u, '{_RX}', 4) END AS pth,
  regexp_extract(u, '{_RX}', 5) AS qry, regexp_extract(u, '{_RX}', 6) AS frg, regexp_matches(u, '{_RX}') AS ok"""
_DROP = ", ".join(f"'{p}'" for p in U.TRACKING)
_KEPT = f"array_to_string(list_filter(string_split(qry, '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN ({_DROP})), '&')"
_NORM = f"(sch || '://' || hst || pth || CASE WHEN {_KEPT} = '' THEN '' ELSE '?' || {_KEPT} END)"
_WEB = "(ok AND sch IN ('http', 'https'))"


def odd_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_ODD).alias("url"))


def twin_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL and its http or https twin under https, so that there are duplicates."""
    pages = table(spark, sf_dir, "pages")
    twins = pages.select((F.col("page_id") * 2 + 1).alias("idx"), F.regexp_replace("url", "^http://", "https://").alias("url"))
    return pages.select((F.col("page_id") * 2).alias("idx"), "url").union(twins)


_TWINS = "SELECT page_id * 2 AS idx, url AS u FROM pages UNION ALL SELECT page_id * 2 + 1, CASE WHEN starts_with(url, 'http://') THEN 'https://' || substr(url, 8) ELSE url END FROM pages"


@query(f"WITH p AS ({_PARTS} FROM (SELECT page_id, url AS u FROM pages)) SELECT page_id, {_NORM} AS normalized FROM p")
def url1_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_url(F.col("url")).alias("normalized"))


_CATEGORY = "CASE WHEN regexp_matches(u, '^(?i)https?:') AND NOT ok OR NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.\\-]*:[^\\s]') THEN 'malformed' WHEN NOT regexp_matches(u, '^(?i)https?:') THEN 'invalid_protocol' ELSE 'valid' END"


@query(f"WITH p AS ({_PARTS} FROM (SELECT page_id, {_ODD} AS u FROM pages)) SELECT page_id, {_CATEGORY} AS category, CASE WHEN {_WEB} THEN {_NORM} END AS normalized FROM p")
def url2_validate(spark, sf_dir):
    return OU.validate_urls(odd_urls(spark, sf_dir)).select("page_id", "category", "normalized")


_EDROP = ", ".join(f"'{p}'" for p in U.TRACKING_ENHANCED)
_EKEPT = f"array_to_string(list_filter(string_split(qry, '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN ({_EDROP})), '&')"


@query(f"""WITH s AS (SELECT page_id, {_ODD} AS raw FROM pages), p AS ({_PARTS} FROM (SELECT page_id, CASE WHEN regexp_matches(raw, '^https?://') THEN raw ELSE 'https://' || raw END AS u FROM s)),
  f AS (SELECT page_id, CASE WHEN ok THEN sch || '://' || hst || CASE WHEN pth <> '/' THEN regexp_replace(pth, '/$', '') ELSE pth END || CASE WHEN {_EKEPT} = '' THEN '' ELSE '?' || {_EKEPT} END END AS formatted, CASE WHEN ok THEN replace(hst, 'www.', '') END AS domain FROM p)
  SELECT page_id, formatted, domain, CASE WHEN formatted IS NULL THEN 'malformed' WHEN domain = 'localhost' OR length(domain) < 3 THEN 'invalid_domain' ELSE 'valid' END AS category FROM f""")
def url3_validate_enhanced(spark, sf_dir):
    return OU.validate_urls_enhanced(odd_urls(spark, sf_dir)).select("page_id", "formatted", "domain", "category")


@query(f"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.pro-football-reference.com/players/M/MahoPa' || lpad((page_id % 100)::VARCHAR, 2, '0') || '.htm' WHEN 1 THEN 'https://www.pro-football-reference.com/players/S/SpilC.00.htm'
    WHEN 2 THEN 'https://www.pro-football-reference.com/teams/kan/' WHEN 3 THEN url ELSE 'x ' || url END AS u FROM pages), p AS ({_PARTS} FROM u)
  SELECT page_id, CASE WHEN NOT ok OR sch NOT IN ('http', 'https') THEN 'malformed' WHEN NOT regexp_matches(hst, '(^|\\.)(pro-football|basketball|baseball|hockey|sports)-reference\\.com$') THEN 'wrong_domain'
    WHEN regexp_matches(pth, '^/players/[A-Z]/[A-Za-z]{{4}}[A-Z][a-z][0-9]{{2}}\\.htm$') THEN 'valid' WHEN regexp_matches(pth, '/(teams|years|coaches|officials)/') THEN 'non_player' ELSE 'invalid_slug' END AS category FROM p""")
def url4_player_urls(spark, sf_dir):
    shaped = """CASE page_id % 5 WHEN 0 THEN concat('https://www.pro-football-reference.com/players/M/MahoPa', lpad(cast(page_id % 100 as string), 2, '0'), '.htm')
      WHEN 1 THEN 'https://www.pro-football-reference.com/players/S/SpilC.00.htm' WHEN 2 THEN 'https://www.pro-football-reference.com/teams/kan/' WHEN 3 THEN url ELSE concat('x ', url) END"""
    return OU.validate_player_urls(table(spark, sf_dir, "pages").select("page_id", F.expr(shaped).alias("url"))).select("page_id", "category")


@query(f"""WITH p AS ({_PARTS} FROM ({_TWINS})), n AS (SELECT idx, {_NORM} AS normalized FROM p)
  SELECT idx, normalized, min(idx) OVER (PARTITION BY normalized) AS first_idx, CASE WHEN idx = min(idx) OVER (PARTITION BY normalized) THEN 'valid' ELSE 'duplicate' END AS status FROM n""")
def url5_dedupe(spark, sf_dir):
    rows = twin_urls(spark, sf_dir)
    return OU.dedupe_urls(rows.withColumn("normalized", U.normalize_url(F.col("url")))).select("idx", "normalized", "first_idx", "status")


@query("""WITH s AS (SELECT page_id AS idx, url, CASE page_id % 4 WHEN 0 THEN replace(replace(url, 'https://', 'https://https://'), 'http://', 'http://http://') WHEN 1 THEN url || '//' WHEN 2 THEN replace(url, '://', '://www.www.') ELSE url END AS original FROM pages),
  a AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN idx % 4 = 2 THEN regexp_replace(replace(url, '://', '://www.'), '(www\\.)+', 'www.', 'g') ELSE url END, '^https?://', 'https://'), '/+$', '') AS cleaned FROM s)
  SELECT idx, original, cleaned, original <> cleaned AS was_changed, CASE WHEN NOT (regexp_matches(cleaned, '^https://([^/?#]*\\.)?example\\.com([/?#]|$)')) THEN 'Unsupported domain' END AS error,
  regexp_matches(cleaned, '^https://([^/?#]*\\.)?example\\.com([/?#]|$)') AND idx <> min(CASE WHEN regexp_matches(cleaned, '^https://([^/?#]*\\.)?example\\.com([/?#]|$)') THEN idx END) OVER (PARTITION BY cleaned) AS is_dup FROM a""")
def url6_repair(spark, sf_dir):
    bad = """CASE page_id % 4 WHEN 0 THEN replace(replace(url, 'https://', 'https://https://'), 'http://', 'http://http://') WHEN 1 THEN concat(url, '//') WHEN 2 THEN replace(url, '://', '://www.www.') ELSE url END"""
    return OU.repair_urls(table(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), F.expr(bad).alias("url")), ("example.com",))


@query(f"""WITH p AS ({_PARTS} FROM (SELECT page_id, url AS u FROM pages)), q AS (SELECT page_id, u, sch, hst, CASE WHEN pth = '/' THEN '/' ELSE regexp_replace(pth, '/$', '') END AS np, CASE WHEN qry <> '' THEN '?' || qry ELSE '' END || CASE WHEN frg <> '' THEN '#' || frg ELSE '' END AS tl FROM p),
  v AS (SELECT page_id, u, unnest([
    {{'k': 0, 'x': CASE WHEN sch = 'http' THEN 'https://' || hst || np || tl END}}, {{'k': 1, 'x': CASE WHEN NOT starts_with(hst, 'www.') THEN 'https://www.' || hst || np || tl END}},
    {{'k': 2, 'x': CASE WHEN sch = 'http' THEN 'https://' || hst || CASE WHEN np = '/' THEN '/' ELSE np || '/' END || tl END}}, {{'k': 3, 'x': CASE WHEN sch = 'http' AND NOT starts_with(hst, 'www.') THEN 'https://www.' || hst || CASE WHEN np = '/' THEN '/' ELSE np || '/' END || tl END}},
    {{'k': 4, 'x': CASE WHEN starts_with(hst, 'www.') THEN sch || '://' || substr(hst, 5) || np || tl END}}, {{'k': 5, 'x': CASE WHEN sch = 'http' AND starts_with(hst, 'www.') THEN 'https://' || substr(hst, 5) || np || tl END}}]) AS s FROM q),
  d AS (SELECT page_id, s.x AS variant, min(s.k) AS k FROM v WHERE s.x IS NOT NULL AND s.x <> u GROUP BY 1, 2) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, variant FROM d""")
def url7_variants(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(U.url_variants(F.col("url"))).alias("pos", "variant")).withColumn("pos", F.col("pos").cast("long"))


@query("""WITH h AS (SELECT DISTINCT url FROM pages WHERE starts_with(url, 'http://')) SELECT url, 'https://' || CASE WHEN regexp_matches(url, '^http://[^/?#]+/?$') THEN substr(url, 8) ELSE regexp_replace(substr(url, 8), '^([^?#]*?)/?([?#].*)?$', '\\1\\2') END AS canonical_url, 0::BIGINT AS pos FROM h""")
def url8_resolve_variants(spark, sf_dir):
    failed = table(spark, sf_dir, "pages").filter("startswith(url, 'http://')").select("url").distinct()
    good = failed.select(F.element_at(U.url_variants(F.col("url")), 1).alias("url"))
    return OU.resolve_variants(failed, good).withColumn("pos", F.col("pos").cast("long"))


@query("""WITH o AS (SELECT event_id, (user_id * 7 % 256)::INT AS a, (event_id % 256)::INT AS b FROM events) SELECT event_id, a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19)) AS blocked FROM o""")
def url9_blocked_host(spark, sf_dir):
    host = F.concat_ws(".", F.col("user_id") * 7 % 256, F.col("event_id") % 256, F.lit(3), F.lit(4))
    return table(spark, sf_dir, "events").select("event_id", U.blocked_host(host).alias("blocked"))


@query("SELECT page_id, regexp_replace(url || '/page/' || page_id, '/page/[0-9]+', '/page/*', 'g') AS pattern FROM pages")
def url10_page_pattern(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.page_pattern(F.concat("url", F.lit("/page/"), "page_id")).alias("pattern"))


@query("SELECT page_id, regexp_replace(url, '/+$', '') || '/page/' || n AS page_url FROM pages, unnest(range(2, least(page_id % 12, 8) + 1)) AS t(n)")
def url11_expand_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("total_pages", F.col("page_id") % 12)
    return OU.expand_pages(pages.select("page_id", "url", "total_pages"), 8).select("page_id", "page_url")


@query(f"""WITH p AS ({_PARTS} FROM (SELECT page_id, url AS u FROM pages)) SELECT page_id, CASE page_id % 3 WHEN 0 THEN sch || '://' || hst || '/a' WHEN 1 THEN sch || '://cdn.example.com/b' ELSE sch || '://' || hst || regexp_replace(pth, '[^/]*$', '') || 'c.html' END AS link FROM p""")
def url12_resolve_link(spark, sf_dir):
    href = F.expr("CASE page_id % 3 WHEN 0 THEN '/a' WHEN 1 THEN '//cdn.example.com/b' ELSE './c.html' END")
    return table(spark, sf_dir, "pages").select("page_id", U.resolve_link(href, F.col("url")).alias("link"))


@query(f"""WITH p AS ({_PARTS} FROM (SELECT page_id, url AS u FROM pages)), l AS (SELECT page_id, string_split(regexp_replace(hst, '^www\\.', ''), '.') AS x FROM p)
  SELECT page_id, array_to_string(list_transform(list_filter(regexp_split_to_array(x[greatest(len(x) - 1, 1)], '[-_]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM l""")
def url13_domain_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.domain_name(F.col("url")).alias("name"))


_SOURCES = [("farm", "spam-farm.example.org", 0), ("mobile", "://m.", 1), ("blog", "://blog.", 2), ("com", ".example.com", 3)]


@query("""SELECT page_id, CASE WHEN contains(lower(url), 'spam-farm.example.org') THEN 'farm' WHEN contains(lower(url), '://m.') THEN 'mobile' WHEN contains(lower(url), '://blog.') THEN 'blog' WHEN contains(lower(url), '.example.com') THEN 'com' ELSE 'custom' END AS source FROM pages""")
def url14_source_of_url(spark, sf_dir):
    sources = spark.createDataFrame(_SOURCES, "key string, base_url string, pos int")
    return OU.source_of_url(table(spark, sf_dir, "pages").select("page_id", "url"), sources).select("page_id", "source")


@query(f"WITH p AS ({_PARTS} FROM (SELECT page_id, {_ODD} AS u FROM pages)) SELECT {_CATEGORY} AS category, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM p")
def url15_summary(spark, sf_dir):
    return OU.validation_summary(OU.validate_urls(odd_urls(spark, sf_dir)))


@query(f"""WITH p AS ({_PARTS} FROM (SELECT page_id, {_ODD} AS u FROM pages)), c AS (SELECT page_id, CASE WHEN {_CATEGORY} = 'valid' AND hst = 'localhost' THEN 'private_host' ELSE {_CATEGORY} END AS category, {_NORM} AS nrm FROM p),
  n AS (SELECT page_id, category, CASE WHEN category = 'valid' THEN nrm END AS normalized FROM c), f AS (SELECT normalized, min(page_id) AS first_idx FROM n WHERE normalized IS NOT NULL GROUP BY 1)
  SELECT page_id AS idx, category, n.normalized, coalesce(first_idx, -1) AS first_idx, CASE WHEN n.normalized IS NULL THEN 'invalid' WHEN first_idx = page_id THEN 'valid' ELSE 'duplicate' END AS status FROM n LEFT JOIN f ON n.normalized = f.normalized""")
def job1_url_intake(spark, sf_dir):
    rows = odd_urls(spark, sf_dir).withColumnRenamed("page_id", "idx")
    return OU.url_intake(rows).select("idx", "category", "normalized", F.coalesce("first_idx", F.lit(-1).cast("long")).alias("first_idx"), "status")


@query("""WITH s AS (SELECT page_id AS idx, url, CASE page_id % 4 WHEN 0 THEN replace(replace(url, 'https://', 'https://https://'), 'http://', 'http://http://') WHEN 1 THEN url || '//' WHEN 2 THEN replace(url, '://', '://www.www.') ELSE url END AS original FROM pages),
  a AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN idx % 4 = 2 THEN regexp_replace(replace(url, '://', '://www.'), '(www\\.)+', 'www.', 'g') ELSE url END, '^https?://', 'https://'), '/+$', '') AS cleaned FROM s),
  n AS (SELECT *, regexp_matches(cleaned, '^https://([^/?#]*\\.)?example\\.com([/?#]|$)') AS fits FROM a) SELECT 'repair' AS section, 'total' AS key, count(*) AS n FROM n UNION ALL SELECT 'repair', 'changed', count(*) FILTER (original <> cleaned) FROM n UNION ALL SELECT 'repair', 'unsupported', count(*) FILTER (NOT fits) FROM n
  UNION ALL SELECT 'category', 'valid', count(*) FROM n UNION ALL SELECT 'status', CASE WHEN first THEN 'valid' ELSE 'duplicate' END, count(*) FROM (SELECT idx = min(idx) OVER (PARTITION BY regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(cleaned, '^https://[^/?#]+')) || substr(cleaned, length(regexp_extract(cleaned, '^https://[^/?#]+')) + 1), '#.*$', ''), '([?&])(utm_source|ref)=[^&#]*', '\\1'), '[?&]+$', '')) AS first FROM n) GROUP BY 2""")
def job1_intake_report(spark, sf_dir):
    bad = """CASE page_id % 4 WHEN 0 THEN replace(replace(url, 'https://', 'https://https://'), 'http://', 'http://http://') WHEN 1 THEN concat(url, '//') WHEN 2 THEN replace(url, '://', '://www.www.') ELSE url END"""
    return OU.intake_report(table(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), F.expr(bad).alias("url")), ("example.com",))


@query(f"""WITH p AS ({_PARTS} FROM ({_TWINS})), n AS (SELECT DISTINCT hst AS host, {_NORM} AS normalized FROM p) SELECT host, count(*) AS unique_pages FROM n GROUP BY 1""")
def url_host_summary(spark, sf_dir):
    rows = twin_urls(spark, sf_dir).select(U.host(F.col("url")).alias("host"), U.normalize_url(F.col("url")).alias("normalized"))
    return rows.distinct().groupBy("host").agg(F.count(F.lit(1)).alias("unique_pages"))


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def set2_remaining_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return OU.remaining_urls(pages, pages.filter("page_id % 3 = 0")).select("page_id", "url")


@query("""WITH f AS (SELECT 1 AS part, page_id AS idx, url, 'a' || page_id AS title FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 2, page_id, url, 'b' || page_id FROM pages UNION ALL SELECT 0, page_id, url, 'm' || page_id FROM pages WHERE page_id % 5 = 0)
  SELECT url, coalesce(arg_min(title, idx) FILTER (WHERE part = 0), arg_max(title, part * 1000000000 + idx) FILTER (WHERE part > 0)) AS title FROM f GROUP BY url""")
def set1_merge_discovered(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rows = lambda tag: pages.select(F.col("page_id").alias("idx"), "url", F.concat(F.lit(tag), "page_id").alias("title"), F.lit("").alias("date"), F.lit("").alias("description"), F.lit(tag).alias("source"))
    return OU.merge_discovered(rows("m").filter("idx % 5 = 0"), rows("a").filter("idx % 2 = 0"), rows("b")).select("url", "title")


# ---- robots: rules made for each host of pages, one in three with a section of its own

@query(f"""WITH p AS ({_PARTS} FROM (SELECT page_id, url AS u FROM pages)) SELECT page_id, CASE WHEN length(hst) % 3 = 0 THEN NOT starts_with(pth, '/en/') OR regexp_matches(pth, '^/en/.*5') WHEN length(hst) % 3 = 1 THEN NOT starts_with(pth, '/fr') ELSE true END AS allowed FROM p""")
def jon2_robots_filter(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"))
    text = F.when(F.length("host") % 3 == 0, "User-agent: *\nDisallow: /en/\nAllow: /en/*5\n").when(F.length("host") % 3 == 1, "# none\nUser-agent: other\nDisallow: /\nUser-agent: LoomBot\nDisallow: /fr\n").otherwise("User-agent: nobody\nDisallow: /")
    rules = R.parse_robots(urls.select("host").distinct().withColumn("content", text), "loombot/1.0")
    return R.robots_filter(urls, rules).select("page_id", "allowed")


# ---- HTML

_STRIP = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"""


@query(f"SELECT page_id, trim(regexp_replace({_STRIP}, '[\\t\\n\\v\\f\\r \\x{{A0}}]+', ' ', 'g')) AS text, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\\t\\n\\v\\f\\r ]+', ' ', 'g')) AS title FROM pages")
def htm1_strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.strip_html(F.col("html")).alias("text"), H.html_title(F.col("html")).alias("title"))


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


@query()
def htm2_content_type(spark, sf_dir):
    return H.content_type(H.parse_pages(stored_pages(spark, sf_dir), parts=("marks",))).select("page_id", "type", "score")


@query()
def htm3_extract_article(spark, sf_dir):
    out = H.article_confidence(H.extract_article(H.parse_pages(stored_pages(spark, sf_dir), parts=H.FOR_ARTICLES), max_len=None, tags=None, images=None))
    return out.withColumn("tags", F.array_join("tags", "|")).withColumn("images", F.to_json("images"))


@query()
def htm5_extract_links(spark, sf_dir):
    return H.extract_links(H.parse_pages(stored_pages(spark, sf_dir), parts=("links",)), cap=None)


@query()
def htm6_extract_headings(spark, sf_dir):
    return H.extract_headings(H.parse_pages(stored_pages(spark, sf_dir), parts=("headings",)), cap=None, longest=None)


@query()
def htm12_main_content(spark, sf_dir):
    return H.main_content_score(H.parse_pages(stored_pages(spark, sf_dir), parts=("blocks",))).select("page_id", "method", "score", "text")


# ---- scalar functions over customer, supplier, part

_MONEY = "CASE c_custkey % 4 WHEN 0 THEN '$' || c_custkey || ',500.25' WHEN 1 THEN '$' || c_custkey || '.5M' WHEN 2 THEN c_custkey || 'K' ELSE 'n/a' END"


@query(f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey * 1000 + 500.25 WHEN 1 THEN (c_custkey + 0.5) * 1000000 WHEN 2 THEN c_custkey * 1000.0 END::DOUBLE AS amount, ('(' || lpad((200 + c_custkey % 700)::VARCHAR, 3, '0') || ') 555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')) AS phone,
  upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Group''S' AS titled, lower(c_mktsegment) || '_ab' AS slug, CASE WHEN c_acctbal < 0 THEN '''-' ELSE '+'[1:0] || '''+' END AS safe FROM customer""")
def scl1_transforms(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    digits = F.concat(F.lpad((200 + F.col("c_custkey") % 700).cast("string"), 3, "0"), F.lit("555"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))
    return c.select(
        "c_custkey", T.currency_to_float(F.expr(_MONEY.replace("||", "||"))).alias("amount"), T.normalize_phone(digits).alias("phone"), T.title_case(F.concat("c_mktsegment", F.lit(" group's"))).alias("titled"),
        T.slugify(F.concat("c_mktsegment", F.lit(" A.B!"))).alias("slug"), T.sanitize_formula(F.when(F.col("c_acctbal") < 0, "-").otherwise("+")).alias("safe"),
    )


@query("""WITH n AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS b FROM part), l AS (SELECT *, greatest(length(a), length(b)) AS m, least(length(a), length(b)) AS s FROM n)
  SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 ELSE greatest(CASE WHEN (contains(a, b) OR contains(b, a)) AND s > 0 THEN 0.8 * s / m ELSE 0 END, (m - levenshtein(a, b))::DOUBLE / m) END, 4)::DOUBLE AS similarity FROM l""")
def scl2_header_similarity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.header_similarity(F.col("p_name"), F.col("p_type")), 4).alias("similarity"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS number, (year(o_orderdate) % 5 = 0) AS summary, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def scl3_numbers_and_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.format_number("o_totalprice", 2), F.lit("%"))
    season = F.when(F.year("o_orderdate") % 5 == 0, "Career").otherwise(F.year("o_orderdate").cast("string"))
    return o.select("o_orderkey", T.coerce_number(text).alias("number"), T.is_summary_row(season).alias("summary"), T.parse_birthdate(F.date_format("o_orderdate", "MMMM d"), F.date_format("o_orderdate", "yyyy")).alias("day"))


@query("""WITH s AS (SELECT p_partkey, list_filter([p_name, p_brand, upper(p_name), p_type], lambda x: x <> '') AS items FROM part), k AS (SELECT p_partkey, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM s), f AS (SELECT p_partkey, lower(item) AS lo, arg_min(item, i) AS item, min(i) AS i FROM k GROUP BY 1, 2)
  SELECT p_partkey, string_agg(item, '|' ORDER BY i) AS items FROM f GROUP BY 1""")
def scl10_parse_listlike(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat("p_name", F.lit("; "), "p_brand", F.lit(" , "), F.upper("p_name"), F.lit(" | "), "p_type")
    return p.select("p_partkey", F.array_join(T.parse_listlike(text), "|").alias("items"))


_FIELD = "CASE p_partkey % 6 WHEN 0 THEN 'cloud software' WHEN 1 THEN 'freight and shipping' WHEN 2 THEN 'solar power' WHEN 3 THEN 'claims handling' WHEN 4 THEN 'real estate leasing' ELSE p_name END"


@query(f"""WITH t AS (SELECT p_partkey, lower({_FIELD}) AS t FROM part) SELECT p_partkey, CASE WHEN regexp_matches(t, 'claims|insurance|underwriting|premium|policy') THEN 'insurance' WHEN regexp_matches(t, 'software|technology|digital|saas|cloud') THEN 'technology'
  WHEN regexp_matches(t, 'logistics|transportation|shipping|freight') THEN 'logistics' WHEN regexp_matches(t, 'solar|energy|wind|electric') THEN 'energy' WHEN regexp_matches(t, 'real estate|property|leasing') THEN 'realestate' ELSE 'general' END AS industry FROM t""")
def scl19_detect_industry(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.detect_industry(F.expr(_FIELD)).alias("industry"))


@query("SELECT s_suppkey, 'https://www.acme' || s_suppkey || '.com' AS site, CASE WHEN s_suppkey % 3 = 2 THEN 'Supplier ' ELSE 'Supplier' END || '#' || lpad(s_suppkey::VARCHAR, 9, '0') AS name FROM supplier WHERE s_suppkey % 3 <> 2 UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier WHERE s_suppkey % 3 = 2")
def scl9_canonical_website(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    link = F.expr("CASE s_suppkey % 3 WHEN 0 THEN concat('https://app.sourcescrub.com/?url=https%3A%2F%2Fwww.acme', s_suppkey, '.com%2Fabout') WHEN 1 THEN concat('www.acme', s_suppkey, '.com/x?y=1') ELSE concat('https://app.sourcescrub.com/companies/', s_suppkey) END")
    name = C.clean_company_name(F.concat("s_name", F.expr("CASE s_suppkey % 2 WHEN 0 THEN ', Inc.' ELSE ' (Holding)' END")))
    return s.select("s_suppkey", U.canonical_website(link).alias("site"), name.alias("name"))


# ---- deals and lines over documents, with phrases put in by doc_id

_DEAL = """CASE doc_id % 4 WHEN 0 THEN 'Acme Corp. acquired Beta Holdings for $' || (1 + doc_id % 9) || '.5 million on March ' || (1 + doc_id % 28) || ', 2024. ' WHEN 1 THEN 'A merger worth $' || (1 + doc_id % 9) || ' billion. ' WHEN 2 THEN 'They invest funding. ' ELSE '' END"""


def deal_docs(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "source", F.concat(F.expr(_DEAL), F.coalesce("text", F.lit(""))).alias("text"))


def _occurs(word: str) -> str:
    return f"((length(t) - length(replace(t, '{word}', ''))) // {len(word)})"


_KINDS = [(kind, w) for kind, ws in N.DEAL_KEYWORDS.items() for w in ws]
_TYPE = "list_max([" + ", ".join(f"{{'n': {_occurs(w)}, 'at': {-i}, 'kind': '{kind}'}}" for i, (kind, w) in enumerate(_KINDS)) + "])"


@query(f"""WITH d AS (SELECT doc_id, {_DEAL} || coalesce(text, '') AS x, lower({_DEAL} || coalesce(text, '')) AS t FROM documents), k AS (SELECT *, {_TYPE} AS b FROM d)
  SELECT doc_id, list_max(list_transform(regexp_extract_all(x, '(?i)(?:\\$|(?:USD|valued at|consideration of|worth|for|approximately)\\s*\\$?)([0-9,]+\\.?[0-9]*\\s*(?:billion|million|[MB]))', 1), lambda a: TRY_CAST(replace(regexp_extract(a, '^[0-9,]+\\.?[0-9]*'), ',', '') AS DOUBLE) * CASE WHEN regexp_matches(a, '(?i)b[a-z]*$') THEN 1e9 ELSE 1e6 END)) AS deal_value, CASE WHEN b.n > 0 THEN b.kind ELSE 'unknown' END AS transaction_type, {" OR ".join(f"contains(t, '{w}')" for w in N.MA_WORDS)} AS related FROM k""")
def scl12_deal_values(spark, sf_dir):
    t = F.col("text")
    return deal_docs(spark, sf_dir).select("doc_id", N.deal_value(t, letters=True).alias("deal_value"), N.transaction_type(t).alias("transaction_type"), N.ma_related(t).alias("related"))


_MONTH_NAMES = "January|February|March|April|May|June|July|August|September|October|November|December"
_SAID_DATES = f"""list_transform(regexp_extract_all(x, '((?:{_MONTH_NAMES}) +[0-9]{{1,2}},? +[0-9]{{4}})', 1), lambda d: coalesce(try_strptime(d, '%B %d, %Y'), try_strptime(d, '%B %d %Y'))) || list_transform(regexp_extract_all(x, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), lambda d: try_strptime(d, '%Y-%m-%d'))
  || list_transform(regexp_extract_all(x, '([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}})', 1), lambda d: coalesce(try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%m/%d/%y')))"""


@query(f"SELECT doc_id, strftime(list_max({_SAID_DATES}), '%Y-%m-%d') AS newest FROM (SELECT doc_id, {_DEAL} || coalesce(text, '') AS x FROM documents)")
def scl14_extract_dates(spark, sf_dir):
    return deal_docs(spark, sf_dir).select("doc_id", F.try_element_at(N.extract_dates(F.col("text")), F.lit(1))["parsed"].cast("string").alias("newest"))


_FOUND = "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0"


@query(f"""WITH f AS ({_FOUND}) SELECT count(*) AS total, count(*) FILTER (doc_id % 7 <> 0) AS successful, count(*) FILTER (doc_id % 7 = 0) AS failed, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 4 IN (0, 1)) AS deals_with_value FROM f""")
def job6_ma_news(spark, sf_dir):
    """From discovered URLs by way of stored pages to the statistics: two feeds and a list, merged; one page in seven is missing."""
    docs = deal_docs(spark, sf_dir)
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    url = F.concat(F.lit("https://news.example.com/"), "doc_id")
    rows = lambda tag, when: docs.filter(when).select(F.col("doc_id").alias("idx"), url.alias("url"), F.lit(tag).alias("title"), F.lit("").alias("date"), F.lit("").alias("description"), F.lit(tag).alias("source"))
    found = OU.merge_discovered(rows("list", "doc_id % 5 = 0"), rows("feed", "doc_id % 2 = 0"), rows("site", "doc_id % 3 = 0"))
    pages = docs.filter("doc_id % 7 != 0").select(F.col("doc_id").alias("page_id"), url.alias("url"), F.concat(F.lit("<article><h1>News</h1><p>"), safe, F.lit("</p></article>")).alias("html"))
    return L.ma_stats(H.ma_news(pages, found=found, max_len=None)).select("total", "successful", "failed", "deals_with_value")


@query()
def job6_deal_facts(spark, sf_dir):
    return N.deal_facts(deal_docs(spark, sf_dir)).drop("text")


@query()
def agg17_ma_stats(spark, sf_dir):
    facts = N.deal_facts(deal_docs(spark, sf_dir)).withColumn("success", F.col("doc_id") % 10 != 0)
    return L.ma_stats(facts, ["source"])


_LINE = """CASE WHEN regexp_matches(t, '(?i)(token|secret|password|api[_-]?key)\\s*[=:]\\s*[\"'']?[A-Za-z0-9_\\-]{12,}') THEN 'secret' WHEN regexp_matches(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') THEN 'email' WHEN regexp_matches(t, '(?i)licensed under') THEN 'license'
  WHEN regexp_matches(t, '\\b[0-9]{1,3}(\\.[0-9]{1,3}){3}\\b') THEN 'ip_address' WHEN regexp_matches(t, '[A-Za-z0-9+/=]{220,}') THEN 'base64' END"""
_LINES = f"SELECT doc_id, i AS line, {_LINE} AS rule, t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


@query(f"WITH l AS ({_LINES}) SELECT rule, doc_id, line, text FROM (SELECT rule, doc_id, line, substr(t, 1, 200) AS text, row_number() OVER (PARTITION BY rule ORDER BY doc_id, line) AS n FROM l WHERE rule IS NOT NULL) WHERE n <= 20")
def flt3_line_scan(spark, sf_dir):
    return LN.line_pattern_scan(table(spark, sf_dir, "documents")).withColumn("line", F.col("line").cast("long"))


@query(f"WITH l AS ({_LINES}) SELECT rule, count(*) AS lines, count(DISTINCT doc_id) AS docs FROM l WHERE rule IS NOT NULL GROUP BY 1")
def flt3_line_counts(spark, sf_dir):
    return LN.line_pattern_counts(table(spark, sf_dir, "documents"))


# ---- contracts over documents, a clause in front by doc_id

_CLAUSE = """CASE doc_id % 6 WHEN 0 THEN 'The term of this deal is ' || (12 + doc_id % 36) || ' months.' WHEN 1 THEN 'This term has no length; best efforts, perpetual.' WHEN 2 THEN 'Confidential Information must be kept.' WHEN 3 THEN 'Your affiliates are bound under the governing law of Texas.' WHEN 4 THEN 'Exclusive jurisdiction of Delaware, all employees.' ELSE 'Nothing here.' END"""


def clause_docs(spark, sf_dir):
    """Each document's whole text after a clause, a paragraph of its own."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.expr(_CLAUSE), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"))


#: The SQL reads the clause and the whole text: lower case, runs of blanks as one, quotes made plain.
_BARE = "trim(replace(regexp_replace(replace({0}, chr(13), ''), '[ \\t]+', ' ', 'g'), chr(160), ' '), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_PLAIN = f"replace(replace(replace({_BARE}, chr(8220), chr(34)), chr(8221), chr(34)), chr(8217), chr(39))"
_MONTHS = "(TRY_CAST(regexp_extract(t, '([0-9]+)\\s*(months|month|mo\\.?|years|year|yr\\.?)', 1) AS INT) * CASE WHEN regexp_extract(t, '([0-9]+)\\s*(months|month|mo\\.?|years|year|yr\\.?)', 2)[1] = 'y' THEN 12 ELSE 1 END)"
_BURDENS = " + ".join(f"contains(t, '{m}')::INT * 10" for m in ("best efforts", "shall immediately", "all employees", "any employee", "all affiliates", "portfolio companies", "perpetual", "in perpetuity", "exclusive jurisdiction"))
_ELSEWHERE = "(regexp_matches(t, 'governing law|jurisdiction|venue') AND NOT regexp_matches(t, 'illinois|new york|delaware'))"
_BURDEN = f"""greatest(0, least(100, CASE WHEN {_MONTHS} > 24 THEN least(40, {_MONTHS} - 24) ELSE 0 END + {_BURDENS} + {_ELSEWHERE}::INT * 20
  + (contains(t, 'confidential information') AND NOT regexp_matches(t, 'publicly available|independently developed|nonconfidential basis'))::INT * 25))"""
_CONTRACTS = f"SELECT doc_id, {_CLAUSE} || chr(10) || chr(10) || coalesce(text, '') AS x FROM documents"
_CARVED_OUT = "(contains(t, 'publicly available') AND regexp_matches(t, 'known to us prior|known.*prior') AND contains(t, 'independently developed') AND contains(t, 'nonconfidential basis'))"
_HARD = "(regexp_matches(t, 'best efforts|shall|immediate') AND regexp_matches(p, '(?i)best efforts|\\bshall\\b|\\bimmediate(ly)?\\b'))"
_ABOUT = "regexp_matches(t, 'term\\b|this agreement shall remain')"
_CLAUSES = (
    ("Customer/Supplier Non-Solicit:delete", "regexp_matches(t, 'non-?solicit') AND regexp_matches(t, 'customer|supplier')"), ("Employee Non-Solicit:replace", "regexp_matches(t, 'non-?solicit') AND regexp_matches(t, 'employee|personnel|staff')"),
    ("Term:insert", f"{_ABOUT} AND coalesce({_MONTHS}, 0) = 0"), ("Term:replace", f"{_ABOUT} AND {_MONTHS} > 24"), ("Return or Destroy Documents:replace", "regexp_matches(t, 'return.*(documents|materials)') AND NOT contains(t, 'destroy')"),
    ("Legal modifiers:replace", _HARD), ("Affiliate Language:replace", "contains(t, 'affiliate')"), ("State of Jurisdiction:replace", _ELSEWHERE),
    ("Representative Language:replace", "contains(t, 'representative') AND NOT regexp_matches(t, 'directors|officers|advisors|employees|financing sources|consultants|accountants|attorneys')"),
    ("Competition Disclaimer:replace", "regexp_matches(t, 'competitor|competition|bid|quote') AND NOT regexp_matches(t, 'will not.*prevent|restrict.*ordinary course')"),
    ("Confidential Information Carve-Out:replace", f"regexp_matches(t, 'confidential( information)?\\b') AND {_CARVED_OUT} AND {_HARD}"), ("Confidential Information Carve-Out:replace", f"regexp_matches(t, 'confidential( information)?\\b') AND NOT {_CARVED_OUT}"),
)
_REVIEWED = f"""WITH d AS ({_CONTRACTS}), a AS (SELECT doc_id, unnest(regexp_split_to_array({_BARE.format("x")}, '\\n{{2,}}')) AS p FROM d), b AS (SELECT doc_id, p, {_PLAIN.format("lower(p)")} AS t FROM a WHERE {_BARE.format("p")} <> ''),
  s AS (SELECT doc_id, {_BURDEN} AS severity, unnest(list_filter([{", ".join(f"CASE WHEN {w} THEN '{n}' END" for n, w in _CLAUSES)}], lambda y: y IS NOT NULL)) AS y FROM b), r AS (SELECT doc_id, string_split(y, ':')[1] AS clause_type, string_split(y, ':')[2] AS operation, severity FROM s)"""


@query(f"WITH d AS ({_CONTRACTS}), l AS (SELECT doc_id, {_PLAIN.format('lower(x)')} AS t FROM d) SELECT doc_id, coalesce({_MONTHS}, -1)::INT AS months, ({_BURDEN})::INT AS burden FROM l")
def scl23_term_and_burden(spark, sf_dir):
    t = F.col("text")
    return clause_docs(spark, sf_dir).select("doc_id", F.coalesce(K.term_months(t), F.lit(-1)).alias("months"), K.burden_score(t).alias("burden"))


@query(f"{_REVIEWED} SELECT doc_id, clause_type, operation, severity::INT AS severity FROM r")
def job9_contract_review(spark, sf_dir):
    return K.contract_review(clause_docs(spark, sf_dir)).select("doc_id", "clause_type", "operation", "severity")


@query()
def job10_apply_suggestions(spark, sf_dir):
    docs = clause_docs(spark, sf_dir)
    return K.apply_suggestions(docs, K.contract_review(docs))


_RULES = [
    {"id": "term", "clause": "Term", "level": "BLOCKER", "severity": 12, "require": ["/\\bterm\\b/i"], "forbid": ["perpetual"]}, {"id": "law", "clause": "Law", "level": "WARN", "severity": 6, "forbid": ["Texas"]},
    {"id": "carve", "clause": "Confidential", "level": "WARN", "severity": 5, "require": [], "forbid": ["/confidential information/i"]}, {"id": "look", "clause": "Any", "level": "WARN", "severity": 1},
]


@query(f"""WITH d AS ({_CONTRACTS}), f AS (SELECT doc_id, (NOT regexp_matches(x, '(?i)\\bterm\\b') OR contains(lower(x), 'perpetual'))::INT AS a, contains(lower(x), 'texas')::INT AS b, contains(lower(x), 'confidential information')::INT AS c FROM d),
  s AS (SELECT doc_id, 12 * a + 6 * b + 5 * c AS score, a AS blockers, b + c AS warns FROM f) SELECT doc_id, score::BIGINT AS score, blockers::BIGINT AS blockers, warns::BIGINT AS warns, CASE WHEN score >= 20 OR blockers >= 1 THEN 'HIGH' WHEN score >= 10 OR warns >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM s""")
def job11_playbook_review(spark, sf_dir):
    return K.playbook_review(clause_docs(spark, sf_dir), _RULES, head=None)


@query(f"{_REVIEWED} SELECT doc_id, bool_and(clause_type <> 'Confidential Information Carve-Out' OR severity < 60) AS carve_out_ok, bool_and(clause_type <> 'Term' OR severity <= 60) AS term_ok, bool_and(clause_type <> 'Affiliate Language' OR severity < 70) AS affiliate_ok FROM r GROUP BY 1")
def agg16_checklist_coverage(spark, sf_dir):
    return K.checklist_coverage(K.contract_review(clause_docs(spark, sf_dir)))


_SECTION_SQL = (("Confidentiality", "confidential|proprietary|non-disclosure"), ("Term", "term|duration|period|expires?|years?"), ("Governing Law", "governing law|jurisdiction|venue|courts?"), ("Indemnification", "indemnif|hold harmless|defend"), ("Limitation of Liability", "limitation|liability|damages|consequential"))


@query(f"""WITH d AS ({_CONTRACTS}), l AS (SELECT doc_id, x, {", ".join(f"CASE WHEN regexp_matches(x, '(?i)(^|[^0-9A-Za-z_])({w})([^0-9A-Za-z_]|$)') THEN '{n}' END AS s{i}" for i, (n, w) in enumerate(_SECTION_SQL))}, regexp_matches(x, '(?i)best\\s+efforts')::INT AS a, regexp_matches(x, '(?i)perpetual|indefinite')::INT AS b FROM d)
  SELECT doc_id, 100 - 10 * (a + b) AS score, concat_ws(',', {", ".join(f"s{i}" for i in range(5))}) AS sections, CASE WHEN a + b = 2 THEN 'fb-best-efforts,fb-term-perpetual' WHEN a = 1 THEN 'fb-best-efforts' WHEN b = 1 THEN 'fb-term-perpetual' ELSE '' END AS issues FROM l""")
def agg16_section_coverage(spark, sf_dir):
    out = K.section_coverage(clause_docs(spark, sf_dir))
    there = F.concat_ws(",", *[F.when(F.col("sections")[n], n) for n, _ in K.SECTIONS])
    return out.select("doc_id", "score", there.alias("sections"), F.array_join(F.transform("issues", lambda x: x["id"]), ",").alias("issues"))


# ---- logs over events: host = user, failure = error, response time = value, job = day

_RESULT = "SELECT event_id, ts, 'host' || user_id AS host, 'https://h' || user_id || '.example.com/list/page/' || event_id % 7 AS url, event_type <> 'error' AS success, event_id % 50 = 0 AS skipped, value AS response_time, CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'Timeout after' WHEN 1 THEN '[404] gone' WHEN 2 THEN '[500] Upstream' WHEN 3 THEN 'DNS failure' ELSE 'odd' END END AS error FROM events"


def results(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    message = F.expr("CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'Timeout after' WHEN 1 THEN '[404] gone' WHEN 2 THEN '[500] Upstream' WHEN 3 THEN 'DNS failure' ELSE 'odd' END END")
    url = F.concat(F.lit("https://h"), "user_id", F.lit(".example.com/list/page/"), F.col("event_id") % 7)
    return e.select("event_id", "ts", F.concat(F.lit("host"), "user_id").alias("host"), url.alias("url"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 50 == 0).alias("skipped"), F.col("value").alias("response_time"), message.alias("error"))


@query(f"""WITH r AS ({_RESULT}) SELECT host, count(*) AS total, count(*) FILTER (NOT skipped) AS processed, count(*) FILTER (NOT skipped AND success) AS successful, count(*) FILTER (NOT skipped AND NOT success) AS failed, count(*) FILTER (skipped) AS skipped,
  round(coalesce(count(*) FILTER (NOT skipped AND success) * 100.0 / nullif(count(*) FILTER (NOT skipped), 0), 0), 4)::DOUBLE AS success_rate, round(avg(response_time), 4) AS avg_response_time, round(coalesce(avg(response_time) FILTER (success), 0), 4) AS avg_success_time FROM r GROUP BY 1""")
def agg1_batch_summary(spark, sf_dir):
    out = L.batch_summary(results(spark, sf_dir), ["host"])
    return out.select("host", "total", "processed", "successful", "failed", "skipped", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("success_rate", "avg_response_time", "avg_success_time")])


_CAT = "CASE WHEN contains(lower(error), 'timeout') THEN 'timeout' WHEN contains(error, '404') THEN 'http_404' WHEN contains(error, '500') THEN 'server_error' WHEN contains(lower(error), 'dns') THEN 'dns_error' ELSE 'unknown' END"
_ALL = ", ".join(f"'{c}'" for c in L.CATEGORIES)


@query(f"WITH r AS ({_RESULT}), c AS (SELECT {_CAT} AS category, count(*) AS n FROM r WHERE NOT success GROUP BY 1) SELECT k AS category, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest([{_ALL}]) AS k) LEFT JOIN c ON k = c.category")
def agg2_error_categories(spark, sf_dir):
    return L.error_categories(results(spark, sf_dir))


@query(f"""WITH r AS (SELECT *, {_CAT} AS category, 'host' || event_id % 3 AS code FROM ({_RESULT}) WHERE NOT success), x AS (SELECT *, row_number() OVER (PARTITION BY category, code ORDER BY ts, url) AS k FROM r)
  SELECT category, code, count(*) AS n, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, string_agg(url, ' ' ORDER BY k) FILTER (k <= 5) AS examples FROM x GROUP BY 1, 2""")
def agg3_error_patterns(spark, sf_dir):
    rows = results(spark, sf_dir).filter("not success").withColumn("category", L.error_category(F.col("error"))).withColumn("code", F.concat(F.lit("host"), F.col("event_id") % 3))
    return L.error_patterns(rows).select("category", "code", "n", *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("first_seen", "last_seen")], F.array_join("example_urls", " ").alias("examples"))


@query(f"WITH r AS ({_RESULT}), c AS (SELECT {_CAT} AS category, count(*) AS n FROM r WHERE NOT success GROUP BY 1) SELECT CASE category WHEN 'server_error' THEN 'server' ELSE category END AS type, CASE category WHEN 'timeout' THEN 'high' ELSE 'medium' END AS severity, n FROM c WHERE category = 'timeout' AND n > 3 OR category = 'server_error' AND n > 2")
def agg4_recommendations(spark, sf_dir):
    return L.recommendations(L.error_categories(results(spark, sf_dir))).select("type", "severity", "n")


_EVENTS = "SELECT 'host' || user_id AS host, '[' || (400 + event_id % 104) || '] ' || event_type AS message FROM events WHERE event_type = 'error'"


@query(f"""WITH e AS ({_EVENTS}), g AS (SELECT 'host' AS dim, host AS value, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'status', regexp_extract(message, '\\[([0-9]+)\\]', 1), count(*) FROM e GROUP BY 2 UNION ALL SELECT 'message', message, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM e)
  SELECT dim, value, n, round(n * 100.0 / (SELECT count(*) FROM e), 4)::DOUBLE AS pct FROM g""")
def agg5_error_log_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    rows = e.select(F.concat(F.lit("host"), "user_id").alias("host"), F.concat(F.lit("["), 400 + F.col("event_id") % 104, F.lit("] "), "event_type").alias("message"))
    return L.error_log_report(rows).withColumn("pct", F.col("pct").cast("double"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS job_id, count(*) AS total_requests, count(*) FILTER (event_type <> 'error') AS successful_requests, count(*) FILTER (event_type = 'error') AS failed_requests, count(*) FILTER (event_id % 3 = 0) AS canonicalized_requests, CASE WHEN bool_or(event_type = 'error') THEN 'error=' || count(*) FILTER (event_type = 'error') END AS error_classes, min(nullif(value, 0)) AS min_ms, max(nullif(value, 0)) AS max_ms,
  round(avg(nullif(value, 0)), 4) AS avg_ms, quantile_disc(nullif(value, 0), 0.5 ORDER BY nullif(value, 0) DESC) AS median_ms FROM events GROUP BY 1""".replace("quantile_disc(nullif(value, 0), 0.5 ORDER BY nullif(value, 0) DESC)", "list_sort(list(value) FILTER (value <> 0))[1 + (count(*) FILTER (value <> 0)) // 2]"))
def agg6_request_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.date_format("ts", "yyyy-MM-dd").alias("job_id"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 3 == 0).alias("canonicalized"), F.lit(False).alias("robots_blocked"), F.lit(False).alias("pagination_discovered"), F.col("value").alias("response_time_ms"), F.col("event_type").alias("error_class"))
    return L.request_summary(rows).select("job_id", "total_requests", "successful_requests", "failed_requests", "canonicalized_requests", F.array_join(F.transform(F.map_entries("error_classes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("error_classes"), "min_ms", "max_ms", F.round("avg_ms", 4).alias("avg_ms"), "median_ms")


@query(f"WITH r AS ({_RESULT}) SELECT '/list/page/*' AS pattern, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM r")
def agg7_url_patterns(spark, sf_dir):
    return L.url_pattern_stats(results(spark, sf_dir))


@query(f"WITH r AS ({_RESULT}) SELECT event_id FROM r WHERE NOT success AND NOT (contains(error, '404') OR contains(lower(error), 'dns'))")
def set3_retry_candidates(spark, sf_dir):
    return L.retry_candidates(results(spark, sf_dir)).select("event_id")


@query(f"WITH r AS ({_RESULT}) SELECT coalesce(error, 'none') AS error_type, count(*) AS retries, count(*) FILTER (success) AS successes, count(*) FILTER (success) * 100.0::DOUBLE / count(*) AS success_rate FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def agg20_retry_metrics(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("error_type", F.coalesce("error", F.lit("none")))
    return L.retry_metrics(rows, 3).withColumn("success_rate", F.col("success_rate").cast("double"))


_SESSIONS = "SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS good, count(*) FILTER (event_type = 'error') AS bad, epoch_us(min(ts)) // 1000 AS c, epoch_us(max(ts)) // 1000 AS u FROM events GROUP BY 1"


def sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    grouped = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") != "error").alias("successCount"), F.count_if(F.col("event_type") == "error").alias("failureCount"), F.unix_millis(F.min("ts").cast("timestamp")).alias("createdAt"), F.unix_millis(F.max("ts").cast("timestamp")).alias("updatedAt"))
    return grouped.select(F.col("user_id").cast("string").alias("id"), F.when(F.col("user_id") % 2 == 0, "completed").otherwise("running").alias("status"), (F.col("n") * 2).alias("totalUrls"), "successCount", "failureCount", "createdAt", "updatedAt", (F.col("createdAt") + 1000 * (F.col("user_id") % 5)).alias("expiresAt"))


@query(f"""WITH s AS ({_SESSIONS}) SELECT user_id::VARCHAR AS id, round((good + bad) * 100.0 / (total * 2), 4)::DOUBLE AS progress, round(coalesce((good + bad)::DOUBLE / nullif((u - c) / 1000.0, 0), 0), 4)::DOUBLE AS urls_per_second,
  round(coalesce((total * 2 - good - bad) / nullif((good + bad)::DOUBLE / nullif((u - c) / 1000.0, 0), 0), 0), 4)::DOUBLE AS eta_seconds, round((u - c)::DOUBLE / (good + bad), 4) AS avg_ms, round(good * 100.0 / (good + bad), 4)::DOUBLE AS success_rate FROM s""")
def agg19_session_stats(spark, sf_dir):
    out = L.session_stats(sessions(spark, sf_dir))
    return out.select("id", *[F.col(c).cast("double").alias(c) for c in ("progress", "urls_per_second", "eta_seconds", "avg_ms", "success_rate")])


@query(f"WITH s AS ({_SESSIONS}) SELECT user_id::VARCHAR AS id, u AS updated FROM s WHERE user_id % 2 = 0 ORDER BY u DESC, user_id::VARCHAR LIMIT 10")
def win7_keep_newest(spark, sf_dir):
    return L.keep_newest(sessions(spark, sf_dir), 10, 4_000_000_000_000).select("id", F.col("updatedAt").alias("updated"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS n_window, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS n_burst FROM events""")
def win6_requests_in_window(spark, sf_dir):
    return OU.requests_in_window(table(spark, sf_dir, "events"), "user_id", "ts", 3_600_000, 60_000).select("event_id", "n_window", "n_burst")


@query("""SELECT event_id, row_number() OVER w AS completed, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w::BIGINT AS errors FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def win8_progress(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("success", F.col("event_type") != "error")
    return L.progress(rows, "user_id", ["ts", "event_id"]).select("event_id", F.col("completed").cast("long").alias("completed"), F.col("errors").cast("long").alias("errors"))


@query("""WITH f AS (SELECT event_id, event_id % 4 AS k, 1 + event_id % 5 AS a FROM events WHERE event_type = 'error') SELECT event_id, CASE k WHEN 0 THEN 'RATE_LIMITED' WHEN 1 THEN 'HTTP_404' WHEN 2 THEN 'TIMEOUT' ELSE 'DEFAULT' END AS error_type,
  CASE k WHEN 0 THEN least(5000 * 2 ** (a - 1), 60000) WHEN 1 THEN 0 WHEN 2 THEN 2000 * a ELSE 2000 * 2 ** (a - 1) END::BIGINT AS delay_ms, a <= CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 2 END AS can_retry FROM f""")
def str7_retry_schedule(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    rows = e.select("event_id", F.expr("CASE event_id % 4 WHEN 0 THEN 'RATE_LIMITED' WHEN 2 THEN 'ETIMEDOUT' END").alias("code"), F.expr("CASE event_id % 4 WHEN 1 THEN 404 END").alias("status"), F.lit(None).cast("string").alias("message"), (1 + F.col("event_id") % 5).alias("attempt"))
    return L.retry_schedule(rows).select("event_id", "error_type", "delay_ms", "can_retry")


_CODE = "coalesce(nullif(regexp_extract(error, '\\[([0-9]+)\\]', 1), ''), 'unknown')"
_SUMMED = """SELECT count(*) AS total, count(*) FILTER (NOT skipped) AS processed, count(*) FILTER (NOT skipped AND success) AS successful, count(*) FILTER (NOT skipped AND NOT success) AS failed, count(*) FILTER (skipped) AS skipped,
  coalesce(count(*) FILTER (NOT skipped AND success) * 100.0 / nullif(count(*) FILTER (NOT skipped), 0), 0) AS success_rate, coalesce(avg(response_time), 0) AS avg_response_time, coalesce(avg(response_time) FILTER (success), 0) AS avg_success_time FROM r"""
_NAMES = ("total", "processed", "successful", "failed", "skipped", "success_rate", "avg_response_time", "avg_success_time")


@query(f"""WITH r AS ({_RESULT}), f AS (SELECT *, {_CAT} AS category, {_CODE} AS code FROM r WHERE NOT success), k AS (SELECT category, count(*) AS n FROM f GROUP BY 1), s AS ({_SUMMED}), g AS (
  {" UNION ALL ".join(f"SELECT 'summary' AS section, '{c}' AS key, NULL::BIGINT AS n, {c}::DOUBLE AS value FROM s" for c in _NAMES)}
  UNION ALL SELECT 'category', c, coalesce(n, 0), NULL FROM (SELECT unnest([{_ALL}]) AS c) LEFT JOIN k ON c = category
  UNION ALL SELECT 'error_pattern', category || ' ' || code, count(*), NULL FROM f GROUP BY 2
  UNION ALL SELECT 'advice', CASE category WHEN 'server_error' THEN 'server' ELSE category END, n, NULL FROM k WHERE category = 'timeout' AND n > 3 OR category = 'network' AND n > 5 OR category = 'rate_limit' OR category = 'server_error' AND n > 2
  UNION ALL SELECT 'pattern', regexp_replace(regexp_extract(url, '^https://[^/]+(/.*)$', 1), '/page/[0-9]+', '/page/*'), count(*), count(*) FILTER (NOT success) FROM r GROUP BY 2
  UNION ALL SELECT 'time', 'min', NULL, min(response_time) FROM r UNION ALL SELECT 'time', 'max', NULL, max(response_time) FROM r UNION ALL SELECT 'time', 'mean', NULL, avg(response_time) FROM r
  UNION ALL SELECT 'time', 'median', NULL, list_sort(list(response_time))[1 + count(*) // 2] FROM r
  UNION ALL SELECT 'host', regexp_extract(url, '^https://([^/]+)', 1), count(*), count(*) * 100.0 / (SELECT count(*) FROM f) FROM f GROUP BY 2
  UNION ALL SELECT 'status', code, count(*), count(*) * 100.0 / (SELECT count(*) FROM f) FROM f WHERE code <> 'unknown' GROUP BY 2 UNION ALL SELECT 'message', error, count(*), count(*) * 100.0 / (SELECT count(*) FROM f) FROM f GROUP BY 2
  UNION ALL SELECT 'companies', 'average', coalesce(sum(CASE WHEN event_id % 4 <> 0 THEN event_id % 9 END) FILTER (success), 0)::BIGINT, coalesce(sum(CASE WHEN event_id % 4 <> 0 THEN event_id % 9 END) FILTER (success)::DOUBLE / nullif(count(*) FILTER (success), 0), 0) FROM r
  UNION ALL SELECT * FROM (SELECT 'retry', 'TYPE_' || event_id % 7 AS k, count(*) AS c, count(*) FILTER (success) * 100.0 / count(*) FROM r WHERE event_id % 10 < 7 GROUP BY 2 ORDER BY c DESC, k LIMIT 5))
  SELECT section, key, n, round(value, 4) AS value FROM g""")
def job12_crawl_report(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("n_companies", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 9)).withColumn("error_type", F.when(F.col("event_id") % 10 < 7, F.concat(F.lit("TYPE_"), F.col("event_id") % 7)))
    return L.crawl_report(rows).withColumn("value", F.round("value", 4))


@query(f"""WITH r AS ({_RESULT}), f AS (SELECT {_CAT} AS category, url FROM r WHERE NOT success), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY url) AS i FROM f)
  SELECT category, count(*) AS n, string_agg(url, ' ' ORDER BY url) FILTER (i <= 10) AS examples FROM k GROUP BY 1""")
def agg8_errors_by_category(spark, sf_dir):
    return L.errors_by_category(results(spark, sf_dir)).withColumn("examples", F.array_join("examples", " "))


@query("SELECT count(*) FILTER (p_partkey % 3 <> 0) AS urls, coalesce(sum(p_size) FILTER (p_partkey % 3 <> 0), 0)::BIGINT AS companies, round(coalesce(sum(p_size) FILTER (p_partkey % 3 <> 0)::DOUBLE / nullif(count(*) FILTER (p_partkey % 3 <> 0), 0), 0), 4) AS average FROM part")
def agg8_companies_per_success(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 3 != 0).alias("success"), F.col("p_size").alias("n_companies"))
    return L.companies_per_success(rows).select("urls", F.col("companies").cast("long").alias("companies"), F.round("average", 4).alias("average"))


@query(f"""WITH p AS ({_PARTS} FROM (SELECT page_id, url AS u FROM pages)) SELECT regexp_replace(pth, '/page/[0-9]+', '/page/*', 'g') AS pattern, count(*) AS total, count(*) FILTER (page_id % 7 <> 0) AS successful, count(*) FILTER (page_id % 7 = 0) AS failed,
  round(count(*) FILTER (page_id % 3 = 0) * 100.0 / count(*), 4)::DOUBLE AS canonical_pct FROM p WHERE {_WEB} GROUP BY 1""")
def agg7_page_patterns(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 7 != 0).alias("success"), (F.col("page_id") % 3 == 0).alias("canonicalized"))
    return L.url_pattern_stats(rows).withColumn("canonical_pct", F.col("canonical_pct").cast("double"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM documents) SELECT doc_id, len(parts) AS sentences, parts[1] AS first, list_max(list_transform(parts, lambda x: length(x))) AS longest FROM s""")
def scl11_split_sentences(spark, sf_dir):
    parts = T.split_sentences(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", parts.alias("parts"))
    return rows.select("doc_id", F.size("parts").cast("long").alias("sentences"), F.try_element_at("parts", F.lit(1)).alias("first"), F.array_max(F.transform("parts", F.length)).cast("long").alias("longest"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(html, '[<>"'';\\]', '', 'g'), '^\s+|\s+$', '', 'g')) AS clean FROM pages""")
def scl29_sanitize_string(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.sanitize_string(F.col("html")).cast("binary")).alias("clean"))


@query()
def scl25_contract_context(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", K.contract_context(F.col("text"), head=None).alias("c")).select("doc_id", "c.*")


@query()
def scl26_sports_validation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.keyword_score(F.col("text")).alias("keywords"), H.sports_validation(F.col("text")).alias("v")).select("doc_id", "keywords", "v.score", "v.valid", F.array_join("v.failed", " ").alias("failed"))


@query()
def htm8_pagination(spark, sf_dir):
    return H.extract_pagination(H.parse_pages(stored_pages(spark, sf_dir), parts=("links", "body")))


def directory_pages(spark, sf_dir):
    """One page for every 20 suppliers, each a row of its table."""
    row = F.concat(F.lit("<tr><td> "), "s_name", F.lit("</td><td>Tel. "), "s_suppkey", F.lit("-555 (main)</td><td>www.s"), "s_suppkey", F.lit(".example.com</td></tr>"))
    pages = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 20").alias("page_id"), F.struct("s_suppkey", row.alias("row")).alias("r")).groupBy("page_id").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    rows = F.array_join(F.transform("rows", lambda r: r["row"]), "")
    return dealt(pages).select("page_id", F.concat(F.lit("https://d.example.com/"), "page_id").alias("url"), F.concat(F.lit("<table><tr><th>Company</th><th>Contact</th><th>Website</th></tr>"), rows, F.lit("</table>")).alias("html"))


_DIRECTORY = "SELECT s_suppkey // 20 AS page_id, 'https://d.example.com/' || s_suppkey // 20 AS url, row_number() OVER (PARTITION BY s_suppkey // 20 ORDER BY s_suppkey) AS pos, s_name AS name, s_suppkey AS k FROM supplier"


@query(f"SELECT page_id, url, pos, name, 'Tel. ' || k || '-555 (main)' AS contact, 'www.s' || k || '.example.com' AS website FROM ({_DIRECTORY})")
def htm9_companies(spark, sf_dir):
    return H.extract_companies(H.parse_pages(directory_pages(spark, sf_dir), parts=H.FOR_COMPANIES)).withColumn("pos", F.col("pos").cast("long"))


_PLANS = "SELECT s_suppkey // 20 AS page_id, s_suppkey AS k, s_suppkey // 20 % 2 = 0 AS plain, row_number() OVER (PARTITION BY s_suppkey // 20 ORDER BY s_suppkey) AS pos FROM supplier"


@query(f"""SELECT page_id, pos, CASE WHEN plain THEN 'Maker ' || k ELSE 'Company ' || k || ' Inc' END AS name, CASE WHEN plain THEN 'Tel. ' || k ELSE 'Address ' || k || ' Main St' END AS contact, CASE WHEN plain THEN 'www.s' || k || '.example.com' ELSE 'Website s' || k || '.example.org' END AS website FROM ({_PLANS})""")
def htm9_site_plans(spark, sf_dir):
    """Two sites whose tables have their columns in another order, one of them found by words in the cells."""
    s = table(spark, sf_dir, "supplier").withColumn("page_id", F.floor(F.col("s_suppkey") / 20))
    plain = F.col("page_id") % 2 == 0
    cells = lambda *parts: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.concat(*p), F.lit("</td>")) for p in parts], F.lit("</tr>"))
    k, t = F.col("s_suppkey"), F.lit
    row = F.when(plain, cells((t("Maker "), k), (t("Tel. "), k), (t("www.s"), k, t(".example.com")))).otherwise(cells((t("Address "), k, t(" Main St")), (t("Website s"), k, t(".example.org")), (t("Company "), k, t(" Inc"))))
    rows = s.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", row.alias("row")))).alias("rows"))  # twenty a page
    host = F.when(plain, "https://www.d2pbuyersguide.com/").otherwise("https://thomasnet.com/")
    html = F.concat(F.lit("<table><tr><th>Company</th><th>Contact</th><th>Website</th></tr>"), F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</table>"))
    return H.extract_companies(H.parse_pages(dealt(rows).select("page_id", F.concat(host, "page_id").alias("url"), html.alias("html")), parts=H.FOR_COMPANIES)).select("page_id", "pos", "name", "contact", "website")


@query(f"""SELECT url, count(*) AS n_companies, true AS has_contact, true AS has_site, count(*) AS n, count(*) AS complete, 0::BIGINT AS empty, greatest(0, least(200, least(10 * count(*), 100) + 20 * count(*) + 10)) AS score, true AS valid FROM ({_DIRECTORY}) GROUP BY url""")
def job7_directory_report(spark, sf_dir):
    parsed = stored(H.parse_pages(directory_pages(spark, sf_dir).withColumn("html", F.concat(F.lit("<title>Makers</title>"), "html")), parts=("title", *H.FOR_COMPANIES)), "directory")
    kept = OC.supplier_directory(H.extract_companies(parsed)).select("url", "name", "contact", "website")
    out = OC.directory_report(kept, parsed.select("url", "title", F.lit("").alias("description")))
    return out.withColumns({c: F.col(c).cast("long") for c in ("n_companies", "n", "complete", "empty", "score")})


@query(f"SELECT page_id, url, pos, name, k || '-555 ()' AS contact, 'https://www.s' || k || '.example.com' AS website FROM ({_DIRECTORY})")
def job7_supplier_directory(spark, sf_dir):
    return OC.supplier_directory(H.extract_companies(H.parse_pages(directory_pages(spark, sf_dir), parts=H.FOR_COMPANIES))).withColumn("pos", F.col("pos").cast("long"))


def player_pages(spark, sf_dir):
    """One page for each customer with orders: a table of its orders by year."""
    years = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    row = F.concat(F.lit("<tr><td>"), "year", F.lit("</td><td>"), "n", F.lit("</td></tr>"))
    pages = years.select(F.col("o_custkey").alias("page_id"), F.struct("year", row.alias("row")).alias("r")).groupBy("page_id").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    rows = F.array_join(F.transform("rows", lambda r: r["row"]), "")
    return dealt(pages).select("page_id", F.lit("https://p.example.com/").alias("url"), F.concat(F.lit("<h1>Player</h1><table><tr><th>Year</th><th>Games</th></tr>"), rows, F.lit("</table>")).alias("html"))


_YEARS = "SELECT o_custkey AS page_id, year(o_orderdate) AS y, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) AS row_idx FROM orders GROUP BY 1, 2"


@query(f"""SELECT page_id, 0::BIGINT AS table_idx, 'season' AS table_type, row_idx, '{{"Year":"' || y || '","Games":"' || n || '"}}' AS stats, n::DOUBLE AS games FROM ({_YEARS})""")
def htm10_stat_tables(spark, sf_dir):
    out = H.extract_stat_tables(H.parse_pages(player_pages(spark, sf_dir), parts=H.FOR_TABLES))
    return out.select("page_id", F.col("table_idx").cast("long").alias("table_idx"), "table_type", F.col("row_idx").cast("long").alias("row_idx"), F.to_json("stats").alias("stats"), F.col("numbers")["Games"].alias("games"))


@query(f"SELECT page_id, row_idx, 'Year' AS stat, y::VARCHAR AS value FROM ({_YEARS}) UNION ALL SELECT page_id, row_idx, 'Games', n::VARCHAR FROM ({_YEARS})")
def job8_player_statistics(spark, sf_dir):
    out = H.player_tables(H.parse_pages(player_pages(spark, sf_dir), parts=(*H.FOR_BIOS, *H.FOR_TABLES)))["statistics"]
    return out.select("page_id", F.col("row_idx").cast("long").alias("row_idx"), "stat", "value")


_ROOKIES = "SELECT c_custkey AS k, 1980 + c_custkey % 30 AS y, 'T' || c_custkey % 32 AS team, 1 + c_custkey % 7 AS r, 1 + c_custkey % 250 AS p FROM customer"


def rookie_pages(spark, sf_dir):
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    html = F.expr("""concat('<h1>', c_name, '</h1><div class="player-info">Height: 6\\'2"; Draft: ', 1980 + c_custkey % 30, ' T', c_custkey % 32, ' ', 1 + c_custkey % 7, ' ', 1 + c_custkey % 250,
      '</div><ul class="awards"><li>Rookie ', 1980 + c_custkey % 30, '; All-Star</li></ul><div class="faq">How old? ', 20 + c_custkey % 20, '</div>')""")
    return c.select(F.col("c_custkey").alias("page_id"), F.lit("https://p.example.com/").alias("url"), html.alias("html"))


@query(f"""SELECT k AS page_id, 'draft' AS kind, y || ' ' || team || ' ' || r || ' ' || p AS value FROM ({_ROOKIES}) UNION ALL SELECT k, 'achievement', 'Rookie ' || y FROM ({_ROOKIES}) UNION ALL SELECT k, 'achievement', 'All-Star' FROM ({_ROOKIES})
  UNION ALL SELECT k, 'answer', 'How old=' || 20 + k % 20 FROM ({_ROOKIES}) UNION ALL SELECT k, 'height', '6''2"' FROM ({_ROOKIES})""")
def job8_player_details(spark, sf_dir):
    t = H.player_tables(H.parse_pages(rookie_pages(spark, sf_dir), parts=(*H.FOR_BIOS, *H.FOR_TABLES)))
    part = lambda name, kind, value: t[name].select("page_id", F.lit(kind).alias("kind"), value.alias("value"))
    out = part("draft_info", "draft", F.concat_ws(" ", "year", "team", "round", "pick")).union(part("achievements", "achievement", F.col("achievement")))
    return out.union(part("answers", "answer", F.concat_ws("=", "question", "answer"))).union(part("players", "height", F.col("height")))


@query("SELECT page_id, 0::BIGINT AS pos, 'Page ' || page_id AS title, 'https://l.example.com/item/' || page_id AS link, 'Page ' || page_id || ' about ' || length(url) AS description FROM pages")
def htm7_listings(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    html = F.concat(F.lit('<ul><li class="listing-item"><a href="/item/'), "page_id", F.lit('">Page '), "page_id", F.lit("</a> about "), F.length("url"), F.lit("</li></ul>"))
    out = H.extract_listings(H.parse_pages(p.select("page_id", F.lit("https://l.example.com/").alias("url"), html.alias("html")), parts=("items",)))
    return out.withColumn("pos", F.col("pos").cast("long"))


@query()
def htm11_player_bio(spark, sf_dir):
    out = H.extract_player_bio(H.parse_pages(stored_pages(spark, sf_dir), parts=H.FOR_BIOS))
    return out.withColumns({"draft_info": F.to_json("draft_info"), "achievements": F.array_join("achievements", "|"), "answers": F.to_json("answers")})


@query("""WITH e AS (SELECT event_id, 'host' || (user_id % 20) AS host, epoch_ms(ts) AS ms FROM events), b AS (SELECT *, ms // 3600000 AS w FROM e), p AS (SELECT *, row_number() OVER (PARTITION BY host, w ORDER BY ms, event_id) AS n FROM b)
  SELECT event_id, n <= 5 AS allowed, greatest(5 - n, 0)::BIGINT AS remaining, CASE WHEN n > 5 THEN ((w + 1) * 3600000 - ms + 999) // 1000 ELSE 0 END AS retry_after_s FROM p""")
def str4_fixed_window(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("host"), F.col("user_id") % 20).alias("host"), "ts")
    return OU.fixed_window_limit(rows, "host", 5, 3_600_000, ("event_id",)).select("event_id", "allowed", "remaining", "retry_after_s")


# ---- players over customer and orders

_TEAMS = "SELECT * FROM (VALUES ('T0', 1990, 'Old Town', 'OLD'), ('T0', 1995, 'New Town', 'NEW'), ('T1', 1996, 'River City', 'RIV')) h(code, start_year, team_full, team_abbrs)"


def seasons(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("season"), F.expr("CASE WHEN c_nationkey % 5 = 4 THEN '2TM' ELSE concat('T', c_nationkey % 5) END").alias("team"), "o_orderpriority")


@query(f"""WITH h AS ({_TEAMS}), s AS (SELECT o_orderkey, year(o_orderdate) AS season, CASE WHEN c_nationkey % 5 = 4 THEN '2TM' ELSE 'T' || c_nationkey % 5 END AS team FROM orders JOIN customer ON o_custkey = c_custkey),
  a AS (SELECT o_orderkey, team, (SELECT arg_max(team_full, start_year) FROM h WHERE h.code = s.team AND h.start_year <= s.season) AS f FROM s) SELECT o_orderkey, CASE WHEN contains(team, 'TM') THEN 'Multiple Teams' WHEN f IS NOT NULL THEN f WHEN team = 'T2' THEN 'Static Bay' ELSE 'Unknown Team (' || team || ')' END AS team_full FROM a""")
def jon1_season_team(spark, sf_dir):
    history = P.team_history(spark, [("T0", 1990, "Old Town", "OLD"), ("T0", 1995, "New Town", "NEW"), ("T1", 1996, "River City", "RIV")])
    static = spark.createDataFrame([("T2", "Static Bay", "STA")], "code string, team_full string, team_abbrs string")
    return P.season_team(seasons(spark, sf_dir), history, static).select("o_orderkey", "team_full")


@query("""WITH c AS (SELECT o_custkey AS player, o_orderpriority AS position, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) SELECT player, position FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY n DESC, f) AS k FROM c) WHERE k = 1""")
def agg12_primary_position(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player"), F.col("o_orderpriority").alias("pos"), F.col("o_orderkey").alias("idx"))
    return P.primary_position(o)


@query("SELECT o_custkey AS player_id, min(year(o_orderdate))::INT AS rookie_year, count(*) FILTER (o_totalprice >= 100000) AS played, count(*) FILTER (o_totalprice >= 100000) >= 2 AS eligible_flag FROM orders GROUP BY 1")
def agg11_eligibility(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season"), F.when(F.col("o_totalprice") >= 100000, 1).otherwise(0).alias("games"))
    return P.eligibility(o, 2).select("player_id", "rookie_year", F.col("seasons_with_G_ge_1").alias("played"), "eligible_flag")


_FORMS = "'Kin ' || chr((65 + c_custkey % 26)::INT) || chr((65 + c_custkey % 7)::INT) || CASE c_custkey // 182 % 5 WHEN 0 THEN ' 1' WHEN 3 THEN ' 2' WHEN 4 THEN ' 1 1' ELSE '' END"


@query(f"""WITH RECURSIVE n AS (SELECT c_custkey, c_custkey % 182 AS kin, row_number() OVER (PARTITION BY c_custkey % 182 ORDER BY c_custkey) AS i, replace(lower({_FORMS}), ' ', '_') AS slug FROM customer),
  r AS (SELECT DISTINCT kin, 0::BIGINT AS i, 0::BIGINT AS c_custkey, '' AS player_id, []::VARCHAR[] AS taken FROM n UNION ALL
    SELECT x.kin, x.i, x.c_custkey, x.id, list_append(x.taken, x.id) FROM (SELECT n.kin, n.i, n.c_custkey, r.taken, CASE WHEN list_contains(r.taken, n.slug) THEN n.slug || '_' || list_filter(range(1, 200), lambda k: NOT list_contains(r.taken, n.slug || '_' || k))[1] ELSE n.slug END AS id FROM r JOIN n ON n.kin = r.kin AND n.i = r.i + 1) x)
  SELECT c_custkey, player_id FROM r WHERE i > 0""")
def win1_slug_families(spark, sf_dir):
    """Names that end in numbers next to names that get some."""
    form = F.expr("concat('Kin ', chr(65 + c_custkey % 26), chr(65 + c_custkey % 7), CASE floor(c_custkey / 182) % 5 WHEN 0 THEN ' 1' WHEN 3 THEN ' 2' WHEN 4 THEN ' 1 1' ELSE '' END)")
    return P.unique_slug(table(spark, sf_dir, "customer").select("c_custkey", form.alias("name")), "name", "c_custkey").select("c_custkey", "player_id")


@query("""SELECT c_custkey, lower(c_mktsegment) || CASE WHEN k = 1 THEN '' ELSE '_' || (k - 1) END AS player_id FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer)""")
def win1_unique_slug(spark, sf_dir):
    return P.unique_slug(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey").select("c_custkey", "player_id")


@query("SELECT DISTINCT o_custkey AS player FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def jon7_check_references(spark, sf_dir):
    child = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player"))
    return P.check_references(child, table(spark, sf_dir, "customer").filter("c_custkey % 7 != 0").select(F.col("c_custkey").alias("player")), "player").select("player")


@query("SELECT o_orderkey, o_custkey, year(o_orderdate)::INT AS season FROM orders")
def top1_sorted_dataset(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("season"))
    return P.sorted_dataset(o, ["o_custkey", "season", "o_orderkey"])


def raw_players(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    pos = F.expr("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'QB' WHEN '2' THEN 'RB' WHEN '3' THEN 'WR' WHEN '4' THEN 'TE' ELSE 'K' END")
    season = F.struct(F.year("o_orderdate").cast("string").alias("Season"), (20 + F.col("o_orderkey") % 15).cast("string").alias("Age"), F.concat(F.lit("T"), F.col("o_orderkey") % 3).alias("Team"), pos.alias("Pos"), (F.col("o_orderkey") % 17).cast("string").alias("G"), F.lit("0").alias("GS"), F.lit("Pro Bowl").alias("Awards"), F.create_map(F.lit("Yds"), F.format_number("o_totalprice", 0)).alias("stats"))
    lists = o.withColumn("s", F.struct("o_orderkey", season.alias("v"))).groupBy("o_custkey").agg(F.array_sort(F.collect_list("s"), lambda a, b: F.signum(a["o_orderkey"] - b["o_orderkey"]).cast("int")).alias("l"))
    rows = c.join(lists, F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("name"), F.lit("March 5").alias("birth_date"), (1960 + F.col("c_custkey") % 30).cast("string").alias("birth_place"), F.col("c_mktsegment").alias("college"), F.transform("l", lambda x: x["v"]).alias("seasons"))


def _trivia(spark, sf_dir):
    history = P.team_history(spark, [("T0", 1990, "Old Town", "OLD"), ("T0", 1995, "New Town", "NEW")])
    static = spark.createDataFrame([("T2", "Static Bay", "STA")], "code string, team_full string, team_abbrs string")
    return P.trivia_dataset(raw_players(spark, sf_dir), history, static, season_min=1992)


@query()
def job2_trivia_dataset(spark, sf_dir):
    """All tables of the dataset, a row each as JSON."""
    parts = [t.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row")) for name, t in _trivia(spark, sf_dir).items()]
    return reduce(lambda a, b: a.union(b), parts)


# ---- sheets over customer and supplier

def sheet(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    about = F.concat(F.lit("We develop innovative "), F.lower(F.element_at(F.array(F.lit("Pumps"), F.lit("Valves"), F.lit("Sensors")), (F.col("s_suppkey") % 3 + 1).cast("int"))), F.lit(" and tools. Revenue is $5 million. Based in Ohio."))
    return s.select(F.col("s_name").alias("Company Name"), F.concat(F.lit("https://www.s"), "s_suppkey", F.lit(".example.com/about")).alias("Website"), F.when(F.col("s_suppkey") % 4 != 0, about).alias("Description"), F.when(F.col("s_suppkey") % 8 == 0, F.lit("Welding; Repair, Paint")).alias("Specialties"), F.lit("Energy, Mining; Oil").alias("End Markets"), F.lit("Industrial").alias("Industries"))


_WHAT = "CASE s_suppkey % 3 WHEN 0 THEN 'pumps' WHEN 1 THEN 'valves' ELSE 'sensors' END"


@query(f"""SELECT s_name AS company, s_name || CASE WHEN s_suppkey % 4 <> 0 THEN ' develops develop ' || {_WHAT} || ' and tools. for Energy and Mining.' WHEN s_suppkey % 8 = 0 THEN ' specializes in Welding, Repair, and Paint for Energy and Mining.' ELSE ' provides industrial-related services (details not specified).' END AS summary FROM supplier""")
def job4_company_summary(spark, sf_dir):
    return OC.with_summaries(sheet(spark, sf_dir)).select(F.col("Company Name").alias("company"), F.col("Summary").alias("summary"))


@query()
def job5_standardize_description(spark, sf_dir):
    c = [F.col(f"`{n}`") for n in ("Company Name", "Website", "Description", "Specialties", "Industries", "End Markets")]
    return sheet(spark, sf_dir).select(c[0].alias("company"), C.standardize_description(c[0], F.lit(""), c[1], c[2], c[3], c[4], c[5]).alias("sentence"))


@query(f"""SELECT s_name AS company, 'https://www.s' || s_suppkey || '.example.com' AS website, CASE WHEN s_suppkey % 4 <> 0 THEN 'We develop innovative ' || {_WHAT} || ' and tools. Revenue is $5 million. Based in Ohio.' ELSE 'Energy, Mining; Oil' END AS summary FROM supplier""")
def job3_target_list(spark, sf_dir):
    return OC.target_list(sheet(spark, sf_dir)).select(F.col("Company").alias("company"), F.col("Website").alias("website"), F.col("Summary").alias("summary"))


@query("""WITH k AS (SELECT p_partkey, p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part) SELECT p_name AS name, p_partkey AS pos FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p_partkey) AS n FROM k WHERE key <> '') WHERE n = 1""")
def agg10_dedupe_companies(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    return OC.dedupe_companies(rows, ())


@query("""WITH c AS (SELECT p_brand AS url, count(*) AS n, count(*) FILTER (p_partkey % 3 = 0 AND p_partkey % 2 = 0 AND p_partkey % 5 <> 0) AS complete, count(*) FILTER (p_partkey % 5 = 0) AS empty FROM part GROUP BY 1) SELECT url, n, complete, empty, greatest(0, least(200, least(10 * n, 100) + 20 * complete + 10 - 5 * empty))::BIGINT AS score FROM c""")
def agg9_directory_score(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_brand").alias("url"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, "x").alias("contact"), F.when(F.col("p_partkey") % 2 == 0, "y").alias("website"))
    meta = p.select(F.col("p_brand").alias("url")).distinct().select("url", F.lit("t").alias("title"), F.lit("").alias("description"))
    return OC.directory_score(rows, meta).select("url", "n", "complete", "empty", F.col("score").cast("long").alias("score"))


@query("""WITH b AS (SELECT p_brand AS url, count(*) AS n, bool_or(p_partkey % 3 = 0) AS has_contact, bool_or(p_partkey % 2 = 0) AS has_site FROM part GROUP BY 1) SELECT url, n AS n_companies, has_contact, has_site FROM b""")
def agg8_companies_per_url(spark, sf_dir):
    company = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "x").alias("contact"), F.when(F.col("p_partkey") % 2 == 0, "y").alias("website"))
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("url")).agg(F.collect_list(company).alias("companies"))
    return L.companies_per_url(rows).withColumn("n_companies", F.col("n_companies").cast("long"))


_FIELDS = [("brand", ["Brand", "Make"], True), ("kind", ["Economy", "Standard", "Type"], False), ("size", ["Size"], True)]


_BARE_NAME = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_SIMILAR = """CASE WHEN a = b THEN 1.0::DOUBLE ELSE greatest(CASE WHEN (contains(a, b) OR contains(b, a)) AND least(length(a), length(b)) > 0 THEN 0.8 * least(length(a), length(b)) / greatest(length(a), length(b)) ELSE 0 END,
  (greatest(length(a), length(b)) - levenshtein(a, b))::DOUBLE / greatest(length(a), length(b))) END"""
_NAMED = ", ".join(f"('{t}', '{n}')" for t, names, _ in _FIELDS for n in names)
_NEAREST = f"""WITH h AS (SELECT p_type AS header, min(p_partkey) AS pos FROM part GROUP BY 1), d AS (SELECT * FROM (VALUES {_NAMED}) v(target_field, name)),
  s AS (SELECT header, pos, target_field, max({_SIMILAR}) AS score FROM (SELECT header, pos, target_field, {_BARE_NAME.format("header")} AS a, {_BARE_NAME.format("name")} AS b FROM h, d) GROUP BY ALL)"""


def _headers(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("header")).agg(F.min("p_partkey").alias("pos"))


@query(f"""{_NEAREST}, b AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY score DESC, target_field) AS k FROM s), m AS (SELECT *, row_number() OVER (PARTITION BY target_field ORDER BY pos) AS i FROM b WHERE k = 1 AND score >= 0.6)
  SELECT h.header, m.target_field, round(m.score, 4) AS score FROM h LEFT JOIN m ON h.header = m.header AND m.i = 1""")
def jon4_auto_map_headers(spark, sf_dir):
    defs = spark.createDataFrame(_FIELDS, "target_field string, source_headers array<string>, required boolean")
    return M.auto_map_headers(_headers(spark, sf_dir), defs).select("header", "target_field", F.round("score", 4).alias("score"))


@query(f"""{_NEAREST}, b AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY score DESC, target_field) AS rank FROM s WHERE target_field <> 'size' AND score >= 0.3) SELECT header, target_field, round(score, 4) AS score, rank FROM b WHERE rank <= 3""")
def jon5_suggest_mappings(spark, sf_dir):
    defs = spark.createDataFrame(_FIELDS, "target_field string, source_headers array<string>, required boolean")
    used = spark.createDataFrame([("size",)], "target_field string")
    return M.suggest_mappings(_headers(spark, sf_dir), defs, used).select("header", "target_field", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH c AS (SELECT 'p_brand' AS c, 0 AS o, count(*) FILTER (p_brand <> '') AS n FROM part UNION ALL SELECT 'p_name', 1, count(*) FILTER (p_name <> '') FROM part UNION ALL SELECT 'p_type', 0, count(*) FILTER (p_type <> '') FROM part)
  SELECT (row_number() OVER (ORDER BY o, c) - 1)::INT AS pos, c AS column_name FROM c WHERE n > 0""")
def top4_report_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type", F.lit("").alias("blank"), F.lit(None).cast("string").alias("none"))
    names = M.report_columns(rows, [{"target_field": c, "required": c in ("p_type", "p_brand", "none")} for c in rows.columns])
    return spark.createDataFrame(list(enumerate(names)), "pos int, column_name string")


_ABOUT = f"CASE WHEN s_suppkey % 4 <> 0 THEN 'We develop innovative ' || {_WHAT} || ' and tools. Revenue is $5 million. Based in Ohio.' END"
_CELLS = f"""SELECT 'Company Name' AS header, s_name AS v FROM supplier UNION ALL SELECT 'Website', 'https://www.s' || s_suppkey || '.example.com/about' FROM supplier UNION ALL SELECT 'Description', {_ABOUT} FROM supplier
  UNION ALL SELECT 'Specialties', CASE WHEN s_suppkey % 8 = 0 THEN 'Welding; Repair, Paint' END FROM supplier UNION ALL SELECT 'End Markets', 'Energy, Mining; Oil' FROM supplier UNION ALL SELECT 'Industries', 'Industrial' FROM supplier"""


@query(f"""WITH c AS (SELECT header, trim(v) AS v, regexp_matches(trim(v), '(?i)^(https?://)?([a-z0-9-]+\\.)+[a-z]{{2,}}(/.*)?$') AS u FROM ({_CELLS})), h AS (SELECT header, lower(regexp_extract(v, '^(?:https?://)?([^/]+)', 1)) AS host, count(*) AS n FROM c WHERE u GROUP BY 1, 2),
  t AS (SELECT header, arg_max(host, n::VARCHAR || ' ' || host) AS top_host FROM h GROUP BY 1)
  SELECT header, count(*) FILTER (v <> '') AS n, round(coalesce(count(*) FILTER (u) * 1.0 / nullif(count(*) FILTER (v <> ''), 0), 0), 4)::DOUBLE AS url_share, round(coalesce(count(*) FILTER (length(v) >= 40 AND regexp_matches(v, '\\s')) * 1.0 / nullif(count(*) FILTER (v <> ''), 0), 0), 4)::DOUBLE AS paragraph_share, any_value(top_host) AS top_host
  FROM c LEFT JOIN t USING (header) GROUP BY 1""")
def agg13_column_shape(spark, sf_dir):
    return M.column_shape(sheet(spark, sf_dir)).select("header", "n", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("url_share", "paragraph_share")], "top_host")


# ---- further operators

@query("""SELECT o_orderkey, year(o_orderdate)::INT AS season, (o_orderkey % 17)::DOUBLE AS games FROM orders WHERE o_orderkey % 10 <> 0 AND year(o_orderdate) BETWEEN 1993 AND 1997 AND o_orderkey % 17 >= 3 AND substr(o_orderpriority, 1, 1) IN ('1', '2')""")
def flt1_eligible_seasons(spark, sf_dir):
    season = F.when(F.col("o_orderkey") % 10 == 0, "Career").otherwise(F.year("o_orderdate").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", season.alias("season_text"), (F.col("o_orderkey") % 17).cast("string").alias("games_text"), F.substring("o_orderpriority", 1, 1).alias("position"))
    return P.eligible_seasons(rows, 1993, 1997, 3, ("1", "2")).select("o_orderkey", "season", "games")


@query("""SELECT event_id FROM events WHERE event_type <> 'error' AND event_id % 100 >= 70""")
def flt2_ma_detected(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 100).alias("confidence"))
    return L.ma_detected(rows, 70).select("event_id")


@query("""WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'dup' WHEN c_custkey % 51 = 0 THEN 'Bad Id' ELSE 'id_' || c_custkey END AS player_id FROM customer), d AS (SELECT player_id FROM p GROUP BY 1 HAVING count(*) > 1)
  SELECT 'pattern' AS "check", player_id AS key, count(*) AS n FROM p WHERE NOT regexp_matches(player_id, '^[a-z0-9_]+$') GROUP BY 2 UNION ALL SELECT 'unique', player_id, 1 FROM d UNION ALL SELECT 'range', year(o_orderdate)::VARCHAR, count(*) FROM orders WHERE year(o_orderdate) < 1997 GROUP BY 2
  UNION ALL SELECT 'reference', x, 1 FROM (SELECT DISTINCT 'id_' || o_custkey AS x FROM orders) WHERE x NOT IN (SELECT player_id FROM p)""")
def agg18_dataset_checks(spark, sf_dir):
    ids = F.expr("CASE WHEN c_custkey % 50 = 0 THEN 'dup' WHEN c_custkey % 51 = 0 THEN 'Bad Id' ELSE concat('id_', c_custkey) END")
    players = table(spark, sf_dir, "customer").select(ids.alias("player_id"), F.col("c_name").alias("full_name"))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("id_"), "o_custkey").alias("player_id"), F.year("o_orderdate").alias("season"))
    return P.dataset_checks({"players": players, "seasons": rows}).groupBy("check", "key").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT DISTINCT p_type AS t FROM part WHERE p_type <> 'ECONOMY') SELECT 'unknown_target' AS "check", t AS field FROM m WHERE t NOT IN ('STANDARD', 'ECONOMY', 'MISSING') UNION ALL SELECT 'duplicate_target', p_type FROM part WHERE p_type <> 'ECONOMY' GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'missing_required', f FROM (SELECT unnest(['ECONOMY', 'MISSING']) AS f)""")
def jon9_validate_mapping(spark, sf_dir):
    mapping = table(spark, sf_dir, "part").filter("p_type != 'ECONOMY'").select(F.col("p_name").alias("header"), F.col("p_type").alias("target_field"))
    defs = spark.createDataFrame([("STANDARD", False), ("ECONOMY", True), ("MISSING", True)], "target_field string, required boolean")
    return M.validate_mapping(mapping, defs)


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'Pro Bowl' END, CASE WHEN o_orderkey % 3 = 0 THEN '1st Team All-Pro' END, CASE WHEN o_orderkey % 5 = 0 THEN 'MVP' END], lambda x: x IS NOT NULL), '|') AS awards FROM orders""")
def scl5_parse_awards(spark, sf_dir):
    text = F.concat_ws(", ", F.when(F.col("o_orderkey") % 5 == 0, "AP MVP-2"), F.when(F.col("o_orderkey") % 3 == 0, "All-Pro"), F.when(F.col("o_orderkey") % 2 == 0, "PRO BOWL"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(P.parse_awards(text), "|").alias("awards"))


@query("""WITH h AS (SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM customer) SELECT c_custkey, ['provides', 'delivers', 'offers', 'supplies'][abs(h) % 4 + 1] AS verb FROM h""")
def scl20_hash_pick(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.hash_pick(C.SERVICE, F.col("c_name")).alias("verb"))


@query("""WITH r AS (SELECT s_suppkey, 'tel: (' || (200 + s_suppkey % 700) || ') 555-0100 ext' AS p, CASE WHEN s_suppkey % 2 = 0 THEN ' ' ELSE 'http://' END || 's' || s_suppkey || '.com' AS w FROM supplier)
  SELECT s_suppkey, trim(regexp_replace(p, '[^0-9()+ -]', '', 'g')) AS phone, CASE WHEN regexp_matches(w, '^https?://') THEN w ELSE 'https://' || trim(w) END AS website FROM r""")
def scl22_clean_contacts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    phone = F.concat(F.lit("tel: ("), 200 + F.col("s_suppkey") % 700, F.lit(") 555-0100 ext"))
    site = F.concat(F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise("http://"), F.lit("s"), "s_suppkey", F.lit(".com"))
    return s.select("s_suppkey", T.clean_phone(phone).alias("phone"), T.clean_website(site).alias("website"))


@query("""WITH r AS (SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'x' END AS contact, CASE WHEN p_partkey % 3 = 0 THEN 'y' ELSE '' END AS website FROM part)
  SELECT p_partkey, round(0.3 * (coalesce(name, '') <> '')::INT + 0.2 * (coalesce(contact, '') <> '')::INT + 0.2 * (website <> '')::INT, 4)::DOUBLE AS confidence FROM r""")
def scl28_record_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "x").alias("contact"), F.when(F.col("p_partkey") % 3 == 0, "y").otherwise("").alias("website"))
    return T.record_confidence(rows, "company").select("p_partkey", "confidence")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '''' || c_acctbal ELSE 'b' || c_acctbal END AS a, '''=' || c_name AS b FROM customer""")
def snk2_sanitize_formulas(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", F.when(F.col("c_acctbal") < 0, F.col("c_acctbal").cast("string")).otherwise(F.concat(F.lit("b"), "c_acctbal")).alias("a"), F.concat(F.lit("="), "c_name").alias("b"))
    from ..sources.io import sanitize_formulas

    return sanitize_formulas(rows)


@query("""WITH e AS (SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS s, user_id AS job_id, event_type = 'error' AS bad, CASE WHEN event_id % 5 <> 0 THEN 'class' || event_id % 3 ELSE 'unknown' END AS kind, value FROM events),
  k AS (SELECT s, job_id, string_agg(kind || '=' || n, ' ' ORDER BY kind) AS error_classes FROM (SELECT s, job_id, kind, count(*) AS n FROM e WHERE bad GROUP BY ALL) GROUP BY ALL)
  SELECT s AS "start", job_id, count(*) AS total, count(*) FILTER (bad) AS failed, min(value) AS min_ms, max(value) AS max_ms, coalesce(any_value(error_classes), '') AS error_classes FROM e LEFT JOIN k USING (s, job_id) GROUP BY s, job_id""")
def str2_request_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("ts", F.col("user_id").alias("job_id"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("response_time_ms"), F.expr("CASE WHEN event_id % 5 <> 0 THEN concat('class', event_id % 3) END").alias("class"))
    out = S.stream_request_counters(rows, window="1 hour", error_class="class")
    text = F.array_join(F.transform(F.map_entries("error_classes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "job_id", "total", "failed", "min_ms", "max_ms", text.alias("error_classes"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
  SELECT user_id::VARCHAR AS session_id, count(*) AS processed, count(*) FILTER (event_type = 'error') AS failed, max(event_id) AS last_index FROM s GROUP BY user_id, k""")
def str6_session_progress(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("ts", F.col("user_id").cast("string").alias("sessionId"), (F.col("event_type") != "error").alias("success"), F.col("event_id").alias("idx"))
    return S.stream_session_progress(rows, "30 minutes").select(F.col("sessionId").alias("session_id"), "processed", "failed", "last_index")


# ---- files: given tables written in each format and read back

def _run(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@query("SELECT url, page_id FROM (SELECT page_id, url FROM pages) WHERE url <> ''")
def src1_url_list(spark, sf_dir):
    """Lines of a file: URLs between blanks, empty lines and comments."""
    path = fresh_path(spark, "urls")
    p = table(spark, sf_dir, "pages")
    lines = p.select(F.explode(F.array(F.concat(F.lit("# page "), "page_id"), F.lit("  "), F.concat(F.lit(" "), "url", F.lit("#id="), "page_id", F.lit(" ")))).alias("value"))
    lines.write.text(path)
    return IO.read_url_list(spark, path).select(F.regexp_extract("url", "^(.*)#id=[0-9]+$", 1).alias("url"), F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page_id"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN chr(39) || '=' ELSE '' END || c_name AS name, 'a, \"b\"' || chr(10) || c_mktsegment AS note FROM customer")
def src2_company_csv(spark, sf_dir):
    path = fresh_path(spark, "csv")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "=").otherwise(""), "c_name").alias("name"), F.concat(F.lit('a, "b"\n'), "c_mktsegment").alias("note"))
    IO.write_csv(c, path)
    return IO.read_company_csv(spark, path)


def _lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("https://h"), "user_id", F.lit(".example.com/"), F.col("event_id") % 50, F.lit("?utm_source=x"), "event_id").alias("url"), (F.col("event_type") != "error").alias("success"), F.col("event_id").alias("processingTime"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.concat(F.lit("s"), F.col("user_id") % 10).alias("sessionId"))


_PER_SESSION = "SELECT 's' || user_id % 10 AS session_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS good, sum(event_id)::BIGINT AS total FROM events GROUP BY 1"


def _per_session(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("sessionId").alias("session_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("good"), F.sum("processingTime").alias("total"))


@query(_PER_SESSION)
def src4_results_jsonl(spark, sf_dir):
    path = fresh_path(spark, "jsonl")
    IO.write_jsonl(_lines(spark, sf_dir), path)
    return _per_session(IO.read_results_jsonl(spark, path))


@query(_PER_SESSION)
def str1_results_to_table(spark, sf_dir):
    """A stream of result files into a table, then into folders by session and batch; what is read back is the latter."""
    path = fresh_path(spark, "stream")
    IO.write_jsonl(_lines(spark, sf_dir), f"{path}/in")
    _run(S.stream_results_to_table(spark, f"{path}/in", f"{path}/table", f"{path}/table-log"))
    rows = spark.readStream.schema(spark.read.parquet(f"{path}/table").schema).parquet(f"{path}/table")
    _run(S.stream_results_by_session(rows, f"{path}/sessions", f"{path}/sessions-log"))
    return _per_session(S.read_sessions(spark, f"{path}/sessions", IO.RESULTS))


@query("SELECT 'https://h' || user_id || '.example.com/' || event_id % 50 AS normalized FROM events GROUP BY 1")
def str3_dedupe_urls(spark, sf_dir):
    path = fresh_path(spark, "stream")
    IO.write_jsonl(_lines(spark, sf_dir), f"{path}/in")
    rows = IO.read_results_jsonl(spark, f"{path}/in", streaming=True).withColumn("ts", F.timestamp_millis("timestamp"))
    seen = S.stream_dedupe_urls(rows, "3650 days").select("normalized")
    _run(seen.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start())
    return spark.read.parquet(f"{path}/out")


def _documents_of(pages: DataFrame, item, root: str, path: str) -> None:
    """XML files of up to a hundred items each under one root."""
    files = pages.groupBy(F.floor(F.col("page_id") / 100)).agg(F.concat(F.lit(f"<{root}>"), F.array_join(F.collect_list(item), "\n"), F.lit(f"</{root}>")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)


@query("SELECT url, 'Page ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'About <b>' || page_id || '</b>' ELSE 'Sum ' || page_id END AS description, 'feed' AS source FROM pages")
def src5_feeds(spark, sf_dir):
    path = fresh_path(spark, "feed")
    p = table(spark, sf_dir, "pages").withColumn("u", F.replace("url", F.lit("&"), F.lit("&amp;")))
    item = F.concat(F.lit("<item><title>Page "), "page_id", F.lit("</title><link>"), "u", F.lit("</link><description><![CDATA[About <b>"), "page_id", F.lit("</b>]]></description></item>"))
    entry = F.concat(F.lit("<entry><title>Page "), "page_id", F.lit('</title><link href="'), "u", F.lit('"/><updated>2024</updated><summary>Sum '), "page_id", F.lit("</summary></entry>"))
    _documents_of(p, F.when(F.col("page_id") % 2 == 0, item).otherwise(entry), "rss", path)
    return IO.read_feeds(spark, path, "feed").select("url", "title", "description", "source")


@query("SELECT url, 'map' AS source FROM pages")
def src6_sitemaps(spark, sf_dir):
    path = fresh_path(spark, "sitemap")
    p = table(spark, sf_dir, "pages").withColumn("u", F.replace("url", F.lit("&"), F.lit("&amp;")))
    _documents_of(p, F.concat(F.lit("<url><loc> "), "u", F.lit(" </loc><priority>1</priority></url>")), "urlset", path)
    return IO.read_sitemaps(spark, path, "map")


@query("SELECT 'nation' AS name, n_nationkey AS k FROM nation UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def snk4_tables(spark, sf_dir):
    path = fresh_path(spark, "tables")
    IO.write_tables({n: table(spark, sf_dir, n) for n in ("nation", "supplier")}, path)
    part = lambda n, k: spark.read.parquet(f"{path}/{n}").select(F.lit(n).alias("name"), F.col(k).cast("long").alias("k"))
    return part("nation", "n_nationkey").union(part("supplier", "s_suppkey"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'OLB' ELSE 'XY' END AS position, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'JAX' ELSE 'DAL' END AS team FROM customer""")
def scl21_normalizers(spark, sf_dir):
    pos, team = F.expr("CASE c_custkey % 4 WHEN 0 THEN ' Quarterback ' WHEN 1 THEN 'HALFBACK' WHEN 2 THEN 'outside linebacker' ELSE 'xy' END"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'GB' WHEN 1 THEN 'JAC' ELSE 'DAL' END")
    return table(spark, sf_dir, "customer").select("c_custkey", P.normalize_position(pos).alias("position"), P.normalize_name(F.concat(F.lit("  "), "c_name", F.lit("   (old)"))).alias("name"), P.normalize_team_code(team).alias("team"))


@query("""SELECT c_custkey, (20 + 15 * (c_custkey % 2) + 10 * (c_custkey % 3 = 0)::INT + 10 + 15 * (c_custkey % 5 = 0)::INT + 10 * (c_custkey % 7 = 0)::INT + 5 * (c_custkey % 11 = 0)::INT)::DOUBLE AS quality FROM customer""")
def scl27_structured_quality(spark, sf_dir):
    when = lambda k, value: F.when(F.col("c_custkey") % k == 0, value)
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 1, "QB").otherwise("").alias("position"), when(3, F.lit("6-2")).alias("height"), F.lit("200").alias("weight"), F.col("c_mktsegment").alias("college"), F.lit("").alias("birth_date"), when(5, F.lit("r1")).alias("draft"),
        when(7, F.create_map(F.lit("a"), F.lit("b"))).alias("career"), F.array().cast("array<string>").alias("seasons"), F.create_map().cast("map<string, string>").alias("playoffs"), when(11, F.array(F.lit("MVP"))).alias("achievements"),
    )
    return H.structured_quality(rows).select("c_custkey", F.col("quality").cast("double").alias("quality"))

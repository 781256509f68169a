"""HTML pages: one tolerant parse to a struct of parts, everything else ordinary columns on it."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..shared import stored
from .text import filled, lookup, squeezed, trimmed, weighted
from .urls import resolve_link

PAGE = (
    "title string, h1 string, lang string, body string, article string, "
    "meta map<string, string>, marks map<string, int>, headings array<struct<level: int, text: string>>, "
    "links array<struct<href: string, text: string, rel: string>>, images array<struct<src: string, alt: string, title: string, caption: string, width: int, height: int, inside: boolean>>, paragraphs array<string>, "
    "times array<string>, authors array<string>, items array<struct<title: string, href: string, text: string>>, "
    "tables array<struct<id: string, rows: array<array<string>>, head: boolean>>, "
    "blocks array<struct<tag: string, text: string, p: int, h: int, lists: int, tables: int, links: int>>, found map<string, array<struct<text: string, value: string>>>, error string"
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("address article aside blockquote dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p section table td th tr ul".split())
_HIDDEN = frozenset(("script", "style", "noscript"))


def _clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


#: Ordered selectors of article fields; the first whose first element is not blank counts.
ARTICLE_SELECTORS = {
    "title": ('h1[class*="title"]', 'h1[class*="headline"]', ".article-title", ".entry-title", "article h1"),
    "byline": (".byline", ".author-byline", ".article-byline", '[class*="byline"]', ".author-info", ".article-meta .author"),
    "author": ('[rel="author"]', ".author", ".article-author", '[class*="author"]', '[property="article:author"]', '[name="author"]'),
    "published": ('[property="article:published_time"]', '[name="article:published_time"]', "time[datetime]", ".publish-date", ".article-date", '[class*="publish"]', '[class*="date"]'),
    "modified": ('[property="article:modified_time"]', '[name="article:modified_time"]', ".modified-date", ".updated-date"),
    "excerpt": ('[property="og:description"]', '[name="description"]', ".article-excerpt", ".excerpt", ".summary", ".lead"),
    "category": (".category", ".article-category", '[class*="category"]', ".breadcrumb a"),
}
#: Selectors all of whose elements count.
TAG_SELECTORS = (".tags a", ".tag", '[class*="tag"]')
BIO_SELECTORS = (".player-info", ".bio", ".profile-header", ".player-details", '[class*="player"][class*="info"]', '[class*="player"][class*="bio"]', ".stats-header", ".necro-jersey", ".player-summary", ".player-header", ".bio-info", '[id*="player-info"]')
FACT_SELECTORS = (".question", ".faq", ".bio-section", ".personal-info", '[class*="question"]', '[class*="faq"]', ".player-facts", ".vital-stats", ".biographical", ".profile-data")
AWARD_SELECTORS = (".awards", ".honors", ".achievements", ".accolades", '[class*="award"]', '[class*="honor"]', '[class*="achievement"]', ".pro-bowl", ".all-pro", ".hall-of-fame", ".records")
JERSEY_SELECTORS = (".necro-jersey", ".player-position")
SELECTORS = tuple(dict.fromkeys([x for xs in ARTICLE_SELECTORS.values() for x in xs] + [*TAG_SELECTORS, *BIO_SELECTORS, *FACT_SELECTORS, *AWARD_SELECTORS, *JERSEY_SELECTORS]))
_SIMPLE = re.compile(r"""^([a-z][a-z0-9]*)?|\.([\w-]+)|\[([\w-]+)(?:(\*?=)"([^"]*)")?\]""")


class _Test:
    """One step of a selector: a tag, class names and attributes that are there, equal a value or hold it."""

    def __init__(self, step: str):
        parts = list(_SIMPLE.finditer(step))
        self.tag = parts[0][1]
        self.classes = frozenset(m[2] for m in parts if m[2])
        self.attributes = [(m[3], m[4], m[5]) for m in parts if m[3]]

    def __call__(self, tag: str, attrs: dict, classes: frozenset) -> bool:
        if self.tag and self.tag != tag or not self.classes <= classes:
            return False
        return all(name in attrs and (how is None or (value == attrs[name] if how == "=" else value in attrs[name])) for name, how, value in self.attributes)


class _Finder:
    """Which selectors an element meets. Selectors are indexed by what an element must have, so few are tried on each."""

    def __init__(self, selectors: tuple[str, ...]):
        self.by_tag: dict[str, list] = {}
        self.by_class: dict[str, list] = {}
        self.by_attribute: dict[str, list] = {}
        for s in selectors:
            steps = [_Test(x) for x in s.split()]
            last = steps[-1]
            if last.classes:
                self.by_class.setdefault(min(last.classes), []).append((s, steps))
            elif last.attributes:
                self.by_attribute.setdefault(last.attributes[0][0], []).append((s, steps))
            else:
                self.by_tag.setdefault(last.tag, []).append((s, steps))

    def met(self, tag: str, attrs: dict, stack: list) -> list[str]:
        classes = frozenset(attrs.get("class", "").split())
        tried = [*self.by_tag.get(tag, ()), *(x for c in classes for x in self.by_class.get(c, ())), *(x for a in attrs for x in self.by_attribute.get(a, ()))]
        out = []
        for s, steps in tried:
            if not steps[-1](tag, attrs, classes):
                continue
            left = len(steps) - 2
            for name, a in reversed(stack):  # ancestors, nearest first
                if left < 0:
                    break
                left -= steps[left](name, a, frozenset(a.get("class", "").split()))
            if left < 0:
                out.append(s)
        return out


_FINDER = _Finder(SELECTORS)


#: Texts that are collected, and the parts of a page that need them.
_MADE_OF = {
    "p": {"paragraphs"}, "heading": {"headings", "h1"}, "a": {"links", "items"}, "item": {"items"}, "found": {"found"}, "caption": {"images"}, "author": {"authors"}, "time": {"times"}, "cell": {"tables"}, "block": {"blocks"},
}


def _number(text: str | None) -> int | None:
    m = re.match(r"\s*\d{1,9}", text or "")
    return int(m[0]) if m else None


class _Parts(HTMLParser):
    """Collects a page's parts, those in `want`; a <p> ends where the next block begins, unclosed tags end with their parent."""

    def __init__(self, want: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.want = want
        self.kinds = frozenset(kind for kind, parts in _MADE_OF.items() if want & parts)
        self.stack: list[tuple[str, dict]] = []
        self.out: dict = {"title": [], "body": [], "article": [], "meta": {}, "marks": {}, "headings": [], "links": [], "images": [], "paragraphs": [], "times": [], "authors": [], "items": [], "tables": [], "blocks": [], "found": {}, "lang": None}
        self.open: list[tuple[str, list[str], dict]] = []  # texts being collected: kind, parts, data
        self.table: list[dict] = []
        self.count = 0

    def _mark(self, name: str) -> None:
        self.out["marks"][name] = self.out["marks"].get(name, 0) + 1

    def _space(self, tag: str) -> None:
        """Blocks and line breaks part words."""
        if tag in _BLOCK or tag == "br":
            for parts in (self.out["body"], self.out["article"], *(p for _, p, _ in self.open)):
                parts.append(" ")

    def _begin(self, kind: str, **data) -> None:
        if kind in self.kinds:
            self.open.append((kind, [], data))

    def _end(self, kind: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == kind:
                _, parts, data = self.open.pop(i)
                if kind == "found":
                    data["raw"] = "".join(parts).strip()
                self._done(kind, _clean(parts), data)
                return

    def _done(self, kind: str, text: str, data: dict) -> None:
        out = self.out
        if kind == "p":
            if text:
                out["paragraphs"].append(text)
        elif kind == "heading":
            out["headings"].append({"level": data["level"], "text": text})
        elif kind == "a":
            out["links"].append({"href": data["href"], "text": text, "rel": data["rel"]})
            for k, parts, d in self.open:
                if k == "item" and d["href"] is None:
                    d["href"], d["title"] = data["href"], d["title"] or text
        elif kind == "found":
            data["at"]["text"] = data["raw"]
        elif kind == "caption":
            inside = {a["_n"] for _, a in self.stack} | data["own"]
            for image in out["images"]:
                if image["_in"] in inside and not image["caption"]:
                    image["caption"] = text
        elif kind == "author":
            out["authors"].append(text)
        elif kind == "time":
            out["times"].append(data["at"] or text)
        elif kind == "item":
            out["items"].append({"title": data["title"] or text[:80], "href": data["href"], "text": text[:500]})
        elif kind == "cell" and self.table and self.table[-1]["rows"]:
            self.table[-1]["rows"][-1].append(text)
        elif kind == "block":
            out["blocks"].append({"tag": data["tag"], "text": text, "p": data["p"], "h": data["h"], "lists": data["lists"], "tables": data["tables"], "links": data["links"]})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        words = f"{a.get('class', '')} {a.get('id', '')}".lower()
        self.count += 1
        a["_n"] = self.count
        if "marks" in self.want:
            self._mark(tag)
            for w in set(a.get("class", "").lower().split()):
                self._mark("." + w)
            for sign, name in (("#", "id"), ("@", "itemprop"), ("=", "role")):
                if a.get(name):
                    self._mark(sign + a[name])
            if "data-stat" in a:
                self._mark("data-stat")
        if tag == "html" and a.get("lang"):
            self.out["lang"] = a["lang"]
        if tag == "meta" and (name := a.get("name") or a.get("property")):
            self.out["meta"].setdefault(name.lower(), a.get("content", ""))
        elif tag == "img" and a.get("src") and "images" in self.want:
            inside = any(t == "article" or {"article-content", "content"} & set(x.get("class", "").split()) for t, x in self.stack)
            parent = self.stack[-1][1]["_n"] if self.stack else 0
            self.out["images"].append({"src": a["src"], "alt": a.get("alt", ""), "title": a.get("title") or None, "caption": None, "width": _number(a.get("width")), "height": _number(a.get("height")), "inside": inside, "_in": parent})
        elif tag == "table":
            self.table.append({"id": words.strip(), "rows": [], "head": False})
        elif tag == "tr" and self.table:
            self._end("cell")
            self.table[-1]["rows"].append([])
        elif tag in ("td", "th") and self.table and self.table[-1]["rows"]:
            self._end("cell")
            self.table[-1]["head"] |= tag == "th"
            self._begin("cell")
        if tag in _BLOCK:
            self._end("p")
        self._space(tag)
        for kind, _, data in self.open:
            if kind == "block":
                data["p"] += tag == "p"
                data["h"] += tag in ("h1", "h2", "h3", "h4", "h5", "h6")
                data["lists"] += tag in ("ul", "ol")
                data["tables"] += tag == "table"
                data["links"] += tag == "a"
        met = _FINDER.met(tag, a, self.stack) if "found" in self.want else ()
        places = []
        for selector in met:
            places.append({"text": "", "value": a.get("content") or a.get("datetime")})
            self.out["found"].setdefault(selector, []).append(places[-1])
        if tag in _VOID:
            return
        for place in places:
            self._begin("found", at=place)
        a["_found"] = len(places)
        if tag == "figcaption" or "caption" in a.get("class", "").split():
            self._begin("caption", own={a["_n"]})
            a["_caption"] = "1"
        if tag == "p":
            self._begin("p")
        elif tag in ("h1", "h2", "h3"):
            self._begin("heading", level=int(tag[1]))
        elif tag == "a" and a.get("href") is not None:
            self._begin("a", href=a["href"], rel=a.get("rel", ""))
        elif tag == "time":
            self._begin("time", at=a.get("datetime", ""))
        if tag in ("article", "main", "section") or tag == "div" and any(w in words for w in ("content", "article", "post", "entry")):
            self._begin("block", tag=tag, p=0, h=0, lists=0, tables=0, links=0)
            a["_block"] = "1"
        if any(w in words for w in ("author", "byline")) or a.get("itemprop") == "author":
            self._begin("author")
            a["_author"] = "1"
        if tag in ("li", "div", "article") and any(w in words for w in ("listing", "company", "supplier", "card", "result")):
            self._begin("item", title="", href=None)
            a["_item"] = "1"
        self.stack.append((tag, a))

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.stack]:
            return
        while self.stack:
            name, a = self.stack.pop()
            for _ in range(a.get("_found", 0)):
                self._end("found")
            for kind in ("block", "author", "item", "caption"):
                if f"_{kind}" in a:
                    self._end(kind)
            closes = {"p": "p", "h1": "heading", "h2": "heading", "h3": "heading", "a": "a", "time": "time", "td": "cell", "th": "cell", "tr": "cell"}.get(name)
            if closes and (closes != "a" or "href" in a):
                self._end(closes)
            if name in _BLOCK and name != "p":
                self._end("p")
            self._space(name)
            if name == "table" and self.table:
                done = self.table.pop()
                done["rows"] = [r for r in done["rows"] if r]
                self.out["tables"].append(done)
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        names = [t for t, _ in self.stack]
        if any(t in _HIDDEN for t in names):
            return
        if "title" in names:
            self.out["title"].append(data)
            return
        if "body" in self.want:
            self.out["body"].append(data)
        if "article" in names:
            self.out["article"].append(data)
        for _, parts, _ in self.open:
            parts.append(data)

    def result(self) -> dict:
        self.close()
        while self.stack:
            self.handle_endtag(self.stack[-1][0])
        out = {k: v for k, v in self.out.items() if k in self.want}
        for name in {"title", "body", "article"} & self.want:
            out[name] = _clean(out[name])
        if "images" in out:
            out["images"] = [{k: v for k, v in i.items() if k != "_in"} | {"caption": i["caption"] or i["title"]} for i in out["images"]]
        if "h1" in self.want:
            out["h1"] = next((h["text"] for h in self.out["headings"] if h["level"] == 1), None)
        return out


#: Characters of html, and pages, that are parsed before their parts leave the worker; parts take up to a hundred times the room.
BLOCK, ROWS = 1 << 20, 500

#: The parts of a page that each of the functions below reads; parse_pages() need not give others.
FOR_ARTICLES = ("title", "h1", "lang", "body", "article", "meta", "images", "paragraphs", "times", "authors", "found")
FOR_BIOS, FOR_TABLES, FOR_COMPANIES = ("title", "h1", "body", "found"), ("tables",), ("tables", "items")


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(from, to) of successive rows that have BLOCK characters together and are ROWS at most; a larger page stands alone."""
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and (total + size > BLOCK or i - lo == ROWS):
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def parse_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html", parts: Sequence[str] | None = None) -> DataFrame:
    """The kept columns and the parts of every page; null or broken html gives a row with an error instead of failing.

    `parts` are those of PAGE that are wanted (None: all), `error` is always there. Pages are parsed in blocks of bounded
    size, so a task holds the parts of one block however many pages it has.
    """
    given = {c.split()[0]: c for c in _split_schema(PAGE)}
    names = [n for n in given if parts is None or n in (*parts, "error")]
    if unknown := set(parts or ()) - set(given):
        raise ValueError(f"no parts of a page: {sorted(unknown)}")
    want = frozenset(names)

    def parsed(texts: Iterator[str | None]) -> Iterator[dict]:
        for text in texts:
            if text is None:
                yield dict.fromkeys(names) | {"error": "no html"}
                continue
            parser = _Parts(want)
            try:
                parser.feed(text)
                yield dict.fromkeys(names) | parser.result()
            except Exception as bad:  # one bad page must not end the job
                yield dict.fromkeys(names) | {"error": f"{type(bad).__name__}: {bad}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo, hi in _blocks([len(t or "") for t in pdf[html]]):
                block = pdf.iloc[lo:hi].reset_index(drop=True)
                yield pd.concat([block[list(keep)], pd.DataFrame(list(parsed(block[html])), columns=names)], axis=1)

    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html).mapInPandas(run, f"{kept}, {', '.join(given[n] for n in names)}")


def _split_schema(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]


def strip_html(c: Column) -> Column:
    """Text without script and style blocks and tags, white space squeezed; entities stay."""
    s = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style[^>]*>.*?</style>", " ")
    return squeezed(F.regexp_replace(s, r"<[^>]+>", " "))


def html_title(c: Column) -> Column:
    return squeezed(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


#: Kinds of pages by URL, selectors that speak for them, and elements all of which make them surer.
KINDS = (
    ("news", r"(?i)/news/|/article/|/story/|/blog/|/post/|insurancejournal\.com|reuters\.com|bloomberg\.com", ("article", "=article", ".article-content", "#article-content", "@articleBody", ".story-body", ".post-content"), ("h1", "p")),
    ("sports", r"(?i)pro.*reference\.com|espn\.com/player|/stats/|/player/|/athlete/", ("#info", ".stats_table", "#all_stats", ".player-header", "data-stat"), ("table",)),
    ("directory", r"(?i)/directory/|/listing/|/filter/|/search/|/results/|/page/[0-9]+", (".listing-item", ".result-card", ".directory-entry", ".search-result", "=listitem"), ("a",)),
)


def content_type(parsed: DataFrame) -> DataFrame:
    """parsed pages with type and score: 10 for the URL, 5 a mark, 15 for all required ones; highest wins, ties in order, else generic."""
    has = lambda m: F.coalesce(F.try_element_at(F.col("marks"), F.lit(m)), F.lit(0)) > 0
    scored = []
    for i, (name, url, marks, need) in enumerate(KINDS):
        s = weighted((F.col("url").rlike(url), 10), *[(has(m), 5) for m in marks])
        every = has(need[0])
        for m in need[1:]:
            every = every & has(m)
        scored.append(F.struct((s + F.when(every, 15.0).otherwise(0.0)).alias("score"), F.lit(-i).alias("at"), F.lit(name).alias("type")))
    best = F.array_max(F.array(*scored))
    return parsed.withColumn("type", F.when(best["score"] > 0, best["type"]).otherwise("generic")).withColumn("score", best["score"])


def _meta(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(F.col("meta"), F.lit(n)), F.lit("")) for n in names])


def _selected(field: str, text: bool = True) -> Column:
    """The first of the field's selectors whose first element has a value (content or datetime) or a text."""
    firsts = [F.try_element_at(F.try_element_at(F.col("found"), F.lit(s)), F.lit(1)) for s in ARTICLE_SELECTORS[field]]
    return F.coalesce(*[F.nullif(trimmed(F.coalesce(F.nullif(x["value"], F.lit("")), x["text"]) if not text else x["text"]), F.lit("")) for x in firsts])


def _all_found(selectors: tuple[str, ...]) -> Column:
    """Texts of all elements that meet the selectors, by selector and place."""
    none = F.array().cast("array<struct<text: string, value: string>>")
    return F.transform(F.concat(*[F.coalesce(F.try_element_at(F.col("found"), F.lit(s)), none) for s in selectors]), lambda x: x["text"])


#: Formats of dates in pages besides ISO's.
_DATES = ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d/yyyy", "yyyy/M/d", "d MMM yyyy HH:mm:ss z")


def iso_date(c: Column) -> Column:
    """A date or time of a page in UTC as 2024-01-31T00:00:00.000Z; null if it can't be read."""
    bare = F.regexp_replace(F.trim(c), "^[A-Za-z]{3,9}, +(?=[0-9])", "")  # without the day of the week
    at = F.coalesce(F.try_to_timestamp(bare), *[F.try_to_timestamp(bare, F.lit(f)) for f in _DATES])
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _dated(field: str) -> Column:
    """The first of the field's selectors whose first element can be read as a date."""
    firsts = [F.try_element_at(F.try_element_at(F.col("found"), F.lit(s)), F.lit(1)) for s in ARTICLE_SELECTORS[field]]
    return F.coalesce(*[iso_date(F.coalesce(F.nullif(x["value"], F.lit("")), x["text"])) for x in firsts])


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def extract_article(parsed: DataFrame, max_len: int | None = 5000, tags: int | None = 10, images: int | None = 5) -> DataFrame:
    """(page_id, url, title, byline, author, published, modified, excerpt, content, word_count, tags, category, language, images) by ordered fallbacks.

    Selectors of class names and attributes come first, then what the page's parts say. published and modified are ISO
    times, or null where no candidate is a date; words are counted on the whole content, before it is cut to `max_len`
    characters. Limits that are None keep all. Images are those inside the article, with their captions.
    """
    content = F.coalesce(F.nullif(F.col("article"), F.lit("")), F.nullif(F.array_join("paragraphs", " "), F.lit("")), F.col("body"))
    words = F.transform(F.split(F.coalesce(_meta("keywords", "news_keywords"), F.lit("")), ","), lambda t: F.trim(t))
    labels = F.array_distinct(F.filter(F.concat(words, F.transform(_all_found(TAG_SELECTORS), trimmed)), lambda t: t != ""))
    shown = F.transform(F.filter("images", lambda i: i["inside"]), lambda i: F.struct(resolve_link(i["src"], F.col("url")).alias("src"), F.nullif(i["alt"], F.lit("")).alias("alt"), i["caption"].alias("caption"), i["width"].alias("width"), i["height"].alias("height")))
    when = _meta("article:published_time", "date", "pubdate")
    return parsed.select(
        "page_id", "url", F.coalesce(_selected("title"), _meta("og:title"), F.nullif(F.col("h1"), F.lit("")), F.nullif(F.col("title"), F.lit(""))).alias("title"), _selected("byline").alias("byline"),
        F.coalesce(_selected("author", text=False), _meta("author", "article:author"), F.try_element_at("authors", F.lit(1))).alias("author"),
        F.coalesce(_dated("published"), iso_date(when), iso_date(F.try_element_at("times", F.lit(1)))).alias("published"), _dated("modified").alias("modified"),
        F.coalesce(_selected("excerpt", text=False), _meta("description", "og:description"), F.substring(F.try_element_at("paragraphs", F.lit(1)), 1, 200)).alias("excerpt"),
        (content if max_len is None else F.substring(content, 1, max_len)).alias("content"), word_count(content).alias("word_count"), _first(labels, tags).alias("tags"), F.coalesce(_selected("category"), _meta("article:section", "section")).alias("category"),
        F.coalesce("lang", _meta("og:locale"), F.lit("en")).alias("language"), _first(shown, images).alias("images"),
    )


def article_confidence(df: DataFrame) -> DataFrame:
    """df with confidence, word_count (kept if df has it) and reading_time (200 words a minute)."""
    c = F.coalesce("content", F.lit(""))
    who = filled(F.col("author")) | filled(F.col("byline")) if "byline" in df.columns else filled(F.col("author"))
    score = weighted((filled(F.col("title")), 0.3), (who, 0.2), (filled(F.col("published")), 0.2), (F.length(c) > 500, 0.2), (filled(F.col("excerpt")), 0.1))
    counted = df if "word_count" in df.columns else df.withColumn("word_count", word_count(c))
    return counted.withColumn("confidence", F.round(score, 4)).withColumn("reading_time", F.ceil(F.col("word_count") / 200).cast("int"))


def extract_links(parsed: DataFrame, cap: int | None = 20) -> DataFrame:
    """(page_id, pos, href, text): the first `cap` (None: all) different absolute links of each page; no fragments or scripts."""
    good = F.filter("links", lambda x: ~x["href"].rlike(r"(?i)^(#|javascript:|mailto:|tel:|$)"))
    full = F.transform(good, lambda x: F.struct(resolve_link(x["href"], F.col("url")).alias("href"), x["text"].alias("text")))
    heads = F.transform(full, lambda x: x["href"])
    once = F.filter(F.transform(full, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: F.array_position(heads, y["x"]["href"]) == y["i"] + 1)
    return parsed.select("page_id", F.posexplode(_first(once, cap)).alias("pos", "l")).select("page_id", "pos", "l.x.href", "l.x.text")


def extract_images(parsed: DataFrame, cap: int = 10) -> DataFrame:
    good = F.filter("images", lambda x: ~x["src"].rlike("(?i)logo|icon"))
    return parsed.select("page_id", "url", F.posexplode(F.slice(good, 1, cap)).alias("pos", "i")).select("page_id", "pos", resolve_link(F.col("i.src"), F.col("url")).alias("src"), "i.alt")


def _first(items: Column | str, cap: int | None) -> Column:
    return F.slice(items, 1, cap) if cap is not None else F.col(items) if isinstance(items, str) else items


def extract_headings(parsed: DataFrame, cap: int | None = 20, longest: int | None = 200) -> DataFrame:
    """(page_id, pos, level, text): the first `cap` headings of levels 1 to 3, `longest` characters of each; None: all."""
    text = F.col("h.text") if longest is None else F.substring("h.text", 1, longest)
    return parsed.select("page_id", F.posexplode(_first("headings", cap)).alias("pos", "h")).select("page_id", "pos", "h.level", text.alias("text"))


def extract_meta(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", F.explode("meta").alias("name", "content"))


def extract_listings(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "url", F.posexplode("items").alias("pos", "i")).select("page_id", "pos", "i.title", resolve_link(F.col("i.href"), F.col("url")).alias("link"), F.col("i.text").alias("description"))


def extract_pagination(parsed: DataFrame) -> DataFrame:
    """(page_id, has_next, next_url, page_numbers, current_page, total_pages)."""
    nxt = F.filter("links", lambda x: x["rel"].rlike(r"(?i)\bnext\b") | F.lower(F.trim(x["text"])).isin("next", "next page", "next »", "»", "›"))
    href = F.try_element_at(F.transform(nxt, lambda x: x["href"]), F.lit(1))
    numbers = F.array_sort(F.array_distinct(F.transform(F.filter("links", lambda x: F.trim(x["text"]).rlike("^[0-9]{1,4}$")), lambda x: F.trim(x["text"]).cast("int"))))
    said = lambda i: F.regexp_extract("body", r"(?i)page\s+([0-9]+)\s+of\s+([0-9]+)", i).try_cast("int")
    return parsed.select("page_id", href.isNotNull().alias("has_next"), resolve_link(href, F.col("url")).alias("next_url"), numbers.alias("page_numbers"), said(1).alias("current_page"), F.coalesce(said(2), F.array_max(numbers)).alias("total_pages"))


_HEADER_WORDS = r"(?i)^(company|name|company name|supplier|contact|contact information|website|phone|url)$"


#: By host, the columns of a directory's tables: their numbers, or words of the cell that holds them.
_NAMES, _CONTACTS, _WEBSITES = ("name", "company", "supplier"), ("contact", "address", "location", "info"), ("website", "url", "web", "site")
SITES = {"d2pbuyersguide.com": (0, 1, 2), "thomasnet.com": (_NAMES, _CONTACTS, _WEBSITES), "globalspec.com": (_NAMES, _CONTACTS, _WEBSITES)}
ANY_SITE = (0, 1, 2)


def _cell(plan: int | tuple[str, ...]) -> Column:
    """A row's cell by number, or the first that holds one of the words; none: null."""
    if isinstance(plan, int):
        return F.try_element_at("cells", F.lit(plan + 1))
    holds = lambda c: reduce(lambda a, b: a | b, [F.lower(c).contains(w) for w in plan])
    return F.try_element_at(F.filter("cells", holds), F.lit(1))


def extract_companies(parsed: DataFrame, sites: dict[str, tuple] = SITES, other: tuple = ANY_SITE) -> DataFrame:
    """(page_id, url, pos, name, contact, website): table rows of two cells or more, a header-like first row skipped; without a table, cards.

    `sites` says which columns a host's tables have (its subdomains' too): numbers, or words that the cell holds. The plans
    are compiled into one expression. pos orders a page's rows: the table's number times 2^32 and the row's.
    """
    tables = parsed.select("page_id", "url", "items", F.posexplode_outer("tables").alias("t", "table"))
    rows = tables.filter("table is not null").select("page_id", "url", "t", F.posexplode("table.rows").alias("r", "cells")).filter(F.size("cells") >= 2)
    rows = rows.filter(~((F.col("r") == 0) & F.exists("cells", lambda c: F.trim(c).rlike(_HEADER_WORDS))))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    picked = []
    for i in range(3):
        c = _cell(other[i])
        for site, plan in sites.items():
            c = F.when((host == site) | host.endswith("." + site), _cell(plan[i])).otherwise(c)
        picked.append(F.trim(c))
    pos = F.col("t").cast("long") * (1 << 32) + F.col("r")
    found = rows.select("page_id", "url", pos.alias("pos"), picked[0].alias("name"), picked[1].alias("contact"), F.nullif(picked[2], F.lit("")).alias("website")).filter("name != ''")
    cards = parsed.filter(F.size("tables") == 0).select("page_id", "url", F.posexplode("items").alias("pos", "i"))
    return found.unionByName(cards.select("page_id", "url", F.col("pos").cast("long").alias("pos"), F.col("i.title").alias("name"), F.col("i.text").alias("contact"), F.col("i.href").alias("website")))


def _numeric(c: Column) -> Column:
    """The number that the whole text is, as double; else null."""
    t = trimmed(c)
    return F.when(t.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), t.try_cast("double"))


def extract_stat_tables(parsed: DataFrame) -> DataFrame:
    """(page_id, url, table_idx, table_type, row_idx, stats, numbers): header to value of each row, numbers those that are numeric.

    A table is career, playoffs, season or general, in this order: by words in its text, id or class, then by a header
    with a year or season.
    """
    t = parsed.select("page_id", "url", F.posexplode("tables").alias("table_idx", "t")).filter(F.size("t.rows") >= 2)
    head = F.col("t.rows")[0]
    text = F.lower(F.concat_ws(" ", F.col("t.id"), F.flatten("t.rows")))
    says = lambda *words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    kind = F.when(says("career", "total"), "career").when(says("playoff", "postseason"), "playoffs").when(F.exists(head, lambda h: h.rlike(r"(?i)year|season|[0-9]{4}")), "season").otherwise("general")
    rows = t.select("page_id", "url", "table_idx", kind.alias("table_type"), head.alias("head"), F.posexplode("t.rows").alias("row_idx", "cells")).filter("row_idx > 0")
    names = F.transform("head", lambda h, i: F.when(F.trim(h) == "", F.concat(F.lit("col"), i)).otherwise(F.trim(h)))
    pairs = F.filter(F.arrays_zip(names.alias("k"), F.col("cells").alias("v")), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    keys = F.transform(pairs, lambda p: p["k"])
    once = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: F.array_position(keys, p["k"]) == p["i"] + 1)
    made = rows.select("page_id", "url", "table_idx", "table_type", "row_idx", F.map_from_entries(F.transform(once, lambda p: F.struct(p["k"], p["v"]))).alias("stats"))
    return made.withColumn("numbers", F.map_filter(F.transform_values("stats", lambda k, v: _numeric(v)), lambda k, v: v.isNotNull()))


_PLACE, _DRAFT = r"(?i)Born:\s*([^,]+),?\s*(.+)", r"(?i)Draft:\s*([0-9]{4}).*?(\w+).*?([0-9]+).*?([0-9]+)"


def extract_player_bio(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, url, name, position, jersey, height, weight, born, birth_place, college, draft, draft_info, achievements, answers) and the parts to keep.

    Patterns run on the page's elements for players and facts, of several the last that fits, then on its whole text.
    achievements are the parts (at commas, semicolons and line ends) of award elements, each once; answers map the
    questions of fact elements to what follows them; draft_info is (year, team, round, pick).
    """
    found = {"_own": (*BIO_SELECTORS, *FACT_SELECTORS), "_facts": FACT_SELECTORS, "_awards": AWARD_SELECTORS, "_jerseys": JERSEY_SELECTORS}
    parsed = parsed.withColumns({name: _all_found(selectors) for name, selectors in found.items()})  # each is read often
    body, own = F.col("body"), F.col("_own")
    get = lambda p, i=1: F.nullif(F.trim(F.regexp_extract(body, p, i)), F.lit(""))
    last = lambda p, i=1: F.try_element_at(F.filter(F.transform(own, lambda x: F.trim(F.regexp_extract(x, p, i))), lambda x: x != ""), F.lit(-1))
    jersey = F.try_element_at(F.transform("_jerseys", lambda x: F.struct(F.regexp_extract(x, r"([A-Z]{1,3})\s*(?:#([0-9]+))?", 1).alias("p"), F.regexp_extract(x, r"([A-Z]{1,3})\s*(?:#([0-9]+))?", 2).alias("n"))), F.lit(1))
    parts = F.flatten(F.transform(F.filter("_awards", lambda x: F.length(x) > 5), lambda x: F.split(x, r"[,;]|\n")))
    awards = F.array_distinct(F.filter(F.transform(parts, trimmed), lambda x: F.length(x) > 3))
    asked = F.flatten(F.transform("_facts", lambda x: F.regexp_extract_all(x, F.lit(r"([^?]+\?\s*[^?]+?)(?=\s*[^?]*\?|$)"), F.lit(1))))
    pairs = F.filter(F.transform(asked, lambda x: F.struct(trimmed(F.element_at(F.split(x, r"\?"), 1)).alias("q"), trimmed(F.try_element_at(F.split(x, r"\?"), F.lit(2))).alias("a"))), lambda p: (p["q"] != "") & (p["a"] != ""))
    keys = F.transform(pairs, lambda p: p["q"])
    answers = F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), p["q"]) == 0))  # of equal questions the last
    picks = F.filter(F.transform(own, lambda x: F.struct(*[F.regexp_extract(x, _DRAFT, i).alias(n) for i, n in enumerate(("year", "team", "round", "pick"), 1)])), lambda p: p["year"] != "")
    draft = F.try_element_at(F.transform(picks, lambda p: F.struct(*[(p[n] if n == "team" else p[n].try_cast("int")).alias(n) for n in ("year", "team", "round", "pick")])), F.lit(-1))
    return parsed.select(
        "page_id", "url", F.coalesce(F.nullif(F.col("h1"), F.lit("")), F.col("title")).alias("name"), F.coalesce(F.nullif(jersey["p"], F.lit("")), get(r"Position:?\s*([A-Z]{1,3}(?:[-/][A-Z]{1,3})?)")).alias("position"), F.coalesce(F.nullif(jersey["n"], F.lit("")), get(r"#([0-9]{1,2})\b")).alias("jersey"),
        F.coalesce(last(r"(?i)(?:Height|Ht):\s*([0-9]+'\s*[0-9]+\"?)"), get(r"\b([4-7]-[0-9]{1,2})\b")).alias("height"), F.coalesce(last(r"(?i)(?:Weight|Wt):\s*([0-9]+)\s*lbs?"), get(r"\b([0-9]{2,3})\s?lbs?\b")).alias("weight"),
        F.coalesce(last(_PLACE), get(r"Born:?\s*([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})")).alias("born"), last(_PLACE, 2).alias("birth_place"), get(r"College:?\s*([A-Z][A-Za-z .&']+?)(?=\s+(?:Draft|Born|High|Weight|Career)|$|[.,;])").alias("college"),
        get(r"Draft:?\s*([^.]+?round[^.]*)").alias("draft"), draft.alias("draft_info"), awards.alias("achievements"), answers.alias("answers"), *keep,
    )


#: Words of sports pages, statistics in text, and what finding a block by its tag is worth.
SPORTS_WORDS = (
    "stats|statistics|season|career|games|player|team|league|championship|playoff|record|performance|draft|yards|touchdown|sack|interception|fumble|quarterback|running back|wide receiver|defensive|offensive|nfl|passing|rushing|"
    "receiving|tackles|completion|points|rebounds|assists|steals|blocks|field goal|three pointer|free throw|minutes|nba|shooting"
)
STATISTICS = (r"(?i)\d+\s*(?:yards|points|touchdowns|sacks|tackles|assists|rebounds)", r"(?i)\d{4}\s*season", r"(?i)(?:career|season|playoff)\s*stats")
SOURCES = {"article": 200, "main": 150, "section": 50, "div": 10}


def keyword_score(c: Column) -> Column:
    """5 for each sports word, 300 at most."""
    return F.least(F.lit(300), 5 * F.regexp_count(F.lower(c), F.lit(rf"\b({SPORTS_WORDS})\b")))


def sports_validation(c: Column) -> Column:
    """struct<score, valid, failed>: six rules on a text, valid from three, names of those that failed."""
    t = F.coalesce(c, F.lit(""))
    rules = {
        "hasPlayerName": t.rlike(r"^[A-Z][a-z]+\s+[A-Z][a-z]+"), "hasStats": t.rlike(STATISTICS[0]), "hasSeasons": t.rlike("20[0-9]{2}|19[0-9]{2}"), "hasBiography": t.rlike("(?i)born|height|weight|college"),
        "hasSportsKeywords": keyword_score(t) > 20, "hasNumericalData": t.rlike("[0-9]"),
    }
    failed = F.array_compact(F.array(*[F.when(~ok, name) for name, ok in rules.items()]))
    return F.struct((6 - F.size(failed)).alias("score"), ((6 - F.size(failed)) >= 3).alias("valid"), failed.alias("failed"))


def structured_quality(df: DataFrame) -> DataFrame:
    """df (name, position, height, weight, birth_date, college, draft, career, seasons, playoffs, achievements) with quality 0 to 100."""
    has = lambda c: filled(F.col(c).cast("string"))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return df.withColumn("quality", weighted(
        (has("name"), 20), (has("position"), 15), (has("height") & has("weight"), 10), (has("birth_date"), 10), (has("college"), 10), (has("draft"), 15), (some("career"), 10), (some("seasons"), 10), (some("playoffs"), 5),
        (some("achievements"), 5),
    ))


def main_content_score(parsed: DataFrame) -> DataFrame:
    """(page_id, url, method, score, text): the best block of 200 characters or more.

    30 a paragraph, 80 a heading, 20 a list, half a point a character, 2 a word up to 1000, less for more than a link in
    ten words; bonuses for its tag, sports words, tables (100 each up to 500) and statistics (20 each up to 200 a kind).
    """
    b = parsed.select("page_id", "url", F.explode("blocks").alias("b")).select("page_id", "url", "b.*").filter(F.length("text") >= 200)
    words = F.size(F.split("text", r"\s+"))
    dense = F.greatest(F.col("links") / (words + 1) - 0.1, F.lit(0.0)) * 500.0
    base = F.greatest(F.lit(0.0), 30.0 * F.col("p") + 80.0 * F.col("h") + 20.0 * F.col("lists") + 0.5 * F.length("text") + F.least(2 * words, F.lit(1000)) - dense)
    bonus = lookup({k: str(v) for k, v in SOURCES.items()}, F.col("tag")).cast("double") + keyword_score(F.col("text")) + F.least(100 * F.col("tables"), F.lit(500))
    for pattern in STATISTICS:
        bonus = bonus + F.least(20 * F.regexp_count("text", F.lit(pattern)), F.lit(200))
    scored = b.withColumn("score", F.round(base + bonus, 4))
    return scored.groupBy("page_id", "url").agg(F.max_by(F.struct(F.col("tag").alias("method"), "score", "text"), F.struct("score", "text")).alias("r")).select("page_id", "url", "r.*")


def player_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """players, draft_info, achievements, answers, statistics (long: one row a value) and the rows by kind of table.

    Biographies and what else the tables need are stored first, so each page is parsed and each pattern tried once however
    many tables are read, and neither the pages' text nor their elements are written.
    """
    known = stored(extract_player_bio(parsed, keep=FOR_TABLES), "players")
    stats, bio = extract_stat_tables(known), known.drop(*FOR_TABLES)
    long = stats.select("page_id", "table_type", "table_idx", "row_idx", F.explode("stats").alias("stat", "value"))
    return {
        "players": bio.drop("draft_info", "achievements", "answers"), "draft_info": bio.filter("draft_info is not null").select("page_id", "url", "name", "draft_info.*"),
        "achievements": bio.select("page_id", "url", "name", F.posexplode("achievements").alias("pos", "achievement")), "answers": bio.select("page_id", F.explode("answers").alias("question", "answer")),
        "statistics": long, "career": stats.filter("table_type = 'career'"), "seasons": stats.filter("table_type = 'season'"), "playoffs": stats.filter("table_type = 'playoffs'"),
    }


def wide_statistics(long: DataFrame, names: list[str]) -> DataFrame:
    """One column for each of the given statistics; the list is given so that its size is bounded."""
    return long.groupBy("page_id", "table_idx", "row_idx").pivot("stat", names).agg(F.first("value"))


def ma_news(pages: DataFrame, min_conf: int = 0, found: DataFrame | None = None, max_len: int | None = 5000) -> DataFrame:
    """Deal facts of stored pages (page_id, url, html) at the given confidence or above; with success and, from `found`, source.

    `found` (url, source) is what discovery merged; pages of other URLs then take no part, and URLs without a page give a
    row that failed.
    """
    from .news import deal_facts

    text = extract_article(parse_pages(pages, parts=FOR_ARTICLES), max_len).select("page_id", "url", "title", "published", "content")
    if found is not None:
        text = found.select("url", "source").join(text, "url", "left")
    facts = deal_facts(text.withColumn("success", F.length("content") > 0), "content")
    return facts.withColumn("success", F.coalesce("success", F.lit(False))).filter(~F.col("success") | (F.col("confidence") >= min_conf))

"""Company text: names, industries, one-sentence summaries and standard descriptions of at most 30 words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import let, lookup, parse_listlike, split_sentences, trimmed
from .urls import domain_name, host

#: Words and sentences that summaries leave out.
FLUFF = r"(?i)\b(leading|innovative|world[- ]?class|premier|top[- ]?tier|cutting[- ]?edge|award[- ]?winning|best[- ]in[- ]class|state[- ]of[- ]the[- ]art|trusted|global|next[- ]?gen|revolutionary|transformative|game[- ]?changing|unique|unparalleled|unrivaled)\b"
REVENUE = r"(?i)(\$[\d,.]+|\b\d+(\.\d+)?\s*(million|billion|m|bn)\b|\brevenue\b)"
PARTNER = r"(?i)\b(partner(ship|s|ed|ing)?|alliance|collaborat(e|ion|ive|ing|ed))\b"
GEO = r"(?i)\b(headquartered|based in|global presence|worldwide|nationwide)\b"


def clean_company_name(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r"\s*\(.+?\)\s*$", ""), r"(?i)\s*dba\s+.+$", "")
    return F.trim(F.regexp_replace(s, r"(?i)\s*,?\s*(Inc\.?|LLC|Corp\.?|Corporation|Company|Co\.?|Ltd\.?|Limited|LP|LLP|Group|Partners)\.?\s*$", ""))


#: Industries in the order in which they are looked for.
INDUSTRIES = {
    "insurance": "insurance|brokerage|underwriting|claims|actuarial|reinsurance|p&c|mga|tpa",
    "healthcare": "healthcare|medical|hospital|clinic|patient|clinical|pharmaceutical|biotech",
    "technology": "software|technology|digital|platform|cloud|saas|data|analytics|ai|ml",
    "manufacturing": "manufactur|production|industrial|factory|assembly|fabricat",
    "construction": "construction|building|contractor|engineering|architect|infrastructure",
    "finance": "financial|banking|investment|capital|fund|equity|lending|payment",
    "logistics": "logistics|transportation|shipping|freight|supply chain|distribution|warehousing",
    "retail": "retail|e-commerce|consumer|shopping|merchandise|store",
    "energy": "energy|oil|gas|renewable|solar|wind|utility|power|electric",
    "realestate": "real estate|property|reit|commercial|residential|development|leasing",
}
#: How each industry is described.
DESCRIBED = {
    "insurance": "insurance and risk management solutions", "healthcare": "healthcare services and solutions", "technology": "technology solutions and services", "manufacturing": "manufacturing and production services",
    "construction": "construction and engineering services", "finance": "financial services and solutions", "logistics": "logistics and supply chain services", "retail": "retail and consumer products",
    "energy": "energy and utility services", "realestate": "real estate services and solutions", "general": "business services and solutions",
}


def detect_industry(*texts: Column) -> Column:
    low = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    out = F.lit("general")
    for name, words in reversed(INDUSTRIES.items()):
        out = F.when(low.rlike(rf"\b({words})\b"), name).otherwise(out)
    return out


def hash_pick(choices: Sequence[str], seed: Column) -> Column:
    """The choice at |h| mod n, h = 31 h + code over the seed's characters in 32 bits; stays in the JVM."""
    codes = F.transform(F.filter(F.split(F.coalesce(seed, F.lit("")), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    wrap = lambda v: F.pmod(v + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: wrap(acc * 31 + x))
    return F.element_at(F.array(*[F.lit(x) for x in choices]), (F.abs(h) % len(choices) + 1).cast("int"))


def join_natural(items: Column, most: int = 3) -> Column:
    """'a', 'a and b', 'a, b, and c' of the first items."""
    s = F.slice(items, 1, most)
    n = F.size(s)
    return F.when(n <= 1, F.array_join(s, "")).when(n == 2, F.array_join(s, " and ")).otherwise(F.concat(F.array_join(F.slice(s, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.try_element_at(s, n)))


def without_brag(c: Column) -> Column:
    """Sentences without revenue, partners and places; the first fluff word goes."""
    kept = F.filter(split_sentences(F.coalesce(c, F.lit(""))), lambda s: ~(s.rlike(REVENUE) | s.rlike(PARTNER) | s.rlike(GEO)) & (F.trim(s) != ""))
    joined = F.array_join(kept, " ")
    one = F.regexp_replace(joined, "(?s)^(.*?)" + FLUFF.replace("(?i)", "(?i:") + ")", "$1 ")
    return F.regexp_replace(trimmed(F.regexp_replace(one, r"\s+", " ")), "^[-;, ]+|[-;, ]+$", "")


def _first_words(s: Column, n: int = 30) -> Column:
    return F.when(F.size(F.split(s, r"\s+")) > n, F.concat(F.array_join(F.slice(F.split(s, r"\s+"), 1, n), " "), F.lit("."))).otherwise(s)


def _struct(**parts: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in parts.items()])


def company_summary(company: Column, website: Column, description: Column, specialties: Column, products: Column, end_markets: Column, industries: Column) -> Column:
    """One sentence of at most 30 words: name, verb, what it does, for whom. Description, specialties, products in this order."""
    given = dict(company=company, website=website, description=description, specialties=specialties, products=products, markets=end_markets, industries=industries)
    return let(_struct(**{k: trimmed(F.coalesce(c, F.lit(""))) for k, c in given.items()}), _summary)


def _summary(r: Column) -> Column:
    name = F.coalesce(F.nullif(r["company"], F.lit("")), F.nullif(domain_name(F.nullif(r["website"], F.lit(""))), F.lit("")), F.lit("Company"))
    text = F.when(r["description"] != "", r["description"]).when(r["specialties"] != "", r["specialties"]).otherwise(r["products"])
    source = F.when(r["description"] != "", "description").when(r["specialties"] != "", "specialties").otherwise("products")
    about = F.coalesce(F.nullif(r["markets"], F.lit("")), r["industries"])
    field = F.coalesce(F.nullif(r["industries"], F.lit("")), F.nullif(r["markets"], F.lit("")), F.lit("industry"))
    return let(_struct(name=name, source=source, primary=without_brag(text), items=parse_listlike(without_brag(text)), about=about, to=parse_listlike(about), field=field), _sentence)


def _words(s: Column) -> Column:
    return F.size(F.split(s, r"\s+"))


def _sentence(r: Column) -> Column:
    name, primary = r["name"], r["primary"]
    bare = F.concat(name, F.lit(" provides "), F.lower(F.trim(F.split(r["field"], "[;,]")[0])), F.lit("-related services (details not specified)."))
    low = F.lower(primary)
    verb = (
        F.when(low.contains("manufactur"), "manufactures").when(low.contains("install"), "installs").when(low.contains("develop"), "develops").when(low.contains("certif"), "certifies")
        .when(low.rlike("test|tab|balanc|calibrat"), "tests").when(low.contains("manage"), "manages").when(low.contains("service") & ~low.contains("services"), "services")
        .when(r["source"] == "specialties", "specializes in").otherwise("provides")
    )

    def without_name(told: Column) -> Column:
        lead = F.regexp_extract(F.substr(told, F.length(name) + 1), r"(?i)^\s+(is|provides|offers|specializes in)\s+", 0)
        return F.when((F.lower(F.left(told, F.length(name))) == F.lower(name)) & (lead != ""), F.substr(told, F.length(name) + F.length(lead) + 1)).otherwise(told)

    told = let(F.regexp_replace(primary, r"(?i)^(we|our|the company)\s+", ""), without_name)
    listed = F.when(F.size(r["items"]) > 0, join_natural(r["items"], 3)).otherwise(primary)
    phrase = F.when(r["source"] == "description", told).otherwise(listed)
    to = F.when(F.size(r["to"]) > 0, r["to"]).otherwise(F.array(r["about"]))
    context = F.when(r["about"] == "", "").otherwise(F.concat(F.lit(" for "), let(F.transform(to, lambda x: trimmed(F.regexp_replace(x, r"\s+", " "))), lambda x: join_natural(x, 2))))

    def fitted(p: Column) -> Column:
        short = F.concat(p["head"], F.lit("."))
        full = trimmed(F.regexp_replace(F.regexp_replace(F.concat(p["head"], p["context"], F.lit(".")), r"\s+", " "), r"\s+([,.;:])", "$1"))
        return let(full, lambda f: F.when(_words(f) <= 30, f).when((p["context"] != "") & (_words(short) <= 30), short).otherwise(_first_words(f)))

    full = let(_struct(head=F.concat(name, F.lit(" "), verb, F.lit(" "), phrase), context=context), fitted)
    return F.when(primary == "", let(bare, lambda x: _first_words(x))).otherwise(full)


#: Verbs by what the text speaks of (whole words, in this order), and phrases that are removed.
VERBS = (
    ("manufact|produc|fabricat|assembl", ("manufactures", "produces", "fabricates", "develops")), ("distribut|wholesal|retail|sell", ("distributes", "supplies", "sells")), ("consult|advis|strateg", ("advises", "consults on", "guides")),
    ("manag|operat|administr|oversee", ("manages", "operates", "administers", "oversees")), ("maintain|service|repair|support", ("maintains", "services", "repairs", "supports")),
    ("install|implement|deploy|integrat", ("installs", "implements", "deploys", "integrates")), ("platform|automat|streamlin|enabl", ("enables", "facilitates", "automates", "streamlines")),
    ("software|application|app|system|tool", ("develops", "builds", "creates")), ("specializ|focus|expert|dedicat", ("specializes in", "focuses on")),
)
#: Verbs where none of those fits.
SERVICE = ("provides", "delivers", "offers", "supplies")
REMOVED = (
    r"(?i)\b(leading|premier|best-in-class|top|innovative|cutting-edge|revolutionary|award-winning|world-class|industry-leading|state-of-the-art|exceptional|unparalleled)\b",
    r"(?i)\b(high-quality|highest quality|superior|excellence|exceptional|outstanding)\b",
    r"(?i)\b(over \d+ years?|since \d{4}|established in \d{4}|founded in \d{4}|\d+ years of experience)\b",
    r"(?i)\b(nationwide|global|worldwide|international|across the nation|throughout)\b",
    r"(?i)\b(their offerings include|services comprise|the company|they provide|we offer|our services)\b",
    r"(?i)\b(in partnership with|partnered with|strategic partner|preferred partner)\b",
    r"(?i)\b(\$[\d,]+(?:K|M|B)?(?:\s+in)?(?:\s+annual)?\s+(?:revenue|sales)|billion dollar|million dollar)\b",
    r"(?i)\b(committed to|dedicated to|focused on providing|passionate about)\b",
)


def clean_description(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    for pattern in REMOVED:
        s = F.regexp_replace(s, pattern, "")
    for pattern, to in ((r"\s+", " "), (r"\(\s*\)", ""), (r"\[\s*\]", ""), (r"\s+([,.])", "$1"), (r"\s*,\s*", ", ")):
        s = F.regexp_replace(s, pattern, to)
    return F.trim(s)


def standardize_description(company: Column, informal: Column, website: Column, description: Column, specialties: Column, industries: Column, end_markets: Column) -> Column:
    """'<name> <verb> <up to three offerings> for <up to two markets>.' in at most 30 words, the verb picked by the name's hash."""
    given = dict(company=company, informal=informal, website=website, description=description, specialties=specialties, industries=industries, markets=end_markets)
    clean = lambda r: _struct(r=r, desc=clean_description(r["description"]), spec=clean_description(r["specialties"]))
    return let(_struct(**{k: F.coalesce(c, F.lit("")) for k, c in given.items()}), lambda r: let(clean(r), lambda c: let(_components(c), _standard)))


def _between(items: Column, most: int) -> Column:
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda s: (F.length(s) > 2) & (F.length(s) < most))


def _components(c: Column) -> Column:
    r, desc, spec = c["r"], c["desc"], c["spec"]
    from_text = F.regexp_extract(desc, r"^([A-Z][A-Za-z0-9\s&.,-]+)(?:\s+is\s+|\s+provides?\s+|\s+offers?\s+|\s+specializes?\s+)", 1)
    site = host(F.when(r["website"].rlike("(?i)^https?://"), r["website"]).otherwise(F.concat(F.lit("https://"), r["website"])))
    site = F.regexp_replace(F.regexp_replace(F.regexp_replace(site, r"(?i)\.(com|net|org|io|co|ai|app|dev|biz|info).*$", ""), r"(?i)^(www\.|app\.|portal\.|my\.)", ""), "[-_]", " ")
    name = (
        F.when((F.trim(r["informal"]) != "") & (r["informal"] != r["company"]), clean_company_name(r["informal"])).when(F.trim(r["company"]) != "", clean_company_name(r["company"]))
        .when(from_text != "", clean_company_name(from_text)).when((r["website"] != "") & (site != ""), F.initcap(site)).otherwise("The company")
    )
    plain = lambda s: ~s.rlike("(?i)" + "|".join(p.removeprefix("(?i)") for p in REMOVED))
    first = F.slice(F.filter(_between(F.split(spec, "[,;]"), 50), plain), 1, 4)
    rest = F.regexp_extract(desc, r"(?i)\b(?:including|such as|like|provides?|offers?)\s*:?\s*([^.]+)", 1)
    more = F.when(rest != "", F.slice(_between(F.split(rest, r",\s*|\s+and\s+"), 30), 1, 3)).otherwise(F.array().cast("array<string>"))
    offers = let(_struct(first=first, more=more), lambda o: F.slice(F.array_distinct(F.when(F.size(o["first"]) < 2, F.concat(o["first"], o["more"])).otherwise(o["first"])), 1, 3))
    kinds = "businesses|companies|organizations|enterprises|hospitals|clinics|manufacturers|retailers"
    hints = [F.trim(F.regexp_extract(desc, p, 1)) for p in (r"(?i)\bserving\s+([^,.]+)", rf"(?i)\bfor\s+({kinds})", rf"(?i)\bto\s+({kinds})", r"(?i)\b(B2B|B2C|enterprise|mid-market|SMB|small business)")]
    hint = F.coalesce(*[F.nullif(h, F.lit("")) for h in hints])
    named = F.slice(_between(F.split(r["markets"], "[,;]"), 30), 1, 2)
    markets = let(named, lambda n: F.when(F.size(n) > 0, n).otherwise(F.array_compact(F.array(hint))))
    bare = (r["description"] == "") & (r["specialties"] == "") & (r["industries"] == "")
    return _struct(name=name, industry=detect_industry(desc, spec, r["industries"]), text=F.lower(F.concat(desc, F.lit(" "), spec)), offers=offers, markets=markets, bare=bare)


def _standard(c: Column) -> Column:
    verb = hash_pick(SERVICE, c["name"])
    for words, verbs in reversed(VERBS):
        verb = F.when(c["text"].rlike(rf"\b({words})\b"), hash_pick(verbs, c["name"])).otherwise(verb)
    what = lookup(DESCRIBED, c["industry"])
    s = F.concat(c["name"], F.lit(" "), verb, F.lit(" "), F.when(F.size(c["offers"]) > 0, join_natural(c["offers"], 3)).otherwise(what))
    s = let(s, lambda x: F.when((F.size(c["markets"]) > 0) & (_words(F.trim(x)) < 27), F.concat(x, F.lit(" for "), F.array_join(c["markets"], " and "))).otherwise(x))
    s = let(s, lambda x: F.when(x.endswith("."), x).otherwise(F.concat(x, F.lit("."))))
    cut = lambda x: let(F.array_join(F.slice(F.split(x, r"\s+"), 1, 30), " "), lambda y: F.when(y.endswith("."), y).otherwise(F.concat(F.regexp_replace(y, r"[,;]?\s*$", ""), F.lit("."))))
    s = let(s, lambda x: F.when(_words(F.trim(x)) <= 30, x).otherwise(cut(x)))
    sector = F.concat(c["name"], F.lit(" operates in the "), F.when(c["industry"] == "general", "business services").otherwise(c["industry"]), F.lit(" sector."))
    return F.when(c["bare"], sector).otherwise(s)

"""URL functions: parts by the generic syntax of RFC 3986, normal forms, repairs and checks. Query bytes are kept raw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import let, trimmed

#: Query parameters that only track visitors.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "dclid", "ref", "source", "_ga", "_gid", "_utm")
TRACKING_PLAYERS = TRACKING[:11]
TRACKING_ENHANCED = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "source", "campaign", "affiliate", "click_id", "clickid", "partner_id", "promo", "discount")

_HTTP = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\s]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_ANY = r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\s]"


def part(c: Column, n: int) -> Column:
    return F.regexp_extract(trimmed(c), _HTTP, n)


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(trimmed(c), "^([A-Za-z][A-Za-z0-9+.\\-]*):", 1))


def host(c: Column) -> Column:
    """Lower-case host name without port; '' if there is none."""
    return F.lower(part(c, 2))


def path(c: Column) -> Column:
    p = part(c, 4)
    return F.when(p == "", "/").otherwise(p)


def is_url(c: Column) -> Column:
    """Whether the text is an absolute URL: for http(s) with a host."""
    t = trimmed(c)
    web = scheme(c).isin("http", "https")
    return F.coalesce(F.when(web, t.rlike(_HTTP)).otherwise(t.rlike(_ANY)), F.lit(False))


def _port(c: Column) -> Column:
    p = part(c, 3)
    usual = (p == "") | ((scheme(c) == "http") & (p == "80")) | ((scheme(c) == "https") & (p == "443"))
    return F.when(usual, "").otherwise(F.concat(F.lit(":"), p))


def _query(c: Column, drop: Sequence[str]) -> Column:
    kept = F.array_join(F.filter(F.split(part(c, 5), "&"), lambda p: ~F.substring_index(p, "=", 1).isin(*drop) & (p != "")), "&")
    return F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))


def normalize_url(c: Column, drop_params: Sequence[str] = TRACKING) -> Column:
    """http(s) URL with lower-case scheme and host, no usual port, fragment or tracking parameters; others: null."""
    made = F.concat(scheme(c), F.lit("://"), host(c), _port(c), path(c), _query(c, drop_params))
    return F.when(scheme(c).isin("http", "https") & is_url(c), made)


def enhanced_url(c: Column) -> Column:
    """As normalize_url with https:// if there is no scheme, more parameters dropped and one trailing slash less."""
    t = trimmed(c)
    t = F.when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    p = path(t)
    p = F.when(p.endswith("/") & (F.length(p) > 1), F.regexp_replace(p, "/$", "")).otherwise(p)
    return F.when(is_url(t), F.concat(scheme(t), F.lit("://"), host(t), _port(t), p, _query(t, TRACKING_ENHANCED)))


def repair_url(c: Column) -> Column:
    """Undoes doubled schemes, www and com, hwww and trailing slashes; the scheme becomes https if it was doubled or missing or plain."""
    t = trimmed(c)
    t = F.regexp_replace(t, "h+www", "www")
    t = F.regexp_replace(t, "^(http://)+", "http://")
    t = F.regexp_replace(t, "^(https://)+", "https://")
    t = F.regexp_replace(t, r"(www\.)+", "www.")
    t = F.regexp_replace(t, r"com(\.com)+", "com")
    t = F.regexp_replace(t, "^(https?://)+", "https://")
    t = F.regexp_replace(t, "/+$", "")
    return F.when(trimmed(c) == "", None).when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def in_domains(h: Column, domains: Sequence[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith("." + d)
    return out


def url_variants(c: Column) -> Column:
    """What to try after a URL failed, in order: https, with www, with a slash, without www. The port is dropped; no URL: none."""
    s, h = scheme(c), host(c)
    tail = F.concat(F.when(part(c, 5) != "", F.concat(F.lit("?"), part(c, 5))).otherwise(""), F.when(part(c, 6) != "", F.concat(F.lit("#"), part(c, 6))).otherwise(""))
    p = F.when(path(c) == "/", "/").otherwise(F.regexp_replace(path(c), "/$", ""))
    slash = F.when(p == "/", "/").otherwise(F.concat(p, F.lit("/")))
    www, plain = h.startswith("www."), s == "http"
    apex = F.regexp_replace(h, r"^www\.", "")
    made = lambda sch, hst, pth: F.concat(sch, F.lit("://"), hst, pth, tail)
    https, longer = F.lit("https"), F.concat(F.lit("www."), h)
    found = F.array(
        F.when(plain, made(https, h, p)), F.when(~www, made(https, longer, p)), F.when(plain, made(https, h, slash)), F.when(plain & ~www, made(https, longer, slash)),
        F.when(www, made(s, apex, p)), F.when(plain & www, made(https, apex, p)),
    )
    web = s.isin("http", "https") & is_url(c)
    return F.when(web, F.array_except(F.array_distinct(F.array_compact(found)), F.array(c))).otherwise(F.array().cast("array<string>"))


def _private_octets(ip: Column) -> Column:
    a, b = (F.get(F.split(ip, r"\."), F.lit(i)).try_cast("int") for i in range(2))
    return a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))


_IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"


def blocked_host(c: Column, deny: Sequence[str] = ()) -> Column:
    """Whether a host must not be fetched: empty, local names, private or special addresses, numbers as hosts, denied suffixes."""
    h = F.lower(trimmed(F.coalesce(c, F.lit(""))))
    h = F.regexp_replace(F.regexp_replace(F.regexp_replace(h, r"^\[|\]$", ""), r"\.+$", ""), "%.*$", "")
    return let(h, lambda x: _blocked(x, deny))


def _blocked(h: Column, deny: Sequence[str]) -> Column:
    names = h.isin("localhost", "ip6-localhost") | h.rlike(r"\.(localhost|local|internal|intranet|home\.arpa)$")
    number = h.rlike("^([0-9]+|0x[0-9a-f]+)$")
    v4 = h.rlike(_IPV4) & _private_octets(h)
    mapped = F.regexp_extract(h, r"^::ffff:([0-9.]+)$", 1)
    hi, lo = (F.conv(F.regexp_extract(h, "^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", i), 16, 10).cast("int") for i in (1, 2))
    joined = F.concat_ws(".", F.shiftright(hi, 8), hi.bitwiseAND(255), F.shiftright(lo, 8), lo.bitwiseAND(255))
    v6 = (mapped.rlike(_IPV4) & _private_octets(mapped)) | (h.rlike("^::ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$") & _private_octets(joined)) | h.isin("::1", "::") | h.rlike("^fe[89ab][0-9a-f]:") | h.rlike("^f[cd][0-9a-f]{2}:")
    return F.coalesce((h == "") | names | number | v4 | v6 | in_domains(h, deny), F.lit(True))


def page_pattern(c: Column) -> Column:
    return F.regexp_replace(c, "/page/[0-9]+", "/page/*")


def resolve_link(href: Column, base: Column) -> Column:
    """An absolute URL of a link on a page: absolute, //host, /path or relative to the page's folder."""
    root = F.concat(scheme(base), F.lit("://"), host(base), _port(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (
        F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href)).when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(root, folder, F.regexp_replace(href, r"^\./", "")))
    )


#: Second-level names under which companies register.
TWO_PART = ("co.uk", "com.au", "co.nz", "co.jp", "com.br", "co.in", "co.za")


def domain_name(c: Column) -> Column:
    """A company name from its host: the registered label, split at - and _, words capitalized."""
    t = trimmed(c)
    h = F.regexp_replace(host(F.when(t.rlike("^[A-Za-z]+://"), t).otherwise(F.concat(F.lit("https://"), t))), r"^www\.", "")
    return let(h, _label_name)


def _label_name(h: Column) -> Column:
    labels = F.split(h, r"\.")
    two = F.coalesce(F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)).isin(*TWO_PART), F.lit(False))
    at = F.greatest(F.size(labels) - F.when(two, 2).otherwise(1), F.lit(1))
    words = F.filter(F.split(F.element_at(labels, at), "[-_]+"), lambda w: w != "")
    return F.when(h != "", F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " "))


#: Link parameters of aggregators, in the order in which they are tried.
LINK_PARAMS = ("url", "u", "target", "redirect", "targetUrl", "website")
AGGREGATORS = ("app.sourcescrub.com", "sourcescrub.com", "google.com", "bing.com", "linkedin.com", "www.linkedin.com", "dnb.com", "zoominfo.com", "crunchbase.com")


def canonical_website(c: Column, aggregators: Sequence[str] = AGGREGATORS) -> Column:
    """Origin of a website; a link through an aggregator is unwrapped, an aggregator alone is null."""
    t = trimmed(c)
    t = F.when(t == "", None).when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    origin = lambda u: F.when(is_url(u) & host(u).contains("."), F.concat(scheme(u), F.lit("://"), host(u), _port(u)))

    def unwrapped(u: Column) -> Column:
        found = F.coalesce(*[F.nullif(F.try_url_decode(F.regexp_extract(u, f"[?&]{p}=([^&#]*)", 1)), F.lit("")) for p in LINK_PARAMS])
        return let(found, lambda x: F.when(x.rlike("(?i)^https?://"), x).otherwise(F.concat(F.lit("https://"), x)))

    inside = lambda u: let(unwrapped(u), lambda x: F.when(~host(x).isin(*aggregators), origin(x)))
    return let(t, lambda u: F.when(host(u).isin(*aggregators), inside(u)).otherwise(origin(u)))

"""String, number, date and record functions: Column in, Column out."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

#: White space as browsers' trim() and \s know it: also no-break space, byte order mark and the Unicode separators.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f refers to it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def squeezed(c: Column) -> Column:
    """White-space runs become one blank, ends are trimmed."""
    return trimmed(F.regexp_replace(c, f"[{WS}]+", " "))


def leading_number(c: Column) -> Column:
    """The number that the text begins with, as double; none: null."""
    return F.regexp_extract(c, r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)", 0).try_cast("double")


def title_case(c: Column) -> Column:
    """Lower case, then every ASCII word character after a non-word one is upper-cased (o'brien: O'Brien)."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def parse_int(c: Column) -> Column:
    """Digits and minus signs of the text, then the integer they begin with; numbers in the middle of signs end it."""
    return F.regexp_extract(F.regexp_replace(c, "[^0-9-]", ""), "^-?[0-9]+", 0).try_cast("bigint")


def parse_float(c: Column) -> Column:
    return leading_number(F.regexp_replace(c, "[^0-9.-]", ""))


def currency_to_float(c: Column) -> Column:
    """Dollars, thousands (k) or millions (m, looked for first); billions are not scaled."""
    bare = F.lower(F.regexp_replace(c, f"[$,{WS}]", ""))
    scale = F.when(bare.contains("m"), 1e6).when(bare.contains("k"), 1e3).otherwise(1.0)
    return parse_float(bare) * scale


def with_scheme(c: Column) -> Column:
    """Trimmed; https:// in front unless there is a scheme; blank: null."""
    t = trimmed(c)
    return F.when(t == "", None).when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


#: Formats that parse_date reads, in order; all else is null.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "MM/dd/yyyy", "M/d/yyyy", "d MMM yyyy HH:mm:ss Z")


def parse_time(c: Column) -> Column:
    bare = F.regexp_replace(trimmed(c), "^[A-Z][a-z]{2}, ", "")  # the day of the week says nothing more
    return let(bare, lambda x: F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in DATE_FORMATS]))


def parse_date(c: Column) -> Column:
    """ISO-8601 text in UTC with milliseconds."""
    return F.date_format(parse_time(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def normalize_phone(c: Column) -> Column:
    d = F.regexp_replace(c, "[^0-9]", "")
    local = lambda at: F.concat(F.lit("("), F.substring(d, at, 3), F.lit(") "), F.substring(d, at + 3, 3), F.lit("-"), F.substring(d, at + 6, 4))
    return F.when(F.length(d) == 10, local(1)).when((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+1 "), local(2))).otherwise(c)


#: Postal codes of the states.
STATES = (
    "Alabama AL, Alaska AK, Arizona AZ, Arkansas AR, California CA, Colorado CO, Connecticut CT, Delaware DE, Florida FL, Georgia GA, Hawaii HI, Idaho ID, Illinois IL, Indiana IN, "
    "Iowa IA, Kansas KS, Kentucky KY, Louisiana LA, Maine ME, Maryland MD, Massachusetts MA, Michigan MI, Minnesota MN, Mississippi MS, Missouri MO, Montana MT, Nebraska NE, Nevada NV, "
    "New Hampshire NH, New Jersey NJ, New Mexico NM, New York NY, North Carolina NC, North Dakota ND, Ohio OH, Oklahoma OK, Oregon OR, Pennsylvania PA, Rhode Island RI, South Carolina SC, "
    "South Dakota SD, Tennessee TN, Texas TX, Utah UT, Vermont VT, Virginia VA, Washington WA, West Virginia WV, Wisconsin WI, Wyoming WY"
)
STATE_CODES = {name.rsplit(" ", 1)[0].lower(): name.rsplit(" ", 1)[1] for name in STATES.split(", ")}


def lookup(table: dict[str, str], c: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), c)


def normalize_state(c: Column) -> Column:
    return F.coalesce(lookup(STATE_CODES, F.lower(trimmed(c))), F.upper(c))


#: Endings of company names, removed in this order, each once.
DESIGNATORS = ("inc", "incorporated", "corp", "corporation", "ltd", "limited", "llc", "llp", "lp", "co", "company", "group", "holdings")


def remove_company_designators(c: Column) -> Column:
    out = trimmed(c)
    for word in DESIGNATORS:
        out = trimmed(F.regexp_replace(out, rf"(?i)\b{word}\.?$", ""))
    return out


def sanitize_formula(c: Column) -> Column:
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


#: Named transforms of a cell; TRANSFORMS' keys are what validate_transforms() knows.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "trim": trimmed, "titleCase": title_case, "upperCase": F.upper, "toLowerCase": F.lower, "parseInt": parse_int, "parseFloat": parse_float, "currencyToFloat": currency_to_float,
    "normalizeUrl": with_scheme, "parseDate": parse_date, "normalizePhone": normalize_phone, "normalizeEmail": lambda c: trimmed(F.lower(c)), "normalizeState": normalize_state,
    "removeCompanyDesignators": remove_company_designators, "sanitizeForExcel": sanitize_formula,
}


def transform_value(name: str, c: Column) -> Column:
    """The named transform; an unknown name passes the value through."""
    return TRANSFORMS.get(name, lambda x: x)(c)


def apply_transforms(c: Column, names: str) -> Column:
    for name in names.split(","):
        c = transform_value(name.strip(), c)
    return c


def validate_transforms(names: Iterable[str]) -> dict[str, list[str]]:
    names = list(names)
    return {"valid": [n for n in names if n in TRANSFORMS], "invalid": [n for n in names if n not in TRANSFORMS]}


def header_similarity(a: Column, b: Column) -> Column:
    """1 for equal letters and digits, 0.8 of the length ratio if one holds the other, else the edit similarity; the best of both."""
    x, y = (F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "")) for c in (a, b))
    longest = F.greatest(F.length(x), F.length(y))
    held = F.when((x.contains(y) | y.contains(x)) & (F.least(F.length(x), F.length(y)) > 0), 0.8 * F.least(F.length(x), F.length(y)) / longest).otherwise(0.0)
    return F.when(x == y, 1.0).otherwise(F.greatest(held, (longest - F.levenshtein(x, y)) / longest))


def coerce_number(c: Column) -> Column:
    """The leading number of the text without commas and percent signs, else 0."""
    return F.coalesce(leading_number(trimmed(F.regexp_replace(c.cast("string"), "[,%]", ""))), F.lit(0.0))


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), f"[^a-z0-9{WS}]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, f"[{WS}]+", "_"), "_+", "_"), "^_+|_+$", "")


def is_summary_row(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).rlike("career|avg|yrs|2tm|3tm|4tm"), F.lit(False))


def parse_birthdate(month_day: Column, year: Column) -> Column:
    """ISO date of 'March 5' and a year of four digits; anything else null."""
    both = F.concat_ws(" ", trimmed(month_day), F.when(year.cast("string").rlike("^[0-9]{4}$"), year.cast("string")))
    return F.date_format(F.coalesce(*[F.try_to_timestamp(both, F.lit(f)) for f in ("MMMM d yyyy", "MMM d yyyy")]), "yyyy-MM-dd")


def split_sentences(c: Column) -> Column:
    """Sentences with their end marks; white space after . ! ? parts them."""
    return F.filter(F.split(c, f"(?<=[.!?])[{WS}]+"), lambda s: s != "")


def parse_listlike(c: Column) -> Column:
    """Items parted by ; , • | / or several blanks, without marks at their ends; of items equal but for case the first stays."""
    items = F.transform(F.split(c, f"[;,•|/]|[{WS}]{{2,}}"), lambda p: F.regexp_replace(trimmed(p), rf"^[{WS}.\-:]+|[{WS}.\-:]+$", ""))
    both = lambda xs: F.struct(xs.alias("items"), F.transform(xs, F.lower).alias("low"))
    first = lambda s: F.filter(s["items"], lambda x, i: F.array_position(s["low"], F.lower(x)) == i + 1)
    return let(F.filter(items, lambda p: p != ""), lambda xs: let(both(xs), first))


def sanitize_string(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"[<>\"';\\]", ""))


def clean_phone(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, f"[^0-9\\-()+{WS}]", ""))


def clean_website(c: Column) -> Column:
    t = trimmed(c)
    return F.when(t == "", None).when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def weighted(*parts: tuple[Column, float]) -> Column:
    """Sum of the weights whose condition holds; null conditions don't."""
    total = F.lit(0.0)
    for condition, weight in parts:
        total = total + F.when(condition, float(weight)).otherwise(0.0)
    return total


def filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


#: Weights of record_confidence by kind of record.
RECORD_WEIGHTS = {
    "company": {"name": 0.3, "contact": 0.2, "website": 0.2, "address": 0.1, "phone": 0.1, "description": 0.1},
    "player": {"name": 0.4, "position": 0.2, "team": 0.2, "statistics": 0.2},
    "news": {"title": 0.3, "content": 0.4, "author": 0.1, "date": 0.2},
}


def record_confidence(df: DataFrame, kind: str, weights: dict[str, dict[str, float]] = RECORD_WEIGHTS) -> DataFrame:
    parts = [(filled(F.col(c).cast("string")), w) for c, w in weights[kind].items() if c in df.columns]
    return df.withColumn("confidence", F.round(weighted(*parts), 4))

"""Mapping messy sheets onto fixed fields: headers, column shapes, whole rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from ..functions.text import apply_transforms, header_similarity, trimmed


#: Names of target fields that are compared with every header, at most: they travel with each task.
MOST_NAMES = 10_000


def _scored(headers: DataFrame, defs: DataFrame) -> DataFrame:
    """headers with near: array<struct<cost, target>> of the targets' best similarities (as negative cost), best first, ties by target.

    The targets' names are configuration: they are collected, their number is checked, and each header is compared with
    them where it stands. Nothing is joined or shuffled.
    """
    rows = defs.select("target_field", F.explode("source_headers").alias("name")).limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names of target fields")
    names: dict[str, list[str]] = {}
    for r in rows:
        names.setdefault(r.target_field, []).append(r.name)
    if not names:
        return headers.withColumn("near", F.array().cast("array<struct<cost: double, target: string>>"))
    targets = F.array(*[F.struct(F.lit(t).alias("target"), F.array(*[F.lit(n) for n in ns]).alias("names")) for t, ns in names.items()])
    score = lambda t: F.array_max(F.transform(t["names"], lambda n: header_similarity(F.col("header"), n)))
    return headers.withColumn("near", F.array_sort(F.transform(targets, lambda t: F.struct((-score(t)).alias("cost"), t["target"].alias("target")))))


def auto_map_headers(headers: DataFrame, defs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(header, pos, target_field, score): each header's best target at or above the threshold, each target's first header.

    headers (header, pos); defs (target_field, source_headers, ...). Ties go to the target's name. Others have null.
    """
    best = _scored(headers, defs).withColumn("best", F.try_element_at("near", F.lit(1)))
    best = best.withColumn("_target", F.when(-F.col("best.cost") >= threshold, F.col("best.target")))
    first = best.filter("_target is not null").groupBy("_target").agg(F.min("pos").alias("_first"))  # one row a target
    mine = best.join(F.broadcast(first), "_target", "left").withColumn("_mine", F.col("pos") == F.col("_first"))
    return mine.select(*headers.columns, F.when(F.col("_mine"), F.col("_target")).alias("target_field"), F.when(F.col("_mine"), -F.col("best.cost")).alias("score"))


def mapping_summary(mapped: DataFrame, defs: DataFrame) -> DataFrame:
    """(mapped, unmapped, missing_required, confidence) of auto_map_headers(): mean score less 0.2 for each missing required field."""
    missing = defs.filter("required").join(mapped.filter("target_field is not null"), "target_field", "left_anti").agg(F.sort_array(F.collect_list("target_field")).alias("missing_required"))
    counts = mapped.agg(F.count("target_field").alias("mapped"), F.count_if(F.col("target_field").isNull()).alias("unmapped"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("_mean"))
    return counts.join(F.broadcast(missing)).select("mapped", "unmapped", "missing_required", F.greatest(F.lit(0.0), F.col("_mean") - 0.2 * F.size("missing_required")).alias("confidence"))


def suggest_mappings(unmapped: DataFrame, defs: DataFrame, used: DataFrame, threshold: float = 0.3, most: int = 3) -> DataFrame:
    """(header, target_field, score, rank): the best unused targets of each unmapped header."""
    free = defs.join(used.select("target_field").distinct(), "target_field", "left_anti")
    near = F.slice(F.filter("near", lambda n: -n["cost"] >= threshold), 1, most)
    out = _scored(unmapped, free).select("header", F.posexplode(near).alias("at", "n"))
    return out.select("header", F.col("n.target").alias("target_field"), (-F.col("n.cost")).alias("score"), (F.col("at") + 1).alias("rank"))


def validate_mapping(mapping: DataFrame, defs: DataFrame) -> DataFrame:
    """(check, field): unknown targets, targets mapped twice, required fields that are missing."""
    m = mapping.filter(F.col("target_field").isNotNull() & (F.col("target_field") != ""))
    unknown = m.join(defs, "target_field", "left_anti").select(F.lit("unknown_target").alias("check"), F.col("target_field").alias("field")).distinct()
    twice = m.groupBy("target_field").count().filter("count > 1").select(F.lit("duplicate_target"), "target_field")
    missing = defs.filter("required").join(m, "target_field", "left_anti").select(F.lit("missing_required"), "target_field")
    return unknown.union(twice).union(missing)


def mapping_confidence(mapping: DataFrame, defs: DataFrame) -> DataFrame:
    """(coverage, required, confidence): 0.6 of the share of headers mapped and 0.4 of the share of required fields met."""
    m = mapping.agg(F.coalesce(F.try_divide(F.count_if(F.col("target_field").isNotNull() & (F.col("target_field") != "")) * 1.0, F.count(F.lit(1))), F.lit(0.0)).alias("coverage"))
    need = defs.filter("required").join(mapping.select("target_field", F.lit(1).alias("_met")).distinct(), "target_field", "left").agg(F.coalesce(F.try_divide(F.count("_met") * 1.0, F.count(F.lit(1))), F.lit(1.0)).alias("required"))
    return m.join(F.broadcast(need)).select("coverage", "required", (0.6 * F.col("coverage") + 0.4 * F.col("required")).alias("confidence"))


def mapped_rows(sheet: DataFrame, mapping: dict[str, str], defs: list[dict]) -> DataFrame:
    """sheet's mapped columns under their target names, blanks replaced by defaults, named transforms applied in turn."""
    by = {d["target_field"]: d for d in defs}
    out = []
    for header, target in mapping.items():
        c, d = F.col(f"`{header}`"), by.get(target, {})
        if d.get("default_value"):
            c = F.when(c.isNull() | (c == ""), F.lit(d["default_value"])).otherwise(c)
        out.append((apply_transforms(c, d["transform"]) if d.get("transform") else c).alias(target))
    return sheet.select(*out)


def report_columns(df: DataFrame, defs: list[dict]) -> list[str]:
    """Names of df's columns that hold anything: required fields first, then alphabetically."""
    need = [d["target_field"] for d in defs if d.get("required")]
    known = [d["target_field"] for d in defs if d["target_field"] in df.columns]
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != "")).alias(c) for c in known]).first()
    return sorted((c for c in known if counts[c]), key=lambda c: (c not in need, c))


def column_shape(sheet: DataFrame, rows: int | None = None) -> DataFrame:
    """(header, n, url_share, paragraph_share, top_host) of each column; with `rows`, of as many first rows ordered by all columns."""
    names = sheet.columns
    first = sheet if rows is None else sheet.orderBy(*[F.col(f"`{c}`") for c in names]).limit(rows)
    head = first.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    cells = head.select(F.explode(F.array(*[F.struct(F.lit(c).alias("header"), F.col(f"`{c}`").alias("v")) for c in names])).alias("x")).select("x.header", trimmed(F.col("x.v")).alias("v"))
    url = F.col("v").rlike(r"(?i)^(https?://)?([a-z0-9-]+\.)+[a-z]{2,}(/.*)?$")
    para = (F.length("v") >= 40) & F.col("v").rlike(r"\s")
    cells = cells.withColumn("is_url", F.coalesce(url, F.lit(False))).withColumn("host", F.when(url, U.host(F.when(F.col("v").contains("://"), F.col("v")).otherwise(F.concat(F.lit("https://"), F.col("v"))))))
    full = F.count_if(F.col("v").isNotNull() & (F.col("v") != ""))
    shape = cells.groupBy("header").agg(full.alias("n"), F.coalesce(F.try_divide(F.count_if("is_url") * 1.0, full), F.lit(0.0)).alias("url_share"), F.coalesce(F.try_divide(F.count_if(F.coalesce(para, F.lit(False))) * 1.0, full), F.lit(0.0)).alias("paragraph_share"))
    hosts = cells.filter("host is not null").groupBy("header", "host").count().groupBy("header").agg(F.max_by("host", F.struct("count", "host")).alias("top_host"))
    return shape.join(hosts, "header", "left")


#: Header patterns of each field; every one that fits counts 2.
FIELD_PATTERNS = {
    "company": (r"^(company|legal)\s*name$", r"^company$", r"^name$", r"^firm$", r"^organization$", r"^org$", r"^account\s*name$"),
    "website": (r"^web\s*site$", r"^website$", r"^url$", r"homepage", r"domain", r"company\s*site", r"\bsite\b"),
    "description": (r"^description$", r"profile|overview|about|summary"),
    "specialties": (r"specialt(y|ies)", r"capabilit", r"competenc", r"expertise", r"service\s*lines?", r"focus\s*areas?"),
    "products": (r"^products?$", r"solutions?|offerings?|equipment|sku"),
    "end_markets": (r"end\s*markets?", r"markets?\s*served", r"verticals|segments"),
    "industries": (r"^industry$", r"industries$", r"sector", r"naics|sic|category|categories"),
}


def pick_columns(sheet: DataFrame, patterns: dict = FIELD_PATTERNS, aggregators: tuple[str, ...] = U.AGGREGATORS) -> dict[str, str | None]:
    """The best column for each field, of equals the first: pattern score plus 6 x URL share (websites, less 3 for aggregators) or 4 x paragraph share (texts)."""
    import re

    shapes = {r.header: r for r in column_shape(sheet).collect()}
    out: dict[str, str | None] = {}
    for field, rules in patterns.items():
        best, found = 0, None
        for header in sheet.columns:
            shape = shapes[header]
            score = 2 * sum(bool(re.search(p, header.strip(), re.I)) for p in rules)
            if field == "website":
                score += int(6 * shape.url_share + 0.5) - (3 if shape.top_host in aggregators else 0)
            elif field in ("description", "specialties", "products"):
                score += int(4 * shape.paragraph_share + 0.5)
            if score > best:
                best, found = score, header
        out[field] = found
    return out


def column_by_synonyms(headers: list[str], names: tuple[str, ...]) -> str | None:
    """The header of least rank: those equal to a name before those that hold one, then by the header's or the name's place."""
    import re

    words = lambda s: " ".join(re.findall("[a-z0-9]+", s.lower()))
    sought = [words(n) for n in names]
    ranks = [((0, at), h) for at, h in enumerate(headers) if words(h) in sought]
    ranks += [((1, at, i), h) for at, h in enumerate(headers) for i, w in enumerate(sought) if w and w in words(h)]
    return min(ranks, default=(None, None), key=lambda r: r[0])[1]


def anything(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.isNotNull() & (c != "") for c in columns])

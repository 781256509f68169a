"""Company tables: de-duplication, page scores, target lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import companies as C, urls as U
from ..functions.text import clean_phone, clean_website, filled, trimmed
from ..sources.io import write_csv
from .crawl_logs import companies_per_url
from .mapping import column_by_synonyms, pick_columns


def dedupe_companies(df: DataFrame, by: Sequence[str] = ("url",), name: str = "name", pos: str = "pos") -> DataFrame:
    """The first row (by pos) of each name, letters and digits only; rows without such a name are left out. by=(): over all pages."""
    keyed = df.withColumn("_key", F.regexp_replace(F.lower(F.col(name)), "[^a-z0-9]", "")).filter("_key != ''")
    first = keyed.groupBy(*by, "_key").agg(F.min_by(F.struct(*df.columns), F.col(pos)).alias("r"))
    return first.select("r.*")


def directory_score(companies: DataFrame, meta: DataFrame) -> DataFrame:
    """(url, n, complete, empty, score, valid) per page: companies (url, name, contact, website), meta (url, title, description).

    Complete rows have all three, empty ones no name; valid pages keep four of six rules: some company, name, contact,
    site, capitalized name, absolute site.
    """
    name, contact, site = (F.coalesce(c, F.lit("")) for c in ("name", "contact", "website"))
    counts = companies.groupBy("url").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((name != "") & (contact != "") & (site != "")).alias("complete"), F.count_if(name == "").alias("empty"),
        (
            F.lit(1) + F.bool_or(F.length(name) > 2).cast("int") + F.bool_or(F.length(contact) > 5).cast("int") + F.bool_or(F.length(site) > 5).cast("int")
            + F.bool_or(name.rlike("^[A-Z]")).cast("int") + F.bool_or(site.rlike("https?://")).cast("int")
        ).alias("rules"),
    )
    out = meta.join(counts, "url", "left").fillna(0, ["n", "complete", "empty", "rules"])
    score = F.least(10 * F.col("n"), F.lit(100)) + 20 * F.col("complete") + F.when(filled(F.col("title")), 10).otherwise(0) + F.when(filled(F.col("description")), 10).otherwise(0) - 5 * F.col("empty")
    return out.select("url", "n", "complete", "empty", F.greatest(F.lit(0), F.least(F.lit(200), score)).alias("score"), (F.col("rules") >= 4).alias("valid"))


#: Other names of a sheet's columns.
SYNONYMS = {
    "company": ("Company Name", "Company", "Name", "Organization", "Org Name", "Legal Name", "Account Name", "Firm", "Business Name", "Entity", "DBA", "Informal Name"),
    "website": ("Website", "Company Website", "Domain", "Company Domain", "URL", "Homepage", "Web Site", "Company URL", "ProfileUrl", "LinkedIn Website"),
    "description": ("Description", "About", "Company Description", "Business Description", "Profile", "Long Description", "Short Description", "Overview"),
    "specialties": ("Specialties", "Specialty", "Capabilities", "Services", "Service Lines", "Competencies", "Focus Areas", "Expertise", "Practice Areas", "Solutions"),
    "products": ("Products and Services", "Products & Services", "Products/Services", "Offerings", "Solutions", "Product Lines", "Service Offerings"),
    "end_markets": ("End Markets", "Markets", "Customer Segments", "Target Markets", "Customers", "Client Types", "Client Segments", "Verticals Served"),
    "industries": ("Industry", "Industries", "Primary Industry", "Sector", "Sectors", "Verticals", "NAICS", "SIC", "NAICS Description", "SIC Description"),
}


def with_summaries(sheet: DataFrame) -> DataFrame:
    """(Company Name, Website, Summary) of a sheet with any of the synonymous headers."""
    at = {field: column_by_synonyms(sheet.columns, names) for field, names in SYNONYMS.items()}
    c = {field: F.col(f"`{h}`") if h else F.lit("") for field, h in at.items()}
    summary = C.company_summary(c["company"], c["website"], c["description"], c["specialties"], c["products"], c["end_markets"], c["industries"])
    name = F.coalesce(F.nullif(trimmed(c["company"]), F.lit("")), U.domain_name(F.nullif(c["website"], F.lit(""))), F.lit(""))
    return sheet.select(name.alias("Company Name"), F.coalesce(c["website"], F.lit("")).alias("Website"), summary.alias("Summary"))


#: Fixed value: what is said of a company of which nothing is known.
NO_DETAILS = "Provides industry-related services (details not specified)."


def target_list(sheet: DataFrame, blank: str = "—") -> DataFrame:
    """(Company, Website, Summary) of every row; aggregator links are unwrapped or blanked.

    The summary is the first that is filled of description, specialties, products, end markets and industries, else the
    fixed sentence, so no row is without one. Companies without a name go by their site, then by `blank`.
    """
    at = pick_columns(sheet)
    c = {f: F.col(f"`{h}`") if h else F.lit(None).cast("string") for f, h in at.items()}
    site = U.canonical_website(c["website"])
    name = F.coalesce(F.nullif(trimmed(c["company"]), F.lit("")), U.domain_name(site))
    texts = [F.nullif(trimmed(c[f]), F.lit("")) for f in ("description", "specialties", "products", "end_markets", "industries")]
    return sheet.select(F.coalesce(name, F.lit(blank)).alias("Company"), F.coalesce(site, F.lit(blank)).alias("Website"), F.coalesce(*texts, F.lit(NO_DETAILS)).alias("Summary"))


def supplier_directory(companies: DataFrame) -> DataFrame:
    """Companies (url, pos, name, contact, website) with cleaned phones and sites, one of each name a page."""
    clean = companies.withColumn("contact", clean_phone(F.col("contact"))).withColumn("website", clean_website(F.col("website")))
    return dedupe_companies(clean)


def directory_report(companies: DataFrame, meta: DataFrame) -> DataFrame:
    """(url, n_companies, has_contact, has_site, n, complete, empty, score, valid) per page: what was found and how good it is.

    companies is supplier_directory()'s; meta (url, title, description) has the pages, those without companies included.
    """
    lists = companies.groupBy("url").agg(F.collect_list(F.struct("name", "contact", "website")).alias("companies"))  # a page's rows
    counts = companies_per_url(meta.select("url").join(lists, "url", "left"))
    return counts.join(directory_score(companies, meta), "url")


def export_directory(companies: DataFrame, path: str) -> None:
    """supplier_directory()'s companies as CSV: name, contact, website, url; cells that a spreadsheet would run are made safe."""
    write_csv(companies.select("name", "contact", "website", "url"), path)

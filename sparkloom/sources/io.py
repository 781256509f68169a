"""Reading and writing: URL lists, sheets, player files, results, feeds, sitemaps, .docx paragraphs, CSV, JSON lines."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import sanitize_formula, trimmed

RESULTS = (
    "url string, success boolean, title string, contentLength int, contentPreview string, metadata struct<author: string, date: string, category: string>, "
    "error struct<code: string, message: string, status: int>, processingTime long, chunkIndex int, timestamp long, sessionId string"
)
SEASON = "Season: string, Age: string, Team: string, Pos: string, G: string, GS: string, Awards: string, stats: map<string, string>"
PLAYERS = f"players array<struct<id: string, url: string, profile: struct<name: string, position: string, personal: struct<birthDate: string, birthPlace: string, college: string>>, statistics: struct<seasons: array<struct<{SEASON}>>>>>"


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(idx, url): one URL a line, without blanks and # comments; idx keeps the order within a file."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("idx"), trimmed(F.col("value")).alias("url"))
    return lines.filter("url != '' and not startswith(url, '#')")


def read_company_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted cells may hold line breaks; empty lines are skipped."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def read_players_json(spark: SparkSession, path: str) -> DataFrame:
    """(player_idx, raw) of a document {players: [...]}; fails if the array is missing."""
    whole = spark.read.schema(PLAYERS).json(path, multiLine=True)
    checked = whole.select(F.when(F.col("players").isNull(), F.raise_error(F.lit("players is missing"))).otherwise(F.col("players")).alias("players"))
    return checked.select(F.posexplode("players").alias("player_idx", "raw"))


def read_results_jsonl(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return (spark.readStream if streaming else spark.read).schema(RESULTS).json(path)


def read_feeds(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(url, title, date, description, source) of RSS items and Atom entries."""
    rss = spark.read.format("xml").option("rowTag", "item").schema("link string, title string, pubDate string, description string").load(path)
    atom = spark.read.format("xml").option("rowTag", "entry").schema("link struct<_href: string>, title string, published string, updated string, summary string").load(path)
    items = rss.select(F.col("link").alias("url"), "title", F.col("pubDate").alias("date"), "description")
    entries = atom.select(F.col("link._href").alias("url"), "title", F.coalesce("published", "updated").alias("date"), F.col("summary").alias("description"))
    return items.unionByName(entries).filter("url is not null").withColumn("source", F.lit(source))


def read_sitemaps(spark: SparkSession, path: str, source: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    return rows.select(F.trim("loc").alias("url"), F.lit(source).alias("source")).filter("url is not null and url != ''")


def _docx(path: str, content: bytes | None, too_big: bool) -> list[tuple]:
    if too_big:
        return [(path, None, None, "file too large")]
    if path.lower().endswith(".docm"):
        return [(path, None, None, "macro-enabled documents are not accepted")]
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if any("vbaproject" in n.lower() for n in z.namelist()):
                return [(path, None, None, "macro-enabled documents are not accepted")]
            xml = z.read("word/document.xml").decode("utf-8")
    except (zipfile.BadZipFile, KeyError, UnicodeDecodeError):
        return [(path, None, None, "not a .docx document")]
    out = []
    for body in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S):
        text = re.sub(r"\s+", " ", unescape("".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", body, re.S)))).strip()
        if text:
            out.append((path, len(out), text, None))
    return out


def read_docx_paragraphs(spark: SparkSession, path: str, max_mb: int = 5) -> DataFrame:
    """(path, para_idx, text, error): paragraphs of each file; a file that isn't accepted gives one row with an error.

    The size is checked on the listing: larger files' contents never reach a task.
    """
    files = spark.read.format("binaryFile").load(path)
    most = max_mb << 20
    rows = files.filter(F.col("length") <= most).select("path", "content", F.lit(False).alias("big")).union(files.filter(F.col("length") > most).select("path", F.lit(None).cast("binary"), F.lit(True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame(_docx(row.path, row.content, row.big), columns=["path", "para_idx", "text", "error"]).astype({"para_idx": "Int32"})

    return rows.mapInPandas(run, "path string, para_idx int, text string, error string")


def sanitize_formulas(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would run get an apostrophe in front."""
    return df.select(*[sanitize_formula(F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str, safe: bool = True) -> None:
    (sanitize_formulas(df) if safe else df).write.csv(path, header=True, quote='"', escape='"', mode="overwrite")


def write_jsonl(df: DataFrame, path: str, by: str = "sessionId") -> None:
    df.write.partitionBy(by).json(path, mode="append")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}", mode="overwrite")

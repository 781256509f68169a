"""The player and season dataset: as-of team names, positions, unique ids, eligibility and checks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import coerce_number, is_summary_row, parse_birthdate, slugify
from ..shared import stored
from .ordered import running

#: Award names by what their text holds.
AWARDS = (("pro bowl", "Pro Bowl"), ("all-pro", "1st Team All-Pro"), ("mvp", "MVP"), ("opoy", "OPOY"), ("dpoy", "DPOY"), ("roy", "ROY"), ("comeback", "Comeback Player"))
#: Team names and codes from a first year on; codes that others stand for.
HISTORY = (
    ("SDG", 1961, "San Diego Chargers", "SDG"), ("SDG", 2017, "Los Angeles Chargers", "LAC"), ("LAC", 2017, "Los Angeles Chargers", "LAC"), ("STL", 1995, "St. Louis Rams", "STL"), ("STL", 2016, "Los Angeles Rams", "LAR"),
    ("LAR", 1946, "Los Angeles Rams", "LAR"), ("LAR", 1995, "St. Louis Rams", "STL"), ("LAR", 2016, "Los Angeles Rams", "LAR"), ("OAK", 1960, "Oakland Raiders", "OAK"), ("OAK", 1982, "Los Angeles Raiders", "LAI"),
    ("OAK", 1995, "Oakland Raiders", "OAK"), ("OAK", 2020, "Las Vegas Raiders", "LVR"), ("LAI", 1982, "Los Angeles Raiders", "LAI"), ("LVR", 2020, "Las Vegas Raiders", "LVR"), ("OTI", 1997, "Tennessee Oilers", "OTI"),
    ("OTI", 1999, "Tennessee Titans", "TEN"), ("TEN", 1999, "Tennessee Titans", "TEN"), ("PHO", 1988, "Phoenix Cardinals", "PHO"), ("PHO", 1994, "Arizona Cardinals", "ARI"), ("ARI", 1994, "Arizona Cardinals", "ARI"),
)
CODE_ALIASES = {"NO": "NOR", "TB": "TBB", "GB": "GBP", "NE": "NEP", "SF": "SFO", "KC": "KCC", "JAC": "JAX", "WSH": "WAS"}
#: Statistics of each position's table; those of receivers marked ? are null instead of 0.
STATS = {
    "QB": "Cmp Att CmpPct Yds TD Int Rate Sk SkYds Y/A AY/A Y/C Y/G NY/A ANY/A 4QC GWD".split(),
    "RB": "Att Yds TD Y/A Y/G A/G Tgt Rec RecYds Y/R RecTD R/G RecY/G Touch Y/Tch YScm RRTD Fmb".split(),
    "WR": "Tgt Rec RecYds Y/R RecTD R/G RecY/G Fmb Att? Yds? TD?".split(),
    "TE": "Tgt Rec RecYds Y/R RecTD R/G RecY/G Fmb Att? Yds? TD?".split(),
}


def parse_awards(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(part), name) for part, name in AWARDS]))


def team_history(spark: SparkSession, rows: Sequence[tuple] = HISTORY) -> DataFrame:
    return spark.createDataFrame(list(rows), "code string, start_year int, team_full string, team_abbrs string")


def season_team(seasons: DataFrame, history: DataFrame, static: DataFrame, code: str = "team", season: str = "season") -> DataFrame:
    """seasons with team_full, team_abbrs, multi_team: the code's name as of the season, else its static name, else unknown.

    Names become year ranges by looking ahead in each code's history; the dimension is small and joined as a range.
    """
    until = F.lead("start_year").over(Window.partitionBy("code").orderBy("start_year"))
    ranges = history.withColumn("until", F.coalesce(until, F.lit(9999))).select(F.col("code").alias("_c"), "start_year", "until", F.col("team_full").alias("_hf"), F.col("team_abbrs").alias("_ha"))
    fixed = static.select(F.col("code").alias("_sc"), F.col("team_full").alias("_sf"), F.col("team_abbrs").alias("_sa"))
    c, y = F.col(code), F.col(season)
    multi = c.isNull() | (c == "") | c.contains("TM")
    out = seasons.join(ranges, (c == F.col("_c")) & (y >= F.col("start_year")) & (y < F.col("until")), "left").join(fixed, c == F.col("_sc"), "left")
    full = F.when(multi, "Multiple Teams").otherwise(F.coalesce("_hf", "_sf", F.concat(F.lit("Unknown Team ("), c, F.lit(")"))))
    abbr = F.when(multi, "MULT").otherwise(F.coalesce("_ha", "_sa", c))
    return out.select(*seasons.columns, full.alias("team_full"), abbr.alias("team_abbrs"), multi.alias("multi_team"))


def primary_position(seasons: DataFrame, player: str = "player", pos: str = "pos", order: str = "idx") -> DataFrame:
    """(player, position): the most frequent non-blank position, of equals the one seen first."""
    rows = seasons.select(F.col(player).alias("player"), F.trim(F.col(pos)).alias("position"), F.col(order).alias("_i")).filter("position is not null and position != ''")
    counts = rows.groupBy("player", "position").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("first"))
    return counts.groupBy("player").agg(F.max_by("position", F.struct("n", -F.col("first"))).alias("position"))


def _numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(_rid, _slug, number) of rows (_slug, at, natural, t, _rid) sorted by slug, at and natural: row number `at` of a slug asks for a number.

    A merge of two ascending sequences: the rows' own numbers, and the numbers that names end in. A row takes the next number
    unless a name with it came before the row. Rows wait in a queue no longer than the numbers passed over so far.
    """
    slug, after, waiting = None, 1, deque()
    for pdf in batches:
        out: list[tuple] = []

        def give(upto: float) -> None:
            nonlocal after
            while waiting and after < upto:
                out.append((waiting.popleft()[1], slug, after))
                after += 1

        for own, at, natural, t, rid in pdf.itertuples(index=False):
            if own != slug:
                give(float("inf"))
                slug, after = own, 1
            give(at)
            if not natural:
                waiting.append((t, rid))
            elif waiting and after == at:
                if t < waiting[0][0]:
                    after += 1  # the name is taken
                else:
                    give(at + 1)
        yield pd.DataFrame(out, columns=["_rid", "_slug", "number"])
    tail = [(rid, slug, after + k) for k, (_, rid) in enumerate(waiting)]
    if tail:
        yield pd.DataFrame(tail, columns=["_rid", "_slug", "number"])


def unique_slug(df: DataFrame, name: str, order: str) -> DataFrame:
    """df with player_id: the name's slug, in `order` with _1, _2 ... where it is taken, also by slugs that end so themselves.

    A slug's rows are numbered by a prefix scan, so a name that most rows have is many tasks. Where names end in numbers
    (smith and smith_1), the free numbers are merged with the rows in order, streaming, from the shortest names on. `order`
    is a number; rows that tie in it follow in the order they are read. A null name is the empty slug.
    """
    columns = [c for c in df.columns if c != "player_id"]
    slug = F.coalesce(slugify(F.col(name)), F.lit(""))
    rows = running(df.select(*columns, slug.alias("_slug"), F.monotonically_increasing_id().alias("_rid")), ["_slug"], [order, "_rid"], {"_nth": F.lit(1)}).drop("_nth_total")
    rows = stored(rows, "slugs")
    firsts = rows.groupBy("_slug").agg(F.min(F.col(order).cast("double")).alias("t"))
    ends = r"^(.*)_([1-9][0-9]{0,17})$"
    named = firsts.select(F.col("_slug").alias("child"), "t", F.regexp_extract("_slug", ends, 1).alias("_slug"), F.regexp_extract("_slug", ends, 2).try_cast("long").alias("at")).filter("at is not null")
    named = stored(named.join(firsts.select("_slug"), "_slug"), "numbered")  # names whose shorter form is a name, too
    whole = rows.withColumn("player_id", F.when(F.col("_nth") == 1, F.col("_slug")).otherwise(F.concat("_slug", F.lit("_"), F.col("_nth") - 1)))
    if named.isEmpty():
        return whole.select(*columns, "player_id")
    family = named.select("_slug").union(named.select("child")).distinct()
    simple = whole.join(family, "_slug", "left_anti").select(*columns, "player_id")
    members = stored(rows.join(family, "_slug"), "families")
    level = stored(family.join(named.select(F.col("child").alias("_slug")), "_slug", "left_anti").withColumn("lost", F.lit(0)), "level")
    done = []
    while not level.isEmpty():
        own = members.join(level, "_slug").withColumn("at", F.col("_nth") - 1 + F.col("lost"))  # 0: the slug itself
        done.append(own.filter("at = 0").select("_rid", F.lit(0).cast("long").alias("number")))
        asked = own.filter("at > 0").select("_slug", "at", F.lit(False).alias("natural"), F.col(order).cast("double").alias("t"), "_rid")
        names = named.join(level.select("_slug"), "_slug").select("_slug", "at", F.lit(True).alias("natural"), "t", F.lit(-1).cast("long").alias("_rid"))
        made = asked.union(names).repartition("_slug").sortWithinPartitions("_slug", "at", "natural").mapInPandas(_numbers, "_rid long, _slug string, number long")
        made = stored(made, "numbers")
        done.append(made.select("_rid", "number"))
        gone = made.select("_slug", F.col("number").alias("at"), F.lit(1).alias("gone"))
        below = named.join(level.select("_slug"), "_slug").join(gone, ["_slug", "at"], "left")
        level = stored(below.select(F.col("child").alias("_slug"), F.coalesce("gone", F.lit(0)).alias("lost")), "level")
    numbered = members.join(reduce(DataFrame.union, done), "_rid")
    numbered = numbered.withColumn("player_id", F.when(F.col("number") == 0, F.col("_slug")).otherwise(F.concat("_slug", F.lit("_"), "number")))
    return simple.unionByName(numbered.select(*columns, "player_id"))


def eligible_seasons(df: DataFrame, season_min: int = 1997, season_max: int = 2024, min_games: int = 1, positions: Sequence[str] = ("QB", "RB", "WR", "TE")) -> DataFrame:
    """Rows (season_text, games_text, position, ...) that are no summary, in range, with enough games and a listed position; season and games as numbers."""
    season = F.regexp_extract(F.trim(F.col("season_text").cast("string")), "^-?[0-9]+", 0).try_cast("int")
    out = df.withColumn("season", season).withColumn("games", coerce_number(F.col("games_text")))
    return out.filter(~is_summary_row(F.col("season_text")) & F.col("season").between(season_min, season_max) & (F.col("games") >= min_games) & F.col("position").isin(*positions))


def eligibility(seasons: DataFrame, least: int = 1) -> DataFrame:
    """(player_id, rookie_year, seasons_with_G_ge_1, eligible_flag)."""
    played = F.count_if(F.col("games") >= 1)
    return seasons.groupBy("player_id").agg(F.min("season").alias("rookie_year"), played.alias("seasons_with_G_ge_1"), (played >= least).alias("eligible_flag"))


def check_references(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """(key, error): child keys that the parent lacks."""
    lost = child.select(key).distinct().join(parent.select(key), key, "left_anti")
    return lost.withColumn("error", F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))


def position_stats(seasons: DataFrame, position: str) -> DataFrame:
    """Rows of one position with its statistics, read from the map `stats` of texts."""
    rename = {"CmpPct": "Cmp%"}
    out = []
    for name in STATS[position]:
        bare = name.rstrip("?")
        key = F.lit(rename.get(bare, bare))
        raw, value = F.try_element_at("stats", key), F.coalesce(F.try_element_at("_numbers", key), F.lit(0.0))
        out.append((F.when(raw.isNotNull() & (raw != ""), value) if name.endswith("?") else value).alias(bare))
    base = ["player_id", "season", "age", "team_full", "team_abbrs", "position", "games", "games_started", "awards", "multi_team"]
    numbers = F.transform_values("stats", lambda k, v: coerce_number(v))  # of what is there, not for each of the names
    return seasons.filter(F.col("position") == position).withColumn("_numbers", numbers).select(*base, *out)


#: (table, column, check, argument) rules of the finished dataset.
RULES = (("players", "player_id", "pattern", "^[a-z0-9_]+$"), ("players", "player_id", "unique", None), ("players", "full_name", "required", None), ("seasons", "season", "range", (1997, 2024)), ("seasons", "age", "range", (18, 50)), ("seasons", "games", "range", (0, 21)), ("seasons", "player_id", "required", None))


def dataset_checks(tables: dict[str, DataFrame], rules: Sequence[tuple] = RULES) -> DataFrame:
    """(table, check, key, message) of every row that breaks a rule, and of references that lead nowhere."""
    found, broken = [], {}
    for table, column, check, argument in rules:
        df = tables.get(table)
        if df is None or column not in df.columns:
            continue
        c, text = F.col(column), F.col(column).cast("string")
        if check == "unique":
            bad = df.groupBy(column).count().filter("count > 1").select(text.alias("key"), F.lit("occurs more than once").alias("message"))
            found.append(bad.select(F.lit(table).alias("table"), F.lit(check).alias("check"), "key", "message"))
            continue
        if check == "required":
            test = c.isNull() | (text == "")
        else:
            test = ~F.coalesce(text.rlike(argument) if check == "pattern" else c.between(*argument), F.lit(False))
        row = F.struct(F.lit(table).alias("table"), F.lit(check).alias("check"), text.alias("key"), F.lit(f"{column} breaks {check}").alias("message"))
        broken.setdefault(table, []).append(F.when(test, row))
    found += [tables[table].select(F.inline(F.array_compact(F.array(*rows)))) for table, rows in broken.items()]  # a table's rules in one scan
    if "players" in tables and "seasons" in tables:
        lost = check_references(tables["seasons"], tables["players"], "player_id")
        found.append(lost.select(F.lit("seasons").alias("table"), F.lit("reference").alias("check"), F.col("player_id").alias("key"), F.col("error").alias("message")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def trivia_dataset(raw: DataFrame, history: DataFrame, static: DataFrame, **options) -> dict[str, DataFrame]:
    """players, one season table for each position, eligibility and checks from raw players.

    raw: idx, name, birth_date, birth_place, college, seasons array<struct<Season, Age, Team, Pos, G, GS, Awards, stats map>>
    (all texts). Ids are given after the position filter and before that of seasons, in order of idx. `raw` is stored, as it
    is read three times.
    """
    raw = stored(raw, "raw")
    rows = raw.select("idx", F.posexplode("seasons").alias("_pos", "s"))
    pos = primary_position(rows.select(F.col("idx").alias("player"), F.col("s.Pos").alias("pos"), F.col("_pos").alias("idx")))
    known = raw.join(pos.withColumnRenamed("player", "idx"), "idx").filter(F.col("position").isin(*STATS))
    named = stored(unique_slug(known.select("idx", "name", "birth_date", "birth_place", "college", "position"), "name", "idx"), "players")
    flat = rows.select("idx", F.col("s.Season").alias("season_text"), F.col("s.G").alias("games_text"), F.col("s.*")).join(named.select("idx", "player_id", "position"), "idx")
    good = eligible_seasons(flat, **options).withColumn("age", coerce_number(F.col("Age"))).withColumn("games_started", coerce_number(F.col("GS"))).withColumn("awards", parse_awards(F.col("Awards")))
    seasons = stored(season_team(good.withColumn("team", F.coalesce("Team", F.lit(""))), history, static), "seasons")  # all other tables read it
    players = named.join(seasons.select("player_id").distinct(), "player_id", "left_semi").select("player_id", F.col("name").alias("full_name"), F.col("position").alias("pos"), "college", parse_birthdate(F.col("birth_date"), F.col("birth_place")).alias("birthdate"))
    out = {"players": players, "eligibility": eligibility(seasons), "seasons": seasons}
    out |= {f"{p.lower()}_seasons": position_stats(seasons, p) for p in STATS}
    out["checks"] = dataset_checks({"players": players, "seasons": seasons})
    return out


def sorted_dataset(df: DataFrame, keys: Sequence[str], everywhere: bool = True) -> DataFrame:
    """Sorted by keys: all of it (a range shuffle), or only inside range partitions that follow each other."""
    return df.orderBy(*keys) if everywhere else df.repartitionByRange(*keys).sortWithinPartitions(*keys)


#: Spellings of positions.
POSITIONS = {"quarterback": "QB", "running back": "RB", "halfback": "RB", "fullback": "FB", "wide receiver": "WR", "tight end": "TE", "offensive tackle": "OT", "offensive guard": "OG", "center": "C", "defensive end": "DE", "defensive tackle": "DT", "nose tackle": "NT", "linebacker": "LB", "middle linebacker": "MLB", "outside linebacker": "OLB", "cornerback": "CB", "safety": "S", "kicker": "K", "punter": "P", "long snapper": "LS"}


def normalize_position(c: Column) -> Column:
    from ..functions.text import lookup

    return F.coalesce(lookup(POSITIONS, F.lower(F.trim(c))), F.upper(F.trim(c)))


def normalize_name(c: Column) -> Column:
    """Without a bracket at the end, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""), r"\s+", " "))


def normalize_team_code(c: Column) -> Column:
    from ..functions.text import lookup

    return F.coalesce(lookup(CODE_ALIASES, c), c)

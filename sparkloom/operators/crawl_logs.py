"""Reports over crawl results, request logs and error logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import urls as U
from ..shared import stored
from .ordered import joined, running, upper_median


def batch_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals, success rate in percent and mean response times of (success, skipped, response_time), one pass."""
    done, good = ~F.coalesce("skipped", F.lit(False)), F.coalesce("success", F.lit(False))
    n = lambda c: F.count_if(c)
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), n(done).alias("processed"), n(done & good).alias("successful"), n(done & ~good).alias("failed"), n(~done).alias("skipped"),
        F.coalesce(F.try_divide(n(done & good) * 100.0, n(done)), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg("response_time"), F.lit(0.0)).alias("avg_response_time"),
        F.coalesce(F.avg(F.when(good, F.col("response_time"))), F.lit(0.0)).alias("avg_success_time"),
    )


#: Message parts and the category they mean, first match wins; and all categories.
MESSAGE_RULES = (
    (("timeout",), "timeout"), (("network", "connection"), "network"), (("404",), "http_404"), (("403",), "http_403"), (("401",), "http_401"), (("429",), "rate_limit"), (("500", "502", "503"), "server_error"),
    (("dns", "enotfound"), "dns_error"), (("robots",), "blocked_by_robots"), (("cloudflare", "challenge"), "anti_bot_challenge"), (("redirect",), "redirect_loop"), (("ssl", "certificate"), "ssl_error"),
)
CATEGORIES = (
    "network", "timeout", "parsing", "validation", "rate_limit", "server_error", "client_error", "http_404", "http_403", "http_401", "dns_error", "blocked_by_robots", "anti_bot_challenge",
    "redirect_loop", "ssl_error", "unknown",
)


def _any_of(c: Column, words: Sequence[str]) -> Column:
    return c.rlike("|".join(words))


def error_category(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("unknown")
    for words, category in reversed(MESSAGE_RULES):
        out = F.when(_any_of(low, words), category).otherwise(out)
    return out


def error_class(code: Column, status: Column, message: Column) -> Column:
    """Category by error code, then text, then HTTP status."""
    m, c = F.coalesce(message, F.lit("")), F.coalesce(code, F.lit(""))
    return (
        F.when(c.isin("ENOTFOUND", "EAI_NODATA", "EAI_NONAME"), "dns_error").when(c.isin("ECONNREFUSED", "ECONNRESET", "ENETUNREACH"), "network_error")
        .when((c == "ETIMEDOUT") | m.contains("timeout"), "timeout_error").when(c.contains("CERT_") | m.contains("certificate") | m.contains("SSL"), "ssl_error")
        .when(c == "BLOCKED_BY_ROBOTS", "blocked_by_robots").when(status == 404, "http_404").when(status == 403, "http_403").when(status == 401, "http_401").when(status == 429, "rate_limit")
        .when((status == 503) & m.contains("cloudflare"), "anti_bot_challenge").when(status >= 500, "server_error").when(status >= 400, "client_error").otherwise("unknown")
    )


def error_categories(results: DataFrame, message: str = "error") -> DataFrame:
    """(category, n) of the failed rows, categories that don't occur with 0."""
    counts = results.filter(~F.coalesce("success", F.lit(False))).groupBy(error_category(F.col(message)).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    every = results.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return every.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def retry_candidates(results: DataFrame, message: str = "error") -> DataFrame:
    """Failed rows whose message speaks of neither 404, 403, 401, robots nor dns."""
    final = _any_of(F.lower(F.coalesce(F.col(message), F.lit(""))), ("404", "403", "401", "robots", "dns"))
    return results.filter(~F.coalesce("success", F.lit(False)) & ~final)


def error_patterns(errors: DataFrame, examples: int = 5) -> DataFrame:
    """(category, code, n, first_seen, last_seen, example_urls): by category and code with the first few URLs (ts, url)."""
    errors = errors.withColumn("code", F.coalesce(F.col("code").cast("string"), F.lit("unknown")))
    keys = ["category", "code"]
    totals = errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    nth = errors.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "url"))).filter(F.col("_n") <= examples)
    some = nth.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_n", "url"))).alias("_urls")).select(*keys, F.transform("_urls", lambda u: u["url"]).alias("example_urls"))
    return totals.join(some, keys)


#: Category, count above which it is reported, type, severity, advice.
ADVICE = (
    ("timeout", 3, "timeout", "high", "Multiple timeout errors detected. Consider increasing timeout or reducing concurrency."),
    ("network", 5, "network", "high", "Multiple network errors detected. Check network connectivity or target server availability."),
    ("rate_limit", 0, "rate_limit", "medium", "Rate limiting detected. Reduce request frequency."),
    ("server_error", 2, "server", "medium", "Target server returned many server errors. The server may be experiencing issues."),
)


def recommendations(counts: DataFrame) -> DataFrame:
    """(type, severity, message, n) of the categories (category, n) above their limits."""
    table = counts.sparkSession.createDataFrame(ADVICE, "category string, above int, type string, severity string, message string")
    return counts.join(F.broadcast(table), "category").filter("n > above").select("type", "severity", "message", "n")


def _log_columns(message: Column, host: Column) -> dict[str, Column]:
    """host, [NNN] status (null: none) and message of an error."""
    text = F.coalesce(message, F.lit(""))
    return {"host": F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown")), "status": F.nullif(F.regexp_extract(text, r"\[([0-9]+)\]", 1), F.lit("")), "message": text}


def _sets(df: DataFrame, sets: Sequence[Sequence[str]], **measures: Column) -> DataFrame:
    """df's measures by each of the sets, from one pass; `dims` names the set's columns, joined by a blank. Stored, since it is read often."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(*[m.alias(k) for k, m in measures.items()], *[F.grouping(c).alias(f"_{c}") for c in names])
    dims = F.concat_ws(" ", *[F.when(F.col(f"_{c}") == 0, c) for c in names])
    return stored(out.select(dims.alias("dims"), *names, *measures), "grouped")


def error_log_report(events: DataFrame) -> DataFrame:
    """(dim, value, n, pct): events by host, by [NNN] status in the message, by message and in total, from one scan."""
    rows = events.select(*[c.alias(k) for k, c in _log_columns(F.col("message"), F.col("host")).items()])
    counts = _sets(rows, [["host"], ["status"], ["message"], []], n=F.count(F.lit(1)))
    counts = counts.select(F.when(F.col("dims") == "", "total").otherwise(F.col("dims")).alias("dim"), F.when(F.col("dims") == "", "all").otherwise(F.coalesce("host", "status", "message")).alias("value"), "n").filter("value is not null")
    total = counts.filter("dim = 'total'").select(F.col("n").alias("_all"))  # one row
    return counts.join(F.broadcast(total)).select("dim", "value", "n", F.round(F.col("n") * 100.0 / F.col("_all"), 4).alias("pct"))


def time_window(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("total"))


def request_summary(events: DataFrame, by: str = "job_id") -> DataFrame:
    """Counters and response times per job; the median is the upper one. Error classes are a map of counts.

    One scan counts by job, by job and response time and by job and error class; the median's rank is found in the counts.
    """
    ok = F.coalesce("success", F.lit(False))
    rows = events.withColumns({"_ok": ok, "_ms": F.when(F.col("response_time_ms") != 0, F.col("response_time_ms"))}).withColumns({"ms": F.col("_ms"), "class": F.when(~F.col("_ok"), F.col("error_class"))})
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    counts = _sets(
        rows, [[by], [by, "ms"], [by, "class"]], total_requests=F.count(F.lit(1)), successful_requests=F.count_if("_ok"), failed_requests=F.count_if(~F.col("_ok")), canonicalized_requests=flag("canonicalized"),
        robots_blocked=flag("robots_blocked"), pagination_discovered=flag("pagination_discovered"), min_ms=F.min("_ms"), max_ms=F.max("_ms"), avg_ms=F.avg("_ms"),
    )
    main = counts.filter(F.col("dims") == by).drop("dims", "ms", "class")
    medians = upper_median(counts.filter(F.col("dims") == f"{by} ms"), [by], "ms", "total_requests").withColumnRenamed("ms", "median_ms")
    classes = counts.filter((F.col("dims") == f"{by} class") & F.col("class").isNotNull())
    maps = classes.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("class").alias("error_class"), F.col("total_requests").alias("n"))))).alias("error_classes"))
    return joined(joined(main, medians, [by]), maps, [by])


def url_pattern_stats(results: DataFrame, col: str = "url") -> DataFrame:
    """(pattern, total, successful, failed) by path with page numbers as *; with a column canonicalized also canonical_pct of the rows."""
    ok = F.coalesce("success", F.lit(False))
    rows = results.filter(U.is_url(F.col(col))).withColumn("pattern", U.page_pattern(U.path(F.col(col))))
    more = [F.round(F.count_if(F.coalesce("canonicalized", F.lit(False))) * 100.0 / F.count(F.lit(1)), 4).alias("canonical_pct")] if "canonicalized" in results.columns else []
    return rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), *more)


def most_common_error(results: DataFrame, col: str = "error") -> DataFrame:
    """(category, n): the most frequent one, ties by name; no failure: no row."""
    counts = results.filter(~F.coalesce("success", F.lit(False))).groupBy(error_category(F.col(col)).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "category").limit(1)


def errors_by_category(results: DataFrame, examples: int = 10) -> DataFrame:
    """(category, n, examples) of the failed rows of (url, success, error): how many, and the first URLs in order."""
    failed = results.filter(~F.coalesce("success", F.lit(False))).select(error_category(F.col("error")).alias("category"), "url")
    nth = failed.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy("url"))).filter(F.col("_n") <= examples)
    some = nth.groupBy("category").agg(F.sort_array(F.collect_list("url")).alias("examples"))
    return failed.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(some, "category")


def companies_per_success(results: DataFrame) -> DataFrame:
    """(urls, companies, average): companies found in all and for each successful URL of (success, n_companies)."""
    ok = F.coalesce("success", F.lit(False))
    n = F.coalesce(F.sum(F.when(ok, F.coalesce("n_companies", F.lit(0)))), F.lit(0))
    return results.agg(F.count_if(ok).alias("urls"), n.alias("companies"), F.coalesce(F.try_divide(n.cast("double"), F.count_if(ok)), F.lit(0.0)).alias("average"))


def companies_per_url(results: DataFrame) -> DataFrame:
    """(url, n_companies, has_contact, has_site) of (url, companies array<struct<name, contact, website>>)."""
    full = lambda f: F.exists("companies", lambda x: x[f].isNotNull() & (x[f] != ""))
    return results.select("url", F.coalesce(F.when(F.col("companies").isNotNull(), F.size("companies")), F.lit(0)).alias("n_companies"), F.coalesce(full("contact"), F.lit(False)).alias("has_contact"), F.coalesce(full("website"), F.lit(False)).alias("has_site"))


def ma_stats(results: DataFrame, by: Sequence[str] = (), least: int = 70) -> DataFrame:
    """Results, successes, deals found at `least` confidence or more, deals with a value."""
    ok = F.coalesce("success", F.lit(False))
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.count_if(ok & (F.col("confidence") >= least)).alias("ma_detected"),
        F.count_if(ok & F.col("deal_value").isNotNull()).alias("deals_with_value"),
    )


def ma_detected(df: DataFrame, min_conf: int = 0) -> DataFrame:
    return df.filter(F.coalesce("success", F.lit(False)) & (F.col("confidence") >= min_conf))


def session_stats(sessions: DataFrame) -> DataFrame:
    """Progress, rates and time left per session; zero where there is nothing to divide by."""
    done = F.col("successCount") + F.col("failureCount")
    seconds = (F.col("updatedAt") - F.col("createdAt")) / 1000.0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rate = zero(F.try_divide(done.cast("double"), seconds))
    return sessions.select(
        "id", "status", F.round(zero(F.try_divide(done * 100.0, F.col("totalUrls"))), 4).alias("progress"), F.round(rate, 4).alias("urls_per_second"),
        F.round(zero(F.try_divide(F.col("totalUrls") - done, rate)), 4).alias("eta_seconds"), F.round(zero(F.try_divide(seconds * 1000.0, done)), 4).alias("avg_ms"),
        F.round(zero(F.try_divide(F.col("successCount") * 100.0, done)), 4).alias("success_rate"),
    )


def retry_metrics(log: DataFrame, top: int = 5) -> DataFrame:
    """(error_type, retries, successes, success_rate) of the `top` most retried error types of (error_type, success)."""
    ok = F.count_if(F.coalesce("success", F.lit(False)))
    counts = log.groupBy("error_type").agg(F.count(F.lit(1)).alias("retries"), ok.alias("successes"), (ok * 100.0 / F.count(F.lit(1))).alias("success_rate"))
    return counts.orderBy(F.desc("retries"), "error_type").limit(top)


def keep_newest(sessions: DataFrame, n: int, now_ms: int) -> DataFrame:
    """The n sessions updated last among those complete or not yet expired; the global order is a top-k, not a sort."""
    alive = sessions.filter((F.col("status") == "completed") | (F.col("expiresAt") > now_ms))
    return alive.orderBy(F.desc("updatedAt"), "id").limit(n)


def progress(results: DataFrame, by: str, order: Sequence[str], total: str | None = None) -> DataFrame:
    """results with completed, errors and percent so far within each batch or session; a batch of any size is many tasks."""
    sums = {"completed": F.lit(1), "errors": F.when(F.coalesce("success", F.lit(False)), 0).otherwise(1)}
    out = running(results.drop(*({"completed", "errors", "percent"} - {total})), [by], order, sums)
    whole = F.col(total) if total else F.col("completed_total")
    return out.withColumn("percent", F.round(F.col("completed") * 100.0 / whole).cast("int")).drop("completed_total", "errors_total")


#: Error type, attempts, multiplier, first delay in ms, kind of delay.
STRATEGIES = (
    ("RATE_LIMITED", 5, 2.0, 5000, "exponential"), ("TIMEOUT", 3, 1.5, 2000, "linear"), ("ECONNRESET", 4, 2.0, 1000, "exponential"), ("ECONNREFUSED", 3, 2.0, 3000, "exponential"), ("ENOTFOUND", 1, 1.0, 1000, "fixed"),
    ("HTTP_404", 2, 1.0, 0, "immediate"), ("HTTP_403", 2, 1.0, 5000, "fixed"), ("HTTP_500", 3, 3.0, 10000, "exponential"), ("HTTP_502", 4, 2.0, 5000, "exponential"), ("HTTP_503", 5, 2.0, 10000, "exponential"),
    ("SSL_ERROR", 1, 1.0, 1000, "fixed"), ("DEFAULT", 2, 2.0, 2000, "exponential"),
)


def retry_type(code: Column, status: Column, message: Column) -> Column:
    c, m = F.coalesce(code, F.lit("")), F.coalesce(message, F.lit(""))
    return (
        F.when((c == "RATE_LIMITED") | ((c != "") & (status == 429)), "RATE_LIMITED").when(c.isin("ETIMEDOUT", "ESOCKETTIMEDOUT"), "TIMEOUT").when(c.isin("ECONNRESET", "ECONNREFUSED", "ENOTFOUND"), c)
        .when(c.startswith("SSL") | (c == "UNABLE_TO_VERIFY_LEAF_SIGNATURE"), "SSL_ERROR").when(status.isin(404, 403, 500, 502, 503), F.concat(F.lit("HTTP_"), status))
        .when(m.contains("timeout"), "TIMEOUT").when(m.contains("429"), "RATE_LIMITED").when(m.contains("ECONNRESET"), "ECONNRESET").otherwise("DEFAULT")
    )


def retry_schedule(failures: DataFrame, most_ms: int = 60_000) -> DataFrame:
    """failures (code, status, message, attempt from 1) with error_type, strategy, can_retry and delay_ms, without jitter."""
    table = failures.sparkSession.createDataFrame(STRATEGIES, "error_type string, max_retries int, factor double, first_ms long, strategy string")
    rows = failures.withColumn("error_type", retry_type(F.col("code"), F.col("status"), F.col("message"))).join(F.broadcast(table), "error_type")
    delay = (
        F.when(F.col("strategy") == "immediate", 0.0).when(F.col("strategy") == "fixed", F.col("first_ms").cast("double")).when(F.col("strategy") == "linear", (F.col("first_ms") * F.col("attempt")).cast("double"))
        .otherwise(F.col("first_ms") * F.pow("factor", F.col("attempt") - 1))
    )
    out = rows.withColumn("delay_ms", F.least(F.greatest(F.round(delay), F.lit(0.0)), F.lit(float(most_ms))).cast("long")).withColumn("can_retry", F.col("attempt") <= F.col("max_retries"))
    return out.drop("max_retries", "factor", "first_ms")


def crawl_report(results: DataFrame) -> DataFrame:
    """(section, key, n, value) of (url, success, skipped, response_time, error), all from one scan by grouping sets.

    Sections: summary; category, advice; error_pattern (category and [NNN] status of failed rows); pattern (URL patterns,
    value the failed ones); host, status, message (the failed rows' log, value in percent); time (least, most, mean and
    upper median); with a column n_companies also companies; with error_type also retry (value the success rate).
    """
    columns, good, bad = set(results.columns), F.col("ok"), ~F.col("ok")
    log = _log_columns(F.col("error"), U.host(F.col("url")))
    rows = results.select(
        F.coalesce("success", F.lit(False)).alias("ok"), (~F.coalesce("skipped", F.lit(False))).alias("done"), F.col("response_time").cast("double").alias("rt"), "url",
        *[c.alias(k) for k, c in log.items()], error_category(F.col("error")).alias("category"), *[F.col(c) if c in columns else F.lit(None).cast(t).alias(c) for c, t in (("n_companies", "long"), ("error_type", "string"))],
    )
    failed = {k: F.when(bad, F.col(k)) for k in ("category", "status", "host", "message")}
    rows = rows.withColumns({**failed, "pattern": F.when(U.is_url(F.col("url")), U.page_pattern(U.path(F.col("url")))), "time": F.col("rt")})
    optional = [["error_type"]] if "error_type" in columns else []
    one = _sets(
        rows, [[], ["category", "status"], ["host"], ["message"], ["pattern"], ["time"], *optional], n=F.count(F.lit(1)), good=F.count_if(good), bad=F.count_if(bad), processed=F.count_if("done"),
        successful=F.count_if(F.col("done") & good), lost=F.count_if(F.col("done") & bad), mean=F.avg("rt"), mean_good=F.avg(F.when(good, F.col("rt"))), least=F.min("rt"), most=F.max("rt"), companies=F.sum(F.when(good, F.coalesce("n_companies", F.lit(0)))),
    )
    of = lambda *dims: one.filter(F.col("dims") == " ".join(dims))
    pairs = lambda frame, items: frame.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in items])).alias("x")).select("x.*")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    n, none = F.col("n"), F.lit(None)
    counted = ("n", "good", "bad", "processed", "successful", "lost", "companies")
    whole = results.sparkSession.range(1).join(of(), how="left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counted})  # one row, also for no results
    parts: list[tuple[Column, DataFrame, Column, Column, Column]] = []
    add = lambda name, frame, key, count, value: parts.append((F.lit(name), frame, key, count, value))
    summary = (("total", n), ("processed", F.col("processed")), ("successful", F.col("successful")), ("failed", F.col("lost")), ("skipped", n - F.col("processed")), ("success_rate", share(F.col("successful") * 100.0, F.col("processed"))), ("avg_response_time", F.coalesce("mean", F.lit(0.0))), ("avg_success_time", F.coalesce("mean_good", F.lit(0.0))))
    add("summary", pairs(whole, summary), F.col("key"), none, F.col("value"))
    kinds = of("category", "status").filter("category is not null")
    by_kind = kinds.groupBy("category").agg(F.sum("n").alias("n"))
    every = results.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    add("category", every.join(by_kind, "category", "left"), F.col("category"), F.coalesce("n", F.lit(0)), none)
    add("error_pattern", kinds, F.concat_ws(" ", "category", F.coalesce("status", F.lit("unknown"))), n, none)
    add("advice", recommendations(by_kind), F.col("type"), n, none)
    add("pattern", of("pattern").filter("pattern is not null"), F.col("pattern"), n, F.col("bad"))
    median = upper_median(of("time"), [], "time", "n")
    add("time", pairs(whole, (("min", F.col("least")), ("max", F.col("most")), ("mean", F.col("mean")))), F.col("key"), none, F.col("value"))
    add("time", results.sparkSession.range(1).join(median, how="left"), F.lit("median"), none, F.col("time"))
    if "n_companies" in columns:
        add("companies", whole, F.lit("average"), F.col("companies"), share(F.col("companies"), F.col("good")))
    if optional:
        add("retry", of("error_type").filter("error_type is not null").orderBy(F.desc("n"), "error_type").limit(5), F.col("error_type"), n, F.col("good") * 100.0 / n)
    all_bad = whole.select(F.col("bad").alias("_all"))  # one row
    lines = of("host").filter("host is not null").select("dims", F.col("host").alias("key"), "n")
    lines = lines.union(of("message").filter("message is not null").select("dims", "message", "n")).union(kinds.filter("status is not null").groupBy("status").agg(F.sum("n").alias("n")).select(F.lit("status"), "status", "n"))
    parts.append((F.col("dims"), lines.join(F.broadcast(all_bad)), F.col("key"), n, F.round(n * 100.0 / F.col("_all"), 4)))
    return reduce(DataFrame.union, [frame.select(section.alias("section"), key.alias("key"), count.cast("long").alias("n"), value.cast("double").alias("value")) for section, frame, key, count, value in parts])

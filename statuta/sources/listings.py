"""Listings of portals to rows: tables of contents, query results, gazettes, registers, link pages, robots rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import text as tx

#: Kinds of acts that a register is asked for, and how ids of gazette items begin.
ACT_KINDS = ("LEGGE", "DECRETO-LEGGE", "DECRETO LEGISLATIVO")
GAZETTE_ITEM = "BOE-A-"
_BINDING = "struct<type:string,value:string>"


def toc(xml: DataFrame, column: str = "xml") -> DataFrame:
    """Items of an XML table of contents: title, link, abbreviation, external id. Items without a link are left out."""
    parts = xml.withColumn("_item", F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))))
    inside = lambda tag: tx.strip(F.regexp_extract("_item", rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    rows = parts.select(inside("title").alias("title"), inside("link").alias("link")).where("link <> ''")
    return rows.withColumns({"abbreviation": tx.abbreviation(F.col("title")), "external_id": tx.link_id(F.col("link"))})


def sparql_bindings(answers: DataFrame, names: list[str], column: str = "json", required: str = "celex", title: str = "title") -> DataFrame:
    """Bindings of SPARQL answers as columns; rows without the required one go, a missing title is that one."""
    shape = "struct<results:struct<bindings:array<struct<" + ",".join(f"{n}:{_BINDING}" for n in names) + ">>>>"
    rows = answers.select(F.explode(F.from_json(column, shape)["results"]["bindings"]).alias("b"))
    out = rows.select(*(F.col(f"b.{n}.value").alias(n) for n in names)).where(F.col(required).isNotNull())
    return out.withColumn(title, F.coalesce(title, required)) if title in names else out


def legislation(acts: DataFrame, language: str, kinds: list[str], since: Column) -> DataFrame:
    """The query of the listing itself: distinct acts of some kinds in a language from a day on, newest first."""
    return acts.where((F.col("language") == language) & F.col("kind").isin(kinds) & (F.col("date") >= since)).distinct().orderBy(F.desc("date"), "celex")


def pages(rows: int, size: int = 100) -> list[tuple[int, int]]:
    """Offset and limit of each page; input partitions of a listing whose length is known."""
    return [(at, min(size, rows - at)) for at in range(0, rows, size)]


def until_short(fetch: Callable[[int, int], list], size: int = 100) -> Iterator:
    """The rows of a listing whose length is not known: pages from an offset, until one has fewer rows than asked for."""
    at = 0
    while True:
        rows = fetch(at, size)
        yield from rows
        if len(rows) < size:
            return
        at += size


def requests(kinds: DataFrame, template: str, **columns: str) -> DataFrame:
    """An address for each row: {name} in the template is the row's column of that name, or the one given, escaped."""
    parts, at = [], 0
    for hit in re.finditer(r"\{(\w+)\}", template):
        parts += [F.lit(template[at : hit.start()]), F.url_encode(F.col(columns.get(hit[1], hit[1])).cast("string"))]
        at = hit.end()
    return kinds.withColumn("url", F.concat(*parts, F.lit(template[at:])))


def codes(answers: DataFrame, column: str = "json") -> DataFrame:
    """Codes of a register; those without an id go."""
    rows = answers.select(F.explode(F.from_json(column, "struct<codes:array<struct<id:string,titre:string>>>")["codes"]).alias("c"))
    return rows.select("c.id", F.col("c.titre").alias("title")).where("id is not null")


def acts(answers: DataFrame, column: str = "json") -> DataFrame:
    """Acts of a register, under either of the two names that it uses for the list; those without an id go."""
    item = "array<struct<id:string,titoloAtto:string>>"
    parsed = answers.withColumn("_p", F.from_json(column, f"struct<atti:{item},docs:{item}>"))
    rows = parsed.select(*[c for c in answers.columns if c != column], F.explode(F.coalesce("_p.atti", "_p.docs")).alias("a"))
    return rows.select("*", "a.id", F.col("a.titoloAtto").alias("title")).drop("a").where("id is not null")


def act_requests(spark) -> DataFrame:
    return spark.createDataFrame([(k,) for k in ACT_KINDS], "act_kind string")


def gazette_days(spark, last: str, days: int = 7) -> DataFrame:
    """The days of a gazette up to the last one."""
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last).cast("date"), days - 1), F.lit(last).cast("date"))).alias("day"))


def gazette_items(days: DataFrame, issues: DataFrame, prefix: str = GAZETTE_ITEM) -> DataFrame:
    """Ids of the items of each day's issue (day, xml) that begin as they should; a missing day has no items."""
    found = days.join(issues, "day").select("day", F.explode(F.xpath("xml", F.lit("//item/@id"))).alias("item"))
    return found.where(F.col("item").startswith(prefix))


def law_links(pages_: DataFrame, html: Column, keep: list[str]) -> DataFrame:
    """Links of all pages that hold one of some parts, each once, where it stood first."""
    from functools import reduce

    from statuta.functions.markup import hrefs

    rows = pages_.select("page", F.posexplode(hrefs(html)).alias("at", "link"))
    rows = rows.where(reduce(lambda a, b: a | b, (F.col("link").contains(k) for k in keep)))
    return rows.groupBy("link").agg(F.min(F.struct("page", "at")).alias("first")).select("link", "first.page", "first.at")


def disallowed(robots: DataFrame, column: str = "robots") -> DataFrame:
    """Path prefixes (host, prefix) that robots files (host, robots) forbid to every agent."""
    lines = robots.select("host", F.posexplode(F.transform(F.split(column, "\r?\n|\r"), lambda x: tx.strip(F.regexp_replace(x, "(?s)#.*$", "")))).alias("at", "line"))
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.when(F.lower("line").startswith("user-agent:"), tx.strip(F.substring_index("line", ":", -1)))
    rules = lines.withColumn("agent", F.last(agent, ignorenulls=True).over(w)).where((F.col("agent") == "*") & F.lower("line").startswith("disallow:"))
    return rules.select("host", tx.strip(F.regexp_extract("line", "(?i)^disallow:(.*)$", 1)).alias("prefix")).where("prefix <> ''")


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Addresses (host, path) that no prefix of their host forbids. Rules are joined by host, then compared."""
    return urls.join(rules.withColumnRenamed("host", "_host"), (urls["host"] == F.col("_host")) & urls["path"].startswith(F.col("prefix")), "left_anti")

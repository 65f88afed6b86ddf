"""Bounded breadth-first traversal of a link graph over a table of fetch results.

Seeds are taken in turn, and what one has visited the next leaves out. A seed is traversed level by level: a level's
URLs meet the fetch results in one join, and its order (the place of the parent, then the place of the link) is that of
a queue, so a cap on documents cuts where a queue would stop. Levels are written tables; nothing but counts reaches the
driver.

Defined results: a URL without a fetch result is skipped; so are blocked, failed and unsupported ones, and documents
without text; a seed whose URL cannot be crawled raises; without seeds the result is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import written
from ..functions.urls import is_pdf_url, normalize_absolute, normalized, site_of
from .html import extract_pages

AGENT = "loamwork"
_FOUND = "seed string, place long, url string, depth int, parent_url string, title string, markdown string, content_type string, child_links array<string>, pdf_links array<string>"


def utf8(column: str) -> Column:
    """The bytes as text; what is no UTF-8 is replaced."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def robots_rules(fetched: DataFrame) -> DataFrame:
    """(origin, robots): the robots.txt that hold; unreachable, failed and non-text ones rule nothing."""
    ok = fetched.filter(F.col("url").endswith("/robots.txt") & (F.col("url") == F.concat(origin(F.col("url")), F.lit("/robots.txt"))) & (F.col("status") < 400) & F.lower("content_type").contains("text"))
    return ok.groupBy(origin(F.col("url")).alias("origin")).agg(F.min(utf8("content")).alias("robots"))


@F.pandas_udf(T.BooleanType())
def _may_fetch(robots: pd.Series, url: pd.Series) -> pd.Series:
    parsed: dict[str, RobotFileParser] = {}
    out = []
    for rules, u in zip(robots, url, strict=True):
        if rules is None:
            out.append(True)
            continue
        if rules not in parsed:
            parsed[rules] = RobotFileParser()
            parsed[rules].parse(rules.splitlines())
        out.append(parsed[rules].can_fetch(AGENT, u))
    return pd.Series(out, dtype=bool)


def allowed(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """`urls(url, ...)` with `allowed`: robots.txt are joined by origin, parsed once a batch."""
    return urls.withColumn("origin", origin(F.col("url"))).join(robots, "origin", "left").withColumn("allowed", _may_fetch("robots", "url")).drop("origin", "robots")


def outcome(final: Column) -> Column:
    """What becomes of a fetch result with columns allowed, status, headers, content, content_type, and its final URL."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    challenge = F.coalesce(F.try_element_at("headers", F.lit("x-amzn-waf-action")) != "", F.lit(False)) | ((F.col("status") == 202) & (F.coalesce(F.length("content"), F.lit(0)) == 0))
    return (
        F.when(F.col("status").isNull(), "missing").when(~F.col("allowed"), "disallowed").when(challenge, "blocked")
        .when(F.col("status").isin(401, 403, 429), "blocked").when(F.col("status") >= 400, "failed")
        .when(kind.contains("pdf") | is_pdf_url(final), "pdf").when(kind.contains("html"), "html").otherwise("unsupported")
    )


def pages_of(fetched: DataFrame, pdfs: DataFrame | None = None, robots: bool | DataFrame = True, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Every fetch result that is a document, extracted: (url, final_url, title, markdown, content_type, child_links,
    pdf_links). `pdfs(url, title, markdown, child_links, pdf_links)` are PDF documents already extracted, by final URL.
    `robots`: the rules, or whether those among the results hold."""
    rules = robots_rules(fetched) if robots is True else robots
    a = fetched.withColumn("allowed", F.lit(True)) if rules is False else allowed(fetched, rules)
    a = a.withColumn("final", F.coalesce(normalize_absolute(F.col("final_url")), F.col("url")))
    a = a.withColumn("outcome", outcome(F.col("final"))).filter("outcome in ('html', 'pdf')")
    texts = a.filter("outcome = 'html'").select("url", "final", utf8("content").alias("html"))
    out = extract_pages(texts, ["url", "final"], "html", "final", suffixes)
    if pdfs is not None:
        p = pdfs.select(F.col("url").alias("final"), "title", "markdown", F.lit("pdf").alias("content_type"), "child_links", "pdf_links")
        out = out.unionByName(a.filter("outcome = 'pdf'").select("url", "final").join(p, "final").select(out.columns))
    return out.filter(F.col("markdown").rlike(r"\S"))


def children(found: DataFrame, start: str, follow: list[str], follow_pdfs: bool) -> DataFrame:
    """(url, place, parent_url): the links that a seed allows, pages before PDFs, in the order of a queue."""
    path = F.regexp_extract("link", r"^https?://[^/?#]*([^?#]*)", 1)
    prefixed = reduce(lambda a, b: a | b, [F.startswith(path, F.lit(p)) for p in follow], F.lit(False))
    same_site = site_of(F.col("link")) == site_of(F.lit(start))
    links = lambda kind, column, keep: found.select("place", F.col("url").alias("parent_url"), F.lit(kind).alias("kind"), F.posexplode(column).alias("pos", "link")).filter(keep)
    every = links(0, "child_links", prefixed).unionByName(links(1, "pdf_links", same_site & F.lit(follow_pdfs)))
    first = every.groupBy("link").agg(F.min(F.struct("place", "kind", "pos", "parent_url")).alias("at"))
    return first.select(F.col("link").alias("url"), "at.*")


def crawl(spark: SparkSession, seeds: list[dict], pages: DataFrame, extract: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The documents that `seeds` reach in `pages` (see `pages_of`): (seed, place, url, depth, parent_url, ...), place
    in order of discovery, all seeds numbered through. `seeds` are rows of the seeds table. With `extract`, `pages` are
    fetch results, and a level's are extracted when it reaches them, and no others."""
    visited = spark.createDataFrame([], "url string")
    everything = spark.createDataFrame([], _FOUND)
    count = 0
    for seed in seeds:
        start = normalized(seed["url"])
        if start is None:
            raise ValueError(f"not a URL that can be crawled: {seed['url']!r}")
        front = spark.createDataFrame([(start, 0, 0, 0, None)], "url string, place long, kind int, pos int, parent_url string")
        left = seed.get("max_pages", 20)
        for depth in range(seed.get("max_depth", 0) + 1):
            fresh = front.join(visited, "url", "left_anti")
            if extract is not None:
                fresh = written(fresh, "crawl_front")
            order = Window.orderBy("place", "kind", "pos")
            # a level holds the links of `max_pages` documents at most, so its order is made in one task
            here = pages if extract is None else extract(pages.join(fresh.select("url"), "url", "left_semi"))
            level = written(fresh.withColumn("n", F.row_number().over(order)).join(here, "url", "left"), "crawl_level")
            # a URL that an earlier document of the level was redirected to has been visited
            moved = level.filter("final is not null and final <> url").select(F.col("final").alias("to"), F.col("n").alias("by"))
            level = level.join(moved, (F.col("url") == F.col("to")) & (F.col("n") > F.col("by")), "left_anti")
            good = F.col("markdown").isNotNull()
            # only numbers go through one task, no texts
            running = F.sum(F.col("good").cast("int")).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
            counted = level.select("n", good.alias("good")).withColumn("before", F.coalesce(running, F.lit(0))).filter(F.col("before") < left).select("n", "before")
            taken = written(level.join(counted, "n"), "crawl_taken")
            visited = written(visited.union(taken.select("url")).union(taken.filter(good).select("final")).distinct(), "crawl_visited")
            found = taken.filter(good).select(
                F.lit(seed["name"]).alias("seed"), (F.lit(count) + F.col("before")).cast("long").alias("place"), F.col("final").alias("url"), F.lit(depth).alias("depth"),
                "parent_url", "title", "markdown", "content_type", "child_links", "pdf_links",
            )
            n = found.count()
            everything = everything.unionByName(found)
            count, left = count + n, left - n
            if not n or left <= 0:
                break
            front = children(found, start, list(seed.get("follow") or []), bool(seed.get("follow_pdfs", True)))
    return everything


def family(edges: DataFrame) -> DataFrame:
    """(doc_id, top): for every document of `edges(doc_id, parent)` the top of the tree it belongs to, which all of its
    family share; for those on or below a cycle, the least document of the cycle. A parent that is not in the table is
    none. Pointers to ancestors double, so a tree costs as many joins as its depth has binary digits."""
    nodes = written(edges.filter("doc_id is not null").groupBy("doc_id").agg(F.min("parent").alias("parent")), "family_edges")
    known = nodes.filter("parent is not null").join(nodes.select(F.col("doc_id").alias("parent")), "parent", "left_semi")
    rest = nodes.join(known.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(None).cast(nodes.schema["doc_id"].dataType).alias("up"), F.col("doc_id").alias("end"))
    # up: the ancestor 2^k steps above, null beyond the top; end: the last one before that; least: of all those passed
    state = written(known.select("doc_id", F.col("parent").alias("up"), F.col("parent").alias("end")).union(rest).withColumn("least", F.col("doc_id")), "family")
    total, reach = state.count(), 1
    while reach <= total and not state.filter("up is not null").isEmpty():
        above = state.select(F.col("doc_id").alias("up"), F.col("up").alias("higher"), F.col("end").alias("top"), F.col("least").alias("low"))
        climbed = state.filter("up is not null").join(above, "up").select("doc_id", F.col("higher").alias("up"), F.col("top").alias("end"), F.least("least", "low").alias("least"))
        state, reach = written(climbed.union(state.filter("up is null").select(climbed.columns)), "family"), 2 * reach
    tops = state.filter("up is null").select("doc_id", F.col("end").alias("top"))
    loops = state.filter("up is not null")  # `up` is on the cycle, and what it has passed is the whole of it
    return tops.union(loops.select("doc_id", "up").join(loops.select(F.col("doc_id").alias("up"), F.col("least").alias("top")), "up").select("doc_id", "top"))

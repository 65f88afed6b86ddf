"""PDF pages, as positioned lines and tables, to Markdown.

Decoding bytes needs a library and is pluggable (`sources.pdf`); everything after it is dataflow over `pdf_lines` and
`pdf_tables`: lines in a table's area go, short bold or large lines are headings, wrapped lines are joined again, list
items stay apart, and tables stand where they were on the page.

Defined results: null or blank lines carry no text; a page without gaps takes DEFAULT_GAP; a document without blocks has
no row; lines and tables that repeat are rendered again; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, joined_lines, markdown_table, stripped, tidy

# What begins a list item; limits of headings, in characters and points; the gap between paragraphs.
LIST_ITEM = r"(?U)^([0-9]{1,2}[.)]|[a-zA-Z][.)]|[ivxIVX]{1,4}[.)]|[•●▪◦\-–*])\s+"
MAX_HEADING, LARGER, GAP_FACTOR, DEFAULT_GAP, BODY_PAGES = 90, 1.5, 1.6, 6.0, 5


def body_size(lines: DataFrame) -> DataFrame:
    """(doc, body): the median size of the characters of the first pages."""
    weight = F.coalesce("n_chars", F.length("text"), F.lit(0)).cast("long")
    first = lines.filter((F.col("page") <= BODY_PAGES) & F.col("size").isNotNull() & (weight > 0))
    return first.groupBy("doc").agg(F.percentile("size", F.lit(0.5), weight).alias("body"))


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """The lines whose middle is in no table's area; the join is on document and page, the range a condition."""
    areas = tables.select(F.col("doc").alias("t_doc"), F.col("page").alias("t_page"), F.col("top").alias("t_top"), F.col("bottom").alias("t_bottom"))
    middle = (F.col("top") + F.col("bottom")) / 2
    return lines.join(areas, (F.col("doc") == F.col("t_doc")) & (F.col("page") == F.col("t_page")) & middle.between(F.col("t_top"), F.col("t_bottom")), "left_anti")


def is_heading(text: Column, size: Column, all_bold: Column, body: Column) -> Column:
    short = (F.length(text) <= MAX_HEADING) & ~text.rlike(r"[.,;:]\z")
    large = F.coalesce((body > 0) & (size >= body + LARGER), F.lit(False))
    return short & ~text.rlike(LIST_ITEM) & text.rlike(r"\p{L}") & (F.coalesce(all_bold, F.lit(False)) | large)


def text_blocks(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, page, top, nth, block): headings and paragraphs."""
    w = Window.partitionBy("doc", "page").orderBy("line")
    free = outside_tables(lines, tables).withColumn("step", F.lead("top").over(w) - F.col("bottom"))
    limits = free.filter("step > 0").groupBy("doc", "page").agg((F.median("step") * GAP_FACTOR).alias("limit"))
    a = free.withColumn("text", clean_text(F.col("text"))).filter("text <> ''").join(limits, ["doc", "page"], "left").join(body_size(lines), "doc", "left")
    a = a.withColumns({"gap": F.coalesce(F.col("top") - F.lag("bottom").over(w), F.lit(0.0)), "limit": F.coalesce("limit", F.lit(DEFAULT_GAP)), "heading": is_heading(F.col("text"), F.col("size"), F.col("all_bold"), F.col("body"))})
    before = F.lag("heading").over(w)
    apart = before.isNull() | (before != F.col("heading")) | (F.col("gap") > F.col("limit")) | (~F.col("heading") & F.col("text").rlike(LIST_ITEM))
    a = a.withColumn("new", apart.cast("int")).withColumn("nth", F.sum("new").over(w))
    g = a.groupBy("doc", "page", "nth", "heading").agg(F.array_sort(F.collect_list(F.struct("line", "text", "top"))).alias("x"))
    text = F.when(F.col("heading"), F.concat(F.lit("## "), F.array_join("x.text", " "))).otherwise(joined_lines(F.col("x.text")))
    return g.select("doc", "page", F.col("x")[0]["top"].alias("top"), F.col("nth").cast("int").alias("nth"), text.alias("block"))


def table_blocks(tables: DataFrame) -> DataFrame:
    """(doc, page, top, nth, block): tables; rows without a filled cell go."""
    filled = tables.withColumn("rows", F.filter("rows", lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != ""))).filter(F.size("rows") > 0)
    return filled.select("doc", "page", "top", F.lit(0).alias("nth"), markdown_table(F.col("rows")[0], F.slice("rows", 2, F.size("rows"))).alias("block"))


def pdf_markdown(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, markdown): blocks by page and place; where a table and a text begin alike, the table comes first."""
    every = text_blocks(lines, tables).unionByName(table_blocks(tables))
    g = every.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "top", "nth", "block"))).alias("x"))
    return g.select("doc", tidy(F.array_join("x.block", "\n\n")).alias("markdown"))


def plain_markdown(blocks: DataFrame) -> DataFrame:
    """(doc, markdown) out of `(doc, page, nth, text)`, plain blocks of text: what a fallback decoder gives."""
    g = blocks.withColumn("text", clean_text(F.col("text"))).filter("text <> ''").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "nth", "text"))).alias("x"))
    return g.select("doc", tidy(F.array_join("x.text", "\n\n")).alias("markdown"))


def pdf_pages(files: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """`files(doc, url, title, fallback_title)` with their Markdown, that of the fallback where the primary one is
    empty. The title is the file's, the fallback's, the first line's, or the last part of the URL."""
    a = files.join(primary.withColumnRenamed("markdown", "first_md"), "doc", "left").join(fallback.withColumnRenamed("markdown", "second_md"), "doc", "left")
    blank = lambda c: F.coalesce(stripped(F.col(c)) == "", F.lit(True))
    named = lambda c: F.when(clean_text(F.col(c)) != "", clean_text(F.col(c)))
    a = a.withColumn("markdown", F.when(blank("first_md"), F.coalesce("second_md", F.lit(""))).otherwise(F.col("first_md")))
    line = F.substring(stripped(F.regexp_replace(F.regexp_extract("markdown", r"(?m)^(.*\S.*)$", 1), "^[# ]+", "")), 1, 120)
    title = F.coalesce(named("title"), F.when(blank("first_md"), named("fallback_title")), F.when(line != "", line), F.substring_index("url", "/", -1))
    return a.select("doc", "url", title.alias("title"), "markdown", F.lit("pdf").alias("content_type"))

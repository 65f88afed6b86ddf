"""The engine's functions under names that SQL can call."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from ..operators.chunk import chunk_markdown
from ..operators.html import extract


class ChunkMarkdown:
    """SELECT d.id, c.* FROM documents d, LATERAL chunk_markdown(d.title, d.markdown) c"""

    def eval(self, title: str | None, markdown: str | None):
        for i, (text, context) in enumerate(chunk_markdown(markdown, title)):
            yield i, text, context


class ExtractHtml:
    """SELECT p.id, e.* FROM pages p, LATERAL extract_html(p.html, p.url) e"""

    def eval(self, html: str | None, url: str | None):
        got = extract(html, url)
        yield got["title"], got["markdown"], got["child_links"], got["pdf_links"]


def register(spark: SparkSession) -> None:
    """Registers normalize_url(url, base), chunk_markdown(title, markdown) and extract_html(html, url)."""
    spark.udf.register("normalize_url", normalize_url)
    spark.udtf.register("chunk_markdown", F.udtf(ChunkMarkdown, returnType="chunk_index int, chunk_text string, context_text string"))
    spark.udtf.register("extract_html", F.udtf(ExtractHtml, returnType="title string, markdown string, child_links array<string>, pdf_links array<string>"))

"""PDF files to positioned lines and tables, by a decoder that is passed in.

No PDF library is assumed. A decoder takes a file's bytes and gives a dictionary with `title`, `links`, `lines` (page,
line, top, bottom, text, size, all_bold, n_chars) and `tables` (page, top, bottom, rows). One that raises, or finds no
text, gives way to the fallback, whose lines are plain blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import written
from ..functions.urls import classified
from ..operators.pdf_layout import pdf_markdown, pdf_pages, plain_markdown

Decoder = Callable[[bytes], dict]
_LINES = "lines array<struct<page:int,line:int,top:double,bottom:double,text:string,size:double,all_bold:boolean,n_chars:int>>"
_TABLES = "tables array<struct<page:int,top:double,bottom:double,rows:array<array<string>>>>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, content) of the files under `path`."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("url"), "content")


def _decoded(files: DataFrame, decode: Decoder) -> DataFrame:
    fields = f"url string, title string, links array<string>, {_LINES}, {_TABLES}"
    types = {
        "lines": pa.list_(pa.struct([("page", pa.int32()), ("line", pa.int32()), ("top", pa.float64()), ("bottom", pa.float64()), ("text", pa.string()), ("size", pa.float64()), ("all_bold", pa.bool_()), ("n_chars", pa.int32())])),
        "tables": pa.list_(pa.struct([("page", pa.int32()), ("top", pa.float64()), ("bottom", pa.float64()), ("rows", pa.list_(pa.list_(pa.string())))])),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    got = decode(content or b"")
                except Exception:  # broken files raise all kinds of errors
                    got = {}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([url], pa.string()), pa.array([got.get("title")], pa.string()), pa.array([got.get("links") or []], pa.list_(pa.string())), *(pa.array([got.get(k) or []], types[k]) for k in ("lines", "tables"))],
                    names=["url", "title", "links", "lines", "tables"],
                )

    return files.select("url", "content").mapInArrow(run, fields)


@F.udf(T.StructType([T.StructField("child_links", T.ArrayType(T.StringType())), T.StructField("pdf_links", T.ArrayType(T.StringType()))]), useArrow=True)
def _links(hrefs, url):
    pages, pdfs = classified(hrefs or [], url)
    return {"child_links": pages, "pdf_links": pdfs}


def extract_pdfs(files: DataFrame, primary: Decoder, fallback: Decoder) -> DataFrame:
    """`files(url, content)` to (url, title, markdown, content_type, child_links, pdf_links). Each decoder runs once a
    file; its output is written before it is taken apart."""
    first = written(_decoded(files, primary), "pdf_first")
    line = lambda d, column: d.select(F.col("url").alias("doc"), F.explode(column).alias("x")).select("doc", "x.*")
    made = written(pdf_markdown(line(first, "lines"), line(first, "tables")), "pdf_markdown")
    failed = files.join(made.filter(F.col("markdown").rlike(r"\S")).select(F.col("doc").alias("url")), "url", "left_anti")
    second = written(_decoded(failed, fallback), "pdf_second")
    plain = plain_markdown(line(second, "lines").select("doc", "page", F.col("line").alias("nth"), "text"))
    info = first.select(F.col("url").alias("doc"), "url", "title", F.col("links").alias("first_links"))
    info = info.join(second.select(F.col("url").alias("doc"), F.col("title").alias("fallback_title"), F.col("links").alias("second_links")), "doc", "left")
    pages = pdf_pages(info, made, plain)
    links = info.select("doc", _links(F.coalesce("second_links", "first_links"), F.col("url")).alias("l"))
    return pages.join(links, "doc").select("url", "title", "markdown", "content_type", "l.child_links", "l.pdf_links")

"""Fetch results: the table that a crawl reads, and a fetcher that fills it.

A crawl never talks to the network; it reads `fetch_results`. `fetch_urls` fills that table with any callable, once a
URL, from the tasks that hold the URLs, one client for each task.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SCHEMAS

AGENT, TIMEOUT, DELAY = "loamwork/1", 30.0, 1.0
Fetched = tuple[str, int, str, bytes, dict[str, str]]


def http_fetcher(timeout: float = TIMEOUT, delay: float = DELAY) -> Callable[[str], Fetched | None]:
    """GET with redirects followed: (final URL, status, content type, content, headers with lower-case names), or None
    if the host cannot be reached. Waits `delay` seconds between requests of one client."""
    last = [0.0]

    def fetch(url: str) -> Fetched | None:
        time.sleep(max(0.0, last[0] + delay - time.monotonic()))
        last[0] = time.monotonic()
        try:
            with urlopen(Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as r:
                headers = {k.lower(): v for k, v in r.headers.items()}
                return r.geturl(), r.status, headers.get("content-type", ""), r.read(), headers
        except HTTPError as e:
            headers = {k.lower(): v for k, v in e.headers.items()}
            return e.geturl() or url, e.code, headers.get("content-type", ""), e.read(), headers
        except (URLError, OSError):
            return None

    return fetch


def fetch_urls(urls: DataFrame, make: Callable[[], Callable[[str], Fetched | None]] = http_fetcher) -> DataFrame:
    """`urls(url)` to rows of fetch_results; URLs are dealt out by origin, so one task is polite to one host. A URL that
    cannot be reached has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = make()
        for b in batches:
            for url in b.column(0).to_pylist():
                got = fetch(url)
                if got is not None:
                    final, status, kind, content, headers = got
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([url], pa.string()), pa.array([final], pa.string()), pa.array([status], pa.int32()), pa.array([kind], pa.string()), pa.array([content], pa.binary()), pa.array([list(headers.items())], pa.map_(pa.string(), pa.string()))],
                        names=["url", "final_url", "status", "content_type", "content", "headers"],
                    )

    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    return urls.filter("url is not null").select("url").distinct().repartition(origin).mapInArrow(run, SCHEMAS["fetch_results"])

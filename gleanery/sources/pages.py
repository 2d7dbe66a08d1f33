"""Page sources: tables, folders of html files, and conditional downloads on the executors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.config import FetchSettings

PAGE_COLUMNS = "url string, html string, etag string, last_modified string, status int, fetched_at double"


def html_files(spark: SparkSession, folder: str, glob: str = "*.html") -> DataFrame:
    """One page per file; the path is its url."""
    files = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def as_pages(df: DataFrame) -> DataFrame:
    """Adds the fetch columns a source does not have."""
    defaults = {
        "etag": F.lit(None).cast("string"),
        "last_modified": F.lit(None).cast("string"),
        "status": F.when(F.col("html").isNotNull(), F.lit(200)),
        "fetched_at": F.unix_micros(F.current_timestamp()) / F.lit(1e6),
    }
    missing = {name: value for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def download(
    url: str, etag: str | None, last_modified: str | None, settings: FetchSettings = FetchSettings(),
    opener: Callable = urlopen, sleep: Callable[[float], None] = time.sleep,
) -> dict:
    """One conditional GET with linear back-off. status 304 means unchanged; a null status means that
    every attempt failed."""
    headers = {"User-Agent": settings.user_agent}
    if etag:
        headers["If-None-Match"] = etag
    if last_modified:
        headers["If-Modified-Since"] = last_modified
    row = {"url": url, "html": None, "etag": None, "last_modified": None, "status": None}
    for attempt in range(1, settings.max_attempts + 1):
        try:
            with opener(Request(url, headers=headers), timeout=settings.timeout_seconds) as reply:
                charset = reply.headers.get_content_charset() or "utf-8"
                row.update(
                    html=reply.read().decode(charset, errors="replace"), status=reply.status,
                    etag=reply.headers.get("ETag"), last_modified=reply.headers.get("Last-Modified"),
                )
            break
        except HTTPError as reply:
            if reply.code == 304:
                row["status"] = 304
                break
        except (URLError, OSError, ValueError, LookupError):
            pass
        if attempt < settings.max_attempts:
            sleep(settings.retry_delay_seconds * attempt)
    return {**row, "fetched_at": time.time()}


def fetch_pages(
    urls: DataFrame, state: DataFrame | None = None, settings: FetchSettings = FetchSettings(),
    opener: Callable = urlopen, tasks: int | None = None,
) -> DataFrame:
    """Downloads every url, sending the stored etag and modification date where `state` has them.

    Waiting dominates, so urls are spread over `tasks` partitions (by default one per core).
    """
    asked = urls.select("url").distinct()
    if state is None:
        asked = asked.withColumns({"etag": F.lit(None).cast("string"), "last_modified": F.lit(None).cast("string")})
    else:
        asked = asked.join(state.select("url", "etag", "last_modified"), "url", "left")
    asked = asked.repartition(tasks or urls.sparkSession.sparkContext.defaultParallelism, "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"status": pa.int32(), "fetched_at": pa.float64()}
        names = ["url", "html", "etag", "last_modified", "status", "fetched_at"]
        schema = pa.schema([(n, types.get(n, pa.string())) for n in names])
        for batch in batches:
            for row in batch.to_pylist():
                page = download(row["url"], row["etag"], row["last_modified"], settings, opener)
                yield pa.RecordBatch.from_pylist([page], schema=schema)

    return asked.mapInArrow(run, PAGE_COLUMNS)

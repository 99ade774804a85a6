"""A change feed: pages of items, followed by link until a cursor is left."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

ITEMS = "id string, name string, parent_path string, is_folder boolean, deleted boolean, size long, ctag string, etag string, web_url string, modified timestamp"
PAGES = f"items array<struct<{ITEMS.replace(' ', ': ').replace(',: ', ', ')}>>, next_link string, delta_link string"
RETRIES = 4


class CursorExpired(Exception):
    """The feed does not know the cursor any more: everything has to be read again."""


def pages(fetch: Callable[[str | None], tuple[int, dict, dict]], cursor: str | None, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Pages from a cursor on.  `fetch(link)` gives (status, headers, body).

    Throttling and server errors are tried again, after the time they name or
    growing pauses; a status of 410 means the cursor is gone.
    """
    link = cursor
    while True:
        for attempt in range(RETRIES + 1):
            status, headers, body = fetch(link)
            if status == 410:
                raise CursorExpired(link)
            if status < 400:
                break
            if status != 429 and status < 500 or attempt == RETRIES:
                raise OSError(f"the feed answered {status}")
            sleep(float(headers.get("retry-after", 2**attempt)))
        yield body
        link = body.get("next_link")
        if not link:
            return


def read_pages(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Stored pages as rows of items, batch or stream."""
    reader = (spark.readStream if streaming else spark.read).schema(PAGES)
    return reader.json(path).selectExpr("inline(items)")

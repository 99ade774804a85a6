"""A change feed as a streaming source whose offset is the feed's cursor.

The driver follows links only: a micro-batch is a few cursors.  Tasks fetch the
pages behind them, a page of many pieces in shares.  A feed that does not know a cursor any more begins anew
under the next epoch; when its end is reached for the first time in an epoch, a
row of kind `end` says so, and what was not seen since can be swept.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructType, _parse_datatype_string

from tessera.sources.changefeed import CursorExpired

LINKS = "epoch int, kind string, cursor string"
PAGE, END = "page", "end"


class Feed(Protocol):
    """What a feed is made of; built from one address, on the driver and in tasks."""

    def after(self, cursor: str | None) -> str | None:
        """The cursor behind the page at a cursor (None: the first page), or None where there is no such page yet; CursorExpired where the feed has forgotten it."""

    def items(self, cursor: str | None) -> Iterator[pa.RecordBatch]:
        """The page's items."""

    # A feed may have share(cursor, number, of) too: the pieces of a page that fall to one of so many tasks.  Without it one task takes a page.


class StoredFeed:
    """Pages in Parquet folders page=<n> below a folder that pyarrow can open; pages below the number in the name of a file oldest=<n> are forgotten."""

    def __init__(self, at: str) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(at)

    def _numbers(self) -> tuple[int, list[int]]:
        found = [i.base_name.split("=") for i in self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))]
        oldest = max((int(n[1]) for n in found if n[0] == "oldest"), default=0)
        return oldest, sorted(int(n[1]) for n in found if n[0] == "page" and int(n[1]) >= oldest)

    def _page(self, cursor: str | None) -> int | None:
        oldest, pages = self._numbers()
        if cursor is not None and int(cursor) < oldest:
            raise CursorExpired(cursor)
        return next((n for n in pages if n >= int(cursor or 0)), None)

    def after(self, cursor: str | None) -> str | None:
        page = self._page(cursor)
        return None if page is None else str(page + 1)

    def items(self, cursor: str | None) -> Iterator[pa.RecordBatch]:
        return self.share(cursor, 0, 1)

    def share(self, cursor: str | None, number: int, of: int) -> Iterator[pa.RecordBatch]:
        """Every of-th row group of the page, from that of the number on."""
        stored = pads.dataset(f"{self.root}/page={self._page(cursor)}", filesystem=self.fs, format="parquet", exclude_invalid_files=False)
        pieces = [g for f in sorted(stored.get_fragments(), key=lambda f: f.path) for g in f.split_by_row_group()]
        for piece in pieces[number::of]:
            yield from piece.to_batches(schema=stored.schema)


def open_feed(kind: str, at: str) -> Feed:
    """The feed of a class named as package.module:Class."""
    module, _, name = kind.partition(":")
    return getattr(importlib.import_module(module), name)(at)


class LinkReader(SimpleDataSourceStreamReader):
    """Offsets are {epoch, cursor, whole}: where to go on, and whether the end of this epoch was already told."""

    def __init__(self, options: dict[str, str]) -> None:
        self.feed = open_feed(options["feed"], options["at"])
        self.most = int(options.get("pages", "16"))

    def initialOffset(self) -> dict:
        return {"epoch": 0, "cursor": None, "whole": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], dict(start)
        while len(rows) < self.most:
            try:
                behind = self.feed.after(at["cursor"])
            except CursorExpired:
                # Rows of an epoch never share a batch with those of another.
                return iter(rows), at if rows else {"epoch": at["epoch"] + 1, "cursor": None, "whole": False}
            if behind is None:
                if not at["whole"] and at["cursor"] is not None:
                    rows.append((at["epoch"], END, at["cursor"]))
                    at["whole"] = True
                break
            rows.append((at["epoch"], PAGE, at["cursor"]))
            at["cursor"] = behind
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same links again, after a failure."""
        at = dict(start)
        if at["epoch"] != end["epoch"]:
            return
        while at["cursor"] != end["cursor"]:
            yield at["epoch"], PAGE, at["cursor"]
            at["cursor"] = self.feed.after(at["cursor"])
        if end["whole"] and not at["whole"]:
            yield at["epoch"], END, at["cursor"]


class ChangeFeed(DataSource):
    """format("changefeed") with options feed (package.module:Class), at (its address) and pages (most a batch)."""

    @classmethod
    def name(cls) -> str:
        return "changefeed"

    def schema(self) -> str:
        return LINKS

    def simpleStreamReader(self, schema: StructType) -> LinkReader:
        return LinkReader(dict(self.options))


def changes(spark: SparkSession, at: str, schema: str, feed: str = f"{__name__}:StoredFeed", pages_per_batch: int = 16) -> DataFrame:
    """A stream of the feed's items (schema) with epoch and kind; rows of kind `end` have no item."""
    spark.dataSource.register(ChangeFeed)
    links = spark.readStream.format("changefeed").option("feed", feed).option("at", at).option("pages", pages_per_batch).load()
    items = _parse_datatype_string(schema)
    out = StructType([*items.fields]).add("epoch", IntegerType()).add("kind", StringType())
    arrow = to_arrow_schema(items)
    # As many shares of a page as leave no core without one.
    shares = -(-spark.sparkContext.defaultParallelism // pages_per_batch)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = None
        for batch in batches:
            for link in batch.to_pylist():
                if link["kind"] == END:
                    page = pa.Table.from_pylist([dict.fromkeys(arrow.names)], arrow)
                    yield from _told(page, link).to_batches()
                    continue
                source = source or open_feed(feed, at)
                for found in fetched(source, link["cursor"], link["share"], shares):
                    page = pa.Table.from_batches([found]).select(arrow.names).cast(arrow)
                    yield from _told(page, link).to_batches()

    def _told(page: pa.Table, link: dict) -> pa.Table:
        n = page.num_rows
        return page.append_column("epoch", pa.array([link["epoch"]] * n, pa.int32())).append_column("kind", pa.array([link["kind"]] * n, pa.string()))

    # The links come in one partition; the shares of their pages are dealt out.
    each = F.explode(F.when(F.col("kind") == PAGE, F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(F.lit(0))))
    return links.withColumn("share", each).repartition(pages_per_batch * shares).mapInArrow(fetch, out)


def fetched(source: Feed, cursor: str | None, share: int, of: int) -> Iterator[pa.RecordBatch]:
    """A share of a page's items; the first has all where the feed does not tell pieces apart."""
    if hasattr(source, "share"):
        return source.share(cursor, share, of)
    return iter(()) if share else source.items(cursor)

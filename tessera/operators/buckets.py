"""Tables that change by buckets: a batch rewrites the buckets that it touches, and one commit publishes all tables.

A row's bucket follows from its key, so a change needs only the rows of its own
bucket.  What a bucket holds lies in a folder that is never written again; a
commit is one small file that says for every table which folder holds which
bucket, published under the next number by an atomic rename.  Readers see the
tables of one commit, also while the next is made.  A commit keeps the number
of the batch that it came from: a batch that is delivered again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.commits import CommitLog
from tessera.sources.shared import names, remove

LOG = "_commits"
COMMIT = "version long, writer string, batch long, changed array<struct<table: string, bucket: int, folder: string>>"


@dataclass(frozen=True)
class Table:
    schema: str
    key: tuple[str, ...]
    buckets: int = 16

    def bucket(self) -> Column:
        """0 to buckets - 1, by the key's columns as text."""
        text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in self.key])
        return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % self.buckets).cast("int")


@dataclass(frozen=True)
class Commit:
    """Which folder holds each bucket of each table, and how far each writer's batches have come."""

    version: int = 0
    folders: dict[str, dict[int, str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


#: What becomes of a table: rows with the keys it is about, and the rows of their buckets anew.
Rewrite = tuple[DataFrame, Callable[[DataFrame], DataFrame]]


class BucketStore:
    """Tables below a folder that all writers and readers share."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]) -> None:
        self.spark, self.root, self.tables = spark, root, tables
        self.log = CommitLog(spark, f"{root}/{LOG}")

    def versions(self) -> list[int]:
        return self.log.versions()

    def commit_of(self, version: int | None = None) -> Commit:
        """The last commit, or an earlier one."""
        raw = self.log.read(version)
        return Commit(raw["version"], {t: {int(b): f for b, f in own.items()} for t, own in raw["folders"].items()}, raw["batches"]) if raw else Commit()

    def rows(self, table: str, buckets: list[int] | None = None, at: Commit | None = None) -> DataFrame:
        """A table's rows, or those of some buckets."""
        folders = (at or self.commit_of()).folders.get(table, {})
        paths = [f"{self.root}/{table}/{f}/bucket={b}" for b, f in sorted(folders.items()) if buckets is None or b in buckets]
        schema = self.tables[table].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, rewrites: dict[str, Rewrite], batch: int | None = None, writer: str = "") -> Commit:
        """Rewrites the buckets of all tables that the keys fall into, and publishes them at once.

        Another writer's commit in between is an error; the batch is then to be
        delivered again.
        """
        old = self.commit_of()
        if batch is not None and old.batches.get(writer, -1) >= batch:
            return old
        folders, changed = {t: dict(own) for t, own in old.folders.items()}, []
        for name, (keys, make) in rewrites.items():
            table, own = self.tables[name], folders.setdefault(name, {})
            # At most as many numbers as there are buckets.
            touched = sorted(r[0] for r in keys.select(table.bucket()).distinct().collect())
            if not touched:
                continue
            columns = self.spark.createDataFrame([], table.schema).columns
            folder = f"v{old.version + 1}-{uuid.uuid4().hex[:12]}"
            new = make(self.rows(name, touched, old)).select(*columns).withColumn("bucket", table.bucket())
            # A bucket is one task's, which writes one file for it; small ones too are not written one after another.
            tasks = min(len(touched), 4 * self.spark.sparkContext.defaultParallelism)
            new.repartitionById(tasks, F.col("bucket") % tasks).write.partitionBy("bucket").parquet(f"{self.root}/{name}/{folder}")
            filled = {int(n.split("=")[1]) for n in names(self.spark, f"{self.root}/{name}/{folder}") if n.startswith("bucket=")}
            for b in touched:
                own.pop(b, None)
                if b in filled:
                    own[b] = folder
                changed.append({"table": name, "bucket": b, "folder": folder if b in filled else None})
        new = Commit(old.version + 1, folders, old.batches | ({} if batch is None else {writer: batch}))
        self.log.publish({"version": new.version, "writer": writer, "batch": batch, "changed": changed, "folders": folders, "batches": new.batches})
        return new

    def history(self) -> DataFrame:
        """version, writer, batch, table, bucket, folder of every bucket that a kept commit has rewritten."""
        if not self.versions():
            return self.spark.createDataFrame([], COMMIT).selectExpr("version", "writer", "batch", "inline(changed)")
        return self.spark.read.schema(COMMIT).json(f"{self.root}/{LOG}/*.json").selectExpr("version", "writer", "batch", "inline(changed)")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the last commits and the folders that only the others name; readers of those fail."""
        versions = self.versions()
        kept = [self.commit_of(v) for v in versions[-keep:]]
        gone = []
        for name in self.tables:
            used = {f for c in kept for f in c.folders.get(name, {}).values()}
            gone += [f"{self.root}/{name}/{f}" for f in names(self.spark, f"{self.root}/{name}") if f not in used]
        for path in gone:
            remove(self.spark, path)
        self.log.forget(versions[:-keep])
        return gone


def newest(changes: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last change of each key, added up before any shuffle, so that a key with most of the changes costs no more than others."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), F.struct(*order)).alias("__last"))
    return last.select("__last.*")

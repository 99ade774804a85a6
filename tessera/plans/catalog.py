"""What exists: values, datasets, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.filters import dataset_period
from tessera.plans.plan import Catalog, DatasetEntry


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """Values of a column that are not null, in order."""
    return rows.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def latest_per(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The row of each key that is last by `order`, nulls least."""
    window = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.col(tie).desc())
    return rows.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def dataset_summary(documents: DataFrame, datasets: DataFrame) -> DataFrame:
    """name, department, from, to, files, columns of each dataset; columns are those of its newest sheet."""
    summary = documents.filter("status = 'indexed' and dataset is not null").groupBy(F.col("dataset").alias("name")).agg(
        F.min("department").alias("department"), F.min("period_start").alias("from"), F.max("period_end").alias("to"), F.count("*").alias("files")
    )
    newest = latest_per(datasets, "dataset", "period_end", "id").select(F.col("dataset").alias("name"), "columns")
    return summary.join(newest, "name", "left").orderBy("name")


def load_catalog(documents: DataFrame, datasets: DataFrame) -> Catalog:
    """A snapshot for the driver: distinct names, not rows of data."""
    indexed = documents.filter("status = 'indexed'")
    values = lambda c: tuple(r[0] for r in distinct_values(indexed, c).collect())
    entries = tuple(
        DatasetEntry(r["name"], r["department"], str(r["from"]) if r["from"] else None, str(r["to"]) if r["to"] else None, r["files"], {c["name"]: c["type"] for c in r["columns"]} if r["columns"] is not None else None)
        for r in dataset_summary(documents, datasets).collect()
    )
    return Catalog(values("hotel"), values("department"), values("file_type"), entries)


def list_datasets(datasets: DataFrame, documents: DataFrame, *, hotel: str | None = None, dataset: str | None = None, start: str | None = None, end: str | None = None, most: int = 200) -> DataFrame:
    """Datasets with their files' names, oldest first; a listing shows at most `most`."""
    for name, value in (("hotel", hotel), ("dataset", dataset)):
        if value is not None:
            datasets = datasets.filter(F.lower(name) == value.lower())
    named = documents.select(F.col("id").alias("document_id"), F.col("name").alias("file"), "web_url")
    return datasets.filter(dataset_period(start, end)).join(named, "document_id").orderBy("period_start", "id").limit(most)


def status_counts(documents: DataFrame, key: str = "source_id", status: str = "status", values: list[str] | None = None) -> DataFrame:
    """Counts by status, one column a status."""
    return documents.groupBy(key).pivot(status, values).count() if values else documents.groupBy(key, status).count()


def source_overview(sources: DataFrame, documents: DataFrame, state: DataFrame) -> DataFrame:
    """Sources with their counts by status as a map and their sync state; those without either stay."""
    counts = documents.groupBy("source_id", "status").count().groupBy("source_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "count")))).alias("counts"))
    return sources.join(counts, sources["id"] == counts["source_id"], "left").drop("source_id").join(state, sources["id"] == state["source_id"], "left").drop("source_id")


def reconcile(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """source_id, expected, indexed where the counts of a source and of its documents differ."""
    indexed = documents.filter("status = 'indexed'").groupBy("source_id").agg(F.count("*").alias("indexed"))
    both = sources.select(F.col("id").alias("source_id"), "expected").join(indexed, "source_id", "full")
    return both.select("source_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("indexed", F.lit(0)).alias("indexed")).filter("expected != indexed")


def trailing_percentile(log: DataFrame, at: str, value: str, *, percent: float = 0.95, interval: str = "5 minutes", user: str = "user_name", without: str = "eval") -> DataFrame:
    """The percentile of a value over the last stretch before the newest row; 0 without rows."""
    newest = log.agg((F.max(at) - F.expr(f"interval {interval}")).alias("since"))
    recent = log.join(F.broadcast(newest), F.col(at) > F.col("since")).filter(~F.col(user).eqNullSafe(F.lit(without)))
    return recent.agg(F.coalesce(F.expr(f"percentile_cont({percent}) WITHIN GROUP (ORDER BY `{value}`)"), F.lit(0.0)).alias("p"))

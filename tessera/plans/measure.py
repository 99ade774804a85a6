"""Templated aggregates over tidy files, with coverage of the months asked for."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dates import months_between, months_of, period_display
from tessera.functions.numbers import round_half_up
from tessera.plans.filters import Layout, Node, between_any, compile_filter, contains_pattern
from tessera.plans.plan import Measure, Plan

AGGREGATE = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
BUCKET = {
    "year": lambda c: F.year(c),
    "month": lambda c: F.date_format(c, "yyyy-MM"),
    "day": lambda c: F.date_format(c, "yyyy-MM-dd"),
    "week": lambda c: F.date_format(F.date_trunc("week", c), "yyyy-MM-dd"),
}


def aggregate(rows: DataFrame, agg: str, value: str | Column | None = None, *, date: str | None = None, group_by: str | None = None, periods: list[tuple[str, str]] = (), where_text: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """[group,] value, rows.

    count counts rows whatever the field.  Groups and periods apply where there
    is a date.  Without rows there is no result row.  Values are rounded to two
    places, halves upwards.
    """
    if date:
        rows = rows.filter(between_any(F.col(date).cast("date"), list(periods)))
    for column, needle in where_text:
        rows = rows.filter(contains_pattern(column, needle))
    value = F.col(value) if isinstance(value, str) else value
    out = F.count("*").cast("double") if agg == "count" else AGGREGATE[agg](value).cast("double")
    keys = [BUCKET[group_by](F.col(date)).alias(group_by)] if date and group_by else []
    grouped = rows.groupBy(*keys).agg(round_half_up(out).alias("value"), F.count("*").alias("rows")).filter("rows > 0")
    return grouped.orderBy(group_by) if keys else grouped


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows under all names; missing columns are null, numbers of different width are widened."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_tidy(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Tidy files of one dataset.  Files of one schema are one scan; which have one is read from their footers in tasks."""
    return union_by_name([spark.read.parquet(*group) for group in by_schema(spark, paths)])


def by_schema(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """The paths in groups of one schema, each group and the groups in the order of their first path."""
    if len(paths) < 2:
        return [paths] if paths else []
    try:
        FileSystem.from_uri(paths[0])
    except (pa.ArrowInvalid, OSError):  # a store that only Spark opens
        alike: dict[str, list[str]] = {}
        for path in paths:
            alike.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
        return list(alike.values())

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                fs, at = FileSystem.from_uri(path)
                found.append(pads.dataset(at, filesystem=fs, format="parquet").schema.remove_metadata().to_string(show_field_metadata=False))
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("path"), pa.array(found, pa.string())], ["n", "path", "schema"])

    listed = spark.createDataFrame(list(enumerate(paths)), "n long, path string").repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4)))
    alike = listed.mapInArrow(footers, "n long, path string, schema string").groupBy("schema").agg(F.sort_array(F.collect_list(F.struct("n", "path"))).alias("files"))
    return [[f["path"] for f in r["files"]] for r in alike.orderBy(F.get("files", 0)["n"]).collect()]  # a row a schema, the paths that were given


def matching_files(datasets: DataFrame, documents: DataFrame, dataset: str, where: Node) -> DataFrame:
    """The registry's files of a dataset that the filter lets through, oldest first: pruning before any scan."""
    hit = datasets.filter((F.lower("dataset") == dataset.lower()) & compile_filter(where, Layout()))
    named = documents.select(F.col("id").alias("document_id"), "name", "web_url")
    return hit.join(named, "document_id").orderBy("period_start", "id")


def present_months(files: DataFrame) -> DataFrame:
    """The months of each file's period; a month comes as often as files have it."""
    return files.select(F.explode(months_of("period_start", F.coalesce("period_end", "period_start"))).alias("month"))


def coverage(spark: SparkSession, periods: list[tuple[str, str]], present: DataFrame) -> DataFrame:
    """month, present of each month asked for, in order: one set of those that are there, and a look into it for each."""
    asked = sorted({m for a, b in periods for m in months_between(a, b)})
    # At most the months asked for.
    there = present.filter(F.col("month").isin(asked)).agg(F.collect_set("month").alias("there"))
    return there.select(F.explode(F.array(*[F.lit(m) for m in asked]).cast("array<string>")).alias("month"), "there").select("month", F.array_contains("there", F.col("month")).alias("present"))


def run_measure(spark: SparkSession, datasets: DataFrame, documents: DataFrame, plan: Plan) -> tuple[DataFrame | None, list[dict], list[str]]:
    """(rows, sources, missing months) of a plan's measure; the registry's rows are few, one for each sheet that matches."""
    m: Measure = plan.measure
    files = matching_files(datasets, documents, m.dataset, plan.filter)
    listed = files.select("path", "columns", "name", "web_url", period_display("period_start", "period_end").alias("period")).collect()
    asked = sorted({x for a, b in plan.periods for x in months_between(a, b)})
    if not listed:
        return None, [], asked
    date = next((c["name"] for c in listed[0]["columns"] or [] if c["type"] == "date"), None)
    rows = aggregate(read_tidy(spark, [r["path"] for r in listed]), m.agg, m.field, date=date, group_by=m.group_by, periods=list(plan.periods), where_text=m.where_text)
    missing = [r["month"] for r in coverage(spark, list(plan.periods), present_months(files)).filter("not present").collect()] if asked else []
    return rows, [{"file": r["name"], "link": r["web_url"], "period": r["period"]} for r in listed], missing

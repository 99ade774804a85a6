"""Profiles that merge: what is kept of each file adds up to the profile of a table.

A row for each file and column holds counts, sums, extremes, a HyperLogLog
sketch of distinct values and a KLL sketch of ranks, a few kilobytes whatever
the file's size.  New files are read once; the profile of any set of files, and
the percentile of any stretch of time, comes from the stored rows alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.shared import exists

FILE = ("file", "size", "changed")


def _parts(field: T.StructField) -> Column:
    """What is kept of a column."""
    c, number = F.col(f"`{field.name}`"), isinstance(field.dataType, T.NumericType)
    value = c.cast("double")
    none, empty = F.lit(None).cast("double"), F.lit(None).cast("binary")
    return F.struct(
        F.lit(field.name).alias("column_name"),
        F.lit(field.dataType.simpleString()).alias("column_type"),
        F.count("*").alias("rows"),
        F.count(c).alias("filled"),
        (F.sum(value) if number else none).alias("total"),
        # About the file's own mean, so that large numbers lose nothing.
        (F.coalesce(F.var_pop(value), F.lit(0.0)) * F.count(c) if number else none).alias("spread"),
        (F.min(value) if number else none).alias("low"),
        (F.max(value) if number else none).alias("high"),
        (F.lit(None).cast("string") if number else F.min(c.cast("string"))).alias("first"),
        (F.lit(None).cast("string") if number else F.max(c.cast("string"))).alias("last"),
        F.hll_sketch_agg(c.cast("string")).alias("distinct_values"),
        (F.kll_sketch_agg_double(value) if number else empty).alias("ranks"),
    )


def sketched(rows: DataFrame, *by: str) -> DataFrame:
    """A row for each group and column, in one pass over all columns."""
    columns = [f for f in rows.schema.fields if f.name not in by]
    one = rows.groupBy(*by).agg(*[_parts(f).alias(f"__c{i}") for i, f in enumerate(columns)])
    return one.select(*by, F.inline(F.array(*[F.col(f"__c{i}") for i in range(len(columns))])))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """column_name, column_type, min, max, approx_unique, avg, std, q25, q50, q75, count, null_percentage of the rows that the sketches stand for."""
    filled, mean = F.sum("filled"), F.sum("total") / F.sum("filled")
    # A row a file: the spread within the parts, and that of their means about the whole mean.
    of_column = Window.partitionBy(*by, "column_name", "column_type")
    apart = F.col("total") / F.col("filled") - F.sum("total").over(of_column) / F.sum("filled").over(of_column)
    spread = F.sum("spread") + F.sum(F.col("filled") * F.col("__apart") * F.col("__apart"))
    whole = sketches.withColumn("__apart", F.when(F.col("filled") > 0, apart)).groupBy(*by, "column_name", "column_type").agg(
        F.coalesce(F.min("low").cast("string"), F.min("first")).alias("min"), F.coalesce(F.max("high").cast("string"), F.max("last")).alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_values")).alias("approx_unique"), mean.alias("avg"), F.when(filled > 1, F.sqrt(spread / (filled - 1))).alias("std"),
        F.kll_merge_agg_double("ranks").alias("__ranks"), F.sum("rows").alias("count"), (100.0 * (F.sum("rows") - filled) / F.greatest(F.sum("rows"), F.lit(1))).alias("null_percentage"),
    )
    # A sketch of nothing has no quantiles.
    at = lambda q: F.when(F.kll_sketch_get_n_double("__ranks") > 0, F.kll_sketch_get_quantile_double("__ranks", F.lit(q)))
    quartiles = [at(q).alias(n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return whole.select(*by, "column_name", "column_type", "min", "max", "approx_unique", "avg", "std", *quartiles, "count", "null_percentage")


class FileSketches:
    """The stored sketches of a table's files."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _files(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed")).distinct()

    def known(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/*/") if exists(self.spark, self.path) else None

    def sync(self, rows: DataFrame) -> int:
        """Sketches the files that are not known as they are now, and says how many those are."""
        now, known = self._files(rows), self.known()
        new = now if known is None else now.join(known.select(*FILE).distinct(), list(FILE), "left_anti")
        count = new.count()
        if count:
            # Their names are the smaller side of the join; Spark reads other files for their names only.
            named = rows.select("*", F.col("_metadata.file_path").alias("__file")).join(F.broadcast(new) if count < 10_000 else new, F.col("__file") == F.col("file")).drop("__file")
            sketched(named, *FILE).write.parquet(f"{self.path}/{uuid.uuid4().hex[:12]}")
        return count

    def profile(self, rows: DataFrame) -> DataFrame:
        """The profile of the files that the table has now, of which none is read again."""
        self.sync(rows)
        return merged(self.known().join(self._files(rows), list(FILE), "left_semi"))


def by_time(rows: DataFrame, at: str, value: str, width: str) -> DataFrame:
    """begin, n, ranks: a KLL sketch of values for each stretch of time."""
    stretch = F.window(F.col(at).cast("timestamp"), width)
    return rows.filter(F.col(value).isNotNull()).groupBy(stretch.alias("w")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("ranks")).select(F.col("w.start").alias("begin"), "n", "ranks")


def percentile_since(sketches: DataFrame, begin: Column, q: float, otherwise: float = 0.0) -> DataFrame:
    """n, percentile of the stretches (begin, n, ranks) from a moment on."""
    some = sketches.filter(F.col("begin") >= begin).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.kll_merge_agg_double("ranks").alias("ranks"))
    return some.select("n", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(q))).otherwise(otherwise).alias("percentile"))

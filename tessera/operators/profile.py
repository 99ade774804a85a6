"""Profiles of tables and scores of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.matching import overlapping_sets


def profile(rows: DataFrame, approximate: bool = True) -> DataFrame:
    """A row for each column: name, type, min, max, avg, std, count, nulls in percent, and with `approximate` distinct values and quartiles.

    One pass over the table for all columns.
    """
    wanted = []
    for f in rows.schema.fields:
        c, number = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
        none = F.lit(None).cast("double")
        q = F.percentile_approx(c.cast("double"), [0.25, 0.5, 0.75]) if number else F.array(none, none, none)
        wanted.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("column_type"),
                F.min(c).cast("string").alias("min"),
                F.max(c).cast("string").alias("max"),
                (F.avg(c.cast("double")) if number else none).alias("avg"),
                (F.stddev_samp(c.cast("double")) if number else none).alias("std"),
                F.count("*").alias("count"),
                (100.0 * (F.count("*") - F.count(c)) / F.greatest(F.count("*"), F.lit(1))).alias("null_percentage"),
                *([F.approx_count_distinct(c).alias("approx_unique"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75")] if approximate else []),
            ).alias(f"c{len(wanted)}")
        )
    one = rows.agg(*wanted)
    return one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(wanted))])).alias("x")).select("x.*")


def retrieval_scores(cites: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """questions, hit_at_k, mrr of cites (question, position, file) against expected (question, file).

    A file counts at its first place among distinct ones; questions without
    cites count as misses; no questions give zeros.
    """
    first = cites.groupBy("question", "file").agg(F.min("position").alias("position"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy("position", "file"))).filter(F.col("rank") <= k)
    hits = ranked.join(expected.distinct(), ["question", "file"]).groupBy("question").agg(F.min("rank").alias("rank"))
    each = expected.select("question").distinct().join(hits, "question", "left")
    return each.agg(F.count("*").alias("questions"), F.coalesce(F.avg(F.col("rank").isNotNull().cast("double")), F.lit(0.0)).alias("hit_at_k"), F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def numeric_accuracy(got: DataFrame, expected: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Share of questions whose summed value is within the tolerance; null where none expects a value."""
    sums = got.groupBy("question").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("got"))
    both = expected.filter("value is not null").join(sums, "question", "left")
    right = F.coalesce(F.abs(F.col("got") - F.col("value")) <= F.abs(F.col("value")) * tolerance, F.lit(False))
    return both.agg(F.avg(right.cast("double")).alias("numeric_accuracy"))


def similar_pairs(rows: DataFrame, key: str, words: str, least: float = 0.6) -> DataFrame:
    """a, b, overlap of rows whose distinct words overlap by a share of the smaller set."""
    found = overlapping_sets(rows.select(F.lit(0).alias("side"), F.col(key).alias("id"), F.col(words).alias("items")), least)
    return found.select(F.least("small.id", "large.id").alias("a"), F.greatest("small.id", "large.id").alias("b"), "overlap")


def best_match(new: DataFrame, old: DataFrame, key: str, words: str, least: float = 0.6) -> DataFrame:
    """key, match, overlap: the existing row that each new one restates most, if any does."""
    sides = [df.select(F.lit(n).alias("side"), F.col(key).alias("id"), F.col(words).alias("items")) for n, df in enumerate((new, old))]
    found = overlapping_sets(sides[0].unionByName(sides[1]), least)
    of = lambda side: F.when(F.col("small.side") == side, F.col("small.id")).otherwise(F.col("large.id"))
    both = found.filter("small.side != large.side").select(of(0).alias(key), of(1).alias("match"), "overlap")
    window = Window.partitionBy(key).orderBy(F.col("overlap").desc(), "match")
    return both.withColumn("__n", F.row_number().over(window)).filter("__n = 1").select(key, "match", "overlap")

"""Joins in time that SQL has no word for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Left rows with the values of the last right row of the same keys at or before their time.

    Both sides are laid over each other and carried forward: one shuffle on the
    keys and one sort, no matter how many rows of the right precede.
    """
    kept = [c for c in left.columns if c not in (*keys, at)]
    a = left.select(*keys, at, F.struct(*[F.col(c) for c in kept]).alias("__left"), F.lit(None).alias("__right"), F.lit(1).alias("__side"))
    b = right.select(*keys, at, F.lit(None).alias("__left"), F.struct(*values).alias("__right"), F.lit(0).alias("__side"))
    b = b.withColumn("__left", F.lit(None).cast(a.schema["__left"].dataType))
    a = a.withColumn("__right", F.lit(None).cast(b.schema["__right"].dataType))
    carried = F.last("__right", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b).withColumn("__seen", carried).filter("__side = 1")
    return both.select(*keys, at, "__left.*", *[F.col(f"__seen.{v}").alias(v) for v in values])


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs of the same keys whose intervals share a moment (ends included).

    Intervals meet in buckets of `width` days and count in the first that both
    have, so that only rows near each other in time are compared.
    """
    day = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (86400 * int(width)))
    spread = lambda df, ends, name: df.withColumn(name, F.explode(F.sequence(day(ends[0]), day(ends[1]))))
    x, y = spread(left, a, "__bucket"), spread(right, b, "__other")
    on = [F.col("__bucket") == F.col("__other")] + [x[k] == y[k] for k in keys]
    first = F.col("__bucket") == F.greatest(day(a[0]), day(b[0]))
    pairs = x.join(y, on).filter(first & (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])))
    for k in keys:
        pairs = pairs.drop(y[k])
    return pairs.drop("__bucket", "__other")

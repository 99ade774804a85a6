from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators.sketches import FileSketches, by_time, merged, percentile_since, sketched

SCHEMA = "part int, x double, n long, name string, day date, gone string"


def drawn(spark, count, seed=1):
    import datetime as dt

    draw = random.Random(seed)
    rows = [(i % 4, draw.gauss(1e6, 3.0) if i % 10 else None, draw.randrange(500), f"name {draw.randrange(3000)}", dt.date(2024, 1, 1 + i % 28), None) for i in range(count)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_merged_parts_are_the_profile_of_the_whole(spark):
    rows, frame = drawn(spark, 20_000)
    got = {r.column_name: r for r in merged(sketched(frame, "part")).collect()}
    x = sorted(r[1] for r in rows if r[1] is not None)
    assert got["x"].avg == pytest.approx(statistics.fmean(x)) and got["x"].std == pytest.approx(statistics.stdev(x), rel=1e-6)
    assert (float(got["x"].min), float(got["x"].max), got["x"]["count"], got["x"].null_percentage) == (x[0], x[-1], 20_000, 10.0)
    for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        assert abs(sum(v <= got["x"][name] for v in x) / len(x) - q) < 0.02
    assert abs(got["name"].approx_unique - 3000) < 150 and abs(got["n"].approx_unique - 500) < 25
    assert (got["name"].min, got["day"].max, got["name"].q50) == (min(r[3] for r in rows), "2024-01-28", None)
    assert (got["gone"].null_percentage, got["gone"].approx_unique, got["gone"].min) == (100.0, 0, None)


def test_one_value_and_no_rows(spark):
    _, frame = drawn(spark, 1)
    one = {r.column_name: r for r in merged(sketched(frame, "part")).collect()}
    assert one["n"].std is None and one["x"].q50 is None and one["x"].avg is None
    assert merged(sketched(frame.limit(0), "part")).collect() == []


def test_only_new_files_are_read(spark, tmp_path):
    path, (rows, frame) = f"file://{tmp_path}/t", drawn(spark, 900)
    for part in range(3):
        frame.filter(F.col("part") == part).coalesce(1).write.parquet(f"{path}/f={part}")
    sketches, table = FileSketches(spark, f"file://{tmp_path}/s"), lambda: spark.read.parquet(path)
    assert sketches.sync(table()) == 3 and sketches.sync(table()) == 0
    frame.filter("part = 3").coalesce(1).write.parquet(f"{path}/f=3")
    frame.filter("part = 3").limit(5).coalesce(1).write.mode("overwrite").parquet(f"{path}/f=0")
    assert sketches.sync(table()) == 2
    whole = {r.column_name: r["count"] for r in sketches.profile(table()).collect()}
    assert whole["x"] == table().count() == sum(r[0] != 0 for r in rows) + 5
    assert sketches.known().select("file", "size", "changed").distinct().count() == 5


def test_percentiles_of_a_stretch(spark):
    rows = spark.range(6000).select((F.lit(1_700_000_000) + F.col("id")).cast("timestamp").alias("ts"), (F.col("id") % 1000).cast("double").alias("v"))
    kept = by_time(rows, "ts", "v", "1 minute")
    since = F.lit(1_700_000_000 + 3000).cast("timestamp")
    got = percentile_since(kept, since, 0.95).first()
    assert got.n <= 3000 and abs(got.percentile - 950) <= 25
    assert tuple(percentile_since(kept, F.lit("2040-01-01").cast("timestamp"), 0.95).first()) == (0, 0.0)

"""State that goes by timers, and what streams in update mode tell."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.queries.streams import rocks
from tessera.streaming import cdc

SCHEMA = "source string, event_id long, signature string, at double, moment timestamp"
START = dt.datetime(2024, 1, 1)
SECONDS = START.replace(tzinfo=dt.UTC).timestamp()


def events(spark, path, rows):
    """One file of (source, event_id, signature, minutes after the start)."""
    made = [(s, i, g, SECONDS + 60.0 * m, START + dt.timedelta(minutes=m)) for s, i, g, m in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_sources_are_forgotten_an_hour_after_their_last_event(spark, tmp_path):
    path, left = f"file://{tmp_path}/in", []

    def run():
        rows = spark.readStream.schema(SCHEMA).parquet(path)
        with rocks(spark):
            running = cdc.rate_capped_in_time(rows, "moment", until=F.lit(START + dt.timedelta(days=2))).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/checkpoint").start()
            cdc.caught_up(running)
            left.append(sorted(r.source for r in cdc.remembered(spark, f"file://{tmp_path}/checkpoint").collect()))
        return sorted(r.event_id for r in spark.read.schema(cdc.CAPPED).parquet(f"file://{tmp_path}/out").collect())

    # The same signature within half an hour, a fifth event within an hour.
    events(spark, path, [("a", 1, "x", 0), ("a", 2, "x", 10), ("a", 3, "y", 11), ("a", 4, "z", 12), ("a", 5, "v", 13), ("a", 6, "w", 14), ("b", 7, "x", 15)])
    assert run() == [1, 3, 4, 5, 7] and left[-1] == ["a", "b"]
    # Another source moves the time on: a and b are forgotten, c is not.
    events(spark, path, [("c", 8, "x", 200)])
    assert run() == [1, 3, 4, 5, 7, 8] and left[-1] == ["c"]
    events(spark, path, [("a", 9, "x", 201)])
    assert run()[-1] == 9 and left[-1] == ["a", "c"]
    events(spark, path, [(None, -1, None, 60 * 24 * 3)])
    run()
    assert left[-1] == []


def test_a_snapshot_and_the_deltas_behind_it(spark, tmp_path):
    told = cdc.Deltas(spark, f"file://{tmp_path}/told", ("k",), "k string, n long")
    batches = [[("a", 1), ("b", 1)], [("a", 2)], [("b", 5), ("c", 1)]]
    for number, rows in enumerate(batches):
        for _ in range(2):  # delivered again
            told.sink(spark.createDataFrame(rows, "k string, n long"), number)
    as_dict = lambda rows: {r.k: r.n for r in rows.collect()}
    assert as_dict(told.snapshot()) == {"a": 2, "b": 5, "c": 1} and as_dict(told.snapshot(1)) == {"a": 2, "b": 1}
    assert sorted((r.k, r.n, r.batch) for r in told.since(0).collect()) == [("a", 2, 1), ("b", 5, 2), ("c", 1, 2)]

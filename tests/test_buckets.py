from __future__ import annotations

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessera.operators.buckets import BucketStore, Table, newest
from tessera.sources import feed
from tessera.sources.changefeed import CursorExpired
from tessera.sources.shared import names, publish_text, read_text
from tessera.streaming import cdc

ROWS = Table("id long, name string", ("id",), 8)


@pytest.fixture
def store(spark, tmp_path):
    return BucketStore(spark, f"file://{tmp_path}/store", {"rows": ROWS, "parts": Table("id long, name string, part long", ("id",), 4)})


def put(spark, rows):
    """A rewrite that replaces rows by key; a null name deletes."""
    new = spark.createDataFrame(rows, "id long, name string")
    return new.select("id"), lambda old: old.join(new.select("id"), "id", "left_anti").unionByName(new.filter("name is not null"))


def held(store, table="rows", at=None):
    return sorted(tuple(r) for r in store.rows(table, at=at).collect())


def test_a_commit_rewrites_touched_buckets_only(spark, store):
    draw, truth, seen = random.Random(1), {}, []
    for _ in range(4):
        change = {draw.randrange(12): draw.choice(["a", "b", None]) for _ in range(4)}
        truth |= change
        before = store.commit_of().folders.get("rows", {})
        after = store.commit({"rows": put(spark, list(change.items()))}).folders["rows"]
        touched = {r[0] for r in spark.createDataFrame([(k,) for k in change], "id long").select(ROWS.bucket()).distinct().collect()}
        assert {b: f for b, f in before.items() if b not in touched} == {b: f for b, f in after.items() if b not in touched}
        assert all(after.get(b) != before.get(b) or b not in after for b in touched)
        assert held(store) == sorted((k, v) for k, v in truth.items() if v)
        seen.append((store.commit_of().version, held(store)))
    for version, rows in seen:  # earlier commits can still be read
        assert held(store, at=store.commit_of(version)) == rows
    assert store.history().count() == store.history().distinct().count() > 4


def test_batches_count_once_and_tables_commit_together(spark, store):
    parts = spark.createDataFrame([(1, "x", 1), (1, "x", 2)], "id long, name string, part long")
    store.commit({"rows": put(spark, [(1, "x")]), "parts": (parts.select("id"), lambda old: old.unionByName(parts))}, 0, "feed")
    assert store.commit({"rows": put(spark, [(1, "again")])}, 0, "feed").version == 1
    assert store.commit({"rows": put(spark, [(2, "other writer")])}, 0, "hand").version == 2

    def broken(old):
        raise ZeroDivisionError

    with pytest.raises(ZeroDivisionError):
        store.commit({"rows": put(spark, [(1, "half")]), "parts": (parts.select("id"), broken)}, 1, "feed")
    assert held(store) == [(1, "x"), (2, "other writer")] and len(held(store, "parts")) == 2
    assert store.commit({}, 1, "feed").batches == {"feed": 1, "hand": 0}


def test_of_two_writers_one_commits(spark, store):
    def meanwhile(old):
        store.commit({"rows": put(spark, [(5, "first")])})
        return old

    keys, _ = put(spark, [(5, "second")])
    with pytest.raises(RuntimeError):
        store.commit({"rows": (keys, meanwhile)})
    assert held(store) == [(5, "first")]


def test_vacuum_keeps_what_kept_commits_name(spark, store):
    for n in range(4):
        store.commit({"rows": put(spark, [(n, "x"), (0, f"v{n}")])})
    rows = held(store)
    assert store.vacuum(2) and store.versions() == [3, 4] and held(store) == rows
    assert held(store, at=store.commit_of(3)) == [(0, "v2"), (1, "x"), (2, "x")]
    with pytest.raises(ValueError):
        store.commit_of(1)


def test_buckets_are_written_side_by_side_one_file_each(spark, store):
    folder = store.commit({"rows": put(spark, [(n, "x") for n in range(60)])}).folders["rows"][0]
    files = [n for b in range(8) for n in names(spark, f"{store.root}/rows/{folder}/bucket={b}") if n.startswith("part-")]
    assert len(files) == 8 and len({n.split("-")[1] for n in files}) == 8


def test_a_null_key_has_one_row(spark, store):
    change = cdc.kept_rows(store, "rows", ("at",))
    for n, rows in enumerate(([(None, "a", False, 0, 1), (1, "a", False, 0, 1)], [(None, "b", False, 0, 2), (1, "b", True, 0, 2), (1, "c", False, 0, 0)])):
        pages = spark.createDataFrame(rows, f"{ITEMS}, epoch int, at int").withColumn("name", F.concat("name", F.lit("!")))
        store.commit({"rows": change(pages, None)}, n)
    assert held(store) == [(None, "b!")]


def test_empty_store_and_null_keys(spark, store):
    assert held(store) == [] and store.history().collect() == []
    assert store.commit({"rows": put(spark, [])}).folders == {"rows": {}}
    other = Table("a string, b long", ("a", "b"), 1 << 20)
    got = spark.createDataFrame([("x", None), (None, None), ("x\x1f1", None), ("x", 1)], other.schema).select(other.bucket()).collect()
    assert len({r[0] for r in got}) == 4


def test_newest_takes_the_last_change(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, None, "n"), (1, 3, None), (2, None, "only")], "id long, at int, name string")
    assert sorted((r.id, r.at, r.name) for r in newest(rows, ("id",), ("at",)).collect()) == [(1, 3, None), (2, None, "only")]


def test_small_files_are_published_once(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.json"
    assert publish_text(spark, path, "é 1") and not publish_text(spark, path, "2")
    assert read_text(spark, path) == "é 1" and names(spark, f"file://{tmp_path}/a") == ["b.json"]
    assert names(spark, f"file://{tmp_path}/none") == []


# The feed

ITEMS = "id long, name string, deleted boolean"


def page(spark, root, n, rows):
    spark.createDataFrame(rows, ITEMS).coalesce(1).write.parquet(f"{root}/page={n}")


def reader(root, most=2):
    return feed.LinkReader({"feed": "tessera.sources.feed:StoredFeed", "at": root, "pages": str(most)})


def test_links_follow_cursors_and_epochs(spark, tmp_path):
    root = f"file://{tmp_path}/feed"
    at = reader(root).initialOffset()
    assert list(reader(root).read(at)[0]) == []
    for n in (0, 1, 4):
        page(spark, root, n, [(n, "x", False)])
    links, one = reader(root).read(at)
    assert list(links) == [(0, "page", None), (0, "page", "1")] and one["cursor"] == "2"
    links, two = reader(root).read(one)
    assert list(links) == [(0, "page", "2"), (0, "end", "5")] and two == {"epoch": 0, "cursor": "5", "whole": True}
    assert list(reader(root).readBetweenOffsets(one, two)) == [(0, "page", "2"), (0, "end", "5")]
    links, three = reader(root).read(two)
    assert list(links) == [] and three == two
    publish_text(spark, f"{root}/oldest=7", "")
    page(spark, root, 8, [(8, "y", False)])
    links, four = reader(root).read(two)
    assert list(links) == [] and four == {"epoch": 1, "cursor": None, "whole": False}
    assert list(reader(root).readBetweenOffsets(two, four)) == []
    assert list(reader(root).read(four)[0]) == [(1, "page", None), (1, "end", "9")]
    with pytest.raises(CursorExpired):
        feed.StoredFeed(root).after("6")


def test_shares_of_a_page_hold_each_item_once(spark, tmp_path):
    root = f"file://{tmp_path}/feed"
    spark.range(100).selectExpr("id", "'x' AS name", "false AS deleted").coalesce(1).write.option("maxRecordsPerFile", 9).parquet(f"{root}/page=0")
    stored = feed.StoredFeed(root)
    shares = [[i for batch in stored.share(None, n, 5) for i in batch["id"].to_pylist()] for n in range(5)]
    assert all(shares) and sorted(sum(shares, [])) == list(range(100))
    assert [i for batch in stored.items(None) for i in batch["id"].to_pylist()] == list(range(100))
    seen = []

    def sink(batch, number):
        pages = batch.filter("kind = 'page'")
        seen.append((sorted(r.id for r in pages.collect()), pages.select(F.spark_partition_id()).distinct().count()))

    cdc.caught_up(cdc.stream_table(feed.changes(spark, root, ITEMS, pages_per_batch=1), [sink], f"file://{tmp_path}/checkpoint", once=False))
    assert seen[0] == (list(range(100)), 4)


def test_a_feed_without_shares_gives_a_page_to_one_task():
    class Whole:
        def items(self, cursor):
            return iter([cursor])

    assert [list(feed.fetched(Whole(), "7", n, 3)) for n in range(3)] == [["7"], [], []]


def test_a_stream_goes_on_after_failures_and_restarts(spark, tmp_path):
    root = f"file://{tmp_path}/feed"
    store = BucketStore(spark, f"file://{tmp_path}/store", {"rows": Table("id long, name string, epoch int", ("id",), 4)})
    apply, numbers = cdc.store_sink(store, {"rows": cdc.kept_rows(store, "rows", ("name",))}), []

    def sink(batch, number):
        numbers.append(number)
        if numbers.count(1) == 1 and number == 1:
            raise OSError("away")
        apply(batch, number)

    def run():
        rows = feed.changes(spark, root, ITEMS, pages_per_batch=1)
        cdc.caught_up(cdc.stream_table(rows, [sink], f"file://{tmp_path}/checkpoint", once=False))

    page(spark, root, 0, [(1, "a", False), (2, "a", False), (1, "b", False)])
    page(spark, root, 1, [(2, "c", True), (3, "c", False)])
    with pytest.raises(StreamingQueryException):
        run()
    run()
    assert [(r.id, r.name) for r in store.rows("rows").orderBy("id").collect()] == [(1, "b"), (3, "c")]
    before = list(numbers)
    run()  # nothing new
    assert numbers == before
    page(spark, root, 2, [(4, "d", False)])
    run()
    assert store.rows("rows").count() == 3
    publish_text(spark, f"{root}/oldest=9", "")
    page(spark, root, 9, [(4, "d", False), (5, "e", False)])
    run()
    assert [(r.id, r.epoch) for r in store.rows("rows").orderBy("id").collect()] == [(4, 1), (5, 1)]
    assert store.rows("rows").filter(F.col("epoch") < 1).isEmpty()

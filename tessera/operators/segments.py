"""A text index that grows by segments.

New texts become a segment of their own; what is stored before stays as it is.
A text that goes is marked in a bitmap of two words for each block of 128
neighbouring texts.  A posting row is a block: a term, the texts of the block
that hold it, and the largest count and the least length among them, which bound
what any of these texts can score.  A top-k search scores the blocks with the
largest bounds first and then only those whose bound reaches the k-th score found
there.  Segments are merged by shifting their block numbers.

A block's texts lie side by side, so its posting rows are made where its words
are: postings do not shuffle.  A file of a segment is a row of runs, each of
about RUN words and in the order of terms, which is what a search's test of terms
is pushed down to.

A commit names the live segments, their totals and the bitmaps, so that readers
see one state.  Searches over phrases and cover density go through index().
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessera.functions.fulltext import ENGLISH_STOP, lexemes, porter2, word_tokens, words_of
from tessera.operators.commits import CommitLog
from tessera.operators.textindex import K1, B, TextIndex, added_up
from tessera.sources.shared import names, remove

BLOCK_BITS = 7
#: Words whose postings are put in order together, and texts of a staged file: whole blocks.
RUN, STAGED = 1 << 20, 1 << 13
#: Bits of a row's number within its part in monotonically_increasing_id().
PART_BITS = 33
#: A bound and a score are sums in different orders.
SLACK = 1 + 1e-9


def saturated(tf: Column, length: Column, average: float) -> Column:
    """A term's share of BM25 before its weight: grows with the count and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


class SegmentedIndex:
    def __init__(self, spark: SparkSession, root: str, stem: bool = False) -> None:
        self.spark, self.root, self.stem = spark, root, stem
        self.log = CommitLog(spark, f"{root}/_commits")

    def state(self) -> dict:
        """The last commit: version, segments (name, docs, words, dead_docs, dead_words), dead (the bitmaps' folder), files (the folder of known files)."""
        return self.log.read() or {"version": 0, "segments": [], "dead": None, "files": None}

    # Changes

    def add(self, docs: DataFrame) -> dict:
        """A segment of docs (id, text and perhaps file); none where they are empty."""
        return self._publish(self.state(), added=docs)

    def delete(self, ids: DataFrame) -> dict:
        """Marks the texts of some ids (id) as gone."""
        return self._publish(self.state(), gone=lambda docs: docs.join(ids.select("id").distinct(), "id", "left_semi"))

    def update(self, docs: DataFrame) -> dict:
        """New texts in place of those of the same ids, in one commit."""
        return self._publish(self.state(), added=docs, gone=lambda old: old.join(docs.select("id").distinct(), "id", "left_semi"))

    def sync(self, rows: DataFrame, key: str = "id", text: str = "text") -> dict:
        """Follows a table's files: a segment for the new and changed ones, marks for what lay in those that went."""
        state = self.state()
        files = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed")).distinct()
        folder = f"{self.root}/files/{_new_name(state)}"
        files.write.parquet(folder)
        now = self.spark.read.parquet(folder)
        known = self.spark.read.schema(now.schema).parquet(f"{self.root}/files/{state['files']}") if state["files"] else now.limit(0)
        same = ["file", "size", "changed"]
        fresh, gone = now.join(known, same, "left_anti").select("file"), known.join(now, same, "left_anti").select("file")
        if fresh.isEmpty() and gone.isEmpty():
            remove(self.spark, folder)
            return state
        docs = rows.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col("_metadata.file_path").alias("file")).join(fresh, "file", "left_semi")
        return self._publish(state, added=docs, gone=lambda old: old.join(gone, "file", "left_semi"), files=folder.rsplit("/", 1)[1])

    def merge(self, most: int = 8) -> dict:
        """At most so many segments: the smallest become one, and what was marked as gone goes."""
        state = self.state()
        by_size = sorted(state["segments"], key=lambda s: s["docs"] - s["dead_docs"], reverse=True)
        kept, merged = by_size[: most - 1], by_size[most - 1 :]
        if len(merged) < 2:
            return state
        name, base, shifts = _new_name(state), 0, []
        for s in merged:
            shifts.append((s["name"], base))
            base += s["blocks"]
        shift = F.broadcast(self.spark.createDataFrame(shifts, "segment string, base long"))  # one row a segment
        at = lambda at, base: at + base * (1 << BLOCK_BITS)
        docs = self._alive(self._stored("docs", merged), state).join(shift, "segment").select(at(F.col("at"), F.col("base")).alias("at"), "id", "file", "length")
        docs.write.parquet(f"{self.root}/docs/segment={name}")
        rows = self._live_blocks(merged, state).join(shift, "segment")
        moved = F.transform("docs", lambda d: F.struct(at(d["at"], F.col("base")).alias("at"), *[d[c].alias(c) for c in ("id", "tf", "length", "positions")]))
        self._write_postings(rows.select("term", (F.col("block") + F.col("base")).alias("block"), moved.alias("docs")), name)
        one = {"name": name, "blocks": base, "docs": sum(s["docs"] - s["dead_docs"] for s in merged), "words": sum(s["words"] - s["dead_words"] for s in merged), "dead_docs": 0, "dead_words": 0}
        dead = None
        if state["dead"] and any(s["dead_docs"] for s in kept):
            dead = name
            self._dead(state).filter(F.col("segment").isin([s["name"] for s in kept])).write.parquet(f"{self.root}/dead/{dead}")
        new = {"version": state["version"] + 1, "segments": [*kept, one], "dead": dead, "files": state["files"]}
        self.log.publish(new)
        return new

    def vacuum(self) -> list[str]:
        """Deletes what the last commit does not name."""
        state, versions = self.state(), self.log.versions()
        used = {f"segment={s['name']}" for s in state["segments"]}
        gone = [f"{self.root}/{kind}/{n}" for kind in ("docs", "postings") for n in names(self.spark, f"{self.root}/{kind}") if n not in used]
        gone += [f"{self.root}/{kind}/{n}" for kind in ("dead", "files") for n in names(self.spark, f"{self.root}/{kind}") if n != state[kind]]
        for path in gone:
            remove(self.spark, path)
        self.log.forget(versions[:-1])
        return gone

    def _publish(self, state: dict, added: DataFrame | None = None, gone=None, files: str | None = None) -> dict:
        segments, dead, name = [dict(s) for s in state["segments"]], state["dead"], _new_name(state)
        if gone and segments:
            marked = gone(self._alive(self._stored("docs", segments), state)).select("segment", "at", "length")
            lost = {r["segment"]: r for r in marked.groupBy("segment").agg(F.count("*").alias("docs"), F.sum("length").alias("words")).collect()}  # one row a segment
            if lost:
                bit = F.pmod(F.col("at"), F.lit(1 << BLOCK_BITS)).cast("int")
                one = lambda low: F.when(bit.between(low, low + 63), F.call_function("shiftleft", F.lit(1).cast("long"), bit - low)).otherwise(0)
                bits = marked.select("segment", F.shiftright("at", BLOCK_BITS).alias("block"), one(0).alias("low"), one(64).alias("high"))
                bits = bits.unionByName(self._dead(state)) if dead else bits
                dead = name
                bits.groupBy("segment", "block").agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high")).write.parquet(f"{self.root}/dead/{dead}")
            for s in segments:
                if s["name"] in lost:
                    s["dead_docs"] += lost[s["name"]]["docs"]
                    s["dead_words"] += lost[s["name"]]["words"]
            segments = [s for s in segments if s["dead_docs"] < s["docs"]]
        if added is not None and (new := self._write_segment(added, name)):
            segments.append(new)
        commit = {"version": state["version"] + 1, "segments": segments, "dead": dead, "files": files or state["files"]}
        self.log.publish(commit)
        return commit

    def _write_segment(self, docs: DataFrame, name: str) -> dict | None:
        staging = f"{self.root}/staging/{name}"
        file = F.col("file") if "file" in docs.columns else F.lit(None).cast("string").alias("file")
        texts = docs.select("id", file, word_tokens("text").alias("words"), F.monotonically_increasing_id().alias("row")).withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
        texts.write.option("compression", "zstd").option("maxRecordsPerFile", STAGED).parquet(staging)
        staged = self.spark.read.parquet(staging).withColumns({"part": F.shiftright("row", PART_BITS), "n": F.col("row").bitwiseAND((1 << PART_BITS) - 1)})
        # One row a part: each begins with a block of its own.
        parts = staged.groupBy("part").agg((F.floor(F.max("n") / (1 << BLOCK_BITS)) + 1).alias("blocks"), F.count("*").alias("docs"), F.sum(F.size("words").cast("long")).alias("words"))
        totals = parts.agg(F.sum("blocks").alias("blocks"), F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        if not totals["docs"]:
            remove(self.spark, staging)
            return None
        before = F.coalesce(F.sum("blocks").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = F.broadcast(parts.select("part", (before * (1 << BLOCK_BITS)).alias("offset")))
        numbered = staged.join(offsets, "part").select((F.col("n") + F.col("offset")).alias("at"), "id", "file", F.size("words").alias("length"), "words")
        numbered.drop("words").write.parquet(f"{self.root}/docs/segment={name}")
        one = StructType([*(numbered.schema[c] for c in ("at", "id")), StructField("tf", IntegerType()), StructField("length", IntegerType()), StructField("positions", ArrayType(IntegerType()))])
        found = numbered.select("at", "id", "length", "words").mapInArrow(_blocks(self.stem), StructType().add("term", "string").add("block", "long").add("docs", ArrayType(one)))
        self._store_postings(found, name)
        remove(self.spark, staging)
        return {"name": name, "blocks": totals["blocks"], "docs": totals["docs"], "words": totals["words"], "dead_docs": 0, "dead_words": 0}

    def _write_postings(self, rows: DataFrame, name: str) -> None:
        self._store_postings(rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block"), name)

    def _store_postings(self, rows: DataFrame, name: str) -> None:
        """Rows that are dealt out already, each task's in runs in the order of terms."""
        largest, least = F.array_max(F.transform("docs", lambda d: d["tf"])), F.array_min(F.transform("docs", lambda d: d["length"]))
        rows = rows.select("term", "block", largest.alias("max_tf"), least.alias("min_length"), "docs")
        rows.write.option("compression", "zstd").parquet(f"{self.root}/postings/segment={name}")

    # Reading

    def _stored(self, kind: str, segments: list[dict]) -> DataFrame:
        paths = [f"{self.root}/{kind}/segment={s['name']}" for s in segments]
        return self.spark.read.option("basePath", f"{self.root}/{kind}").parquet(*paths).withColumn("segment", F.col("segment").cast("string"))

    def _dead(self, state: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/dead/{state['dead']}")

    def _alive(self, docs: DataFrame, state: dict) -> DataFrame:
        """Rows (segment, at, …) of texts that are not marked as gone."""
        if not state["dead"]:
            return docs
        marks = docs.withColumn("block", F.shiftright("at", BLOCK_BITS)).join(self._dead(state), ["segment", "block"], "left")
        return marks.filter(_lives(F.col("at"))).select(*docs.columns)

    def _live_blocks(self, segments: list[dict], state: dict, asked: Column | None = None) -> DataFrame:
        """Posting rows without the texts that are gone."""
        rows = self._stored("postings", segments)
        rows = rows if asked is None else rows.filter(asked)
        if state["dead"]:
            rows = rows.join(self._dead(state), ["segment", "block"], "left").withColumn("docs", F.when(F.col("low").isNull(), F.col("docs")).otherwise(F.filter("docs", lambda d: _lives(d["at"])))).drop("low", "high").filter(F.size("docs") > 0)
        return rows

    def totals(self, state: dict | None = None) -> tuple[int, int]:
        """Live texts and their words."""
        segments = (state or self.state())["segments"]
        return sum(s["docs"] - s["dead_docs"] for s in segments), sum(s["words"] - s["dead_words"] for s in segments)

    def index(self) -> TextIndex:
        """The live texts as one index, for phrases and cover density."""
        state = self.state()
        totals = self.spark.createDataFrame([self.totals(state)], "docs long, words long")
        if not state["segments"]:
            return TextIndex(self.spark.createDataFrame([], "term string, id long, tf int, length int, positions array<int>"), totals, self.stem)
        rows = self._live_blocks(state["segments"], state).select("term", F.inline("docs")).drop("at")
        return TextIndex(rows.select("term", "id", "tf", "length", "positions"), totals, self.stem)

    def terms(self, words: list[str]) -> list[str]:
        return [x for w in words for x in (lexemes if self.stem else words_of)(w)]

    def _weighted(self, terms: list[str], state: dict) -> tuple[DataFrame, float]:
        """The terms' blocks with weight and bound, and the average length."""
        docs, words = self.totals(state)
        blocks = self._live_blocks(state["segments"], state, reduce(lambda a, b: a | b, [F.col("term") == t for t in dict.fromkeys(terms)]))
        seen = blocks.groupBy("term").agg(F.sum(F.size("docs")).alias("with_term"))
        idf = F.ln((F.lit(docs) - F.col("with_term") + 0.5) / (F.col("with_term") + 0.5))
        # One row a term.
        weights = F.broadcast(seen.select("term", F.when(idf > 0, idf).otherwise(1e-6).alias("idf")))
        average = words / docs
        return blocks.join(weights, "term").withColumn("bound", F.col("idf") * saturated(F.col("max_tf"), F.col("min_length"), average)), average

    def _scored(self, blocks: DataFrame, average: float) -> DataFrame:
        each = blocks.select("idf", F.inline("docs"))
        return each.groupBy("id").agg(added_up(F.collect_list(F.col("idf") * saturated(F.col("tf"), F.col("length"), average))).alias("score"))

    def reaching(self, blocks: DataFrame, average: float, k: int) -> DataFrame:
        """The blocks of _weighted() that can hold one of the k best texts."""
        place = ["segment", "block"]
        bounds = blocks.groupBy(*place).agg(F.sum("bound").alias("most"))
        first = bounds.orderBy(F.col("most").desc(), *place).limit(k).select(*place)
        best = self._scored(blocks.join(F.broadcast(first), place, "left_semi"), average).orderBy(F.col("score").desc()).limit(k)
        # One row.
        least = F.broadcast(best.agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("least")))
        good = bounds.crossJoin(least).filter(F.col("most") * SLACK >= F.col("least")).select(*place)
        return blocks.join(good, place, "left_semi")

    def bm25(self, terms: list[str], k: int | None = 40) -> DataFrame:
        """id, score: BM25 of the live texts that hold a term, the k best."""
        state = self.state()
        if not state["segments"] or not terms:
            return self.spark.createDataFrame([], "id long, score double")
        blocks, average = self._weighted(terms, state)
        if not k:
            return self._scored(blocks, average)
        return self._scored(self.reaching(blocks, average, k), average).orderBy(F.col("score").desc(), "id").limit(k)


def _blocks(stem: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """term, block, docs of texts (at, id, length, words) that lie in the order of their numbers."""

    def one_run(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = rows.column("words")
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        words, code = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes)
        place = (np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        stop = set(ENGLISH_STOP) if stem else ()
        terms = [None if w in stop else porter2(w) if stem else w for w in words]
        # As Spark orders strings: by their bytes.
        names = sorted({t for t in terms if t is not None}, key=str.encode)
        rank = dict(zip(names, range(len(names)), strict=True))
        term = np.array([-1 if t is None else rank[t] for t in terms], np.int64)[code] if words else code
        text, place, term = text[term >= 0], place[term >= 0], term[term >= 0]
        block = rows.column("at").to_numpy() >> BLOCK_BITS
        # A text's words lie in order, and texts do: the order of terms keeps both.
        order = np.argsort(term, kind="stable")
        text, place, term = text[order], place[order], term[order]
        # Where a posting begins, and where a row.
        posting = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        of, own = term[posting], text[posting]
        row = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(block[own], prepend=-1) != 0))
        cut = lambda at, n: pa.array(np.append(at, n).astype(np.int32))
        take = lambda c: rows.column(c).take(pa.array(own))
        tf = np.diff(np.append(posting, len(term))).astype(np.int32)
        docs = pa.StructArray.from_arrays([take("at"), take("id"), pa.array(tf), take("length"), pa.ListArray.from_arrays(cut(posting, len(term)), pa.array(place))], ["at", "id", "tf", "length", "positions"])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(of[row])), pa.array(block[own[row]]), pa.ListArray.from_arrays(cut(row, len(posting)), docs)], ["term", "block", "docs"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, last = [], 0, -1
        for batch in batches:
            size = np.cumsum(pc.list_value_length(batch.column("words")).to_numpy().astype(np.int64))
            block, begun = batch.column("at").to_numpy() >> BLOCK_BITS, 0
            for at in np.flatnonzero(np.diff(block, prepend=last)).tolist():
                # A block begins, which one that goes on from the batch before does not: what is held may end.
                before = int(size[at - 1]) if at else 0
                if (held or at > begun) and words + before - (int(size[begun - 1]) if begun else 0) >= RUN:
                    yield one_run(_joined([*held, batch.slice(begun, at - begun)]))
                    held, words, begun = [], 0, at
            if batch.num_rows > begun:
                last = block[-1]
                held.append(batch.slice(begun))
                words += int(size[-1]) - (int(size[begun - 1]) if begun else 0)
        if held:
            yield one_run(_joined(held))

    return runs


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _lives(at: Column) -> Column:
    """Whether the bit of a text is not set in low and high, the marks of its block (null: none)."""
    bit = F.pmod(at, F.lit(1 << BLOCK_BITS)).cast("int")
    marks = F.coalesce(F.when(bit < 64, F.col("low")).otherwise(F.col("high")), F.lit(0).cast("long"))
    return F.getbit(marks, F.pmod(bit, F.lit(64))) == 0


def _new_name(state: dict) -> str:
    return f"s{state['version'] + 1}-{uuid.uuid4().hex[:12]}"

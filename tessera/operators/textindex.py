"""A stored inverted index, and the searches that it answers.

Postings lie in the order of their terms, so a question reads the row groups of
its own terms only: equal terms and beginnings of terms are pushed down to the
scan.  A posting carries the length of its text, so that a rank needs no join.
Everything stays in the JVM but the stems, which are looked up once for each
distinct word when an index is built, the grouping of a text's own words, and
the scores of a table of questions: postings of the terms asked for lie in groups
of about POSTINGS, dealt by text, and pass by the questions of a share; a task
keeps the k best of each, so that no row is made for a question and a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from tessera.functions.fulltext import ENGLISH_STOP, lexemes, places_by_word, porter2_udf, websearch, word_tokens, words_of
from tessera.sources.shared import exists, named_path, stored

K1, B, COVER = 1.2, 0.75, 0.1
#: A search line as alternatives: each a list of phrases, all of which a text has to hold; a phrase is a list of terms in a row.
Line = list[list[list[str]]]
#: Postings of a group and questions of a share about, and postings that are packed together.
POSTINGS, QUESTIONS, AT_ONCE = 1 << 21, 1 << 16, 1 << 17
#: A score that is a sum in another order.
SLACK = 1 - 1e-9


def _top(rows: DataFrame, score: str, key: str, k: int | None) -> DataFrame:
    return rows.orderBy(F.col(score).desc(), key).limit(k) if k else rows


def added_up(parts: Column) -> Column:
    """The sum of a text's few parts from small to large: texts of equal parts are equal to the last bit, whatever order rows come in."""
    return F.aggregate(F.sort_array(parts), F.lit(0.0), lambda total, x: total + x)


def by_term(part: Column, terms: list[str]) -> Column:
    """The same of rows of one text, one a term, without a list of rows."""
    return added_up(F.array(*[F.coalesce(F.max(F.when(F.col("term") == t, part)), F.lit(0.0)) for t in dict.fromkeys(terms)]))


class TextIndex:
    """postings (term, id, tf, length, positions) and totals (docs, words, one row) of texts."""

    def __init__(self, postings: DataFrame, totals: DataFrame, stem: bool) -> None:
        self.postings, self.totals, self.stem = postings, totals, stem

    @classmethod
    def of(cls, docs: DataFrame, key: str = "id", text: str | Column = "text", stem: bool = False, once: bool = False) -> TextIndex:
        """The index of docs, not stored: every question reads the texts.  With `stem`, stop words go and words become stems; `once` says that no id comes twice."""
        words = docs.select(F.col(key).alias("id"), word_tokens(text).alias("words")).select("id", F.size("words").alias("length"), "words")
        totals = words.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.col("length").cast("long")), F.lit(0).cast("long")).alias("words"))
        each = places_by_word(words)
        if stem:
            each = each.filter(~F.col("term").isin(ENGLISH_STOP)).withColumnRenamed("term", "word")
            each = each.join(each.select("word").distinct().withColumn("term", porter2_udf()("word")), "word")
        if stem or not once:
            # What comes from several words or texts is put together.
            each = each.groupBy("term", "id").agg(F.max("length").alias("length"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
        return cls(each.select("term", "id", F.size("positions").alias("tf"), "length", "positions"), totals, stem)

    @classmethod
    def read(cls, spark: SparkSession, path: str, stem: bool = False) -> TextIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals"), stem)

    def write(self, path: str) -> None:
        """Stores postings in the order of terms; totals come last and say that the index is whole."""
        # Adaptive execution splits the parts of frequent terms.
        dealt = self.postings.hint("rebalance", "term")
        dealt.sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        totals = self.totals
        if not self.stem:
            # Every word is a posting's: the texts are not cut again.
            words = self.postings.sparkSession.read.parquet(f"{path}/postings").agg(F.coalesce(F.sum(F.col("tf").cast("long")), F.lit(0).cast("long")).alias("words"))
            totals = totals.select("docs").crossJoin(words)
        totals.write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def stored(cls, docs: DataFrame, key: str = "id", text: str = "text", stem: bool = False) -> TextIndex:
        """The stored index of a table's files as they are now; built where there is none."""
        spark, name = docs.sparkSession, version_of(docs, f"{key} {text} {stem}")
        path = named_path(spark, f"textindex-{name}")
        if not exists(spark, f"{path}/totals/_SUCCESS"):
            once = docs.groupBy(key).count().filter("count > 1").isEmpty()
            cls.of(docs, key, text, stem, once).write(path)
        return cls.read(spark, path, stem)

    def terms(self, words: list[str]) -> list[str]:
        """The index's terms for words of a question."""
        return [x for w in words for x in (lexemes if self.stem else words_of)(w)]

    def bm25(self, terms: list[str], k: int | None = 40, prefix: bool = False) -> DataFrame:
        """id, score: BM25 of texts that hold a term, or a word that begins with it; inverse frequencies that fall to zero become tiny."""
        asked = [F.startswith("term", F.lit(t)) if prefix else F.col("term") == t for t in terms]
        found = self.postings.filter(reduce(or_, asked)).select("id", "term", "tf", "length")
        if prefix:
            # A word may begin with several of the terms.
            hits = F.explode(F.filter(F.array(*[F.when(a, F.lit(t)) for a, t in zip(asked, terms, strict=True)]), lambda x: x.isNotNull()))
            found = found.withColumn("term", hits).groupBy("id", "term").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
        seen = found.groupBy("term").agg(F.count("*").alias("with_term"))
        docs = F.col("docs")
        idf = F.ln((docs - F.col("with_term") + 0.5) / (F.col("with_term") + 0.5))
        # One row a term.
        weights = F.broadcast(seen.crossJoin(self.totals).select("term", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"), (F.col("words") / docs).alias("average")))
        tf, length = F.col("tf"), F.col("length")
        part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("average")))
        return _top(found.join(weights, "term").groupBy("id").agg(by_term(part, terms).alias("score")), "score", "id", k)

    def bm25_many(self, questions: DataFrame, k: int = 40) -> DataFrame:
        """question, id, score, rank: the k best texts for every question (question, terms), in one pass over the postings of all their terms.

        Texts without an id take no part.
        """
        spark = questions.sparkSession
        asked = stored(questions.select("question", F.explode(F.array_distinct("terms")).alias("term")), "asked")
        terms = stored(asked.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "terms")
        docs, seen = F.col("docs"), self.postings.select("term").join(terms, "term").groupBy("term", "number").agg(F.count("*").alias("with_term"))
        idf = F.ln((docs - F.col("with_term") + 0.5) / (F.col("with_term") + 0.5))
        # The totals are one row.
        weights = stored(seen.crossJoin(F.broadcast(self.totals)).select("term", "number", "with_term", F.when(idf > 0, idf).otherwise(1e-6).alias("idf")), "weights")
        whole, most = self.totals.first(), weights.agg(F.sum("with_term")).first()[0] or 0
        average = whole["words"] / whole["docs"] if whole["docs"] else 0.0

        slots = 4 * spark.sparkContext.defaultParallelism
        shares, groups = asked.select("question").distinct().count() // QUESTIONS + 1, max(slots, most // POSTINGS + 1)
        found = self.postings.filter("id is not null").select("term", "id", "tf", "length").join(weights.select("term", "number"), "term")
        found = found.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), "id", "number", "tf", "length")
        each = asked.join(weights, "term").groupBy("question").agg(F.collect_list("number").alias("numbers"), F.collect_list("idf").alias("idfs"))
        each = each.select(F.pmod(F.xxhash64("question"), F.lit(shares)).cast("int").alias("share"), "question", "numbers", "idfs")
        kinds = {"share": IntegerType(), "group": IntegerType(), "question": ArrayType(each.schema["question"].dataType), "sizes": ArrayType(IntegerType()), "idf": ArrayType(DoubleType()), "number": ArrayType(LongType()), "id": ArrayType(found.schema["id"].dataType), "tf": ArrayType(found.schema["tf"].dataType), "length": ArrayType(found.schema["length"].dataType)}
        schema = lambda *names: reduce(lambda row, c: row.add(c, kinds[c]), names, StructType().add("role", IntegerType()))
        left = each.mapInArrow(_packed_questions, schema("share", "question", "sizes", "number", "idf")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        right = found.mapInArrow(_packed_postings, schema("group", "id", "number", "tf", "length")).withColumns({"slot": F.pmod("group", F.lit(slots)), "share": F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))})
        both = left.unionByName(right, allowMissingColumns=True).withColumn("part", F.col("share") * slots + F.col("slot"))
        hit = StructType().add("question", each.schema["question"].dataType).add("id", found.schema["id"].dataType).add("score", DoubleType())
        scored = both.repartition(shares * slots, "part").sortWithinPartitions("part", "role", "group").select("part", "role", "group", "question", "sizes", "number", "idf", "id", "tf", "length").mapInArrow(_best_of(k, average), hit)
        best = Window.partitionBy("question").orderBy(F.col("score").desc(), "id")
        return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def places(self, terms: list[str]) -> DataFrame:
        """id and a column of positions for each term, p0, p1 and so on; null where a text lacks the term."""
        own = self.postings.filter(F.col("term").isin(terms))
        return own.groupBy("id").agg(*[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(terms)])

    def holding(self, must: list[str], exclude: list[str] = ()) -> DataFrame:
        """id of texts with all of some words and none of others; without any `must` there is nothing to begin with."""
        must, exclude = self.terms(list(must)), self.terms(list(exclude))
        terms = list(dict.fromkeys([*must, *exclude]))
        has = {t: F.col(f"p{i}").isNotNull() for i, t in enumerate(terms)}
        wanted = reduce(and_, [has[t] for t in must] + [~has[t] for t in exclude])
        return self.places(terms).filter(wanted).select("id")

    def rank(self, line: Line, exclude: list[list[str]] = (), k: int | None = 40) -> DataFrame:
        """id, score of texts that hold all phrases of one alternative and no excluded one, by the density of their covers.

        An alternative's covers are the shortest stretches with all its terms;
        those of several alternatives add up.
        """
        terms = list(dict.fromkeys(t for phrases in (*line, exclude) for p in phrases for t in p))
        line = [phrases for phrases in line if phrases]
        if not line:
            return self.postings.select("id", F.lit(0.0).alias("score")).limit(0)
        at = {t: F.col(f"p{i}") for i, t in enumerate(terms)}
        held = [reduce(and_, [_in_a_row([at[t] for t in p]) for p in phrases]) for phrases in line]
        scores = [F.when(h, covers([at[t] for t in dict.fromkeys(x for p in phrases for x in p)])).otherwise(0.0) for h, phrases in zip(held, line, strict=True)]
        rows = self.places(terms).withColumn("score", reduce(lambda a, b: a + b, scores)).filter(reduce(or_, held))
        if exclude:
            rows = rows.filter(~reduce(or_, [_in_a_row([at[t] for t in p]) for p in exclude]))
        return _top(rows.select("id", "score"), "score", "id", k)

    def search(self, text: str, k: int | None = 40) -> DataFrame:
        """The same for a search line: all words, phrases in quotes, `or` between alternatives, a leading minus."""
        alternatives, exclude = websearch(text, lexemes if self.stem else None)
        return self.rank(alternatives, exclude, k)


def _lists(columns: dict[str, pa.Array], order: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    """The columns in an order, cut into lists."""
    offsets = pa.array(np.append(cuts, len(order)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, c.take(pa.array(order))) for c in columns.values()]


def _packed_questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Role 0: the questions of a share, with the numbers and weights of their terms one question behind the other."""
    for batch in batches:
        share = batch.column("share").to_numpy()
        for one in np.unique(share):
            some = batch.filter(pa.array(share == one))
            numbers = some.column("numbers")
            columns = [some.column("question"), pa.array(np.diff(numbers.offsets.to_numpy()), pa.int32()), numbers.flatten(), some.column("idfs").flatten()]
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([one], pa.int32()), *[pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]], ["role", "share", "question", "sizes", "number", "idf"])


def _packed_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Role 1: postings of a group."""
    held, rows = [], 0

    def packed() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        columns = {c: whole.column(c).combine_chunks() for c in ("id", "number", "tf", "length")}
        group = whole.column("group").to_numpy()
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(cuts), np.int32)), pa.array(group[order][cuts], pa.int32()), *_lists(columns, order, cuts)], ["role", "group", *columns])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= AT_ONCE:
            yield packed()
            held, rows = [], 0
    if held:
        yield packed()


class _Group:
    """Postings of some texts, those of each term in the order of the texts' ids."""

    def __init__(self, held: list[tuple[np.ndarray, ...]], numbers: np.ndarray, idf: np.ndarray, average: float) -> None:
        ids, number, tf, length = (np.concatenate(c) for c in zip(*held, strict=True))
        self.ids, text = np.unique(ids, return_inverse=True)
        term = np.searchsorted(numbers, number)
        asked = (term < len(numbers)) & (numbers[term.clip(max=len(numbers) - 1)] == number)
        text, term, tf, length = text[asked], term[asked], tf[asked].astype(np.float64), length[asked].astype(np.float64)
        order = np.argsort(term * len(self.ids) + text, kind="stable")
        self.text, term, tf, length = text[order], term[order], tf[order], length[order]
        # As bm25() has it, operation by operation.
        self.part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
        self.start = np.searchsorted(term, np.arange(len(numbers) + 1))
        self.total = np.zeros(len(self.ids))

    def best(self, terms: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of texts that may be among the k best and reach a score, all that do at the least."""
        runs = [slice(self.start[t], self.start[t + 1]) for t in terms if self.start[t] < self.start[t + 1]]
        if not runs:
            return self.ids[:0], np.zeros(0)
        self.total[:] = 0
        for r in runs:
            self.total[self.text[r]] += self.part[r]
        which = np.flatnonzero(self.total >= max(least * SLACK, 1e-300))
        if len(which) > 4 * k:
            near = self.total[which]
            which = which[near >= np.partition(near, len(near) - k)[len(near) - k] * SLACK]
        parts = np.zeros((len(runs), len(which)))
        for row, r in zip(parts, runs, strict=True):
            at = np.searchsorted(self.text[r], which).clip(max=r.stop - r.start - 1)
            row[:] = np.where(self.text[r][at] == which, self.part[r][at], 0.0)
        # From small to large, as added_up() does.
        parts.sort(axis=0)
        score = np.zeros(len(which))
        for row in parts:
            score += row
        return self.ids[which], score


def _best_of(k: int, average: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """question, id, score: the k best texts of each question among the groups that pass by."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, asked, held, names, terms, numbers, idf = None, None, [], [], None, [], None, None
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def pass_by() -> None:
            one = _Group(held, numbers, idf, average)
            for i, own in enumerate(terms):
                ids, score = best.get(i, (one.ids[:0], np.zeros(0)))
                new, more = one.best(own, k, score[-1] if len(score) == k else 0.0)
                if len(new):
                    ids, score = np.concatenate([ids, new]), np.concatenate([score, more])
                    order = np.argsort(ids, kind="stable")
                    order = order[np.argsort(-score[order], kind="stable")][:k]
                    best[i] = ids[order], score[order]

        def results() -> Iterator[pa.RecordBatch]:
            some = list(best)
            for at in range(0, len(some), 1024):
                few = some[at : at + 1024]
                which = np.repeat(few, [len(best[i][0]) for i in few])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(which)), pa.array(np.concatenate([best[i][0] for i in few])), pa.array(np.concatenate([best[i][1] for i in few]))], ["question", "id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                part, role, of = (batch.column(c)[i].as_py() for c in ("part", "role", "group"))
                if held and (part, of) != (now, group):
                    pass_by()
                    held = []
                if part != now:
                    yield from results()
                    now, asked, names, best = part, [], None, {}
                group = of
                if role == 0:
                    asked.append([batch.column(c)[i].values for c in ("question", "sizes", "number", "idf")])
                    continue
                if not asked:
                    continue
                if names is None:
                    names, sizes, number, weight = (pa.concat_arrays(c) for c in zip(*asked, strict=True))
                    numbers, first = np.unique(number.to_numpy(), return_index=True)
                    idf = weight.to_numpy()[first]
                    terms = np.split(np.searchsorted(numbers, number.to_numpy()), np.cumsum(sizes.to_numpy())[:-1])
                held.append(tuple(batch.column(c)[i].values.to_numpy(zero_copy_only=False).copy() for c in ("id", "number", "tf", "length")))
        if held:
            pass_by()
        yield from results()

    return task


def _in_a_row(places: list[Column]) -> Column:
    """Whether positions of all terms are there, one after another; false where one is null."""
    found = reduce(and_, [p.isNotNull() for p in places])
    if len(places) > 1:
        found &= F.exists(places[0], lambda x: reduce(and_, [F.array_contains(p, x + i) for i, p in enumerate(places[1:], 1)]))
    return F.coalesce(found, F.lit(False))


def covers(places: list[Column]) -> Column:
    """The density of minimal covers: each adds COVER over one plus the other words in it.

    Positions of all terms in order pass by; a cover ends where the earliest
    of the last positions of each term moves on.
    """
    if len(places) == 1:
        return F.size(places[0]) * COVER

    def marked(i: int) -> Callable[[Column], Column]:
        return lambda x: F.struct(x.alias("at"), F.lit(i).alias("of"))

    marks = F.array_sort(F.flatten(F.array(*[F.transform(p, marked(i)) for i, p in enumerate(places)])))
    none = F.array(*[F.lit(-1)] * len(places))
    start = F.struct(none.alias("last"), F.lit(0.0).alias("total"), F.lit(-1).alias("begun"))

    def step(state: Column, mark: Column) -> Column:
        last = F.transform(state["last"], lambda x, i: F.when(i == mark["of"], mark["at"]).otherwise(x))
        first = F.array_min(last)
        new = (first >= 0) & (first > state["begun"])
        inside = 1.0 + mark["at"] - first - (len(places) - 1)
        return F.struct(last.alias("last"), F.when(new, state["total"] + COVER / inside).otherwise(state["total"]).alias("total"), F.when(new, first).otherwise(state["begun"]).alias("begun"))

    return F.aggregate(marks, start, step, lambda state: state["total"])


def version_of(docs: DataFrame, how: str) -> str:
    """A name for a table's files with their sizes and times."""
    spark, digest = docs.sparkSession, hashlib.sha256(how.encode())
    conf = spark._jsc.hadoopConfiguration()
    for file in sorted(docs.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(conf).getFileStatus(path)
        digest.update(f"{file} {status.getLen()} {status.getModificationTime()}\n".encode())
    return digest.hexdigest()[:20]

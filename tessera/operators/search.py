"""Retrieval: vector and full-text candidates, fused, deduplicated and filled in late."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.fulltext import any_or_all, lexemes, websearch, word_tokens
from tessera.functions.text import col
from tessera.functions.vectors import cosine, literal
from tessera.operators.textindex import TextIndex, by_term
from tessera.operators.vectorindex import VectorIndex
from tessera.plans.filters import And, Layout, Node, compile_filter
from tessera.plans.plan import Keywords
from tessera.sources.shared import stored

CANDIDATES, FUSION = 40, 60
K1, B = 1.2, 0.75


def top(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best, ties to the smaller key: one TakeOrdered, no full sort."""
    return rows.orderBy(F.col(score).desc(), key).limit(k)


def knn(rows: DataFrame, query: list[float], k: int = CANDIDATES, *, key: str = "id", vector: str = "embedding", where: Node = And(), layout: Layout | None = None) -> DataFrame:
    """key, similarity: the k rows nearest by cosine among those that a filter lets through."""
    scored = rows.filter(compile_filter(where, layout)).select(key, cosine(vector, literal(query)).alias("similarity"))
    return top(scored, "similarity", key, k)


def knn_many(rows: DataFrame, questions: DataFrame, k: int = CANDIDATES, *, key: str = "id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """question, key, similarity: for each of a stated set of questions (key, vector) the k nearest other rows.

    Questions go round in blocks; a task keeps the k best of its rows for each,
    and those meet once.
    """
    found, asked = [], questions.select(key, vector).orderBy(key).toLocalIterator()
    while some := list(islice(asked, block)):
        ids = np.array([r[0] for r in some], np.int64)
        unit = np.array([r[1] for r in some], np.float64)
        unit /= np.maximum(np.sqrt((unit * unit).sum(axis=1, keepdims=True)), 1e-300)
        found.append(rows.select(F.col(key).cast("long").alias(key), vector).mapInPandas(_best_of(ids, unit, k, key), f"question long, {key} long, similarity double"))
    if not found:
        return rows.select(F.lit(0).cast("long").alias("question"), F.col(key).cast("long").alias(key), F.lit(0.0).alias("similarity")).limit(0)
    window = Window.partitionBy("question").orderBy(F.col("similarity").desc(), key)
    return reduce(DataFrame.unionByName, found).withColumn("__n", F.row_number().over(window)).filter(F.col("__n") <= k).drop("__n")


def _best_of(ids: np.ndarray, unit: np.ndarray, k: int, key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"question": np.zeros(0, np.int64), key: np.zeros(0, np.int64), "similarity": np.zeros(0)})
        for batch in batches:
            batch = batch[batch.iloc[:, 1].notna()]
            if not len(batch):
                continue
            names, vectors = batch.iloc[:, 0].to_numpy(np.int64), np.array(batch.iloc[:, 1].tolist(), np.float64)
            size = np.sqrt((vectors * vectors).sum(axis=1))
            near = unit @ (vectors / np.maximum(size, 1e-300)[:, None]).T
            near[ids[:, None] == names] = -np.inf
            first = np.argsort(-near, axis=1, kind="stable")[:, : k + 1]
            new = pd.DataFrame({"question": np.repeat(ids, first.shape[1]), key: names[first].ravel(), "similarity": np.take_along_axis(near, first, axis=1).ravel()})
            held = pd.concat([held, new[new["similarity"] > -np.inf]]).sort_values(["question", "similarity", key], ascending=[True, False, True]).groupby("question").head(k)
        yield held

    return best


def above(rows: DataFrame, query: list[float], least: float = 0.25, k: int = 5, *, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The k nearest of at least a similarity."""
    scored = rows.select(key, cosine(vector, literal(query)).alias("similarity")).filter(F.col("similarity") >= least)
    return top(scored, "similarity", key, k)


def term_rows(docs: DataFrame, terms: list[str], *, key: str, text: str | Column, prefix: bool = False) -> DataFrame:
    """key, term, tf, length: occurrences of the query's terms; a prefix term counts all words that begin with it."""
    tokens = docs.select(key, word_tokens(text).alias("words"))
    match = (lambda w, t: F.startswith(w, F.lit(t))) if prefix else (lambda w, t: w == t)
    counted = [_counted(t, match) for t in terms]
    return tokens.select(key, F.size("words").alias("length"), F.explode(F.array(*counted)).alias("x")).select(key, "length", "x.term", "x.tf")


def _counted(term: str, match) -> Column:
    return F.struct(F.lit(term).alias("term"), F.size(F.filter("words", lambda w: match(w, term))).alias("tf"))


def bm25(docs: DataFrame, terms: list[str], k: int | None = CANDIDATES, *, key: str = "id", text: str | Column = "text", prefix: bool = False) -> DataFrame:
    """key, score: BM25 of documents that hold a term; inverse frequencies that fall to zero become tiny."""
    rows = term_rows(docs, terms, key=key, text=text, prefix=prefix)
    whole = rows.filter(F.col("term") == terms[0]).agg(F.count("*").alias("docs"), F.avg("length").alias("average"))
    seen = rows.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("with_term"))
    # One row, and one row a term.
    idf = F.ln((F.col("docs") - F.col("with_term") + 0.5) / (F.col("with_term") + 0.5))
    weights = F.broadcast(seen.crossJoin(whole).select("term", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"), "average"))
    tf, length = F.col("tf"), F.col("length")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("average")))
    scored = rows.filter("tf > 0").join(weights, "term").groupBy(key).agg(by_term(part, terms).alias("score"))
    return top(scored, "score", key, k) if k else scored


def holds(terms: Column, wanted: list[str], every: bool) -> Column:
    """Whether an array of terms holds all or any of those wanted."""
    if not wanted:
        return F.lit(True)
    tests = [F.array_contains(terms, w) for w in wanted]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests)


def lexical_filter(docs: DataFrame, keywords: Keywords, text: str | Column = "text") -> DataFrame:
    """Documents with every must term and no excluded one."""
    terms = F.array_distinct(word_tokens(text))
    kept = docs.filter(holds(terms, [w.lower() for w in keywords.must], True))
    return kept.filter(~holds(terms, [w.lower() for w in keywords.exclude], False)) if keywords.exclude else kept


def keyword_filter(docs: DataFrame, index: TextIndex, keywords: Keywords, key: str = "id") -> DataFrame:
    """The same by an index, whose terms may be stems; words of stop words only ask for nothing."""
    must, exclude = index.terms(list(keywords.must)), index.terms(list(keywords.exclude))
    if must:
        docs = docs.join(index.holding(keywords.must).withColumnRenamed("id", key), key, "left_semi")
    for word in keywords.exclude if exclude else ():
        if index.terms([word]):
            docs = docs.join(index.holding([word]).withColumnRenamed("id", key), key, "left_anti")
    return docs


def text_leg(index: TextIndex, keywords: Keywords, semantic: str) -> tuple[list[list[list[str]]], list[list[str]]]:
    """What the full-text leg asks for: any of the keywords, each with all its words, or else the question as a search line."""
    groups = any_or_all([*keywords.must, *keywords.should], False) if index.stem else [index.terms(w.split()) for w in (*keywords.must, *keywords.should)]
    return ([[[t] for t in g] for g in groups], []) if groups else websearch(semantic, lexemes if index.stem else None)


def ranked(rows: DataFrame, score: str, key: str, leg: str) -> DataFrame:
    """leg, key, rank of a short candidate list."""
    window = Window.partitionBy("leg").orderBy(F.col(score).desc(), key)
    return rows.withColumn("leg", F.lit(leg)).select("leg", key, F.row_number().over(window).alias("rank"))


def fuse(legs: list[DataFrame], key: str, k: int = FUSION) -> DataFrame:
    """key, score: reciprocal rank fusion, which needs no join."""
    union = reduce(DataFrame.unionByName, legs)
    return union.groupBy(key).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))


def best_per(rows: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """The best row of each group, ties to the smaller key."""
    window = Window.partitionBy(group).orderBy(F.col(score).desc(), key)
    return rows.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def hydrate(candidates: DataFrame, *tables: tuple[DataFrame, str]) -> DataFrame:
    """Text and names for the few candidates that are left: late materialisation."""
    out = candidates
    for table, key in tables:
        out = out.join(table, key)
    return out


def hybrid(chunks: DataFrame, query: list[float], keywords: Keywords, semantic: str, k: int = 8, *, where: Node = And(), layout: Layout | None = None, key: str = "id", section: str = "section_id", text: str = "text", index: TextIndex | None = None) -> DataFrame:
    """section, key, score: fused candidates of both legs under one filter, the best chunk of each section.

    `index` is the stored index of all chunks; without one the texts are read.
    The full-text leg ranks by cover density of stems.
    """
    index = index or TextIndex.of(chunks, key, text, stem=True)
    inside = keyword_filter(chunks.filter(compile_filter(where, layout)), index, keywords, key)
    legs = [ranked(knn(inside, query, key=key), "similarity", key, "vector")]
    line, exclude = text_leg(index, keywords, semantic)
    if any(line):
        found = index.rank(line, exclude, None).withColumnRenamed("id", key).join(inside.select(key), key, "left_semi")
        legs.append(ranked(top(found, "score", key, CANDIDATES), "score", key, "text"))
    fused = fuse(legs, key)
    # At most two lists of CANDIDATES.
    return top(best_per(chunks.select(key, section).join(F.broadcast(fused), key), section, "score", key), "score", key, max(1, min(30, k)))


def hybrid_many(vectors: VectorIndex, index: TextIndex, questions: DataFrame, k: int = 8, *, where: Node = And(), layout: Layout | None = None, exact: bool = False, itself: bool = False) -> DataFrame:
    """question, id, score, rank: fused candidates of both legs for a table of questions (question, vector, terms), each leg in one pass."""
    questions = stored(questions, "questions")
    near = vectors.knn_many(questions, CANDIDATES, key="question", vector="vector", where=where, layout=layout, exact=exact, itself=itself).select("question", F.col("key").alias("id"), "rank")
    worded = index.bm25_many(questions, CANDIDATES + (not itself))
    if not itself:
        # A question's own text takes no place.
        again = Window.partitionBy("question").orderBy("rank")
        worded = worded.filter("id != question").withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= CANDIDATES)
    fused = near.unionByName(worded.select("question", "id", "rank")).groupBy("question", "id").agg(F.sum(F.lit(1.0) / (FUSION + F.col("rank"))).alias("score"))
    best = Window.partitionBy("question").orderBy(F.col("score").desc(), "id")
    return fused.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def two_stage(documents: DataFrame, chunks: DataFrame, query: list[float], docs: int = 20) -> DataFrame:
    """Chunks of the documents with the nearest summaries; documents without a summary stay in."""
    first = knn(documents.filter("summary_embedding is not null"), query, docs, vector="summary_embedding").select("id")
    chosen = first.unionByName(documents.filter("summary_embedding is null").select("id"))
    return chunks.join(chosen.withColumnRenamed("id", "document_id"), "document_id", "left_semi")


def confidence(kind: Column | str, found: Column | str, missing: Column | str, notes: Column | str) -> Column:
    """high, medium or low: numbers by rows and missing months, passages by count; notes lower it a step."""
    kind, found, missing, notes = map(col, (kind, found, missing, notes))
    numeric = F.when(found == 0, 0).when(missing > 0, 1).otherwise(2)
    passages = F.when(found >= 3, 2).when(found >= 1, 1).otherwise(0)
    step = F.greatest(F.lit(0), F.when(kind == "numeric", numeric).otherwise(passages) - F.when(notes > 0, 1).otherwise(0))
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), step + 1)

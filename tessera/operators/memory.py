"""Search in the memory of entities and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clip, keywords
from tessera.operators.search import bm25
from tessera.operators.state import recall

TERMS, HITS = 12, 60


def index(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """id, kind, ref, text: what is searched, nodes by label and type, facts by label and text."""
    node = nodes.select(F.concat(F.lit("node:"), F.col("id").cast("string")).alias("id"), F.lit("node").alias("kind"), F.col("id").alias("ref"), F.concat_ws(" ", "label", "type").alias("text"))
    named = facts.join(nodes.select(F.col("id").alias("node_id"), "label"), "node_id")
    fact = named.select(F.concat(F.lit("fact:"), F.col("id").cast("string")).alias("id"), F.lit("fact").alias("kind"), F.col("id").alias("ref"), F.concat(F.col("label"), F.lit(": "), F.col("text")).alias("text"))
    return node.unionByName(fact)


def query_terms(nodes: DataFrame, query: str, names: tuple[str, ...] = ()) -> list[str]:
    """The first content words of a query."""
    return nodes.sparkSession.range(1).select(keywords(F.lit(query), names).alias("k")).head()["k"][:TERMS]


def search(nodes: DataFrame, facts: DataFrame, query: str, now: Column, k: int = 12, names: tuple[str, ...] = ()) -> DataFrame:
    """id, label, kind, text, score of the best facts; a query of fillers finds none."""
    terms = query_terms(nodes, query, names)
    rows = index(nodes, facts)
    if not terms:
        empty = rows.limit(0).select("kind", "ref", F.lit(0.0).alias("score"))
        return recall(empty, facts, nodes, now, k)
    # Words match by their beginning, so that a plural finds its singular's stem.
    stems = [t[:-1] if len(t) > 4 and t.endswith("s") else t for t in terms]
    hits = bm25(rows, stems, HITS, prefix=True).join(rows, "id").select("kind", "ref", "score")
    return recall(hits, facts, nodes, now, k)


def as_text(found: DataFrame, most: int = 600) -> DataFrame:
    """Lines for a prompt."""
    return found.select(F.format_string("- [%s] %s: %s", "kind", "label", clip("text", most)).alias("line"), "score").orderBy(F.col("score").desc()).select("line")

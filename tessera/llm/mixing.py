"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words.  Its documents first get the whole
copies that are certain.  Of the words that are left, documents get inclusion
probabilities in proportion to their size, and those that would pass 1 are
certain too.  The others are ranked by random odds over inclusion odds, and the
first in that order are taken until their words come nearest to what is left.

The constant of proportion follows from a histogram of sizes, the cut from a
histogram of ranks and the order within one bin of it, so no task sees a whole
source.  The bins grow in number with the rows.

Defined results: a null text has no words.  Null is a source, the last in
order.  Documents of no words take nothing; a table without words gives
targets of 0.  Equal ranks go by doc_id, so that reruns agree; rows that
repeat a doc_id share its draw.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Bins of ranks at least, and rows for each bin beyond.
BINS, ROWS = 1 << 10, 1 << 12
#: Sources whose figures are broadcast, about 60 bytes each.
FEW = 1 << 16


def uniform(doc_id: Column, seed: str = "") -> Column:
    """In (0, 1), the same for the same document: 48 bits of a digest."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """source, source_size, target of sizes (source, size), one row a source.

    Words are shared by weight; a source that would get more than `most` times
    its size gets that, and the excess is shared anew.  In the order of size
    over weight, the capped sources come first: the level is the first that
    the next source can bear.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    per = per.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("bears", F.col("cap") / F.col("weight"))
    filled = Window.orderBy("bears", F.col("source").asc_nulls_last())
    before, whole = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / heavy).withColumn("place", F.row_number().over(filled))
    per = per.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("bears"), F.col("level")), F.when(F.col("level") <= F.col("bears"), F.col("place"))).over(whole))
    return per.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def proportion(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """of, c, sure: inclusion probabilities are c times the size; documents that would pass 1 have `sure` words together.

    Sizes from the largest on are certain as long as what is left of `rest`,
    shared in proportion to size, would give them 1 or more.
    """
    sizes = sized.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = sizes.join(goal.select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of")))
    larger = Window.partitionBy("of").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("of").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    squares = F.col("n").cast("decimal(38,0)") * F.col("size").cast("decimal(18,0)") * F.col("size").cast("decimal(18,0)")
    steps = sizes.withColumn("sure", F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger), F.lit(0)).cast("double"))
    steps = steps.withColumn("c", (F.col("rest") - F.col("sure")) / F.sum(squares.cast("decimal(38,0)")).over(upto).cast("double"))
    first = F.max_by(F.struct("c", "sure"), "size")
    return steps.filter(F.col("c") * F.col("size") < 1).groupBy("of").agg(first.alias("first")).select(F.col("of").alias("of_odds"), "first.c", "first.sure")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = "") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, source, text)."""
    sized = written(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), uniform(F.col("doc_id"), seed).alias("u")), "sized")
    bins = max(BINS, 1 << (sized.count() // ROWS).bit_length())
    goal = written(targets(sized, weights, share, most), "targets")
    size, target = F.col("source_size").cast("double"), F.col("target")
    goal = goal.withColumn("whole", F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", target - F.col("whole") * size)
    # One row a source; while sources are few, documents meet theirs without a shuffle.
    near = F.broadcast if goal.limit(FEW + 1).count() <= FEW else lambda df: df
    goal = goal.join(proportion(sized, goal), F.col("source").eqNullSafe(F.col("of_odds")), "left").withColumnRenamed("source", "of")
    goal = written(goal.withColumn("left", F.col("rest") - F.col("sure")).select("of", "source_size", "target", "whole", "c", "left"), "odds")
    ranked = sized.join(near(goal), F.col("source").eqNullSafe(F.col("of")))
    p = F.col("p")
    ranked = ranked.withColumn("p", F.when(F.col("size") > 0, F.least(F.lit(1.0), F.coalesce(F.col("c") * F.col("size"), F.lit(1.0)))).otherwise(0.0))
    drawn = (p > 0) & (p < 1)
    ranked = ranked.withColumn("q", F.when(drawn, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))).withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * bins).cast("long"))
    words = ranked.filter("q is not null").groupBy("source", "left", "bin").agg(F.sum("size").alias("words"))
    below = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = words.withColumn("below", below).filter("below < left and below + words >= left")
    cut = cut.select(F.col("source").alias("of_cut"), F.col("bin").alias("cut"), "below")
    ranked = ranked.join(near(cut), F.col("source").eqNullSafe(F.col("of_cut")), "left")
    # In the bin of the cut the order itself decides.
    inside = F.col("bin") == F.col("cut")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("q", "u", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = ranked.filter(inside).withColumn("sampled", F.when(F.col("below") + run - F.col("size") / 2 < F.col("left"), 1).otherwise(0))
    before = F.coalesce(F.col("bin") < F.col("cut"), F.col("left") > 0)
    rest = ranked.filter(~F.coalesce(inside, F.lit(False))).withColumn("sampled", F.when((p == 1) | drawn & before, 1).otherwise(0))
    copies = (F.col("whole") + F.col("sampled")).cast("long")
    return rest.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Docs with every row as often as the mix takes it; rows alike in doc_id, source and size are taken alike."""
    keys = {"doc_id": "__id", "source": "__source", "size": "__size"}
    copies = mix(docs, **options).filter("copies > 0").groupBy(*keys).agg(F.max("copies").alias("__copies")).withColumnsRenamed(keys)
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & docs["source"].eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__size"))
    each = docs.withColumn("__own", size).join(copies, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return each.select(*[docs[c] for c in docs.columns])

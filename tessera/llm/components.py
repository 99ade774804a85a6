"""Connected components of a graph of links, by labels that shrink.

Every round a node takes the smallest label among its neighbours' and its own
and then the label of that node, so distances halve.  Rounds are written to
the shared folder; nothing but a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, settled, stored, written


def components(links: DataFrame) -> DataFrame:
    """node, label of links (src, dst); a label is the smallest node of its component.

    No links give no rows; repeated links and links of a node to itself change nothing.
    """
    return settled(lambda: _shrunk(links), "components")[0]


def _shrunk(links: DataFrame) -> DataFrame:
    spark = links.sparkSession
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = written(both.filter("src != dst").distinct(), "edges")
    labels, before = stored(edges.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("label")).withColumnRenamed("src", "node"), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("other")), "dst").groupBy("src").agg(F.min("other").alias("other"))
        step = labels.join(near, labels["node"] == near["src"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("other", "label")).alias("label"))
        step, between = stored(step, "step")
        jump = step.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = step.join(jump, step["label"] == jump["at"], "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        new, path = stored(new, "labels")
        drop(spark, before)
        drop(spark, between)
        if not new.filter("label != old").limit(1).count():
            return new.select("node", "label")
        labels, before = new.select("node", "label"), path

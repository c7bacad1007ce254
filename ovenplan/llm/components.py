"""Connected components of a link table by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ovenplan.llm.common import settled


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp): the smallest node that each linked node is connected with.

    Every round a node takes the smallest label among its own, its neighbours' and its label's label, so labels run along a chain
    in steps that double. Labels are written each round; a node with many links is combined before the shuffle.
    """
    both = settled(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .distinct(),
        "links",
    )
    labels = settled(both.groupBy("node").agg(F.min("other").alias("comp")).select("node", F.least("node", "comp").alias("comp")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        drawn = labels.join(seen, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        roots = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        labels = settled(drawn.join(roots, "comp").select("node", "was", F.col("root").alias("comp")), "labels")
        if labels.filter("was <> comp").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")

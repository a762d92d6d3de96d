"""Connected components of a table of links, on the executors: each round every vertex takes the smallest
label among its neighbours and then the label of its label, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in a table of links (a, b); label is the smallest id that links reach."""
    links = links.where("a is not null and b is not null and a <> b")
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = saved(lower, "labels")
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = saved(step.join(jump, "label", "left").select("id", "was", F.coalesce("next", "label").alias("label")), "labels")
        labels = after.select("id", "label")
        if after.where("label <> was").isEmpty():
            return labels

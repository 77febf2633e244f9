"""Connected components of links between ids, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (its least id) for every id that a link names. Nulls and loops are ignored; no links, no rows.

    Rounds join links with labels, so links are thinned first: an id that links to several lesser ids keeps the link to the
    least of them, which takes its links to the others over. Where all ids of a group share a few of them, as near copies do,
    that leaves about one link an id, however many there were. The lesser ids of one id meet in a task.

    Each round takes the least label among neighbours and then the label of that label, so that a chain of n links needs
    about log n rounds. Rounds are written to the shared folder.
    """
    one, other = F.col(a).cast("long"), F.col(b).cast("long")
    links = links.where(one != other).select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()
    links = links.select("b", F.col("a").alias("lesser"), F.min("a").over(Window.partitionBy("b")).alias("a"))
    links = links.select("a", F.when(F.col("lesser") == F.col("a"), F.col("b")).otherwise(F.col("lesser")).alias("b")).distinct()
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("near_id")).agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("id") == F.col("near_id")).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("jump_id"), F.col("label").alias("jump"))
        new = stored(least.join(jump, F.col("label") == F.col("jump_id"), "left").select("id", "old", F.least("label", F.coalesce("jump", "label")).alias("label")), "labels")
        if new.where("old <> label").isEmpty():
            return new.select("id", F.col("label").alias("component"))
        labels = new.select("id", "label")

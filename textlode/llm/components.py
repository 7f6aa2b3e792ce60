"""Connected components of a table of links, without gathering them anywhere."""

from pyspark.sql import DataFrame, functions as F

from . import shared


def components(links: DataFrame, a="a", b="b") -> DataFrame:
    """(v, label): for each end of a link the smallest end in its component.

    Each round every vertex takes the smallest label among its own and its neighbours', and then that label's label, so distances at least halve on
    paths of labels.  Rounds end when nothing changes; each is written to the checkpoint folder.  Hubs only meet partial aggregates and joins that
    Spark can split.  An empty table gives an empty table; self links and repeated links change nothing.
    """
    ends = shared.cut(links.select(F.col(a).alias("v"), F.col(b).alias("w")).unionAll(links.select(F.col(b).alias("v"), F.col(a).alias("w"))).distinct())
    label = shared.cut(ends.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("label")))
    while True:
        near = ends.join(label.select(F.col("v").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("near"))
        step = label.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = label.select(F.col("v").alias("label"), F.col("label").alias("far"))
        step = shared.cut(step.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        changed = step.filter("old <> label").limit(1).count()
        label = step.select("v", "label")
        if not changed:
            return label

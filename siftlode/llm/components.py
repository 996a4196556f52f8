"""Connected components of a link table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.shared import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable over undirected links ``a``-``b``.

    Each round takes the least label of the neighbours and then jumps to the label's own label, so
    chains shorten by doubling. Joins are on plain keys (AQE splits hot hubs), the minimum is combined
    before it is shuffled, and every round ends in a written table. Only the number of changed labels
    reaches the driver. Self links and repeated links do no harm; null ends are ignored. An empty link
    table gives an empty result.
    """
    e = edges.select(F.col(a).alias("s"), F.col(b).alias("d")).where("s is not null and d is not null and s <> d").distinct()
    e = written(e.unionAll(e.select(F.col("d").alias("s"), F.col("s").alias("d"))).distinct(), "links")
    labels = written(e.groupBy(F.col("s").alias("node")).agg(F.min("d").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        seen = e.join(labels.withColumnRenamed("node", "s"), "s").groupBy(F.col("d").alias("node")).agg(F.min("label").alias("m"))
        hooked = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(hooked.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")

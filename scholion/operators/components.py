"""Connected components by repeated smallest-label exchange with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.session import checkpoint


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``root``): every node of the edges with the smallest node it is linked to.

    Only a count leaves the executors. Each round takes the smallest label of
    all neighbours and then that label's own label, so long chains need few
    rounds; a hub's neighbours are pre-aggregated before the shuffle. Null ends
    are ignored; no edges give an empty table; repeated edges and loops do no
    harm.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = checkpoint(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = checkpoint(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).withColumnRenamed("x", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node", "left").select("node", "root", F.least("root", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("beyond"))
        new = checkpoint(step.join(jump, "to", "left").select("node", F.least("to", "beyond").alias("root"), (F.least("to", "beyond") < F.col("root")).alias("moved")))
        labels = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return labels

"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored_at


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for each end of a link; comp: the smallest node that can be reached.

    Every node takes the label that the smallest one among its own and its neighbours' has itself, until none changes.
    The labels of each round are written to the shared folder; nothing but a count comes to the driver.  The links are read
    in each round, so callers store them; repeated ones do no harm.
    """
    ends = links.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    spark = links.sparkSession
    ends = ends.union(ends.select("dst", "src")).where("src <> dst")
    labels, path = stored_at(ends.groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("comp")), "labels")
    while True:
        near = ends.join(labels.select(F.col("node").alias("dst"), "comp"), "dst")
        seen = labels.select("node", F.col("comp").alias("own"), "comp").union(near.select("src", F.lit(None), "comp"))
        least = seen.groupBy("node").agg(F.max("own").alias("own"), F.min("comp").alias("low"))
        beyond = labels.select(F.col("node").alias("low"), F.col("comp").alias("beyond"))  # not larger than its node
        new, new_path = stored_at(
            least.join(beyond, "low").select("node", F.col("beyond").alias("comp"), (F.col("beyond") < F.col("own")).alias("moved")),
            "labels",
        )
        discard(spark, path)
        labels, path = new.select("node", "comp"), new_path
        if new.where("moved").isEmpty():
            return labels

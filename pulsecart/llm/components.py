"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsecart.workspace import materialise, write_tasks

#: Rows to a file.
EACH = 200_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows of node and component (the least node reachable) for all nodes of the edges u, v.

    Every round takes the least label among a node's neighbours and then the label of that label.
    Rounds are written to the shared folder, so none depends on a lost executor. Nothing is gathered
    by node: joins can be split at hot nodes, and minima are taken before the shuffle. The tables of a
    round have about ``EACH`` rows in a file, however many partitions the shuffles have; for that
    the edges, a stored table, are counted.
    """
    tasks = write_tasks(edges.sparkSession, 2 * edges.count(), EACH)
    own = edges.where("u <> v").select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))
    both = materialise(own.union(own.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges", tasks)
    labels = materialise(
        both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label")),
        "labels", tasks,
    )
    for _ in range(most_rounds):
        near = (
            both.join(labels, both["u"] == labels["node"]).groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        )
        nearest = materialise(
            labels.join(near, "node").select("node", F.least("label", "near").alias("next"), "label"), "labels", tasks
        )
        onward = nearest.select(F.col("node").alias("at"), F.col("next").alias("onward"))
        jumped = materialise(
            nearest.join(onward, F.col("next") == F.col("at")).select(
                "node", F.col("onward").alias("label"), (F.col("onward") != F.col("label")).alias("moved")
            ),
            "labels", tasks,
        )
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

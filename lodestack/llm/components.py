"""Connected components of an edge table, by hooking and contraction, as distributed joins.

Each round every node takes the least of itself and its neighbours as its parent, follows that
parent's parent once, and edges move to the parents; edges within a component vanish. A parent is a
least value, made by a partial aggregate, so a node with very many edges is no task's burden, and
the relabelling joins may be split by adaptive execution. Rounds are cut by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): component is the least node of those that edges connect.

    Edges may repeat, run either way, or be loops; a null end makes no edge. No edges, no rows.
    """
    edges = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null"), "edges")
    label = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("b")).select(F.col("a").alias("node"), F.col("b").alias("parent")), "hooks")
        up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        hook = written(hook.join(up, "parent").select("node", F.col("above").alias("parent")), "hooks")
        for end in ("a", "b"):
            edges = edges.join(hook.withColumnsRenamed({"node": end, "parent": f"to_{end}"}), end)
        edges = written(edges.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        label = written(label.join(hook.withColumnsRenamed({"node": "component", "parent": "up"}), "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
    return label

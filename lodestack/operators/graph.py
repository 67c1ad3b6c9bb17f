"""Import graphs as edge tables (src, dst): neighbours, closures and cycles.

Closures of given roots and cycles grow by one edge a round as joins on the node; closures of all nodes
double their depth a round. Every round is cut from its lineage and keeps only what is new, so the
search ends when nothing is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rounds import cut


def dependencies(edges: DataFrame, module: str) -> DataFrame:
    return edges.where(F.col("src") == module).select("dst").distinct()


def dependents(edges: DataFrame, module: str) -> DataFrame:
    return edges.where(F.col("dst") == module).select("src").distinct()


def modules(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("module")).distinct()


def neighbours(edges: DataFrame, module: str) -> DataFrame:
    """(side, module): `dependencies` and `dependents` from one pass over the edges."""
    sides = [F.when(F.col(own) == module, F.struct(F.lit(side).alias("side"), F.col(other).alias("module"))) for side, own, other in (("dependency", "src", "dst"), ("dependent", "dst", "src"))]
    return edges.select(F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())).alias("x")).select("x.*").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("dst"))


def closure(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, node, depth): all nodes that lead from each root of `start` (root), at their least depth, itself left out; to the end, or so deep."""
    edges = cut(edges.select("src", "dst").distinct())
    edge = cut(start.select("root", F.col("root").alias("node")).distinct().withColumn("depth", F.lit(0)))
    seen, k = edge, 0
    while (depth is None or k < depth) and not edge.isEmpty():
        k += 1
        new = edge.join(edges, edge["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        edge = cut(new.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(edge)
    return seen.where("depth > 0")


def closures(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """`closure` of every node that leads anywhere, in as many rounds as the logarithm of the depth.

    What is between k and 2k deep lies up to k beyond a node exactly k deep, whose own closure to k is there already; so
    each round reads what was found before once, and a graph of depth 40 takes six. Nodes that lead nowhere, which
    many may share, are marked at the start and never joined on.
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    ends = edges.select("dst").distinct().join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti")
    found = cut(edges.join(ends.withColumn("end", F.lit(True)), "dst", "left").select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("depth"), F.col("end").isNull().alias("leads")))
    last, k = found, 1
    while (depth is None or k < depth) and not (edge := last.where(F.col("leads") & (F.col("depth") == k))).isEmpty():
        near = found.select(F.col("root").alias("via"), F.col("node").alias("to"), F.col("depth").alias("more"), "leads")
        steps = edge.select("root", F.col("node").alias("via")).join(near, "via").where("root <> to")
        new = steps.groupBy("root", F.col("to").alias("node")).agg((F.min("more") + k).alias("depth"), F.first("leads").alias("leads"))
        last, k = cut(new.join(found, ["root", "node"], "left_anti")), 2 * k
        found = found.unionByName(last)
    found = found.select("root", "node", "depth")
    return found if depth is None else found.where(F.col("depth") <= depth)


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """cycle: arrays of distinct nodes that lead back to the first, which is the smallest; one for each set of nodes.

    All simple cycles, or those of up to `longest` nodes. Nodes without a way in or out are on none and
    go first, round by round. Paths grow only over nodes above their first, so each cycle is met once
    for its smallest node.
    """
    edges, before = cut(edges.select("src", "dst").where("src <> dst").distinct()), -1
    while (n := edges.count()) != before:
        before = n
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = cut(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
    paths = edges.where("dst > src").select(F.array("src", "dst").alias("path"), F.col("src").alias("first"), F.col("dst").alias("last"))
    out, k = edges.where("false").select(F.array("src").alias("path")), 1
    while (longest is None or k < longest) and not paths.isEmpty():
        k += 1
        step = cut(paths.join(edges, F.col("last") == F.col("src")))
        out = out.unionByName(step.where("dst = first").select("path"))
        paths = step.where((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"), "first", F.col("dst").alias("last"))
    return out.groupBy(F.array_sort("path").alias("_set")).agg(F.min("path").alias("cycle")).select("cycle")

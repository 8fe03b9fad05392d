"""Connected components of a graph that may not fit in one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root: for the nodes of ``edges`` (a, b: long), the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows these
    pointers to their ends by doubling, and contracts the edges; the number of
    nodes at least halves. Every step is an aggregate with partial sums or a
    join with one row a key on one side, whose large keys adaptive execution
    can split; each round's tables are written, so lineage stays short.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while edges.head(1):
        both = edges.union(edges.select("b", "a")).toDF("node", "to")
        hook = materialize(both.groupBy("node").agg(F.least(F.min("to"), F.min("node")).alias("root")), "hooks")
        while True:
            up = hook.toDF("root", "above")
            jumped = materialize(hook.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "jumps")
            hook = jumped.select("node", "root")
            if not jumped.where("moved").head(1):
                break
        to_a, to_b = hook.toDF("a", "ra"), hook.toDF("b", "rb")
        edges = materialize(edges.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        found = hook if found is None else materialize(found.join(hook.toDF("root", "above"), "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
    return found if found is not None else edges.toDF("node", "root")

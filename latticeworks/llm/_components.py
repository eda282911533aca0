"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import new_folder


def written(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read again.

    Unlike checkpoint() this also drops the constraints that the optimizer has inferred, which grow with every round of an
    iteration until planning takes longer than the work.
    """
    folder = new_folder(rows.sparkSession, "rows")
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node that can be reached.

    Each round takes the least label among a node and its neighbours, then the label's own label, so paths halve; a round's
    result is written and read again.  The driver sees one count a round.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        pulled = labels.join(near, labels.node == near.a, "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        up = labels.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
        jumped = written(pulled.join(up, pulled.comp == up.n2, "left").select("node", "was", F.least("comp", F.coalesce("c2", "comp")).alias("comp")))
        moved = jumped.where("was <> comp").limit(1).count()
        labels = jumped.select("node", "comp")
        if not moved:
            return labels


def merged(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """comp (node, comp) of earlier edges, and of further ones (a, b): only the components that these join are worked on."""
    one, two = (comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp")) for c in ("a", "b"))
    ends = written(edges.select("a", "b").join(one, "a", "left").join(two, "b", "left"))
    fresh = ends.where("a_comp IS NULL").select("a").union(ends.where("b_comp IS NULL").select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("comp"))
    apart = ends.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).where("a <> b")
    up = components(apart).select(F.col("node").alias("was"), F.col("comp").alias("least"))
    nodes = comp.select("node", "comp").union(fresh)
    return written(nodes.join(up, nodes.comp == up.was, "left").select("node", F.coalesce("least", "comp").alias("comp")))

"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import join_unique
from .storage import delete, shared_path, written


def connected(edges: DataFrame) -> DataFrame:
    """node, label (least node of the component) of every node of ``edges`` (a, b: long).

    Each round maps every node to its least neighbour, twice over, and joins and dedups the
    edges under that map, until none is left. All tables stay distributed; each step of a round
    is written to the shared folder, so that no plan has more than one step's joins, whose
    number the driver keeps in memory with every task's figures, and a lost executor costs no
    more than the step it was in. What a round wrote for itself is deleted at its end. Nodes of
    very many edges, and labels of very many nodes, are joined apart from the others
    (`ranges.join_unique`).
    """
    spark, spent = edges.sparkSession, []

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = shared_path(spark, name)
        return written(df, name, path), path

    def step(df: DataFrame, name: str) -> DataFrame:
        """``df`` written until the round is over."""
        df, path = kept(df, name)
        spent.append(path)
        return df

    def mapped(rows: DataFrame, key: str, to: DataFrame, name: str, total: int) -> DataFrame:
        """``rows`` with what ``key`` is mapped to by ``to`` (node, m), or itself, as ``name``."""
        uses = rows.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("uses"))
        found = uses.join(to.hint("merge"), "node", "left").select(F.col("node").alias(key), F.coalesce("m", "node").alias(name), "uses")
        return join_unique(rows, step(found, "uses"), [key], "uses", total)

    edges, at = kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels, labels_at = kept(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    n_nodes = labels.count()
    while n_edges := edges.count():
        spent += [at, labels_at]
        both = edges.union(edges.select("b", "a"))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m"))
        to = step(to, "hooks")
        twice = step(mapped(to, "m", to, "mm", n_nodes).select("node", F.col("mm").alias("m")), "hooks")
        labels, labels_at = kept(mapped(labels, "label", twice, "to", n_nodes).select("node", F.col("to").alias("label")), "labels")
        half = step(mapped(edges, "a", twice, "x", n_edges).select("x", "b"), "links")
        left = mapped(half, "b", twice, "y", n_edges).where("x <> y")
        edges, at = kept(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        while spent:
            delete(spark, spent.pop())
    return labels

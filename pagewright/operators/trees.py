"""Trees of form fields and page dictionaries as node tables (node, parent, ...).

What a node has from its ancestors is found by doubling: each round joins a node's path so
far with the path of the node it has come to, so a tree of depth d takes about log2(d)
rounds. Each round is written to the shared folder, and the one before deleted. There is no bound on depth. Nodes below a cycle, or below
a parent that isn't there, aren't reached from a root and are left out (`unrooted` has them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import Rounds

#: How a path from an ancestor (``a_<name>``) and the one that begins below it (``<name>``) join.
Join = Callable[[Column, Column], Column]


def _doubled(nodes: DataFrame, state: dict[str, tuple[Column, Join]], inner: str | None = None) -> DataFrame:
    """node, up (null once a root is passed), depth and state of every node's longest path. Where
    ``inner`` names a state that is true of every node with nodes below it, only those are joined from above."""
    names, rounds, open_ = list(state), Rounds(nodes.sparkSession), F.col("up").isNotNull()
    paths, left = rounds.keep(nodes.select("node", F.col("parent").alias("up"), F.lit(0).alias("depth"), *[state[n][0].alias(n) for n in names]), open_)
    while left:
        above = (paths.where(inner) if inner else paths).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("a_depth"), *[F.col(n).alias(f"a_{n}") for n in names], F.lit(True).alias("there"))
        joined = paths.where(open_).join(above, "up", "left")
        # A path that ends in a parent that isn't there stays as it is.
        moved = joined.select(
            "node",
            F.when(F.col("there"), F.col("next")).otherwise(F.col("up")).alias("up"),
            F.when(F.col("there"), F.col("depth") + F.col("a_depth") + 1).otherwise(F.col("depth")).alias("depth"),
            *[F.when(F.col("there"), state[n][1](F.col(f"a_{n}"), F.col(n))).otherwise(F.col(n)).alias(n) for n in names],
        )
        before = left
        paths, left = rounds.keep(paths.where(~open_).unionByName(moved), open_)
        rounds.forget(rounds.n - 1)
        if left == before:  # a tree has nodes at every depth, so what is left has no root
            break
    return paths


def walk_down(nodes: DataFrame, state: dict[str, tuple[Column, Join]]) -> DataFrame:
    """node, depth and state of every node that a root (parent null) is above. ``state`` gives for
    each name a node's own value and how that of a path joins with the one above it."""
    return _doubled(nodes, state).where("up IS NULL").drop("up")


def walked_and_unrooted(nodes: DataFrame, state: dict[str, tuple[Column, Join]], inner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """`walk_down` and `unrooted` from the same rounds."""
    paths = _doubled(nodes, state, inner)
    return paths.where("up IS NULL").drop("up"), paths.where("up IS NOT NULL").select("node")


def unrooted(nodes: DataFrame) -> DataFrame:
    """Nodes that no root is above: in or below a cycle, or below a parent that isn't there."""
    return _doubled(nodes, {}).where("up IS NOT NULL").select("node")


def nearest(above: Column, own: Column) -> Column:
    return F.coalesce(own, above)


def dotted(above: Column, own: Column) -> Column:
    """Names joined by a dot, empty ones left out."""
    return F.when(own == "", above).when(above == "", own).otherwise(F.concat(above, F.lit("."), own))


def field_names(nodes: DataFrame) -> DataFrame:
    """Node, full dotted name, inherited type and depth of each field (node, parent, part, type)."""
    return walk_down(nodes, {"name": (F.coalesce("part", F.lit("")), dotted), "kind": (F.col("type"), nearest)})


def terminals(nodes: DataFrame, named: DataFrame) -> DataFrame:
    """Fields without children."""
    return named.join(nodes.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct(), "node", "left_anti")


def inherited(nodes: DataFrame, key: str) -> DataFrame:
    """Node and the value of ``key`` of itself or its nearest ancestor that has one."""
    return walk_down(nodes, {"value": (F.col(key), nearest)}).select("node", "value")


def with_live_descendant(nodes: DataFrame, live: DataFrame) -> DataFrame:
    """Nodes that are live or above a live one, each once.

    By doubling: who is within 2^k steps above a live node is so within 2^(k+1) steps if it
    is 2^k steps above one that is.
    """
    rounds = Rounds(nodes.sparkSession)
    found, n = rounds.keep(live.select("node").distinct())
    hops, _ = rounds.keep(nodes.where("parent IS NOT NULL").select("node", F.col("parent").alias("up")))
    while True:
        above = hops.join(found, "node", "left_semi").select(F.col("up").alias("node"))
        before = n
        found, n = rounds.keep(found.union(above).distinct())
        # Nothing new within 2^k steps of what is known means nothing new further up.
        if n == before:
            return found
        done = rounds.n - 2
        hops, twice = rounds.keep(hops.join(hops.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")))
        if not twice:
            return found
        rounds.forget(done)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of a graph (src, dst) that can be reached from the roots (node): level by level,
    each node once, until a level is empty."""
    rounds = Rounds(edges.sparkSession)
    (found, n), level = rounds.keep(roots.select("node").distinct()), roots.select("node").distinct()
    while n:
        level, n = rounds.keep(edges.join(level.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti"))
        if n:
            found, _ = rounds.keep(found.union(level))
    return found

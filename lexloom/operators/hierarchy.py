"""Parent-child links to full hierarchies, by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.tables import Shelf


def parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, parent)`` of every distinct non-null node id; parent is null for a root.

    Links that are null, repeated, or whose ends aren't nodes don't count; should a
    node have several parents, the smallest id is taken.
    """
    ids = nodes.select("id").where("id is not null").distinct()
    links = (
        edges.select(F.col("child"), F.col("parent"))
        .where("child is not null and parent is not null")
        .distinct()
        .join(ids.select(F.col("id").alias("parent")), "parent", "left_semi")
        .groupBy("child")
        .agg(F.min("parent").alias("parent"))
    )
    return ids.join(links, ids.id == links.child, "left").select("id", "parent")


def hierarchy(nodes: DataFrame, edges: DataFrame, with_paths: bool = True) -> DataFrame:
    """Root and depth of every node of a forest, and the nodes that have no root.

    ``nodes`` has a column ``id``; ``edges`` has ``child`` and ``parent``; further
    columns are ignored. Returns ``id, parent, root, depth, cyclic`` and, with paths,
    ``path`` (ids from the root down to the node). For a node on a cycle or below
    one, ``cyclic`` is true, ``root`` is the smallest id on that cycle, ``depth`` and
    ``path`` are null. A node may be its own parent (a cycle of one). Null ids and
    links to or from absent nodes don't count; repeated rows count once; empty
    tables give an empty result.

    Method: each unresolved node holds a pointer to an ancestor and joins it with
    that ancestor's own pointer, so distances double; pointers that meet a resolved
    node are resolved. A node of depth d is resolved in round log2(d)+1, and depths
    have no holes, so a round that resolves nothing leaves only cycles and what hangs
    below them. A round writes the rows it moved only; what is resolved stays where it
    was written. Hot parents are split by AQE's skew join: every round ends in a written
    table, so nothing above the join asks for its partitioning.
    """
    spark = nodes.sparkSession
    shelf = Shelf(spark, "hierarchy")
    at_root = F.col("parent").isNull()
    start = parents(nodes, edges).select(
        "id",
        "parent",
        F.coalesce("parent", "id").alias("anc"),
        F.when(at_root, 0).otherwise(1).alias("dist"),
        at_root.alias("done"),
        *([F.when(at_root, F.array().cast("array<string>")).otherwise(F.array("id")).alias("segs")] if with_paths else []),
    )
    state, _ = shelf.put(start)
    resolved, open_ = [state.where("done")], state.where("not done")
    todo = open_.count()
    while todo:
        c, p = open_.alias("c"), reduce(DataFrame.unionByName, [*resolved, open_]).alias("p")
        moved, _ = shelf.put(
            c.join(p, F.col("c.anc") == F.col("p.id")).select(
                "c.id",
                "c.parent",
                F.col("p.anc").alias("anc"),
                (F.col("c.dist") + F.col("p.dist")).alias("dist"),
                F.col("p.done").alias("done"),
                *([F.concat("c.segs", "p.segs").alias("segs")] if with_paths else []),
            )
        )
        resolved.append(moved.where("done"))
        open_ = moved.where("not done")
        left = open_.count()
        if left == todo:
            break
        todo = left
    done = reduce(DataFrame.unionByName, resolved).select(
        "id",
        "parent",
        F.col("anc").alias("root"),
        F.col("dist").alias("depth"),
        F.lit(False).alias("cyclic"),
        *([F.reverse(F.concat("segs", F.array("anc"))).alias("path")] if with_paths else []),
    )
    if not todo:
        return done
    cyclic = _cycles(spark, shelf, open_.select("id", "parent")).select(
        "id",
        "parent",
        "root",
        F.lit(None).cast("int").alias("depth"),
        F.lit(True).alias("cyclic"),
        *([F.lit(None).cast("array<string>").alias("path")] if with_paths else []),
    )
    return done.unionByName(cyclic)


def _cycles(spark: SparkSession, shelf: Shelf, links: DataFrame) -> DataFrame:
    """``(id, parent, root)``: the smallest id on the cycle that each node's links lead into.

    The image of the doubled jump shrinks to the nodes on cycles and then stays as
    large as it is; on those, the smallest id within the doubled window is final once
    a round changes none.
    """
    jumps, place = shelf.put(links.select("id", "parent", F.col("parent").alias("jump")))
    size = jumps.select("jump").distinct().count()
    while True:
        a, b = jumps.alias("a"), jumps.alias("b")
        jumps_2, place_2 = shelf.put(a.join(b, F.col("a.jump") == F.col("b.id")).select("a.id", "a.parent", "b.jump"))
        size_2 = jumps_2.select("jump").distinct().count()
        shelf.drop(place)
        jumps, place = jumps_2, place_2
        if size_2 == size:
            break
        size = size_2
    on = jumps.select(F.col("jump").alias("id")).distinct()
    ring, place_r = shelf.put(links.join(on, "id", "left_semi").select("id", F.col("parent").alias("next"), F.least("id", "parent").alias("least")))
    while True:
        a, b = ring.alias("a"), ring.alias("b")
        step = a.join(b, F.col("a.next") == F.col("b.id")).select("a.id", "b.next", F.least("a.least", "b.least").alias("least"), (F.col("b.least") < F.col("a.least")).alias("changed"))
        ring_2, place_2 = shelf.put(step)
        changed = ring_2.where("changed").limit(1).count()
        shelf.drop(place_r)
        ring, place_r = ring_2, place_2
        if not changed:
            break
    return jumps.join(ring.select(F.col("id").alias("jump"), F.col("least").alias("root")), "jump").select("id", "parent", "root")


def descendants(tree: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)`` for every node below every node, from ``hierarchy``'s paths.

    Nodes on or below a cycle have no path and give no rows. Each row is unfolded from
    the descendant's own path, so no ancestor's group is ever gathered.
    """
    return tree.where("path is not null").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor")).where("at < depth").select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))

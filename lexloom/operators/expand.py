"""Lookups and expansion along the graph's edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.urns import canonical_target
from lexloom.tables import Shelf


def citations(edges: DataFrame, expressions: DataFrame) -> DataFrame:
    """``(source_id, id)``: chunks that a chunk cites, directly or as chunks of the act it cites.

    Distinct; links to nothing give no row.
    """
    cites = edges.where("type = 'CITES' and target_id <> ''").select("source_id", canonical_target(F.col("target_id")).alias("target_id")).distinct()
    direct = cites.join(expressions.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", F.col("target_id").alias("id"))
    by_act = cites.join(expressions.select(F.col("work_urn").alias("target_id"), "id"), "target_id").select("source_id", "id")
    return direct.unionByName(by_act).distinct()


def cited(seeds: DataFrame, edges: DataFrame, expressions: DataFrame, hops: int = 1, most: int = 10) -> DataFrame:
    """``(query_id, id, hop)``: chunks reached from the seeds (``query_id, id``) in up to ``hops`` citations.

    Each at its least distance, seeds left out; a query gets the first ``most`` by hop and
    id, a report's length. Cycles end, as a chunk is taken up once. Null ids don't count.

    Of a cited act only so many chunks are met, in the order of their ids, as can come
    among the first ``most`` after those the query has already; a query goes on from those
    it keeps, as whoever has ``most`` needs no further hop. So no act's citations meet all
    of its chunks, and what a hop yields is bounded by ``most`` a query and act.
    """
    shelf = Shelf(seeds.sparkSession, "cited")
    links = edges.where("type = 'CITES' and target_id <> '' and source_id is not null").select(F.col("source_id").alias("id"), canonical_target(F.col("target_id")).alias("target"))
    own = expressions.where("id is not null").select("id", F.col("work_urn").alias("target"))
    level = seeds.where("query_id is not null and id is not null").select("query_id", "id").distinct().withColumn("hop", F.lit(0))
    seen = level
    by_id = Window.partitionBy("query_id").orderBy("id")
    for hop in range(1, hops + 1):
        reached, _ = shelf.put(level.join(links, "id").select("query_id", "target").distinct())
        direct = reached.join(own.select(F.col("id").alias("target")), "target", "left_semi").select("query_id", F.col("target").alias("id"))
        acts = reached.join(own.select("target").distinct(), "target", "left_semi")
        had = seen.join(own, "id").groupBy("query_id", "target").agg(F.count("*").alias("had"))
        need, _ = shelf.put(acts.join(had, ["query_id", "target"], "left").select("query_id", "target", (F.coalesce("had", F.lit(0)) + most).cast("int").alias("need")))
        deepest = need.agg(F.max("need")).first()[0] or 0
        first = own.withColumn("at", F.row_number().over(Window.partitionBy("target").orderBy("id"))).where(F.col("at") <= deepest)
        by_act = need.select("query_id", "target", F.explode(F.sequence(F.lit(1), "need")).alias("at")).join(first, ["target", "at"]).select("query_id", "id")
        fresh = direct.unionByName(by_act).distinct().join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti")
        level, _ = shelf.put(fresh.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= most).select("query_id", "id", F.lit(hop).alias("hop")))
        seen = seen.unionByName(level)
    order = Window.partitionBy("query_id").orderBy("hop", "id")
    return seen.where("hop > 0").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, parent_id, grandparent_id)`` by one and two PART_OF steps; null where there is none."""
    link = edges.where("type = 'PART_OF'").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("parent_id"))
    up = link.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("grandparent_id"))
    return nodes.select("id").distinct().join(link, "id", "left").join(up, "parent_id", "left").select("id", "parent_id", "grandparent_id")

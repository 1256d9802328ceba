"""Upserts into the graph's tables, and checks of them.

Tables carry the time a row came in; an upsert is an aggregate over all rows of a key,
so loading anything twice changes nothing. Ties in time are settled by a hash of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(rows: DataFrame, key: str, at: str, first: tuple[str, ...] = (), last: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: of ``first`` the values of the earliest row, of ``last`` the latest that isn't null.

    Null keys are dropped. One aggregate with map-side combine; rows of one time are
    ranked by the hash of their values.
    """
    kinds = dict(rows.dtypes)
    plain = lambda c: F.to_json(c) if "map<" in kinds[c] else F.col(c)  # noqa: E731 maps can't be hashed
    aggs: list[Column] = []
    if first:
        aggs.append(F.min_by(F.struct(*first), F.struct(at, F.xxhash64(*map(plain, first)))).alias("f"))
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(at), F.xxhash64(plain(c))))).alias(c) for c in last]
    out = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    return out.select(key, *(F.col(f"f.{c}").alias(c) for c in first), *last)


def works(rows: DataFrame) -> DataFrame:
    """Acts by URN: what came first stays."""
    return upsert(rows, "urn", "ingested_at", tuple(c for c in rows.columns if c not in ("urn", "ingested_at")))


def expressions(nodes: DataFrame, acts: DataFrame) -> DataFrame:
    """Text chunks of known acts: texts as they came first, the embedding as it came last."""
    own = nodes.where("type = 'EXPRESSION'").join(acts.select(F.col("urn").alias("work_urn")), "work_urn", "left_semi")
    return upsert(own, "id", "ingested_at", ("work_urn", "eid", "text_display", "tag_name"), ("embedding",))


def structurals(nodes: DataFrame, acts: DataFrame) -> DataFrame:
    """Structural units of known acts, as they came first."""
    own = nodes.where("type = 'STRUCTURAL'").join(acts.select(F.col("urn").alias("work_urn")), "work_urn", "left_semi")
    return upsert(own, "id", "ingested_at", ("work_urn", "eid", "tag_name"))


def links(edges: DataFrame, ids: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Distinct ``(source_id, target_id, type)`` whose ends are both among ``ids`` (``id``)."""
    own = edges.where(F.col("type").isin(*types)).select("source_id", "target_id", "type").distinct()
    return own.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "type")


def topic_links(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``(source_id, target_id, score)`` of topics; the score that came last counts, topics need no row of their own."""
    own = edges.where("type = 'HAS_TOPIC' and target_id <> ''").join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return own.groupBy("source_id", "target_id").agg(F.max_by("score", F.struct("ingested_at", "edge_id")).alias("score"))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their number: what a uniqueness constraint would refuse."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def without_parent(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """Distinct ids of nodes of a kind that have no PART_OF edge."""
    return nodes.where((F.col("type") == kind) & F.col("id").isNotNull()).select("id", "level").distinct().join(edges.where("type = 'PART_OF'").select(F.col("source_id").alias("id")), "id", "left_anti")


def documents_without_structure(nodes: DataFrame) -> DataFrame:
    """Acts that have nodes but no STRUCTURAL one."""
    return nodes.groupBy("work_urn").agg(F.bool_or(F.col("type") == "STRUCTURAL").alias("structured"), F.count("*").alias("nodes")).where("not structured").select("work_urn", "nodes")


def unnamed(acts: DataFrame) -> DataFrame:
    """Distinct URNs that name no act: empty or unknown ones, and those made of a hash."""
    return acts.where("urn in ('', 'urn:', 'urn:unknown') or urn like 'urn:fallback:%'").select("urn").distinct()


def embedding_gaps(nodes: DataFrame) -> DataFrame:
    """``(tag_name, missing, embedded)``: text chunks without and with a vector."""
    own = nodes.where("type = 'EXPRESSION'")
    return own.groupBy("tag_name").agg(F.count_if(F.col("embedding").isNull()).alias("missing"), F.count("embedding").alias("embedded"))

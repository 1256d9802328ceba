"""Fusion of search channels: weighted reciprocal ranks, validity marks, merging per act."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What marks a text that is no longer in force (fixed value).
MARK = "[ATTENZIONE: NORMA ABROGATA]\n"
#: Context of a piece merged from several (fixed value).
MERGED = "MULTIPLE_CHUNKS"


#: Names of the settings in an environment (fixed values).
NAMES = {
    "top_k": ("RAG_TOP_K", int),
    "vector": ("RRF_WEIGHT_VECTOR", float),
    "bm25": ("RRF_WEIGHT_BM25", float),
    "graph": ("RRF_WEIGHT_GRAPH", float),
    "rrf_k": ("RRF_K", int),
    "hops": ("MAX_CITATION_HOPS", int),
}


def environment(file: str = ".env") -> dict[str, str]:
    """The process's environment, on top of the lines NAME=VALUE of a file, if there is one."""
    own: dict[str, str] = {}
    if os.path.exists(file):
        with open(file, encoding="utf-8") as lines:
            for line in lines:
                name, sign, value = line.strip().partition("=")
                if sign and not name.startswith("#"):
                    own[name.removeprefix("export ").strip()] = value.strip().strip("'\"")
    return own | dict(os.environ)


@dataclass(frozen=True)
class Settings:
    top_k: int = 10
    final_k: int = 5
    vector: float = 0.8
    bm25: float = 1.5
    graph: float = 1.0
    rrf_k: int = 60
    hops: int = 1
    expand: int = 10

    @classmethod
    def of(cls, names: Mapping[str, str], **given: int) -> Settings:
        """Settings from an environment; what is missing or unreadable keeps its default, what is given goes before."""
        read = {}
        for field, (name, kind) in NAMES.items():
            try:
                read[field] = kind(names[name])
            except (KeyError, ValueError):
                continue
        return cls(**read | given)

    @property
    def weights(self) -> dict[str, float]:
        return {"vector": self.vector, "bm25": self.bm25, "graph": self.graph}


CHANNELS = ("vector", "bm25", "graph")


def fuse(hits: DataFrame, settings: Settings) -> DataFrame:
    """``(query_id, id, score, source, place)``: weighted reciprocal rank fusion.

    ``hits`` has ``query_id, id, channel, rank`` (from 1). The score is the sum of
    weight / (k + rank); ``source`` the channels, sorted, joined by '+'; ``place`` ranks by
    score, ties by the first channel (vector, bm25, graph), then by the rank in it, then
    by id. A hit given twice in a channel counts once, with its best rank.
    """
    w, first = F.lit(0.0), F.lit(len(CHANNELS))
    for n, c in enumerate(CHANNELS):
        w = F.when(F.col("channel") == c, settings.weights[c]).otherwise(w)
        first = F.when(F.col("channel") == c, n).otherwise(first)
    once = hits.groupBy("query_id", "id", "channel").agg(F.min("rank").alias("rank"))
    fused = once.groupBy("query_id", "id").agg(
        F.sum(w / (settings.rrf_k + F.col("rank"))).alias("score"),
        F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("source"),
        F.min(F.struct(first.alias("c"), "rank")).alias("seen"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "seen.c", "seen.rank", "id")
    return fused.withColumn("place", F.row_number().over(order)).drop("seen")


def mark(text: Column, end: Column, reference: Column) -> Column:
    """``text`` with the mark before it if its validity ended before the day of reference and it has none yet."""
    return F.when((end < reference) & ~text.startswith(MARK), F.concat(F.lit(MARK), text)).otherwise(text)


def in_force(start: Column, end: Column, day: Column) -> Column:
    """Whether a day lies in the validity; an open or unknown side doesn't limit it."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (end >= day))


def work_key(title: Column, urn: Column, ident: Column) -> Column:
    """What chunks of one act share: its title, else its URN if known, else nothing but themselves."""
    known = F.when(~urn.isin("urn:unknown", ""), urn)
    return F.coalesce(F.nullif(title, F.lit("")), known, ident)


def merge(chunks: DataFrame) -> DataFrame:
    """Chunks of one act as one result per query.

    ``chunks`` has ``query_id, id, text, context, score, source, place, work_key``. A
    single chunk stays as it is. Several are put in the order of context and place, each
    text under its context if it has one; the id is ``merged_`` and the first's, the score
    the greatest, the source all channels, the context says so, and ``members`` lists the
    chunks. ``place`` ranks the results anew. The chunks are those of a cut list, a few a
    query, so the groups are small.
    """
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("context", F.lit("")).alias("context"), "place", "id", F.coalesce("text", F.lit("")).alias("text"))))
    by = chunks.groupBy("query_id", "work_key").agg(order.alias("m"), F.max("score").alias("score"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("source", r"\+"))))), "+").alias("source"), F.min("place").alias("at"))
    piece = lambda x: F.when(x["context"] == "", x["text"]).otherwise(F.concat(F.lit("--- "), x["context"], F.lit(" ---\n"), x["text"]))
    one = F.size("m") == 1
    first = F.element_at("m", 1)
    merged = by.select(
        "query_id",
        F.when(one, first["id"]).otherwise(F.concat(F.lit("merged_"), first["id"])).alias("id"),
        F.when(one, first["text"]).otherwise(F.array_join(F.transform("m", piece), "\n\n")).alias("text"),
        F.when(one, first["context"]).otherwise(F.lit(MERGED)).alias("context"),
        "score",
        "source",
        "work_key",
        F.transform("m", lambda x: x["id"]).alias("members"),
        "at",
    )
    rank = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "at")
    return merged.withColumn("place", F.row_number().over(rank)).drop("at")

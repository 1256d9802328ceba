"""Retrieval: queries against chunks by vector, words and topics, fused, marked, merged and extended along citations."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.urns import known_urn
from lexloom.operators import expand, fusion, search, store, topics
from lexloom.operators.enrich import Provider, chunks
from lexloom.operators.fusion import Settings
from lexloom.tables import Shelf


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Graph:
    """What is searched: chunks with their act's data, context, topics, citations, thesaurus."""

    chunks: DataFrame
    topic_links: DataFrame
    edges: DataFrame
    labels: DataFrame
    broader: DataFrame


def build(works: DataFrame, nodes: DataFrame, edges: DataFrame, concepts: DataFrame, broader: DataFrame) -> Graph:
    """The graph of the tables as they were loaded, each key once.

    Chunks and topic links are written, as every channel reads them.
    """
    shelf = Shelf(nodes.sparkSession, "graph")
    acts = store.works(works)
    own = store.expressions(nodes, acts)
    parent = edges.where("type = 'PART_OF'").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("parent_id"))
    tag = store.upsert(nodes, "id", "ingested_at", ("tag_name",)).toDF("parent_id", "context")
    listed = chunks(own, acts).join(parent, "id", "left").join(tag, "parent_id", "left").withColumn("context", F.coalesce("context", F.lit("articolo"))).withColumn("urn", known_urn(F.col("work_urn"), F.col("text_display")))
    kept, _ = shelf.put(listed)
    links, _ = shelf.put(store.topic_links(edges, kept.select("id")))
    return Graph(kept, links, edges, topics.dictionary(concepts), broader)


def ask(spark: SparkSession, questions: list[tuple[str, str]], provider: Provider) -> DataFrame:
    """Queries ``(query_id, text, vector)``; if the provider fails they have no vector, and so no vector channel."""
    try:
        vectors = [[float(x) for x in v] for v in provider([t for _, t in questions])]
        rows = [(i, t, v) for (i, t), v in zip(questions, vectors, strict=True)]
    except Exception:  # noqa: BLE001 a provider may fail in any way
        log.exception("questions have no vectors")
        rows = [(i, t, None) for i, t in questions]
    return spark.createDataFrame(rows, "query_id string, text string, vector array<double>")


def analyze(graph: Graph, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (``query_id, text``) with the labels found in them appended, and ``(query_id, concept_id)`` with narrower concepts."""
    shelf = Shelf(queries.sparkSession, "analysis")
    found, _ = shelf.put(topics.match(queries.select(F.col("query_id").alias("id"), "text"), graph.labels).withColumnRenamed("id", "query_id"))
    labels = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("concept_id", "label"))), lambda x: x["label"]), " ").alias("labels"))
    widened = queries.join(labels, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "labels").alias("text"))
    below = found.select("query_id", F.col("concept_id").alias("parent_id")).join(graph.broader.distinct(), "parent_id").select("query_id", F.col("child_id").alias("concept_id"))
    return widened, found.select("query_id", "concept_id").unionByName(below).distinct()


def channels(graph: Graph, queries: DataFrame, settings: Settings) -> DataFrame:
    """``(query_id, id, channel, rank)`` of all channels; a query without a vector or without topics lacks that channel.

    Each channel's lists, ``top_k`` rows a query, are written on their own: one that fails
    is reported and gives none, and the others go on.
    """
    words, concepts = analyze(graph, queries)
    ways: dict[str, Callable[[], DataFrame]] = {
        "vector": lambda: search.vector_top_k(graph.chunks, queries.select("query_id", "vector"), "id", "embedding", settings.top_k),
        "bm25": lambda: search.bm25_top_k(graph.chunks, words, "id", "text_display", settings.top_k),
        "graph": lambda: search.topic_top_k(graph.topic_links.select("source_id", "target_id", "score"), concepts, settings.top_k),
    }
    spark = queries.sparkSession
    shelf, found = Shelf(spark, "channels"), spark.createDataFrame([], "query_id string, id string, channel string, rank int")
    for name, way in ways.items():
        try:
            own, _ = shelf.put(way().select(F.col("query_id").cast("string").alias("query_id"), "id", F.lit(name).alias("channel"), "rank"))
        except Exception:  # noqa: BLE001 whatever fails in a channel
            log.exception("channel %s failed", name)
            continue
        found = found.unionByName(own)
    return found


def retrieve(graph: Graph, queries: DataFrame, reference: Column, settings: Settings | None = None) -> DataFrame:
    """``(query_id, place, id, text, context, score, source, members, urn, title)`` for each query (``query_id, text, vector``).

    The ``final_k`` best chunks, marked if their validity ended before ``reference``,
    merged per act; then up to ``expand`` chunks they cite, with score 0 and source
    citation_hop, marked likewise.
    """
    settings = settings or Settings()
    about = graph.chunks.select(F.col("id").alias("first"), "urn", F.col("work_title").alias("title"))
    cut, _ = Shelf(queries.sparkSession, "fused").put(fusion.fuse(channels(graph, queries, settings), settings).where(F.col("place") <= settings.final_k))
    known = graph.chunks.select("id", fusion.mark(F.coalesce("text_display", F.lit("")), F.col("vigenza_end"), reference).alias("text"), "context", fusion.work_key(F.col("work_title"), F.col("work_urn"), F.col("id")).alias("work_key"))
    merged = fusion.merge(cut.join(known, "id")).drop("work_key")
    hops = expand.cited(cut.select("query_id", "id"), graph.edges, graph.chunks, settings.hops, settings.expand)
    extra = hops.join(known, "id").select("query_id", "id", "text", "context", F.lit(0.0).alias("score"), F.lit("citation_hop").alias("source"), F.array("id").alias("members"), F.lit(None).cast("int").alias("place"))
    return merged.unionByName(extra).withColumn("first", F.get("members", F.lit(0))).join(about, "first", "left").drop("first")


def prompt(results: DataFrame, questions: DataFrame) -> DataFrame:
    """``(query_id, prompt)``: the results of each query in their order, and its question."""
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(1 << 30)).alias("place"), "id", "text")))
    context = results.groupBy("query_id").agg(F.array_join(F.transform(order, lambda x: x["text"]), "\n\n").alias("context"))
    return questions.join(context, "query_id", "left").select("query_id", F.concat(F.lit("Contesto:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nDomanda: "), F.col("text"), F.lit("\nRisposta:")).alias("prompt"))


def printed(results: DataFrame, concepts: DataFrame | None = None, full: bool = False, most: int = 1500) -> DataFrame:
    """Results as texts to read: white space single, cut to ``most`` characters unless ``full``.

    ``concepts`` (``query_id, id, concepts``) gives the topics that matched a chunk, shown
    by the last part of their addresses.
    """
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    out = results.withColumn("text", text if full else F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text))
    if concepts is None:
        return out.withColumn("topics", F.lit(""))
    names = F.array_join(F.transform("concepts", lambda c: F.regexp_extract(c, r"([^/#]*)$", 1)), ", ")
    own = out.select("query_id", F.col("id").alias("result"), F.explode("members").alias("id")).join(concepts, ["query_id", "id"]).groupBy("query_id", F.col("result").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(names)), ", ").alias("topics"))
    return out.join(own, ["query_id", "id"], "left").withColumn("topics", F.coalesce("topics", F.lit("")))

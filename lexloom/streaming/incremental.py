"""Incremental loads: new files become rows once, in batches that may be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators import enrich, topics
from lexloom.operators.enrich import Provider
from lexloom.sources import akn, files

#: Columns of the thesaurus' tables.
LABELS, BROADER = "concept_id string, label string, kind string", "child_id string, parent_id string"


def documents(spark: SparkSession, directory: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of parsed XML documents of a directory; a file is taken up once."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(directory)
    return akn.parsed(found)


def parsed_documents(spark: SparkSession, directory: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of documents parsed before, from JSON lines; lines that are no valid document are left out."""
    rows = spark.readStream.schema(akn.SCHEMA).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_a_batch).json(directory)
    return rows.where(files.valid())


def thesaurus(spark: SparkSession, target: str, rdf: str | None = None) -> DataFrame:
    """Write labels and broader links of an RDF/XML file below ``target``; without a file those there are kept, or made empty. Returns the labels."""
    if rdf:
        labels, broader = files.thesaurus(files.triples(spark.read.format("binaryFile").load(rdf)))
        labels.write.mode("overwrite").parquet(f"{target}/concepts.parquet")
        broader.write.mode("overwrite").parquet(f"{target}/broader.parquet")
    else:
        for name, columns in (("concepts", LABELS), ("broader", BROADER)):
            spark.createDataFrame([], columns).write.mode("ignore").parquet(f"{target}/{name}.parquet")
    return spark.read.schema(LABELS).parquet(f"{target}/concepts.parquet")


def enriched(docs: DataFrame, labels: DataFrame | None = None, provider: Provider | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Acts, nodes with vectors, and edges with those to the topics named in the displayed texts, of parsed documents.

    A batch of texts that the provider refuses has no vectors; structural nodes have none.
    Without labels there are no topics, without a provider no vectors.
    """
    own = docs.where("error is null").select(F.col("frbr.title").alias("work_title"), F.inline("nodes"))
    chunk = F.col("type") == "EXPRESSION"
    payload = F.when(chunk, enrich.embedding_payload(F.col("work_title"), F.col("text_vector"), F.col("text_display")))
    none = F.lit(None).cast("array<float>")
    if provider:
        nodes = enrich.embed(own.withColumn("payload", payload), "payload", provider).drop("payload", "work_title")
    else:
        nodes = own.drop("work_title").withColumns({"embedding": none, "embed_error": F.lit(None).cast("string")})
    own_edges = akn.edges(docs).withColumn("score", F.lit(None).cast("double"))
    numbered = lambda edges: edges.withColumn("edge_id", F.xxhash64("source_id", "target_id", "type", "properties"))
    if labels is None:
        return akn.acts(docs), nodes, numbered(own_edges)
    found = topics.match(own.where(chunk).select("id", F.col("text_display").alias("text")), topics.dictionary(labels))
    links = found.select(F.col("id").alias("source_id"), F.col("concept_id").alias("target_id"), F.lit("HAS_TOPIC").alias("type"), F.col("score").cast("double").alias("score"))
    return akn.acts(docs), nodes, numbered(own_edges.unionByName(links, allowMissingColumns=True))


def load(docs: DataFrame, target: str, checkpoint: str, labels: DataFrame | None = None, provider: Provider | None = None) -> StreamingQuery:
    """Enrich each batch and write its acts, nodes, edges and errors to the tables below ``target``, until what is there is taken up.

    Each batch overwrites its own partition, so one that is repeated after a failure
    changes nothing; the tables' upserts then settle which row of a key counts.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        works, nodes, edges = enriched(batch, labels, provider)
        for name, rows in (("works", works), ("nodes", nodes), ("edges", edges), ("errors", akn.errors(batch))):
            rows.withColumn("ingested_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{target}/{name}.parquet/batch={n}")
        batch.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, at: str, kind: str, window: str, late: str) -> DataFrame:
    """``(start, kind, n)``: events per window and kind; events later than ``late`` are dropped once a window is final."""
    own = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return own.select(F.col("w.start").alias("start"), "kind", "n")

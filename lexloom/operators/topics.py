"""Thesaurus: label dictionary, matching of labels in texts, narrower concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import normalize_text


#: First words of labels that are looked up in a list.
FIRST_WORDS = 20_000


def dictionary(labels: DataFrame) -> DataFrame:
    """``(label, concept_id, kind)``: one concept for each normalised label.

    ``labels`` has ``concept_id, label, kind`` (pref or alt). A preferred label goes
    before an alternative one; among preferred the greatest concept id is taken, among
    alternative ones the smallest. Null and blank labels and null concepts don't count.
    """
    own = labels.where("concept_id is not null").select("concept_id", normalize_text(F.col("label")).alias("label"), "kind").where("label <> ''")
    by = own.groupBy("label").agg(F.max(F.when(F.col("kind") == "pref", F.col("concept_id"))).alias("p"), F.min("concept_id").alias("a"))
    return by.select("label", F.coalesce("p", "a").alias("concept_id"), F.when(F.col("p").isNotNull(), "pref").otherwise("alt").alias("kind"))


def match(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, concept_id, label, score)``: concepts whose label stands in a text as whole words.

    ``texts`` has ``id, text``, ``labels`` is a ``dictionary``. Of a concept's matches in
    a text the one that ends first counts, the longest at equal ends; the score is 1.
    Null texts and an empty dictionary give no rows. Stretches of as many words as some
    label has are joined by hash with the labels, which Spark broadcasts if they are small.
    Stretches begin only where some label of their size does, as long as these first words
    are ``FIRST_WORDS`` at most; with more of them, everywhere.
    """
    parts = F.split("label", " ")
    begins = labels.select(F.size(parts).alias("n"), parts[0].alias("word")).distinct()
    some = begins.limit(FIRST_WORDS + 1).collect()
    firsts: dict[int, list[str]] = {}
    if len(some) <= FIRST_WORDS:
        for r in some:
            firsts.setdefault(r["n"], []).append(r["word"])
        sizes = sorted(firsts)
    else:
        sizes = sorted(r["n"] for r in begins.select("n").distinct().collect())
    words = texts.where("id is not null and text is not null").select("id", F.split(normalize_text(F.col("text")), " ").alias("w"))

    def stretches(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        if n in firsts:
            starts = F.filter(starts, lambda i: F.element_at("w", i).isin(firsts[n]))
        return F.transform(starts, lambda i: F.struct(F.array_join(F.slice("w", i, n), " ").alias("label"), (i + n - 1).cast("int").alias("last"), F.lit(n).alias("n")))

    gram = F.concat(F.array().cast("array<struct<label:string,last:int,n:int>>"), *map(stretches, sizes))
    hits = words.select("id", F.inline(gram)).join(labels.select("label", "concept_id"), "label")
    return hits.groupBy("id", "concept_id").agg(F.min_by("label", F.struct("last", -F.col("n"))).alias("label")).withColumn("score", F.lit(1.0))


def narrower(broader: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """``(concept_id, hop)`` of the concepts up to ``hops`` steps below ``seeds`` (``concept_id``), each at its least distance.

    Seeds themselves aren't returned; cycles end, as a concept is taken up once.
    """
    level = seeds.where("concept_id is not null").select("concept_id").distinct()
    seen = level.withColumn("hop", F.lit(0))
    below = broader.where("child_id is not null and parent_id is not null").distinct()
    for hop in range(1, hops + 1):
        level = level.join(below.withColumnRenamed("parent_id", "concept_id"), "concept_id").select(F.col("child_id").alias("concept_id")).distinct().join(seen.select("concept_id"), "concept_id", "left_anti")
        seen = seen.unionByName(level.withColumn("hop", F.lit(hop)))
    return seen.where("hop > 0")


def hottest(topics: DataFrame, k: int = 1) -> DataFrame:
    """``(concept_id, n)``: the concepts with the most chunks; ties by id."""
    own = topics.groupBy(F.col("target_id").alias("concept_id")).agg(F.count("*").alias("n"))
    return own.orderBy(F.desc("n"), "concept_id").limit(k)


def containing(concepts: DataFrame, part: str) -> DataFrame:
    """Distinct concept ids that contain ``part``."""
    return concepts.where(F.col("concept_id").contains(part)).select("concept_id").distinct().withColumn("part", F.lit(part))


def best(edges: DataFrame, k: int) -> DataFrame:
    """``(source_id, topics, best)``: how many topics a chunk has, and the k of greatest score, ties by id; repeated links count once."""
    own = edges.where("type = 'HAS_TOPIC' and target_id <> '' and source_id is not null").select("source_id", "target_id", "score").distinct()
    ranked = own.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "target_id"))).where(F.col("n") <= k)
    first = ranked.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "target_id"))), lambda x: x["target_id"]).alias("best"))
    return own.groupBy("source_id").agg(F.count("*").alias("topics")).join(first, "source_id")

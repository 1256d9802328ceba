"""Enrichment of chunks: what is embedded, vectors of a provider, data of the act, its steps and judgements."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import embedding_payload

#: A provider turns a list of texts into vectors; it may fail for a batch.
Provider = Callable[[list[str]], list[list[float]]]


def hash_provider(dim: int = 64) -> Provider:
    """Deterministic vectors for tests and offline runs: signed counts of hashed words."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                row[h % dim] += 1 if h >> 63 else -1
        return out.tolist()

    return embed


def chunks(expressions: DataFrame, acts: DataFrame) -> DataFrame:
    """Chunks with title and validity of their act."""
    own = acts.select(F.col("urn").alias("work_urn"), F.col("title").alias("work_title"), "vigenza_start", "vigenza_end")
    return expressions.join(own, "work_urn", "left")


def payloads(rows: DataFrame, most: int = 3500) -> DataFrame:
    """``(id, payload)``: what is embedded of each chunk (``work_title, text_vector, text_display``)."""
    return rows.select("id", embedding_payload(F.col("work_title"), F.col("text_vector"), F.col("text_display"), most).alias("payload"))


def embed(rows: DataFrame, text: str, provider: Provider, batch: int = 500) -> DataFrame:
    """``rows`` with ``embedding`` and ``embed_error``: a batch that fails leaves null vectors and says why.

    Null texts have null vectors. Texts go to the provider in batches of at most ``batch``.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors: list = [None] * len(part)
            errors: list = [None] * len(part)
            for lo in range(0, len(part), batch):
                some = [(i, t) for i, t in enumerate(part.iloc[lo : lo + batch], lo) if t is not None]
                try:
                    for (i, _), v in zip(some, provider([t for _, t in some]) if some else [], strict=True):
                        vectors[i] = v
                except Exception as e:  # noqa: BLE001 a provider may fail in any way
                    for i, _ in some:
                        errors[i] = f"{type(e).__name__}: {e}"[:200]
            yield pd.DataFrame({"embedding": vectors, "embed_error": errors})

    udf = F.pandas_udf(run, "embedding array<float>, embed_error string")
    return rows.withColumn("e", udf(F.col(text))).select(*rows.columns, "e.embedding", "e.embed_error")


def by_act(acts: DataFrame, steps: DataFrame, judgements: DataFrame) -> DataFrame:
    """``(urn, steps, step_types, judgements)``: of each act the distinct steps and judgements that name it.

    An act without any has zeros. Both sides are aggregated per URN before they meet.
    """
    s = steps.where("related_work_urn is not null").groupBy(F.col("related_work_urn").alias("urn")).agg(F.count_distinct("id").alias("steps"), F.array_join(F.array_sort(F.collect_set("step_type")), ",").alias("step_types"))
    j = judgements.select("id", F.explode("affected_urns").alias("urn")).groupBy("urn").agg(F.count_distinct("id").alias("judgements"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return acts.select("urn").join(s, "urn", "left").join(j, "urn", "left").select("urn", zero("steps"), F.coalesce("step_types", F.lit("")).alias("step_types"), zero("judgements"))

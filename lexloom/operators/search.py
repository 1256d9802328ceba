"""Search channels: vectors, words, topics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.tables import Shelf

#: Query vectors held by a worker at once; more go in blocks.
BLOCK = 4096
#: Distinct query terms looked up in each text as a list; more are met by a join.
TERMS = 10_000


def _top(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest of each row of ``s``, ties by id; the columns come sorted by ``ids`` (one row for all)."""
    if s.shape[1] > k:
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        tied = (s >= kth).sum(axis=1) > k
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        if tied.any():
            top[tied] = np.argsort(-s[tied], axis=1, kind="stable")[:, :k]
        return np.take_along_axis(s, top, axis=1), ids[top]
    return s, np.broadcast_to(ids, s.shape)


def _best(batches: Iterator[pa.RecordBatch], queries: object, k: int) -> Iterator[pa.RecordBatch]:
    """Of each query the k nearest rows of a partition."""
    names, q = queries.value
    dim = q.shape[1]
    best_s, best_i = np.zeros((len(q), 0)), np.zeros((len(q), 0), "U1")
    for b in batches:
        v = b.column(1)
        right = np.flatnonzero(np.asarray(v.value_lengths().fill_null(-1)) == dim)
        x = np.asarray(v.take(pa.array(right)).flatten().cast(pa.float64()).fill_null(float("nan"))).reshape(-1, dim)
        norm = np.linalg.norm(x, axis=1)
        fine = np.isfinite(norm) & (norm > 0)
        own = np.array(b.column(0).take(pa.array(right[fine])).to_pylist(), dtype=str)
        x = x[fine] / norm[fine, None]
        for lo in range(0, len(x), 4096):
            order = np.argsort(own[lo : lo + 4096], kind="stable")
            s, i = _top(q @ x[lo : lo + 4096][order].T, own[lo : lo + 4096][order], k)
            s, i = np.concatenate((best_s, s), axis=1), np.concatenate((best_i, i), axis=1)
            place = np.unique(i, return_inverse=True)[1].reshape(i.shape)
            keep = np.lexsort((place, -s), axis=1)[:, :k]
            best_s, best_i = np.take_along_axis(s, keep, axis=1), np.take_along_axis(i, keep, axis=1)
    n = best_s.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n), pa.string()), pa.array(best_i.ravel().tolist(), pa.string()), pa.array(best_s.ravel())], ["query_id", "id", "cosine"])


def vector_top_k(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``(query_id, id, cosine, score, rank)``: of each query (``query_id, vector``) the k rows of greatest cosine, exactly.

    Unusable vectors (null, of another length, zero, not finite) have no neighbours and
    are none; ties rank by id; a row that is the query itself counts. The queries are a
    stated set and go to the workers in blocks, each of which passes once over the rows;
    a task returns its k best a query, so what is shuffled doesn't grow with the rows a
    task holds.
    """
    spark = rows.sparkSession
    asked = queries.where(F.col("query_id").isNotNull() & F.col("vector").isNotNull()).select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    few = asked.limit(BLOCK + 1).collect()
    blocks = 1 if len(few) <= BLOCK else -(-asked.count() // BLOCK)
    data = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(vector).alias("vector"))
    found = None
    for n in range(blocks):
        own = few if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).collect()
        by_dim: dict[int, list] = {}
        for r in own:
            by_dim.setdefault(len(r["vector"]), []).append((r["query_id"], r["vector"]))
        for some in by_dim.values():
            q = np.array([v for _, v in some], dtype=np.float64)
            norm = np.linalg.norm(q, axis=1) if q.size else np.zeros(len(q))
            fine = np.isfinite(norm) & (norm > 0)
            if not fine.any():
                continue
            sent = spark.sparkContext.broadcast((np.array([i for i, _ in some], dtype=object)[fine], q[fine] / norm[fine, None]))
            one = data.mapInArrow(partial(_best, queries=sent, k=k), "query_id string, id string, cosine double")
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "query_id string, id string, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 12)), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", "cosine", ((1 + F.col("cosine")) / 2).alias("score"), "rank")


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, term, tf, dl)``: how often each token stands in each text, and the text's number of tokens.

    Null and empty texts have no postings. Repeated rows of a key would add up: give one
    row a key. A text's tokens are counted in the task that reads it, before the shuffle.
    """
    listed = rows.select(F.col(key).alias("id"), tokens(F.col(text)).alias("t")).where("size(t) > 0")
    one = listed.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return one.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25_top_k(rows: DataFrame, queries: DataFrame, key: str, text: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(query_id, id, score, rank)``: of each query (``query_id, text``) the k texts of greatest BM25 score.

    idf ln(1 + (N - df + 0.5) / (df + 0.5)), tf / (tf + k1 (1 - b + b dl / avgdl)); terms are
    alternatives, a repeated query term counts as often; N and avgdl are over texts with a
    token; ties rank by id; null ids don't count.

    Texts are cut into tokens once: written are each text's length and those of its tokens
    that some query has, which is all that later steps read. Up to ``TERMS`` distinct terms
    are looked up in each text before anything is exploded; a larger set of queries is met
    by a join of the exploded tokens.
    """
    q = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    terms = q.select("term").distinct()
    some = [r["term"] for r in terms.limit(TERMS + 1).collect()]
    listed = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), tokens(F.col(text)).alias("t")).where("size(t) > 0").select("id", F.size("t").alias("dl"), "t")
    if len(some) <= TERMS:
        listed = listed.select("id", "dl", F.filter("t", lambda x: x.isin(some)).alias("t"))
        kept, _ = Shelf(rows.sparkSession, "tokens").put(listed)
        each = kept.select("id", "dl", F.explode("t").alias("term"))
    else:
        kept = listed
        each = listed.select("id", "dl", F.explode("t").alias("term")).join(terms, "term", "left_semi")
    size = kept.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = each.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighed = hits.join(df, "term").join(q, "term").join(F.broadcast(size))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = weighed.groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topic_top_k(topics: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score, concepts, rank)``: of each query (``query_id, concept_id``) the k chunks of greatest topic score.

    ``topics`` has ``source_id, target_id, score``. Repeated concepts count once; ties
    rank by the number of matched concepts, then by id.
    """
    hits = topics.join(queries.distinct().withColumnRenamed("concept_id", "target_id"), "target_id")
    scored = hits.groupBy("query_id", F.col("source_id").alias("id")).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("target_id")).alias("concepts"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.size("concepts")), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

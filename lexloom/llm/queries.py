"""Queries of the language-model data problems, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import bpe, languages, leaks, mojibake, neighbours, split
from lexloom.tables import table


#: Where the public vocabulary lies.
TOKENIZER = os.environ.get("LEXLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that may have been misread: titles of works, descriptions of steps and judgements."""
    one = lambda t, c: table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), "row_id", F.col(c).alias("text"))
    return one("works", "title").unionByName(one("iter_steps", "description")).unionByName(one("judgements", "description"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find(_texts(spark, sf_dir)).select("table_name", "row_id").distinct()


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected texts with their originals put in place."""
    texts = _texts(spark, sf_dir)
    return mojibake.restore(texts, mojibake.find(texts))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.similar(table(spark, sf_dir, "nodes").select("id", "embedding"), "id", "embedding", k=5, least=0.9)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every node whose id, a hexadecimal number, is divisible by 20, among all nodes."""
    nodes = table(spark, sf_dir, "nodes").select("id", "embedding")
    half = lambda at: F.conv(F.substring("id", at, 8), 16, 10).cast("bigint")
    # 2^32 leaves 16 when divided by 20
    asked = nodes.where(F.pmod(16 * half(-16) + half(-8), F.lit(20)) == 0)
    return neighbours.search(nodes, asked, "id", "embedding").select("id", "neighbour", "cosine", F.col("rank").cast("bigint").alias("rank"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text of every EXPRESSION node."""
    nodes = table(spark, sf_dir, "nodes").where("type = 'EXPRESSION'").select(F.col("id").alias("node_id"), "text_content", "text_vector", "tag_name")
    return split.split_fields(nodes, "node_id", ("text_content", "text_vector"), 3500, 200, F.col("tag_name") == "table")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose text had to be cut: those with a second piece."""
    return p7_pieces(spark, sf_dir).where("piece_no = 1").select("node_id", "field_name").distinct()


def p7_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the pieces of each text reach, and whether all are within the limit and join up."""
    end, after = F.col("start") + F.length("piece"), Window.partitionBy("node_id", "field_name").orderBy("start", "piece_no").rowsBetween(Window.unboundedPreceding, -1)
    own = p7_pieces(spark, sf_dir).distinct().withColumn("joined", F.col("start") <= F.coalesce(F.max(end).over(after), F.lit(0)))
    return own.groupBy("node_id", "field_name").agg(F.max(end).cast("bigint").alias("n_chars"), F.bool_and((F.length("piece") <= 3500) & F.col("joined")).alias("fit"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", TOKENIZER)


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together again from their ids: lengths and hashes."""
    back = bpe.decode(p8_ids(spark, sf_dir), "doc_id", "ids", TOKENIZER)
    return back.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("md5"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of twenty words; of those that the alignment found, the ones without edits."""
    return _leaks(spark, sf_dir).where("edits = 0").select("doc_id", "item_id")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of twenty words with at most one letter wrong, missing or added."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id", "edits")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it and its longest run of words."""
    return _leaks(spark, sf_dir).where("edits = 0").groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("words"))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (segment -1) and each of its segments with language and confidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages.label(docs, languages.train(docs))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule, rows = languages.Rule(), p10_segments(spark, sf_dir)
    long = (F.col("segment") == -1) | (F.col("end") - F.col("start") >= rule.passage)
    unnamed = ~F.col("lang").eqNullSafe(languages.label_language(F.col("given")))
    return rows.where(F.col("lang").isNotNull() & long & unnamed).select("doc_id", "lang").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_restored, p5_found, p5_knn, p7_found, p7_pieces, p7_cover, p8_ids, p8_roundtrip, p9_found, p9_near, p9_items, p10_found, p10_segments)}

SQL = {
    "p5_found": """
with v as (select id, min(list_transform(embedding, lambda x: x::double)) as e from nodes
           where id is not null and len(embedding) = 64 and list_sum(list_transform(embedding, lambda x: abs(x::double))) > 0 group by id),
u as (select id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v),
p as (select a.id, b.id as other, list_dot_product(a.e, b.e) as s from u a join u b on a.id <> b.id where list_dot_product(a.e, b.e) >= 0.9),
r as (select *, row_number() over (partition by id order by round(s, 7) desc, other) as n from p)
select distinct least(id, other) as id_a, greatest(id, other) as id_b from r where n <= 5""",
    "p7_found": """
select distinct id as node_id, field_name from (
  select id, type, 'text_content' as field_name, text_content as t from nodes
  union all select id, type, 'text_vector', text_vector from nodes)
where type = 'EXPRESSION' and length(t) > 3500""",
    "p7_cover": """
select id as node_id, field_name, max(length(t)) as n_chars, true as fit from (
  select id, type, 'text_content' as field_name, text_content as t from nodes
  union all select id, type, 'text_vector', text_vector from nodes)
where type = 'EXPRESSION' and t is not null group by 1, 2""",
    "p9_found": r"""
with d as (select doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') as w from documents where text is not null),
b as (select item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') as w from benchmark where text is not null),
dw as (select doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ''))) as run from d where len(w) >= 20),
bw as (select item_id, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ''))) as run from b where len(w) >= 20)
select distinct doc_id, item_id from dw join bw using (run)""",
    "p9_items": r"""
with d as (select doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') as w from documents where text is not null),
b as (select item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') as w from benchmark where text is not null),
dw as (select doc_id, unnest(range(1, len(w) - 18)) as i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) as run from d where len(w) >= 20),
bw as (select item_id, unnest(range(1, len(w) - 18)) as j, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) as run from b where len(w) >= 20),
m as (select doc_id, item_id, j, i - j as diagonal, j - row_number() over (partition by doc_id, item_id, i - j order by j) as island from dw join bw using (run)),
r as (select doc_id, item_id, count(*) + 19 as n from m group by doc_id, item_id, diagonal, island)
select item_id, count(distinct doc_id) as documents, max(n) as words from r group by 1""",
    "p8_roundtrip": "select doc_id, length(coalesce(text, ''))::bigint as n_chars, md5(coalesce(text, '')) as md5 from documents",
}

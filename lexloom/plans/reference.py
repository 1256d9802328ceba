"""Queries of the retrieval engine's own operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import engine
from lexloom.functions import classify, dates, text, urns
from lexloom.operators import enrich, expand, fusion, search, store, topics
from lexloom.plans.documents import escaped
from lexloom.sources import akn, files
from lexloom.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Day of reference of the queries that need one, and the questions put.
DAY = "2020-01-01"
QUESTIONS = (("q1", "tutela acque interne nei comuni"), ("q2", "sanzioni pesca e mobilità ciclabile"), ("q3", "assistenza agli anziani"))


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def big(c: str):
    return F.col(c).cast("bigint").alias(c)


# --- columns -------------------------------------------------------------------------

_NORM = r"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s\x0B\x{{85}}\p{{Z}}]', '', 'g'), '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g'))"


@query(f"select id, md5({_NORM.format(x='text_display')}) as norm from nodes where text_display is not null")
def text_normalize(spark, sf):
    return table(spark, sf, "nodes").where("text_display is not null").select("id", F.md5(text.normalize_text(F.col("text_display"))).alias("norm"))


@query("select id, eid, substr(sha256(work_urn || '#' || eid), 1, 16) as node_id from nodes where eid is not null")
def node_id_hash(spark, sf):
    return table(spark, sf, "nodes").where("eid is not null").select("id", "eid", urns.node_id(F.col("work_urn"), F.col("eid")).alias("node_id"))


_URN = r"""case when c like '/akn/%' then
  case when len(p) >= 4 then 'urn:nir:' || p[2] || ':' || p[1] || ':' || p[3] || ';' || p[4] else 'urn:akn:' || b end
  when c like 'urn:%' then c else 'urn:akn:' || c end"""


@query(
    rf"""with u as (select row_id, regexp_replace(frbr_expression_uri, '/?!?main.*$', '') as c from works where frbr_expression_uri is not null),
  s as (select row_id, c, regexp_replace(c, '^/akn/it/act/', '') as b from u), t as (select *, string_split(trim(b, '/'), '/') as p from s)
  select row_id, {_URN} as urn from t"""
)
def uri_to_urn(spark, sf):
    return table(spark, sf, "works").where("frbr_expression_uri is not null").select("row_id", urns.uri_to_urn(F.col("frbr_expression_uri")).alias("urn"))


@query("select row_id, 'urn:fallback:' || substr(sha256(coalesce(title, 'None') || '_' || strftime(date_promulgation, '%Y-%m-%d')), 1, 16) as urn from works")
def fallback_urn(spark, sf):
    return table(spark, sf, "works").select("row_id", urns.fallback_urn(F.col("title"), F.col("date_promulgation")).alias("urn"))


@query("select row_id, list_extract(p, -2) || ':' || list_extract(p, -1) as urn from (select row_id, list_filter(string_split(frbr_work_uri, '/'), lambda s: s <> '') as p from works)")
def uri_work_urn(spark, sf):
    return table(spark, sf, "works").select("row_id", urns.last_segments(F.col("frbr_work_uri")).alias("urn"))


@query(
    """with e as (select edge_id, source_id, properties.href as h from edges where properties.href is not null),
  n as (select id, min(work_urn) as urn from nodes group by id)
  select edge_id, case when h like '#%' then substr(sha256(urn || '#' || substr(h, 2)), 1, 16)
    when h like '/akn/%' or h like 'urn:%' or h like 'http%' then h else urn || '#' || h end as target
  from e join n on n.id = e.source_id"""
)
def href_resolve(spark, sf):
    act = table(spark, sf, "nodes").groupBy(F.col("id").alias("source_id")).agg(F.min("work_urn").alias("urn"))
    own = table(spark, sf, "edges").select("edge_id", "source_id", F.col("properties.href").alias("href")).where("href is not null")
    return own.join(act, "source_id").select("edge_id", urns.resolve_href(F.col("urn"), F.col("href")).alias("target"))


@query(r"""select raw_id, array_to_string(list_sort(list_distinct(regexp_extract_all(payload, 'urn:nir:[^\s<"'']+'))), ' ') as urns from raw_records where payload is not null""")
def urn_extract(spark, sf):
    return table(spark, sf, "raw_records").where("payload is not null").select("raw_id", F.array_join(F.array_sort(urns.urns_in(F.col("payload"), r"""urn:nir:[^\s<"']+""")), " ").alias("urns"))


def _case(x: str, patterns, other: str) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, '(?i){p}') then '{n}'" for n, p in ((n, p.replace("'", "''")) for n, p in patterns)) + f" else '{other}' end"


@query(f"select id, {_case('text_content', classify.MODIFICATIONS, 'AMENDMENT')} as class from nodes where type = 'EXPRESSION'")
def classify_mod(spark, sf):
    return table(spark, sf, "nodes").where("type = 'EXPRESSION'").select("id", classify.modification_class(F.col("text_content")).alias("class"))


@query(f"select row_id, {_case('description', classify.STEPS, 'DDL_PRESENTATION')} as class from iter_steps")
def classify_step(spark, sf):
    return table(spark, sf, "iter_steps").select("row_id", classify.step_class(F.col("description")).alias("class"))


@query(
    """select row_id, coalesce(try_strptime(case when regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$') then date end, '%Y-%m-%d'),
  try_strptime(case when regexp_matches(date, '^\\d{8}$') then date end, '%Y%m%d'))::date as day from iter_steps"""
)
def iso_dates(spark, sf):
    return table(spark, sf, "iter_steps").select("row_id", dates.iso_date(F.col("date")).alias("day"))


@query("select urn, min(vigenza_start) as first_day, nullif(max(vigenza_start), min(vigenza_start)) as last_day from works group by urn")
def validity_interval(spark, sf):
    first, last = dates.validity(F.col("vigenza_start"))
    return table(spark, sf, "works").groupBy("urn").agg(first.alias("first_day"), last.alias("last_day"))


@query(r"""select row_id, regexp_replace(frbr_work_uri || ' "' || doc_type || '" (' || doc_number || ')', '([+\-&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g') as q from works""")
def lucene_escape(spark, sf):
    return table(spark, sf, "works").select("row_id", text.lucene_escape(F.concat("frbr_work_uri", F.lit(' "'), "doc_type", F.lit('" ('), "doc_number", F.lit(")"))).alias("q"))


@query(
    """with w as (select urn, title from (select urn, title, row_number() over (partition by urn order by ingested_at) as n from works) where n = 1)
  select id, md5(left('Contesto: ' || coalesce(w.title, 'None') || chr(10) || chr(10) || 'Testo: ' || coalesce(nullif(text_vector, ''), text_display, ''), 3500)) as payload
  from nodes left join w on w.urn = work_urn where type = 'EXPRESSION'"""
)
def payload_truncate(spark, sf):
    acts = store.works(table(spark, sf, "works")).select(F.col("urn").alias("work_urn"), F.col("title").alias("work_title"))
    rows = table(spark, sf, "nodes").where("type = 'EXPRESSION'").select("id", "work_urn", "text_vector", "text_display").join(acts, "work_urn", "left")
    return enrich.payloads(rows).select("id", F.md5("payload").alias("payload"))


_PARENT = "p as (select source_id as id, min(target_id) as parent_id from edges where type = 'PART_OF' group by 1)"
_ONE = "one as (select * from (select *, row_number() over (partition by id order by ingested_at) as rn from nodes where id is not null) where rn = 1)"


@query(
    rf"""with {_ONE}, {_PARENT},
  l as (select id, coalesce(nullif(trim(num), '') || ' - ' || nullif(trim(heading), ''), nullif(trim(num), ''), nullif(trim(heading), ''), upper(tag_name[1]) || lower(tag_name[2:])) as label from one),
  x as (select one.id, case when l.label is null then [] else [l.label] end as c, nullif(regexp_replace(trim(num), '\.+$', ''), '') as n, text_content as t
    from one left join p using (id) left join l on l.id = p.parent_id where type = 'EXPRESSION' and text_content is not null),
  y as (select id, t, array_to_string(list_concat(c, case when n is null then [] else [n] end), ' > ') as path from x)
  select id, md5(case when path = '' then t else path || ': ' || t end) as vector from y"""
)
def context_inject(spark, sf):
    one = store.upsert(table(spark, sf, "nodes"), "id", "ingested_at", ("type", "num", "heading", "tag_name", "text_content"))
    up = expand.parents(one, table(spark, sf, "edges")).select("id", "parent_id")
    labels = one.select(F.col("id").alias("parent_id"), text.structural_label(F.col("num"), F.col("heading"), F.col("tag_name")).alias("label"))
    rows = one.where("type = 'EXPRESSION' and text_content is not null").join(up, "id", "left").join(labels, "parent_id", "left")
    return rows.select("id", F.md5(text.inject_context(F.array("label"), F.col("num"), F.col("text_content"))).alias("vector"))


_LINES = """select l_orderkey, array_to_string(list_concat(['| parte | resa | stato |', '| --- | --- | --- |'],
  list('| ' || l_partkey || ' | ' || l_returnflag || ' | ' || l_linestatus || ' |' order by l_linenumber, l_partkey, l_suppkey)), chr(10)) as md,
  array_to_string(list_transform(list('parte=' || l_partkey || ', resa=' || l_returnflag || ', stato=' || l_linestatus order by l_linenumber, l_partkey, l_suppkey),
    lambda x, i: 'Riga ' || i || ': ' || x), '. ') as lin from lineitem group by l_orderkey"""


def _tables(spark, sf) -> DataFrame:
    """A table of cells for the lines of each order."""
    cells = F.array(F.col("l_partkey").cast("string"), "l_returnflag", "l_linestatus")
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cells.alias("c"))))
    head = F.array(F.array(F.lit("parte"), F.lit("resa"), F.lit("stato")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(lines.alias("m")).select("l_orderkey", F.concat(head, F.transform("m", lambda x: x["c"])).alias("t"))


@query(f"select l_orderkey, md5(md) as md from ({_LINES})")
def table_markdown(spark, sf):
    return _tables(spark, sf).select("l_orderkey", F.md5(text.table_markdown(F.col("t"))).alias("md"))


@query(f"select l_orderkey, md5(lin) as lin from ({_LINES})")
def table_linear(spark, sf):
    return _tables(spark, sf).select("l_orderkey", F.md5(text.table_linear(F.col("t"), F.lit(True))).alias("lin"))


# --- thesaurus -----------------------------------------------------------------------

_DICT = f"""d0 as (select concept_id, kind, {_NORM.format(x="label")} as label from concepts where concept_id is not null and label is not null),
  dict as (select label, coalesce(max(case when kind = 'pref' then concept_id end), min(concept_id)) as concept_id,
    case when max(case when kind = 'pref' then 1 else 0 end) = 1 then 'pref' else 'alt' end as kind from d0 where label <> '' group by label)"""
_MATCH = """g as (select id, concept_id, dict.label, g.e, g.n from grams g join dict using (label)),
  m as (select id, concept_id, label from (select *, row_number() over (partition by id, concept_id order by e, n desc, label) as k from g) where k = 1)"""


def _grams(source: str) -> str:
    return f"""tw as (select id, string_split({_NORM.format(x="t")}, ' ') as w from ({source}) where t is not null),
  sizes as (select distinct len(string_split(label, ' ')) as n from dict),
  grams as (select id, n, i + n - 1 as e, array_to_string(w[i:i + n - 1], ' ') as label from (select id, w, n, unnest(range(1, len(w) - n + 2)) as i from tw, sizes where len(w) >= n))"""


@query(f"with {_DICT} select label, concept_id, kind from dict")
def label_priority(spark, sf):
    return topics.dictionary(table(spark, sf, "concepts"))


_NAMED = "select source_id || target_id as id, min(label) || ', ' || max(label) || '; ' || max(edge_id) as t from edges join concepts on concept_id = target_id where type = 'HAS_TOPIC' group by source_id, target_id"


@query(f"with {_ONE}, {_DICT}, {_grams('select id, text_display as t from one union all ' + _NAMED)}, {_MATCH} select id, concept_id, label, 1.0::double as score from m")
def topic_match(spark, sf):
    """Labels in the chunks' texts, which name none here, and in texts made of the labels of each topic link."""
    one, labels = store.upsert(table(spark, sf, "nodes"), "id", "ingested_at", ("text_display",)).toDF("id", "text"), table(spark, sf, "concepts")
    links = table(spark, sf, "edges").where("type = 'HAS_TOPIC'").select(F.concat("source_id", "target_id").alias("id"), F.col("target_id").alias("concept_id"), "edge_id")
    named = links.join(labels, "concept_id").groupBy("id").agg(F.concat(F.min("label"), F.lit(", "), F.max("label"), F.lit("; "), F.max("edge_id").cast("string")).alias("text"))
    return topics.match(one.unionByName(named), topics.dictionary(labels))


@query(
    """with recursive b as (select distinct child_id, parent_id from broader), t as (select child_id as id, 1 as hop from b where parent_id = 'teseo:00000'
  union select b.child_id, hop + 1 from b join t on b.parent_id = t.id where hop < 3)
  select id as concept_id, min(hop)::bigint as hop from t where id <> 'teseo:00000' group by 1"""
)
def narrower_expand(spark, sf):
    seeds = spark.createDataFrame([("teseo:00000",)], "concept_id string")
    return topics.narrower(table(spark, sf, "broader"), seeds, 3).select("concept_id", big("hop"))


@query("select target_id as concept_id, count(*) as n from edges where type = 'HAS_TOPIC' group by 1 order by n desc, 1 limit 1")
def hottest_topic(spark, sf):
    return topics.hottest(table(spark, sf, "edges").where("type = 'HAS_TOPIC'"))


@query("select distinct concept_id, '0011' as part from concepts where contains(concept_id, '0011')")
def topic_contains(spark, sf):
    return topics.containing(table(spark, sf, "concepts"), "0011")


_TOPICS = """tl as (select source_id, target_id, score from (select source_id, target_id, score, row_number() over (partition by source_id, target_id order by ingested_at desc, edge_id desc) as k
  from edges where type = 'HAS_TOPIC' and target_id <> '' and score is not null and source_id in (select id from nodes where type = 'EXPRESSION')) where k = 1)"""


def _topic_links(spark, sf) -> DataFrame:
    nodes = table(spark, sf, "nodes").where("type = 'EXPRESSION'").select("id").distinct()
    return store.topic_links(table(spark, sf, "edges").where("score is not null"), nodes)


@query(f"with {_TOPICS} select source_id, target_id, score from tl")
def topic_edge_upsert(spark, sf):
    return _topic_links(spark, sf)


_TOPK = f"""with {_TOPICS}, q as (select * from (values ('a', 'teseo:00001'), ('a', 'teseo:00002'), ('b', 'teseo:00017')) as v(query_id, concept_id)),
  s as (select query_id, source_id as id, max(score) as score, count(distinct target_id) as n, string_agg(distinct target_id, ',' order by target_id) as concepts from tl join q on q.concept_id = target_id group by 1, 2),
  r as (select *, row_number() over (partition by query_id order by score desc, n desc, id) as rank from s)
  select query_id, id, score, concepts, rank from r where rank <= """


@query(_TOPK + "10")
def topic_topk(spark, sf):
    q = spark.createDataFrame([("a", "teseo:00001"), ("a", "teseo:00002"), ("b", "teseo:00017")], "query_id string, concept_id string")
    return search.topic_top_k(_topic_links(spark, sf), q, 10).select("query_id", "id", "score", F.array_join("concepts", ",").alias("concepts"), big("rank"))


# --- search --------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)), 6)"


@query(f"select b.vec_id::varchar as id, {_COS} as cosine from embeddings a, embeddings b where a.vec_id = 0 order by list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)) desc, 1 limit 10")
def vector_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    q = rows.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.vector_top_k(rows, q, "vec_id", "embedding", 10).select("id", F.round("cosine", 6).alias("cosine"))


@query(
    f"""with c as (select a.vec_id::varchar as query_id, b.vec_id::varchar as id, {_COS.replace(", 6)", ", 12)")} as c from embeddings a, embeddings b where a.vec_id % 20 = 0)
  select query_id, id, round(c, 6) as cosine, rank from (select *, row_number() over (partition by query_id order by c desc, id) as rank from c) where rank <= 5"""
)
def vector_topk_batch(spark, sf):
    rows = table(spark, sf, "embeddings")
    q = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.vector_top_k(rows, q, "vec_id", "embedding", 5).select("query_id", "id", F.round("cosine", 6).alias("cosine"), big("rank"))


_TOKENS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


@query(f"with t as (select doc_id as id, {_TOKENS.format(x='text')} as t from documents where text is not null), u as (select id, len(t) as dl, unnest(t) as term from t) select id, term, count(*) as tf, min(dl)::bigint as dl from u group by 1, 2")
def bm25_postings(spark, sf):
    return search.postings(table(spark, sf, "documents"), "doc_id", "text").select("id", "term", "tf", big("dl"))


def _bm25(texts: str, queries: str, k: int) -> str:
    """CTEs: bt texts(id, t), bq queries(query_id, t) -> bm(query_id, id, score, rank)."""
    return f"""bt as (select id, {_TOKENS.format(x="t")} as t from ({texts}) where t is not null), bd as (select id, len(t) as dl, t from bt where len(t) > 0),
  bn as (select count(*) as n, avg(dl) as avgdl from bd), bp as (select id, dl, term, count(*) as tf from (select id, dl, unnest(t) as term from bd) group by 1, 2, 3),
  bq as (select query_id, term, count(*) as qtf from (select query_id, unnest({_TOKENS.format(x="t")}) as term from ({queries})) group by 1, 2), bf as (select term, count(*) as df from bp group by 1),
  bs as (select query_id, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) as score from bp join bq using (term) join bf using (term), bn group by 1, 2),
  bm as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from bs) where rank <= {k})"""


_Q = "select * from (values " + ", ".join(f"('{i}', '{t}')" for i, t in QUESTIONS) + ") as v(query_id, t)"


def _questions(spark) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id string, text string")


@query(f"with {_bm25('select doc_id as id, text as t from documents', _Q, 10)} select query_id, id, round(score, 6) as score, rank from bm")
def bm25_topk(spark, sf):
    return search.bm25_top_k(table(spark, sf, "documents"), _questions(spark), "doc_id", "text", 10).select("query_id", "id", F.round("score", 6).alias("score"), big("rank"))


# --- the graph's tables --------------------------------------------------------------

_FIRST = "(select *, row_number() over (partition by {k} order by ingested_at) as rn from {t})"


@query(f"select urn, title, doc_type, vigenza_start, vigenza_end from {_FIRST.format(k='urn', t='works')} where rn = 1")
def upsert_first_wins(spark, sf):
    return store.works(table(spark, sf, "works")).select("urn", "title", "doc_type", "vigenza_start", "vigenza_end")


_EXPR = """ex as (select f.id, work_urn, text_display, e.embedding from (select * from (select *, row_number() over (partition by id order by ingested_at) as rn
    from nodes where type = 'EXPRESSION' and id is not null and work_urn in (select urn from works)) where rn = 1) f
  left join (select id, embedding from (select id, embedding, row_number() over (partition by id order by ingested_at desc) as rn from nodes
    where type = 'EXPRESSION' and embedding is not null) where rn = 1) e using (id))"""


@query(f"with {_EXPR} select id, work_urn, md5(text_display) as text, len(embedding) as dims, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total from ex")
def upsert_mixed(spark, sf):
    own = store.expressions(table(spark, sf, "nodes"), store.works(table(spark, sf, "works")))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return own.select("id", "work_urn", F.md5("text_display").alias("text"), F.size("embedding").cast("bigint").alias("dims"), F.round(F.when(F.size("embedding") > 0, total), 4).alias("total"))


@query("select id, work_urn, eid, tag_name from (select *, row_number() over (partition by id order by ingested_at) as rn from nodes where type = 'STRUCTURAL' and work_urn in (select urn from works)) where rn = 1")
def upsert_structural(spark, sf):
    return store.structurals(table(spark, sf, "nodes"), store.works(table(spark, sf, "works")))


@query("select distinct source_id, target_id, type from edges where type in ('PART_OF', 'NEXT') and source_id in (select id from nodes) and target_id in (select id from nodes)")
def edge_dedup_resolve(spark, sf):
    return store.links(table(spark, sf, "edges"), table(spark, sf, "nodes").select("id").distinct(), ("PART_OF", "NEXT"))


@query("select urn, count(*) as n from works group by 1 having count(*) > 1")
def unique_keys(spark, sf):
    return store.duplicates(table(spark, sf, "works"), "urn")


@query("select distinct id from nodes where type = 'EXPRESSION' and id not in (select source_id from edges where type = 'PART_OF')")
def orphan_nodes(spark, sf):
    return store.without_parent(table(spark, sf, "nodes"), table(spark, sf, "edges"), "EXPRESSION").select("id").distinct()


@query("select distinct id from nodes where type = 'STRUCTURAL' and level > 0 and id not in (select source_id from edges where type = 'PART_OF')")
def orphan_structural(spark, sf):
    return store.without_parent(table(spark, sf, "nodes"), table(spark, sf, "edges"), "STRUCTURAL").where("level > 0").select("id").distinct()


@query("select distinct urn from works where urn = '' or urn in ('urn:unknown', 'urn:') or urn like 'urn:fallback:%'")
def unknown_urn(spark, sf):
    return store.unnamed(table(spark, sf, "works"))


@query("select tag_name, count(*) filter (embedding is null) as missing, count(embedding) as embedded from nodes where type = 'EXPRESSION' group by 1")
def null_embeddings(spark, sf):
    return store.embedding_gaps(table(spark, sf, "nodes"))



@query(f"with {_PARENT} select n.id, p.parent_id, g.parent_id as grandparent_id from (select distinct id from nodes) n left join p on p.id = n.id left join p g on g.id = p.parent_id")
def work_lookup(spark, sf):
    return expand.parents(table(spark, sf, "nodes"), table(spark, sf, "edges"))



@query(
    """with s as (select related_work_urn as urn, count(distinct id) as steps, string_agg(distinct step_type, ',' order by step_type) as t from iter_steps where related_work_urn is not null group by 1),
  j as (select urn, count(distinct id) as n from (select id, unnest(affected_urns) as urn from judgements) group by 1)
  select w.urn, coalesce(steps, 0) as steps, coalesce(t, '') as step_types, coalesce(n, 0) as judgements from (select distinct urn from works) w left join s using (urn) left join j using (urn)"""
)
def enrich_by_urn(spark, sf):
    return enrich.by_act(table(spark, sf, "works").select("urn").distinct(), table(spark, sf, "iter_steps"), table(spark, sf, "judgements"))


# --- fusion and expansion ------------------------------------------------------------


@query(f"select row_id, case when vigenza_end < date '{DAY}' then '[ATTENZIONE: NORMA ABROGATA]' || chr(10) || title else title end as title from works where title is not null")
def abrogation_mark(spark, sf):
    return table(spark, sf, "works").where("title is not null").select("row_id", fusion.mark(F.col("title"), F.col("vigenza_end"), F.lit(DAY).cast("date")).alias("title"))


@query(f"select row_id from works where (vigenza_start is null or vigenza_start <= date '{DAY}') and (vigenza_end is null or vigenza_end >= date '{DAY}')")
def temporal_filter(spark, sf):
    return table(spark, sf, "works").where(fusion.in_force(F.col("vigenza_start"), F.col("vigenza_end"), F.lit(DAY).cast("date"))).select("row_id")


_CITED = r"""ct as (select distinct source_id, case when regexp_matches(target_id, '^/akn/it/act/[^/]+/[^/]+/[^/]+/[^/]+?(/?!?main)?/?$')
    then regexp_replace(target_id, '^/akn/it/act/([^/]+)/([^/]+)/([^/]+)/([^/]+?)(/?!?main)?/?$', 'urn:nir:\2:\1:\3;\4') else target_id end as t from edges where type = 'CITES' and target_id <> ''),
  ci as (select source_id, t as id from ct where t in (select id from ex) union select source_id, ex.id from ct join ex on ex.work_urn = t)"""


@query(f"with {_EXPR}, {_CITED} select source_id, id from ci")
def citation_links(spark, sf):
    own = store.expressions(table(spark, sf, "nodes"), store.works(table(spark, sf, "works")))
    return expand.citations(table(spark, sf, "edges"), own)


@query(
    f"""with {_EXPR}, {_CITED}, s as (select work_urn as query_id, id from ex), h as (select distinct s.query_id, ci.id from s join ci on ci.source_id = s.id),
  f as (select query_id, h.id, row_number() over (partition by query_id order by h.id) as n from h where not exists (select 1 from s where s.query_id = h.query_id and s.id = h.id))
  select query_id, id, 1::bigint as hop from f where n <= 10"""
)
def citation_expand(spark, sf):
    own = store.expressions(table(spark, sf, "nodes"), store.works(table(spark, sf, "works")))
    return expand.cited(own.select(F.col("work_urn").alias("query_id"), "id"), table(spark, sf, "edges"), own).select("query_id", "id", big("hop"))


def _graph(spark, sf) -> engine.Graph:
    return engine.build(*(table(spark, sf, t) for t in ("works", "nodes", "edges", "concepts", "broader")))


def _asked(spark, sf, graph: engine.Graph) -> DataFrame:
    """The questions; each has the vector of one of the first usable chunks."""
    some = graph.chunks.where("size(embedding) = 64 and exists(embedding, x -> x <> 0)").orderBy("id").limit(len(QUESTIONS)).select("id", F.col("embedding").alias("vector")).collect()
    return spark.createDataFrame([(q, t, [float(x) for x in r["vector"]]) for (q, t), r in zip(QUESTIONS, sorted(some, key=lambda r: r["id"]), strict=False)], "query_id string, text string, vector array<double>")


_VEC = """uv as (select id, list_transform(embedding, lambda x: x::double) as v from ex where len(embedding) = 64 and list_sum(list_transform(embedding, lambda x: abs(x::double))) > 0),
  qv as (select 'q' || n as query_id, v from (select v, row_number() over (order by id) as n from uv) where n <= 3),
  vc as (select query_id, uv.id, row_number() over (partition by query_id order by round(list_cosine_similarity(qv.v, uv.v), 12) desc, uv.id) as rank from qv, uv)"""
_HITS = f"""{_EXPR}, {_VEC}, {_DICT}, {_grams(_Q.replace("query_id, t)", "id, t)"))}, {_MATCH},
  wq as (select v.query_id, concat_ws(' ', v.t, l.labels) as t from ({_Q}) v left join (select id as query_id, string_agg(label, ' ' order by concept_id) as labels from m group by 1) l using (query_id)),
  {_bm25("select id, text_display as t from ex", "select query_id, t from wq", 10)}, {_TOPICS},
  qc as (select id as query_id, concept_id from m union select m.id, b.child_id from m join broader b on b.parent_id = m.concept_id),
  tc as (select query_id, source_id as id, max(score) as score, count(distinct target_id) as n from tl join qc on qc.concept_id = target_id where source_id in (select id from ex) group by 1, 2),
  hits as (select query_id, id, 'vector' as channel, 0 as c, rank from vc where rank <= 10 union all select query_id, id, 'bm25', 1, rank from bm
    union all select query_id, id, 'graph', 2, rank from (select *, row_number() over (partition by query_id order by score desc, n desc, id) as rank from tc) where rank <= 10),
  rrf as (select query_id, id, sum(case channel when 'vector' then 0.8::double when 'bm25' then 1.5::double else 1.0::double end / (60 + rank)) as score, string_agg(channel, '+' order by channel) as source, min(c * 1000 + rank) as seen from hits group by 1, 2),
  fused as (select *, row_number() over (partition by query_id order by round(score, 12) desc, seen, id) as place from rrf)"""


@query(f"with {_HITS} select query_id, id, channel, rank from hits")
def channels(spark, sf):
    graph = _graph(spark, sf)
    return engine.channels(graph, _asked(spark, sf, graph), fusion.Settings()).select("query_id", "id", "channel", big("rank"))


@query(f"with {_HITS} select query_id, id, round(score, 9) as score, source, place from fused")
def rrf_fuse(spark, sf):
    graph, s = _graph(spark, sf), fusion.Settings()
    return fusion.fuse(engine.channels(graph, _asked(spark, sf, graph), s), s).select("query_id", "id", F.round("score", 9).alias("score"), "source", big("place"))


_RAW = f"""with {_HITS}, {_PARENT}, {_ONE}, {_CITED},
  wk as (select urn, title, vigenza_end from {_FIRST.format(k="urn", t="works")} where rn = 1),
  ch as (select ex.id, coalesce(t.tag_name, 'articolo') as context, coalesce(nullif(wk.title, ''), case when ex.work_urn not in ('urn:unknown', '') then ex.work_urn end, ex.id) as work_key,
    case when wk.vigenza_end < date '{DAY}' and not starts_with(coalesce(ex.text_display, ''), '[ATTENZIONE: NORMA ABROGATA]' || chr(10)) then '[ATTENZIONE: NORMA ABROGATA]' || chr(10) || coalesce(ex.text_display, '') else coalesce(ex.text_display, '') end as text
    from ex left join wk on wk.urn = ex.work_urn left join p on p.id = ex.id left join one t on t.id = p.parent_id),
  cut as (select f.query_id, f.id, f.score, f.source, f.place, ch.context, ch.work_key, ch.text from fused f join ch using (id) where place <= 5),
  gr as (select query_id, work_key, count(*) as n, max(score) as score, min(place) as spot, arg_min(id, (context, place)) as first_id,
    string_agg('--- ' || context || ' ---' || chr(10) || text, chr(10) || chr(10) order by context, place) as many, max(text) as single, max(context) as ctx, string_agg(id, ',' order by context, place) as members from cut group by 1, 2),
  src as (select query_id, work_key, string_agg(s, '+' order by s) as source from (select distinct query_id, work_key, unnest(string_split(source, '+')) as s from cut) group by 1, 2),
  mg as (select query_id, case when n = 1 then first_id else 'merged_' || first_id end as id, case when n = 1 then single else many end as text, case when n = 1 then ctx else 'MULTIPLE_CHUNKS' end as context,
    score, source, members, row_number() over (partition by query_id order by round(score, 12) desc, spot) as place from gr join src using (query_id, work_key)),
  hp as (select query_id, id, row_number() over (partition by query_id order by id) as n from (select distinct cut.query_id, ci.id from cut join ci on ci.source_id = cut.id) h
    where not exists (select 1 from cut where cut.query_id = h.query_id and cut.id = h.id))
  select query_id, place, id, text, context, round(score, 9) as score, source, members from mg
  union all select query_id, null, ch.id, ch.text, ch.context, 0.0, 'citation_hop', ch.id from hp join ch using (id) where n <= 10"""


_HYBRID = f"select query_id, place, id, md5(text) as text, context, score, source, members from ({_RAW})"


@query(_HYBRID)
def hybrid_retrieve(spark, sf):
    graph = _graph(spark, sf)
    found = engine.retrieve(graph, _asked(spark, sf, graph), F.lit(DAY).cast("date"))
    return found.select("query_id", big("place"), "id", F.md5("text").alias("text"), "context", F.round("score", 9).alias("score"), "source", F.array_join("members", ",").alias("members"))


@query(f"with r as ({_HYBRID}) select query_id, count(*) filter (place is not null) as results, count(*) filter (place is null) as hops, string_agg(id, ',' order by coalesce(place, 1000), id) as ids from r group by 1")
def prompt_sources(spark, sf):
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(1000)).alias("p"), "id")))
    found = hybrid_retrieve(spark, sf)
    return found.groupBy("query_id").agg(F.count("place").alias("results"), F.count_if(F.col("place").isNull()).alias("hops"), order.alias("o")).select("query_id", "results", "hops", F.array_join(F.transform("o", lambda x: x["id"]), ",").alias("ids"))


@query(
    f"""with r as ({_RAW}), c as (select query_id, string_agg(text, chr(10) || chr(10) order by coalesce(place, 1000000), id) as context from r group by 1)
  select q.query_id, md5('Contesto:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Domanda: ' || t || chr(10) || 'Risposta:') as prompt from ({_Q}) q left join c using (query_id)"""
)
def prompt_context(spark, sf):
    graph = _graph(spark, sf)
    found = engine.retrieve(graph, _asked(spark, sf, graph), F.lit(DAY).cast("date"))
    return engine.prompt(found, _questions(spark)).select("query_id", F.md5("prompt").alias("prompt"))


# --- documents -----------------------------------------------------------------------


def _documents(spark, sf) -> DataFrame:
    """An XML document of every row of works."""
    e = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    d = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    body = F.concat(
        F.lit('<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act><meta><identification><FRBRWork><FRBRthis value="'), e(F.col("frbr_work_uri")), F.lit('/!main"/><FRBRdate date="'), d("date_promulgation"),
        F.lit('"/><FRBRnumber value="'), e(F.col("doc_number")), F.lit('"/><FRBRname value="'), e(F.col("doc_type")), F.lit('"/></FRBRWork></identification><lifecycle><eventRef date="'), d("vigenza_start"), F.lit('"/><eventRef date="'), d("vigenza_end"),
        F.lit('"/></lifecycle></meta><preface><docTitle>'), e(F.col("title")), F.lit('</docTitle></preface><body><article id="1"><num>Art. 1</num><paragraph><num>1.</num><content><p>'), e(F.col("title")),
        F.lit(' <ref href="#art_2">art. 2</ref></p></content></paragraph><paragraph><content><p>Fine.</p></content></paragraph></article></body></act></akomaNtoso>'),
    )
    return table(spark, sf, "works").select(F.col("row_id").cast("string").alias("path"), body.alias("content"))


@query(
    r"""select row_id::varchar as path, date_promulgation as promulgated, nullif(trim(regexp_replace(title, '[\s\x0B\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')), '') as title, doc_number, doc_type,
  least(vigenza_start, vigenza_end) as first_day, case when vigenza_start <> vigenza_end then greatest(vigenza_start, vigenza_end) end as last_day,
  case when c like '/akn/%' then case when len(p) >= 4 then 'urn:nir:' || p[2] || ':' || p[1] || ':' || p[3] || ';' || p[4] else 'urn:akn:' || b end when c like 'urn:%' then c else 'urn:akn:' || c end as urn
  from (select *, string_split(trim(b, '/'), '/') as p from (select *, regexp_replace(c, '^/akn/it/act/', '') as b from (select *, regexp_replace(frbr_work_uri || '/!main', '/?!?main.*$', '') as c from works)))"""
)
def xml_parse_meta(spark, sf):
    docs = akn.parsed(_documents(spark, sf))
    return docs.select("path", F.to_date("frbr.date_promulgation").alias("promulgated"), F.col("frbr.title").alias("title"), F.col("frbr.doc_number").alias("doc_number"), F.col("frbr.doc_type").alias("doc_type"), F.to_date("frbr.vigenza_start").alias("first_day"), F.to_date("frbr.vigenza_end").alias("last_day"), F.col("frbr.urn").alias("urn"))



@query()
def embed_batch(spark, sf):
    own = store.upsert(table(spark, sf, "nodes").where("type = 'EXPRESSION'"), "id", "ingested_at", ("text_vector",))
    return enrich.embed(own, "text_vector", enrich.hash_provider()).select("id", "embedding", "embed_error")


@query(
    r"""select row_id, date, array_to_string(list_distinct(affected_urns), ' ') = '' as none, array_to_string(list_sort(list_distinct(list_filter(affected_urns, lambda u: u like 'urn:nir:%'))), ' ') as urns
  from judgements where date <> ''"""
)
def judgement_extract(spark, sf):
    """Court files made of every judgement, and what is read from them."""
    j = table(spark, sf, "judgements")
    body = F.concat(F.lit('<atto><sentenza date="'), escaped(F.col("date")), F.lit('"> visti '), escaped(F.array_join("affected_urns", " ")), F.lit(" </sentenza></atto>"))
    read = files.judgements(j.select(F.concat(F.lit("/c/"), F.col("row_id").cast("string"), F.lit(".xml")).alias("path"), body.alias("content")))
    none = j.select("row_id", (F.size(F.array_distinct("affected_urns")) <= 0).alias("none"))
    return read.select(F.split("id", ":")[1].cast("bigint").alias("row_id"), "date", F.array_join(F.array_sort("affected_urns"), " ").alias("urns")).join(none, "row_id")


@query(
    """select 'http://atti.esempio/' || edge_id || '/' as page, properties.href as href, case when properties.href like '/%' then 'http://atti.esempio' || properties.href when properties.href like '#%' then 'http://atti.esempio/' || edge_id || '/' || properties.href
  when regexp_matches(properties.href, '^[a-z]+:') then properties.href else 'http://atti.esempio/' || edge_id || '/' || properties.href end as url from edges where properties.href <> ''"""
)
def link_scrape(spark, sf):
    """Pages made of every link, and the links read from them."""
    own = table(spark, sf, "edges").select("edge_id", F.col("properties.href").alias("href"), F.col("properties.text").alias("text")).where("href <> ''")
    html = F.concat(F.lit('<html><body><p>Vedi <a class="x" href="'), escaped(F.col("href")), F.lit('"><b>'), escaped(F.col("text")), F.lit("</b></a><a>nulla</a></p>"))
    pages = own.select(F.concat(F.lit("http://atti.esempio/"), F.col("edge_id").cast("string"), F.lit("/")).alias("url"), html.alias("html"))
    return files.links(pages).select("page", "href", "url")


@query("select concept_id, label, kind from concepts")
def thesaurus_load(spark, sf):
    """RDF made of every label, and the labels read from it."""
    c = table(spark, sf, "concepts")
    tag = F.concat(F.lit("skos:"), F.col("kind"), F.lit("Label"))
    rdf = F.concat(F.lit('<rdf:RDF xmlns:rdf="r" xmlns:skos="s"><skos:Concept rdf:about="'), escaped(F.col("concept_id")), F.lit('"><'), tag, F.lit(' xml:lang="it">'), escaped(F.col("label")), F.lit("</"), tag, F.lit('><skos:altLabel xml:lang="en">x</skos:altLabel></skos:Concept></rdf:RDF>'))
    return files.thesaurus(files.triples(c.select(rdf.alias("content"))))[0]


@query(
    """select source_id, count(*) as topics, array_to_string((list(target_id order by score desc, target_id))[1:3], ',') as best from (select distinct source_id, target_id, score from edges where type = 'HAS_TOPIC' and target_id <> '') group by 1"""
)
def expressions_by_topic(spark, sf):
    """Each chunk's three best topics."""
    return topics.best(table(spark, sf, "edges"), 3).select("source_id", "topics", F.array_join("best", ",").alias("best"))


@query("select time_bucket(interval 1 hour, ts) as start, event_type as kind, count(*) as n from events group by 1, 2")
def event_windows(spark, sf):
    """The streaming aggregate run over a finished table."""
    from lexloom.streaming.incremental import counts_by_window

    return counts_by_window(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour", "2 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n")

"""Queries of the general data problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.urns import act_uri_to_urn
from lexloom.operators.hierarchy import descendants, hierarchy
from lexloom.operators.intervals import periods_and_gaps
from lexloom.operators.orphans import EVER, NEVER, orphans, spells
from lexloom.operators.shred import objects, related, table_of
from lexloom.tables import Shelf, table

#: Names of the repeated fields of a document's JSON (fixed values).
LISTS = ("nodes", "children", "refs", "mods", "quoted", "events", "iter_legis")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects(table(spark, sf_dir, "raw_records"), "raw_id", "payload", LISTS, ("eid", "tag_name"), ("metadata",))
    return rows.fillna("", ["eid", "tag_name"])


def p1_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects of each repeated ancestor give a field, and how many of them as null."""
    rows = related(table(spark, sf_dir, "raw_records"), "raw_id", "payload", LISTS, ("metadata",))
    each = rows.select("ancestor", F.explode_outer("fields").alias("field", "value"))
    return each.groupBy("ancestor", "field").agg(F.count("*").alias("given"), F.count_if(F.col("value").isNull() & F.col("field").isNotNull()).alias("nulls"))


def p1_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of references of nodes of the first level, with the node each belongs to."""
    rows = related(table(spark, sf_dir, "raw_records"), "raw_id", "payload", LISTS, ("metadata",))
    refs = table_of(rows, "nodes[].metadata.refs[]", ("href", "text", "range.range_from", "range.range_to"))
    return refs.select("raw_id", "path", "parent_path", "href", "text", F.col("`range.range_from`").alias("range_from"), F.col("`range.range_to`").alias("range_to"))


def _part_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "edges").where("type = 'PART_OF'").select(F.col("source_id").alias("child"), F.col("target_id").alias("parent"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nodes")
    tree = hierarchy(nodes.select("id"), _part_of(spark, sf_dir), with_paths=False)
    levels = nodes.where("id is not null").groupBy("id").agg(F.min("level").alias("lo"), F.max("level").alias("hi"), F.bool_or(F.col("level").isNull()).alias("none"))
    wrong = F.col("cyclic") | F.col("none") | (F.col("lo") != F.col("depth")) | (F.col("hi") != F.col("depth"))
    return tree.join(levels, "id").where(wrong).select(F.col("id").alias("node_id"), F.col("root").alias("root_id"))


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy(table(spark, sf_dir, "nodes").select("id"), _part_of(spark, sf_dir))
    return tree.select(F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), F.col("depth").cast("bigint").alias("depth"), "cyclic", F.array_join("path", "/").alias("path"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy(table(spark, sf_dir, "nodes").select("id"), _part_of(spark, sf_dir))
    return descendants(tree).select("ancestor", "descendant", F.col("distance").cast("bigint").alias("distance"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "works").select(F.col("urn").alias("key"), F.col("vigenza_start").alias("first"), F.col("vigenza_end").alias("last"))
    return periods_and_gaps(rows).withColumnRenamed("key", "urn")


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges with the scope of their target and its normalised key."""
    e = table(spark, sf_dir, "edges")
    scope = F.when(F.col("type") == "HAS_TOPIC", "concept").when(F.col("type").isin("PART_OF", "NEXT"), "node").otherwise("any")
    key = F.when(scope == "any", F.coalesce(act_uri_to_urn(F.col("target_id")), F.col("target_id"))).otherwise(F.col("target_id"))
    no_reference = F.col("target_id").rlike("(?i)^https?:") | (F.col("target_id") == "urn:unknown:modification")
    return e.where(~F.coalesce(no_reference, F.lit(False))).select("edge_id", "type", scope.alias("scope"), key.alias("key"), F.col("ingested_at").alias("at"))


def _orphan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, works, concepts, gone = (table(spark, sf_dir, t) for t in ("nodes", "works", "concepts", "deletions"))
    dead = lambda t: gone.where(F.col("table_name") == t).select(F.col("entity_key").alias("key"), F.col("deleted_at").alias("at"))
    born = nodes.where("id is not null").groupBy("id").agg(F.min("ingested_at").alias("since"))
    node_dead = dead("nodes").where("key is not null").groupBy(F.col("key").alias("id")).agg(F.min("at").alias("until"))
    # both are read twice: node spans for nodes and places, all spans by both anti-joins
    shelf = Shelf(spark, "spans")
    node_spans, _ = shelf.put(born.join(node_dead, "id", "left").select("id", "since", F.coalesce("until", F.lit(NEVER).cast("timestamp_ntz")).alias("until")))
    places = nodes.where("eid is not null and work_urn is not null").select("id", F.concat("work_urn", F.lit("#"), "eid").alias("key")).distinct()
    ever, never = F.lit(EVER).cast("timestamp_ntz"), F.lit(NEVER).cast("timestamp_ntz")
    spans = (
        node_spans.select(F.lit("nodes").alias("referred"), F.col("id").alias("key"), "since", "until")
        .unionByName(places.join(node_spans, "id").select(F.lit("places").alias("referred"), "key", "since", "until"))
        .unionByName(spells(works.select(F.col("urn").alias("key"), F.col("ingested_at").alias("at")), dead("works"), "works"))
        .unionByName(concepts.where("concept_id is not null").groupBy(F.col("concept_id").alias("key")).agg(F.min("retired_at").alias("until")).select(F.lit("concepts").alias("referred"), "key", ever.alias("since"), F.coalesce("until", never).alias("until")))
    )
    allowed = F.when(F.col("u.scope") == "concept", F.col("s.referred") == "concepts").when(F.col("u.scope") == "node", F.col("s.referred") == "nodes").otherwise(F.col("s.referred") != "concepts")
    return orphans(_references(spark, sf_dir), shelf.put(spans)[0], allowed)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphan_edges(spark, sf_dir).select("edge_id")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table that the key's form refers to, type and month."""
    k = F.coalesce(F.col("key"), F.lit(""))
    referred = F.when(F.col("scope") == "concept", "concepts").when((F.col("scope") == "node") | k.rlike("^[0-9a-f]{16}$") | k.contains("#"), "nodes").otherwise("works")
    return _orphan_edges(spark, sf_dir).groupBy(referred.alias("referred"), "type", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("orphans"))


QUERIES = {f.__name__: f for f in (p1_found, p1_fields, p1_refs, p3_found, p3_hierarchy, p3_descendants, p4_found, p6_found, p6_counts)}

_TREE = """
with recursive ids as (select distinct id from nodes where id is not null),
link as (select e.source_id as id, min(e.target_id) as parent from edges e join ids p on p.id = e.target_id
         where e.type = 'PART_OF' group by 1),
node as (select i.id, l.parent from ids i left join link l on l.id = i.id),
tree as (select id, id as root, 0::bigint as depth, id as path from node where parent is null
         union all
         select n.id, t.root, t.depth + 1, t.path || '/' || n.id from node n join tree t on n.parent = t.id),
loose as (select id, parent from node where id not in (select id from tree)),
walk as (select id, parent as spot, 1 as n from loose
         union
         select w.id, l.parent, w.n + 1 from walk w join loose l on w.spot = l.id where w.n < 2 * (select count(*) from loose) and w.n < 2000),
ring as (select distinct id from walk where id = spot),
lap as (select r.id, min(w.spot) as root from ring r join walk w on w.id = r.id group by 1),
led as (select l.id, min(p.root) as root from loose l join walk w on w.id = l.id join lap p on p.id = w.spot group by 1),
lost as (select id, coalesce((select root from lap where lap.id = led.id), root) as root from led)
"""

SQL = {
    "p3_found": _TREE
    + """
select distinct n.id as node_id, coalesce(t.root, c.root) as root_id
from nodes n left join tree t on t.id = n.id left join lost c on c.id = n.id
where n.id is not null and (t.id is null or n.level is distinct from t.depth)""",
    "p3_hierarchy": _TREE
    + """
select n.id as node_id, n.parent as parent_id, coalesce(t.root, c.root) as root_id, t.depth as depth, t.id is null as cyclic, t.path as path
from node n left join tree t on t.id = n.id left join lost c on c.id = n.id""",
    "p3_descendants": _TREE.rstrip()
    + """,
below as (select parent as ancestor, id as descendant, 1::bigint as distance from node where parent is not null and id in (select id from tree)
          union all
          select n.parent, b.descendant, b.distance + 1 from below b join node n on n.id = b.ancestor where n.parent is not null)
select ancestor, descendant, distance from below""",
    "p4_found": """
with v as (select urn, vigenza_start - date '0001-01-01' as a, coalesce(vigenza_end - date '0001-01-01', 4194304) as b from works
           where urn is not null and vigenza_start is not null and (vigenza_end is null or vigenza_end >= vigenza_start)),
m as (select *, max(b) over (partition by urn order by a, b rows between unbounded preceding and 1 preceding) as before from v),
g as (select *, sum(case when before is null or a > before + 1 then 1 else 0 end) over (partition by urn order by a, b rows unbounded preceding) as n from m),
p as (select urn, n, min(a) as a, max(b) as b from g group by urn, n),
x as (select urn, 'period' as kind, a, b from p
      union all
      select * from (select urn, 'gap' as kind, b + 1 as a, lead(a) over (partition by urn order by n) - 1 as b from p) where b is not null)
select urn, kind, strftime(date '0001-01-01' + a::int, '%Y-%m-%d') as first_day,
  case when b = 4194304 then '' else strftime(date '0001-01-01' + b::int, '%Y-%m-%d') end as last_day
from x""",
}

_ORPHANS = r"""
with e as (select edge_id, type, ingested_at as ts, coalesce(target_id, '') as t,
  case when type = 'HAS_TOPIC' then 'concept' when type in ('PART_OF', 'NEXT') then 'node' else 'any' end as scope from edges),
r as (select edge_id, type, ts, scope, case when scope = 'any' and regexp_matches(t, '^/akn/it/act/[^/]+/[^/]+/[^/]+/[^/]+?(/?!?main)?/?$')
  then regexp_replace(t, '^/akn/it/act/([^/]+)/([^/]+)/([^/]+)/([^/]+?)(/?!?main)?/?$', 'urn:nir:\2:\1:\3;\4') else t end as key
  from e where not regexp_matches(lower(t), '^https?:') and t <> 'urn:unknown:modification'),
n as (select id, since, coalesce(until, timestamp '9999-12-31 23:59:59') as until from (select id, min(ingested_at) as since from nodes group by 1)
  left join (select entity_key as id, min(deleted_at) as until from deletions where table_name = 'nodes' group by 1) using (id)),
w as (select urn, since, coalesce(until, timestamp '9999-12-31 23:59:59') as until from (select urn, min(ingested_at) as since from works group by 1)
  left join (select entity_key as urn, min(deleted_at) as until from deletions where table_name = 'works' group by 1) using (urn)),
s as (select 'node' as kind, id as key, since, until from n
  union all select distinct 'place', work_urn || '#' || eid, since, until from nodes join n using (id) where eid is not null
  union all select 'work', urn, since, until from w
  union all select 'concept', concept_id, timestamp '0001-01-01', coalesce(min(retired_at), timestamp '9999-12-31 23:59:59') from concepts group by concept_id),
o as (select * from r where not exists (select 1 from s where s.key = r.key and s.since <= r.ts and s.until > r.ts and
  case r.scope when 'concept' then s.kind = 'concept' when 'node' then s.kind = 'node' else s.kind <> 'concept' end))
"""
SQL["p6_found"] = _ORPHANS + "select edge_id from o"
SQL["p6_counts"] = (
    _ORPHANS
    + """
select case when scope = 'concept' then 'concepts' when scope = 'node' or regexp_matches(key, '^[0-9a-f]{16}$') or contains(key, '#') then 'nodes' else 'works' end as referred,
  type, strftime(ts, '%Y-%m') as month, count(*) as orphans
from o group by 1, 2, 3"""
)

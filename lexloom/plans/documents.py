"""Queries of the parser: documents made of every act, and what is read from them, value by value; their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.dates import iso_date, reference_date
from lexloom.operators import store
from lexloom.sources import akn, files
from lexloom.tables import Shelf, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def note(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return note


def escaped(c: Column) -> Column:
    """A column's text within XML."""
    out = F.coalesce(c, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def made(template: str, **values: Column) -> Column:
    """The template with each [NAME] replaced by that column's text."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit(f"[{name}]"), c)
    return out


#: An act with all that the parser tells apart: given, numeric, missing and repeated names, references of all kinds, modifications, a table, attachments.
ACT = """<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act><meta><identification><FRBRWork><FRBRalias name="urn:nir" value="urn:nir:stato:legge:[N]"/>
<FRBRalias name="eli" value="eli/[N]"/></FRBRWork></identification></meta><body><chapter eId="chp_1"><num>CAPO I</num><heading>Atto [T]</heading><article eId="art_1"><num>Art. 1.</num>
<paragraph eId="para_1"><num>1.</num><content eId="x"><p>Atto [T] di <ref href="/akn/it/act/legge/stato/2001-01-01/[N]/!main">legge</ref> e <rref from="#art_2" upTo="#art_5">artt. 2-5</rref></p></content></paragraph>
<paragraph id="2"><mod>L'articolo <ref href="#art_9">9</ref> è sostituito dal seguente: <quotedText>nuovo [N]</quotedText></mod></paragraph><paragraph><p>Il comma <mod>è abrogato</mod></p></paragraph>
<paragraph id="2"><num>2.</num> <p>Vedi <mref><ref href="urn:nir:a:[N]">a</ref> e <ref href="art_7">b</ref></mref> <i>poi</i> <b>tanto</b> Atto [T]</p></paragraph>
<table><tr><th>a</th><th>b</th></tr><tr><td>[N]</td><td>Atto [T]</td></tr><tr><td>x</td></tr></table></article></chapter></body>
<attachments><attachment eId="all_1"><num>Allegato A</num><paragraph eId="prima"><p>Fine Atto [T]</p></paragraph></attachment></attachments></act></akomaNtoso>"""

#: What must come out of it: name, level, tag, num, heading, text, text with context, text shown ([A]: 'Atto' and the title, [N]: the number).
_STRUCTURES = (
    ("body", 0, "body", None, None),
    ("chp_1", 1, "chapter", "CAPO I", "[A]"),
    ("chp_1__art_1", 2, "article", "Art. 1.", None),
    ("chp_1__art_1__para_1", 3, "paragraph", "1.", None),
    ("attachments", 1, "attachments", None, "Allegati"),
    ("attachments__all_1", 2, "attachment", "Allegato A", None),
)
_IN = "CAPO I - [A] > Art. 1."
_GRID = "| a | b |\n| --- | --- |\n| [N] | [A] |\n| x |  |"
_CHUNKS = (
    ("chp_1__art_1__para_1__contentx", 4, "content", None, "[A] di legge e artt. 2-5", f"{_IN} > 1.: [A] di legge e artt. 2-5", "[A] di [legge](/akn/it/act/legge/stato/2001-01-01/[N]/!main) e artt. 2-5"),
    ("chp_1__art_1__paragraph2", 3, "paragraph", None, "L'articolo 9 è sostituito dal seguente: nuovo [N]", f"{_IN}: L'articolo 9 è sostituito dal seguente: nuovo [N]", "L'articolo [9](#art_9) è sostituito dal seguente: nuovo [N]"),
    ("chp_1__art_1__gen_paragraph_1", 3, "paragraph", None, "Il comma è abrogato", f"{_IN}: Il comma è abrogato", "Il comma è abrogato"),
    ("chp_1__art_1__paragraph2-n2", 3, "paragraph", "2.", "2. Vedi a e b poi tanto [A]", f"{_IN} > 2: 2. Vedi a e b poi tanto [A]", "Vedi [a](urn:nir:a:[N]) e [b](art_7) *poi* **tanto** [A]"),
    ("chp_1__art_1__gen_table_2", 3, "table", None, _GRID, f"{_IN} > Tabella: Riga 1: a=[N], b=[A]. Riga 2: a=x", _GRID),
    ("attachments__all_1__prima", 3, "paragraph", None, "Fine [A]", "Allegato > Allegato A: Fine [A]", "Fine [A]"),
)
#: Source, type, target (a name of the act, or what is written there), address, text, range from and to, quoted text, class.
_C, _P = "chp_1__art_1__para_1__contentx", "chp_1__art_1__"
_LINKS = (
    *((s, "PART_OF", t) + (None,) * 6 for s, t in (("chp_1", "body"), ("chp_1__art_1", "chp_1"), (f"{_P}para_1", "chp_1__art_1"), (_C, f"{_P}para_1"), (f"{_P}paragraph2", "chp_1__art_1"), (f"{_P}gen_paragraph_1", "chp_1__art_1"), (f"{_P}paragraph2-n2", "chp_1__art_1"), (f"{_P}gen_table_2", "chp_1__art_1"), ("attachments", "body"), ("attachments__all_1", "attachments"), ("attachments__all_1__prima", "attachments__all_1"))),
    *((s, "NEXT", t) + (None,) * 6 for s, t in ((f"{_P}para_1", f"{_P}paragraph2"), (f"{_P}paragraph2", f"{_P}gen_paragraph_1"), (f"{_P}gen_paragraph_1", f"{_P}paragraph2-n2"), (f"{_P}paragraph2-n2", f"{_P}gen_table_2"))),
    (_C, "CITES", "=/akn/it/act/legge/stato/2001-01-01/[N]/!main", "/akn/it/act/legge/stato/2001-01-01/[N]/!main", "legge", None, None, None, None),
    (_C, "CITES", "art_2", "#art_2", "artt. 2-5", "#art_2", "#art_5", None, None),
    (f"{_P}paragraph2", "MODIFIES", "art_9", "#art_9", "L'articolo 9 è sostituito dal seguente: nuovo [N]", None, None, "nuovo [N]", "SUBSTITUTION"),
    (f"{_P}paragraph2", "CITES", "art_9", "#art_9", "9", None, None, None, None),
    (f"{_P}gen_paragraph_1", "MODIFIES", "=urn:unknown:modification", None, "è abrogato", None, None, None, "REPEAL"),
    (f"{_P}paragraph2-n2", "CITES", "=urn:nir:a:[N]", "urn:nir:a:[N]", "a", None, None, None, None),
    (f"{_P}paragraph2-n2", "CITES", "=urn:nir:stato:legge:[N]#art_7", "art_7", "b", None, None, None, None),
)


def _said(x: str | None) -> str:
    """A text with [A] and [N] as SQL."""
    if x is None:
        return "null::varchar"
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("[A]", "' || a || '").replace("[N]", "' || n || '") + "'"


_ACTS = r"acts as (select row_id::varchar as n, trim(regexp_replace('Atto ' || coalesce(title, ''), '[\s\x0B\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) as a from works)"


def _rows(rows: tuple, names: tuple[str, ...], where: str = "acts") -> str:
    each = ", ".join("{" + ", ".join(f"'{k}': {v if isinstance(v, int) else _said(v)}" for k, v in zip(names, r, strict=True)) + "}" for r in rows)
    return f"select n, unnest([{each}]) as x from {where}"


def _acts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "works").select(F.col("row_id").cast("string").alias("path"), made(ACT, T=escaped(F.col("title")), N=F.col("row_id").cast("string")).alias("content"))
    return akn.parsed(rows)


@query(
    f"""with {_ACTS}, s as ({_rows(_STRUCTURES, ("eid", "level", "tag", "num", "heading"))}), c as ({_rows(_CHUNKS, ("eid", "level", "tag", "num", "text", "vector", "display"))}),
  r as (select n, x.eid as eid, 'STRUCTURAL' as type, x.level as level, x.tag as tag_name, x.num as num, x.heading as heading, null::varchar as text, null::varchar as vector, null::varchar as display, false as is_modifier from s
    union all select n, x.eid, 'EXPRESSION', x.level, x.tag, x.num, null, md5(x.text), md5(x.vector), md5(x.display), x.eid like '%paragraph2' or x.eid like '%gen_paragraph_1' from c)
  select n as path, substr(sha256('urn:nir:stato:legge:' || n || '#' || eid), 1, 16) as id, eid, type, level::bigint as level, tag_name, num, heading, text, vector, display, is_modifier, tag_name = 'table' as is_table from r"""
)
def xml_parse_nodes(spark, sf):
    """Every node of every act."""
    own = _acts(spark, sf).where("error is null").select("path", F.inline("nodes"))
    is_ = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return own.select("path", "id", "eid", "type", F.col("level").cast("bigint").alias("level"), "tag_name", "num", "heading", F.md5("text_content").alias("text"), F.md5("text_vector").alias("vector"), F.md5("text_display").alias("display"), is_("is_modifier"), is_("is_table"))


_ID = "substr(sha256('urn:nir:stato:legge:' || n || '#' || {}), 1, 16)"
_LINKED = _rows(_LINKS, ("source", "type", "target", "href", "text", "range_from", "range_to", "quoted_text", "class"))


@query(
    f"""with {_ACTS}, l as ({_LINKED}) select n as path, {_ID.format("x.source")} as source_id, case when starts_with(x.target, '=') then x.target[2:] else {_ID.format("x.target")} end as target_id, x.type as type,
  x.href as href, x.text as text, x.range_from as range_from, x.range_to as range_to, x.quoted_text as quoted_text, x.class as modification_type from l"""
)
def xml_parse_edges(spark, sf):
    """Every edge of every act."""
    own = _acts(spark, sf).where("error is null").select("path", F.inline("edges")).dropDuplicates()
    return own.select("path", "source_id", "target_id", "type", *(f"properties.{c}" for c in ("href", "text", "range_from", "range_to", "quoted_text", "modification_type")))


@query(f"with {_ACTS}, l as ({_LINKED}) select n as path, x.source as eid, x.target as next_eid from l where x.type = 'NEXT'")
def next_chain(spark, sf):
    """Chain of each act's nodes of a level, by names."""
    docs = _acts(spark, sf).where("error is null").select("path", F.inline("edges"), "nodes").where("type = 'NEXT'")
    name = lambda c: F.filter("nodes", lambda x: x["id"] == F.col(c))[0]["eid"]
    return docs.select("path", name("source_id").alias("eid"), name("target_id").alias("next_eid"))


@query(
    """with p as (select row_id::varchar as path, unnest(range(1, (2 + row_id % 4)::bigint)) as i from works)
  select path, 'article1__paragraph7' || case when i > 1 then '-n' || i else '' end as eid from p"""
)
def occurrence_suffix(spark, sf):
    """Names of paragraphs that an act calls alike, one to four times."""
    times = (1 + F.pmod("row_id", F.lit(4))).cast("int")
    body = F.concat(F.lit("<akomaNtoso><act><meta/><body><article id='1'>"), F.repeat(F.lit("<paragraph id='7'><p>x</p></paragraph>"), times), F.lit("</article></body></act></akomaNtoso>"))
    docs = akn.parsed(table(spark, sf, "works").select(F.col("row_id").cast("string").alias("path"), body.alias("content")))
    return docs.select("path", F.inline("nodes")).where("type = 'EXPRESSION'").select("path", "eid")


NIR = """<NIR xmlns="http://www.normeinrete.it/nir/2.2/"><Legge><meta><descrittori><urn valore="[U]"/></descrittori></meta><intestazione><tipoDoc>Legge [K]</tipoDoc>
<dataDoc norm="[D]">un giorno</dataDoc><numDoc>[K]</numDoc><titoloDoc>Atto [T]</titoloDoc></intestazione><articolato><articolo id="1"><num>1</num><comma id="1"><corpo>Testo [N]</corpo></comma></articolo></articolato></Legge></NIR>"""


@query(
    f"""with {_ACTS}, w as (select row_id, strftime(date_promulgation, '%Y-%m-%d') as day, trim(doc_number) as k, a from works join acts on n = row_id::varchar)
  select row_id::varchar as path, case when row_id % 3 = 0 then 'urn:fallback:' || substr(sha256(a || '_' || day), 1, 16) else 'urn:nir:stato:legge;' || row_id end as urn,
    day::date as promulgated, day::date as first_day, a as title, trim('Legge ' || k) as doc_type, k as doc_number, 'articolo1__comma1' as eid, 'Testo ' || row_id as text from w"""
)
def xml_parse_nir(spark, sf):
    """Acts in the older format; every third names no URN."""
    n = F.col("row_id").cast("string")
    urn = F.when(F.col("row_id") % 3 == 0, "urn:").otherwise(F.concat(F.lit("urn:nir:stato:legge;"), n))
    content = made(NIR, U=urn, K=escaped(F.col("doc_number")), D=F.date_format("date_promulgation", "yyyyMMdd"), T=escaped(F.col("title")), N=n)
    docs = akn.parsed(table(spark, sf, "works").select(n.alias("path"), content.alias("content")))
    chunk = F.filter("nodes", lambda x: x["type"] == "EXPRESSION")[0]
    return docs.select("path", "frbr.urn", F.to_date("frbr.date_promulgation").alias("promulgated"), F.to_date("frbr.vigenza_start").alias("first_day"), "frbr.title", "frbr.doc_type", "frbr.doc_number", chunk["eid"].alias("eid"), chunk["text_content"].alias("text"))


@query("select row_id::varchar as path, row_id % 4 as kind, row_id % 4 < 3 as failed from works")
def xml_parse_errors(spark, sf):
    """Acts that can't be parsed beside ones that can: none at all, no element, no header, and a torn one that is read all the same."""
    n = F.col("row_id") % 4
    content = F.when(n == 0, None).when(n == 1, "plain < text").when(n == 2, "<akomaNtoso><act><body/></act></akomaNtoso>").otherwise("<akomaNtoso><act><meta/><body><article><p>x</body>")
    docs = akn.parsed(table(spark, sf, "works").select(F.col("row_id").cast("string").alias("path"), content.alias("content")))
    return docs.select("path", F.pmod(F.col("path").cast("bigint"), F.lit(4)).alias("kind"), F.col("error").isNotNull().alias("failed"))


@query("select row_id::varchar as path, 'urn:nir:stato:legge:' || row_id as urn, 'eli/' || row_id as eli, 12::bigint as nodes from works")
def documents_jsonl(spark, sf):
    """Acts written as JSON lines and read again, one of three spoilt: a line without a URN, and one that is no JSON, are left out."""
    shelf = Shelf(spark, "jsonl")
    place = f"{shelf.at}/lines"
    files.write_jsonl(_acts(spark, sf), place)
    broken = spark.range(100).select(F.when(F.col("id") % 2 == 0, '{"frbr": {"eli": "x"}}').otherwise("{broken").alias("value"))
    broken.write.mode("append").text(place)
    return files.documents_jsonl(spark, place).select("path", "frbr.urn", "frbr.eli", F.size("nodes").cast("bigint").alias("nodes"))


@query(
    """with s as (select distinct replace(related_work_urn, ':', '/') || '/x' as uri, coalesce(date, '') as date, coalesce(description, '') as description, authority from iter_steps where related_work_urn is not null)
  select distinct substr(sha256(uri || '#' || date), 1, 16) as id, date, coalesce(authority, 'Camera dei Deputati') as authority,
    list_extract(list_filter(string_split(uri, '/'), lambda p: p <> ''), -2) || ':x' as related_work_urn, md5(description) as description from s"""
)
def chamber_steps(spark, sf):
    """Steps written as JSON lines, twice, and read again."""
    place = f"{Shelf(spark, 'steps').at}/lines"
    rows = table(spark, sf, "iter_steps").where("related_work_urn is not null").select(F.concat(F.replace("related_work_urn", F.lit(":"), F.lit("/")), F.lit("/x")).alias("uri"), "row_id", F.col("description").alias("title"), "date", "authority")
    for _ in range(2):
        rows.write.mode("append").json(place)
    return files.chamber_steps(spark, place).select("id", "date", "authority", "related_work_urn", F.md5("description").alias("description")).distinct()


def _results(spark: SparkSession, rows: DataFrame, times: int = 1) -> str:
    """Where the rows lie as SPARQL results, one a line; nulls are unbound."""
    place = f"{Shelf(spark, 'results').at}/lines"
    bound = F.struct(*(F.when(F.col(c).isNotNull(), F.struct(F.lit("literal").alias("type"), F.col(c).alias("value"))).alias(c) for c in rows.columns))
    for _ in range(times):
        rows.select(F.to_json(F.struct(F.struct(F.array(bound).alias("bindings")).alias("results"))).alias("value")).write.mode("append").text(place)
    return place


@query(
    """select frbr_work_uri as uri, doc_number as number, title, 'http://x/' || row_id as xml_url, 'ddl_' || regexp_replace(coalesce(doc_number, 'NA'), '[^A-Za-z0-9.-]', '', 'g') || '.xml' as file
  from works where row_id % 2 = 0"""
)
def bill_files(spark, sf):
    """Bills of a SPARQL result; those without an XML address aren't fetched."""
    url = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("http://x/"), F.col("row_id").cast("string")))
    return files.bills(spark, _results(spark, table(spark, sf, "works").select(F.col("frbr_work_uri").alias("uri"), F.col("doc_number").alias("number"), "title", url.alias("xml_url"))), True)


@query(
    r"""with w as (select frbr_work_uri as uri, 'C' || row_id as celex, title, strftime(date_promulgation, '%Y-%m-%d') as date from works)
  select uri, celex, title, date, date || '_' || celex || '_' || left(regexp_replace(coalesce(title, ''), '[^\p{L}\p{N}]+', '_', 'g'), 100) as file from w where date >= '2000-01-01'"""
)
def eu_files(spark, sf):
    """EU acts of a SPARQL result that was fetched twice, from a day on."""
    rows = table(spark, sf, "works").select(F.col("frbr_work_uri").alias("uri"), F.concat(F.lit("C"), F.col("row_id").cast("string")).alias("celex"), "title", F.date_format("date_promulgation", "yyyy-MM-dd").alias("date"))
    return files.eu_acts(spark, _results(spark, rows, 2), "2000-01-01", lines=True)


@query(
    """select 'http://corte.esempio/p/' || row_id || '/' || case when row_id % 3 = 0 then 'pronunce' when row_id % 3 = 1 then 'Dati' else 'altro' end || '/' || row_id || case when row_id % 2 = 0 then '.XML' else '.zip' end as url
  from works where row_id % 3 < 2 and (row_id % 2 = 0 or row_id % 5 = 0)"""
)
def court_links(spark, sf):
    """Files of pronouncements that pages made of every act link to, each page twice."""
    n = F.col("row_id").cast("string")
    folder = F.when(F.col("row_id") % 3 == 0, "pronunce").when(F.col("row_id") % 3 == 1, "Dati").otherwise("altro")
    href = F.concat(folder, F.lit("/"), n, F.when(F.col("row_id") % 2 == 0, ".XML").otherwise(".zip"))
    shown = F.when(F.col("row_id") % 5 == 0, "file xml").otherwise("file")
    html = F.concat(F.lit("<p><a href='"), href, F.lit("'>"), shown, F.lit("</a> <a href='/pronunce/elenco.html'>tutte</a></p>"))
    pages = table(spark, sf, "works").select(F.concat(F.lit("http://corte.esempio/p/"), n, F.lit("/")).alias("url"), html.alias("html"))
    return files.court_files(pages.unionByName(pages))


@query("select work_urn, count(*) as nodes from nodes where level >= 2 group by 1 having not bool_or(type = 'STRUCTURAL')")
def doc_validation(spark, sf):
    """Acts whose nodes from the second level down hold no STRUCTURAL one."""
    return store.documents_without_structure(table(spark, sf, "nodes").where("level >= 2"))


_DAY = """coalesce(try_strptime(case when regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$') then date end, '%Y-%m-%d'), try_strptime(case when regexp_matches(date, '^\\d{8}$') then date end, '%Y%m%d'))::date"""


@query(f"select row_id, {_DAY} is null as missing, coalesce({_DAY}, current_date) >= date '2000-01-01' as recent from iter_steps")
def reference_day(spark, sf):
    """Days of reference: the date given, or today where there is none."""
    return table(spark, sf, "iter_steps").select("row_id", iso_date(F.col("date")).isNull().alias("missing"), (reference_date(F.col("date")) >= F.lit("2000-01-01").cast("date")).alias("recent"))

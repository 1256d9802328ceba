"""Local files of the sources, and what is written."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.classify import step_class
from lexloom.functions.urns import last_segments, node_id, urns_in
from lexloom.sources import akn, xml

#: Elements that hold a pronouncement, and its type (fixed values).
PRONOUNCEMENTS = {"sentenza": "Sentenza", "ordinanza": "Ordinanza", "pronuncia": "Pronuncia", "decisione": "Decisione"}


def valid() -> Column:
    """Whether a parsed document has a URN and, if it has nodes, a STRUCTURAL one."""
    none = F.coalesce(F.size("nodes"), F.lit(0)) <= 0
    return F.col("frbr.urn").isNotNull() & (none | F.exists("nodes", lambda n: n["type"] == "STRUCTURAL"))


def documents_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents from JSON lines; blank, malformed and invalid lines are left out.

    A document is invalid without a URN, or if it has nodes but no STRUCTURAL one.
    """
    return spark.read.schema(akn.SCHEMA).option("mode", "DROPMALFORMED").json(path).where(valid())


def write_jsonl(docs: DataFrame, path: str) -> None:
    """One document a line."""
    docs.where("error is null").write.mode("overwrite").json(path)


def pretty(docs: DataFrame) -> DataFrame:
    """Documents as indented JSON texts, a reader's form."""
    return docs.select("path", F.to_json(F.struct(*[c for c in docs.columns if c != "path"]), {"pretty": "true"}).alias("json"))


def chamber_steps(spark: SparkSession, path: str) -> DataFrame:
    """Steps from JSON lines of chamber acts; files that were appended to twice give each step once."""
    raw = spark.read.schema("uri string, number string, title string, date string, authority string").option("mode", "DROPMALFORMED").json(path)
    c = lambda n, d="": F.coalesce(F.col(n), F.lit(d))
    return raw.where("uri is not null").select(
        node_id(c("uri"), c("date")).alias("id"), c("date").alias("date"), c("title").alias("description"), step_class(F.col("title")).alias("step_type"),
        c("authority", "Camera dei Deputati").alias("authority"), last_segments(F.col("uri")).alias("related_work_urn"),
    ).distinct()


def _pronounced(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                root = xml.parse(raw)
            except ValueError:
                continue
            for e in [x for x in root.walk() if x.tag in PRONOUNCEMENTS] or [root]:
                inner = e.below("data", "date")
                date = e.attrs.get("date") or e.attrs.get("data") or (inner.attrs.get("valore") or xml.clean(inner.text()) if inner is not None else None)
                if date:
                    rows.append({"path": path, "date": date, "judgement_type": PRONOUNCEMENTS.get(e.tag, "Decisione"), "text": xml.clean(e.text())})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def judgements(files: DataFrame, court: str = "Corte Costituzionale") -> DataFrame:
    """Judgements of court files (``path, content``); those without a date are left out.

    The id joins the file's name, the date and the place within both, so that two
    pronouncements of a day don't collide.
    """
    schema = pa.schema([(n, pa.string()) for n in ("path", "date", "judgement_type", "text")])
    rows = files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(partial(_pronounced, schema=schema), "path string, date string, judgement_type string, text string")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return rows.select(F.concat_ws(":", F.lit("cortecost"), stem, "date", F.substring(F.md5("text"), 1, 8)).alias("id"), "date", F.left("text", F.lit(500)).alias("description"), F.lit(court).alias("court"), "judgement_type", F.lit(None).cast("string").alias("judgement_result"), urns_in(F.col("text")).alias("affected_urns"))


def sparql_rows(spark: SparkSession, path: str, names: tuple[str, ...], lines: bool = False) -> DataFrame:
    """Bindings of SPARQL JSON results as columns; an unbound variable is null. A file is one result, or has one a line (pages fetched one after the other)."""
    struct = ", ".join(f"`{n}`: struct<value: string>" for n in names)
    raw = spark.read.option("multiLine", not lines).schema(f"results struct<bindings: array<struct<{struct}>>>").json(path)
    return raw.select(F.explode("results.bindings").alias("b")).select(*(F.col(f"b.`{n}`.value").alias(n) for n in names))


def bills(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Bills with an XML address, and the name their file gets."""
    rows = sparql_rows(spark, path, ("uri", "number", "title", "xml_url"), lines)
    return rows.where("xml_url is not null").withColumn("file", F.concat(F.lit("ddl_"), F.regexp_replace(F.coalesce("number", F.lit("NA")), "[^A-Za-z0-9.-]", ""), F.lit(".xml")))


def eu_acts(spark: SparkSession, path: str, since: str, limit: int = 0, lines: bool = False) -> DataFrame:
    """EU acts from a day on, each by its CELEX number once; the first ``limit`` by date, if one is asked for."""
    rows = sparql_rows(spark, path, ("uri", "celex", "title", "date"), lines).where(F.col("celex").isNotNull() & (F.col("date") >= since)).dropDuplicates(["celex"])
    clean = F.left(F.regexp_replace(F.coalesce("title", F.lit("")), r"[^\p{L}\p{N}]+", "_"), F.lit(100))
    named = rows.withColumn("file", F.concat_ws("_", "date", "celex", clean))
    return named.orderBy("date", "celex").limit(limit) if limit else named


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = dict(attrs).get("href")
            self.inside = href is not None
            if self.inside:
                self.found.append([href, ""])

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "a"

    def handle_data(self, data):
        if self.inside:
            self.found[-1][1] += data


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p = _Links()
            p.feed(html or "")
            rows += [{"page": url, "href": h, "text": xml.clean(t), "url": urljoin(url or "", h)} for h, t in p.found]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.string()) for n in ("page", "href", "text", "url")]))


def links(pages: DataFrame) -> DataFrame:
    """``(page, href, text, url)`` of every link of pages (``url, html``); ``url`` is absolute."""
    return pages.select("url", "html").mapInArrow(_links, "page string, href string, text string, url string")


def court_files(pages: DataFrame) -> DataFrame:
    """Distinct addresses of links to XML files of pronouncements or data; the link as written is what is tested."""
    xmlish = F.lower("href").contains("xml") | F.lower("text").contains("xml")
    return links(pages).where(xmlish & (F.lower("href").contains("pronunce") | F.lower("href").contains("dati"))).select("url").distinct()


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Files still to be fetched: those not present yet."""
    return wanted.join(present.select("file"), "file", "left_anti")


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for raw in b.column(0).to_pylist():
            try:
                root = xml.parse(raw)
            except ValueError:
                continue
            for e in root.children:
                subject = e.attrs.get("about")
                for p in e.children if subject else ():
                    rows.append({"subject": subject, "predicate": p.tag, "object": p.attrs.get("resource") or xml.clean(p.text()), "lang": p.attrs.get("lang")})
                if subject and e.tag != "Description":
                    rows.append({"subject": subject, "predicate": "type", "object": e.tag, "lang": None})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.string()) for n in ("subject", "predicate", "object", "lang")]))


def triples(files: DataFrame) -> DataFrame:
    """``(subject, predicate, object, lang)`` of RDF/XML files (``content``); predicates by their local names."""
    return files.select("content").mapInArrow(_triples, "subject string, predicate string, object string, lang string")


def thesaurus(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(concept_id, label, kind)`` in Italian or without a language, and ``(child_id, parent_id)``."""
    kind = F.when(F.col("predicate") == "prefLabel", "pref").otherwise("alt")
    labels = rows.where(F.col("predicate").isin("prefLabel", "altLabel") & (F.col("lang").isNull() | (F.col("lang") == "it"))).select(F.col("subject").alias("concept_id"), F.col("object").alias("label"), kind.alias("kind"))
    broader = rows.where("predicate = 'broader'").select(F.col("subject").alias("child_id"), F.col("object").alias("parent_id")).distinct()
    return labels, broader

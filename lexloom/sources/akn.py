"""Acts in XML to flat rows: header, nodes and edges.

A document is walked in one go, as identifiers and the NEXT chain depend on what came
before; documents are what is spread over tasks.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexloom.functions.classify import MODIFICATIONS
from lexloom.functions.dates import NO_DATE
from lexloom.sources import xml
from lexloom.sources.xml import Element, clean

#: Elements that hold a document, and the type each stands for (fixed values).
DOCUMENTS = ("act", "bill", "doc", "amendment", "judgment", "debate", "DecretoLegge", "Legge", "DecretoLegislativo")
TYPES = {"act": "atto", "bill": "disegno di legge", "doc": "documento", "amendment": "emendamento", "judgment": "sentenza"}
UNKNOWN_MODIFICATION = "urn:unknown:modification"

FRBR = ("urn", "eli", "date_promulgation", "vigenza_start", "vigenza_end", "country", "doc_type", "doc_number", "title", "frbr_work_uri", "frbr_expression_uri", "frbr_manifestation_uri")


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def day(text: str | None) -> str | None:
    """YYYY-MM-DD or YYYYMMDD as an ISO date, else null."""
    for shape in ("%Y-%m-%d", "%Y%m%d"):
        try:
            d = dt.datetime.strptime((text or "").strip(), shape).date()
        except ValueError:
            continue
        if len((text or "").strip()) in (8, 10):
            return f"{d.year:04d}-{d.month:02d}-{d.day:02d}"
    return None


def uri_to_urn(uri: str) -> str:
    """As the column function of that name."""
    uri = re.sub(r"/?!?main.*$", "", uri)
    if uri.startswith("/akn/"):
        bare = re.sub("^/akn/it/act/", "", uri)
        seg = bare.strip("/").split("/")
        return f"urn:nir:{seg[1]}:{seg[0]}:{seg[2]};{seg[3]}" if len(seg) >= 4 else f"urn:akn:{bare}"
    if "dati.senato.it" in uri:
        seg = re.sub(r"^[a-z]+://[^/]*", "", uri).strip("/").split("/")
        return f"urn:senato:{seg[1]}:{seg[2]};{seg[3]}" if len(seg) >= 4 else "urn:senato:" + (":".join(seg[1:]) if len(seg) >= 2 else uri)
    return uri if uri.startswith("urn:") else f"urn:akn:{uri}"


def _value(layer: Element | None, tag: str, attr: str = "value", **where: object) -> str | None:
    for e in layer.children if layer is not None else ():
        if e.tag == tag and all(e.attrs.get(k) in v for k, v in where.items()):
            return e.attrs.get(attr)
    return None


def _days(root: Element) -> tuple[str | None, str | None]:
    found = sorted({d for e in root.walk() if e.tag == "lifecycle" for r in e.walk() if r.tag == "eventRef" and (d := day(r.attrs.get("date")))})
    return (found[0] if found else None, found[-1] if len(found) > 1 else None)


def header(root: Element) -> dict[str, str | None]:
    """The act's header; without a document element that has a ``meta`` it is an error."""
    if xml.namespace(root) == "nir" or root.tag == "NIR":
        return _nir_header(root)
    doc = root.find(*DOCUMENTS) or (root.children[0] if root.children else root)
    meta = doc.find("meta") or root.below("meta")
    if meta is None:
        raise ValueError("no meta")
    ident = meta.find("identification") or meta
    work, expression, manifestation = (ident.find(f"FRBR{x}") for x in ("Work", "Expression", "Manifestation"))
    uri = lambda layer: _value(layer, "FRBRthis") or _value(layer, "FRBRuri")
    title = next((t for part in ("preface", "coverPage") if (p := doc.find(part)) is not None for e in p.walk() if e.tag == "docTitle" and (t := clean(e.text()))), None)
    date = day(_value(work, "FRBRdate", "date")) or NO_DATE
    urn = _value(work, "FRBRalias", name=("urn", "urn:nir"))
    if urn is None:
        urn = uri_to_urn(uri(work)) if uri(work) else "urn:unknown"
    if urn in ("", "urn:unknown"):
        urn = "urn:fallback:" + hashed(f"{title}_{date}")
    start, end = _days(meta)
    return {
        "urn": urn, "eli": _value(work, "FRBRalias", name=("eli",)), "date_promulgation": date, "vigenza_start": start, "vigenza_end": end,
        "country": _value(work, "FRBRcountry") or "it", "doc_type": _value(work, "FRBRname") or TYPES.get(doc.tag, doc.tag), "doc_number": _value(work, "FRBRnumber") or "", "title": title,
        "frbr_work_uri": uri(work) or "", "frbr_expression_uri": uri(expression), "frbr_manifestation_uri": uri(manifestation),
    }


def _nir_header(root: Element) -> dict[str, str | None]:
    doc = root.children[0] if root.children else root
    found = root.below("urn")
    urn = (found.attrs.get("valore") or clean(found.text())) if found is not None else ""
    dated, titled, numbered = (root.below(t) for t in ("dataDoc", "titoloDoc", "numDoc"))
    date = day(dated.attrs.get("norm") if dated is not None else None) or NO_DATE
    title = clean(titled.text()) if titled is not None else None
    if urn in ("", "urn:"):
        work = root.below("FRBRWork")
        this = _value(work, "FRBRthis")
        urn = uri_to_urn(this) if this else "urn:fallback:" + hashed(f"{title or None}_{date}")
    kind = root.below("tipoDoc")
    return {
        "urn": urn, "eli": None, "date_promulgation": date, "vigenza_start": date, "vigenza_end": None, "country": "it", "doc_type": clean(kind.text()) if kind is not None else doc.tag,
        "doc_number": clean(numbered.text()) if numbered is not None else "", "title": title or None, "frbr_work_uri": urn, "frbr_expression_uri": None, "frbr_manifestation_uri": None,
    }


class Walk:
    """One pass over a body; collects node and edge rows."""

    def __init__(self, urn: str):
        self.urn, self.nodes, self.edges = urn, [], []
        self.used: Counter[str] = Counter()

    def fresh(self) -> None:
        """A part with its own counters of generated names and its own NEXT chain."""
        self.made = 0
        self.latest: dict[int, str] = {}

    def eid(self, e: Element, parent: str | None) -> str:
        """Given names, with their tag before mere numbers; else generated ones; below the parent's; unique in the document."""
        name = e.attrs.get("eId") or e.attrs.get("id") or ""
        if not name:
            self.made += 1
            name = f"gen_{e.tag}_{self.made}"
        elif name.isdigit() or len(name) <= 2:
            name = e.tag + name
        if parent and parent != "body" and not name.startswith(parent + "__"):
            name = f"{parent}__{name}"
        self.used[name] += 1
        return name if self.used[name] == 1 else f"{name}-n{self.used[name]}"

    def node(self, kind: str, e: Element, eid: str, level: int, parent: str | None, **more: object) -> str:
        ident = hashed(f"{self.urn}#{eid}")
        self.nodes.append({"id": ident, "work_urn": self.urn, "type": kind, "eid": eid, "level": level, "tag_name": e.tag} | more)
        if parent is not None:
            self.edge(ident, parent, "PART_OF")
            if (before := self.latest.get(level)) is not None:
                self.edge(before, ident, "NEXT")
            self.latest[level] = ident
        return ident

    def edge(self, source: str, target: str, kind: str, **properties: object) -> None:
        self.edges.append({"source_id": source, "target_id": target, "type": kind, "properties": properties or None})

    def body(self, body: Element) -> str:
        self.fresh()
        self.used["body"] += 1
        root = self.node("STRUCTURAL", body, "body", 0, None, heading=body.attrs.get("title"))
        self.below(body, root, "body", 1, ())
        return root

    def attachments(self, e: Element, root: str) -> None:
        self.fresh()
        eid = "attachments" if not self.used["attachments"] else f"attachments-n{self.used['attachments'] + 1}"
        self.used["attachments"] += 1
        ident = self.node("STRUCTURAL", e, eid, 1, root, heading="Allegati")
        self.below(e, ident, eid, 2, ("Allegato",))

    def below(self, e: Element, parent: str, parent_eid: str, level: int, context: tuple[str, ...]) -> None:
        for c in e.children:
            if c.tag in SKIP:
                continue
            if c.tag in xml.TABLE:
                self.table(c, parent, parent_eid, level, context)
            elif c.tag in xml.STRUCTURAL or c.tag in xml.ATOMIC and any(x.tag in xml.STRUCTURAL or x.tag in xml.ATOMIC for x in c.children):
                self.structural(c, parent, parent_eid, level, context)
            elif c.tag in xml.ATOMIC:
                self.atomic(c, parent, parent_eid, level, context)
            else:
                self.below(c, parent, parent_eid, level, context)

    def structural(self, e: Element, parent: str, parent_eid: str, level: int, context: tuple[str, ...]) -> None:
        num = clean(n.text()) if (n := e.find("num")) is not None else None
        head = e.find("heading", "rubrica")
        heading = (clean(head.text()) if head is not None else None) or e.attrs.get("name") or e.attrs.get("title")
        label = " - ".join(x for x in (num, heading) if x) or e.tag.capitalize()
        eid = self.eid(e, parent_eid)
        ident = self.node("STRUCTURAL", e, eid, level, parent, num=num, heading=heading)
        self.below(e, ident, eid, level + 1, (*context, label))

    def atomic(self, e: Element, parent: str, parent_eid: str, level: int, context: tuple[str, ...]) -> None:
        num = clean(n.text()) if (n := e.find("num")) is not None else None
        raw = clean(e.text())
        if not raw:
            return
        path = " > ".join([*context, *([n] if (n := (num or "").strip().rstrip(".")) else [])])
        ident = self.node("EXPRESSION", e, self.eid(e, parent_eid), level, parent, num=num, text_content=raw, text_vector=f"{path}: {raw}" if path else raw, text_display=display(e))
        self.inline(e, ident)

    def table(self, e: Element, parent: str, parent_eid: str, level: int, context: tuple[str, ...]) -> None:
        rows = [[clean(c.text()) for c in r.children if c.tag in xml.CELLS] for r in e.walk() if r.tag in xml.ROWS]
        rows = [r for r in rows if r]
        headed = any(c.tag == "th" for r in e.walk() if r.tag in xml.ROWS for c in r.children)
        text = markdown(rows) if rows else clean(e.text())
        path = " > ".join([*context, "Tabella"])
        ident = self.node("EXPRESSION", e, self.eid(e, parent_eid), level, parent, text_content=text, text_vector=f"{path}: {linear(rows, headed) if rows else text}", text_display=text, is_table=True)
        self.inline(e, ident)

    def inline(self, e: Element, source: str) -> None:
        """Citations and modifications in a chunk."""
        modifies = False
        for x in e.walk():
            if x.tag in ("ref", "rif"):
                if href := x.attrs.get("href"):
                    self.edge(source, self.target(href), "CITES", href=href, text=clean(x.text()), relation="EXPLICIT")
            elif x.tag == "rref":
                start, end = x.attrs.get("from"), x.attrs.get("upTo") or x.attrs.get("to")
                if start or end:
                    more = {"range": True, "range_from": start, "range_to": end} if start else {}
                    self.edge(source, self.target(start or end), "CITES", href=start or end, text=clean(x.text()), relation="EXPLICIT", **more)
            elif x.tag == "mod":
                modifies = True
                text = clean(x.text())
                kind = next((k for k, p in MODIFICATIONS if re.search(p, text, re.IGNORECASE)), "AMENDMENT")
                quoted = x.below("quotedText", "quotedStructure", "virgolette", "strutturaCitata")
                hrefs = [h for r in x.walk() if r.tag in ("ref", "rif") and (h := r.attrs.get("href"))]
                for href in hrefs or [None]:
                    self.edge(source, self.target(href) if href else UNKNOWN_MODIFICATION, "MODIFIES", href=href, text=text, quoted_text=clean(quoted.text()) if quoted is not None else None, modification_type=kind)
        if modifies:
            self.nodes[-1]["is_modifier"] = True

    def target(self, href: str) -> str:
        if href.startswith("#"):
            return hashed(f"{self.urn}#{href[1:]}")
        return href if href.startswith(("/akn/", "urn:", "http")) else f"{self.urn}#{href}"


SKIP = xml.SKIPPED | xml.FORMATTING | xml.INLINE


def display(e: Element) -> str:
    """Text with light marks: italics, bold, links; numbers left out."""

    def shown(x: Element) -> str:
        inner = "".join(p if isinstance(p, str) else shown(p) for p in x.parts if isinstance(p, str) or p.tag != "num")
        if x.tag == "i":
            return f"*{inner}*"
        if x.tag == "b":
            return f"**{inner}**"
        if x.tag in ("ref", "rif") and x.attrs.get("href"):
            return f"[{inner}]({x.attrs['href']})"
        return "\n" if x.tag in ("br", "eol") else inner

    return clean(shown(e))


def markdown(rows: list[list[str]]) -> str:
    width = len(rows[0])
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *(line([*r, *[""] * width][:width]) for r in rows[1:])])


def linear(rows: list[list[str]], header: bool) -> str:
    body = rows[1:] if header else rows
    return ". ".join(f"Riga {i}: " + ", ".join(f"{h}={v}" for h, v in zip(rows[0], r, strict=False)) if header else f"Riga {i}: " + ", ".join(r) for i, r in enumerate(body, 1))


def document(raw: bytes | str | None, recover: bool = True) -> tuple[dict, list[dict], list[dict]]:
    """Header, nodes and edges of one document; a document without a body has no nodes."""
    root = xml.parse(raw, recover)
    head = header(root)
    walk = Walk(head["urn"])
    body = next((b for tag in ("body", "articolato") if (b := (root if root.tag == tag else root.below(tag))) is not None), None)
    if body is not None:
        top = walk.body(body)
        for e in root.walk():
            if e.tag in ("attachments", "annessi"):
                walk.attachments(e, top)
    return head, walk.nodes, walk.edges


_NODE = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("work_urn", T.StringType()), ("type", T.StringType()), ("eid", T.StringType()), ("num", T.StringType()), ("heading", T.StringType()), ("text_content", T.StringType()), ("text_vector", T.StringType()), ("text_display", T.StringType()), ("level", T.IntegerType()), ("tag_name", T.StringType()), ("is_modifier", T.BooleanType()), ("is_table", T.BooleanType()))])
_PROPERTIES = T.StructType([T.StructField(n, T.BooleanType() if n == "range" else T.StringType()) for n in ("href", "text", "relation", "range", "range_from", "range_to", "quoted_text", "modification_type")])
_EDGE = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("target_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("properties", _PROPERTIES)])
SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("error", T.StringType()), T.StructField("frbr", T.StructType([T.StructField(n, T.StringType()) for n in FRBR])), T.StructField("nodes", T.ArrayType(_NODE)), T.StructField("edges", T.ArrayType(_EDGE))])


def _parse(batches: Iterator[pa.RecordBatch], schema: pa.Schema, recover: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                head, nodes, edges = document(raw, recover)
                rows.append({"path": path, "error": None, "frbr": head, "nodes": nodes, "edges": edges})
            except (ValueError, RecursionError) as e:
                rows.append({"path": path, "error": str(e)[:500] or type(e).__name__, "frbr": None, "nodes": None, "edges": None})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def parsed(files: DataFrame, path: str = "path", content: str = "content", recover: bool = True) -> DataFrame:
    """``(path, error, frbr, nodes, edges)`` of each document; ``error`` says why one has none.

    Null and empty documents are errors, repeated ones are parsed again, other columns are
    ignored. One narrow pass.
    """
    schema = to_arrow_schema(SCHEMA)
    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(partial(_parse, schema=schema, recover=recover), SCHEMA)


def scan(spark: SparkSession, directory: str, limit: int = 0) -> DataFrame:
    """``(path, content)`` of all XML files below a directory; of the first ``limit`` by path, if one is asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(directory).select("path", "content")
    return files.orderBy("path").limit(limit) if limit else files


def acts(docs: DataFrame) -> DataFrame:
    """Table of headers."""
    days = ("date_promulgation", "vigenza_start", "vigenza_end")
    return docs.where("error is null").select(*(F.to_date(f"frbr.{c}").alias(c) if c in days else F.col(f"frbr.{c}").alias(c) for c in FRBR))


def nodes(docs: DataFrame) -> DataFrame:
    """Table of nodes."""
    return docs.where("error is null").select(F.inline("nodes"))


def edges(docs: DataFrame) -> DataFrame:
    """Table of edges; a link found twice in a chunk is one."""
    return docs.where("error is null").select(F.inline("edges")).dropDuplicates()


def errors(docs: DataFrame) -> DataFrame:
    """Documents that could not be parsed."""
    return docs.where("error is not null").select("path", "error")

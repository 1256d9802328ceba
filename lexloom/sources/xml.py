"""XML of acts, judgements and thesauri, read leniently and turned into rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.parsers import expat

#: Tags by class (fixed values).
STRUCTURAL = frozenset({"book", "title", "part", "chapter", "section", "article", "subchapter", "subsection", "libro", "titolo", "capo", "sezione", "articolo", "attachment", "annex", "doc"})
ATOMIC = frozenset({"paragraph", "subparagraph", "content", "list", "point", "indent", "alinea", "item", "comma", "el", "lettera"})
SKIPPED = frozenset({"meta", "identification", "lifecycle", "workflow", "references", "analysis", "temporalData", "presentation", "components", "num", "heading"})
FORMATTING = frozenset({"i", "b", "u", "sub", "sup", "span", "br", "eol", "p", "docTitle", "docType", "docNumber", "docDate", "docProponent"})
INLINE = frozenset({"ref", "rref", "mref", "mod", "quotedStructure", "quotedText", "noteRef", "authorialNote"})
TABLE, ROWS, CELLS = frozenset(["table"]), frozenset(["tr", "row"]), frozenset(["th", "td", "cell"])
#: Namespaces of the formats known (fixed values).
NAMESPACES = {
    "http://docs.oasis-open.org/legaldocml/ns/akn/3.0": "akn",
    "http://docs.oasis-open.org/legaldocml/ns/akn/3.0/CSD03": "akn-csd03",
    "http://www.normeinrete.it/nir/2.2/": "nir",
}


@dataclass(slots=True)
class Element:
    """An element by its local name; ``parts`` holds texts and elements in their order."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parts: list = field(default_factory=list)
    space: str = ""

    @property
    def children(self) -> list[Element]:
        return [p for p in self.parts if isinstance(p, Element)]

    def walk(self):
        """The element and all below it, in the order of the document."""
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(reversed(e.children))

    def find(self, *tags: str) -> Element | None:
        return next((c for c in self.children if c.tag in tags), None)

    def below(self, *tags: str) -> Element | None:
        return next((e for e in self.walk() if e is not self and e.tag in tags), None)

    def text(self) -> str:
        """All text below, in one."""
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                stack.extend(reversed(e.parts))
        return "".join(out)


def local_name(name: str) -> str:
    return re.split(r"[:}\s]", name)[-1]


class _Builder:
    def __init__(self) -> None:
        self.root: Element | None = None
        self.open: list[Element] = []

    def start(self, name: str, attrs: dict[str, str]) -> None:
        space, _, tag = name.rpartition("}") if "}" in name else ("", "", name)
        e = Element(local_name(tag), {local_name(k): v or "" for k, v in attrs.items()}, [], space)
        if self.open:
            self.open[-1].parts.append(e)
        elif self.root is None:
            self.root = e
        else:
            self.root.parts.append(e)
        self.open.append(e)

    def end(self, tag: str) -> None:
        names = [e.tag for e in self.open]
        if tag in names:
            while self.open.pop().tag != tag:
                pass

    def data(self, text: str) -> None:
        if self.open and text:
            last = self.open[-1].parts
            if last and isinstance(last[-1], str):
                last[-1] += text
            else:
                last.append(text)


class _Lenient(HTMLParser):
    """For what isn't well-formed: unclosed and stray tags, bare signs."""

    def __init__(self, builder: _Builder, cases: dict[str, str]):
        super().__init__(convert_charrefs=True)
        self.b, self.cases = builder, cases

    def _name(self, tag: str) -> str:
        return self.cases.get(tag, tag)

    def handle_starttag(self, tag, attrs):
        self.b.start(self._name(tag), {self.cases.get(k, k): v or "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.b.open.pop()

    def handle_endtag(self, tag):
        self.b.end(local_name(self._name(tag)))

    def handle_data(self, data):
        self.b.data(data)


def parse(raw: bytes | str | None, recover: bool = True) -> Element:
    """The root element. A leading mark is dropped; bytes that aren't UTF-8 are Latin-1.

    What isn't well-formed is read leniently if ``recover``, else it is an error; a text
    without any element is an error too.
    """
    if raw is None:
        raise ValueError("no document")
    if isinstance(raw, bytes):
        raw = raw.removeprefix(b"\xef\xbb\xbf")
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = raw.decode("latin-1")
    else:
        text = raw.removeprefix("﻿")
    text = re.sub(r"^\s*<\?xml[^>]*\?>", "", text)
    builder = _Builder()
    p = expat.ParserCreate(namespace_separator="}")
    p.buffer_text = True
    p.StartElementHandler, p.CharacterDataHandler = builder.start, builder.data
    p.EndElementHandler = lambda name: builder.end(local_name(name))
    try:
        p.Parse(text.encode("utf-8", "replace"), True)
    except expat.ExpatError as e:
        if not recover:
            raise ValueError(f"not well-formed: {e}") from None
        builder = _Builder()
        cases = {m.lower(): m for m in re.findall(r"[A-Za-z_][\w:.-]*", text)}
        lenient = _Lenient(builder, cases)
        lenient.feed(text)
        lenient.close()
    if builder.root is None:
        raise ValueError("no element")
    return builder.root


def namespace(root: Element) -> str:
    """The format by the namespace of the root, else of its children, else the standard one."""
    for e in (root, *root.children):
        if e.space in NAMESPACES:
            return NAMESPACES[e.space]
    return "akn"


def clean(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()

"""Text decoded with a wrong encoding: found, and restored where the original is known.

Every distinct clean word of the corpus that has characters beyond ASCII is garbled under
all chains of encodings; the words of the texts are joined by hash with that table. Which
of two words is the garbled one is settled first by their bytes (several characters that
decode back to one of Latin script), then by their looks (capitals or foreign letters
within words), and only between two that look proper by their counts in the same
surroundings. What bytes or looks give away is never an original. All encodings here
leave ASCII alone, so a word is garbled in its other characters only, and surroundings
stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.tables import Shelf

#: Encodings as which bytes are misread (fixed values).
READ_AS = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "iso8859-5", "koi8-r", "cp1253", "iso8859-7", "cp1254", "cp850", "cp437", "cp852", "cp866", "mac_roman")
#: Encodings besides UTF-8 in which texts were written; those but the first were misread as the first.
WRITTEN = ("cp1252", "mac_roman", "cp850", "cp437", "cp1250")
#: Encodings as which texts misread once were misread again.
AGAIN = ("cp1252", "latin-1", "mac_roman", "cp850")

#: Those of ``READ_AS`` that show the bytes of other letters as Latin letters and signs.
LATIN = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1254", "cp850", "cp437", "cp852", "mac_roman")
#: Letters beyond ASCII of the languages at hand, small ones (fixed values).
LETTERS = frozenset("àáâäèéêëìíîïòóôöùúûüñçßœæÿ")
#: Those that are words by themselves (fixed values).
ALONE = frozenset("àèéòóÀÈÉÒÓ")
#: Signs that may stand beside letters (fixed values), and those that may close a word in capitals.
PLAIN = frozenset("°©®™€£§ªº’‘“”«»‹›–—‐‑…·•²³¹\xa0")
CLOSING = frozenset("”“’‘»›–—…\xa0")
LOST = "\ufffd"

_RUN = re.compile(r"[^\x00-\x7f]+")
_WINDOW = re.compile(r"[A-Za-z0-9]*(?:[^\x00-\x7f]+[A-Za-z0-9]*)+")
_ASCII = re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """How many times more frequent than its garbled form an original must be, where bytes don't settle it: as a word, as
    a sign beside letters, as a sign between given words (``between``; ``seen``: its least count there); ``letter``: if
    the form looks more proper than the original, by rows and by distinct texts; ``odd``: if it looks improper where it stands."""

    word: float = 4.0
    sign: float = 5.0
    letter: float = 20.0
    between: float = 5.0
    odd: float = 0.05
    seen: int = 3


def _read_as(c: str, of: str, taken_for: str, spare: str) -> str | None:
    """Bytes of one character in ``of`` read as ``taken_for``; what that leaves undefined becomes a control character, U+FFFD or nothing."""
    try:
        raw = c.encode(of)
    except UnicodeError:
        if of != "cp1252" or not 0x80 <= ord(c) < 0xA0:
            return None
        raw = bytes([ord(c)])
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(taken_for))
        except UnicodeError:
            out.append(chr(b) if spare == "control" else spare)
    return "".join(out)


class _Chain(dict):
    """Each character beyond ASCII as a chain of misreadings (``of, taken_for, spare``) leaves it; NUL where it can't be."""

    def __init__(self, *steps: tuple[str, str, str]):
        self.steps = steps

    def __missing__(self, c: int) -> str:
        out = chr(c)
        for step in self.steps:
            parts = [x if x < "\x80" else _read_as(x, *step) for x in out]
            out = "\0" if None in parts else "".join(parts)
        self[c] = out
        return out


@lru_cache(maxsize=1)
def _chains() -> list[tuple[_Chain, bool]]:
    """All chains; true: multi-byte or lossy."""
    out: list[tuple[_Chain, bool]] = []
    for a in READ_AS:
        for spare in ("control", LOST, ""):
            out.append((_Chain(("utf-8", a, spare)), bool(spare)))
        for b in AGAIN:
            out.append((_Chain(("utf-8", a, "control"), ("utf-8", b, "control")), True))
            if a == b:
                out.append((_Chain(*[("utf-8", a, "control")] * 3), True))
        out.append((_Chain(("cp1252", a, "control")), False))
    for a in WRITTEN:
        if a != "cp1252":
            out.append((_Chain((a, "cp1252", "control")), False))
        # each byte lost for itself
        out.append((_Chain((a, "ascii", LOST)), True))
    return out


def garbled(text: str) -> dict[str, bool]:
    """All garbled forms of ``text``; true: multi-byte or lossy, so that no proper text looks so.

    Bytes of one character each that happen to be UTF-8 aren't taken as such unless some
    are lost: whoever sees several characters in place of one sees the garbled form.
    """
    forms: dict[str, bool] = {}

    def note(form: str, strong: bool) -> None:
        if form and form != text and "\0" not in form:
            forms[form] = forms.get(form, False) or strong
            if "\xa0" in form:  # blanks made plain afterwards
                plain = form.replace("\xa0", " ").strip(" ")
                if plain != text and not plain.isascii():
                    forms.setdefault(plain, False)

    for chain, strong in _chains():
        note(text.translate(chain), strong)
    for a in WRITTEN:
        try:
            lossy = text.encode(a).decode("utf-8", "replace")
        except UnicodeError:
            continue
        if LOST in lossy:
            note(lossy, True)
    return forms


@lru_cache(maxsize=1)
def _multibyte() -> tuple[dict[str, str], dict[str, str]]:
    """Forms of several characters of Latin letters and common signs: as Latin encodings show them, and as others do."""
    of = [chr(c) for c in (*range(0xA0, 0x180), *range(0x2010, 0x2027), 0x2030, 0x2039, 0x203A, 0x20AC, 0x2122)]
    shown = lambda names: {f: c for a in names for c in of if (f := _read_as(c, "utf-8", a, "control"))}
    return shown(LATIN), shown(a for a in READ_AS if a not in LATIN)


@lru_cache(maxsize=1 << 16)
def settled(left: str, run: str, right: str, sure: bool = True) -> bool:
    """Whether the bytes alone say that a stretch is garbled: a part of it is the several characters of one, or is lost.

    Not so if the part may be proper: Latin letters only, unless a small letter stands
    before; a capital and what may close a word in capitals, unless small letters stand beside.
    In foreign letters only right beside Latin ones. ``sure``: ``left`` is what stands before.
    """
    if LOST in run:
        return True
    latin, other = _multibyte()
    text = left + run
    for i in range(len(left), len(text) - 1):
        for n in (2, 3):
            part = text[i : i + n]
            if len(part) == n and (part in latin or part in other and (left in ("a", "A") or right in ("a", "A"))):
                before = text[i - 1 : i] if i else " "
                letters = all(map(_latin, part))
                if letters and (not sure or not before.islower()):
                    continue
                if part[1] in CLOSING and part[0].isupper() and not (sure and (before.islower() or (text + right)[i + n : i + n + 1].islower())):
                    continue
                return True
    return False


@lru_cache(maxsize=1 << 16)
def odd(left: str, run: str, right: str) -> bool:
    """Whether a stretch looks improper where it stands: a capital behind a small letter, a foreign letter beside a
    Latin one, a rare sign within or beside a word, a control character."""
    text = (left or " ") + run + (right or " ")
    for i in range(1, len(text) - 1):
        c = text[i]
        if c < "\x80" or c in PLAIN:
            continue
        a, b = text[i - 1], text[i + 1]
        kind = unicodedata.category(c)
        beside = _latin(a) or _latin(b)
        if kind in ("Cc", "Co", "Cn"):
            return True
        if kind[0] == "L":
            if not _latin(c) and c != "µ" and beside or kind == "Lu" and a.islower():
                return True
        elif kind[0] == "S" and beside or kind[0] == "P" and _latin(a):
            return True
    return False


def _native(run: str) -> bool:
    """Whether what is beyond ASCII in a stretch are letters of the languages at hand."""
    return all(c < "\x80" or c.lower() in LETTERS for c in run)


def _foreign(run: str) -> bool:
    """Whether some letter beyond ASCII is none of the languages at hand."""
    return any(c > "\x7f" and c.isalpha() and c.lower() not in LETTERS for c in run)


def _kind(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return " "
    c = text[at]
    return "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "9" if c.isdigit() else " " if c.isspace() else "."


def occurrences(text: str) -> Iterator[tuple[str, str, str, str, int, int]]:
    """``(kind, left, run, right, start, length)`` of each stretch beyond ASCII, in the forms in which it is looked up.

    w: the word it stands in; c: the stretch between the kinds of the characters beside
    it, if one is a letter; p, n: the stretch behind or before a word, if none is; r: the
    stretch alone.
    """
    for m in _WINDOW.finditer(text):
        if re.search("[A-Za-z]", m[0]):
            yield "w", "", m[0], "", m.start(), len(m[0])
    words: list[re.Match] | None = None
    at = 0
    for m in _RUN.finditer(text):
        a, b = m.start(), m.end()
        left, right = _kind(text, a - 1), _kind(text, b)
        if left in "aA" or right in "aA":
            yield "c", left, m[0], right, a, b - a
        else:
            if words is None:
                words = list(_ASCII.finditer(text))
            while at < len(words) and words[at].start() < b:
                at += 1
            if at:
                yield "p", words[at - 1][0].lower(), m[0], "", a, b - a
            if at < len(words):
                yield "n", "", m[0], words[at][0].lower(), a, b - a
        yield "r", "", m[0], "", a, b - a


@lru_cache(maxsize=1 << 12)
def _latin(c: str) -> bool:
    return unicodedata.name(c, "").startswith("LATIN ")


@lru_cache(maxsize=1 << 16)
def _suspect(kind: str, left: str, run: str, right: str) -> bool:
    """Whether bytes give a key away as garbled; of a key without surroundings only what no surroundings excuse."""
    if kind == "w":
        return any(settled(_kind(run, m.start() - 1), m[0], _kind(run, m.end())) for m in _RUN.finditer(run))
    if kind == "c":
        return settled(left, run, right)
    return settled(" ", run, " ", kind != "r")


def _least(kind: str, left: str, form: str, right: str, original: str, strong: bool, rule: Rule) -> tuple[float, bool] | None:
    """How many times more frequent the original must be, and whether by rows and distinct texts; none if it is no original."""
    if kind == "c":
        beside = left, right
    else:
        beside = " ", " "
    if kind != "r" and odd(beside[0], original, beside[1]):
        return None
    if strong and _suspect(kind, left, form, right):
        return 0.0, False
    base = {"w": rule.word, "c": rule.sign, "r": 1.0}.get(kind, rule.between)
    if kind in "wc":
        if odd(beside[0], form, beside[1]):
            return min(base, rule.odd), False
        letters = all(c < "\x80" or _latin(c) for c in form) and not all(c < "\x80" or _latin(c) for c in original)
        if letters or _native(form) and not _native(original) or _foreign(original) and not _foreign(form):
            return max(base, rule.letter), True
    elif kind in "pn" and original not in ALONE and (form in ALONE or original.isalpha()):
        return max(base, rule.letter), True
    return base, False


_KEY = ("kind", "left", "run", "right")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(8)]
        for table, row, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for x in occurrences(text):
                for c, v in zip(cols, (table, row, *x), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["table_name", "row_id", *_KEY, "start", "size"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each key of a distinct text how often all its copies have it."""
    for b in batches:
        cols: list[list] = [[] for _ in range(5)]
        for text, copies in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for x, n in Counter(x[:4] for x in occurrences(text)).items():
                for c, v in zip(cols, (*x, n * copies), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(),) * 4 + (pa.int64(),), strict=True)], [*_KEY, "n"])


def _forms(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Garbled forms of every clean key; keys that their bytes give away, with no original."""
    for b in batches:
        cols: list[list] = [[] for _ in range(9)]

        def note(*row: object) -> None:
            for c, v in zip(cols, row, strict=True):  # noqa: B023 used within the batch
                c.append(v)

        for kind, left, run, right, n, d in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if _suspect(kind, left, run, right):
                if kind != "w":
                    note(kind, left, run, right, None, 0, 0, 0.0, False)
                continue
            for form, strong in garbled(run).items():
                if (kind != "r" or strong) and (least := _least(kind, left, form, right, run, strong, rule)):
                    note(kind, left, form, right, run, n, d, *least)
        types = (pa.string(),) * 5 + (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*_KEY, "original", "n_original", "d_original", "least", "both"])


def find(texts: DataFrame, rule: Rule | None = None) -> DataFrame:
    """``(table_name, row_id, start, size, original)``: garbled stretches of texts.

    ``texts`` has ``table_name``, BIGINT ``row_id`` and ``text``; other columns are
    ignored. ``original`` is null where several fit equally, nothing can tell, or no clean
    text has it. Null and plain ASCII texts have none: letters that became '?' are not
    looked for, as nothing tells such a sign from a proper one.

    Counts are over all texts, once with copies and once without: an original is proven by
    either, so neither many copies of a damaged text nor few distinct proper ones hide what
    is damaged. What bytes settle needs no counts at all, so damage may be in the majority
    or everywhere. Where two single signs could each be the other's garbled form and both
    look proper, the one that looks native stays unless it is outnumbered by ``rule.letter``.

    The table of garbled forms grows with the distinct words, not with the texts; it is
    joined by key, and what it settles is written first, so that Spark broadcasts it to
    the texts only if it is small.
    """
    rule = rule or Rule()
    shelf = Shelf(texts.sparkSession, "mojibake")
    odd_ones = texts.where("row_id is not null and text is not null").where(F.col("text").rlike(r"[^\x00-\x7F]")).select("table_name", F.col("row_id").cast("bigint").alias("row_id"), "text")
    seen = odd_ones.mapInArrow(_tokens, "table_name string, row_id bigint, kind string, `left` string, run string, `right` string, start int, size int")
    own = odd_ones.groupBy("text").agg(F.count("*").alias("copies")).mapInArrow(_counted, "kind string, `left` string, run string, `right` string, n bigint")
    counts, _ = shelf.put(own.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.count("*").alias("d")))
    table = counts.repartition(*_KEY).mapInArrow(partial(_forms, rule=rule), "kind string, `left` string, run string, `right` string, original string, n_original bigint, d_original bigint, least double, both boolean")
    by_n, by_d = (F.col(f"{x}_original") >= F.col("least") * F.col(x) for x in "nd")
    often = F.col("original").isNull() | ~F.col("kind").isin("p", "n") | (F.col("least") == 0) | (F.col("n_original") >= rule.seen)
    hits = counts.join(table, list(_KEY)).where(F.when(F.col("both"), by_n & by_d).otherwise(by_n | by_d) & often)
    best = F.max_by("original", F.when(F.col("original").isNotNull(), F.struct("n_original", "original")))
    bad, _ = shelf.put(hits.groupBy(*_KEY).agg(best.alias("top"), F.max("n_original").alias("most"), F.sum("n_original").alias("all")).select(*_KEY, F.when(F.col("most") >= 0.8 * F.col("all"), F.col("top")).alias("original")))
    return seen.join(bad, list(_KEY)).select("table_name", "row_id", "start", "size", "kind", "original")


def restore(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``(table_name, row_id, restored, whole)`` of each affected text.

    The originals are put in place, words before stretches; ``whole`` is false if some
    stretch has no known original or is left as it was.
    """
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in zip("wcpnr", range(5), strict=True) for x in kv)), F.col("kind"))
    hits = found.groupBy("table_name", "row_id").agg(F.array_sort(F.collect_set(F.struct(rank.alias("rank"), "start", "size", "original"))).alias("hits"))
    joined = texts.select("table_name", F.col("row_id").cast("bigint").alias("row_id"), "text").join(hits, ["table_name", "row_id"])
    return joined.mapInArrow(_restore, "table_name string, row_id bigint, restored string, whole boolean")


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, whole = [], []
        for text, hits in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            taken: list[tuple[int, int, str]] = []
            for h in hits:
                a, e = h["start"], h["start"] + h["size"]
                if h["original"] is not None and all(e <= x or a >= y for x, y, _ in taken):
                    taken.append((a, e, h["original"]))
            whole.append(all(any(x <= h["start"] and h["start"] + h["size"] <= y for x, y, _ in taken) for h in hits))
            for a, e, new in sorted(taken, reverse=True):
                text = text[:a] + new + text[e:]
            out.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(whole)], ["table_name", "row_id", "restored", "whole"])

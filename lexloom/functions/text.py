"""Text columns: normalising, tokens, context, payloads, tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, spelled out so that every regex dialect reads it alike.
SPACE = r"[\s\x0B\x{85}\p{Z}]"
#: Characters that a query parser takes as operators (fixed values).
OPERATORS = r'([+\-&|!(){}\[\]^"~*?:\\/])'


def strip(x: Column) -> Column:
    """``x`` without white space of any kind at its ends; null gives null."""
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_text(x: Column) -> Column:
    """Lower case, signs deleted (not replaced: ``dell'acqua`` is ``dellacqua``), white space single and trimmed."""
    bare = F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s\x0B\x{85}\p{Z}]", "")
    return strip(F.regexp_replace(bare, rf"{SPACE}+", " "))


def tokens(x: Column) -> Column:
    """Array of lower-case tokens of letters and digits; [] for null and for texts without any."""
    return F.coalesce(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def lucene_escape(x: Column) -> Column:
    """A backslash before every operator sign of the query syntax; words stay as they are."""
    return F.regexp_replace(x, OPERATORS, r"\\$1")


def structural_label(num: Column, heading: Column, tag: Column) -> Column:
    """``num - heading``, whichever of them is there, else the tag with a capital letter."""
    n, h = F.nullif(strip(num), F.lit("")), F.nullif(strip(heading), F.lit(""))
    return F.coalesce(F.concat(n, F.lit(" - "), h), n, h, F.concat(F.upper(F.substring(tag, 1, 1)), F.lower(F.substring(tag, 2, 1 << 20))))


def inject_context(context: Column, num: Column, raw: Column) -> Column:
    """``c1 > c2 > num: raw`` of an array of context labels; trailing dots of the number go; no context gives raw."""
    n = F.nullif(F.regexp_replace(strip(num), r"\.+$", ""), F.lit(""))
    path = F.array_join(F.array_compact(F.concat(F.coalesce(context, F.array().cast("array<string>")), F.array(n))), " > ")
    return F.when(path == "", raw).otherwise(F.concat(path, F.lit(": "), raw))


def embedding_payload(title: Column, text_vector: Column, text_display: Column, most: int = 3500) -> Column:
    """What is embedded: title and text, cut to ``most`` characters; a missing title is written None."""
    text = F.coalesce(F.nullif(text_vector, F.lit("")), text_display, F.lit(""))
    return F.left(F.concat(F.lit("Contesto: "), F.coalesce(title, F.lit("None")), F.lit("\n\nTesto: "), text), F.lit(most))


def table_markdown(rows: Column) -> Column:
    """Markdown of ``array<array<string>>``; the first row is the header, other rows are filled up or cut to its width; '' for no rows."""
    head = F.get(rows, F.lit(0))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    fit = lambda r: F.transform(F.sequence(F.lit(0), F.size(head) - 1), lambda i: F.coalesce(F.get(r, i), F.lit("")))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(fit(r)))
    rule = line(F.transform(head, lambda _: F.lit("---")))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(head), rule), body), "\n")).otherwise("")


def table_linear(rows: Column, header: Column) -> Column:
    """``Riga i: h=v, ...`` for each row behind the header, or ``Riga i: v, ...`` where ``header`` is false; joined by '. '."""
    head = F.get(rows, F.lit(0))
    body = F.when(header, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    cells = lambda r: F.when(header, F.array_join(F.array_compact(F.zip_with(head, r, lambda h, v: F.concat(h, F.lit("="), v))), ", ")).otherwise(F.array_join(r, ", "))
    return F.array_join(F.transform(body, lambda r, i: F.concat(F.lit("Riga "), (i + 1).cast("string"), F.lit(": "), cells(r))), ". ")

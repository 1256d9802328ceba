"""Splitting oversized texts at natural boundaries with a bounded-quantifier regular expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries from strong to weak: what stands before the cut, the most characters it
#: takes, and the divisor of the limit below which a piece must not end there (0: none).
BOUNDARIES = (
    (r"\n[ \t]{0,20}\n", 22, 3),
    (r"\n", 1, 3),
    (r"[.!?;][\"»”)]?\s", 3, 3),
    (r"[:,–—][\"»”)]?\s", 3, 2),
    (r"\s", 1, 0),
)
#: In tables the end of a row comes before anything else.
TABLE = ((r"\n", 1, 0), (r"\.\s(?=Riga )", 2, 0), (r"[.;|]\s", 2, 3), (r"\s", 1, 0))


def pattern(most: int, boundaries: tuple[tuple[str, int, int], ...] = BOUNDARIES) -> str:
    """Alternatives in the order of their strength; each takes up to ``most`` characters.

    First what is left if it fits, then the longest stretch up to each kind of
    boundary, then up to ``most`` characters that don't part a letter from its marks,
    then any ``most`` characters.
    """
    cuts = [f".{{{max(1, most // share - width if share else 1)},{most - width}}}{text}" for text, width, share in boundaries if most > 2 * width]
    return "(?s)" + "|".join([f".{{1,{most}}}\\z", *cuts, rf".{{1,{most}}}(?![\p{{M}}\u200D\uFE0F])", f".{{1,{most}}}"])


#: Stretches whose lengths are summed up in one go.
GROUP = 128
#: So many stretches one after the other hold one of a third of the limit at least: one more than there are boundaries without a least size.
SHORT = 4


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is reckoned once."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _starts(parts: Column) -> Column:
    """Where each of the stretches begins: sums within groups, on top of the sums of the groups before."""
    size = F.size(parts)
    groups = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / GROUP).cast("int"))).otherwise(F.array().cast("array<int>"))
    lengths = lambda g: F.transform(F.slice(parts, g * GROUP + 1, GROUP), lambda p: F.length(p))
    none = F.array().cast("array<int>")

    def sums(of: Column, first: Column) -> Column:
        """Each place's sum of all before it."""
        start = F.struct(first.alias("n"), none.alias("all"))
        return F.aggregate(of, start, lambda acc, n: F.struct((acc["n"] + n).alias("n"), F.concat(acc["all"], F.array(acc["n"])).alias("all")), lambda acc: acc["all"])

    whole = F.transform(groups, lambda g: F.aggregate(lengths(g), F.lit(0), lambda a, n: a + n))
    return _let(sums(whole, F.lit(0)), lambda firsts: F.flatten(F.transform(groups, lambda g: sums(lengths(g), F.get(firsts, g)))))


def pieces(text: Column, limit: int = 3500, overlap: int = 200, table: Column | None = None) -> Column:
    """``array<struct<start, piece>>`` of a text, every piece at most ``limit`` code points.

    A text within the limit is one piece; '' too; null gives null. Longer ones are cut
    into stretches of at most ``limit - overlap``; each piece but the first begins up to
    ``overlap`` characters earlier, at a word's start where there is one in the first
    third of these, so that ``piece`` is ``substring(text, start + 1, ...)`` and the
    pieces cover the whole text. ``table`` says of a row that its text is a table.

    The work is in proportion to the length of a text: what a piece shares is taken from
    the ends of the stretches just before it, never from the whole.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    most = limit - overlap
    before = SHORT * max(1, -(-3 * overlap // most))
    cut = lambda b: F.regexp_extract_all(text, F.lit(pattern(most, b)), F.lit(0))
    parts = cut(BOUNDARIES) if table is None else F.when(table, cut(TABLE)).otherwise(cut(BOUNDARIES))

    def whole(parts: Column) -> Column:
        tails = F.transform(parts, lambda p: F.right(p, F.lit(overlap)))

        def piece(tails: Column, starts: Column, p: Column, i: Column) -> Column:
            back = F.right(F.array_join(F.slice(tails, F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before))), ""), F.lit(overlap))
            shared = F.regexp_replace(back, rf"(?s)\A\S{{0,{overlap // 3}}}\s+(?=\S)", "") if overlap else F.lit("")
            return _let(shared, lambda own: F.struct((F.get(starts, i) - F.length(own)).alias("start"), F.concat(own, p).alias("piece")))

        return _let(tails, lambda t: _let(_starts(parts), lambda s: F.transform(parts, lambda p, i: piece(t, s, p, i))))

    return F.when(F.length(text) > limit, _let(parts, whole)).when(text.isNotNull(), F.array(F.struct(F.lit(0).alias("start"), text.alias("piece"))))


def split_fields(rows: DataFrame, key: str, fields: tuple[str, ...], limit: int = 3500, overlap: int = 200, table: Column | None = None) -> DataFrame:
    """``(key, field_name, piece_no, start, piece)`` of every text in ``fields``.

    Null texts give no piece; repeated rows give theirs again; other columns are
    ignored. One narrow pass of built-in functions, no shuffle.
    """
    listed = rows.select(F.col(key), F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), pieces(F.col(f), limit, overlap, table).alias("pieces")) for f in fields))).alias("f"))
    return listed.select(key, F.col("f.field_name").alias("field_name"), F.posexplode("f.pieces").alias("piece_no", "p")).select(key, "field_name", "piece_no", F.col("p.start").alias("start"), F.col("p.piece").alias("piece"))

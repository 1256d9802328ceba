"""Identifiers of acts and nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(urn: Column, eid: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of ``urn#eid``; null if either is."""
    return F.substring(F.sha2(F.concat(urn, F.lit("#"), eid), 256), 1, 16)


def without_main(uri: Column) -> Column:
    """The URI without its ``main`` ending and all behind it."""
    return F.regexp_replace(uri, r"/?!?main.*$", "")


def act_uri_to_urn(uri: Column) -> Column:
    """``/akn/it/act/TYPE/AUTHORITY/DATE/NUMBER`` as ``urn:nir:AUTHORITY:TYPE:DATE;NUMBER``; null for anything else."""
    m = r"^/akn/it/act/([^/]+)/([^/]+)/([^/]+)/([^/]+?)(?:/?!?main)?/?$"
    part = lambda i: F.regexp_extract(uri, m, i)
    return F.when(uri.rlike(m), F.concat(F.lit("urn:nir:"), part(2), F.lit(":"), part(1), F.lit(":"), part(3), F.lit(";"), part(4)))


def uri_to_urn(uri: Column) -> Column:
    """URN of an act's URI, its ``main`` ending dropped.

    Paths under /akn/ and addresses of the Senate's data site are turned round where
    they have enough parts; what is a URN stays; anything else becomes ``urn:akn:`` and
    the URI. Null gives null, '' gives ``urn:akn:``.
    """
    clean = without_main(uri)
    bare = F.regexp_replace(clean, "^/akn/it/act/", "")
    seg = F.split(F.regexp_replace(bare, "^/+|/+$", ""), "/")
    nir = F.when(F.size(seg) >= 4, F.concat(F.lit("urn:nir:"), F.get(seg, F.lit(1)), F.lit(":"), F.get(seg, F.lit(0)), F.lit(":"), F.get(seg, F.lit(2)), F.lit(";"), F.get(seg, F.lit(3))))
    step = F.split(F.regexp_replace(F.regexp_replace(clean, r"^[a-z]+://[^/]*", ""), "^/+|/+$", ""), "/")
    senate = (
        F.when(F.size(step) >= 4, F.concat(F.lit("urn:senato:"), F.get(step, F.lit(1)), F.lit(":"), F.get(step, F.lit(2)), F.lit(";"), F.get(step, F.lit(3))))
        .when(F.size(step) >= 2, F.concat(F.lit("urn:senato:"), F.array_join(F.slice(step, 2, 1 << 20), ":")))
        .otherwise(F.concat(F.lit("urn:senato:"), clean))
    )
    return (
        F.when(uri.isNull(), None)
        .when(clean.startswith("/akn/"), F.coalesce(nir, F.concat(F.lit("urn:akn:"), bare)))
        .when(clean.contains("dati.senato.it"), senate)
        .when(clean.startswith("urn:"), clean)
        .otherwise(F.concat(F.lit("urn:akn:"), clean))
    )


def resolve_href(urn: Column, href: Column) -> Column:
    """Target of a link in the act ``urn``: a fragment is a node's id; paths, URNs and addresses stay; others hang on the act."""
    return (
        F.when(href.startswith("#"), node_id(urn, F.substring(href, 2, 1 << 20)))
        .when(href.startswith("/akn/") | href.startswith("urn:") | href.startswith("http"), href)
        .otherwise(F.concat(urn, F.lit("#"), href))
    )


def canonical_target(target: Column) -> Column:
    """An act's path as its URN, so that links by path and by URN meet; anything else stays."""
    return F.coalesce(act_uri_to_urn(target), target)


def last_segments(uri: Column, n: int = 2) -> Column:
    """The last ``n`` segments of a path joined by ':'."""
    return F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.filter(F.split(uri, "/"), lambda s: s != "")), 1, n)), 1, n), ":")


def urns_in(text: Column, pattern: str = r"""(?i)urn:nir:[^\s<"']+""") -> Column:
    """Distinct URNs in a text in the order of their first place; [] for null."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")))


def known_urn(urn: Column, text: Column) -> Column:
    """The URN of an act; where it is missing or unknown, the first one named in the text; else ``urn:unknown``."""
    named = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)(urn:nir:[a-z0-9.\-;~:]+)", 1)
    return F.coalesce(F.when(~urn.isin("", "urn:", "urn:unknown"), urn), F.nullif(named, F.lit("")), F.lit("urn:unknown"))


def fallback_urn(title: Column, date: Column) -> Column:
    """URN of an act that names none: a hash of title and ISO date; a missing title is written None."""
    return F.concat(F.lit("urn:fallback:"), F.substring(F.sha2(F.concat(F.coalesce(title, F.lit("None")), F.lit("_"), F.date_format(date, "yyyy-MM-dd")), 256), 1, 16))

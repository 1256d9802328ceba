"""References to records that did not exist when the reference was loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Instants outside every window.
EVER, NEVER = "0001-01-01 00:00:00", "9999-12-31 23:59:59"


def spells(keys: DataFrame, gone: DataFrame, referred: str) -> DataFrame:
    """``(referred, key, since, until)`` of records: from their first load until their deletion.

    ``keys`` has ``key`` and ``at`` (when a row was loaded), ``gone`` has ``key`` and
    ``at`` (when it was deleted; the earliest counts). Null keys don't count.
    """
    born = keys.where("key is not null").groupBy("key").agg(F.min("at").alias("since"))
    dead = gone.where("key is not null").groupBy("key").agg(F.min("at").alias("until"))
    return born.join(dead, "key", "left").select(F.lit(referred).alias("referred"), "key", "since", F.coalesce("until", F.lit(NEVER).cast("timestamp_ntz")).alias("until"))


def orphans(refs: DataFrame, spans: DataFrame, allowed: Column) -> DataFrame:
    """The rows of ``refs`` whose key names no record that existed at that time.

    ``refs`` has ``key`` (normalised, '' or null: names nothing) and ``at``, besides
    any other columns, all of which are returned; ``spans`` has ``referred, key, since,
    until`` (since included, until excluded); ``allowed`` says of a pair of rows
    (``refs.scope``, ``spans.referred``) whether the reference may mean that table.
    Repeated references are judged each at its own time.

    Distinct keys with their first and last use are anti-joined with the spans that
    cover all their uses, which settles nearly all keys with a combined aggregate; only
    the references under the keys left are joined back and held against each span. Hot
    keys are combined before the first shuffle; in the join back AQE splits them.
    """
    usable = refs.where("key is not null and key <> ''")
    uses = usable.groupBy("scope", "key").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    u, s = uses.alias("u"), spans.alias("s")
    same = (F.col("u.key") == F.col("s.key")) & allowed
    open_keys = u.join(s, same & (F.col("s.since") <= F.col("u.lo")) & (F.col("s.until") > F.col("u.hi")), "left_anti").select("scope", "key")
    suspects = usable.join(open_keys, ["scope", "key"], "left_semi").alias("u")
    found = suspects.join(s, same & (F.col("s.since") <= F.col("u.at")) & (F.col("s.until") > F.col("u.at")), "left_anti")
    return found.unionByName(refs.where("key is null or key = ''"))

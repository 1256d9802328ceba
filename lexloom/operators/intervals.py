"""Overlapping and gapped intervals of days: a mergeable aggregate of sorted disjoint intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Day number of an open end, above that of 9999-12-31.
OPEN = 2**22
#: Day numbers of one key, from OFFSET on, lie within SPAN.
SPAN, OFFSET = 2**24, 2**22
#: Partial lists longer than this are merged in an intermediate level of the tree first.
LONG = 32
_STATE = "key string, first array<int>, last array<int>"


def _merge(code: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge intervals per code; both ends belong to them, and consecutive days are continuous.

    With each code on its own stretch of numbers one running maximum serves all codes.
    """
    if not len(code):
        return code, first, last
    start = code * SPAN + first + OFFSET
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate((code * SPAN + last + OFFSET)[order])
    code, first = code[order], first[order]
    new = np.r_[True, (start[1:] > reach[:-1] + 1) | (code[1:] != code[:-1])]
    at = np.flatnonzero(new)
    return code[at], first[at], (reach[np.r_[at[1:], len(code)] - 1] - code[at] * SPAN - OFFSET)


class _Partial:
    """Sorted disjoint intervals of many keys; ``add`` and ``lists`` keep them merged."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = self.kept = 0

    def add(self, keys: pa.Array, reps: np.ndarray | None, first: np.ndarray, last: np.ndarray) -> None:
        enc = keys.dictionary_encode()
        own = np.array([self.codes.setdefault(k, len(self.codes)) for k in enc.dictionary.to_pylist()], dtype=np.int64)
        code = own[enc.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.int64)
        self.parts.append((code if reps is None else np.repeat(code, reps), first.astype(np.int64), last.astype(np.int64)))
        self.n += len(first)
        if self.n > 2 * self.kept + 500_000:
            self.compact()

    def compact(self) -> None:
        self.parts = [_merge(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.n = self.kept = len(self.parts[0][0])

    def lists(self) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        self.compact()
        code, first, last = self.parts[0]
        at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        names = list(self.codes)
        offsets = pa.array(np.r_[at, len(code)].astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array([names[c] for c in code[at]], pa.string()), pa.ListArray.from_arrays(offsets, pa.array(first.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(last.astype(np.int32)))],
            ["key", "first", "last"],
        )


def _from_rows(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Level 0: a partition's rows to partial lists; emitted early where it holds very many keys."""
    state = _Partial()
    for b in batches:
        state.add(b["key"], None, b["first"].to_numpy(zero_copy_only=False), b["last"].to_numpy(zero_copy_only=False))
        if len(state.codes) > most:
            yield state.lists()
            state = _Partial()
    if (out := state.lists()) is not None:
        yield out


def _from_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Further levels: partial lists, sorted by key, to one list a key; holds one batch and the last key's list."""
    state = _Partial()
    for b in batches:
        if not b.num_rows:
            continue
        key, first, last = b["key"], b["first"], b["last"]
        final = key[b.num_rows - 1].as_py()
        same = np.array([k == final for k in key.to_pylist()])
        cut = int(np.argmax(same))
        for lo, hi in ((0, cut), (cut, b.num_rows)):
            if lo == hi:
                continue
            if lo == cut and state.codes and final not in state.codes:
                yield state.lists()
                state = _Partial()
            part = [c.slice(lo, hi - lo) for c in (key, first, last)]
            reps = part[1].value_lengths().to_numpy(zero_copy_only=False)
            state.add(part[0], reps, part[1].flatten().to_numpy(zero_copy_only=False), part[2].flatten().to_numpy(zero_copy_only=False))
    if (out := state.lists()) is not None:
        yield out


def merged(rows: DataFrame) -> DataFrame:
    """``(key, first, last)``: sorted disjoint lists of the intervals of every key.

    ``rows`` has ``key`` (string), ``first`` and ``last`` (day numbers, both ends
    included; null last: open). Rows with a null key or first, or with last before
    first, don't count; repeated rows change nothing.

    The state of a key is its list of disjoint intervals. Each map task merges its own
    rows, long partial lists are merged in groups on an intermediate level, the rest
    in the last level: a hot key arrives there as a few short lists, never as its rows.
    A list can't have more entries than the calendar has separable days.
    """
    level_0 = rows.where("key is not null and first is not null and (last is null or last >= first)").select(F.col("key").cast("string").alias("key"), F.col("first").cast("int").alias("first"), F.coalesce(F.col("last").cast("int"), F.lit(OPEN)).alias("last")).mapInArrow(_from_rows, _STATE)
    salted = level_0.withColumn("salt", F.when(F.size("first") > LONG, F.spark_partition_id() % 64 + 1).otherwise(0))
    once = salted.where("salt > 0").repartition("key", "salt").sortWithinPartitions("key", "salt").select("key", "first", "last").mapInArrow(_from_lists, _STATE)
    return salted.where("salt = 0").select("key", "first", "last").unionByName(once).repartition("key").sortWithinPartitions("key").mapInArrow(_from_lists, _STATE)


def periods_and_gaps(rows: DataFrame) -> DataFrame:
    """``(key, kind, first_day, last_day)``: continuous periods and the gaps between them.

    ``rows`` has ``key``, ``first`` and ``last`` as dates. Days are written YYYY-MM-DD,
    both ends included; ``last_day`` is '' for an open period. See ``merged``.
    """
    lists = merged(rows.select("key", F.unix_date("first").alias("first"), F.unix_date("last").alias("last")))
    day = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")
    spans = lists.select(
        "key",
        F.explode(
            F.concat(
                F.zip_with("first", "last", lambda a, b: F.struct(F.lit("period").alias("kind"), a.alias("a"), b.alias("b"))),
                F.zip_with(F.slice("last", 1, F.size("last") - 1), F.slice("first", 2, F.size("first")), lambda a, b: F.struct(F.lit("gap").alias("kind"), (a + 1).alias("a"), (b - 1).alias("b"))),
            )
        ).alias("x"),
    )
    return spans.select("key", F.col("x.kind").alias("kind"), day(F.col("x.a")).alias("first_day"), F.when(F.col("x.b") == OPEN, "").otherwise(day(F.col("x.b"))).alias("last_day"))

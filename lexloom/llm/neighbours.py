"""Most similar vectors by cross-polytope hashing.

A pseudo-rotation (random signs and a fast Hadamard transform, three times) turns a
unit vector; its hash is the nearest signed axis. A table's key joins several hashes;
vectors that share a key in some table are candidates, and these are ranked by their
exact cosine. Further probes replace hashes of a key by their next nearest axes, those
first that lag least behind. Hashes, tables and probes are the same whatever the number
of rows: whether two vectors meet depends on these two only. A search without a least
cosine has its hashing bound how far the nearest may be, and then compares all rows
within these bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.tables import Shelf

#: Largest error of a cosine reckoned from two quantised vectors of 64 numbers, with room.
SLACK = 0.03
#: Vectors whose unit coordinates agree to so many decimals are copies of each other.
DECIMALS = 4
#: Rows of a bucket compared with each other in one block.
BLOCK = 2048
#: Largest error of a cosine reckoned in float32, with room.
ROUNDING = 5e-6


@dataclass(frozen=True)
class Lsh:
    """Tables, keys of each that a vector goes to, hashes a key; ``crowd``: a bucket with more rows is compared
    part by part; ``more``: rotations drawn besides those of the keys, which stay the same by it; ``top``: largest
    coordinate of a quantised vector, of one byte up to 127, else of two; ``axes``: of each hash, how many axes the probes of a search may take."""

    tables: int = 3
    probes: int = 3
    hashes: int = 2
    dim: int = 64
    more: int = 1
    crowd: int = 20_000
    seed: int = 7
    top: int = 32_767
    axes: tuple[int, ...] = ()

    def signs(self) -> np.ndarray:
        """Random signs: (table, hash, turn, coordinate); coordinates are filled up to a power of two."""
        return np.random.default_rng(self.seed).choice(np.array([-1, 1], np.float32), (self.tables, self.hashes + self.more, 3, 1 << (self.dim - 1).bit_length()))


#: The setting for neighbours of a least cosine of 0.9, for any number of rows.
SIMILAR = Lsh(3, 3, 2)
#: The one that bounds searches without a least cosine; what they find doesn't depend on it.
SEARCH = Lsh(1, 192, 2, axes=(8, 28), top=127)
#: Most rows, and most queries, that a task compares with each other, and into how many parts fewer rows go.
SIDE, PARTS = 262_144, 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.float32(np.sqrt(d))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def axes(x: np.ndarray, most: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The nearest signed axes of each row, nearest first, and how far each lags behind the nearest."""
    if most == 1:
        best = np.argmax(np.abs(x), axis=1)[:, None]
    else:
        best = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :most]
    v = np.take_along_axis(x, best, axis=1)
    size = np.abs(v)
    return 2 * best + (v < 0), (size[:, :1] - size)


def _unit(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes of unit float32, with a hash that copies share."""
    for b in batches:
        ids, vectors = b.column(0), b.column(1)
        right = np.flatnonzero(np.asarray(vectors.value_lengths().fill_null(-1)) == dim)
        flat = vectors.take(pa.array(right)).flatten()
        x = np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))).reshape(-1, dim)
        scale = np.abs(x).max(axis=1, initial=0)
        fine = np.isfinite(scale) & (scale > 0)
        right, x = right[fine], x[fine] / scale[fine, None]
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        near = np.round(x * 10.0**DECIMALS).astype(np.int16)
        codes = [blake2b(row.tobytes(), digest_size=16).digest() for row in near]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(right)), _packed(x), pa.array(codes, pa.binary())], ["id", "unit", "code"])


def _packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(x.strides[0]), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def units(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``(id, unit, code)`` of every row that has an id and a usable vector; copies share the code.

    Vectors that are null, of another length, all zero, or hold a null or a number that
    isn't finite don't take part.
    """
    kind = "array<double>" if dict(rows.dtypes)[vector] == "array<double>" else "array<float>"
    got = rows.where(F.col(key).isNotNull() & (F.size(vector) == dim)).select(F.col(key).cast("string").alias("id"), F.col(vector).cast(kind).alias("vector"))
    return got.mapInArrow(partial(_unit, dim=dim), "id string, unit binary, code binary")


def _matrix(column: pa.Array, kind: type, dim: int) -> np.ndarray:
    whole = pa.concat_arrays([column])
    offsets = np.frombuffer(whole.buffers()[1], np.int32, len(whole) + 1 + whole.offset)[whole.offset :]
    return np.frombuffer(whole.buffers()[2], kind, count=len(whole) * dim, offset=int(offsets[0])).reshape(len(whole), dim)


def _quantised(x: np.ndarray, top: int = 127) -> np.ndarray:
    """Unit vectors as small whole numbers, each scaled by its own largest coordinate, which is got back by normalising."""
    return np.round(x * (top / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8 if top <= 127 else np.int16)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine.astype(np.float64), -1, 1))


def _within(who: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Which candidates may be among the k nearest of ``who``: those whose least angle isn't over the k-th smallest largest one."""
    order = np.lexsort((high, who))
    first = np.searchsorted(who[order], who, side="left")
    last = np.searchsorted(who[order], who, side="right")
    kth = np.minimum(first + k, last) - 1
    return (last - first <= k) | (low <= high[order][kth])


def _hashed(batches: Iterator[pa.RecordBatch], lsh: Lsh, probes: int) -> Iterator[pa.RecordBatch]:
    """A row for each table and probe: table, key, id, quantised vector."""
    signs = lsh.signs()
    wide = signs.shape[-1]
    for b in batches:
        for lo in range(0, b.num_rows, 8192):
            part = b.slice(lo, 8192)
            x = _matrix(part.column(1), np.float32, lsh.dim)
            q = _quantised(x, lsh.top)
            packed = _packed(q)
            full = np.zeros((len(x), wide), np.float32)
            full[:, : lsh.dim] = x
            for t in range(lsh.tables):
                found = [axes(rotate(full, signs[t, h]), probes) for h in range(lsh.hashes)]
                first = np.stack([f[0][:, 0] for f in found], axis=1).astype(np.int64)
                keys = [first]
                if probes > 1:
                    # single changes, cheapest first: the sum of lags orders them
                    lags = np.concatenate([found[h][1][:, 1:] for h in range(lsh.hashes)], axis=1)
                    order = np.argsort(lags, axis=1, kind="stable")[:, : probes - 1]
                    for p in range(order.shape[1]):
                        h, k = order[:, p] // (probes - 1), order[:, p] % (probes - 1) + 1
                        other = first.copy()
                        for own in range(lsh.hashes):
                            at = h == own
                            other[at, own] = found[own][0][at, k[at]]
                        keys.append(other)
                for key in keys:
                    short = np.zeros(len(x), np.int64)
                    for h in range(lsh.hashes):
                        short = short * (2 * wide) + key[:, h]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(short), part.column(0), packed], ["t", "short", "id", "q"])


_ROW = "t int, short bigint, id string, q binary"


def _buckets(batches: Iterator[pa.RecordBatch], heads: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each bucket together; they come sorted by their first ``heads`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(i)) for i in range(heads)]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if last is not None and first != last:
            yield held
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo:
                yield held
                held = []
            held.append(b.slice(lo, hi - lo))
        last = tuple(c[-1] for c in cols)
    if held:
        yield held


def _sized(x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised vectors as unit ones, and the angle by which rounding may have moved each.

    Rounding moves a quantised vector by half a unit a coordinate, so by an angle with
    sine sqrt(dim) / 2 / its length at most; the angle of two by the sum of theirs.
    """
    x = x.astype(np.float32)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x /= size
    return x, np.arcsin(np.minimum(1, 0.51 * np.sqrt(dim) / size[:, 0].astype(np.float64)))


class _Best:
    """Candidates of some rows among others; what can't be among the k best of a row, whatever the rounding, is left out."""

    def __init__(self, off: np.ndarray, far: float, k: int, floor: np.ndarray | float):
        self.off, self.far, self.k = off, far, k
        self.floor = np.maximum(np.broadcast_to(floor, len(off)), -1.5).astype(np.float64)
        self.best = np.full((len(off), k), -2, np.float32)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, r: np.ndarray, cols: np.ndarray, s: np.ndarray) -> None:
        """The cosines ``s`` of rows ``r`` with others ``cols``, each pair met once."""
        some = (s >= self.floor[r].astype(np.float32)[:, None]).any(axis=1)
        if not some.any():
            return
        if not some.all():
            r, s = r[some], s[some]
        most = -np.partition(-s, self.k - 1, axis=1)[:, : self.k] if s.shape[1] > self.k else s
        best = -np.sort(-np.concatenate((self.best[r], most), axis=1), axis=1)[:, : self.k]
        self.best[r] = best
        floor = np.cos(np.minimum(np.pi, _angle(best[:, -1] - ROUNDING) + 2 * (self.off[r] + self.far))) - ROUNDING
        self.floor[r] = np.maximum(self.floor[r], np.where(best[:, -1] > -1.5, floor, -1.5))
        i, j = np.nonzero(s >= self.floor[r][:, None])
        self.found.append((r[i], cols[j], s[i, j]))
        self.n += len(i)
        if self.n > 2_000_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        r, c, near = (np.concatenate(x) for x in zip(*self.found, strict=True))
        fit = near >= self.floor[r]
        self.found, self.n = [(r[fit], c[fit], near[fit])], int(fit.sum())
        return self.found[0]


def _kinds(top: int) -> type:
    return np.int8 if top <= 127 else np.int16


def _near_pairs(batches: Iterator[pa.RecordBatch], dim: int, k: int, least: float, top: int) -> Iterator[pa.RecordBatch]:
    """``(a, b)``: for each row of a bucket all others that may be among the k most similar, at ``least`` or more.

    Rows of one side look for those of the other, or all rows among themselves if there is one side only.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for parts in _buckets(batches, 3):
        if sum(p.num_rows for p in parts) < 2:
            continue
        side = np.concatenate([np.asarray(p.column(3)) for p in parts])
        ids, code = _coded(pa.concat_arrays([p.column(4) for p in parts]))
        x, off = _sized(np.concatenate([_matrix(p.column(5), _kinds(top), dim) for p in parts]), dim)
        # an id counts once a side, though it may be redelivered, or probe the bucket twice
        left, right = (w[np.unique(code[w], return_index=True)[1]] for w in (np.flatnonzero(side == 0), np.flatnonzero(side == 1)))
        for asks, has in [(left, right), (right, left)] if len(left) and len(right) else [(w, w) for w in (left, right)]:
            for rows in (asks[lo : lo + BLOCK] for lo in range(0, len(asks) if len(has) else 0, BLOCK)):
                best = _Best(off[rows], off[has].max(), k, least)
                for at in range(0, len(has), BLOCK):
                    cols = has[at : at + BLOCK]
                    s = x[rows] @ x[cols].T
                    s[code[rows][:, None] == code[cols][None, :]] = -2
                    best.add(np.arange(len(rows)), cols, s)
                r, c, near = best.cut()
                fit = _within(r, _angle(near + ROUNDING) - off[rows[r]] - off[c], _angle(near - ROUNDING) + off[rows[r]] + off[c], k)
                out.append((ids[code[rows[r[fit]]]], ids[code[c[fit]]]))
                n += int(fit.sum())
        if n > 50_000:
            yield _pairs(out)
            out, n = [], 0
    if n:
        yield _pairs(out)


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    turn = x > y
    pairs = dict.fromkeys(zip(np.where(turn, y, x).tolist(), np.where(turn, x, y).tolist(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["a", "b"])


def _cosine(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (_matrix(b.column(i), np.float32, dim).astype(np.float64) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)))], ["a", "b", "cosine"])


def _one_a_row(shelf: Shelf, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ids with their smallest code, and the rows of ``base`` that have it (several, if they were redelivered)."""
    ids, _ = shelf.put(base.groupBy("id").agg(F.min("code").alias("code"), F.max("code").alias("other")))
    odd, _ = shelf.put(ids.where("code <> other").select("id", F.col("code").alias("own")))
    return ids, base.join(odd, "id", "left").where("own is null or own = code").select("id", "unit", "code")


def similar(rows: DataFrame, key: str, vector: str, k: int = 5, least: float = 0.9, lsh: Lsh | None = None, dim: int = 64) -> DataFrame:
    """``(id, neighbour, cosine, rank)``: of every vector its k most similar others with a cosine of ``least`` or more.

    Copies are one class: only its smallest member is hashed, and members are taken up
    again at the end, those of the own class first (cosine 1), the smallest ids of a
    class first. Ties rank by id. An unusable vector takes no part; an id counts once,
    with one of its vectors; empty tables give no rows; repeated rows and further
    columns change nothing.

    The loss: with the setting for any number of rows (``SIMILAR``) 0.998 of all pairs
    from 0.9 up are found, those of 0.92 and less included at 0.99 (measured against
    brute force, see the README). No bucket is capped: a crowded one is cut into parts, and each pair of its parts is
    compared, so no pair of it is lost and no task holds more than two parts; all are
    compared in blocks.

    Vectors are read again rather than stored, and move once, quantised, a table of
    hashes each. What is joined to all vectors (ids with several vectors, classes,
    crowded buckets, ids that some pair names) is written first, so its size is known
    and Spark broadcasts it only if it is small.
    """
    spark = rows.sparkSession
    shelf = Shelf(spark, "similar")
    ids, one = _one_a_row(shelf, units(rows, key, vector, dim))
    lsh = lsh or replace(SIMILAR, dim=dim)
    kinds, _ = shelf.put(ids.groupBy("code").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    reps = one.join(kinds.select("code", "rep"), "code", "left").where("rep is null or rep = id").select("id", "unit")
    hashed = reps.mapInArrow(partial(_hashed, lsh=lsh, probes=lsh.probes), _ROW)
    crowds, _ = shelf.put(hashed.groupBy("t", "short").agg(F.count("*").alias("n")).where(F.col("n") > lsh.crowd).select("t", "short", F.ceil(F.col("n") / lsh.crowd).cast("bigint").alias("parts")))
    own = hashed.join(crowds, ["t", "short"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint"))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    keyed = met.select("t", "short", (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("long"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "q")
    at = ("t", "short", "long")
    pairs, _ = shelf.put(keyed.repartition(*at).sortWithinPartitions(*at).mapInArrow(partial(_near_pairs, dim=lsh.dim, k=k, least=least - SLACK, top=lsh.top), "a string, b string").distinct())
    named, _ = shelf.put(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    some, _ = shelf.put(reps.join(named, "id", "left_semi").dropDuplicates(["id"]))
    scored = pairs.join(some.toDF("a", "unit_a"), "a").join(some.toDF("b", "unit_b"), "b").select("a", "b", "unit_a", "unit_b").mapInArrow(partial(_cosine, dim=dim), "a string, b string, cosine double").where(F.col("cosine") >= least)
    # the members of a class of more than k have their nearest among themselves
    both = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")).join(kinds.where(F.col("n") > k).select(F.col("rep").alias("a")), "a", "left_anti")
    copies = ids.join(kinds, "code").select("id", "rep", "n")
    first = copies.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("place") <= k + 1)
    kin = copies.alias("x").join(first.alias("y"), "rep").where("x.id <> y.id").select(F.col("x.id").alias("id"), F.col("y.id").alias("neighbour"), F.lit(1.0).alias("cosine"))
    of_a = both.join(copies.where(F.col("n") <= k).select(F.col("rep").alias("a"), "id"), "a", "left").select(F.coalesce("id", "a").alias("id"), "b", "cosine")
    of_b = of_a.join(first.select(F.col("rep").alias("b"), F.col("id").alias("neighbour")), "b", "left").select("id", F.coalesce("neighbour", "b").alias("neighbour"), "cosine")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return of_b.unionByName(kin).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _turned(part: pa.RecordBatch, lsh: Lsh) -> tuple[np.ndarray, pa.Array]:
    """Vectors filled up to the width of the rotations, and quantised."""
    x = _matrix(part.column(1), np.float32, lsh.dim)
    full = np.zeros((len(x), 1 << (lsh.dim - 1).bit_length()), np.float32)
    full[:, : lsh.dim] = x
    return full, _packed(_quantised(x, lsh.top))


def _placed(batches: Iterator[pa.RecordBatch], lsh: Lsh, tables: range) -> Iterator[pa.RecordBatch]:
    """A row for each table: table and first hash as one number, the other hashes as another."""
    signs = lsh.signs()
    wide = 2 * signs.shape[-1]
    for b in batches:
        for lo in range(0, b.num_rows, 8192):
            part = b.slice(lo, 8192)
            full, packed = _turned(part, lsh)
            for t in tables:
                first = [axes(rotate(full, s))[0][:, 0] for s in signs[t, : lsh.hashes]]
                sub = np.zeros(len(full), np.int64)
                for h in first[1:]:
                    sub = sub * wide + h
                yield pa.RecordBatch.from_arrays([pa.array(t * wide + first[0].astype(np.int64)), pa.array(sub), _packed(sub.astype(np.int32)[:, None]), part.column(0), packed], ["base", "sub", "rest", "id", "q"])


def _asking(batches: Iterator[pa.RecordBatch], lsh: Lsh, tables: range, groups: int) -> Iterator[pa.RecordBatch]:
    """A row for each table, first hash and group that some of the ``probes`` best keys of a query lie in, with the rest of these keys."""
    signs = lsh.signs()
    wide = 2 * signs.shape[-1]
    most = lsh.axes or (min(lsh.probes, wide // 2),) * lsh.hashes
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            part = b.slice(lo, 1024)
            full, packed = _turned(part, lsh)
            n = len(full)
            kth = np.asarray(part.column(2).fill_null(np.pi)).astype(np.float32).view(np.int32)
            for t in tables:
                short, sub, total = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.int64), np.zeros((n, 1), np.float32)
                for h in range(lsh.hashes):
                    code, lag = axes(rotate(full, signs[t, h]), most[h])
                    total = (total[:, :, None] + lag[:, None, :] ** 2).reshape(n, -1)
                    if h:
                        short, sub = np.repeat(short, most[h], axis=1), (sub[:, :, None] * wide + code[:, None, :]).reshape(n, -1)
                    else:
                        short, sub = code, np.zeros_like(code)
                if total.shape[1] > lsh.probes:
                    some = np.argpartition(total, lsh.probes - 1, axis=1)[:, : lsh.probes]
                    short, sub = np.take_along_axis(short, some, axis=1), np.take_along_axis(sub, some, axis=1)
                who = np.repeat(np.arange(n), short.shape[1])
                short, sub = short.ravel(), sub.ravel()
                grp = sub % groups
                order = np.lexsort((grp, short, who))
                who, short, grp, sub = who[order], short[order], grp[order], sub[order]
                first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (short[1:] != short[:-1]) | (grp[1:] != grp[:-1])])
                # each list begins with -1, by which queries are known, and their bound
                offsets = pa.py_buffer((4 * (np.r_[first, len(sub)] + 2 * np.arange(len(first) + 1))).astype(np.int32).tobytes())
                head = np.stack((np.full(len(first), -1), kth[who[first]]), axis=1).ravel()
                rest = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(np.insert(sub, np.repeat(first, 2), head).astype(np.int32).tobytes())])
                own = pa.array(who[first])
                yield pa.RecordBatch.from_arrays([pa.array(t * wide + short[first].astype(np.int64)), pa.array(grp[first]), rest, part.column(0).take(own), packed.take(own)], ["base", "grp", "rest", "id", "q"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key of a query."""
    for b in batches:
        n, keys = _listed(b.column(1))
        first = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)
        kth = np.repeat(keys[first + 1], n - 2)
        keys = np.delete(keys, np.r_[first, first + 1])
        own = pa.array(np.repeat(np.arange(b.num_rows), n - 2))
        yield pa.RecordBatch.from_arrays([b.column(0).take(own), pa.array(keys.astype(np.int64)), _packed(np.stack((np.full_like(keys, -1), kth, keys), axis=1)), b.column(2).take(own), b.column(3).take(own)], ["base", "sub", "rest", "id", "q"])


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each value holds, and all of them."""
    whole = pa.concat_arrays([column])
    offsets = np.frombuffer(whole.buffers()[1], np.int32, len(whole) + 1 + whole.offset)[whole.offset :]
    return np.diff(offsets) // 4, np.frombuffer(whole.buffers()[2], np.int32, count=(int(offsets[-1]) - int(offsets[0])) // 4, offset=int(offsets[0])) if len(whole) else np.zeros(0, np.int32)


def _coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and the place of each value among them."""
    d = column.dictionary_encode()
    return np.asarray(d.dictionary), np.asarray(d.indices).astype(np.int64)


def _answers(batches: Iterator[pa.RecordBatch], lsh: Lsh, k: int) -> Iterator[pa.RecordBatch]:
    """``(a, b, low, high)``: for each query of a bucket the rows under its keys that may be among the k most similar, and the least and largest angle."""
    out: list[tuple[np.ndarray, ...]] = []
    n = 0

    def told() -> pa.RecordBatch:
        a, b, low, high = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(low), pa.array(high)], ["a", "b", "low", "high"])

    for parts in _buckets(batches, 1):
        column = lambda c: pa.concat_arrays([p.column(c) for p in parts])  # noqa: B023, E731 used within the bucket
        many, at = _listed(column(2))
        asks = at[np.r_[0, np.cumsum(many)[:-1]]] < 0
        if asks.all() or not asks.any():
            continue
        ids, code = _coded(column(1))
        x, off = _sized(_matrix(column(3), _kinds(lsh.top), lsh.dim), lsh.dim)
        keys = column(2)
        # rows by the rest of their keys
        once = lambda w: w[np.unique(code[w], return_index=True)[1]]  # noqa: B023, E731 an id counts once a side, though it may be redelivered
        rows = once(np.flatnonzero(~asks))
        sub = _listed(keys.take(pa.array(rows)))[1]
        order = np.argsort(sub, kind="stable")
        rows, sub = rows[order], sub[order]
        own = np.flatnonzero(np.r_[True, sub[1:] != sub[:-1]])
        kinds, until = sub[own], np.r_[own[1:], len(sub)]
        # queries by the keys they look under
        queries = once(np.flatnonzero(asks))
        many, at = _listed(keys.take(pa.array(queries)))
        first = np.r_[0, np.cumsum(many)[:-1]].astype(np.int64)
        kth = at[first + 1].view(np.float32).astype(np.float64)
        who, at = np.repeat(np.arange(len(queries)), many - 2), np.delete(at, np.r_[first, first + 1])
        place = np.minimum(np.searchsorted(kinds, at), len(kinds) - 1)
        met = np.flatnonzero(kinds[place] == at)
        met = met[np.argsort(place[met], kind="stable")]
        who, place = who[met], place[met]
        if not len(place):
            continue
        edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        far = off[rows].max()
        best = _Best(off[queries], far, k, np.cos(np.minimum(np.pi, kth + off[queries] + far)) - ROUNDING)
        for lo, hi in zip(edges, np.r_[edges[1:], len(place)], strict=True):
            some = who[lo:hi]
            cols = rows[own[place[lo]] : until[place[lo]]]
            for q in range(0, len(some), BLOCK):
                for c in range(0, len(cols), BLOCK):
                    r, w = some[q : q + BLOCK], cols[c : c + BLOCK]
                    s = x[queries[r]] @ x[w].T
                    s[code[queries[r]][:, None] == code[w][None, :]] = -2
                    best.add(r, w, s)
        r, c, near = best.cut()
        fit = _within(r, (low := _angle(near + ROUNDING) - off[queries[r]] - off[c]), (high := _angle(near - ROUNDING) + off[queries[r]] + off[c]), k)
        out.append((ids[code[queries[r[fit]]]], ids[code[c[fit]]], low[fit], high[fit]))
        n += int(fit.sum())
        if n > 50_000:
            yield told()
            out, n = [], 0
    if n:
        yield told()


def _small(batches: Iterator[pa.RecordBatch], dim: int, top: int) -> Iterator[pa.RecordBatch]:
    """Vectors quantised."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), _packed(_quantised(_matrix(b.column(1), np.float32, dim), top)), b.column(2)], ["id", "q", "kth"])


def _compared(batches: Iterator[pa.RecordBatch], dim: int, k: int, top: int) -> Iterator[pa.RecordBatch]:
    """``(a, b, low, high)``: for each query of a part the rows of it that may be among the k most similar, and the least and largest angle.

    All are compared. Rows have an angle below zero, queries the one their k-th nearest has at most.
    """
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    column = lambda c: pa.concat_arrays([p.column(c) for p in parts])
    ids, kth = np.asarray(column(1)), np.asarray(column(3))
    q = _matrix(column(2), _kinds(top), dim)
    # an id counts once a side, though it may be redelivered
    has, asks = (w[np.unique(ids[w], return_index=True)[1]] for w in (np.flatnonzero(kth < 0), np.flatnonzero(kth >= 0)))
    if not len(has) or not len(asks):
        return
    x, off = _sized(q[asks], dim)
    far = float(max(_sized(q[has[at : at + BLOCK]], dim)[1].max() for at in range(0, len(has), BLOCK)))
    best = _Best(off, far, k, np.cos(np.minimum(np.pi, kth[asks] + off + far)) - ROUNDING)
    # ids are in order on both sides: where a query stands among the rows, if it is one
    own = np.minimum(np.searchsorted(ids[has], ids[asks]), len(has) - 1)
    own[ids[has[own]] != ids[asks]] = -1
    for at in range(0, len(has), BLOCK):
        y = _sized(q[has[at : at + BLOCK]], dim)[0].T
        for lo in range(0, len(asks), BLOCK):
            r = np.arange(lo, min(lo + BLOCK, len(asks)))
            s = x[r] @ y
            self = np.flatnonzero((own[r] >= at) & (own[r] < at + BLOCK))
            s[self, own[r[self]] - at] = -2
            best.add(r, np.arange(at, at + s.shape[1]), s)
    r, c, near = best.cut()
    away = _sized(q[has[c]], dim)[1]
    low, high = _angle(near + ROUNDING) - off[r] - away, _angle(near - ROUNDING) + off[r] + away
    fit = np.flatnonzero(_within(r, low, high, k))
    for lo in range(0, len(fit), 50_000):
        w = fit[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[asks[r[w]]]), pa.array(ids[has[c[w]]]), pa.array(low[w]), pa.array(high[w])], ["a", "b", "low", "high"])


def search(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, lsh: Lsh | None = None, dim: int = 64) -> DataFrame:
    """``(id, neighbour, cosine, rank)``: of every vector in ``queries`` its k most similar others in ``rows``, exactly.

    Hashing bounds the angle of each query's k-th nearest: vectors go to one key of each
    table, queries look under ``lsh.probes``. A task has the rows under some keys with one
    first hash; a query comes there once, with those of its keys, and meets only the rows
    under them. The rows under a crowded key are cut into parts, to each of which its
    queries go.

    Then each query is compared with each row, whatever their keys, in tasks of at most
    ``SIDE`` of both, which tell the rows that may lie within the bound and be among the
    best, as far as quantised vectors can say; those that still may be over all tasks are
    ranked by their exact cosine. So neither ``lsh`` nor the number of rows changes what
    is found, only how much is told on the way; the work is queries times rows. Ties rank
    by id; unusable vectors take no part; an id counts once, with one of its vectors;
    copies are vectors like any others.
    """
    spark = rows.sparkSession
    shelf = Shelf(spark, "search")
    ids, own = _one_a_row(shelf, units(rows, key, vector, dim))
    n = ids.count()
    lsh = lsh or replace(SEARCH, dim=dim)
    asked_ids, asked = _one_a_row(shelf, units(queries, key, vector, dim))
    groups = max(1, -(-n // (2 * dim * lsh.crowd))) if lsh.hashes > 1 else 1
    # until the end ids are numbers; should two share one, more is compared
    own, asked = (d.withColumn("h", F.xxhash64("id")) for d in (own, asked))

    def met(tables: range, asked: DataFrame) -> DataFrame:
        """``(a, b, low, high)`` that the tables' buckets give."""
        data = own.select(F.col("h").alias("id"), "unit").mapInArrow(partial(_placed, lsh=lsh, tables=tables), "base bigint, sub bigint, rest binary, id bigint, q binary")
        asks = asked.select(F.col("h").alias("id"), "unit", "kth").mapInArrow(partial(_asking, lsh=lsh, tables=tables, groups=groups), "base bigint, grp bigint, rest binary, id bigint, q binary")
        place = lambda grp: (F.col("base") * groups + grp).alias("bucket")
        spread = data.select(place(F.pmod("sub", F.lit(groups))), "id", "rest", "q")
        sent = asks.select(place(F.col("grp")), "id", "rest", "q")
        # no key is crowded unless its first hash is; which of them are is counted only then
        bases, _ = shelf.put(data.groupBy("base").agg(F.count("*").alias("n")).where(F.col("n") > lsh.crowd).select("base"))
        if not bases.isEmpty():
            crowds, _ = shelf.put(data.join(bases, "base", "left_semi").groupBy("base", "sub").agg(F.count("*").alias("n")).where(F.col("n") > lsh.crowd).select("base", "sub", F.ceil(F.col("n") / lsh.crowd).cast("int").alias("parts")))
            # the parts of a crowded key have buckets of their own, below zero; should two meet in one, more is compared
            alone = lambda part: (-1 - F.xxhash64("base", "sub", part).bitwiseAND(F.lit((1 << 63) - 1))).alias("bucket")
            full = F.col("parts").isNotNull()
            spread = data.join(crowds, ["base", "sub"], "left").select(F.when(full, alone(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))).otherwise(place(F.pmod("sub", F.lit(groups)))).alias("bucket"), "id", "rest", "q")
            single = asks.select("base", "rest", "id", "q").mapInArrow(_single, "base bigint, sub bigint, rest binary, id bigint, q binary").join(crowds, ["base", "sub"])
            parted = single.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            sent = sent.unionByName(parted.select(alone(F.col("part")), "id", "rest", "q"))
        return spread.unionByName(sent).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_answers, lsh=lsh, k=k), "a bigint, b bigint, low double, high double")

    def compared(asked: DataFrame) -> DataFrame:
        """``(a, b, low, high)`` that the comparison of all rows gives."""
        across, down = max(1, -(-asked_ids.count() // SIDE)), max(-(-n // SIDE), min(PARTS, -(-n // BLOCK)), 1)
        top = Lsh.top
        small = lambda d, kth: d.select(F.col("h").alias("id"), "unit", kth.cast("double").alias("kth")).mapInArrow(partial(_small, dim=dim, top=top), "id bigint, q binary, kth double")
        every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
        at = lambda of, many: F.pmod(of, F.lit(many)).cast("int")
        spread = small(own, F.lit(-1)).withColumn("ask", every(across)).select((at(F.col("id"), down) * across + F.col("ask")).alias("part"), "id", "q", "kth")
        sent = small(asked, F.coalesce("kth", F.lit(np.pi))).withColumn("row", every(down)).select((F.col("row") * across + at(F.col("id"), across)).alias("part"), "id", "q", "kth")
        return spread.unionByName(sent).repartitionById(down * across, "part").mapInArrow(partial(_compared, dim=dim, k=k, top=top), "a bigint, b bigint, low double, high double")

    by_high = Window.partitionBy("a").orderBy("high")
    # what hashing finds bounds the angle of the k-th nearest, so that the comparison tells what lies within only
    first = met(range(lsh.tables), asked.withColumn("kth", F.lit(None).cast("double")))
    bounds, _ = shelf.put(first.groupBy("a", "b").agg(F.min("high").alias("high")).withColumn("n", F.row_number().over(by_high)).where(F.col("n") == k).select(F.col("a").alias("h"), F.col("high").alias("kth")))
    near, _ = shelf.put(compared(asked.join(bounds, "h", "left")))
    once = near.groupBy("a", "b").agg(F.max("low").alias("low"), F.min("high").alias("high")).withColumn("n", F.row_number().over(by_high))
    kth = F.max(F.when(F.col("n") <= k, F.col("high"))).over(Window.partitionBy("a"))
    best, _ = shelf.put(once.withColumn("kth", kth).where(F.col("low") <= F.col("kth")).select("a", "b"))
    named, _ = shelf.put(best.select(F.col("b").alias("h")).distinct())
    left = asked.dropDuplicates(["id"]).select(F.col("h").alias("a"), F.col("id").alias("id_a"), F.col("unit").alias("unit_a"))
    right = own.join(named, "h", "left_semi").dropDuplicates(["id"]).select(F.col("h").alias("b"), F.col("id").alias("id_b"), F.col("unit").alias("unit_b"))
    both = best.join(left, "a").join(right, "b").select("id_a", "id_b", "unit_a", "unit_b")
    scored = both.mapInArrow(partial(_cosine, dim=dim), "a string, b string, cosine double").toDF("id", "neighbour", "cosine")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

"""Evaluation texts that leaked into training texts: q-gram counts in diagonal bands, verified by banded alignment.

Texts are compared as their letters and digits. By the q-gram lemma a stretch of n letters
with e edits still shares n - q + 1 - q e q-grams; these lie on neighbouring diagonals, so
they are counted in bands that overlap by half. Bands with enough of them are aligned,
with whole words at both ends of the document's stretch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.tables import Shelf

#: Characters of evaluation texts that are sent to every worker at once; more go in blocks.
BLOCK_CHARS = 8_000_000
#: Characters of documents whose q-grams are looked up together.
CHUNK = 2_000_000
#: Odd multiplier of the hash (fixed value).
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """A leak: at least ``words`` consecutive words of an item with at most ``edits`` edits of letters in them."""

    words: int = 20
    edits: int = 1
    q: int = 12


def _plain(c: str) -> str:
    """A character as its plain small letters and digits; '' if it only marks or joins, a blank if it is anything else."""
    flat = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", c).casefold())
    return "".join(x for x in flat if x.isalnum()) or ("" if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else " ")


class _Fold:
    """``_plain`` of all characters as tables, filled in when a character is first met."""

    def __init__(self) -> None:
        self.first = np.zeros(0x110000, np.uint32)
        self.size = np.full(0x110000, 255, np.uint8)
        self.rest: dict[int, list[int]] = {}

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The plain letters and blanks of code points, and how many each gave."""
        size = self.size[codes]
        if (size == 255).any():
            for c in np.unique(codes[size == 255]).tolist():
                plain = [ord(x) for x in _plain(chr(c))]
                self.size[c], self.rest[c] = len(plain), plain[1:]
                self.first[c] = plain[0] if plain else 0
            size = self.size[codes]
        kept = size > 0
        out = self.first[codes][kept]
        many = np.flatnonzero(size > 1)
        if len(many):
            more = [x for c in codes[many].tolist() for x in self.rest[c]]
            out = np.insert(out, np.repeat(np.cumsum(kept)[many], size[many] - 1), np.array(more, np.uint32))
        return out, size


_FOLD = _Fold()


def words(text: str) -> list[str]:
    """The words of a text: stretches of letters and digits, without case, accents and signs."""
    return _FOLD(_codes(text))[0].tobytes().decode("utf-32-le", "surrogatepass").split()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram that begins at each place, put together from those of half its length."""

    def joined(a: np.ndarray, b: np.ndarray, off: int) -> np.ndarray:
        n = len(b) - off
        h = a[:n] * MULTIPLIER
        h ^= h >> np.uint64(29)
        h += b[off:]
        h *= MULTIPLIER
        return h

    if len(codes) < q:
        return np.zeros(0, np.uint64)
    power, size, whole, done = codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if q & size:
            whole, done = (power, size) if whole is None else (joined(whole, power, done), done + size)
        if done == q:
            return whole ^ (whole >> np.uint64(31))
        power, size = joined(power, power, size), 2 * size


class Items:
    """The q-grams of a block of evaluation texts, and where their words begin."""

    def __init__(self, items: tuple[tuple[int, str], ...], rule: Rule):
        self.ids, starts, ends, text, at, least, self.item_at = [], [], [], [], 0, None, []
        for i, t in items:
            w = words(t)
            if len(w) < rule.words:
                continue
            sizes = np.cumsum([0, *map(len, w)])
            self.ids.append(i)
            self.item_at.append(at)
            starts.append(at + sizes[:-1])
            ends.append(at + sizes[1:])
            short = int((sizes[rule.words :] - sizes[: -rule.words]).min())
            least = short if least is None else min(least, short)
            text.append("".join(w) + "\0")
            at += int(sizes[-1]) + 1
        self.codes = _codes("".join(text))
        self.window = least or 0
        self.item_at = np.array(self.item_at, np.int64)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        # the q-gram lemma: a window with e edits still shares so many q-grams
        self.q = max(2, min(rule.q, self.window // (rule.edits + 1) - 1)) if self.window else rule.q
        self.need = self.window - self.q + 1 - self.q * rule.edits
        grams = _grams(self.codes, self.q)
        inside = np.ones(len(grams), bool)
        for z in np.flatnonzero(self.codes == 0):
            inside[max(0, z - self.q + 1) : z + 1] = False
        place = np.flatnonzero(inside)
        order = np.argsort(grams[place], kind="stable")
        self.place = place[order]
        self.grams, self.first, self.count = np.unique(grams[place][order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def words(self, item: int) -> tuple[int, int]:
        """The first word of an item, and the first of the next."""
        until = self.item_at[item + 1] if item + 1 < len(self.item_at) else len(self.codes)
        return int(np.searchsorted(self.starts, self.item_at[item])), int(np.searchsorted(self.starts, until))

    def windows(self, item: int, shared: np.ndarray, rule: Rule) -> list[tuple[int, int, bool]]:
        """``(from, to, whole)`` of the least runs that share enough q-grams, those with most first; whole: all of them."""
        first, until = self.words(item)
        a0, a1 = self.starts[first : until - rule.words + 1], self.ends[first + rule.words - 1 : until]
        n = np.searchsorted(shared, a1 - self.q, side="right") - np.searchsorted(shared, a0)
        lack = a1 - a0 - self.q + 1 - n
        some = np.flatnonzero(lack <= self.q * rule.edits)
        some = some[np.argsort(lack[some], kind="stable")]
        return [(int(a0[i]), int(a1[i]), bool(lack[i] <= 0)) for i in some]


def _regions(items: Items, hits: np.ndarray, which: np.ndarray, ends: np.ndarray, rule: Rule) -> list[tuple[int, int, int, int, np.ndarray]]:
    """``(doc, item, diagonal, width, shared)`` of bands that share enough q-grams within a window.

    ``shared``: where in the item the shared q-grams stand.
    ``hits``: places in the chunk whose q-gram ``which`` some item has; ``ends``: where
    the documents of the chunk end. Bands overlap by half, so any run of hits whose
    diagonals differ by at most ``edits`` lies whole in one of them.
    """
    span = items.window - items.q + rule.edits
    # places with enough hits of any item nearby come first: most documents end here
    distinct = len(hits)
    if distinct < items.need:
        return []
    reach = hits[items.need - 1 :] - hits[: distinct - items.need + 1] <= span
    near = np.zeros(distinct + 1, np.int64)
    at = np.flatnonzero(reach)
    np.add.at(near, at, 1)
    np.add.at(near, at + items.need, -1)
    live = np.cumsum(near[:-1]) > 0
    hits, which = hits[live], which[live]
    reps = items.count[which]
    p = np.repeat(hits, reps)
    offset = np.arange(len(p)) - np.repeat(np.cumsum(reps) - reps, reps)
    s = items.place[np.repeat(items.first[which], reps) + offset]
    step = max(1, rule.edits)
    width = 2 * step
    found = []
    for shift in (0, step):
        band = (p - s + shift) // width
        # bands that can't have enough, by the number of hits that share their hash, aren't sorted
        mixed = ((band.astype(np.uint64) * MULTIPLIER) >> np.uint64(44)).astype(np.int64)
        some = np.flatnonzero(np.bincount(mixed, minlength=1 << 20)[mixed] >= items.need)
        x, y, b = p[some], s[some], band[some]
        i = np.searchsorted(items.item_at, y, side="right") - 1
        # places come in order, and with them documents, so a stable order of bands and items does
        order = np.argsort(b * len(items.item_at) + i, kind="stable")
        i, b, x, y = i[order], b[order], x[order], y[order]
        d = np.searchsorted(ends, x, side="right")
        if not len(x):
            continue
        new = np.r_[True, (b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (d[1:] != d[:-1])]
        group = np.cumsum(new) - 1
        # within a band a place in the document counts once
        once = new | np.r_[True, x[1:] != x[:-1]]
        place, of = x[once], group[once]
        n = len(place) - items.need + 1
        if n <= 0:
            continue
        last = items.need - 1
        full = np.unique(of[:n][(of[last:] == of[:n]) & (place[last:] - place[:n] <= span)])
        first = np.flatnonzero(new)
        until = np.r_[first[1:], len(x)]
        for g in full.tolist():
            at = first[g]
            found.append((int(d[at]), int(i[at]), int(b[at]) * width - shift, width, np.unique(y[at : until[g]])))
    return found


def _aligned(items: Items, text: Text, jobs: list[tuple[int, int, int, int, int, int]], edits: int) -> np.ndarray:
    """The least edits of an alignment of each job, one more than allowed if there is none.

    A job is ``(from, to, low, width, lo, hi)``: letters of the items, the band's diagonals,
    and the letters of the document. The document's stretch begins where a word does and
    ends where one does. Only cells within ``edits`` of the band are reckoned, for all jobs at once.
    """
    a0, a1, low, width, lo, hi = np.array(jobs, np.int64).T
    k = np.arange(int(width.max()) + 2 * edits)
    far = edits + 1
    base = a0 + low - edits
    size = a1 - a0
    last = len(text.codes)

    def boundaries(row: int) -> tuple[np.ndarray, np.ndarray]:
        at = base[:, None] + row + k[None, :]
        return at, (at >= lo[:, None]) & (at <= hi[:, None]) & (k[None, :] < (width + 2 * edits)[:, None])

    at, inside = boundaries(0)
    cost = np.where(inside & (at < hi[:, None]) & text.starts[np.clip(at, 0, last - 1)], 0, far)
    best = np.full(len(jobs), far)
    for row in range(1, int(size.max()) + 1):
        live = row <= size
        at, inside = boundaries(row)
        letter = items.codes[np.minimum(a0 + row - 1, len(items.codes) - 1)]
        before = np.clip(at - 1, 0, last - 1)
        new = np.where(at > lo[:, None], cost + (text.codes[before] != letter[:, None]), far)
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        new[~inside] = far
        for j in range(1, len(k)):
            new[:, j] = np.minimum(new[:, j], new[:, j - 1] + 1)
        new = np.where(inside, np.minimum(new, far), far)
        cost = np.where(live[:, None], new, cost)
        over = size == row
        if over.any():
            best[over] = np.where(inside[over] & (at[over] > lo[over, None]) & text.ends[before[over]], new[over], far).min(axis=1)
    return best


def _longest(items: Items, text: Text, lo: int, hi: int, item: int, low: int, width: int) -> int:
    """The most consecutive words of the item that stand without edits on one of these diagonals, with whole words at both ends."""
    first, until = items.words(item)
    starts, ends = items.starts[first:until], items.ends[first:until]
    best = 0
    for diagonal in range(low, low + width):
        a0, a1 = max(int(starts[0]), lo - diagonal), min(int(ends[-1]), hi - diagonal)
        if a1 <= a0:
            continue
        same = np.r_[0, np.cumsum(items.codes[a0:a1] != text.codes[a0 + diagonal : a1 + diagonal])]
        own = np.flatnonzero((starts >= a0) & (ends <= a1))
        whole = same[ends[own] - a0] == same[starts[own] - a0]
        opens, closes = text.starts[starts[own] + diagonal], text.ends[ends[own] + diagonal - 1]
        at = -1
        for n in range(len(own)):
            if not whole[n]:
                at = -1
                continue
            if at < 0 and opens[n]:
                at = n
            if at >= 0 and closes[n]:
                best = max(best, n - at + 1)
    return best


class Text:
    """The letters of some documents one after the other, where words begin and end, and where documents end."""

    def __init__(self, texts: list[str]):
        plain, size = _FOLD(_codes("\n".join(texts)))
        letter = plain != 32
        self.codes = plain[letter]
        self.starts = np.r_[True, ~letter[:-1]][letter] if len(letter) else letter
        self.ends = np.r_[~letter[1:], True][letter] if len(letter) else letter
        until = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        until[-1] -= 1
        plainly = np.r_[0, np.cumsum(size, dtype=np.int64)][until]
        self.until = np.r_[0, np.cumsum(letter)][plainly]


@lru_cache(maxsize=4)
def _index(items: tuple[tuple[int, str], ...], rule: Rule) -> Items:
    return Items(items, rule)


def _scan(batches: Iterator[pa.RecordBatch], items: object, rule: Rule) -> Iterator[pa.RecordBatch]:
    index = _index(items.value, rule)
    for b in batches:
        out: dict[tuple[int, int], tuple[int, int]] = {}
        if len(index.ids):
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                part, ids, n = [], [], 0
                while at < len(texts) and (n < CHUNK or not part):
                    if len(texts[at]) >= rule.words:
                        part.append(texts[at])
                        ids.append(keys[at])
                        n += len(texts[at]) + 1
                    at += 1
                if part:
                    _leaks(index, Text(part), ids, rule, out)
        cols = [[k[0] for k in out], [k[1] for k in out], [v[1] for v in out.values()], [v[0] for v in out.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "words", "edits"])


def _leaks(index: Items, text: Text, ids: list[int], rule: Rule, out: dict[tuple[int, int], tuple[int, int]]) -> None:
    """Add ``(edits, words)`` of each document and item."""
    grams = _grams(text.codes, index.q)
    maybe = np.flatnonzero(index.seen[(grams >> np.uint64(44)).astype(np.int64)])
    which = np.searchsorted(index.grams, grams[maybe])
    which[which == len(index.grams)] = 0
    right = index.grams[which] == grams[maybe]
    regions = _regions(index, maybe[right], which[right], text.until, rule)
    windows = [index.windows(i, shared, rule) for _, i, _, _, shared in regions]
    # (edits, words) of each document (not id, as ids may repeat) and item
    found: dict[tuple[int, int], tuple[int, int]] = {}
    turn = 0
    while True:
        jobs, of = [], []
        for n, (d, i, low, width, _) in enumerate(regions):
            best = found.get((d, i), (rule.edits + 1, 0))[0]
            if best and turn < len(windows[n]) and (best > rule.edits or windows[n][turn][2]):
                a0, a1, _ = windows[n][turn]
                jobs.append((a0, a1, low, width, int(text.until[d - 1]) if d else 0, int(text.until[d])))
                of.append(n)
        if not jobs:
            break
        for n, edits in zip(of, _aligned(index, text, jobs, rule.edits).tolist(), strict=True):
            key = regions[n][:2]
            if edits <= rule.edits and edits < found.get(key, (rule.edits + 1, 0))[0]:
                found[key] = edits, rule.words
        turn += 1
    for d, i, low, width, _ in regions:
        if (d, i) in found and found[d, i][0] == 0:
            lo, hi = int(text.until[d - 1]) if d else 0, int(text.until[d])
            found[d, i] = 0, max(found[d, i][1], _longest(index, text, lo, hi, i, low, width))
    for (d, i), (edits, n) in found.items():
        key = ids[d], index.ids[i]
        old = out.get(key, (edits, n))
        out[key] = min(old[0], edits), n if edits < old[0] else old[1] if edits > old[0] else max(old[1], n)


def leaks(documents: DataFrame, items: DataFrame, rule: Rule | None = None) -> DataFrame:
    """``(doc_id, item_id, words, edits)``: documents that hold at least ``rule.words`` consecutive words of an item.

    ``documents`` has BIGINT ``doc_id`` and ``text``, ``items`` BIGINT ``item_id`` and
    ``text``; other columns are ignored. Case, accents, signs, and the kind and amount of
    white space don't matter. The document's stretch begins and ends with whole words;
    words within it may be joined or parted otherwise than the item's. ``edits`` is the
    least number of edits found, up to ``rule.edits``; ``words`` the longest run without
    edits, else ``rule.words``. Null, empty and blank texts, and items with fewer words,
    give no rows; each document counts for itself, so repeated texts are all reported
    (rows that repeat an id within a batch are one).

    One narrow pass over the documents, whole texts, no shuffle. The items are the stated
    query set: their number of characters is looked up first. Up to ``BLOCK_CHARS`` go to
    the workers at once; more go in blocks, one pass over the documents each, whose rows
    are written before the next block is read, so that the driver never holds two.
    """
    rule = rule or Rule()
    spark = documents.sparkSession
    asked = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    chars = asked.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-2 * chars // BLOCK_CHARS) if chars > BLOCK_CHARS else 1
    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def scanned(own: DataFrame) -> tuple[DataFrame, object]:
        sent = spark.sparkContext.broadcast(tuple(sorted((r["item_id"], r["text"]) for r in own.toLocalIterator())))
        return rows.mapInArrow(partial(_scan, items=sent, rule=rule), "doc_id bigint, item_id bigint, words bigint, edits bigint"), sent

    if blocks == 1:
        return scanned(asked)[0]
    shelf, found = Shelf(spark, "leaks"), None
    for n in range(blocks):
        own, sent = scanned(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n))
        one, _ = shelf.put(own)
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    return found

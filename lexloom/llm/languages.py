"""Languages of documents and of segments of mixed ones: nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes by which a label names one of the languages (fixed values).
NAMES = {"it": ("it", "ita"), "en": ("en", "eng"), "fr": ("fr", "fra", "fre"), "de": ("de", "deu", "ger"), "es": ("es", "spa")}
LANGUAGES = tuple(NAMES)
#: Buckets of hashed n-grams, a power of two.
BUCKETS = 1 << 16
#: Letters reckoned together in one block.
CHUNK = 1_000_000


@dataclass(frozen=True)
class Fit:
    """Bounds of the labelled sample the centroids come from, and how they are found.

    at most ``sample`` documents a language, by the hash of their id, of ``shortest`` to
    ``longest`` characters; ``centroids`` a language; ``rounds`` of leaving out units
    that lie nearer to another language than the one on their label.
    """

    sample: int = 300
    shortest: int = 200
    longest: int = 6000
    centroids: int = 3
    rounds: int = 3
    seed: int = 5


@dataclass(frozen=True)
class Rule:
    """``passage``: least characters of a segment that counts by itself; ``document``: least of a text that has a language;
    ``turn``: what a change of language must gain, in letters times cosine; ``unit``: most characters of a unit without a boundary."""

    passage: int = 100
    document: int = 60
    turn: float = 4.0
    unit: int = 240


@dataclass(frozen=True)
class Model:
    """Weights (bucket x centroid: IDF times centroid), squared IDF, language of each centroid, least cosine that is no rejection."""

    weights: np.ndarray
    idf2: np.ndarray
    owner: np.ndarray
    least: float


def label_language(label: Column) -> Column:
    """The language a label names, by its two- or three-letter code in any case, with or without a region; null for none."""
    head = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    out = F.lit(None).cast("string")
    for name, codes in NAMES.items():
        out = F.when(head.isin(*codes), name).otherwise(out)
    return out


class _Letters:
    """Letters in lower case by their code points; anything else is a blank, or nothing if it only joins or marks. Filled in when first met."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, 1, np.uint32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = self.table[codes]
        if (out == 1).any():
            for c in np.unique(codes[out == 1]).tolist():
                x = chr(c)
                self.table[c] = ord(x.lower()[0]) if x.isalpha() else 0 if unicodedata.category(x) in ("Mn", "Cf") else 32
            out = self.table[codes]
        return out


_LETTERS = _Letters()
# blanks behind or before certain signs, lines, dashes between blanks
_BOUNDARY = re.compile(r"\s(?:(?<=[.!?;:…»”/|•]\s)\s*|(?<=\n)\s*|\s*\n\s*|\s*(?=[/|•«„“])|\s*[-–—*]+\s+)")


def units(text: str, most: int) -> list[tuple[int, int]]:
    """Spans that cover the text, cut behind sentences and lines, else at blanks after ``most`` characters."""
    cuts = [0]
    for m in _BOUNDARY.finditer(text):
        if m.end() > cuts[-1]:
            cuts.append(m.end())
    if cuts[-1] < len(text):
        cuts.append(len(text))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        while b - a > 2 * most:
            at = text.rfind(" ", a + most // 2, a + most) + 1 or a + most
            out.append((a, at))
            a = at
        out.append((a, b))
    return out


def _features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter (its neighbours are letters of the part or blanks), and the part it stands in."""
    parts = [p if p.isascii() or unicodedata.is_normalized("NFC", p) else unicodedata.normalize("NFC", p) for p in parts]
    codes = _LETTERS(np.frombuffer(("\n" + "\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32))
    part = np.repeat(np.arange(len(parts) + 1), [1, *(len(p) + 1 for p in parts)]) - 1
    kept = codes > 0
    if not kept.all():
        codes, part = codes[kept], part[kept]
    at = np.flatnonzero(codes != 32)
    codes = codes.astype(np.uint64)
    h = (codes[at - 1] * np.uint64(0x9E3779B1) + codes[at] * np.uint64(0x85EBCA77) + codes[at + 1] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1), part[at]


def cosines(model: Model, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cosine of each part's TF-IDF vector with the nearest centroid of each language; the part's number of n-grams."""
    n = len(parts)
    got, sizes = np.zeros((n, len(LANGUAGES)), np.float32), np.zeros(n, np.int64)
    at = 0
    while at < n:
        end, letters = at, 0
        while end < n and (letters < CHUNK or end == at):
            letters += len(parts[end]) + 3
            end += 1
        bucket, part = _features(parts[at:end])
        m = end - at
        if len(bucket):
            size = np.bincount(part, minlength=m)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            dot = np.zeros((m, model.weights.shape[1]), np.float32)
            dot[part[first]] = np.add.reduceat(model.weights[bucket], first, axis=0)
            key = np.sort(part * BUCKETS + bucket)
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            tf = np.diff(np.r_[edge, len(key)])
            length = np.sqrt(np.bincount(key[edge] // BUCKETS, tf.astype(np.float64) ** 2 * model.idf2[key[edge] % BUCKETS], minlength=m))
            cos = dot / np.maximum(length, 1e-9)[:, None]
            for k in range(len(LANGUAGES)):
                got[at:end, k] = cos[:, model.owner == k].max(axis=1, initial=0)
            sizes[at:end] = size
        at = end
    return got, sizes


def fit(labelled: list[tuple[str, str]], how: Fit | None = None, unit: int = 240) -> Model:
    """Centroids from ``(language, text)`` pairs, some of which may be wrong or mixed."""
    how = how or Fit()
    parts, label = [], []
    for lang, text in labelled:
        for a, b in units(text, unit):
            if b - a >= 60:
                parts.append(text[a:b])
                label.append(LANGUAGES.index(lang))
    if not parts:
        return Model(np.zeros((BUCKETS, len(LANGUAGES)), np.float32), np.ones(BUCKETS), np.arange(len(LANGUAGES)), 2.0)
    label = np.array(label)
    bucket, part = _features(parts)
    key, tf = np.unique(part * BUCKETS + bucket, return_counts=True)
    row, col = key // BUCKETS, key % BUCKETS
    df = np.bincount(col, minlength=BUCKETS)
    idf = np.log((1 + len(parts)) / (1 + df)) + 1
    used = np.flatnonzero(df)
    place = np.zeros(BUCKETS, np.int64)
    place[used] = np.arange(len(used))
    value = tf * idf[col]
    value = value / np.sqrt(np.bincount(row, value**2, minlength=len(parts)))[row]
    col = place[col]

    def of(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place among ``which``, column and value of all entries of these parts."""
        place = np.full(len(parts), -1)
        place[which] = np.arange(len(which))
        own = place[row] >= 0
        return place[row[own]], col[own], value[own]

    def mean(entries: tuple[np.ndarray, np.ndarray, np.ndarray], which: np.ndarray) -> np.ndarray:
        r, k, v = entries
        keep = which[r]
        c = np.bincount(k[keep], v[keep], minlength=len(used))
        return c / max(np.linalg.norm(c), 1e-12)

    def against(entries: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, centres: list[np.ndarray]) -> np.ndarray:
        r, k, v = entries
        return np.stack([np.bincount(r, v * c[k], minlength=n) for c in centres], axis=1)

    rng = np.random.default_rng(how.seed)
    kept = np.ones(len(parts), bool)
    for _ in range(how.rounds):
        centres, owner = [], []
        for k in range(len(LANGUAGES)):
            own = np.flatnonzero(kept & (label == k))
            if not len(own):
                continue
            entries = of(own)
            some = []
            for _ in range(min(how.centroids, len(own))):
                drawn = np.zeros(len(own), bool)
                drawn[rng.choice(len(own), min(len(own), 50), replace=False)] = True
                some.append(mean(entries, drawn))
            for _ in range(4):
                near = against(entries, len(own), some).argmax(axis=1)
                some = [mean(entries, near == n) if (near == n).any() else some[n] for n in range(len(some))]
            centres += some
            owner += [k] * len(some)
        cos = against((row, col, value), len(parts), centres)
        owner = np.array(owner)
        kept = owner[cos.argmax(axis=1)] == label
    mine = owner[None, :] == label[:, None]
    own, other = np.where(mine, cos, -1).max(axis=1)[kept], np.where(mine, 0, cos).max(axis=1)[kept]
    # rejected: farther than nearly all own units are, and than units of other languages usually are
    least = min(0.6 * float(np.quantile(own, 0.01)), float(np.median(other))) if len(own) else 0.0
    weights = np.zeros((BUCKETS, len(centres)), np.float32)
    weights[used] = (np.array(centres) * idf[used]).T
    return Model(weights, idf**2, owner, max(least, 1e-6))


def segments(model: Model, rule: Rule, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """For each text ``(start, end, language, confidence)`` of its segments; language -1 where none is near."""
    spans = [units(t, rule.unit) for t in texts]
    parts = [t[a:b] for t, s in zip(texts, spans, strict=True) for a, b in s]
    cos, size = cosines(model, parts)
    none = np.full((len(parts), 1), model.least, np.float32)
    gain = np.concatenate((cos, none), axis=1) * size[:, None]
    out, at = [], 0
    for s in spans:
        g = gain[at : at + len(s)]
        best = g.argmax(axis=1)
        lively = size[at : at + len(s)] > 0
        if len(s) > 1 and (best[lively] != best[lively][:1]).any():
            best = _smooth(g, rule.turn)
        elif lively.any():
            best[:] = best[lively][0]
        runs: list[tuple[int, int, int, float]] = []
        lo = 0
        for hi in range(1, len(s) + 1):
            if hi == len(s) or best[hi] != best[lo]:
                k = int(best[lo])
                c = cos[at + lo : at + hi].T @ size[at + lo : at + hi]
                if k < len(LANGUAGES) and c[k] > 0:
                    second = max(x for n, x in enumerate(c) if n != k)
                    runs.append((s[lo][0], s[hi - 1][1], k, float(max(0.0, min(1.0, 1 - second / c[k])))))
                else:
                    runs.append((s[lo][0], s[hi - 1][1], -1, 0.0))
                lo = hi
        out.append(runs)
        at += len(s)
    return out


def _smooth(gain: np.ndarray, turn: float) -> np.ndarray:
    """The sequence of languages that gains most when each change costs ``turn``."""
    total, back = gain[0].copy(), []
    for g in gain[1:]:
        top = int(total.argmax())
        stay = total >= total[top] - turn
        back.append(np.where(stay, np.arange(len(total)), top))
        total = np.where(stay, total, total[top] - turn) + g
    path = [int(total.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def _label(batches: Iterator[pa.RecordBatch], model: object, rule: Rule, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            keys, texts, kept = (c.to_pylist() for c in b.slice(lo, 500).columns)
            rows = []
            for key, text, keep, runs in zip(keys, texts, kept, segments(m, rule, texts), strict=True):
                rows += [(key, keep, n, a, e, LANGUAGES[k] if k >= 0 else None, sure) for n, (a, e, k, sure) in enumerate(runs)]
                total: dict[int, int] = {}
                for a, e, k, _ in runs:
                    if k >= 0:
                        total[k] = total.get(k, 0) + e - a
                if total and len(text) >= rule.document:
                    main = max(total, key=lambda k: (total[k], -k))
                    rows.append((key, keep, -1, 0, len(text), LANGUAGES[main], max(s for *_, k, s in runs if k == main)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def train(documents: DataFrame, how: Fit | None = None) -> Model:
    """A model from the labelled rows of ``documents`` (``doc_id, text, lang``); the bounds of the sample are ``how``'s.

    The hashes of ids are cut into ``how.sample`` parts, and each language's least one in
    each part is taken: an aggregate of ids that combines before the shuffle, with no hot
    key; texts never move. Those ids, ``how.sample`` a language at most, then fetch their
    texts. A language none of whose texts has a length in the range is fitted on excerpts of
    ``how.longest`` characters of longer ones, or on shorter ones.
    """
    how = how or Fit()
    n = F.length("text")
    rank = F.when(n.between(how.shortest, how.longest), 0).when(n > how.longest, 1).otherwise(2)
    labelled = documents.select("doc_id", "text", label_language(F.col("lang")).alias("name")).where("name is not null and doc_id is not null and text is not null")
    code = F.xxhash64("doc_id")
    least = labelled.select("name", F.pmod(code, F.lit(how.sample)).alias("part"), F.struct(rank.alias("rank"), code.alias("code"), "doc_id").alias("at")).groupBy("name", "part").agg(F.min("at").alias("at"))
    chosen = least.select("name", "at.rank", "at.doc_id").collect()
    has = {r["name"] for r in chosen if r["rank"] == 0}
    taken = [(r["doc_id"], r["name"]) for r in chosen if r["rank"] == 0 or r["name"] not in has]
    if not taken:
        return fit([], how)
    ids = documents.sparkSession.createDataFrame(taken, f"doc_id {dict(documents.dtypes)['doc_id']}, name string")
    some = labelled.join(F.broadcast(ids), ["doc_id", "name"]).select("name", F.substring("text", 1, how.longest).alias("text"), "doc_id").dropDuplicates(["doc_id", "name"])
    return fit(sorted((r["name"], r["text"]) for r in some.collect()), how)


def label(documents: DataFrame, model: Model, rule: Rule | None = None, keep: str = "lang") -> DataFrame:
    """``(doc_id, given, segment, start, end, lang, confidence)``: segments of every text, and its main language as segment -1.

    Segments cover the whole text; ``lang`` is null where no centroid is near enough;
    ``confidence`` is how far, in relation, the next language lies behind; ``given`` is
    the column ``keep`` (null where there is none), other columns are ignored. Null and
    empty texts give no row; texts under ``rule.document`` characters have no main
    language; repeated rows give theirs again. One narrow pass without a shuffle; the
    model (about 4 MB, however large the corpus) goes to every worker.
    """
    rule = rule or Rule()
    sent = documents.sparkSession.sparkContext.broadcast(model)
    given = F.col(keep).cast("string") if keep in documents.columns else F.lit(None).cast("string")
    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", given.alias("given"))
    schema = pa.schema([("doc_id", pa.int64()), ("given", pa.string()), ("segment", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())])
    return rows.mapInArrow(partial(_label, model=sent, rule=rule, schema=schema), "doc_id bigint, given string, segment int, start bigint, `end` bigint, lang string, confidence double")

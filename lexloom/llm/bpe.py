"""Byte-pair encoding by a tokenization automaton compiled from the merges.

The automaton begins with one state and an arc for every byte. A merge of u and v at
step k puts in a gadget: the state behind u loses its arc v, and each state that had
arcs u and then v gets an arc uv, to a copy of the state behind v. So a state is
named by the token that led into it, and an arc (t, w) is settled by the steps at
which its parts came and went. The accepted paths are exactly the token sequences
that the merges produce, and every text has one.

The merges are compiled once, on the driver, into tables of numbers that go to every
worker: birth and parts of each state, steps at which arcs went, and the labels as a tree
of bytes. Of the table of arcs (all states times all tokens would be 2.5 billion) a worker
fills in those it meets, each settled once and then looked up.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How byte-level BPE cuts a text into words (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker remembers before it begins anew, and the longest remembered.
KEPT, KEPT_CHARS = 200_000, 64
#: Arcs a worker keeps before it begins anew: with the words, some 150 MB at most.
ARCS = 1_000_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letter = byte_letters()
        self.label = {i: bytes(letter[c] for c in t) for t, i in vocab.items() if all(c in letter for c in t)}
        self.born = {vocab[c]: -1 for c in letter if c in vocab}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        #: Arcs by the number state * size + token.
        self.size = 1 + max(vocab.values(), default=0)
        self.gone: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        for k, (a, b) in enumerate(merges):
            u, v = vocab[a], vocab[b]
            w = vocab[a + b]
            if w not in self.born and u in self.born and v in self.born and self._has(u, v, k):
                self.born[w], self.left[w], self.right[w] = k, u, v
            self.gone.setdefault(u * self.size + v, k)
        self.trie: dict[int, list] = {}
        for i in self.born:
            at = self.trie
            for byte in self.label[i][:-1]:
                at = at.setdefault(byte, [None, {}])[1]
            at.setdefault(self.label[i][-1], [None, {}])[0] = i

    def _has(self, t: int, w: int, step: int) -> bool:
        """Whether state t has arc w before the given step."""
        gone, born, size = self.gone, self.born, self.size
        while True:
            if gone.get(t * size + w, NEVER) < step:
                return False
            bt, bw = born[t], born[w]
            if bt < 0 and bw < 0:
                return True
            if bt > bw:
                t, step = self.right[t], bt
            else:
                w, step = self.left[w], bw + 1

    def arc(self, t: int, w: int) -> bool:
        """Whether the finished automaton has arc w from state t."""
        key = t * self.size + w
        if (has := self.arcs.get(key)) is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            has = self.arcs[key] = self._has(t, w, NEVER)
        return has

    def encode(self, word: bytes) -> list[int]:
        """Ids of the one accepted path that spells ``word``; each prefix has just one last arc."""
        n = len(word)
        last: list[int | None] = [None] * (n + 1)
        for i in range(n):
            t = last[i]
            if i and t is None:
                continue
            at, j = self.trie, i
            while j < n and (x := at.get(word[j])) is not None:
                j += 1
                if x[0] is not None and last[j] is None and (not i or self.arc(t, x[0])):
                    last[j] = x[0]
                at = x[1]
        ids, i = [], n
        while i:
            ids.append(last[i])
            i -= len(self.label[last[i]])
        return ids[::-1]

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs, one after the other."""
        return b"".join(self.label[i] for i in ids)


@lru_cache(maxsize=2)
def compiled(path: str) -> Automaton:
    """The automaton of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])


def _encode(batches: Iterator[pa.RecordBatch], rules: object) -> Iterator[pa.RecordBatch]:
    machine, find = rules.value, regex.compile(WORDS).findall
    known: dict[str, array] = {}
    for b in batches:
        flat, ends = array("i"), [0]
        for text in b.column(1).to_pylist():
            for word in find(text) if text else ():
                ids = known.get(word)
                if ids is None:
                    ids = array("i", machine.encode(word.encode("utf-8")))
                    if len(word) <= KEPT_CHARS:
                        if len(known) >= KEPT:
                            known.clear()
                        known[word] = ids
                flat.extend(ids)
            ends.append(len(flat))
        values = pa.array(np.frombuffer(flat, dtype=np.int32)) if flat else pa.array([], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["key", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], rules: object) -> Iterator[pa.RecordBatch]:
    machine = rules.value
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else machine.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())], ["key", "text"])


def encode(documents: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``(key, ids)``: the ids of every text by the byte-level BPE file at ``path``, without special tokens.

    Null and empty texts give an empty list; white space and all other characters are
    encoded as they stand; repeated rows give their rows again; other columns are
    ignored. A narrow pass without any shuffle: the compiled automaton (some 4 MB) goes to
    the workers once, which remember the ids of words.
    """
    rules = documents.sparkSession.sparkContext.broadcast(compiled(path))
    rows = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_encode, rules=rules), "key bigint, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """``(key, text)`` of lists of ids; a null list gives null, an empty one ''."""
    rules = encoded.sparkSession.sparkContext.broadcast(compiled(path))
    rows = encoded.select(F.col(key).cast("bigint").alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(partial(_decode, rules=rules), "key bigint, text string").withColumnRenamed("key", key)

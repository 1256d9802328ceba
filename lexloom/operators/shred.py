"""Deeply nested records to related flat tables, by columnar shredding.

A record becomes columns, one for each leaf path: repetition levels, which all leaves of
one repeated ancestor (path of keys down to a list) share, definition levels of its own,
and values. A leaf's definition level tells apart where it ends: at an object above it
that isn't there, at the object itself (the key is absent), at the key (it is null), or
at a value. The tables, one for each repeated ancestor, are then put together from the
level sequences alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records shredded together.
GROUP = 512


class _Field:
    """A place in the schema of a record: below a key, or an element of a list."""

    __slots__ = ("below", "d", "item", "keys", "label", "r", "table")

    def __init__(self, label: tuple, r: int, d: int):
        self.label, self.r, self.d = label, r, d
        self.keys: dict[str, _Field] = {}
        self.item: _Field | None = None
        self.table: _Table | None = None
        self.below: list[_Table] = []


class _Leaf:
    """Definition levels and values of one leaf path where they go beyond those of its ancestor, and where that is."""

    __slots__ = ("at", "levels_d", "values")

    def __init__(self) -> None:
        self.at: list[int] = []
        self.levels_d: list[int] = []
        self.values: list[str | None] = []

    def add(self, at: int, d: int, value: str | None) -> None:
        self.at.append(at)
        self.levels_d.append(d)
        self.values.append(value)


class _Table:
    """Columns of one repeated ancestor: who, repetition level, definition level down to its objects, leaves."""

    __slots__ = ("d", "leaves", "levels_d", "levels_r", "who")

    def __init__(self, d: int, leaves: tuple[str, ...]):
        self.d = d
        self.who: list[int] = []
        self.levels_r: list[int] = []
        self.levels_d: list[int] = []
        self.leaves: dict[tuple[str, ...], _Leaf] = {(k,): _Leaf() for k in leaves}


class Shredder:
    """Shreds records whose repeated fields of interest have the names ``lists``.

    A single object in place of such a list counts as a list of one; below a key in
    ``as_text`` JSON text counts as the object it encodes. ``leaves`` are the keys of these
    lists' objects that become columns; if none are named, all paths down to a value do
    that meet no list of interest. Other lists are values, as JSON.
    """

    def __init__(self, lists: tuple[str, ...], leaves: tuple[str, ...] = (), as_text: tuple[str, ...] = ()):
        self.lists, self.leaves, self.as_text = frozenset(lists), leaves, frozenset(as_text)
        self.tables: dict[tuple, _Table] = {}

    def schema(self, record: dict) -> _Field:
        """The schema of one record; lists of one and objects in text are written out in place."""
        root = _Field((), 0, 0)
        order, stack = [root], [(record, root, "")]
        while stack:
            value, at, key = stack.pop()
            if isinstance(value, dict):
                for k, v in value.items():
                    if k in self.as_text and isinstance(v, str):
                        v = value[k] = decode(v)
                    if k in self.lists and isinstance(v, dict):
                        v = value[k] = [v]
                    if isinstance(v, dict | list):
                        if k not in at.keys:
                            at.keys[k] = _Field((*at.label, k), at.r, at.d + 1)
                            order.append(at.keys[k])
                        stack.append((v, at.keys[k], k))
            else:
                for v in value:
                    if at.item is None and (key in self.lists or isinstance(v, dict | list)):
                        at.item = _Field((*at.label, None), at.r + 1, at.d + 1)
                        order.append(at.item)
                        if key in self.lists:
                            at.item.table = self.tables.get(at.item.label) or self.tables.setdefault(at.item.label, _Table(at.item.d, self.leaves))
                    if isinstance(v, dict | list):
                        stack.append((v, at.item, ""))
        for f in reversed(order):
            f.below = [*([f.table] if f.table else []), *(t for x in (*f.keys.values(), *([f.item] if f.item else [])) for t in x.below)]
        return root

    def add(self, who: int, record: dict) -> None:
        """Append the level sequences of one record."""

        def absent(tables: list[_Table], r: int, d: int) -> None:
            for t in tables:
                t.who.append(who)
                t.levels_r.append(r)
                t.levels_d.append(d)

        stack = [(False, record, self.schema(record), 0, 0)]
        while stack:
            element, value, f, r, d = stack.pop()
            held = isinstance(value, dict | list)
            if element:
                if t := f.table:
                    own = isinstance(value, dict)
                    t.who.append(who)
                    t.levels_r.append(r)
                    t.levels_d.append(d + own)
                    if own:
                        self.leaf_levels(t, value)
                d += held
            if isinstance(value, dict):
                for k, x in f.keys.items():
                    if x.below:
                        v = value.get(k)
                        if isinstance(v, dict | list):
                            stack.append((False, v, x, r, d + 1))
                        else:
                            absent(x.below, r, d)
            else:
                for x in f.keys.values():
                    absent(x.below, r, d)
            if (x := f.item) is not None and x.below:
                if isinstance(value, list) and value:
                    stack.extend((True, value[i], x, x.r if i else r, d) for i in range(len(value) - 1, -1, -1))
                else:
                    absent(x.below, r, d)

    def leaf_levels(self, t: _Table, value: dict) -> None:
        """Append the levels of the leaves of one object: one more than the object's for each key on the way, one more for a value."""
        at = len(t.who) - 1
        if self.leaves:
            for k in self.leaves:
                if k in value:
                    v = value[k]
                    t.leaves[k,].add(at, t.d + 1 + (v is not None), scalar(v))
            return
        stack: list[tuple[tuple[str, ...], object]] = [((k,), v) for k, v in value.items() if k not in self.lists]
        while stack:
            path, v = stack.pop()
            if isinstance(v, dict) and v:
                stack.extend(((*path, k), x) for k, x in v.items() if k not in self.lists)
            else:
                if path not in t.leaves:
                    t.leaves[path] = _Leaf()
                t.leaves[path].add(at, t.d + len(path) + (v is not None), scalar(v))

    def assemble(self, label: tuple) -> Iterator[tuple[int, str, str, dict[tuple[str, ...], str | None]]]:
        """``(who, path, parent_path, leaves)`` of each object in one table, from its level sequences.

        ``leaves`` has a value or null for each leaf path that the object has, none for those
        that are absent. The position at level k counts the entries that repeat at k since the last one
        that repeats below k; an entry is an object if it is defined to the full depth.
        """
        t = self.tables[label]
        r = np.asarray(t.levels_r)
        depth = sum(x is None for x in label)
        at = np.arange(len(r))
        index = np.zeros((len(r), depth), np.int64)
        for k in np.unique(r[r > 0]).tolist():
            n = np.cumsum(r == k)
            index[:, k - 1] = n - n[np.maximum.accumulate(np.where(r < k, at, 0))]
        given: dict[int, dict] = {}
        for path, leaf in t.leaves.items():
            for i, d, v in zip(leaf.at, leaf.levels_d, leaf.values, strict=True):
                # a level below the key's own would be an absent one
                if d >= t.d + len(path):
                    given.setdefault(i, {})[path] = v
        whole, parent, parent_depth = _templates(label, self.lists)
        for i in np.flatnonzero(np.asarray(t.levels_d) == t.d).tolist():
            row = tuple(index[i].tolist())
            yield t.who[i], whole % row, parent % row[:parent_depth], given.get(i, {})


def _templates(label: tuple, lists: frozenset) -> tuple[str, str, int]:
    """Path with a place for each position, the same of the nearest enclosing element of a named list, and its places."""
    parts: list[str] = []
    within, depth, places, last = 0, 0, 0, None
    for n, x in enumerate(label):
        if x is None:
            parts.append("[%d]")
            places += 1
            if last in lists and n < len(label) - 1 and label[n + 1] is not None:  # an object stands there
                within, depth = len(parts), places
            last = None
        else:
            parts.append(("." if parts else "") + x.replace("%", "%%"))
            last = x
    return "".join(parts), "".join(parts[:within]), depth


def scalar(v: object) -> str | None:
    """A leaf as text: strings as they are, numbers as written, booleans and nested values as JSON."""
    if v is None or isinstance(v, str):
        return v
    try:
        return json.dumps(v, ensure_ascii=False)
    except RecursionError:
        return _written(v)


def _written(v: object) -> str:
    """JSON of a value of any depth."""
    out: list[str] = []
    stack: list[tuple[bool, object]] = [(False, v)]
    while stack:
        plain, x = stack.pop()
        if plain or not isinstance(x, dict | list):
            out.append(x if plain else json.dumps(x, ensure_ascii=False))
            continue
        own = isinstance(x, dict)
        parts: list[tuple[bool, object]] = [(True, "{" if own else "[")]
        for n, e in enumerate(x):
            parts += [(True, (", " if n else "") + (json.dumps(e, ensure_ascii=False) + ": " if own else "")), (False, x[e] if own else e)]
        stack.extend(reversed([*parts, (True, "}" if own else "]")]))
    return "".join(out)


def _refuse(x: str) -> None:
    raise ValueError(f"{x} is not JSON")


_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")
_BLANK = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None}


def _deep(text: str) -> object:
    """JSON of any depth, read with a stack; numbers as they are written."""
    blank = lambda i: _BLANK.match(text, i).end()
    open_: list[dict | list] = []
    keys: list[str | None] = []
    i = blank(0)
    while True:
        # a value begins at i
        c = text[i : i + 1]
        if c in ("{", "["):
            value: object = {} if c == "{" else []
            open_.append(value)
            keys.append(None)
            i = blank(i + 1)
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    keys[-1], i = _key(text, i)
                continue
        elif c == '"':
            value, i = scanstring(text, i + 1)
        elif m := _NUMBER.match(text, i):
            value, i = m[0], m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, i)), None)
            if word is None:
                raise ValueError(f"no value at {i}")
            value, i = _WORDS[word], i + len(word)
        # a value has ended, or an empty object or list is to be closed
        while True:
            i = blank(i)
            if open_ and value is not open_[-1]:
                holder = open_[-1]
                if isinstance(holder, dict):
                    holder[keys[-1]] = value
                else:
                    holder.append(value)
                if text[i : i + 1] == ",":
                    i = blank(i + 1)
                    if isinstance(holder, dict):
                        keys[-1], i = _key(text, i)
                    break
            if not open_:
                if i != len(text):
                    raise ValueError(f"more at {i}")
                return value
            if text[i : i + 1] != ("}" if isinstance(open_[-1], dict) else "]"):
                raise ValueError(f"not closed at {i}")
            value, i = open_.pop(), i + 1
            keys.pop()


def _key(text: str, i: int) -> tuple[str, int]:
    """The key at i, and where its value begins."""
    if text[i : i + 1] != '"':
        raise ValueError(f"no key at {i}")
    key, i = scanstring(text, i + 1)
    i = _BLANK.match(text, i).end()
    if text[i : i + 1] != ":":
        raise ValueError(f"no colon at {i}")
    return key, _BLANK.match(text, i + 1).end()


def decode(text: str) -> dict | str:
    """The object that ``text`` encodes, however deep it is nested; the text itself if it encodes none.

    Numbers stay as they are written. NaN and Infinity aren't JSON.
    """
    try:
        v = json.loads(text, parse_int=str, parse_float=str, parse_constant=_refuse)
    except ValueError:
        return text
    except RecursionError:
        try:
            v = _deep(text)
        except ValueError:
            return text
    return v if isinstance(v, dict) else text


def _fit(x: str | None) -> str | None:
    return x.encode("utf-8", "replace").decode() if isinstance(x, str) and not x.isascii() else x


def _shred(batches: Iterator[pa.RecordBatch], lists: tuple, leaves: tuple, as_text: tuple, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    named = [(k,) for k in leaves]
    for b in batches:
        for lo in range(0, b.num_rows, GROUP):
            part = b.slice(lo, GROUP)
            keys, s = part.column(0).to_pylist(), Shredder(lists, leaves, as_text)
            for who, text in enumerate(part.column(1).to_pylist()):
                if text is not None and isinstance(v := decode(text), dict):
                    s.add(who, v)
            cols: list[list] = [[] for _ in schema]
            for label in s.tables:
                ancestor = None if named else _fit(_templates(label, s.lists)[0].replace("[%d]", "[]").replace("%%", "%"))
                for who, path, parent, values in s.assemble(label):
                    more = [_fit(values.get(k)) for k in named] if named else [ancestor, [(_fit(".".join(k)), _fit(v)) for k, v in values.items()]]
                    for c, x in zip(cols, (keys[who], _fit(path), _fit(parent), *more), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _passed(records: DataFrame, key: str, payload: str, lists: tuple, leaves: tuple, as_text: tuple, more: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("path", pa.string()), ("parent_path", pa.string()), *((n, t) for n, t, _ in more)])
    out = ", ".join(["key bigint", "path string", "parent_path string", *(f"{n} {t}" for n, _, t in more)])
    rows = records.select(records[key].cast("bigint").alias("key"), records[payload].cast("string").alias("payload"))
    return rows.mapInArrow(partial(_shred, lists=lists, leaves=leaves, as_text=as_text, schema=schema), out)


def objects(records: DataFrame, key: str, payload: str, lists: tuple[str, ...], leaves: tuple[str, ...], as_text: tuple[str, ...] = ()) -> DataFrame:
    """``(key, path, parent_path, *leaves)``: a row for each object that is an element of a list named in ``lists``.

    ``records`` has a BIGINT ``key`` and the JSON text ``payload``; other columns are
    ignored. Paths are keys and zero-based positions from the top, ``parent_path`` that
    of the nearest enclosing element, '' if none. Null elements keep their position.
    Null, empty and unusable payloads, and those that aren't an object, give no rows;
    repeated records give their rows again; of repeated keys the last counts. A leaf
    that is absent or null is null. An unpaired surrogate becomes '?'. Nesting may have any
    depth; paths are as long as it is deep, so time and rows of one record grow with its square.

    One narrow pass: nothing is shuffled, and a task holds the columns of ``GROUP`` records.
    """
    shredded = _passed(records, key, payload, lists, leaves, as_text, [(f"leaf_{i}", pa.string(), "string") for i in range(len(leaves))])
    return shredded.toDF(key, "path", "parent_path", *leaves)


def related(records: DataFrame, key: str, payload: str, lists: tuple[str, ...], as_text: tuple[str, ...] = ()) -> DataFrame:
    """``(key, path, parent_path, ancestor, fields)``: as ``objects``, with all that each object holds.

    ``ancestor`` is the path without positions, as in ``nodes[].children[]``: it names the
    table that the row belongs to. ``fields`` maps each leaf path below the object, keys
    joined by '.', to its value: a key that is null is there with null, an absent one isn't.
    """
    fields = pa.map_(pa.string(), pa.string())
    return _passed(records, key, payload, lists, (), as_text, [("ancestor", pa.string(), "string"), ("fields", fields, "map<string,string>")]).withColumnRenamed("key", key)


def table_of(rows: DataFrame, ancestor: str, columns: tuple[str, ...]) -> DataFrame:
    """One table of ``related``: its key, ``path, parent_path`` and a column for each of these fields, absent or null ones null."""
    own = [c for c in rows.columns if c not in ("ancestor", "fields")]
    return rows.where(F.col("ancestor") == ancestor).select(*own, *(F.col("fields")[c].alias(c) for c in columns))

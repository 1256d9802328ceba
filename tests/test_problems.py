"""The general problems' operators against brute force and on awkward rows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators.hierarchy import descendants, hierarchy
from lexloom.operators.intervals import OPEN, merged, periods_and_gaps
from lexloom.operators.orphans import orphans, spells
from lexloom.operators.shred import _deep, decode, objects, related, scalar, table_of
from lexloom.plans.problems import LISTS


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- shredding -----------------------------------------------------------------------


def shredded(spark, *payloads):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "raw_id bigint, payload string, path string")
    return rows(objects(df, "raw_id", "payload", LISTS, ("eid", "tag_name"), ("metadata",)))


def test_shred_positions_and_parents(spark):
    doc = {"nodes": [None, {"eid": "a", "children": [{"tag_name": "p"}, None, {"metadata": {"refs": {"eid": 7}}}]}, {"eid": None, "children": None}]}
    assert shredded(spark, json.dumps(doc)) == [
        (0, "nodes[1]", "", "a", None),
        (0, "nodes[1].children[0]", "nodes[1]", None, "p"),
        (0, "nodes[1].children[2]", "nodes[1]", None, None),
        (0, "nodes[1].children[2].metadata.refs[0]", "nodes[1].children[2]", "7", None),
        (0, "nodes[2]", "", None, None),
    ]


def test_shred_metadata_as_text_and_lists_elsewhere(spark):
    doc = {"frbr": {"lifecycle": {"events": [{"eid": "e"}]}}, "nodes": {"metadata": json.dumps({"mods": [{"quoted": [{}, "text", [{"refs": [{}]}]]}]})}}
    assert [r[1] for r in shredded(spark, json.dumps(doc))] == [
        "frbr.lifecycle.events[0]",
        "nodes[0]",
        "nodes[0].metadata.mods[0]",
        "nodes[0].metadata.mods[0].quoted[0]",
        "nodes[0].metadata.mods[0].quoted[2][0].refs[0]",
    ]


def test_shred_unusable_payloads_give_no_rows(spark):
    assert shredded(spark, None, "", "[]", "3", '{"nodes": [{}]', '{"nodes": [{"eid": NaN}]}', "null", "{}", '{"nodes": []}') == []


def test_shred_of_any_depth(spark):
    for depth in (10, 5200):
        p = '{"nodes": [{"eid": "a", ' + '"children": [{' * depth + '"tag_name": "x"' + "}]" * depth + "}]}"
        got = shredded(spark, p[:-1], p + " ")
        assert len(got) == depth + 1 and {r[0] for r in got} == {1}
        assert max(r[1].count("children[0]") for r in got) == depth and [r for r in got if r[4] == "x"][0][1].count("children") == depth
    odd = '{"a": [1, -2.50e3, "x\\u00e9", true, false, null, {}, [], {"b": [ ]}], "c" : {"d":"" , "e":{ }}}'
    assert _deep(odd) == decode(odd)
    for bad in ("", "{", '{"a"}', '{"a": 1,}', "[1,]", "[1 2]", "{} x", '{"a": NaN}', '{"a": "x}', "[}", '{"a": 01}'):
        with pytest.raises(ValueError):
            _deep(bad)
    deep = {"a": []}
    for _ in range(6000):
        deep = {"a": [deep, None, "è"]}
    assert scalar(deep).count("è") == 6000


def test_shred_tables_with_absent_and_null_apart(spark):
    doc = {"nodes": [{"eid": None, "metadata": json.dumps({"a": {"b": 1.25, "c": None}, "refs": [{"href": "x"}, {"range": {"from": "1"}}]})}, {"metadata": {}, "tags": ["p", {"q": 1}]}, {}]}
    df = spark.createDataFrame([(1, json.dumps(doc), "x"), (2, None, "x"), (3, "[]", "x")], "raw_id bigint, payload string, fields string")
    got = related(df, "raw_id", "payload", LISTS, ("metadata",))
    assert sorted((r["ancestor"], r["path"], tuple(sorted(r["fields"].items()))) for r in got.collect()) == [
        ("nodes[]", "nodes[0]", (("eid", None), ("metadata.a.b", "1.25"), ("metadata.a.c", None))),
        ("nodes[]", "nodes[1]", (("metadata", "{}"), ("tags", '["p", {"q": "1"}]'))),
        ("nodes[]", "nodes[2]", ()),
        ("nodes[].metadata.refs[]", "nodes[0].metadata.refs[0]", (("href", "x"),)),
        ("nodes[].metadata.refs[]", "nodes[0].metadata.refs[1]", (("range.from", "1"),)),
    ]
    assert rows(table_of(got, "nodes[].metadata.refs[]", ("href", "range.from"))) == [(1, "nodes[0].metadata.refs[0]", "nodes[0]", "x", None), (1, "nodes[0].metadata.refs[1]", "nodes[0]", None, "1")]
    assert related(df.limit(0), "raw_id", "payload", LISTS).count() == 0


def test_shred_repeated_records_and_odd_values(spark):
    p = '{"nodes": [{"eid": true, "tag_name": {"a": 1.50}, "k%d.[x]": {"children": [{}]}}], "nodes": [{"eid": "\\ud800"}]}'
    got = shredded(spark, p, p)
    assert got == [(0, "nodes[0]", "", "?", None), (1, "nodes[0]", "", "?", None)]
    assert [r[1] for r in shredded(spark, '{"k%d": {"children": [{}]}}')] == ["k%d.children[0]"]


def test_shred_against_a_plain_walk(spark):
    rng = random.Random(1)

    def value(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.2:
            return rng.choice([None, 1, "t", True, [], {}])
        if kind < 0.6:
            return {k: value(depth + 1) for k in rng.sample([*LISTS, "metadata", "eid", "z"], rng.randint(0, 4))}
        return [value(depth + 1) for _ in range(rng.randint(0, 3))]

    want = []

    def text(v):
        return v if v is None or isinstance(v, str) else json.dumps(v)

    def walk(v, path, key, parent, i):
        if isinstance(v, dict):
            for k, x in v.items():
                at = f"{path}.{k}" if path else k
                if k in LISTS and isinstance(x, dict):
                    x = [x]
                walk(x, at, k, parent, i)
        elif isinstance(v, list):
            for n, x in enumerate(v):
                at = f"{path}[{n}]"
                own = isinstance(x, dict) and key in LISTS
                if own:
                    want.append((i, at, parent, text(x.get("eid")), text(x.get("tag_name"))))
                walk(x, at, None, at if own else parent, i)

    docs = []
    while len(docs) < 60:
        d = value(0)
        if isinstance(d, dict) and "eid" not in json.dumps(d):
            docs.append(d)
            walk(d, "", None, "", len(docs) - 1)
    assert shredded(spark, *map(json.dumps, docs)) == sorted(want, key=lambda r: r[:2])


# --- hierarchy -----------------------------------------------------------------------


def tree(spark, ids, links, paths=True):
    nodes = spark.createDataFrame([(i, "junk", "junk") for i in ids], "id string, root string, path string")
    edges = spark.createDataFrame([(c, p, "junk") for c, p in links], "child string, parent string, id string")
    return hierarchy(nodes, edges, paths)


def test_hierarchy_of_a_forest_with_cycles(spark):
    ids = [*"abcdefgh", "a", None]
    links = [("b", "a"), ("b", "a"), ("c", "b"), ("d", "e"), ("e", "d"), ("f", "e"), ("g", "g"), ("h", "missing"), ("missing", "a"), (None, "a"), ("c", None)]
    got = {r["id"]: (r["parent"], r["root"], r["depth"], r["cyclic"], r["path"]) for r in tree(spark, ids, links).collect()}
    assert got == {
        "a": (None, "a", 0, False, ["a"]),
        "b": ("a", "a", 1, False, ["a", "b"]),
        "c": ("b", "a", 2, False, ["a", "b", "c"]),
        "d": ("e", "d", None, True, None),
        "e": ("d", "d", None, True, None),
        "f": ("e", "d", None, True, None),
        "g": ("g", "g", None, True, None),
        "h": (None, "h", 0, False, ["h"]),
    }


def test_hierarchy_against_walking_up(spark):
    rng = random.Random(3)
    n = 300
    parent = {f"n{i:03}": f"n{rng.randrange(i):03}" for i in range(1, n)}
    for i in range(40):  # a long chain, then cycles of several lengths with tails
        parent[f"c{i:02}"] = f"c{i + 1:02}"
    for length in (1, 2, 3, 7):
        for i in range(length):
            parent[f"r{length}{i}"] = f"r{length}{(i + 1) % length}"
        for i in range(5):
            parent[f"t{length}{i}"] = f"t{length}{i - 1}" if i else f"r{length}0"
    ids = sorted({*parent, *parent.values()})
    want = {}
    for i in ids:
        seen, x = [i], i
        while x in parent and parent[x] not in seen:
            x = parent[x]
            seen.append(x)
        want[i] = (min(seen[seen.index(parent[x]) :]), None) if x in parent else (x, len(seen) - 1)
    got = {r["id"]: (r["root"], r["depth"]) for r in tree(spark, ids, parent.items(), False).collect()}
    assert got == want


def test_hierarchy_of_nothing(spark):
    assert tree(spark, [], []).count() == 0
    assert rows(tree(spark, ["a"], []).select("id", "depth")) == [("a", 0)]


def test_descendants(spark):
    assert rows(descendants(tree(spark, "abc", [("b", "a"), ("c", "b")]))) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


# --- intervals -----------------------------------------------------------------------


def spans(spark, *given):
    day = lambda x: x and dt.date.fromisoformat(x)
    df = spark.createDataFrame([(k, day(a), day(b), "junk") for k, a, b in given], "key string, first date, last date, salt string")
    return rows(periods_and_gaps(df))


def test_periods_and_gaps(spark):
    assert spans(
        spark,
        ("u", "2020-01-01", "2020-01-31"), ("u", "2020-02-01", "2020-02-10"), ("u", "2020-02-05", "2020-02-07"), ("u", "2020-03-01", None), ("u", "2021-01-01", "2021-02-01"),
        ("u", "2020-01-01", "2020-01-31"), ("v", "0001-01-01", "0001-01-01"), ("v", "9999-12-31", "9999-12-31"),
        ("w", None, "2020-01-01"), ("w", "2020-01-02", "2020-01-01"), (None, "2020-01-01", None), ("x", "2020-01-01", "2020-01-01"),
    ) == [
        ("u", "gap", "2020-02-11", "2020-02-29"), ("u", "period", "2020-01-01", "2020-02-10"), ("u", "period", "2020-03-01", ""),
        ("v", "gap", "0001-01-02", "9999-12-30"), ("v", "period", "0001-01-01", "0001-01-01"), ("v", "period", "9999-12-31", "9999-12-31"),
        ("x", "period", "2020-01-01", "2020-01-01"),
    ]


def test_intervals_of_nothing(spark):
    assert spans(spark) == []


def test_intervals_of_a_hot_key(spark):
    """A third of the rows on one key, many disjoint intervals: partial lists go through the intermediate level."""
    rng = random.Random(2)
    given = [("hot" if i % 3 == 0 else f"k{i % 50}", a := rng.randrange(0, 40000), a + rng.randrange(0, 3)) for i in range(9000)]
    df = spark.createDataFrame(given, "key string, first int, last int").repartition(8)
    got = {r["key"]: list(zip(r["first"], r["last"], strict=True)) for r in merged(df).collect()}
    want = {}
    for k, a, b in sorted(given):
        out = want.setdefault(k, [])
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    assert got == want
    assert max(map(len, got.values())) > 1000


def test_open_end_covers_all_later_ones(spark):
    df = spark.createDataFrame([("a", 5, None), ("a", 10, 12)], "key string, first int, last int")
    assert [(r["first"], r["last"]) for r in merged(df).collect()] == [([5], [OPEN])]


# --- orphans -------------------------------------------------------------------------


def test_orphans_at_their_own_time(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    keys = spark.createDataFrame([("a", t(5)), ("a", t(2)), ("b", t(1)), (None, t(1))], "key string, at timestamp_ntz")
    gone = spark.createDataFrame([("b", t(4)), ("b", t(9)), ("z", t(1)), (None, t(1))], "key string, at timestamp_ntz")
    refs = spark.createDataFrame(
        [(1, "s", "a", t(1)), (2, "s", "a", t(2)), (3, "s", "b", t(3)), (4, "s", "b", t(4)), (5, "s", "", t(3)), (6, "s", None, t(3)), (7, "other", "a", t(3)), (8, "s", "none", t(3)), (8, "s", "none", t(3))],
        "n int, scope string, key string, at timestamp_ntz",
    ).withColumns({"since": F.lit("junk"), "until": F.lit("junk"), "referred": F.lit("junk")})
    found = orphans(refs, spells(keys, gone, "things"), F.col("u.scope") == "s")
    assert sorted(r["n"] for r in found.collect()) == [1, 4, 5, 6, 7, 8, 8]
    assert orphans(refs.limit(0), spells(keys, gone, "things"), F.lit(True)).count() == 0
    assert orphans(refs, spells(keys.limit(0), gone, "things"), F.lit(True)).count() == 9

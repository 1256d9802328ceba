"""Nearest neighbours of rows that quantised vectors rank wrongly."""

import numpy as np
import pyarrow as pa

from lexloom.llm import neighbours


def test_nearest_in_a_dense_cluster(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=64) + rng.normal(size=(800, 64)) * 0.05).astype(np.float32)
    df = spark.createDataFrame([(f"n{i:03}", v.tolist()) for i, v in enumerate(x)], "id string, v array<float>")
    u = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"n{i:03}", f"n{j:03}") for i in range(800) for j in np.argsort(-s[i])[:5]}
    same = lambda d: {r[:2] for r in d.select("id", "neighbour").collect()}
    assert same(neighbours.similar(df, "id", "v")) == want
    few = {w for w in want if w[0].endswith("0")}
    for top in (127, 32_767):
        lsh = neighbours.Lsh(tables=8, probes=6, hashes=1, top=top)
        assert same(neighbours.search(df, df.where("id like '%0'"), "id", "v", lsh=lsh)) == few


def test_rows_beyond_change_no_answer(spark):
    """All of the nearest are found, though they lie far, and as many rows as once took another setting change nothing."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 64)) + 0.4
    far = rng.normal(size=(41_000, 64)) - 3

    def answers(x):
        table = pa.table({"id": [f"n{i:05}" for i in range(len(x))], "v": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))})
        df = spark.createDataFrame(table)
        return sorted(tuple(r) for r in neighbours.search(df, df.where("id < 'n02000' and id like '%0'"), "id", "v").select("id", "rank", "neighbour").collect())

    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = [(f"n{i:05}", n + 1, f"n{j:05}") for i in range(0, 2000, 10) for n, j in enumerate(np.argsort(-s[i])[:5])]
    assert answers(x) == want
    assert answers(np.concatenate((x, far))) == want


def test_parts_of_a_comparison(spark, monkeypatch):
    """Rows and queries in several parts, with and without a bound, give what one part gives."""
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(f"n{i:03}", v.tolist()) for i, v in enumerate(rng.normal(size=(300, 64)))], "id string, v array<double>")
    df = df.unionByName(df.limit(50))
    own = neighbours.Lsh(1, 192, 2, axes=(8, 28), top=127)
    unbound = neighbours.Lsh(1, 1, 3, top=127)
    got = []
    for side, lsh in ((1000, own), (40, own), (40, unbound)):
        monkeypatch.setattr(neighbours, "SIDE", side)
        got.append(sorted(tuple(r) for r in neighbours.search(df, df, "id", "v", lsh=lsh).select("id", "rank", "neighbour").collect()))
    assert len(got[0]) == 1500 and got[0] == got[1] == got[2]
    assert neighbours.search(df, df.limit(0), "id", "v").count() == 0
    assert neighbours.search(df.limit(3), df.limit(3), "id", "v").count() == 6

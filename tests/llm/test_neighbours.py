"""op13: recall and distances against all pairs, and the parts of the index by themselves."""

import numpy as np
import pytest

from veristrata.llm import neighbours
from veristrata.llm.queries import QUERIES


def all_pairs(rows, is_query, k=10):
    """rows: distinct (id, vector). The k nearest of each query, ties to the smaller id."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for q in np.flatnonzero([is_query(i) for i in ids]):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        order = order[order != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def recall(got, want):
    return np.mean([len({x[0] for x in got[q]} & {x[0] for x in w}) / max(1, len(w)) for q, w in want.items()])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_recalls_nine_of_ten(spark, sf):
    data = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got, want = found(QUERIES["op13_nearest_neighbours"](spark, data)), all_pairs(rows, lambda i: i % 100 == 0)
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    assert recall(got, want) >= 0.9
    true = dict(rows)
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0]))
        assert np.allclose([s for _, s in near], [np.linalg.norm(np.array(true[q], dtype=float) - np.array(true[j], dtype=float)) for j, _ in near], rtol=1e-12, atol=0)


def test_one_vector_of_a_third_of_the_rows(spark, monkeypatch):
    """Equal vectors, split over blocks and queried too, come by id; what is found is exact where one part is looked into whole."""
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    rng = np.random.default_rng(5)
    rows = [(k, [1.0, 2.0, 3.0, 4.0]) if k % 3 == 0 else (k, rng.normal(size=4).tolist()) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(neighbours.nearest(df, df.vec_id % 100 == 0))
    want = all_pairs(rows, lambda i: i % 100 == 0)
    assert got[0] == want[0] == [(3 * k, 0.0) for k in range(1, 11)]
    assert recall(got, want) >= 0.9


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [0.0, 1.0]), (3, [3.0, 1.0]), (3, [9.0, 9.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0, 2.0, 3.0]), (None, [0.0, 1.0]), (100, [0.0, 5.0]), (200, None), (300, [1e200, -1e200])]
    df = spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, embedding array<double>, part string")
    got = found(neighbours.nearest(df, df.vec_id % 100 == 0))
    assert got[0] == [(2, 0.0), (1, 1.0), (3, 3.0), (100, 4.0), (300, inf)]
    assert [x[0] for x in got[100]] == [1, 0, 2, 3, 300] and set(got) == {0, 100, 300} and len(got[300]) == 5
    assert neighbours.nearest(df.limit(0), df.vec_id % 100 == 0).collect() == []
    assert neighbours.nearest(df.where("vec_id = 0"), df.vec_id % 100 == 0).collect() == []
    assert neighbours.nearest(df.where("vec_id = 4"), df.vec_id % 100 == 0).collect() == []


def test_queries_get_ten_where_parts_are_small(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 6)) * 20
    rows = [(k, (centres[k % 40] + rng.normal(size=6) * 0.01).tolist()) for k in range(320)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(neighbours.nearest(df, df.vec_id % 10 == 0))
    assert len(got) == 32 and all(len(v) == 10 for v in got.values())


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 8)) + 8 * np.eye(8)[k] for k in range(4)])
    near = neighbours.neighbour_graph(x, 8)
    exact = [sorted(range(len(x)), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j)) for i in range(0, 800, 97)]
    assert [near[i].tolist() for i in range(0, 800, 97)] == [[j for j in e if j != i][:8] for e, i in zip(exact, range(0, 800, 97))]
    part = neighbours.balanced_parts(x, near, 4)
    assert np.bincount(part).tolist() == [200] * 4
    cut = (part[:, None] != part[near]).mean()
    assert cut < 0.05
    router = neighbours.train(x, near, part, 4)
    assert (router(x).argmax(axis=1) == part).mean() > 0.95

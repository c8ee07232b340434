import numpy as np

from postmill.llm import neighbours
from postmill.llm.neighbours import F, hilbert_keys, nearest
from postmill.llm.queries import op5_neighbours


def brute(rows, asks, k=20):
    """(query, vec) to score, and each query's list; rows of (id, vector) with unique ids."""
    table, names = np.stack([np.asarray(v, float) for _, v in rows]), np.array([i for i, _ in rows])
    lists = {}
    for i, v in rows:
        if asks(i):
            scores = (np.asarray(v, float) * table).sum(axis=1)
            order = [j for j in np.lexsort((names, -scores)) if names[j] != i][:k]
            lists[i] = [(int(names[j]), scores[j]) for j in order]
    return lists


def gathered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for found in out.values():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
    return {q: [(v, s) for _, v, s in found] for q, found in out.items()}


def recall(got, wanted):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in wanted[q]}) / len(wanted[q]) for q in wanted])


def test_every_cell_of_a_grid_is_passed_in_steps_of_one():
    for axes, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * axes), axis=-1).reshape(-1, axes)
        keys = hilbert_keys(grid, bits)
        path = grid[np.argsort(keys)]
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, wanted = gathered(op5_neighbours(spark, sf)), brute(rows, lambda i: i % 20 == 0)
    assert got.keys() == wanted.keys() and recall(got, wanted) >= 0.9
    for q in got:
        exact = dict(brute(rows, lambda i, q=q: i == q, len(rows))[q])
        assert all(abs(exact[v] - s) < 1e-12 for v, s in got[q])


def test_windows_smaller_than_the_table_keep_the_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    v = np.random.default_rng(2).standard_normal((3000, 32))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, wanted = gathered(nearest(df, F.col("id") % 100 == 0)), brute(rows, lambda i: i % 100 == 0)
    assert recall(got, wanted) >= 0.9


def test_edge_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(60)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, [nan, 1.0, 1.0]),
            (103, [1.0, inf, 0.0]), (104, [1.0, None, 2.0]), (105, [1.0]), (106, []), (107, [3.0, 2.0, 1.0]),
            (108, [-9.0, -9.0, -9.0]), (None, same), (0, same)]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<double>, id int, key string")
    fine = [(i, same) for i in range(60)] + [(107, [3.0, 2.0, 1.0]), (108, [-9.0, -9.0, -9.0])]
    got = gathered(nearest(df, F.col("id") % 4 == 0))
    assert got == brute(fine, lambda i: i % 4 == 0)
    few = gathered(nearest(df.filter("vec_id IN (1, 107)"), F.lit(True)))
    assert few == {1: [(107, 10.0)], 107: [(1, 10.0)]}
    assert nearest(df.limit(0), F.lit(True)).collect() == []

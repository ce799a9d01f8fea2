import numpy as np
import pytest

from tallygrid.llm import neighbours

SHAPE = "vec_id long, embedding array<float>, rank string, score string, dims string, shard string"


def plain(rows, asked, k=20):
    held = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        held.setdefault(i, np.array(v, np.float32).astype(np.float64))
    out = set()
    for q in sorted({i for i, _ in rows if i in held and asked(i)}):
        near = sorted((-float(np.cumsum(held[q] * v)[-1]), i) for i, v in held.items() if i != q and len(v) == len(held[q]))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(near)}
    return out


def run(spark, rows, asked, **kw):
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "a", "b", "c", "d") for i, v in rows], SHAPE)
    out = neighbours.nearest(spark, frame, frame.where(asked), **kw)
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect()}


@pytest.fixture
def rows():
    dice = np.random.default_rng(5)
    centres = dice.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * dice.uniform(0.5, 2) + dice.normal(size=8) * 0.1).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)]  # one vector again and again
    return rows


@pytest.mark.parametrize("shard_rows", [10_000, 300])
def test_factor_one_is_exact(spark, rows, shard_rows):
    assert run(spark, rows, "vec_id % 20 = 0", factor=1.0, shard_rows=shard_rows) == plain(rows, lambda i: i % 20 == 0)


def test_relaxed_search_still_finds_most(spark, rows):
    want = {(q, i) for q, _, i, _ in plain(rows, lambda i: i % 20 == 0)}
    got = {(q, i) for q, _, i, _ in run(spark, rows, "vec_id % 20 = 0", factor=1.5, shard_rows=300)}
    assert len(want & got) >= 0.9 * len(want)


def test_pruning_leaves_leaves_out(rows):
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    top = (matrix * matrix).sum(axis=1).max()
    order, nodes = neighbours.build_tree(neighbours.lifted(matrix, top), leaf=16)
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    nodes["point"] = np.where(nodes["point"] >= 0, place[nodes["point"]], -1)
    scored = {}
    for factor in (1.0, 3.0):
        search = neighbours.Search(ids[order], matrix[order], nodes, ids[:50], matrix[:50], top, 20, factor)
        search.run()
        scored[factor] = search.scored
    assert scored[3.0] < scored[1.0] < 50 * len(ids)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(20, None), (40, []), (60, [0, 0]), (80, [1, None]), (100, [nan, 1]), (120, [inf, 1]), (None, [1, 1]), (140, [1, 0]), (141, [2, 0]),
           (142, [2, 0]), (143, [0, 1, 0]), (160, [0, 2, 0]), (180, [1, 1, 1, 1])]
    got = run(spark, odd, "vec_id % 20 = 0 or vec_id is null")
    assert got == plain(odd, lambda i: i % 20 == 0)
    assert [(r, i) for q, r, i, _ in sorted(got) if q == 140] == [(1, 141), (2, 142)]
    assert run(spark, [], "vec_id % 20 = 0") == set()
    assert run(spark, [(20, [1, 0]), (20, [1, 0]), (21, [1, 0])], "vec_id = 20") == {(20, 1, 21, 1.0)}

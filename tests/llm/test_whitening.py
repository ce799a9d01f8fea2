import math

import numpy as np
import pytest

from tallygrid.llm import whitening


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<float>, n string, whitened double")


def plain(rows, components=32):
    """(vec_id, deviation) by whole numbers, and eigenvalues and projections by the library's solver in double."""
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good], object)
    n, total = len(x), x.sum(axis=0)
    deviation = [int(((n * r - total) ** 2).sum()) for r in x]
    centred = ((n * x - total) / n).astype(float)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in good], deviation, centred, values[::-1], basis[:, ::-1]


@pytest.fixture
def rows():
    dice = np.random.default_rng(4)
    mixed = dice.normal(size=(300, 40)) @ dice.normal(size=(40, 40)) * 0.3 + dice.normal(size=40)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(mixed)]
    return rows + [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [math.inf] + [0.0] * 39), (None, [0.5] * 40), (7, rows[7][1])]


def test_agrees_with_whole_numbers_and_double(spark, rows, tmp_path):
    frame = vectors_of(spark, rows)
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op13_whitening(spark, str(tmp_path)).collect()
    ids, deviation, centred, values, basis = plain(rows)
    assert len(got) == len(ids) * 32 and {r["n"] for r in got} == {len(ids)}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    assert set(by) == set(zip(ids, deviation))
    assert {r["component"] for r in got} == set(range(1, 33))
    sign = {k: np.sign(by[ids[0], deviation[0]][k][0] * (centred[0] @ basis[:, k - 1])) for k in range(1, 33)}
    for row, (name, apart) in enumerate(zip(ids, deviation)):
        for k in range(1, 33):
            want = sign[k] * (centred[row] @ basis[:, k - 1]) / math.sqrt(values[k - 1])
            assert all(abs(w - want) < 1e-9 for w in by[name, apart][k])
    for r in got[:64]:
        assert math.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rel_tol=1e-10)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def residual(matrix, values, vectors):
    wide = matrix.astype(np.longdouble) @ vectors.astype(np.longdouble) - vectors.astype(np.longdouble) * values
    return float(np.abs(wide).max() / np.abs(matrix).max()), float(np.abs(vectors.T @ vectors - np.eye(len(matrix))).max())


@pytest.mark.parametrize("spread", [
    np.linspace(1, 2, 30), 10.0 ** -np.arange(12), np.ones(10), np.repeat([3.0, 2.0, 1.0], 8), np.zeros(5),
    np.concatenate([1 + 1e-10 * np.arange(6), 2 + 1e-13 * np.arange(5), [5, 5 + 1e-7]]), np.array([7.0])])
def test_eigenvectors_to_double_precision(spread):
    size = len(spread)
    turn = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))[0]
    matrix = (turn * spread) @ turn.T * 1e5
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.eigen(matrix)
    if spread.any():
        assert max(residual(matrix, values, vectors)) < 4e-15
    assert np.all(np.diff(values) <= 0)
    # single precision alone is far off
    if size == 30:
        rough = np.linalg.eigh(matrix.astype(np.float32))[1].astype(float)
        assert residual(matrix, np.diag(rough.T @ matrix @ rough), rough)[0] > 1e-9


def test_a_cluster_is_solved_apart():
    """Eigenvalues 1e-9 apart cannot be told apart from single precision; their vectors still come out."""
    dice = np.random.default_rng(9)
    turn = np.linalg.qr(dice.normal(size=(12, 12)))[0]
    spread = np.concatenate([[1 + 1e-9, 1.0], np.linspace(2, 3, 10)])
    matrix = (turn * spread) @ turn.T
    _, vectors = whitening.eigen((matrix + matrix.T) / 2)
    apart = min(np.abs(vectors[:, -2] - s * turn[:, 0]).max() for s in (1, -1))
    assert apart < 1e-6  # the rounding of the matrix itself, over the gap


def test_edges(spark, tmp_path):
    def run(rows):
        frame = vectors_of(spark, rows)
        model = whitening.fit(spark, frame)
        return model, (whitening.whiten(frame, model).collect() if model else [])

    assert run([])[0] is None and run([(1, None), (2, []), (3, [None])])[0] is None
    model, rows = run([(1, [1.0, 2.0])])
    assert model.n == 1 and len(model.values) == 0 and [(r["vec_id"], r["deviation"], r["whitened"]) for r in rows] == [(1, 0, [])]
    model, rows = run([(1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [9.0]), (4, [1e30, 0.0]), (2, [3.0, 0.0])])
    assert model.n == 3 and len(model.values) == 1  # the second dimension does not vary; other lengths and ranges take no part
    assert sorted(r["vec_id"] for r in rows) == [1, 2, 2]
    model, rows = run([(1, [1e12, 0.0]), (2, [-1e12, 5.0]), (3, [0.0, 1.0])])
    assert model.n == 3 and [r["deviation"] for r in rows if r["vec_id"] != 3] == [None, None]
    for name, rows in (("none", []), ("one", [(1, [1.0, 2.0])])):
        vectors_of(spark, rows).write.parquet(str(tmp_path / name / "embeddings.parquet"))
        assert whitening.op13_whitening(spark, str(tmp_path / name)).count() == 0

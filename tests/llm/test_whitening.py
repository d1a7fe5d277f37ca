import numpy as np
import pytest

from isohyet.llm import whitening


def expected(vectors, components=8, weights="counts"):
    """Plain numpy over the whole fit list."""
    x = np.floor(np.array(vectors, float) * 1024).astype(int) + 100_000
    fit = x if weights == "counts" else np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1], columns[:, ::-1]
    z = (x - s / n) @ columns[:, :components] / np.sqrt(values[:components])
    return n, ((n * x - s) ** 2).sum(axis=1), z, values / values.sum()


def compare(rows, ids, vectors, components=8, weights="counts"):
    n, deviation, z, explained = expected(vectors, components, weights)
    assert len(rows) == len(ids) * min(components, z.shape[1])
    ours = np.array([[r["whitened"] for r in sorted((r for r in rows if r["vec_id"] == i), key=lambda r: r["component"])] for i in ids])
    signs = np.sign((ours * z).sum(axis=0))  # one sign a component for all rows
    np.testing.assert_allclose(ours, z * signs, atol=1e-8)
    by_id = {r["vec_id"]: r for r in rows}
    assert [by_id[i]["deviation"] for i in ids] == deviation.tolist()
    assert {r["n"] for r in rows} == {n}
    assert all(abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 for r in rows)
    (error,) = {r["identity_error"] for r in rows}
    if weights == "counts":
        assert error < 1e-9


def some(n=60, d=12, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) / 8).astype(np.float32)


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_equals_plain_numpy_with_hot_vector(spark, weights):
    vectors = some()
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 40, axis=0)])  # two rows in five are one vector
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    compare(whitening.whiten(frame, weights=weights).collect(), range(len(vectors)), vectors, weights=weights)


def test_unusable_rows_repeats_and_foreign_columns(spark):
    vectors = some(30, 3)
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(vectors)]
    odd = [(100, None, 1, 2), (101, [1.0, None, 2.0], 1, 2), (102, [1.0, float("nan"), 2.0], 1, 2), (103, [1.0, float("inf"), 2.0], 1, 2),
           (104, [], 1, 2), (105, [1.0, 2.0], 1, 2), (106, [1e30, 0.0, 0.0], 1, 2)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, x int, copies int")
    compare(whitening.whiten(frame).collect(), range(30), vectors)
    doubled = frame.unionAll(frame)
    twice = whitening.whiten(doubled).collect()
    assert len(twice) == 2 * 30 * 3 and {r["n"] for r in twice} == {60}
    unnamed = whitening.whiten(spark.createDataFrame([(None, v.tolist()) for v in vectors], SCHEMA)).collect()
    assert len(unnamed) == 90 and all(r["vec_id"] is None for r in unnamed)


def test_no_rows_no_variance_and_ties(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []
    alone = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], SCHEMA)).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in alone] == [(1, None, 0.0, None, 0), (2, None, 0.0, None, 0)]
    # two equal eigenvalues: any basis of their plane, the same for all rows
    square = [(i, [a, b, 0.0]) for i, (a, b) in enumerate([(1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0)])]
    rows = whitening.whiten(spark.createDataFrame(square, SCHEMA)).collect()
    z = {(r["vec_id"], r["component"]): r["whitened"] for r in rows}
    assert all(abs(z[i, 1] ** 2 + z[i, 2] ** 2 - 2) < 1e-9 and z[i, 3] is None for i in range(4))
    assert all(r["identity_error"] < 1e-9 for r in rows)


def test_large_entries_stay_exact(spark):
    big = [[1e15, 1.0], [-1e15, 2.0], [3.0, -4.0]]
    rows = whitening.whiten(spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None for r in rows if r["vec_id"] < 2)
    x = [[int(np.floor(c * 1024)) + 100_000 for c in v] for v in big]
    s = [sum(v[j] for v in x) for j in range(2)]
    exact = sum((3 * x[2][j] - s[j]) ** 2 for j in range(2))
    assert {r["deviation"] for r in rows if r["vec_id"] == 2} == {exact if exact < 2**63 else None}


def test_query_covers_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    from isohyet.llm.queries import QUERIES

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    compare(QUERIES["op13_whitening"](spark, sf_dir).collect(), [r["vec_id"] for r in table], [r["embedding"] for r in table])

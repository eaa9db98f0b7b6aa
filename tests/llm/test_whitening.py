import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfin.llm import whitening
from quillfin.llm.whitening import components, gridded, learn, refined, whiten


def turned(values, seed=0):
    r = np.random.default_rng(seed)
    q, _ = np.linalg.qr(r.normal(size=(len(values), len(values))))
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 9, 24),
        np.r_[np.full(6, 5.0), np.linspace(1, 2, 10)],
        np.r_[3 + 1e-9 * np.arange(5), 2 + 1e-7 * np.arange(4), 1.0],
        np.r_[1e12, 1.0, 1e-3, np.zeros(4)],
        np.r_[np.ones(5), 1 + 1e-12],
        [7.0],
    ],
)
def test_refinement_reaches_double_precision(values):
    a = turned(np.asarray(values, float), 3)
    found, x = refined(a)
    size = np.abs(a).max()
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    assert np.all(np.diff(found) <= 0)
    assert np.abs(found - want).max() <= 4e-14 * size * len(a)
    wide = x.astype(np.longdouble)
    assert np.abs(wide.T @ wide - np.eye(len(a))).max() < 1e-15
    off = wide.T @ a.astype(np.longdouble) @ wide
    assert np.abs(off - np.diag(np.diag(off))).max() < 4e-16 * size


def test_refinement_beats_its_float32_start():
    a = turned(np.linspace(1, 2, 40), 5)
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    spoilt = lambda x: np.abs((m := x.T @ a @ x) - np.diag(np.diag(m))).max()
    assert spoilt(rough) > 1e-8 and spoilt(refined(a)[1]) < 1e-15


def plain(vectors):
    """Everything by its words, in Python integers and numpy's own eigenvectors."""
    x = [tuple(int(np.floor(64 * float(v))) + 1_000_000 for v in row) for row in vectors]
    fit = np.array(sorted(set(x)), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = np.array([[(n * v - t) / n for v, t in zip(row, s)] for row in fit], float)
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    white = np.array([[(n * v - t) / n for v, t in zip(row, s)] for row in x], float) @ q / np.sqrt(e)
    return n, [sum((n * v - t) ** 2 for v, t in zip(row, s)) for row in x], white, e / e.sum()


def rows(n, d, seed=1):
    r = np.random.default_rng(seed)
    base = (r.normal(size=(n, d)) * np.linspace(0.2, 3, d)).astype(np.float32)
    base[n // 2 :] = base[: n - n // 2]  # copies
    base[: n // 3] = base[0]  # one vector with a third of the rows
    return base.tolist()


@pytest.mark.parametrize("d,parts", [(20, 5), (5, 1)])
def test_rows_agree_with_the_plain_way(spark, d, parts):
    vectors = rows(400, d)
    data = [(i, v, "clash") for i, v in enumerate(vectors)]
    data += [(1000, None, ""), (1001, [None] + vectors[0][1:], ""), (1002, [float("nan")] + vectors[0][1:], ""), (1003, [float("inf")] + vectors[0][1:], "")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, whitened string").repartition(parts)
    n, deviation, white, explained = plain(vectors)
    got = components(df).collect()
    assert len(got) == 400 * min(16, d)
    assert {g["vec_id"] for g in got} == set(range(400))
    sign = {}
    for g in got:
        i, c = g["vec_id"], g["component"] - 1
        assert g["n"] == n and g["deviation"] == deviation[i]
        assert g["explained"] == pytest.approx(explained[c], rel=1e-9)
        assert g["identity_error"] < 1e-9
        turn = sign.setdefault(c, np.sign(g["whitened"] * white[i, c]))
        assert g["whitened"] * turn == pytest.approx(white[i, c], abs=1e-9)


def test_partitions_do_not_change_the_components(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows(300, 12, 7))], "vec_id long, embedding array<float>")
    key = lambda g: (g["vec_id"], g["component"])
    a, b = (sorted(components(df.repartition(p)).collect(), key=key) for p in (1, 7))
    for x, y in zip(a, b, strict=True):
        assert x["deviation"] == y["deviation"] and x["whitened"] == pytest.approx(y["whitened"], abs=1e-11)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    empty = components(spark.createDataFrame([], schema))
    assert empty.collect() == [] and [c for c in empty.columns] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert components(spark.createDataFrame([(1, None), (2, []), (3, [float("nan")])], schema)).collect() == []
    one = components(spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert [(g["n"], g["deviation"], g["whitened"], g["explained"]) for g in one] == [(1, 0, 0.0, 0.0)] * 4
    # Another length than most is left out; a constant dimension has no variance.
    mixed = components(spark.createDataFrame([(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [1.0, 2.0, 3.0])], schema)).collect()
    assert {g["vec_id"] for g in mixed} == {1, 2}
    assert {round(abs(g["whitened"]), 9) for g in mixed if g["component"] == 1} == {1.0}
    assert {g["whitened"] for g in mixed if g["component"] == 2} == {0.0}
    assert {g["identity_error"] for g in mixed} == {1.0}


def test_huge_entries_stay_exact_or_null(spark):
    vectors = [[1e15, 0.5], [-1e30, 0.25], [3.0, 1.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    ready = gridded(df, "embedding")
    model = learn(ready)
    x = [[min(max(int(np.floor(64 * v)), -(1 << 52)), 1 << 52) + 1_000_000 for v in row] for row in vectors]
    assert model.sums == tuple(map(sum, zip(*x)))
    got = {g["vec_id"]: g for g in whiten(ready, model).collect()}
    for i, row in enumerate(x):
        assert int(got[i]["deviation"]) == sum((3 * v - s) ** 2 for v, s in zip(row, model.sums))
    # The sums nearly cancel, so the small vector's deviation fits a long; the others' don't.
    small = sum((3 * v - s) ** 2 for v, s in zip(x[2], model.sums))
    assert {g["vec_id"]: g["deviation"] for g in components(df).collect()} == {0: None, 1: None, 2: small}


def test_the_fit_table_is_deleted(spark, tmp_path):
    before = whitening.checkpoint_dir(spark)
    components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(before)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    assert not [s for s in fs.listStatus(path) if "whitening-" in s.getPath().getName()]

"""Pruned top-k against all scores: clustered and shapeless vectors, groups, ties, hot cells and empty tables."""

import numpy as np
import pytest

from quillfin.operators import maxsim, pruning

POINT = "segment_id string, chunk_id string, vectors array<array<float>>"
QUERY = "query_id string, vectors array<array<float>>"


def _points(rng, n, centres, spread, dim=16):
    middle = rng.normal(size=(centres, dim))
    rows = []
    for i in range(n):
        tokens = middle[rng.integers(centres)] + spread * rng.normal(size=(rng.integers(1, 5), dim))
        rows.append((f"p{i:05d}", f"c{i // 3}", tokens.tolist()))
    return rows, middle


def _both(spark, tmp_path, rows, queries, k, group=None, **kwargs):
    table, asked = spark.createDataFrame(rows, POINT), spark.createDataFrame(queries, QUERY)
    found = pruning.pruned_topk(pruning.write_blocks(table, str(tmp_path / "blocks"), **kwargs), asked, k, group)
    ordered = lambda df: sorted(map(tuple, df.collect()))
    assert ordered(found.result) == ordered(maxsim.maxsim_topk(table, asked, k, group))
    return found


@pytest.mark.parametrize("group", [None, "chunk_id"])
def test_clustered_vectors_leave_out_most_blocks(spark, tmp_path, group):
    rng = np.random.default_rng(3)
    rows, middle = _points(rng, 4000, 40, 0.05)
    queries = [(f"q{i}", (middle[i : i + 1] + 0.05 * rng.normal(size=(3, 16))).tolist()) for i in range(4)]
    found = _both(spark, tmp_path, rows, queries, 5, group, block_tokens=64)
    assert found.blocks > 100 and found.visited <= found.blocks / 2


def test_shapeless_vectors_ties_and_points_without_tokens(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows, _ = _points(rng, 300, 300, 1.0)
    rows += [("same0", "c2", rows[7][2]), ("same1", None, rows[9][2]), ("same2", "", rows[9][2]), ("none", "c0", []), ("null", "c0", None)]
    queries = [("q0", rng.normal(size=(2, 16)).tolist()), ("q1", rows[9][2])]
    _both(spark, tmp_path, rows, queries, 400, cells=8, block_tokens=16)
    _both(spark, tmp_path / "few", rows, queries, 3, cells=8, block_tokens=16)


def test_one_cell_and_no_rows(spark, tmp_path):
    rows = [(f"p{i:03d}", f"c{i}", [[1.0, 0.0]]) for i in range(200)]
    found = _both(spark, tmp_path / "hot", rows, [("q", [[0.5, 0.5]])], 4, block_tokens=8)
    assert found.blocks >= 25
    empty = _both(spark, tmp_path / "empty", [], [("q", [[0.5, 0.5]])], 4)
    assert (empty.blocks, empty.visited) == (0, 0)


def test_rows_that_are_not_live_only_lend_their_balls(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows, middle = _points(rng, 600, 6, 0.1)
    table, asked = spark.createDataFrame(rows, POINT), spark.createDataFrame([("q", middle[:1].tolist())], QUERY)
    odd = "cast(substring(segment_id, 2) as int) % 2 = 1"
    stored = pruning.write_blocks(table, str(tmp_path / "blocks"), block_tokens=32).selectExpr("*", f"{odd} as live")
    ordered = lambda df: sorted(map(tuple, df.collect()))
    assert ordered(pruning.pruned_topk(stored, asked, 7).result) == ordered(maxsim.maxsim_topk(table.where(odd), asked, 7))

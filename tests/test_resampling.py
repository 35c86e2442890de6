"""Bootstraps and permutations by arrays: the draws of the SQL, nulls and repeated ids, and no row for each draw."""

import hashlib

import duckdb
import pytest

from lodestar.operators import resampling
from lodestar.plans import catalog
from tests import oracle

NULLS = "SELECT i AS doc_id, CASE WHEN i % 9 = 4 THEN NULL ELSE (i * 7 % 5 < 2)::INTEGER END AS {} FROM range({}) t(i)"


def tables(folder, n):
    """Labels and lengths, some of them null, with tied scores."""
    duckdb.sql(f"COPY ({NULLS.format('quality', n)}) TO '{folder}/labels.parquet'")
    duckdb.sql(f"COPY (SELECT i AS doc_id, CASE WHEN i % 11 = 3 THEN NULL ELSE 600 + i * 37 % 800 // 50 * 50 END AS n_chars FROM range({n}) t(i)) TO '{folder}/documents.parquet'")
    return str(folder)


def check(spark, name, folder):
    got = catalog.QUERIES[name](spark, folder)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "sequence" not in plan  # rows are numbered in no single task, and no draw is a row
    oracle.same(got, catalog.SQL[name], folder)


def test_hashes_are_those_of_md5():
    for low, high in [*resampling.blocks(12), *[b for b in resampling.blocks(1_000_003)][-2:]]:
        for rep, h in zip((0, 41, 1999), resampling.hashes(low, high, [f"42:{r}:" for r in (0, 41, 1999)]), strict=True):
            assert [int(h[i - low]) for i in (low, high - 1)] == [int(hashlib.md5(f"42:{rep}:{i}".encode()).hexdigest()[:8], 16) for i in (low, high - 1)]
    assert [b for b in resampling.blocks(101)] == [(0, 10), (10, 100), (100, 101)]


def test_difference_of_areas(spark, tmp_path):
    check(spark, "bootstrap_delta_auc", tables(tmp_path, 300))


def test_permutation(spark, tmp_path):
    check(spark, "permutation_p_value", tables(tmp_path, 300))


@pytest.mark.parametrize("limit", [1, 1 << 26])
def test_permutations_in_any_order_of_rows(spark, limit, monkeypatch):
    """Rows that repeat an id are ordered by their values, however the table lies."""
    rows = [(k // 3, k % 2, k % 5 // 3) for k in range(90)]
    monkeypatch.setattr(resampling, "SORTED_BYTES", limit)
    one, two = (sorted(map(tuple, resampling.permuted(spark.createDataFrame(r, "i long, y int, p int").repartition(3), "i", "y", "p", 20).collect())) for r in (rows, rows[::-1]))
    assert one == two and [r for r, _ in one] == list(range(20)) and len({v for _, v in one}) > 3


def test_accuracy(spark, tmp_path):
    check(spark, "bootstrap_ci_accuracy", tables(tmp_path, 300))


def test_no_labels(spark, tmp_path):
    assert catalog.QUERIES["bootstrap_ci_accuracy"](spark, tables(tmp_path, 0)).first().asDict() == {"replicates": 0, "low": None, "high": None}

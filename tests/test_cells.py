"""suppressed_cells counts all embeddings."""

from lodestar.plans import catalog
from tests.oracle import same

SF = "/root/testdata/sf0.001"

#: What the query is to give, in DuckDB SQL.
WHOLE = "WITH k AS (SELECT (vec_id % 4)::INTEGER AS site, label, count(*) AS n FROM embeddings GROUP BY ALL), t AS (SELECT count(*) FILTER (WHERE n < 10) AS low, min(n) FILTER (WHERE n >= 10) AS nxt FROM k) SELECT site, label, n FROM k, t WHERE n >= 10 AND NOT (low = 1 AND n = nxt)"


def test_all_rows_are_counted(spark):
    same(catalog.QUERIES["suppressed_cells"](spark, SF), WHOLE, SF)


def cells(spark, path, counts):
    rows = [(4 * k + site, label) for (site, label), n in counts.items() for k in range(n)]
    spark.createDataFrame(rows, "vec_id long, label int").write.parquet(f"{path}/embeddings.parquet")
    return {(r.site, r.label): r.n for r in catalog.QUERIES["suppressed_cells"](spark, str(path)).collect()}


def test_small_cells_are_suppressed(spark, tmp_path):
    """A single small cell takes the smallest of the others along; of two small ones each hides the other."""
    full = {(0, 0): 40, (1, 0): 12, (2, 1): 30}
    assert cells(spark, tmp_path / "none", full) == full
    assert cells(spark, tmp_path / "one", full | {(3, 1): 9}) == {(0, 0): 40, (2, 1): 30}
    assert cells(spark, tmp_path / "two", full | {(3, 1): 9, (3, 0): 3}) == full

import datetime
import pickle

import pytest
from pyspark.sql import functions as F

from lodestar.operators import centrality, claims, governance, graph, models
from lodestar.sources import registry
from lodestar.streaming import moments

CONSENT = governance.Consent("site", "study", "consent", "v1", expires="2100-01-01")
TODAY = datetime.date(2025, 1, 1)


def gate(payload, ledger, tier="aggregate", consent=CONSENT, purpose="study"):
    return governance.check_egress(payload, tier, purpose, consent, governance.Policy(), ledger, "t", TODAY)


def test_egress_suppresses_and_records():
    ledger = governance.Ledger(b"key")
    out, manifest = gate({"n": 65, "class_n": {"a": 40, "b": 22, "rare": 3}}, ledger)
    assert out["class_n"] == {"a": 40} and out["n"] == 40 and manifest["suppressed_cells"] == 2 and ledger.verify()
    ledger.entries[0]["event"]["disclosed"]["record_count"] = 1
    assert not ledger.verify()


@pytest.mark.parametrize("change", [{"tier": "identifiable"}, {"tier": "derived"}, {"purpose": "other"}, {"consent": governance.Consent("", "study", "x", "v")}, {"consent": governance.Consent("s", "study", "x", "v", expires="2020-01-01")}, {"payload": {"n": 50, "patient_ids": [1]}}, {"payload": {"n": 3}}, {"payload": {}}])
def test_egress_fails_closed(change):
    ledger = governance.Ledger()
    with pytest.raises(governance.Refused):
        gate(change.pop("payload", {"n": 50}), ledger, **change)
    assert len(ledger.entries) == 1 and ledger.verify()


def test_sealed_contribution():
    s = governance.Sealed(lambda: {"n": 50, "mean": [1.0]})
    with pytest.raises(governance.Refused):
        pickle.dumps(s)
    assert "1.0" not in repr(s) and s.disclose("aggregate", "study", CONSENT, governance.Policy(), governance.Ledger(), "t", TODAY)[0]["n"] == 50


def test_claims():
    assert claims.permutation_gate(0.01) == "pass" and claims.split_gate(0.8, 0.5) == "fail" and claims.baseline_gate(0.03, 0.01) == "unresolved"
    assert claims.headline({"a": "pass", "b": "fail", "c": "untested"}) == "not supported: failed b"
    assert claims.headline({"a": "pass"}, leakage=True) == "possible leakage" and claims.headline({"a": "pass"}) == "supported by all gates"
    assert claims.safety_gate({"x": 3, "y": 9}, 5)["downgrade"]


def small_graph(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("c", "e")]
    return spark.createDataFrame([(x,) for x in "abcdef"], "id string"), graph.canonical(spark.createDataFrame(rows, "src string, dst string"))


def test_betweenness(spark):
    got = {r.id: r.betweenness for r in centrality.betweenness(*small_graph(spark)).collect()}
    assert got["a"] == 0 and abs(got["b"] - 2 * 3 / 20) < 1e-12 and abs(got["c"] - 2 * 5 / 20) < 1e-12 and got["f"] == 0


def test_two_cliques_are_two_communities(spark):
    rows = [(x, y) for s in ("abcd", "wxyz") for x in s for y in s if x < y] + [("d", "w")]
    v = spark.createDataFrame([(x,) for x in "abcdwxyz"], "id string")
    e = graph.canonical(spark.createDataFrame(rows, "src string, dst string"))
    got = centrality.communities(v, e)
    assert {r.id: r.community for r in got.collect()} == {x: "a" if x in "abcd" else "w" for x in "abcdwxyz"}
    assert centrality.modularity(e, got).first()[0] > 0.4


def blobs(spark, n=60):
    return spark.range(n).select("id", F.array(*((F.col("id") % 2) * 6 + F.sin(F.col("id") * k) for k in (1.0, 2.0, 3.0))).alias("v"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("c"))


@pytest.mark.parametrize("model", sorted(models.ESTIMATORS))
def test_models_on_blobs(spark, model):
    parts = models.split(blobs(spark), "id", "c")
    assert parts.filter("is_test").count() == 12
    r = models.split_row(parts, "v", "c", model).first()
    assert r.accuracy == r.roc_auc == r.average_precision == 1.0 and r.brier < 0.2 and (r.train_rows, r.test_rows) == (48, 12)


def test_split_needs_every_class(spark):
    with pytest.raises(ValueError):
        models.split(blobs(spark).withColumn("g", F.col("c")), "id", "c", test_share=0.999999, group="g")


def test_kmeans_on_blobs(spark):
    got = models.kmeans(blobs(spark), "v", 2, "id", "c").groupBy("c", "cluster").count().collect()
    assert len(got) == 2


def test_registry(spark):
    df = spark.createDataFrame([("1", "2.5", "A", "x"), ("2", "bad", "A", "y"), ("3", "4", "B", "x")], "case string, level string, hospital string, out string")
    nodes, edges, manifest = registry.adapt(df, registry.RegistryProfile("case", ("level",), "out", "shared", "hospital"))
    assert {r.ID: r.level for r in nodes.collect()} == {"1": 2.5, "2": 0.0, "3": 4.0} and manifest["n_edges"] == 1
    assert registry.adapt(df, registry.RegistryProfile("case", ("level",), k=1))[2]["edge_strategy"] == "knn"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600)).alias("ts"), (F.col("id") % 3).alias("site"), (F.col("id") * 1.5).alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = moments.windowed_moments(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "site", "v")
    q = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("windowed").collect()) == sorted(moments.windowed_moments(rows, "ts", "site", "v").collect())


def test_suppression_leaves_no_way_back():
    """Sums of hidden classes, extremes and totals go with the cells, whatever integers count them."""
    import numpy as np

    message = {"n": 65, "labeled_count": 65, "class_n": {"a": 40, "b": 22, "rare": 3}, "class_sum": {"a": [1.0], "b": [2.0], "rare": [3.0]}, "flip_min": 0.1, "flip_max": 9.0}
    for integer in (int, np.int64, np.int32):
        out, gone = governance.suppress(message | {"class_n": {k: integer(v) for k, v in message["class_n"].items()}}, 10)
        assert set(out["class_n"]) == set(out["class_sum"]) == {"a"} and out["flip_min"] is out["flip_max"] is None
        assert out["n"] == out["labeled_count"] == 40 and "class_n[rare]" in gone
    two, _ = governance.suppress({"n_scored": 30, "flip_count": 28, "runner_up_counts": {"a": 4, "b": 5, "c": 19}}, 10)
    assert two["runner_up_counts"] == {"c": 19} and two["flip_count"] == 19 and two["n_scored"] == 21
    assert governance.suppress({"n": 50, "class_n": {"a": 25, "b": 25}}, 10)[0]["n"] == 50


def test_ledger_as_a_table(spark, tmp_path):
    ledger = governance.Ledger(b"key")
    ledger.append({"a": 1}, "t0")
    ledger.append_to(spark, str(tmp_path / "ledger"))
    ledger.append({"b": [2]}, "t1")
    ledger.append_to(spark, str(tmp_path / "ledger"), since=1)
    again = governance.Ledger.read(spark, str(tmp_path / "ledger"), b"key")
    assert again.verify() and len(again.entries) == 2 and not governance.Ledger.read(spark, str(tmp_path / "ledger"), b"other").verify()
    again.entries.reverse()
    assert not again.verify()


def test_conflicts_must_be_declared():
    assert governance.Consent("s", "study", "x", "v", conflict_declared=False).problems("study")


def test_contestability_without_a_border(spark):
    """Centroids that coincide, and a single class: infinitely far, no runner-up."""
    from lodestar.operators import geometry

    rows = [(1, [0.0, 1.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 1.0], "b"), (4, [1.0, 0.0], "b")]
    for data in (rows, [r for r in rows if r[2] == "a"]):
        df = spark.createDataFrame(data, "id int, v array<double>, c string")
        got = geometry.contestability(df, "v", geometry.fit(df, "v", "c"), "id").collect()
        assert len(got) == len(data) and all(r.flip_distance == float("inf") and r.single_axis_flip == float("inf") and r.runner_up is None for r in got)
        assert geometry.contested(geometry.contestability(df, "v", geometry.fit(df, "v", "c"), "id")).filter("contested").count() == 0


def test_draws_of_large_indexes(spark):
    """Beyond what the square of an index could hold."""
    from lodestar.operators import metrics

    places = spark.range(9_999_990, 10_000_010).select(F.col("id").alias("i"))
    assert metrics.draws(places, "i", 2).count() <= 40
    assert places.select(metrics.hashed(1, F.col("i"))).distinct().count() == 20


def test_exact_quantile_by_refinement(spark):
    import numpy as np

    from lodestar.operators import metrics

    values = np.random.default_rng(3).lognormal(size=4000).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for q in (0.0, 0.1, 0.5, 0.999, 1.0):
        assert abs(metrics.exact_quantile(df, "v", q, most=50, bins=16) - np.quantile(values, q)) < 1e-9
    assert metrics.exact_quantile(df.filter("v < 0"), "v", 0.5) is None


def test_wilcoxon():
    from lodestar.operators import metrics

    assert metrics.wilcoxon([0.0, 0.0]) == 1.0
    assert abs(metrics.wilcoxon([1, 2, 3, 4, 5]) - 0.0625) < 1e-12
    assert metrics.wilcoxon([0.1] * 40) < 1e-6

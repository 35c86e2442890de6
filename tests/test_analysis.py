"""Federation, harness, audit, sources, sinks and command lines on small inputs."""

import hashlib
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import cli, sinks
from lodestar.operators import audit, federated, geometry, governance, graph, metrics, models, shaping, spectral
from lodestar.sources import config, registry, tables


def sites(spark, n=90):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, 3)) + (np.arange(n) % 3)[:, None] * [2.0, 0.0, 1.0]
    return spark.createDataFrame([(i, [*map(float, v), 7.0], "abc"[i % 3] if i % 10 else "", f"s{i % 4}") for i, v in enumerate(x)], "id int, v array<double>, c string, site string")


def test_pooled_fit_equals_the_central_one(spark):
    pooled, gaps = federated.simulate(sites(spark), "v", "c", "site")
    assert all(v < 1e-9 for v in gaps.values()) and pooled.fit.kept == [0, 1, 2] and pooled.n_total == 90
    assert sum(pooled.class_counts.values()) == 81


def test_message_order_does_not_matter(spark):
    sent = federated.messages(federated.site_aggregates(sites(spark), "v", "c", "site"))
    one, two = federated.combine_aggregates(sent), federated.combine_aggregates(sent[::-1])
    assert np.array_equal(one.fit.centroids, two.fit.centroids) and np.array_equal(one.fit.metric, two.fit.metric)


def test_pooled_contestability(spark):
    out, gaps = federated.simulate_contestability(sites(spark), "v", "c", "site")
    assert out["n_scored"] == 90 and gaps["mean"] < 1e-9 and gaps["std"] < 1e-9 and gaps["n_contested"] <= 1
    assert sum(out["runner_up_counts"].values()) == 90 and abs(sum(x["share"] for x in out["feature_voi"]) - 1) < 1e-9
    fit = federated.combine_aggregates(federated.messages(federated.site_aggregates(sites(spark), "v", "c", "site"))).fit
    fit.metric = None
    sent = [governance.suppress(m, 10)[0] for m in federated.messages(federated.site_contestability(sites(spark), "v", "c", fit, "site"))]
    assert federated.combine_contestability(sent, fit)["flip_distance"]["min"] is None


def test_balanced_sites(spark):
    got = federated.balanced_sites(spark.range(103), "id", 4).groupBy("site").count().collect()
    assert sorted(r["count"] for r in got) == [25, 26, 26, 26]


def test_mahalanobis_flip_equals_numpy(spark):
    df = sites(spark)
    rows = [r for r in df.collect() if r.c]
    f = geometry.fit(df.filter("c <> ''"), "v", "c", mahalanobis=True)
    z = (np.array([r.v for r in rows])[:, f.kept] - f.mean) / f.sd
    d = z[:, None, :] - f.centroids[None]
    d2 = np.einsum("nki,ij,nkj->nk", d, f.metric, d)
    apart = f.separation()
    got = {r.id: r.flip_distance for r in geometry.contestability(df.filter("c <> ''"), "v", f, "id").collect()}
    for r, row in zip(rows, d2, strict=True):
        a = int(row.argmin())
        assert math.isclose(got[r.id], min(max(0, (row[k] - row[a]) / (2 * apart[a, k])) for k in range(3) if k != a), rel_tol=1e-6, abs_tol=1e-9)


def blobs(spark, n=80):
    return spark.range(n).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), F.array(*((F.col("id") % 2) * (4 if k == 1.0 else 0) + F.sin(F.col("id") * (k + 0.37)) for k in (1.0, 2.0, 3.0))).alias("v"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("c"), (F.col("id") % 8).alias("g"))


def test_importance_finds_the_feature_that_tells(spark):
    parts = models.split(blobs(spark), "id", "c")
    got = {r.pos: r.importance for r in models.importance(parts, "id", "v", "c", repeats=3).collect()}
    assert got[0] > 0.2 and abs(got[1]) < 0.1 and abs(got[2]) < 0.1


def test_harness(spark):
    out = models.outcome_model(blobs(spark), "id", "v", "c", iterations=2, permutations=3, tune=True)
    s = {r.metric: r["mean"] for r in out["summary"].collect()}
    assert s["balanced_accuracy"] > 0.9 and out["params"] in models.GRIDS["logistic"] and 0 < out["cv_threshold"] < 1
    assert out["permutation"].first().p_value == 0.25 and out["learning_curve"].count() == 5
    assert models.split_comparison(blobs(spark), "id", "v", "c", "g", 2)["group"]["n"] == 2


def test_representations_on_the_same_splits(spark):
    df = blobs(spark)
    flat = df.withColumn("v", F.array(F.lit(0.0), F.col("v")[1]))
    runs = models.compare({"all": df, "noise": flat}, "id", "v", "c", iterations=3)
    table = {r.representation: r for r in models.comparison_table(runs).collect()}
    assert table["all"].roc_auc > table["noise"].roc_auc and table["all"].roc_auc_p is None and table["noise"].roc_auc_p == 0.25
    m = models.paired_margin(runs, "all", "noise").first()
    assert m.k == 3 and m.low < m["mean"] < m.high


def test_external_validation_aligns_columns(spark):
    dev = blobs(spark).select("id", "c", *(F.col("v")[i].alias(f"f{i}") for i in range(3)))
    out = models.external_validation(dev, dev.drop("f2"), "id", ["f0", "f1", "f2"], "c")
    assert out["external"]["n_external"] == 80 and out["external"]["roc_auc"] > 0.9 and set(out["drift"]) == {"balanced_accuracy_drop", "mcc_drop", "f1_weighted_drop", "roc_auc_drop"}


def test_number_of_clusters(spark):
    rows = spark.range(60).select("id", F.array((F.col("id") % 3) * 9 + F.sin("id"), (F.col("id") % 3 == 1).cast("int") * 9 + F.cos("id")).alias("v"), F.lit("").alias("c"))
    k, found = models.choose_k(rows, "v", range(2, 5), starts=2)
    assert k == 3 and found[3] > 0.6
    table, about = models.clustered(rows, "id", "v", "c", starts=2)
    assert about["k"] == 3 and sorted(about["sizes"].values()) == [20, 20, 20] and table.columns[:3] == ["ID", "outcome", "cluster"]


def test_silhouette_equals_a_plain_one(spark):
    rng = np.random.default_rng(1)
    x, c = rng.standard_normal((40, 3)), rng.integers(0, 3, 40)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(40):
        own = (c == c[i]) & (np.arange(40) != i)
        a, b = d[i][own].mean(), min(d[i][c == k].mean() for k in set(c) - {c[i]})
        s.append((b - a) / max(a, b))
    got = models.silhouette(spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, c, strict=True)], "v array<double>, c int"), "v", "c")
    assert abs(got - np.mean(s)) < 1e-9


def test_spectral_embedding_by_both_ways(spark, monkeypatch):
    rows = [(x, y) for s in ("abcde", "vwxyz") for x in s for y in s if x < y] + [("e", "v"), ("a", "m"), ("m", "n")]
    v = spark.createDataFrame([(x,) for x in "abcdemnvwxyz"], "id string")
    e = graph.canonical(spark.createDataFrame(rows, "src string, dst string"))
    one = {r.ID: r.spectral for r in spectral.embedding(v, e, 1).collect()}
    assert {one[x][0] > 0 for x in "bcd"} != {one[x][0] > 0 for x in "wxyz"}
    monkeypatch.setattr(spectral, "DENSE", 2)
    two = {r.ID: r.spectral for r in spectral.embedding(v, e, 1, rounds=25).collect()}
    a, b = (np.array([s[x][0] for x in sorted(s)]) for s in (one, two))
    assert abs(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) > 0.95


def ratings(spark, n=60):
    i = F.col("id")
    h, j = (i % 3 == 0).cast("int").cast("string"), ((i % 3 == 0) != (i % 10 == 1)).cast("int").cast("string")
    human = spark.range(n).select(F.concat(F.lit("i"), i).alias("item_id"), h.alias("human_label"), j.alias("human_label_2"), F.concat(F.lit("g"), i % 2).alias("group_a"))
    return human, spark.range(n).select(F.concat(F.lit("i"), i).alias("item_id"), j.alias("judge_label"), (0.55 + (i % 9) / 20).alias("judge_confidence"), (i % 3 + F.sin(i) / 4).alias("criterion_x"), F.cos(i).alias("criterion_y"))


def test_blinded_audit(spark):
    human, judge = ratings(spark)
    a = audit.BlindedAudit("a")
    with pytest.raises(RuntimeError):
        a.close(judge)
    seal = a.seal(human)
    assert seal == shaping.frame_digest(human.orderBy(F.desc("item_id"))).first().sha256
    out = a.close(judge, replicates=50)
    assert out["agreement"]["n_items"] == 60 and abs(out["agreement"]["raw_agreement"] - 0.9) < 1e-9 and out["agreement"]["confidence_intervals"]["raw_agreement"][0] <= 0.9
    assert out["panel"]["n_raters"] == 2 and out["panel"]["n_split"] == 6 and len(out["funnels"]) == 2 and out["criterion_contestability"]["n_disagreements"] == 6
    assert out["conformal"]["n_test"] == 30 and "Sealed labels" in audit.report(out)
    with pytest.raises(RuntimeError):
        a.seal(human)


def test_sealed_labels_must_not_change(spark):
    human, judge = ratings(spark)
    a = audit.BlindedAudit("a")
    a.seal(human)
    a.human = human.withColumn("human_label", F.lit("1"))
    with pytest.raises(RuntimeError, match="changed"):
        a.close(judge)


def test_split_half_tiers(spark):
    got = spark.createDataFrame([([1, 5, 1, 5],), ([3],), ([4, 4, 4],)], "r array<int>").select(shaping.split_half_tiers(F.col("r"), F.lit(3)).alias("t")).collect()
    order = sorted(range(4), key=lambda i: ((i + 3) * 2654435761) % 2**32)
    name = lambda m: "benign_low" if m < 2.5 else "suspicious_high" if m > 3.5 else "indeterminate"
    values = [[1, 5, 1, 5][i] for i in order]
    assert tuple(got[0].t) == (name(np.median(values[:2])), name(np.median(values[2:]))) and got[1].t is None and tuple(got[2].t) == ("suspicious_high",) * 2


def test_unreadable_file_is_an_error_row(spark, tmp_path):
    profile, error = tables.profile_file(spark, str(tmp_path / "none.csv"))
    assert profile is None and error.startswith("file not readable")
    (tmp_path / "a.csv").write_text("patient_id,x,Outcome\nP1,1.5,a\nP2,2.5,b\nP3,9.25,\n")
    profile, error = tables.profile_file(spark, str(tmp_path / "a.csv"))
    assert error is None and {r["column"]: r.looks_like_id for r in profile.collect()} == {"patient_id": True, "x": False, "Outcome": False}
    assert tables.smallest_class(spark, str(tmp_path / "a.csv"), "Outcome") == 1


def test_other_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text("LIDC-1,3\nLIDC-2,x\nother,1\n")
    assert [tuple(r) for r in tables.read_diagnosis(spark, str(tmp_path / "d.csv")).collect()] == [("LIDC-1", 3)]
    (tmp_path / "p.csv").write_text("PID,AGE\n1,60\n2,70\n")
    (tmp_path / "f.csv").write_text("pid,Size\n1,5\n1,6\n")
    got = tables.read_registry(spark, str(tmp_path / "p.csv"), str(tmp_path / "f.csv"), {"pid": "pid", "age": "age", "mm": "size"})
    assert sorted(tuple(r) for r in got.select("pid", "age", "mm").collect()) == [(1, 60, 5), (1, 60, 6)]
    nodules = tables.synthetic_nodules(spark, 50)
    assert nodules.count() == 50 and nodules.filter("brock < 0 or brock > 1 or mayo is null").count() == 0


def test_graph_modes(spark):
    nodes = spark.createDataFrame([("a", 1.0, 5.0), ("b", None, 5.0), ("c", 3.0, 5.0)], "ID string, x double, y double")
    got = {tuple(r)[:2] for r in registry.graph_edges(nodes, "ID", ["x", "y"], "similarity", 1).collect()}
    assert got == {("a", "b"), ("b", "c")} or got == {("a", "b"), ("a", "b"), ("b", "c")}
    assert registry.graph_edges(nodes, "ID", [], "none").count() == 0
    with pytest.raises(ValueError):
        registry.graph_edges(nodes, "ID", [], "other")


def test_config_names_all_problems(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("nodes: x.csv\nmodel: magic\ntest_size: 2\n")
    with pytest.raises(ValueError, match="model.*test_size"):
        config.load(str(path))
    path.write_text("nodes: x.csv\ncolour: red\n")
    with pytest.raises(ValueError, match="unknown settings: colour"):
        config.load(str(path))


def test_command_lines(spark, tmp_path):
    """From files to the contract's files."""
    tables.synthetic_nodes(spark, 80, signal=3.0).toPandas().to_csv(tmp_path / "nodes.csv", index=False)
    tables.synthetic_edges(spark, 80).toPandas().to_csv(tmp_path / "edges.csv", index=False)
    out = tmp_path / "out"
    assert cli.main(["analyse", "--nodes", f"{tmp_path}/nodes.csv", "--edges", f"{tmp_path}/edges.csv", "--output", str(out), "--path-mode", "strength", "--model", "logistic", "--iterations", "2"], spark) == 0
    names = {"node_features", "shortest_paths", "nearest_targets", "target_coverage", "node_contestability", "node_clusters", "iteration_metrics", "feature_importance", "claims.json", "provenance.json", "run_summary.json", "model_card.md", "report.html", "bundle.zip", "network.html", "environment.txt"}
    assert names <= set(os.listdir(out))
    read = lambda n: spark.read.csv(f"{out}/{n}", header=True)
    assert read("node_features").columns == ["ID", "degree", "weighted_degree", "clustering", "component_size", "is_isolate"]
    assert read("shortest_paths").columns == ["source", "target", "path_mode", "path_cost", "distance", "hops", "path_strength", "path"]
    assert read("node_contestability").columns == ["ID", "nearest_class_centroid", "runner_up_class", "flip_distance", "contested", "most_decision_relevant_feature", "single_axis_flip_distance", "dist_to_0", "dist_to_1", "outcome", "nearest_matches_outcome"]
    with open(out / "claims.json") as f:
        assert json.load(f)["headline"].startswith("untested")
    assert len(json.loads((out / "provenance.json").read_text())["inputs"]) == 2
    cli.main(["plan", "--nodes", f"{tmp_path}/nodes.csv", "--config", f"{tmp_path}/c.yaml"], spark)
    made = config.load(f"{tmp_path}/c.yaml")
    assert (made.id_column, made.outcome_column, made.feature_columns, made.model) == ("ID", "Outcome", ["Feature1", "Feature2"], "logistic")


def test_audit_command(spark, tmp_path):
    for name, df in zip(("human", "judge"), ratings(spark), strict=True):
        df.toPandas().to_csv(tmp_path / f"{name}.csv", index=False)
    cli.main(["audit", "--human", f"{tmp_path}/human.csv", "--judge", f"{tmp_path}/judge.csv", "--output", f"{tmp_path}/o", "--replicates", "20"], spark)
    with open(tmp_path / "o" / "judge_audit.json") as f:
        assert json.load(f)["agreement"]["n_items"] == 60


def test_bundle_is_the_same_for_the_same_files(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    one = sinks.file_digest(sinks.bundle(str(tmp_path)))
    assert one == sinks.file_digest(sinks.bundle(str(tmp_path)))


def test_draws_of_whole_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (4, None), (5, "c")], "v int, g string")
    got = {}
    for r in metrics.group_draws(df, "g", 20).collect():
        got.setdefault(r.rep, []).append((r.g, r.v))
    own = {"a": [1, 2], "b": [3], None: [4, 4], "c": [5]}
    order = [None, "a", "b", "c"]
    for rep in range(20):
        drawn = [order[int(hashlib.md5(f"42:{rep}:{i}".encode()).hexdigest()[:8], 16) % 4] for i in range(4)]
        assert sorted(map(str, got[rep])) == sorted(str((g, v)) for g in drawn for v in own[g])
    assert metrics.group_draws(df.limit(0), "g", 5).count() == 0

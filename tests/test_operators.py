import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.labels import is_blank
from lodestar.operators import agreement, geometry, graph, metrics, neighbours, profiles
from lodestar.sources import tables


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "src string, dst string, weight double")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_path_with_isolate(spark):
    e = edges(spark, ("A", "B", 1.0), ("B", "C", 1.0))
    v = ids(spark, "A", "B", "C", "D")
    got = {r.source: r for r in graph.path_pairs(graph.shortest_paths(e, v), v, ids(spark, "C")).collect()}
    assert (got["A"].path, got["A"].hops, got["D"].path) == ("A -> B -> C", 2, None)
    assert {r.id: r.degree for r in graph.degrees(v, graph.canonical(e)).collect()} == {"A": 1, "B": 2, "C": 1, "D": 0}


def test_strongest_path(spark):
    e = edges(spark, ("A", "T", 0.2), ("A", "B", 0.9), ("B", "T", 0.8), ("A", "C", 0.7), ("C", "T", 0.7))
    got = graph.shortest_paths(e, ids(spark, "A"), "strength").filter("target = 'T'").first()
    assert got.path == "A -> B -> T" and abs(got.path_strength - 0.72) < 1e-12


def test_coverage_and_nearest(spark):
    e = edges(spark, ("A", "B", 1.0), ("B", "T1", 1.0), ("C", "T2", 1.0))
    s = ids(spark, "A", "B", "C")
    pairs = graph.path_pairs(graph.shortest_paths(e, s), s, ids(spark, "T1", "T2"))
    got = {r.target: r for r in graph.target_coverage(pairs).collect()}
    assert (got["T1"].reachable_source_count, got["T1"].min_distance, got["T1"].mean_distance) == (2, 1, 1.5)
    assert abs(got["T1"].coverage - 2 / 3) < 1e-12 and got["T2"].reachable_source_count == 1
    assert {r.source: r.nearest_target for r in graph.nearest_target(pairs).collect()} == {"A": "T1", "B": "T1", "C": "T2"}


def test_negative_weights_are_refused(spark):
    with pytest.raises(ValueError):
        graph.shortest_paths(edges(spark, ("A", "B", -1.0)), ids(spark, "A"), "distance")


def test_last_duplicate_edge_wins(spark):
    e = spark.createDataFrame([("A", "B", 1.0, 0), ("B", "A", 5.0, 1)], "src string, dst string, weight double, row int")
    assert [tuple(r) for r in graph.canonical(e).collect()] == [("A", "B", 5.0)]
    assert graph.canonical(e, directed=True).count() == 2


def test_triangle_and_components(spark):
    e = graph.canonical(edges(spark, ("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0), ("x", "y", 1.0)))
    v = ids(spark, "a", "b", "c", "d", "x", "y", "z")
    c = {r.id: r for r in graph.clustering(v, e).collect()}
    assert (c["a"].clustering, c["d"].clustering, c["z"].triangles) == (1.0, 0.0, 0) and abs(c["c"].clustering - 1 / 3) < 1e-12
    assert {r.id: (r.component, r.component_size) for r in graph.components(v, e).collect()}["d"] == ("a", 4)
    s = graph.summary(v, e).first()
    assert (s.nodes, s.edges, s.components, s.isolates, s.max_degree) == (7, 5, 3, 1, 3)


def test_long_chain_is_one_component(spark):
    e = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    assert graph.components(spark.range(61), graph.canonical(e)).select("component").distinct().count() == 1


def test_pagerank_sums_to_one(spark):
    v = ids(spark, "a", "b", "c")
    r = {x.id: x.pagerank for x in graph.pagerank(v, edges(spark, ("a", "b", 1.0), ("b", "a", 1.0), ("a", "c", 2.0)), tolerance=1e-12).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and r["c"] > r["b"]


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], c) for i, (v, c) in enumerate(rows)], "id int, v array<double>, c string")


def test_flip_distance_closed_form(spark):
    fit = geometry.Fit([0, 1], np.zeros(2), np.ones(2), ["a", "b"], np.array([[0.0, 0.0], [4.0, 0.0]]))
    df = points(spark, [((0, 0), "a"), ((1, 0), "a"), ((2, 0), "b")])
    got = {r.id: r for r in geometry.contestability(df, "v", fit, "id").collect()}
    assert [got[i].flip_distance for i in range(3)] == [2.0, 1.0, 0.0]
    assert got[2].nearest == "a" and got[0].runner_up == "b"


def test_decisive_feature(spark):
    fit = geometry.Fit([0, 1, 2], np.zeros(3), np.ones(3), ["a", "b"], np.array([[0.0, 0, 0], [0, 6.0, 0]]))
    got = geometry.contestability(points(spark, [((0, 1, 0), "a")]), "v", fit, "id").first()
    assert got.decisive_feature == 1 and got.flip_distance == got.single_axis_flip == 2.0


def test_fit_drops_constants_and_refuses_infinity(spark):
    df = points(spark, [((0, 1), "a"), ((2, 1), "b"), ((4, 1), "b")])
    assert geometry.fit(df, "v", "c").kept == [0]
    with pytest.raises(ValueError):
        geometry.fit(points(spark, [((float("inf"), 1), "a")]), "v", "c")


def test_mahalanobis_distance(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 2)) @ np.array([[1.0, 0.6], [0.0, 0.5]])
    df = points(spark, [(tuple(v), "ab"[i % 2]) for i, v in enumerate(x)])
    fit = geometry.fit(df, "v", "c", mahalanobis=True)
    z = (x - fit.mean) / fit.sd
    want = np.sqrt(((z - fit.centroids[0]) @ fit.metric * (z - fit.centroids[0])).sum(1))
    got = {r.id: r.distances[0] for r in geometry.contestability(df, "v", fit, "id").collect()}
    assert max(abs(got[i] - want[i]) for i in range(40)) < 1e-9


def test_site_moments_merge_exactly(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 2)) + np.array([1e6, 0])
    df = points(spark, [(tuple(v), "a") for v in x]).withColumn("site", F.col("id") % 3)
    got = {r.pos: r for r in geometry.merged_moments(geometry.moments(df, "v", "site")).collect()}
    assert all(abs(got[p].sd - x[:, p].std()) < 1e-9 and abs(got[p]["mean"] - x[:, p].mean()) < 1e-6 for p in (0, 1))


def test_blank_labels(spark):
    df = spark.createDataFrame([("a",), ("",), ("nan",), (" None ",), ("b",), (None,)], "c string")
    assert [r[0] for r in df.select(is_blank(F.col("c"))).collect()] == [False, True, True, True, False, True]


def ratings(spark, a, b):
    rows = [(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    return agreement.aligned(spark.createDataFrame([(i, x) for i, x, _ in rows], "item_id int, human_label string"), spark.createDataFrame([(i, y) for i, _, y in rows], "item_id int, judge_label string"))


def test_kappa(spark):
    got = agreement.kappa(ratings(spark, "yyyyynnnnn", "yyyynnnnny")).first()
    assert (got.raw_agreement, round(got.cohens_kappa, 12)) == (0.8, 0.6)


def test_agreement_without_variation_is_null(spark):
    p = ratings(spark, "xxx", "xxx")
    assert agreement.kappa(p).first().cohens_kappa is None and agreement.alpha_two(p).first().krippendorff_alpha is None


def test_blank_ratings_are_left_out(spark):
    assert agreement.kappa(ratings(spark, ["x", "", "y", None], "xyyx")).first().n_items == 2


def test_panel_alpha_of_two_equals_two_rater_alpha(spark):
    p = ratings(spark, "aabbcabc", "abbbcacc")
    assert abs(agreement.alpha_panel(p, "item_id", ["human_label", "judge_label"]).first()[0] - agreement.alpha_two(p).first()[0]) < 1e-12


def test_confidence_range(spark):
    with pytest.raises(ValueError):
        agreement.calibration(spark.createDataFrame([(1, 1.5)], "ok int, c double"), "ok", "c")


def test_cox_on_calibrated_scores(spark):
    df = spark.createDataFrame([(int(i < 10 * p), p) for p in (0.1, 0.3, 0.5, 0.7, 0.9) for i in range(10)], "y int, p double")
    slope, intercept = agreement.cox(df, "y", "p")
    assert abs(slope - 1) < 1e-6 and abs(intercept) < 1e-6


def test_auroc_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert metrics.auroc(df, "y", "s").first()[0] == 0.875


def test_average_rank(spark):
    df = spark.createDataFrame([(v,) for v in (10, 20, 20, 30)], "v int")
    assert sorted(r.k for r in metrics.average_rank(df, "v", "k").collect()) == [1, 2.5, 2.5, 4]


def test_t_quantile():
    assert abs(metrics.t_quantile(0.975, 9) - 2.262157) < 1e-5 and abs(metrics.t_quantile(0.975, 1e6) - 1.959966) < 1e-4


def test_suppression_hides_what_a_total_would_show(spark):
    df = spark.createDataFrame([("a", 3), ("b", 12), ("c", 40)], "k string, n int")
    assert [r.k for r in profiles.suppressed(df).collect()] == ["c"]


def test_validation_counts(spark):
    n = spark.createDataFrame([("1",), ("2",), ("2",)], "ID string")
    e = spark.createDataFrame([("1", "2"), ("1", "2"), ("2", "1"), ("1", "9")], "SourceID string, TargetID string")
    assert tuple(profiles.validate(n, e).first()) == (3, 1, 4, 1, 1)
    with pytest.raises(ValueError):
        profiles.validate(n, e.drop("TargetID"))


def test_knn_matches_numpy(spark):
    x = np.random.default_rng(3).standard_normal((30, 4))
    df = points(spark, [(tuple(v), "a") for v in x])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {tuple(sorted((i, int(j)))) for i in range(30) for j in np.argsort(d[i])[1:4]}
    got = {(r.SourceID, r.TargetID): r.Weight for r in neighbours.knn_edges(df, "id", "v", 3).collect()}
    assert set(got) == want and all(math.isclose(w, 1 / (1 + d[p])) for p, w in got.items())


def test_alias_names(spark):
    df = spark.createDataFrame([(1, 2)], "Node_ID int, label int")
    got, log = tables.normalised(df, ("ID", "Outcome"))
    assert got.columns == ["ID", "Outcome"] and len(log) == 2


def test_csv_keeps_identifiers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("ID,Value\n001,2.5\n002,3\n")
    df = tables.read_csv(spark, str(tmp_path / "n.csv"))
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [("001", 2.5), ("002", 3.0)]

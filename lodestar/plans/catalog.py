"""Named queries over the driver tables, each with the same result in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import agreement, centrality, geometry, graph, metrics, models, neighbours, profiles, resampling
from lodestar.sources import tables
from lodestar.sources.tables import table
from lodestar.streaming import moments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded to 6 places, without negative zero."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return out.alias(name or c)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(n) if t == "double" else F.col(n) for n, t in df.dtypes))


# --- geometry over embeddings

_LONG = "l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"
_FIT = f"""WITH {_LONG}, m AS (SELECT pos, avg(v) AS mean, stddev_pop(v) AS sd FROM l GROUP BY pos),
z AS (SELECT vec_id, label, l.pos, (v - mean) / sd AS z FROM l JOIN m ON l.pos = m.pos WHERE sd * sd > 1e-12),
c AS (SELECT label::VARCHAR AS class, pos, avg(z) AS z FROM z GROUP BY label, pos),
sep AS (SELECT a.class AS a, b.class AS b, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS apart FROM c a JOIN c b ON a.pos = b.pos GROUP BY a.class, b.class),
d AS (SELECT vec_id, class, sum((z.z - c.z) * (z.z - c.z)) AS d2 FROM z JOIN c ON z.pos = c.pos GROUP BY vec_id, class),
n AS (SELECT vec_id, class AS nearest, d2 AS own FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, class) AS r FROM d) WHERE r = 1),
f AS (SELECT vec_id, nearest, class AS runner_up, greatest(0, (d2 - own) / (2 * apart)) AS flip, d2 - own AS margin, row_number() OVER (PARTITION BY vec_id ORDER BY (d2 - own) / apart, class) AS r
      FROM n JOIN d USING (vec_id) JOIN sep ON sep.a = nearest AND sep.b = d.class WHERE d.class <> nearest AND apart > 0),
s AS (SELECT vec_id, nearest, runner_up, flip AS flip_distance, margin FROM f WHERE r = 1)"""


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, geometry.Fit]:
    e = table(spark, sf_dir, "embeddings")
    return e, geometry.fit(e, "embedding", "label")


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, geometry.Fit]:
    e, fitted = _fitted(spark, sf_dir)
    return geometry.contestability(e, "embedding", fitted, "vec_id", "label"), fitted


@query(f"WITH {_LONG} SELECT pos, count(*) AS n, round(avg(v), 6) AS mean, round(var_pop(v) * count(*), 6) AS m2 FROM l GROUP BY pos")
def standardize_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.moments(table(spark, sf_dir, "embeddings"), "embedding"))


@query(f"{_FIT} SELECT class, pos, round(z, 6) + 0.0 AS z FROM c")
def class_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _fitted(spark, sf_dir)
    rows = [(c, p, float(v)) for c, row in zip(f.classes, f.centroids, strict=True) for p, v in zip(f.kept, row, strict=True)]
    return rounded(spark.createDataFrame(rows, "class string, pos int, z double"))


@query(f"{_FIT} SELECT a, b, round(apart, 6) AS apart FROM sep WHERE a < b")
def centroid_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _fitted(spark, sf_dir)
    apart = f.separation()
    rows = [(a, b, float(apart[i, j])) for i, a in enumerate(f.classes) for j, b in enumerate(f.classes) if a < b]
    return rounded(spark.createDataFrame(rows, "a string, b string, apart double"))


@query(f"{_FIT} SELECT n.vec_id, nearest, round(sqrt(own), 6) AS distance, (nearest = label::VARCHAR) AS matches FROM n JOIN embeddings USING (vec_id)")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _assigned(spark, sf_dir)
    return a.select("vec_id", "nearest", r6(F.array_min("distances"), "distance"), (F.col("nearest") == F.col("label").cast("string")).alias("matches"))


@query(f"{_FIT} SELECT vec_id, nearest, runner_up, round(flip_distance, 6) AS flip_distance FROM s")
def flip_distance_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _assigned(spark, sf_dir)
    return rounded(a.select("vec_id", "nearest", "runner_up", "flip_distance"))


@query(f"{_FIT} SELECT vec_id, flip_distance <= (SELECT quantile_cont(flip_distance, 0.1) FROM s) AS contested FROM s")
def contested_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.contested(_assigned(spark, sf_dir)[0]).select("vec_id", "contested")


@query(f"{_FIT} SELECT count(*) AS n_scored, round(avg(flip_distance), 6) AS mean, round(stddev_pop(flip_distance), 6) AS std, round(min(flip_distance), 6) AS min, round(median(flip_distance), 6) AS median, round(max(flip_distance), 6) AS max, count(*) FILTER (WHERE flip_distance <= (SELECT quantile_cont(flip_distance, 0.1) FROM s)) AS n_contested FROM s")
def flip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.flip_summary(geometry.contested(_assigned(spark, sf_dir)[0])))


@query(f"{_FIT} SELECT runner_up, count(*) AS n FROM s GROUP BY runner_up")
def runner_up_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)[0].groupBy("runner_up").agg(F.count("*").alias("n"))


_LEVER = "g AS (SELECT a.class AS a, b.class AS b, a.pos, abs(a.z - b.z) AS w FROM c a JOIN c b ON a.pos = b.pos WHERE a.class <> b.class)"


@query(f"{_FIT}, {_LEVER}, w AS (SELECT a, b, pos, w / sum(w) OVER (PARTITION BY a, b) AS share FROM g) SELECT pos, round(avg(share), 6) AS share FROM s JOIN w ON s.nearest = w.a AND s.runner_up = w.b GROUP BY pos")
def leverage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, f = _assigned(spark, sf_dir)
    return rounded(geometry.leverage_share(spark, a, f))


@query(f"{_FIT}, {_LEVER}, top AS (SELECT a, b, pos, w, row_number() OVER (PARTITION BY a, b ORDER BY w DESC, pos) AS r FROM g) SELECT vec_id, pos AS decisive_feature, round(margin / (2 * w), 6) AS single_axis_flip FROM s JOIN top ON s.nearest = top.a AND s.runner_up = top.b AND top.r = 1")
def single_axis_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_assigned(spark, sf_dir)[0].select("vec_id", "decisive_feature", "single_axis_flip"))


# --- federated aggregates


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("site", F.pmod("vec_id", F.lit(4)).cast("int"))


@query(f"WITH {_LONG} SELECT (vec_id % 4)::INTEGER AS site, pos, count(*) AS n, round(avg(v), 6) AS mean, round(var_pop(v) * count(*), 6) AS m2 FROM l GROUP BY ALL")
def site_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.moments(_sites(spark, sf_dir), "embedding", "site"))


@query(f"WITH {_LONG} SELECT pos, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM l GROUP BY pos")
def combined_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.merged_moments(geometry.moments(_sites(spark, sf_dir), "embedding", "site")))


@query(f"{_FIT} SELECT (vec_id % 4)::INTEGER AS site, least(31, floor(least(flip_distance, 8) / 0.25))::INTEGER AS bin, count(*) AS n FROM s GROUP BY ALL")
def flip_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assigned(spark, sf_dir)[0].withColumn("site", F.pmod("vec_id", F.lit(4)).cast("int"))
    return geometry.flip_histogram(a, "site")


@query(f"{_FIT}, h AS (SELECT least(31, floor(least(flip_distance, 8) / 0.25))::INTEGER AS bin, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h) SELECT round((bin + (0.1::DOUBLE * total - (upto - n)) / n) * 0.25::DOUBLE, 6) AS threshold, round(0.1::DOUBLE * total)::BIGINT AS n_below FROM r WHERE upto >= 0.1::DOUBLE * total ORDER BY bin LIMIT 1")
def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.histogram_quantile(geometry.flip_histogram(_assigned(spark, sf_dir)[0]), 0.1))


@query("WITH k AS (SELECT (vec_id % 4)::INTEGER AS site, label, count(*) AS n FROM embeddings GROUP BY ALL), t AS (SELECT count(*) FILTER (WHERE n < 10) AS low, min(n) FILTER (WHERE n >= 10) AS nxt FROM k) SELECT site, label, n FROM k, t WHERE n >= 10 AND NOT (low = 1 AND n = nxt)")
def suppressed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _sites(spark, sf_dir).groupBy("site", "label").agg(F.count("*").alias("n"))
    return profiles.suppressed(cells)


# --- graphs

_COPART = """d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
e AS (SELECT x.l_partkey AS src, y.l_partkey AS dst, count(*)::DOUBLE AS weight FROM d x JOIN d y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL HAVING count(*) >= 2)"""
_DEG = "ends AS (SELECT src AS id, weight FROM e UNION ALL SELECT dst, weight FROM e), deg AS (SELECT p_partkey AS id, count(weight) AS degree, coalesce(sum(weight), 0)::DOUBLE AS weighted_degree FROM part LEFT JOIN ends ON id = p_partkey GROUP BY p_partkey)"
_COMP = "both_ways AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT p_partkey AS id, p_partkey AS root FROM part UNION SELECT b, root FROM r JOIN both_ways ON a = id WHERE root < b), comp AS (SELECT id, min(root) AS component FROM r GROUP BY id)"


@query(f"WITH {_COPART} SELECT * FROM e")
def copart_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.co_purchased_parts(spark, sf_dir)[1]


@query(f"WITH {_COPART}, {_DEG} SELECT id, degree, weighted_degree, (degree = 0)::INTEGER AS is_isolate FROM deg")
def degree_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = tables.co_purchased_parts(spark, sf_dir)
    return graph.degrees(v, graph.canonical(e))


@query(f"WITH {_COPART}, {_DEG}, t AS (SELECT unnest([x.src, x.dst, y.dst]) AS id FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst), k AS (SELECT id, count(*) AS triangles FROM t GROUP BY id) SELECT deg.id, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree >= 2 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 6)::DOUBLE AS clustering FROM deg LEFT JOIN k ON deg.id = k.id")
def clustering_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = tables.co_purchased_parts(spark, sf_dir)
    return rounded(graph.clustering(v, graph.canonical(e)))


@query(f"WITH RECURSIVE {_COPART}, {_COMP} SELECT id, component, count(*) OVER (PARTITION BY component) AS component_size FROM comp")
def component_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = tables.co_purchased_parts(spark, sf_dir)
    return graph.components(v, graph.canonical(e))


@query(f"WITH RECURSIVE {_COPART}, {_DEG}, {_COMP} SELECT count(*) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT component) FROM comp) AS components, count(*) FILTER (WHERE degree = 0) AS isolates, round(2.0 * (SELECT count(*) FROM e) / (count(*) * (count(*) - 1)), 6)::DOUBLE AS density, round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree FROM deg")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = tables.co_purchased_parts(spark, sf_dir)
    return rounded(graph.summary(v, graph.canonical(e)))


@query("WITH ends AS (SELECT o_custkey AS id FROM orders UNION SELECT c_nationkey FROM customer) SELECT (SELECT count(*) FROM customer) AS node_count, (SELECT count(*) - count(DISTINCT c_custkey) FROM customer) AS duplicate_nodes, (SELECT count(*) FROM orders) AS edge_rows, (SELECT count(*) - count(DISTINCT (o_custkey, o_orderpriority)) FROM orders) AS duplicate_edges, (SELECT count(*) FROM (SELECT DISTINCT x FROM (SELECT o_custkey::VARCHAR AS x FROM orders UNION ALL SELECT o_orderpriority FROM orders)) WHERE x NOT IN (SELECT c_custkey::VARCHAR FROM customer)) AS missing_endpoints")
def validate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ID"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("SourceID"), F.col("o_orderpriority").alias("TargetID"))
    return profiles.validate(nodes, edges)


_NATION = """c0 AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
e AS (SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, n / (SELECT max(n) FROM c0) AS weight FROM c0)"""


def _walks(cost: str) -> str:
    """Best paths by (source, target): a round relaxes all edges, as long as anything gets better."""
    return f"""WITH RECURSIVE {_NATION}, s(source, target, path_cost, hops, path_strength, path) USING KEY (source, target) AS (
  SELECT n_nationkey::VARCHAR, n_nationkey::VARCHAR, 0.0::DOUBLE, 0, 1.0::DOUBLE, n_nationkey::VARCHAR FROM nation
  UNION SELECT m.source, m.target, m.b.c, m.b.h, m.b.w, m.b.t FROM (
    SELECT s.source, e.dst AS target, min(struct_pack(k := round(s.path_cost + {cost}, 12), t := s.path || ' -> ' || e.dst, c := s.path_cost + {cost}, h := s.hops + 1, w := s.path_strength * e.weight)) AS b
    FROM s JOIN e ON s.target = e.src AND e.src <> e.dst GROUP BY s.source, e.dst) m
  LEFT JOIN recurring.s o ON o.source = m.source AND o.target = m.target
  WHERE o.source IS NULL OR m.b.k < round(o.path_cost, 12) OR (m.b.k = round(o.path_cost, 12) AND m.b.t < o.path))"""


def _paths(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    v, e = tables.nation_trade(spark, sf_dir)
    return graph.shortest_paths(e, v, mode, directed=True)


_HOPS = _walks("1.0")


@query(f"{_HOPS} SELECT source, target, path_cost, hops, round(path_strength, 6) AS path_strength, path FROM s")
def hop_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_paths(spark, sf_dir, "hops"))


@query(f"{_walks('e.weight')} SELECT source, target, round(path_cost, 6) AS path_cost, hops, round(path_strength, 6) AS path_strength, path FROM s")
def distance_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_paths(spark, sf_dir, "distance"))


@query(f"{_walks('(-ln(least(greatest(e.weight, 1e-12), 1.0)))')} SELECT source, target, round(path_cost, 6) + 0.0 AS path_cost, hops, round(path_strength, 6) AS path_strength, path FROM s")
def strength_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_paths(spark, sf_dir, "strength"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = tables.nation_trade(spark, sf_dir)
    return graph.path_pairs(_paths(spark, sf_dir, "hops"), v, v)


_PAIRS = f"{_HOPS}, q AS (SELECT a.n_nationkey::VARCHAR AS source, b.n_nationkey::VARCHAR AS target FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey), j AS (SELECT q.source, q.target, path_cost, hops FROM q LEFT JOIN s ON q.source = s.source AND q.target = s.target)"


@query(f"{_PAIRS}, b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path_cost, target) AS r FROM j WHERE path_cost IS NOT NULL) SELECT x.source, b.target AS nearest_target, b.path_cost, b.hops, coalesce(x.n, 0) AS reachable_target_count FROM (SELECT source, count(path_cost) AS n FROM j GROUP BY source) x LEFT JOIN b ON x.source = b.source AND b.r = 1")
def nearest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest_target(_pairs(spark, sf_dir))


@query(f"{_PAIRS} SELECT target, count(*) AS source_count, count(path_cost) AS reachable_source_count, round(count(path_cost) / count(*), 6) AS coverage, min(path_cost) AS min_distance, round(avg(path_cost), 6) AS mean_distance, max(path_cost) AS max_distance, round(avg(hops), 6) AS mean_hops FROM j GROUP BY target")
def target_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.target_coverage(_pairs(spark, sf_dir)))


#: Undirected edges, and all pairs' hops over them.
_UNDIRECTED = f"""WITH RECURSIVE {_NATION}, u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst),
h(source, node, d) USING KEY (source, node) AS (SELECT n_nationkey::VARCHAR, n_nationkey::VARCHAR, 0 FROM nation UNION SELECT h.source, u.dst, min(h.d + 1) FROM h JOIN u ON h.node = u.src LEFT JOIN recurring.h o ON o.source = h.source AND o.node = u.dst WHERE o.source IS NULL GROUP BY h.source, u.dst)"""
_PAGERANK = f"""WITH RECURSIVE {_NATION}, w AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e),
r AS (SELECT n_nationkey::VARCHAR AS id, 1.0::DOUBLE / count(*) OVER () AS r, 0 AS k FROM nation
  UNION ALL SELECT n.id, 0.85 * (coalesce(g.got, 0) + hold.held / n.n) + 0.15 / n.n, n.k FROM
    (SELECT id, count(*) OVER () AS n, k + 1 AS k FROM r WHERE k < 40) n
    LEFT JOIN (SELECT w.dst AS id, sum(w.share * r.r) AS got FROM w JOIN r ON r.id = w.src GROUP BY w.dst) g ON g.id = n.id,
    (SELECT coalesce(sum(r.r), 0) AS held FROM r WHERE r.id NOT IN (SELECT src FROM w)) hold)"""


@query(f"{_PAGERANK} SELECT id::BIGINT AS id, round(r, 6) AS pagerank FROM r WHERE k = 40")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = tables.nation_trade(spark, sf_dir)
    return rounded(graph.pagerank(v, e, tolerance=1e-9))


@query(f"{_UNDIRECTED} SELECT n_nationkey::VARCHAR AS id, round(coalesce(count(d) / sum(d) * count(d) / (SELECT count(*) - 1 FROM nation), 0), 6) AS closeness FROM nation LEFT JOIN h ON source = n_nationkey::VARCHAR AND node <> source GROUP BY n_nationkey")
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = tables.nation_trade(spark, sf_dir)
    return rounded(graph.closeness(v, graph.canonical(e)))


@query()
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = tables.nation_trade(spark, sf_dir)
    return rounded(centrality.betweenness(v, graph.canonical(e)))


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = tables.nation_trade(spark, sf_dir)
    return centrality.communities(v, graph.canonical(e))


@query()
def kmeans_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.kmeans(table(spark, sf_dir, "embeddings"), "embedding", 10, "vec_id"))


@query()
def outcome_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return rounded(models.evaluated(models.scored(models.split(e, "vec_id", "label"), "embedding", "label"), "label"))


@query()
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.projection(table(spark, sf_dir, "embeddings"), "embedding", "vec_id"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type AS site, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value) * count(value), 6) AS m2 FROM events GROUP BY ALL")
def windowed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.windowed_moments(table(spark, sf_dir, "events"), "ts", "event_type", "value"))


@query("WITH d AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d) SELECT least(i, j) AS SourceID, greatest(i, j) AS TargetID, round(1 / (1 + min(d)), 6) AS Weight FROM k WHERE r <= 5 GROUP BY ALL")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.knn_edges(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


@query("WITH c AS (SELECT c_nationkey, min(c_custkey) AS s FROM customer GROUP BY c_nationkey) SELECT s AS SourceID, c_custkey AS TargetID, 1.0::DOUBLE AS Weight FROM customer JOIN c USING (c_nationkey) WHERE s <> c_custkey")
def shared_value_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.shared_value_edges(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey")


# --- rater audit

_RATE = """WITH md AS (SELECT quantile_cont(n_chars, 0.5) AS median FROM documents),
q AS (SELECT doc_id AS item_id, quality::VARCHAR AS human_label, (n_chars >= median)::INTEGER::VARCHAR AS judge_label, least(1.0::DOUBLE, 0.5::DOUBLE + abs(n_chars - median) / (4 * median)) AS conf, (1 - toxic)::VARCHAR AS human_label_2, lang FROM labels JOIN documents USING (doc_id), md)"""


@query(f"{_RATE}, l AS (SELECT DISTINCT unnest([human_label, judge_label]) AS x FROM q) SELECT a.x AS human_label, b.x AS judge_label, count(q.item_id) AS n FROM l a CROSS JOIN l b LEFT JOIN q ON q.human_label = a.x AND q.judge_label = b.x GROUP BY ALL")
def confusion_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.confusion(tables.ratings(spark, sf_dir))


@query(f"{_RATE}, t AS (SELECT count(*) AS n, avg((human_label = judge_label)::INTEGER) AS po FROM q), h AS (SELECT human_label AS x, count(*) AS a FROM q GROUP BY ALL), j AS (SELECT judge_label AS x, count(*) AS b FROM q GROUP BY ALL), e AS (SELECT sum(a * b) AS ab FROM h JOIN j USING (x)) SELECT n AS n_items, round(po, 6) AS raw_agreement, round((po - ab / (n * n)) / (1 - ab / (n * n)), 6) AS cohens_kappa FROM t, e")
def cohens_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.kappa(tables.ratings(spark, sf_dir)))


@query(f"{_RATE}, p AS (SELECT x, count(*) AS c FROM (SELECT human_label AS x FROM q UNION ALL SELECT judge_label FROM q) GROUP BY x), s AS (SELECT sum(c) AS n, sum(c * c) AS cc FROM p), o AS (SELECT avg((human_label <> judge_label)::INTEGER) AS d FROM q) SELECT round(1 - d / ((1 - cc / (n * n)) * n / (n - 1)), 6) AS krippendorff_alpha FROM s, o")
def krippendorff_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.alpha_two(tables.ratings(spark, sf_dir)))


_PANEL = f"{_RATE}, r AS (SELECT item_id, unnest([human_label, judge_label, human_label_2]) AS x FROM q), c AS (SELECT item_id, x, count(*) AS c FROM r GROUP BY ALL), m AS (SELECT item_id, sum(c)::BIGINT AS m, count(*) AS k, sum(c * c)::BIGINT AS cc FROM c GROUP BY item_id)"


@query(f"{_PANEL}, o AS (SELECT sum((m * m - cc) / (m - 1)) AS o, sum(m) AS n FROM m), l AS (SELECT sum(t * t) AS s FROM (SELECT x, sum(c) AS t FROM c GROUP BY x)) SELECT round(1 - (n - 1) * o / (n * n - s), 6) AS krippendorff_alpha FROM o, l")
def krippendorff_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.alpha_panel(tables.ratings(spark, sf_dir), "item_id", ["human_label", "judge_label", "human_label_2"]))


@query(f"{_PANEL} SELECT item_id, m AS n_ratings, k AS n_labels, round((cc - m) / (m * (m - 1)), 6) AS pairwise_agreement, k = 1 AS unanimous FROM m")
def panel_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.panel_splits(tables.ratings(spark, sf_dir), "item_id", ["human_label", "judge_label", "human_label_2"]))


@query(f"{_RATE} SELECT count(*) AS n_items, round(avg((human_label = judge_label)::INTEGER), 6) AS accuracy, round(avg(conf), 6) AS mean_confidence, round(avg((conf - (human_label = judge_label)::INTEGER) ** 2), 6) AS brier FROM q")
def brier_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.ratings(spark, sf_dir).withColumn("ok", F.col("human_label") == F.col("judge_label"))
    return rounded(agreement.calibration(r, "ok", "judge_confidence"))


@query(f"{_RATE}, p AS (SELECT avg((human_label <> judge_label)::INTEGER) AS p FROM q), g AS (SELECT lang AS \"group\", count(*) AS n, sum((human_label <> judge_label)::INTEGER)::BIGINT AS n_disagree FROM q GROUP BY lang), w AS (SELECT g.*, p, 1.959963984540054 * sqrt(p * (1 - p) / n) + 0.5 / n AS a, 3.090232306167813 * sqrt(p * (1 - p) / n) + 0.5 / n AS b FROM g, p) SELECT \"group\", n, n_disagree, round(n_disagree / n, 6) AS disagreement_rate, round(greatest(p - a, 0), 6) AS warn_low, round(least(p + a, 1), 6) AS warn_high, round(greatest(p - b, 0), 6) AS alarm_low, round(least(p + b, 1), 6) AS alarm_high, (n_disagree / n < greatest(p - a, 0) OR n_disagree / n > least(p + a, 1)) AS outside_warn FROM w")
def subgroup_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.ratings(spark, sf_dir).withColumn("wrong", F.col("human_label") != F.col("judge_label"))
    return rounded(agreement.funnel(r, "group_lang", "wrong"))


@query(f"{_RATE}, o AS (SELECT *, row_number() OVER (ORDER BY (item_id * 7919) % 10007, item_id) AS r, count(*) OVER () AS n, 1 - CASE WHEN human_label = judge_label THEN conf ELSE 1 - conf END AS s FROM q), fit AS (SELECT *, row_number() OVER (ORDER BY s, item_id) AS k, count(*) OVER () AS m FROM o WHERE r <= floor(n / 2)), th AS (SELECT coalesce(max(s) FILTER (WHERE ceil((m + 1) * 0.9::DOUBLE) / m < 1 AND k = ceil(ceil((m + 1) * 0.9::DOUBLE) / m * (m - 1)) + 1), 1.0) AS t FROM fit) SELECT item_id, judge_label, human_label, ((1 - conf <= t)::INTEGER + (conf <= t)::INTEGER) AS set_size, CASE WHEN human_label = judge_label THEN 1 - conf <= t ELSE conf <= t END AS covers_human FROM o, th WHERE r > floor(n / 2)")
def conformal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.conformal_sets(tables.ratings(spark, sf_dir), "item_id", "judge_label", "human_label", "judge_confidence", (F.col("item_id") * 7919) % 10007)


# --- metrics and resampling

_SCORED = "WITH q AS (SELECT doc_id, quality AS y, n_chars AS s, (n_chars >= 1000)::INTEGER AS p FROM labels JOIN documents USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), F.col("n_chars").alias("s"), (F.col("n_chars") >= 1000).cast("int").alias("p"))


@query(f"{_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM q) SELECT round((sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auroc FROM r")
def auroc_tie_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auroc(_scored(spark, sf_dir), "y", "s"))


@query(f"{_SCORED}, c AS (SELECT s, sum(y) AS p, count(*) AS n FROM q GROUP BY s), r AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM c) SELECT round(sum(p * tp / seen) / sum(p), 6) AS average_precision FROM r")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(_scored(spark, sf_dir), "y", "s"))


@query(f"{_SCORED}, t AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND p = 0)::DOUBLE AS tn, count(*) FILTER (WHERE y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND p = 0)::DOUBLE AS fn FROM q), m AS (SELECT *, tp / (tp + fp) AS p1, tn / (tn + fn) AS p0, tp / (tp + fn) AS r1, tn / (tn + fp) AS r0, tp + fn AS n1, tn + fp AS n0, tp + tn + fp + fn AS n FROM t) SELECT round((tp + tn) / n, 6) AS accuracy, round((r1 + r0) / 2, 6) AS balanced_accuracy, round((n1 * p1 + n0 * p0) / n, 6) AS precision_weighted, round((n1 * r1 + n0 * r0) / n, 6) AS recall_weighted, round((n1 * 2 * p1 * r1 / (p1 + r1) + n0 * 2 * p0 * r0 / (p0 + r0)) / n, 6) AS f1_weighted, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM m")
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.label_metrics(_scored(spark, sf_dir), "y", "p"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice"))


@query("WITH t AS (SELECT lang, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang), p AS (SELECT lang, n, k, k / n AS p, 1.96::DOUBLE AS z FROM t) SELECT lang, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0), 6) AS low, round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1), 6) AS high FROM p")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").cast("double").alias("n"), F.sum("quality").cast("double").alias("k"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return t.select("lang", r6(low, "low"), r6(high, "high"))


#: Replicates of the bootstraps and of the permutation test.
REPLICATES, DELTA_REPLICATES, PERMUTATIONS = 1000, 2000, 1000


def _drawn_sql(replicates: int) -> str:
    return f"{_SCORED}, i AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM q), d AS (SELECT rep, ('0x' || substr(md5('42:' || rep || ':' || i), 1, 8))::BIGINT % n AS i FROM range({replicates}) x(rep), i), b AS (SELECT rep, y, s, p FROM d JOIN i USING (i))"


_DRAWN = _drawn_sql(REPLICATES)
_SHUFFLED = f"{_SCORED}, i AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM q), d AS (SELECT rep, y, row_number() OVER (PARTITION BY rep ORDER BY ('0x' || substr(md5('42:' || rep || ':' || i), 1, 8))::BIGINT, i) - 1 AS i FROM range({PERMUTATIONS}) x(rep), i), b AS (SELECT rep, d.y, i.s, i.p FROM d JOIN i USING (i))"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows are few: they are numbered in one window, by their ids."""
    from pyspark.sql import Window

    return _scored(spark, sf_dir).withColumn("i", (F.row_number().over(Window.orderBy("doc_id")) - 1).cast("long"))


@query(f"{_DRAWN}, a AS (SELECT rep, avg((y = p)::INTEGER) AS v FROM b GROUP BY rep) SELECT count(*) AS replicates, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM a")
def bootstrap_ci_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = resampling.bootstrap(_scored(spark, sf_dir), "doc_id", ["y", "p"], REPLICATES, resampling.hit_share)
    return rounded(metrics.percentile_interval(a, "v"))


@query(f"{_drawn_sql(DELTA_REPLICATES)}, r AS (SELECT rep, y, rank() OVER (PARTITION BY rep ORDER BY s) + (count(*) OVER (PARTITION BY rep, s) - 1) / 2 AS k, rank() OVER (PARTITION BY rep ORDER BY p) + (count(*) OVER (PARTITION BY rep, p) - 1) / 2 AS l FROM b), u AS (SELECT rep, (sum(k) FILTER (WHERE y = 1) - sum(l) FILTER (WHERE y = 1)) / (sum(y) * sum(1 - y)) AS v FROM r GROUP BY rep) SELECT count(*) AS replicates, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM u")
def bootstrap_delta_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = resampling.bootstrap(_scored(spark, sf_dir), "doc_id", ["y", "s", "p"], DELTA_REPLICATES, resampling.area_difference)
    return rounded(metrics.percentile_interval(d, "v"))


@query(f"{_SHUFFLED}, a AS (SELECT rep, avg((y = p)::INTEGER) AS v FROM b GROUP BY rep), o AS (SELECT avg((y = p)::INTEGER) AS o FROM q) SELECT round(o, 6) AS observed, count(*) AS permutations, round((count(*) FILTER (WHERE v >= o) + 1) / (count(*) + 1), 6) AS p_value FROM a, o GROUP BY o")
def permutation_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accuracy against that of shuffles of the labels."""
    rows, right = _scored(spark, sf_dir), F.avg((F.col("y") == F.col("p")).cast("int")).alias("v")
    return rounded(metrics.permutation_p(rows.agg(right), resampling.permuted(rows, "doc_id", "y", "p", PERMUTATIONS), "v"))


#: Repeated splits, and the t quantile for one degree less.
SPLITS, _T9 = 10, 2.2621571627409915


@query(f"{_SCORED}, h AS (SELECT rep, y, p, s, row_number() OVER (PARTITION BY rep ORDER BY ('0x' || substr(md5('42:' || rep || ':' || doc_id), 1, 8))::BIGINT, doc_id) AS r, count(*) OVER (PARTITION BY rep) AS n FROM range({SPLITS}) x(rep), q), m AS (SELECT rep, max(CASE WHEN r > floor(n * 0.2::DOUBLE) THEN 1 ELSE 0 END) AS one, CASE WHEN 2 * sum(y) FILTER (WHERE r > floor(n * 0.2::DOUBLE)) >= count(*) FILTER (WHERE r > floor(n * 0.2::DOUBLE)) THEN 1 ELSE 0 END AS majority FROM h GROUP BY rep), a AS (SELECT h.rep, avg((y = p)::INTEGER) - avg((y = majority)::INTEGER) AS v FROM h JOIN m USING (rep) WHERE r <= floor(n * 0.2::DOUBLE) GROUP BY h.rep), z AS (SELECT count(*) AS k, avg(v) AS mean, sqrt((1 / count(*) + 0.25::DOUBLE) * var_samp(v)) AS se FROM a) SELECT k, round(mean, 6) AS mean, round(se, 6) AS se, round(mean - {_T9} * se, 6) AS low, round(mean + {_T9} * se, 6) AS high FROM z")
def nadeau_bengio_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the accuracy of a rule on test rows is above that of the training rows' majority, over repeated splits."""
    from pyspark.sql import Window

    rep = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPLITS - 1).cast("long"))).alias("rep")
    rows = _scored(spark, sf_dir).select("*", rep)
    w = Window.partitionBy("rep")
    r = F.row_number().over(w.orderBy(metrics.hashed(42, F.col("rep"), F.col("doc_id")), "doc_id"))
    rows = rows.withColumn("test", r <= F.floor(F.count("*").over(w) * F.lit(0.2)))
    majority = rows.filter("not test").groupBy("rep").agg((2 * F.sum("y") >= F.count("*")).cast("int").alias("majority"))
    a = rows.filter("test").join(majority, "rep").groupBy("rep").agg((F.avg((F.col("y") == F.col("p")).cast("int")) - F.avg((F.col("y") == F.col("majority")).cast("int"))).alias("v"))
    return rounded(metrics.nadeau_bengio(a, "v", 0.2))


# --- profiles


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    parts = [f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n_rows, count(DISTINCT {c}) AS n_unique, count(*) FILTER (WHERE {c} IS NULL OR lower(trim({c}::VARCHAR)) IN ('', 'nan', 'none')) AS n_missing FROM {name}" for c, t in columns.items()]
    return f"WITH p AS ({' UNION ALL '.join(parts)}) SELECT *, round(n_unique / n_rows, 6) AS cardinality_ratio, (regexp_matches(lower(\"column\"), 'id|identifier|accession|mrn|uuid|guid|key|index') AND n_unique / n_rows > 0.95) OR (n_unique = n_rows AND dtype = 'string') AS looks_like_id, n_unique / n_rows > 0.5 AND n_unique > 20 AS high_cardinality FROM p"


@query(_profile_sql("customer", {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}))
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.table_profile(table(spark, sf_dir, "customer")))


@query("SELECT c_custkey, " + ", ".join(f"(coalesce(r_name, '') = '{r}')::INTEGER AS \"r_name_{r}\"" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def one_hot_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    both = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return profiles.one_hot(both, "r_name", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "c_custkey")


@query()
def schema_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.infer_schema(table(spark, sf_dir, "orders"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE role IS NULL OR lower(trim(role)) IN ('', 'nan', 'none')) AS blank_roles, count(*) FILTER (WHERE text IS NULL OR lower(trim(text)) IN ('', 'nan', 'none')) AS blank_texts FROM conversations")
def blank_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.functions.labels import is_blank

    c = table(spark, sf_dir, "conversations")
    return c.agg(F.count("*").alias("n_rows"), F.count_if(is_blank(F.col("role"))).alias("blank_roles"), F.count_if(is_blank(F.col("text"))).alias("blank_texts"))

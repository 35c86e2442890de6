"""More named queries: federation, clusters, audits, joins and group rows, scores, thresholds and plot data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import sinks
from lodestar.operators import agreement, audit, federated, geometry, governance, graph, metrics, models, neighbours, shaping, spectral
from lodestar.plans.catalog import _FIT, _PAIRS, _RATE, _SCORED, REPLICATES, _assigned, _fitted, _numbered, _paths, _scored, _sites, query, r6, rounded
from lodestar.sources import tables
from lodestar.sources.tables import table

# --- federation


@query(f"{_FIT} SELECT class, pos, round(z, 6) + 0.0 AS z FROM c")
def federated_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised centroids of the pooled fit, from site messages alone."""
    f = federated.combine_aggregates(federated.messages(federated.site_aggregates(_sites(spark, sf_dir), "embedding", "label", "site"))).fit
    return rounded(spark.createDataFrame([(c, p, float(v)) for c, row in zip(f.classes, f.centroids, strict=True) for p, v in zip(f.kept, row, strict=True)], "class string, pos int, z double"))


@query("WITH l AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT pos::INTEGER AS pos, (SELECT count(*) FROM embeddings) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS sd FROM l GROUP BY pos")
def federated_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = federated.combine_aggregates(federated.messages(federated.site_aggregates(_sites(spark, sf_dir), "embedding", "label", "site")))
    return rounded(spark.createDataFrame([(i, p.n_total, float(m), float(s)) for i, m, s in zip(p.fit.kept, p.fit.mean, p.fit.sd, strict=True)], "pos int, n long, mean double, sd double"))


@query("SELECT 'mean' AS quantity, true AS equal UNION ALL SELECT 'sd', true UNION ALL SELECT 'centroids', true UNION ALL SELECT 'metric', true")
def federated_against_central(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each quantity of the pooled fit is that of the central one, to 1e-9 (the precision matrix relative to its largest entry)."""
    pooled, gaps = federated.simulate(_sites(spark, sf_dir), "embedding", "label", "site")
    scale = {"metric": max(1.0, float(abs(pooled.fit.metric).max()))}
    return spark.createDataFrame([(k, bool(v < 1e-9 * scale.get(k, 1.0))) for k, v in gaps.items()], "quantity string, equal boolean")


@query(f"{_FIT}, h AS (SELECT least(31, floor(least(flip_distance, 8) / 0.25))::INTEGER AS bin, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h), t AS (SELECT (bin + (0.1::DOUBLE * total - (upto - n)) / n) * 0.25::DOUBLE AS threshold FROM r WHERE upto >= 0.1::DOUBLE * total ORDER BY bin LIMIT 1) SELECT count(*) AS n_scored, round(avg(flip_distance), 6) AS mean, round(stddev_pop(flip_distance), 6) AS std, round(min(flip_distance), 6) AS min, round(max(flip_distance), 6) AS max, round(any_value(t.threshold), 6) AS approx_contest_threshold, round(0.1::DOUBLE * count(*))::BIGINT AS approx_n_contested, round(avg((nearest = label::VARCHAR)::INTEGER), 6) AS nearest_centroid_agreement FROM s JOIN embeddings USING (vec_id), t")
def federated_contestability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = federated.simulate_contestability(_sites(spark, sf_dir), "embedding", "label", "site")
    f = out["flip_distance"]
    return rounded(spark.createDataFrame([(out["n_scored"], f["mean"], f["std"], f["min"], f["max"], f["approx_contest_threshold"], f["approx_n_contested"], out["nearest_centroid_agreement"])], "n_scored long, mean double, std double, min double, max double, approx_contest_threshold double, approx_n_contested long, nearest_centroid_agreement double"))


@query("WITH k AS (SELECT (vec_id % 4)::VARCHAR AS site, label::VARCHAR AS class, count(*) AS n FROM embeddings GROUP BY ALL), t AS (SELECT site, count(*) FILTER (WHERE n < 10) AS low FROM k GROUP BY site), x AS (SELECT site, class, row_number() OVER (PARTITION BY site ORDER BY n, class) AS r FROM k WHERE n >= 10), s AS (SELECT k.site, k.class, k.n FROM k JOIN t USING (site) JOIN x USING (site, class) WHERE NOT (low = 1 AND r = 1)) SELECT t.site, s.class, s.n, (SELECT coalesce(sum(z.n), 0)::BIGINT FROM s z WHERE z.site = t.site) AS site_n FROM t LEFT JOIN s ON s.site = t.site")
def site_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class counts and totals of site messages after the gate: small cells, and what would show them, are gone."""
    rows = []
    for m in federated.messages(federated.site_aggregates(_sites(spark, sf_dir), "embedding", "label", "site")):  # a row a site
        out, _ = governance.suppress(m, 10)
        if set(out["class_n"]) != set(out["class_sum"]):
            raise ValueError("a hidden class left its sums")
        rows += [(m["site"], c, n, out["n"]) for c, n in out["class_n"].items()] or [(m["site"], None, None, out["n"])]
    return spark.createDataFrame(rows, "site string, class string, n long, site_n long")


@query("WITH h AS (SELECT c_custkey, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || c_custkey), 1, 8))::BIGINT, c_custkey) - 1 AS r FROM customer) SELECT c_custkey, (r % 5)::INTEGER AS site FROM h")
def balanced_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federated.balanced_sites(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 5)


@query()
def mahalanobis_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    f = geometry.fit(e, "embedding", "label", mahalanobis=True)
    return rounded(geometry.contestability(e, "embedding", f, "vec_id").select("vec_id", "nearest", "runner_up", "flip_distance", "single_axis_flip"))


# --- contestability tables and clusters


@query(f"{_FIT}, k AS (SELECT *, row_number() OVER (ORDER BY flip_distance, vec_id::VARCHAR) AS r FROM s) SELECT vec_id::VARCHAR AS \"ID\", nearest AS nearest_class_centroid, round(flip_distance, 6) AS flip_distance FROM k WHERE r <= 10")
def most_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, f = _fitted(spark, sf_dir)
    return rounded(geometry.most_contested(geometry.node_contestability(e, "vec_id", "embedding", "label", f)).select("ID", "nearest_class_centroid", "flip_distance"))


@query(f"{_FIT} SELECT s.vec_id::VARCHAR AS \"ID\", nearest AS nearest_class_centroid, runner_up AS runner_up_class, label::VARCHAR AS outcome, nearest = label::VARCHAR AS nearest_matches_outcome, flip_distance <= (SELECT quantile_cont(flip_distance, 0.1) FROM s) AS contested, round(sqrt(d.d2), 6) AS dist_to_0 FROM s JOIN embeddings USING (vec_id) JOIN d ON d.vec_id = s.vec_id AND d.class = '0'")
def node_contestability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, f = _fitted(spark, sf_dir)
    out = geometry.node_contestability(e, "vec_id", "embedding", "label", f)
    return rounded(out.select("ID", "nearest_class_centroid", "runner_up_class", "outcome", "nearest_matches_outcome", "contested", "dist_to_0"))


@query(f"{_FIT} SELECT nearest AS cluster, label::VARCHAR AS outcome, count(*) AS n FROM s JOIN embeddings USING (vec_id) GROUP BY ALL")
def cluster_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _assigned(spark, sf_dir)
    return models.crosstab(a.select(F.col("nearest").alias("cluster"), F.col("label").cast("string").alias("outcome")), "cluster", "outcome")


@query(f"{_FIT} SELECT nearest AS cluster, count(*) AS n, round(sum(own), 4) AS inertia FROM n GROUP BY nearest")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _assigned(spark, sf_dir)
    out = models.cluster_sizes(a.select(F.col("nearest").alias("cluster"), F.array_min("distances").alias("distance_to_cluster_centroid")))
    return out.select("cluster", "n", F.round("inertia", 4).alias("inertia"))


@query("WITH d AS (SELECT a.vec_id AS i, a.label AS own, b.label AS c, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s, count(*) AS k FROM embeddings a JOIN embeddings b ON true GROUP BY ALL), r AS (SELECT i, max(s / nullif(k - 1, 0)) FILTER (WHERE own = c) AS a, max(k) FILTER (WHERE own = c) AS size, min(s / k) FILTER (WHERE own <> c) AS b FROM d GROUP BY i) SELECT round(avg(CASE WHEN size <= 1 OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM r")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = models.silhouette(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return spark.createDataFrame([(round(s, 5),)], "silhouette double")


@query()
def spectral_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = tables.nation_trade(spark, sf_dir)
    out = spectral.embedding(v, graph.canonical(e), 2)
    return rounded(out.select("ID", F.col("spectral")[0].alias("x"), F.col("spectral")[1].alias("y")))


@query("SELECT n_nationkey::VARCHAR AS \"ID\", 0.0::DOUBLE AS constant FROM nation")
def no_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.no_information(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")))


# --- path tables


@query(f"{_PAIRS} SELECT source, target, 'hops' AS path_mode, path_cost, path_cost AS distance, hops FROM j")
def path_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = tables.nation_trade(spark, sf_dir)
    return graph.path_table(graph.path_pairs(_paths(spark, sf_dir, "hops"), v, v), "hops").select("source", "target", "path_mode", "path_cost", "distance", "hops")


@query(f"{_PAIRS}, b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path_cost, target) AS r FROM j WHERE path_cost IS NOT NULL) SELECT x.source, b.target AS nearest_target, b.path_cost AS distance, x.n AS reachable_target_count, x.m AS target_count FROM (SELECT source, count(path_cost) AS n, count(*) AS m FROM j GROUP BY source) x LEFT JOIN b ON x.source = b.source AND b.r = 1")
def nearest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = tables.nation_trade(spark, sf_dir)
    paths = graph.path_table(graph.path_pairs(_paths(spark, sf_dir, "hops"), v, v), "hops")
    return graph.nearest_table(paths).select("source", "nearest_target", "distance", "reachable_target_count", "target_count")


@query(f"{_PAIRS}, t AS (SELECT target, count(*) AS n, count(path_cost) AS k FROM j GROUP BY target), o AS (SELECT source, count(path_cost) AS k FROM j GROUP BY source) SELECT (SELECT count(*) FROM o) AS source_count, (SELECT count(*) FROM t) AS target_count, (SELECT count(*) FROM o WHERE k > 0) AS reachable_sources, (SELECT count(*) FROM t WHERE k = n) AS fully_covered_targets, (SELECT count(*) FROM t WHERE k = 0) AS unreached_targets")
def path_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = tables.nation_trade(spark, sf_dir)
    return graph.run_summary(graph.path_table(graph.path_pairs(_paths(spark, sf_dir, "hops"), v, v), "hops"))


@query("SELECT a.s_suppkey AS \"SourceID\", b.s_suppkey AS \"TargetID\", 1.0::DOUBLE AS \"Weight\" FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def shared_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of suppliers of a nation: the square of a nation's suppliers, which is what the operator is."""
    return neighbours.all_shared_pairs(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey")


# --- audits


@query(f"{_RATE}, p AS (SELECT avg((human_label <> judge_label)::INTEGER) AS p FROM q), g AS (SELECT lang AS \"group\", count(*) AS n, avg((human_label <> judge_label)::INTEGER) AS r FROM q GROUP BY lang), w AS (SELECT g.*, p, 1.959963984540054 * sqrt(p * (1 - p) / n) + 0.5 / n AS a, 3.090232306167813 * sqrt(p * (1 - p) / n) + 0.5 / n AS b FROM g, p) SELECT \"group\", CASE WHEN r < greatest(p - b, 0) OR r > least(p + b, 1) THEN 'alarm' WHEN r < greatest(p - a, 0) OR r > least(p + a, 1) THEN 'warn' ELSE 'ok' END AS flag FROM w")
def funnel_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.ratings(spark, sf_dir).withColumn("wrong", F.col("human_label") != F.col("judge_label"))
    return audit.flagged(agreement.funnel(r, "group_lang", "wrong")).select("group", "flag")


@query(f"{_RATE} SELECT item_id, human_label, judge_label FROM q WHERE human_label IS NOT NULL AND judge_label IS NOT NULL")
def rater_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.ratings(spark, sf_dir)
    return agreement.aligned(r.select("item_id", "human_label"), r.select("item_id", "judge_label"))


_CONFORMAL = f"{_RATE}, o AS (SELECT *, row_number() OVER (ORDER BY (item_id * 7919) % 10007, item_id) AS r, count(*) OVER () AS n, 1 - CASE WHEN human_label = judge_label THEN conf ELSE 1 - conf END AS s FROM q), fit AS (SELECT *, row_number() OVER (ORDER BY s, item_id) AS k, count(*) OVER () AS m FROM o WHERE r <= floor(n / 2)), th AS (SELECT coalesce(max(s) FILTER (WHERE ceil((m + 1) * 0.9::DOUBLE) / m < 1 AND k = ceil(ceil((m + 1) * 0.9::DOUBLE) / m * (m - 1)) + 1), 1.0) AS t FROM fit), z AS (SELECT item_id, judge_label, human_label, (1 - conf <= t) AS own, (conf <= t) AS other FROM o, th WHERE r > floor(n / 2)), cs AS (SELECT *, own::INTEGER + other::INTEGER AS set_size, CASE WHEN human_label = judge_label THEN own ELSE other END AS covers FROM z)"


@query(f"{_CONFORMAL} SELECT count(*) AS n_test, round(avg(covers::INTEGER), 6) AS coverage, round(avg(set_size), 6) AS mean_set_size, count(*) FILTER (WHERE set_size = 0) AS n_empty, count(*) FILTER (WHERE set_size = 1) AS n_single, count(*) FILTER (WHERE set_size = 2) AS n_double FROM cs")
def conformal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.conformal_summary(audit.conformal_rows(tables.ratings(spark, sf_dir), "item_id", (F.col("item_id") * 7919) % 10007)))


@query(f"{_CONFORMAL} SELECT item_id, array_to_string(list_sort([x FOR x IN [CASE WHEN own THEN judge_label END, CASE WHEN other THEN (1 - judge_label::INTEGER)::VARCHAR END] IF x IS NOT NULL]), ',') AS prediction_set FROM cs")
def conformal_prediction_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.conformal_rows(tables.ratings(spark, sf_dir), "item_id", (F.col("item_id") * 7919) % 10007)
    return rows.select("item_id", F.array_join(F.array_sort("prediction_set"), ",").alias("prediction_set"))


@query()
def judge_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.ratings(spark, sf_dir).withColumn("ok", F.col("human_label") == F.col("judge_label"))
    return rounded(audit.calibration(r, "ok", "judge_confidence"))


@query()
def verdict_grey_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contested items that people judged otherwise, by the first four values of each item's vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), *(F.col("embedding")[i].alias(f"criterion_{i}") for i in range(4)))
    _, s = audit.verdict_contestability(tables.ratings(spark, sf_dir).join(e, "item_id"), "item_id", "criterion_")
    return spark.createDataFrame([(s["n_contested"], s["n_disagreements"], s["n_grey_zone"])], "n_contested long, n_disagreements long, n_grey_zone long")


# --- group rows, joins and selections


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def index_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.index_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey")


@query("SELECT o_custkey, round(first, 2) AS first, round(last, 2) AS last, round(last - first, 2) AS change, n FROM (SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_totalprice)) AS first, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS last, count(*) AS n FROM orders GROUP BY o_custkey)")
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shaping.first_last(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice")
    return out.select("o_custkey", *(F.round(c, 2).alias(c) for c in ("first", "last", "change")), "n")


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1)::INTEGER AS place, count(*) OVER (PARTITION BY o_custkey) AS group_count FROM orders")
def group_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.counted(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority").select("o_orderkey", "place", "group_count")


@query("SELECT l_orderkey, count(*) AS readers, median(l_linenumber)::DOUBLE AS median, max(l_linenumber) - min(l_linenumber) AS spread, string_agg(l_linenumber::VARCHAR, ';' ORDER BY l_linenumber) AS ratings FROM lineitem GROUP BY l_orderkey")
def reader_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("WITH d AS (SELECT doc_id, n_chars, lang FROM documents), x AS (SELECT quality = 1 AS y, n_chars >= 1000 AS f, n_chars BETWEEN 900 AND 1100 AS h, lang FROM labels JOIN d USING (doc_id)), t AS (SELECT lang, count(*) FILTER (WHERE y AND f) AS tp, count(*) FILTER (WHERE y AND NOT f) AS fn, count(*) FILTER (WHERE NOT y AND NOT f) AS tn, count(*) FILTER (WHERE NOT y AND f) AS fp, avg(h::INTEGER) AS hedge FROM x GROUP BY lang) SELECT lang, tp, fn, tn, fp, round(hedge, 6) AS hedge_fraction, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity FROM t")
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    out = shaping.operating_point(rows, F.col("quality") == 1, F.col("n_chars") >= 1000, F.col("n_chars").between(900, 1100), "lang")
    return rounded(out.select("lang", "tp", "fn", "tn", "fp", "hedge_fraction", "sensitivity", "specificity"))


_MULTI = " UNION ALL ".join(f"SELECT '{a}' AS aggregation, {t}::DOUBLE AS threshold, '{k}' AS labels, {a}_ AS v, {k} AS y FROM p" for a in ("max", "mean", "last") for t in (100000, 200000) for k in ("urgent", "failed"))


@query(f"WITH p AS (SELECT o_custkey, max(o_totalprice) AS max_, avg(o_totalprice) AS mean_, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS last_, max((o_orderpriority = '1-URGENT')::INTEGER) AS urgent, max((o_orderstatus = 'F')::INTEGER) AS failed FROM orders GROUP BY o_custkey), s AS ({_MULTI}) SELECT aggregation, threshold, labels, count(*) AS n, count(*) FILTER (WHERE y = 1 AND v >= threshold) AS tp, count(*) FILTER (WHERE y = 1 AND v < threshold) AS fn, count(*) FILTER (WHERE y = 0 AND v < threshold) AS tn, count(*) FILTER (WHERE y = 0 AND v >= threshold) AS fp FROM s GROUP BY ALL")
def multiverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    positive = {"urgent": F.col("o_orderpriority") == "1-URGENT", "failed": F.col("o_orderstatus") == "F"}
    return shaping.multiverse(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderdate", positive, [100000, 200000])


@query("SELECT c_custkey::VARCHAR AS \"ID\", coalesce(n, 0)::DOUBLE AS n_orders, c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def features_with_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = shaping.numeric_attributes(table(spark, sf_dir, "customer"), "c_custkey", ["c_nationkey"]).select("ID", "c_acctbal")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("ID")).agg(F.count("*").cast("double").alias("n_orders"))
    return shaping.with_attributes(own, n)


@query("SELECT d.doc_id, quality::VARCHAR AS quality, coalesce(item_id, -1) AS item FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def labels_and_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    groups = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("item"))
    return shaping.with_groups(shaping.with_labels(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality"), groups, "doc_id", "item")


@query("SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
def target_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.target_rows(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size")


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND starts_with(p_type, 'STANDARD')")
def member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.members(shaping.members(table(spark, sf_dir, "part"), "p_size", [1, 5, 9]), "p_type", prefix="STANDARD").select("p_partkey")


@query("SELECT doc_id, coalesce(quality::VARCHAR, '') AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def scaffold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return shaping.scaffold_labels(table(spark, sf_dir, "documents"), labels, "doc_id", "quality")


@query(f"{_RATE} SELECT item_id FROM q WHERE human_label <> judge_label INTERSECT SELECT item_id FROM q WHERE human_label <> human_label_2")
def split_and_disputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.ratings(spark, sf_dir)
    return shaping.both_in(r.filter("human_label <> judge_label"), r.filter("human_label <> human_label_2"), "item_id")


@query("SELECT a.doc_id, quality::DOUBLE AS one, toxic::DOUBLE AS other FROM labels a")
def paired_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "labels")
    return shaping.paired(r.withColumn("v", F.col("quality").cast("double")), r.withColumn("v", F.col("toxic").cast("double")), "doc_id", "v")


# --- scores, tiers, thresholds and plot data

_PART = "WITH p AS (SELECT p_partkey, 40 + p_size AS age, p_partkey % 2 AS female, 4 + p_size / 2.0::DOUBLE AS mm, CASE p_partkey % 3 WHEN 0 THEN 'solid' WHEN 1 THEN 'part_solid' ELSE 'non_solid' END AS kind, p_partkey % 5 AS k FROM part)"


@query(f"{_PART}, s AS (SELECT p_partkey, 1 / (1 + exp(-(-6.7892 + 0.0287 * (age - 62) + 0.6011 * female - 5.3854 * (pow(mm / 10, -0.5) - 1.58113883) + CASE kind WHEN 'part_solid' THEN 0.377 WHEN 'non_solid' THEN -0.1276 ELSE 0 END - 0.0824 * (k - 4))::DOUBLE)) AS b, 1 / (1 + exp(-(-6.8272 + 0.0391 * age + 0.7917 * female + 0.1274 * mm)::DOUBLE)) AS m FROM p) SELECT p_partkey, round(b, 6) AS brock, round(m, 6) AS mayo, CASE WHEN b < 0.1 THEN 'low' WHEN b < 0.5 THEN 'intermediate' ELSE 'high' END AS tier FROM s")
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, zero = F.col, F.lit(0)
    kind = F.when(c("p_partkey") % 3 == 0, "solid").when(c("p_partkey") % 3 == 1, "part_solid").otherwise("non_solid")
    age, female, mm = 40 + c("p_size"), c("p_partkey") % 2, 4 + c("p_size") / 2
    b = shaping.brock_probability(age, female, zero, zero, mm, kind, zero, c("p_partkey") % 5, zero)
    m = shaping.mayo_probability(age, female, zero, mm, zero, zero)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", b.alias("brock"), m.alias("mayo"), shaping.risk_tier(b).alias("tier")))


@query("WITH p AS (SELECT p_partkey, 100 + p_size AS days, 5 + p_partkey % 4 AS a, 5 + p_partkey % 7 AS b FROM part), v AS (SELECT p_partkey, CASE WHEN b > a THEN days * ln(2) / (3 * ln(b / a)) END AS vdt FROM p) SELECT p_partkey, round(vdt, 6) AS vdt_days, CASE WHEN vdt >= 9999 THEN 0 WHEN vdt < 100 THEN 15 WHEN vdt < 400 THEN 13 WHEN vdt < 600 THEN 10 WHEN vdt IS NOT NULL THEN 8 END AS points FROM v")
def growth_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    vdt = shaping.volume_doubling_time(100 + c("p_size"), 5 + c("p_partkey") % 4, 5 + c("p_partkey") % 7)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", vdt.alias("vdt_days"), shaping.growth_points(vdt).alias("points")))


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) + 0.0 AS z FROM part")
def zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.zscore(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "z").select("p_partkey", r6("z"))


@query(f"{_SCORED}, c AS (SELECT s AS threshold, sum(y) AS p, count(*) - sum(y) AS q FROM q GROUP BY s), r AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(q) OVER (ORDER BY threshold DESC) AS fp, sum(p) OVER () AS pp, sum(q) OVER () AS qq FROM c), b AS (SELECT threshold, (tp / pp + 1 - fp / qq) / 2 AS balanced FROM r) SELECT arg_max(threshold, (balanced, threshold))::DOUBLE AS threshold FROM b")
def tuned_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(metrics.tuned_threshold(_scored(spark, sf_dir), "y", "s"),)], "threshold double")


@query("WITH m AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT round(a + k * (b - a) / 30, 4) AS low, count(*) AS n FROM (SELECT a, b, least(floor((o_totalprice - a) / ((b - a) / 30)), 29) AS k FROM orders, m) GROUP BY a, b, k")
def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.histogram(table(spark, sf_dir, "orders"), "o_totalprice").select(F.round("low", 4).alias("low"), "n")


@query(f"{_RATE} SELECT least(floor(conf * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(conf), 6) AS mean_p, round(avg((human_label = judge_label)::INTEGER), 6) AS share FROM q GROUP BY ALL")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.ratings(spark, sf_dir).withColumn("ok", (F.col("human_label") == F.col("judge_label")).cast("int"))
    return rounded(sinks.reliability(r, "ok", "judge_confidence"))


@query("SELECT 5000::BIGINT AS cases, 0::BIGINT AS differing")
def score_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to write the Mayo score, compared on 5000 cases."""
    i = F.col("id")
    age, smoker, mm = 40 + i % 45, i % 2, 4 + (i % 260) / 10
    one = shaping.mayo_probability(age, smoker, F.lit(0), mm, F.lit(1), F.lit(0))
    odds = F.exp(F.lit(-6.8272 + 1.0407)) * F.exp(0.0391 * age) * F.exp(0.7917 * smoker) * F.exp(0.1274 * mm)
    return shaping.same_everywhere(spark, 5000, one, odds / (1 + odds)).select("cases", "differing")


@query(f"{_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM q) SELECT count(*) AS n, round(sum(k) FILTER (WHERE y = 1), 4) AS rank_sum FROM r")
def rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_rank(_numbered(spark, sf_dir), "s", "k").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("y") == 1, F.col("k"))), 4).alias("rank_sum"))


# --- whole groups held out or resampled


@query(f"WITH g AS (SELECT source, count(*) AS n, sum((quality = (n_chars >= 1000)::INTEGER)::INTEGER) AS hits FROM labels JOIN documents USING (doc_id) GROUP BY source), i AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS m FROM g), d AS (SELECT rep, ('0x' || substr(md5('42:' || rep || ':' || i), 1, 8))::BIGINT % m AS i FROM range({REPLICATES}) x(rep), i), a AS (SELECT rep, sum(hits) / sum(n) AS v FROM d JOIN i USING (i) GROUP BY rep) SELECT count(*) AS replicates, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM a")
def bootstrap_ci_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of the accuracy when whole sources are drawn, not rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    hit = F.col("quality") == (F.col("n_chars") >= 1000).cast("int")
    sums = table(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum(hit.cast("int")).alias("hits"))
    a = metrics.group_draws(sums, "source", REPLICATES).groupBy("rep").agg((F.sum("hits") / F.sum("n")).alias("v"))
    return rounded(metrics.percentile_interval(a, "v"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with counts of their characters, lines and marks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("chars"), F.size(F.split(text, "\n")).cast("double").alias("lines"), F.length(F.regexp_replace(text, "[^#*$%&|<>]", "")).cast("double").alias("marks"))
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id").persist()  # read again by every fit; numbers of labelled rows only


@query()
def external_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of the English documents' quality, tried on those in other languages."""
    rows = _measured(spark, sf_dir)
    out = models.external_validation(rows.filter("lang = 'en'"), rows.filter("lang <> 'en'"), "doc_id", ["chars", "lines", "marks"], "quality")
    return rounded(spark.createDataFrame([(part, name, float(v)) for part, values in out.items() for name, v in values.items() if isinstance(v, (int, float))], "part string, metric string, value double"))


@query()
def split_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced accuracy under random splits, and with whole sources held out."""
    rows = models.aligned(_measured(spark, sf_dir), ["chars", "lines", "marks"])
    out = models.split_comparison(rows, "doc_id", "features_array", "quality", "source")
    return rounded(spark.createDataFrame([(k, v["mean"], v["std"], v["n"]) for k, v in out.items() if v], "split string, mean double, std double, n long"))

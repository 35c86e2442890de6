"""Standardised feature geometry: class centroids, distances, and the exact distance to a change of decision.

Only constants of size d, k x d and k x k reach the driver; rows are scored where they lie, against
literals, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestar.functions.labels import is_blank
from lodestar.operators import metrics

#: Columns of less variance are constant.
LEAST_VARIANCE = 1e-12


def long_form(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """keys, pos, v: one row for each value of a vector."""
    return df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "v"))


def moments(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """keys, pos, n, mean, m2 (sum of squared deviations): a mergeable partial aggregate."""
    return long_form(df, vector, *keys).groupBy(*keys, "pos").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"))


def merged_moments(parts: DataFrame) -> DataFrame:
    """pos, n, mean, sd over parts, by the parallel rule: within-part deviations plus those of the parts' means."""
    total = parts.groupBy("pos").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("inner"))
    between = parts.join(total.select("pos", F.col("mean").alias("centre")), "pos").groupBy("pos").agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("centre"), 2)).alias("outer"))
    return total.join(between, "pos").select("pos", "n", "mean", F.sqrt((F.col("inner") + F.col("outer")) / F.col("n")).alias("sd"))


@dataclass
class Fit:
    """Constants of a fit: kept positions, their means and deviations, classes in text order, standardised centroids, metric."""

    kept: list[int]
    mean: np.ndarray
    sd: np.ndarray
    classes: list[str]
    centroids: np.ndarray
    metric: np.ndarray | None = None

    def separation(self) -> np.ndarray:
        d = self.centroids[:, None, :] - self.centroids[None, :, :]
        return np.sqrt(np.einsum("abi,ij,abj->ab", d, np.eye(len(self.kept)) if self.metric is None else self.metric, d))


def non_finite(df: DataFrame, vector: str) -> list[int]:
    """Positions that hold NaN or infinity; a fit refuses them."""
    bad = F.isnan("v") | F.col("v").isin(float("inf"), float("-inf"))
    return [r.pos for r in long_form(df, vector).filter(bad).select("pos").distinct().orderBy("pos").collect()]


def fit(df: DataFrame, vector: str, label: str, mahalanobis: bool = False, ridge: float = 1e-6, shrink: str = "ledoit_wolf") -> Fit:
    """Standardise by all rows (population deviation), drop constants, average by class: one aggregate by class and position, rows without a class included."""
    bad = F.count_if(F.isnan("v") | F.col("v").isin(float("inf"), float("-inf")))
    rows = long_form(df.withColumn("_class", F.col(label).cast("string")), vector, "_class").groupBy("_class", "pos").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"), bad.alias("bad")).collect()  # classes x d
    if wrong := sorted({r.pos for r in rows if r.bad}):
        raise ValueError(f"values that are not finite at positions {wrong[:5]}")
    stats = {}
    for pos in sorted({r.pos for r in rows}):
        parts = [(r.n, r["mean"], r.m2) for r in rows if r.pos == pos and r.n]
        n = sum(p[0] for p in parts)
        if n:
            centre = sum(p[0] * p[1] for p in parts) / n
            stats[pos] = centre, sum(p[2] + p[0] * (p[1] - centre) ** 2 for p in parts) / n
    kept = sorted(p for p, (_, var) in stats.items() if var > LEAST_VARIANCE)
    mean, sd = np.array([stats[p][0] for p in kept]), np.sqrt([stats[p][1] for p in kept])
    classes = sorted({r["_class"] for r in rows if r["_class"] is not None})
    at = {(r["_class"], r.pos): r["mean"] for r in rows}
    centroids = np.array([[at[c, p] for p in kept] for c in classes]).reshape(len(classes), len(kept))
    out = Fit(kept, mean, sd, classes, (centroids - mean) / sd)
    if mahalanobis:
        out.metric = precision(df, vector, out, ridge, shrink)
    return out


def gramians(df: DataFrame, vector: str, centre: np.ndarray, *keys: str) -> DataFrame:
    """keys, n, sum, gram (d x d, flat), fourth (sum of squared norms squared) of the vectors less `centre`: numpy products, added up in a partition before anything is sent."""
    schema = df.select(*keys).schema.add("n", "long").add("sum", T.ArrayType(T.DoubleType())).add("gram", T.ArrayType(T.DoubleType())).add("fourth", "double")
    d, names = len(centre), list(keys)

    def add(held: dict, key: tuple, parts: tuple) -> None:
        held[key] = tuple(x + y for x, y in zip(held[key], parts, strict=True)) if key in held else parts

    def rows(held: dict) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k in held], pa.from_numpy_dtype(np.dtype("int64")) if all(isinstance(k[i], int) for k in held) else None) for i in range(len(names))]
        arrow = to_arrow_schema(schema)
        cols += [pa.array([v[0] for v in held.values()]), pa.array([v[1].tolist() for v in held.values()]), pa.array([v[2].reshape(-1).tolist() for v in held.values()]), pa.array([float(v[3]) for v in held.values()])]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            x = np.array(batch.column("_x").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d) - centre
            values = list(zip(*(batch.column(k).to_pylist() for k in names), strict=True)) if names else [()] * batch.num_rows
            for key in dict.fromkeys(values):
                own = x if not names else x[[v == key for v in values]]
                add(held, key, (len(own), own.sum(0), own.T @ own, float(((own * own).sum(1) ** 2).sum())))
        if held:
            yield rows(held)

    def total(table: pa.Table) -> pa.Table:
        held: dict = {}
        for r in table.to_pylist():
            add(held, tuple(r[k] for k in names), (r["n"], np.array(r["sum"]), np.array(r["gram"]).reshape(d, d), r["fourth"]))
        return pa.Table.from_batches([rows(held)])

    parts = df.filter(F.col(vector).isNotNull()).select(*keys, F.col(vector).cast("array<double>").alias("_x")).mapInArrow(partial, schema)
    return parts.groupBy(*keys).applyInArrow(total, schema)  # a row for each partition and key


def scatter(df: DataFrame, vector: str, fitted: Fit) -> tuple[np.ndarray, int, float]:
    """Covariance of the standardised vectors (d x d), their number, and the sum of their squared norms squared."""
    z = df.filter(F.col(vector).isNotNull()).select(standardised(vector, fitted).alias("_z"))
    d = len(fitted.kept)
    r = gramians(z, "_z", np.zeros(d)).first()
    return (np.array(r.gram).reshape(d, d) / r.n, r.n, r.fourth) if r else (np.zeros((d, d)), 0, 0.0)


def oas(cov: np.ndarray, n: int) -> float:
    """Oracle-approximating shrinkage."""
    d, t, t2 = len(cov), float(np.trace(cov)), float((cov * cov).sum())
    below = (n + 1) * (t2 - t * t / d)
    return 1.0 if below <= 0 else min(1.0, (t2 + t * t) / below)


def ledoit_wolf(cov: np.ndarray, n: int, fourth: float) -> float:
    """Shrinkage towards the mean variance, from the covariance of centred vectors and the sum of their squared norms squared."""
    d = len(cov)
    mu, square = float(np.trace(cov)) / d, float((cov * cov).sum())
    spread = square - d * mu * mu
    noise = min(max((fourth / n - square) / n, 0.0), spread)
    return noise / spread if spread > 0 else 0.0


def precision(df: DataFrame, vector: str, fitted: Fit, ridge: float = 1e-6, shrink: str = "ledoit_wolf") -> np.ndarray:
    """Inverse of the shrunk covariance of the standardised vectors; where that is singular, of the covariance with a ridge."""
    cov, n, fourth = scatter(df, vector, fitted)
    d = len(cov)
    if shrink == "oas":
        share = oas(cov, n)
        return np.linalg.pinv((1 - share) * cov + (share + ridge) * np.eye(d))
    share = ledoit_wolf(cov, max(n, 1), fourth)
    shrunk = (1 - share) * cov + share * float(np.trace(cov)) / max(d, 1) * np.eye(d)
    try:
        return np.linalg.inv(shrunk)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(cov + ridge * np.eye(d))


def literal(values: np.ndarray) -> Column:
    if values.ndim == 1:
        return F.array(*(F.lit(float(v)) for v in values))
    return F.array(*(literal(v) for v in values))


def standardised(vector: str, fitted: Fit) -> Column:
    c = F.col(vector).cast("array<double>")
    if len(fitted.kept) == 0:
        return F.array().cast("array<double>")
    chosen = F.transform(F.array(*(F.lit(p) for p in fitted.kept)), lambda p: F.get(c, p))
    return F.zip_with(F.zip_with(chosen, literal(fitted.mean), lambda x, m: x - m), literal(fitted.sd), lambda x, s: x / s)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def squared_distances(z: Column, centroids: np.ndarray) -> Column:
    """To each centroid."""
    return F.transform(literal(centroids), lambda c: _total(F.zip_with(z, c, lambda x, y: (x - y) * (x - y))))


def turned(df: DataFrame, vector: str, fitted: Fit, root: np.ndarray, *keys: str) -> DataFrame:
    """keys, _z: standardised vectors in a space in which the metric's distances are Euclidean, as numpy products of batches."""
    schema = df.select(*keys).schema.add("_z", T.ArrayType(T.DoubleType()))
    kept, mean, sd = list(fitted.kept), fitted.mean, fitted.sd

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").to_pylist()
            z = [None if v is None else (((np.array(v, float)[kept] - mean) / sd) @ root.T).tolist() for v in x]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(z, pa.list_(pa.float64()))], names=[*keys, "_z"])

    return df.select(*keys, F.col(vector).cast("array<double>").alias("_x")).mapInArrow(run, schema)


def contestability(df: DataFrame, vector: str, fitted: Fit, *keys: str) -> DataFrame:
    """keys, distances by class (array), nearest, runner_up, flip_distance, decisive_feature, single_axis_flip.

    The nearest class is the first of equally near ones in text order. The flip distance is the
    least over the other classes of (d_k^2 - d_a^2) / (2 |c_k - c_a|), not below 0; a class whose
    centroid coincides with the nearest one's is infinitely far.
    """
    k, d = len(fitted.classes), len(fitted.kept)
    apart = fitted.separation()
    metric = np.eye(d) if fitted.metric is None else fitted.metric
    lever, steep = np.zeros((k, k), int), np.zeros((k, k))
    for a in range(k):
        for b in range(k):
            g = np.abs(metric @ (fitted.centroids[a] - fitted.centroids[b]))
            weight = g / np.sqrt(np.diag(metric))
            lever[a, b] = int(np.argmax(weight)) if d else 0
            steep[a, b] = weight[lever[a, b]] if d else 0.0
    if fitted.metric is None:
        z, centroids = df.select(*keys, standardised(vector, fitted).alias("_z")), fitted.centroids
    else:
        root = np.linalg.cholesky(fitted.metric + 1e-15 * np.eye(d)).T
        z, centroids = turned(df, vector, fitted, root, *keys), fitted.centroids @ root.T
    d2 = z.select(*keys, squared_distances(F.col("_z"), centroids).alias("_d"))
    near = d2.withColumn("_a", F.array_position("_d", F.array_min("_d")).cast("int") - 1)
    row = F.get(literal(apart), F.col("_a"))
    own = F.get(F.col("_d"), F.col("_a"))
    flips = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when((i == F.col("_a")) | (F.get(row, i) <= 0), F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.0), F.try_divide(F.get(F.col("_d"), i) - own, 2 * F.get(row, i)))))
    out = near.withColumn("_f", flips)
    out = out.withColumn("flip_distance", F.array_min("_f")).withColumn("_b", F.array_position("_f", F.col("flip_distance")).cast("int") - 1)
    names = F.array(*(F.lit(c) for c in fitted.classes))
    pair = lambda m: F.get(F.get(literal(m.astype(float)), F.col("_a")), F.col("_b"))
    # with one class, or centroids that coincide, there is no border: infinitely far, and no runner-up
    near_none = ~(F.col("flip_distance") < float("inf"))
    single = F.when(near_none, F.lit(float("inf"))).otherwise(F.coalesce(F.try_divide(F.get(F.col("_d"), F.col("_b")) - own, 2 * pair(steep)), F.lit(float("inf"))))
    kept = F.array(*(F.lit(p) for p in fitted.kept)) if d else F.array(F.lit(-1))
    made = out.select(*keys, F.transform("_d", lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))).alias("distances"), F.get(names, F.col("_a")).alias("nearest"), F.when(~near_none, F.get(names, F.col("_b"))).alias("runner_up"), "flip_distance", F.when(~near_none, F.get(kept, pair(lever).cast("int"))).alias("decisive_feature"), single.alias("single_axis_flip"))
    # one generator row per row: a caller's filter stays above it, instead of being pushed down and computing all arrays again
    return made.select(F.explode_outer(F.array(F.struct(*made.columns))).alias("_s")).select("_s.*")


def leverage(fitted: Fit) -> dict[tuple[str, str], np.ndarray]:
    """Shares of each feature in the border of each pair of classes."""
    metric = np.eye(len(fitted.kept)) if fitted.metric is None else fitted.metric
    out = {}
    for a, x in enumerate(fitted.classes):
        for b, y in enumerate(fitted.classes):
            w = np.abs(metric @ (fitted.centroids[a] - fitted.centroids[b])) / np.sqrt(np.diag(metric))
            out[x, y] = w / w.sum() if w.sum() else w
    return out


def leverage_share(spark, assigned: DataFrame, fitted: Fit) -> DataFrame:
    """pos, share: the mean over rows of each feature's share, by counts of (nearest, runner_up) pairs."""
    rows = [(a, b, p, float(v)) for (a, b), shares in leverage(fitted).items() for p, v in zip(fitted.kept, shares, strict=True)]
    shares = spark.createDataFrame(rows, "nearest string, runner_up string, pos int, share double")  # k * k * d rows
    pairs = assigned.groupBy("nearest", "runner_up").count()
    return pairs.join(shares, ["nearest", "runner_up"]).groupBy("pos").agg((F.sum(F.col("share") * F.col("count")) / F.sum("count")).alias("share"))


def contested(assigned: DataFrame, quantile: float = 0.1) -> DataFrame:
    """assigned with `contested`: flip distance at most the quantile of the finite ones, ties included."""
    finite = assigned.filter(F.col("flip_distance") < float("inf"))
    threshold = metrics.exact_quantile(finite, "flip_distance", quantile)
    return assigned.withColumn("contested", (F.col("flip_distance") < float("inf")) & (F.col("flip_distance") <= F.lit(threshold)) if threshold is not None else F.lit(False))


def flip_summary(flagged: DataFrame) -> DataFrame:
    f = F.col("flip_distance")
    finite = flagged.filter(f < float("inf"))
    median = F.lit(metrics.exact_quantile(finite, "flip_distance", 0.5)).cast("double")
    return finite.agg(F.count("*").alias("n_scored"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std"), F.min(f).alias("min"), median.alias("median"), F.max(f).alias("max"), F.count_if("contested").alias("n_contested"))


#: The shared histogram of flip distances: bins of this width up to the last edge; the last bin is closed.
BIN, BINS = 0.25, 32


def flip_bin(flip: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(F.least(flip, F.lit(BIN * BINS)) / BIN)).cast("int")


def flip_histogram(assigned: DataFrame, *keys: str) -> DataFrame:
    """keys, bin, n: counts that sites can add up."""
    return assigned.filter(F.col("flip_distance") < float("inf")).groupBy(*keys, flip_bin(F.col("flip_distance")).alias("bin")).agg(F.count("*").alias("n"))


def histogram_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """threshold, n_below: linear inside the first bin whose running count reaches q of all. At most BINS rows are windowed."""
    from pyspark.sql import Window

    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram.groupBy("bin").agg(F.sum("n").alias("n"))
    h = h.withColumn("upto", F.sum("n").over(w)).crossJoin(F.broadcast(h.agg(F.sum("n").alias("total"))))
    hit = h.filter(F.col("upto") >= F.lit(q) * F.col("total")).orderBy("bin").limit(1)
    inside = (F.lit(q) * F.col("total") - (F.col("upto") - F.col("n"))) / F.col("n")
    return hit.select(((F.col("bin") + inside) * BIN).alias("threshold"), F.round(F.lit(q) * F.col("total")).cast("long").alias("n_below"))


def node_contestability(df: DataFrame, key: str, vector: str, label: str, fitted: Fit, quantile: float = 0.1) -> DataFrame:
    """ID, nearest_class_centroid, runner_up_class, flip_distance, contested, most_decision_relevant_feature, single_axis_flip_distance, dist_to_<class>, outcome, nearest_matches_outcome (null without an outcome)."""
    rows = contested(contestability(df.select(F.col(key).cast("string").alias("ID"), vector, F.when(~is_blank(F.col(label)), F.col(label).cast("string")).alias("outcome")), vector, fitted, "ID", "outcome"), quantile)
    far = [F.get("distances", F.lit(i)).alias(f"dist_to_{c}") for i, c in enumerate(fitted.classes)]
    return rows.select("ID", F.col("nearest").alias("nearest_class_centroid"), F.col("runner_up").alias("runner_up_class"), "flip_distance", "contested", F.col("decisive_feature").alias("most_decision_relevant_feature"), F.col("single_axis_flip").alias("single_axis_flip_distance"), *far, "outcome", (F.col("nearest") == F.col("outcome")).alias("nearest_matches_outcome"))


def most_contested(assigned: DataFrame, n: int = 10) -> DataFrame:
    """The n rows with the least flip distance, ties by ID: a report of n rows."""
    return assigned.orderBy("flip_distance", "ID").limit(n)


def leverage_ranking(spark, assigned: DataFrame, fitted: Fit) -> DataFrame:
    """leverage_share in falling order, ties by position."""
    return leverage_share(spark, assigned, fitted).orderBy(F.desc("share"), "pos")


def contest_summary(spark, rows: DataFrame, assigned: DataFrame, fitted: Fit, quantile: float = 0.1) -> dict:
    """Of node_contestability's rows and contestability's rows with the same fit."""
    f = flip_summary(rows).first()
    ups = {r[0]: r[1] for r in rows.filter("runner_up_class is not null").groupBy("runner_up_class").count().orderBy("runner_up_class").collect()}
    threshold = rows.filter("contested").agg(F.max("flip_distance")).first()[0]
    lever = [{"feature": r.pos, "share": r.share} for r in leverage_ranking(spark, assigned, fitted).collect()]
    return {"distance_metric": "euclidean" if fitted.metric is None else "mahalanobis", "n_scored": f.n_scored, "n_classes": len(fitted.classes), "classes": fitted.classes, "n_features": len(fitted.kept), "feature_columns": fitted.kept, "flip_distance": {"mean": f["mean"], "std": f["std"], "min": f["min"], "median": f["median"], "max": f["max"], "contest_quantile": quantile, "contest_threshold": threshold, "n_contested": f.n_contested}, "runner_up_counts": ups, "feature_leverage": lever, "caveats": ["A flip distance is a property of this fit, not of a case.", "Distances depend on the features that were chosen."]}

"""A fit and its contestability over sites that send aggregates only, never rows.

A site's message has n, sums, centred moments and co-moments, counts and sums by class. Messages are
put together in the order of the sites' names by the parallel rule for moments, so the pooled fit
equals the one that all rows would give, up to rounding. What reaches the driver is one row a site.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.labels import is_blank
from lodestar.operators import geometry


def site_aggregates(df: DataFrame, vector: str, label: str, site: str) -> DataFrame:
    """site, n, sum, mean, m2, comoment (d x d, flat, about the site's mean), class_n, class_sum; rows without a class count for the moments alone."""
    named = df.select(F.col(site).cast("string").alias("site"), F.col(vector).cast("array<double>").alias("_v"), F.when(~is_blank(F.col(label)), F.col(label).cast("string")).alias("_class"))
    centre = {r.pos: r["mean"] for r in geometry.moments(named, "_v").collect()}  # d rows; products about it keep their digits
    at = np.array([centre[p] for p in sorted(centre)])
    grams = geometry.gramians(named, "_v", at, "site")
    d = len(at)
    mean = F.zip_with(F.transform("sum", lambda s: s / F.col("n")), geometry.literal(at) if d else F.array().cast("array<double>"), lambda x, c: x + c)
    flat = F.transform("gram", lambda g, i: g - F.get("sum", F.floor(i / d).cast("int")) * F.get("sum", (i % d).cast("int")) / F.col("n"))
    moments = grams.select("site", "n", mean.alias("mean"), flat.alias("comoment"))
    moments = moments.select("site", "n", F.transform("mean", lambda m: m * F.col("n")).alias("sum"), "mean", F.transform(F.sequence(F.lit(0), F.lit(max(d - 1, 0))), lambda i: F.get("comoment", (i * (d + 1)).cast("int"))).alias("m2"), "comoment")
    cells = geometry.long_form(named.filter("_class is not null"), "_v", "site", "_class").groupBy("site", "_class", "pos").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    vectors = cells.groupBy("site", "_class").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("sums"), F.max("n").alias("n"))
    maps = vectors.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("_class", "n"))).alias("class_n"), F.map_from_entries(F.collect_list(F.struct("_class", "sums"))).alias("class_sum"))
    return moments.join(maps, "site", "left")


def messages(sites: DataFrame) -> list[dict]:
    """One message a site, in the order of their names."""
    return [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in sites.orderBy("site").collect()]


@dataclass
class Pooled:
    """A pooled fit and what it stands on."""

    fit: geometry.Fit
    n_total: int
    class_counts: dict[str, int]
    cov_standardized: np.ndarray
    shrinkage: float
    shrinkage_method: str = "oas"


def combine_aggregates(sent: list[dict], ridge: float = 1e-6) -> Pooled:
    """The pooled fit of site messages; what a gate took out of a message is not in it."""
    if not sent:
        raise ValueError("no messages")
    width = {len(m["mean"]) for m in sent}
    if len(width) != 1:
        raise ValueError("sites differ in their columns")
    d = width.pop()
    n, mean, comoment = 0, np.zeros(d), np.zeros((d, d))
    counts: dict[str, int] = {}
    sums: dict[str, np.ndarray] = {}
    for m in sorted(sent, key=lambda m: m["site"]):
        k, own = m["n"], np.array(m["mean"], float)
        delta = own - mean
        comoment = comoment + np.array(m["comoment"], float).reshape(d, d) + np.outer(delta, delta) * n * k / max(n + k, 1)
        mean, n = mean + delta * k / max(n + k, 1), n + k
        for c, x in (m.get("class_n") or {}).items():
            counts[c] = counts.get(c, 0) + x
            sums[c] = sums.get(c, np.zeros(d)) + np.array(m["class_sum"][c], float)
    variance = np.diag(comoment) / n
    kept = [p for p in range(d) if variance[p] > geometry.LEAST_VARIANCE]
    sd = np.sqrt(variance[kept])
    classes = sorted(counts)
    centroids = np.array([(sums[c][kept] / counts[c] - mean[kept]) / sd for c in classes]).reshape(len(classes), len(kept))
    cov = (comoment / n)[np.ix_(kept, kept)] / np.outer(sd, sd)
    share = geometry.oas(cov, n)
    inverse = np.linalg.pinv((1 - share) * cov + (share + ridge) * np.eye(len(kept)))
    return Pooled(geometry.Fit(kept, mean[kept], sd, classes, centroids, inverse), n, counts, cov, share)


def centralized_fit(df: DataFrame, vector: str, label: str, ridge: float = 1e-6) -> geometry.Fit:
    """The fit of all rows at once."""
    return geometry.fit(df.withColumn("_label", F.when(~is_blank(F.col(label)), F.col(label).cast("string"))), vector, "_label", mahalanobis=True, ridge=ridge, shrink="oas")


def simulate(df: DataFrame, vector: str, label: str, site: str) -> tuple[Pooled, dict[str, float]]:
    """The pooled fit over df's sites, and the largest difference of each quantity from the central fit."""
    pooled, central = combine_aggregates(messages(site_aggregates(df, vector, label, site))), centralized_fit(df, vector, label)
    if (pooled.fit.kept, pooled.fit.classes) != (central.kept, central.classes):
        raise ValueError("pooled and central fit differ in columns or classes")
    gap = lambda a, b: float(np.abs(a - b).max()) if a.size else 0.0
    return pooled, {k: gap(getattr(pooled.fit, k), getattr(central, k)) for k in ("mean", "sd", "centroids", "metric")}


def local_flip_distances(df: DataFrame, vector: str, fitted: geometry.Fit, *keys: str) -> DataFrame:
    """A site's rows against a fit that it was sent."""
    return geometry.contestability(df, vector, fitted, *keys)


def site_contestability(df: DataFrame, vector: str, label: str, fitted: geometry.Fit, site: str) -> DataFrame:
    """site, n, flip_count, flip_sum, flip_sumsq, flip_min, flip_max, flip_hist, runner_up_counts, leverage_sum, leverage_n, agree_count, labeled_count."""
    rows = df.select(F.col(site).cast("string").alias("site"), F.col(vector).alias("_v"), F.when(~is_blank(F.col(label)), F.col(label).cast("string")).alias("_class"))
    a = geometry.contestability(rows, "_v", fitted, "site", "_class")
    f, finite = F.col("flip_distance"), F.col("flip_distance") < float("inf")
    own = F.when(finite, f)
    bins = geometry.flip_bin(f)
    hist = F.array(*(F.count_if(finite & (bins == b)) for b in range(geometry.BINS)))
    one = a.groupBy("site").agg(F.count("*").alias("n"), F.count_if(finite).alias("flip_count"), F.coalesce(F.sum(own), F.lit(0.0)).alias("flip_sum"), F.coalesce(F.sum(own * own), F.lit(0.0)).alias("flip_sumsq"), F.min(own).alias("flip_min"), F.max(own).alias("flip_max"), hist.alias("flip_hist"), F.count("*").alias("leverage_n"), F.count_if(F.col("nearest") == F.col("_class")).alias("agree_count"), F.count("_class").alias("labeled_count"))
    pairs = a.groupBy("site", "nearest", "runner_up").agg(F.count("*").alias("k"))  # classes squared a site
    ups = pairs.filter("runner_up is not null").groupBy("site", "runner_up").agg(F.sum("k").alias("k")).groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("runner_up", "k"))).alias("runner_up_counts"))
    d = len(fitted.kept)
    shares = [(x, y, v.tolist()) for (x, y), v in geometry.leverage(fitted).items()]
    share = df.sparkSession.createDataFrame(shares, "nearest string, runner_up string, share array<double>")
    lever = pairs.join(F.broadcast(share), ["nearest", "runner_up"]).groupBy("site").agg(F.array(*(F.sum(F.col("k") * F.col("share")[i]) for i in range(d))).alias("leverage_sum"))
    return one.join(ups, "site", "left").join(lever, "site", "left")


def combine_contestability(sent: list[dict], fitted: geometry.Fit, quantile: float = 0.1) -> dict:
    """The summary over all sites: sums are exact, the threshold is read off the shared histogram; extremes are none where a gate withheld them."""
    total = lambda k: sum(m.get(k) or 0 for m in sent)
    n = total("flip_count")
    mean = total("flip_sum") / n if n else None
    std = float(np.sqrt(max(total("flip_sumsq") / n - mean * mean, 0.0))) if n else None
    hist = np.sum([m["flip_hist"] for m in sent], axis=0) if sent else np.zeros(geometry.BINS)
    upto, threshold, below = np.cumsum(hist), None, None
    want = quantile * hist.sum()
    if hist.sum():
        b = int(np.argmax(upto >= want))
        threshold, below = float((b + (want - (upto[b] - hist[b])) / max(hist[b], 1)) * geometry.BIN), int(round(want))
    ups: dict[str, int] = {}
    for m in sent:
        for c, k in (m.get("runner_up_counts") or {}).items():
            ups[c] = ups.get(c, 0) + k
    lever = np.sum([m["leverage_sum"] for m in sent if m.get("leverage_sum")], axis=0) / max(total("leverage_n"), 1)
    ends = lambda k, pick: pick(v) if len(v := [m[k] for m in sent if m.get(k) is not None]) == len(sent) and v else None
    flip = {"mean": mean, "std": std, "min": ends("flip_min", min), "max": ends("flip_max", max), "contest_quantile": quantile, "approx_contest_threshold": threshold, "approx_n_contested": below}
    order = np.argsort(-np.atleast_1d(lever), kind="stable")
    voi = [{"feature": fitted.kept[i], "share": float(np.atleast_1d(lever)[i])} for i in order] if fitted.kept else []
    return {"n_scored": total("n"), "flip_distance": flip, "runner_up_counts": dict(sorted(ups.items())), "feature_voi": voi, "nearest_centroid_agreement": total("agree_count") / total("labeled_count") if total("labeled_count") else None}


def simulate_contestability(df: DataFrame, vector: str, label: str, site: str, quantile: float = 0.1) -> tuple[dict, dict[str, float]]:
    """The pooled summary over df's sites with the pooled Euclidean fit, and its differences from that of all rows."""
    pooled = combine_aggregates(messages(site_aggregates(df, vector, label, site))).fit
    pooled.metric = None
    out = combine_contestability(messages(site_contestability(df, vector, label, pooled, site)), pooled, quantile)
    rows = geometry.contestability(df.withColumn("_label", F.col(label).cast("string")), vector, pooled, "_label")
    whole = geometry.flip_summary(geometry.contested(rows, quantile)).first()
    flip = out["flip_distance"]
    return out, {"mean": abs(flip["mean"] - whole["mean"]), "std": abs(flip["std"] - whole["std"]), "n_contested": abs(flip["approx_n_contested"] - whole["n_contested"])}


def balanced_sites(df: DataFrame, key: str, n_sites: int, seed: int = 42) -> DataFrame:
    """df with `site`: sites of sizes that differ by one at most, dealt out in hash order. Rows are numbered by ranges of the hash, never in one task."""
    from lodestar.operators import metrics

    order = df.withColumn("_h", metrics.hashed(seed, F.col(key)))
    cells = metrics.running(order.groupBy("_h").agg(F.count("*").alias("_n")), "_h", {"_below": "_n"}).select("_h", "_below")
    from pyspark.sql import Window

    within = F.row_number().over(Window.partitionBy("_h").orderBy(key)) - 1
    return order.join(cells, "_h").withColumn("site", F.pmod(F.col("_below") + within, F.lit(n_sites)).cast("int")).drop("_h", "_below")

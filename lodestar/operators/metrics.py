"""Outcome metrics and resampling, each as aggregates over rows that a replicate key may group."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of values that a running sum without groups is dealt out by.
RANGES = 64


def running(cells: DataFrame, value: str, sums: dict[str, str], by: tuple[str, ...] = (), descending: bool = False, inclusive: bool = False) -> DataFrame:
    """cells with running sums in the order of value (distinct within by): `sums` names a new column for each old one.

    Without groups no task gets all rows: values are dealt out by ranges with bounds from the data,
    summed inside a range, and the ranges before are added, of which there are RANGES at most.
    """
    order = F.desc(value) if descending else F.asc(value)
    end = 0 if inclusive else -1
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
        return cells.withColumns({new: F.coalesce(F.sum(old).over(w), F.lit(0)) for new, old in sums.items()})
    found = cells.agg(F.percentile_approx(F.col(value).cast("double"), [k / RANGES for k in range(1, RANGES)], 1000).alias("b")).first().b
    bounds = F.array(*(F.lit(float(x)) for x in sorted(set(found or [])))).cast("array<double>")
    ranged = cells.withColumn("_range", F.size(F.filter(bounds, lambda x: x < F.col(value).cast("double"))) * (-1 if descending else 1))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    totals = ranged.groupBy("_range").agg(*(F.sum(old).alias(f"_t_{new}") for new, old in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = totals.select("_range", *(F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_o_{new}") for new in sums))
    out = ranged.join(F.broadcast(offsets), "_range").withColumns({new: F.coalesce(F.sum(old).over(inside), F.lit(0)) + F.col(f"_o_{new}") for new, old in sums.items()})
    return out.drop("_range", *(f"_o_{new}" for new in sums))


def auroc(df: DataFrame, y: str, score: str, *by: str) -> DataFrame:
    """by, auroc; tied scores count half. Rows are first counted by score, so only distinct scores are ranked."""
    cells = df.groupBy(*by, score).agg(F.sum(F.col(y).cast("long")).alias("_p"), F.sum(1 - F.col(y).cast("long")).alias("_q"))
    ranked = running(cells, score, {"_below": "_q"}, by)
    u = F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2))
    return ranked.groupBy(*by).agg(F.try_divide(u, F.sum("_p") * F.sum("_q")).alias("auroc"))


def average_precision(df: DataFrame, y: str, score: str, *by: str) -> DataFrame:
    """by, average_precision: precision at each distinct score, weighted by the recall it adds."""
    cells = df.groupBy(*by, score).agg(F.sum(F.col(y).cast("long")).alias("_p"), F.count("*").alias("_n"))
    run = running(cells, score, {"_tp": "_p", "_seen": "_n"}, by, descending=True, inclusive=True)
    return run.groupBy(*by).agg(F.try_divide(F.sum(F.col("_p") * F.col("_tp") / F.col("_seen")), F.sum("_p")).alias("average_precision"))


def threshold_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """threshold, tp, fp, balanced_accuracy for predicting 1 from each distinct score on."""
    cells = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum(F.col(y).cast("long")).alias("_p"), F.sum(1 - F.col(y).cast("long")).alias("_q"))
    run = running(cells, "threshold", {"tp": "_p", "fp": "_q"}, descending=True, inclusive=True)
    total = F.broadcast(cells.agg(F.sum("_p").alias("_pp"), F.sum("_q").alias("_qq")))  # one row
    both = run.crossJoin(total)
    balanced = (F.try_divide("tp", "_pp") + 1 - F.try_divide("fp", "_qq")) / 2
    return both.select("threshold", "tp", "fp", balanced.alias("balanced_accuracy"))


def tuned_threshold(df: DataFrame, y: str, score: str) -> float:
    """The score from which predicting 1 has the best balanced accuracy; of equal ones the highest."""
    r = threshold_curve(df, y, score).agg(F.max_by("threshold", F.struct("balanced_accuracy", "threshold")).alias("t")).first()
    return 0.5 if r.t is None else float(r.t)


def exact_quantile(df: DataFrame, value: str, q: float, most: int = 1_000_000, bins: int = 1024) -> float | None:
    """The q-quantile of value, linear between order statistics, without all values in one buffer.

    While more than `most` rows are left, a histogram finds the bin that the two order statistics
    fall in, and only its rows go on.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    s = rows.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not s.n:
        return None
    n, low, high, at = s.n, s.low, s.high, q * (s.n - 1)
    while n > most and high > low:
        width = (high - low) / bins
        b = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int").alias("b")
        seen, lower, upper = 0, None, None
        for r in rows.groupBy(b).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect():  # `bins` rows
            if lower is None and seen + r.n > math.floor(at):
                lower, before = r, seen
            if lower is not None and seen + r.n > math.ceil(at):
                upper = r
                break
            seen += r.n
        if (lower.low, upper.high) == (low, high):
            break
        low, high, at = lower.low, upper.high, at - before
        rows = rows.filter(F.col("v").between(low, high))
        n = rows.count()
    if high == low:
        return low
    return rows.agg(F.percentile("v", F.lit(min(1.0, at / max(n - 1, 1)))).alias("p")).first().p


def label_metrics(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """accuracy, balanced_accuracy, weighted precision, recall and F1, mcc: all from one confusion table."""
    cells = df.groupBy(F.col(y).cast("string").alias("a"), F.col(predicted).cast("string").alias("b")).agg(F.count("*").alias("n"))
    labels = cells.select(F.col("a").alias("l")).union(cells.select("b")).distinct()
    t = labels.join(cells.groupBy(F.col("a").alias("l")).agg(F.sum("n").alias("t")), "l", "left").join(cells.groupBy(F.col("b").alias("l")).agg(F.sum("n").alias("p")), "l", "left").join(cells.filter("a = b").select(F.col("a").alias("l"), F.col("n").alias("c")), "l", "left").fillna(0)
    precision, recall = F.coalesce(F.try_divide("c", "p"), F.lit(0.0)), F.coalesce(F.try_divide("c", "t"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    s = t.agg(F.sum("t").alias("n"), F.sum("c").alias("c"), F.avg(F.when(F.col("t") > 0, recall)).alias("balanced_accuracy"), F.sum(F.col("t") * precision).alias("wp"), F.sum(F.col("t") * recall).alias("wr"), F.sum(F.col("t") * f1).alias("wf"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    n = F.col("n")
    below = F.sqrt((n * n - F.col("pp")).cast("double") * (n * n - F.col("tt")).cast("double"))
    return s.select((F.col("c") / n).alias("accuracy"), "balanced_accuracy", (F.col("wp") / n).alias("precision_weighted"), (F.col("wr") / n).alias("recall_weighted"), (F.col("wf") / n).alias("f1_weighted"), F.when(below > 0, (F.col("c") * n - F.col("tp")) / below).otherwise(0.0).alias("mcc"))


def average_rank(df: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    """df with the rank of value, ties averaged. Counts of distinct values are ranked, then joined back."""
    cells = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranks = running(cells, value, {"_below": "_n"}, by).select(*by, value, (F.col("_below") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_rank(average_rank(df.select(a, b), a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Limits of a share, clipped to [0, 1]."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def hashed(*parts: Column | int | str) -> Column:
    """32 bits of the md5 of the parts, which any engine repeats."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def draws(df: DataFrame, index: str, replicates: int, seed: int = 42) -> DataFrame:
    """df's rows resampled with replacement for each `rep`: the i-th place of replicate r takes row hash(seed, r, i) mod n. `index` numbers rows from 0."""
    n = df.count()
    rep = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("rep")
    places = df.select(F.col(index).cast("long").alias("_i"), rep)  # stated replicates of each row
    taken = places.select("rep", F.pmod(hashed(seed, F.col("rep"), F.col("_i")), F.lit(max(n, 1))).alias(index))
    return taken.join(df.withColumn(index, F.col(index).cast("long")), index)


def group_draws(df: DataFrame, group: str, replicates: int, seed: int = 42) -> DataFrame:
    """df's rows for each `rep`, with whole groups resampled with replacement: a group drawn twice gives its rows twice.

    Rows without a group are one group. Groups are numbered in one window, by their values; for a
    metric of sums, df is best a row of sums for each group.
    """
    known = df.select(group).distinct()
    numbered = known.withColumn("_g", (F.row_number().over(Window.orderBy(group)) - 1).cast("long"))
    drawn = draws(numbered.withColumnRenamed(group, "_own"), "_g", replicates, seed)
    return df.join(drawn, F.col(group).eqNullSafe(F.col("_own"))).select("rep", *(f"`{c}`" for c in df.columns))


def percentile_interval(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.count(value).alias("replicates"), F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def shuffled(df: DataFrame, index: str, label: str, replicates: int, seed: int = 42) -> DataFrame:
    """df's rows for each `rep`, with a permutation of all labels: the k-th row by `index` (numbers from 0) takes the label of the k-th in the replicate's hash order.

    A replicate is sorted by itself, so replicates spread over tasks.
    """
    rep = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("rep")
    drawn = df.select(F.col(index).alias("_i"), F.col(label).alias("_l"), rep)
    order = Window.partitionBy("rep").orderBy(hashed(seed, F.col("rep"), F.col("_i")), "_i")
    moved = drawn.select("rep", (F.row_number().over(order) - 1).cast("long").alias(index), F.col("_l").alias(label))
    return moved.join(df.drop(label).withColumn(index, F.col(index).cast("long")), index).select("rep", *df.columns)


def permutation_p(observed: DataFrame, null: DataFrame, value: str, smaller: bool = False) -> DataFrame:
    """p_value: (1 + null values at least as extreme) / (null values + 1)."""
    both = null.select(F.col(value).alias("_v")).crossJoin(F.broadcast(observed.select(F.col(value).alias("_o"))))  # one row
    extreme = F.col("_v") <= F.col("_o") if smaller else F.col("_v") >= F.col("_o")
    return both.agg(F.first("_o").alias("observed"), F.count("_v").alias("permutations"), ((F.count_if(extreme) + 1) / (F.count("_v") + 1)).alias("p_value"))


def nadeau_bengio(df: DataFrame, difference: str, test_share: float, alpha: float = 0.05) -> DataFrame:
    """k, mean, se, low, high of paired differences over repeated splits, corrected for shared training rows; limits by Student's t with k - 1 degrees."""
    rho = test_share / (1 - test_share)
    one = df.agg(F.count(difference).alias("k"), F.avg(difference).alias("mean"), F.sqrt((1 / F.count(difference) + F.lit(rho)) * F.var_samp(difference)).alias("se"))
    k = one.first().k
    t = F.lit(t_quantile(1 - alpha / 2, k - 1) if k > 1 else None).cast("double")
    return one.select("k", "mean", "se", (F.col("mean") - t * F.col("se")).alias("low"), (F.col("mean") + t * F.col("se")).alias("high"))


def wilcoxon(differences: list[float]) -> float:
    """Two-sided p of the signed-rank test: exact up to 25 differences without ties, else normal with a correction for ties; 1 where all are 0."""
    d = np.array([x for x in differences if x and not math.isnan(x)])
    if not len(d):
        return 1.0
    size, n = np.abs(d), len(d)
    _, at, count = np.unique(size, return_inverse=True, return_counts=True)
    upto = np.cumsum(count)
    rank = (upto - (count - 1) / 2)[at]
    w = float(min(rank[d > 0].sum(), rank[d < 0].sum()))
    if n <= 25 and (count == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r]
        return min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - float((count**3 - count).sum()) / 48)
    return math.erfc(abs(w - n * (n + 1) / 4) / sd / math.sqrt(2)) if sd else 1.0


def t_quantile(p: float, df: float) -> float:
    """Student-t quantile by bisection on the regularised incomplete beta function."""

    def beta_fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    def cdf(t: float) -> float:
        x = df / (df + t * t)
        a, b = df / 2, 0.5
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
        tail = front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b
        return 1 - tail / 2 if t > 0 else tail / 2

    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2

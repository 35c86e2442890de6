"""Rater agreement, calibration and conformal sets over rating tables."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.labels import is_blank


def aligned(human: DataFrame, judge: DataFrame, item: str = "item_id", a: str = "human_label", b: str = "judge_label") -> DataFrame:
    """human left-joined to judge, only items that both have labelled, labels as text."""
    both = human.join(judge, item, "left")
    return both.filter(~is_blank(F.col(a)) & ~is_blank(F.col(b))).withColumns({a: F.col(a).cast("string"), b: F.col(b).cast("string")})


def confusion(pairs: DataFrame, a: str = "human_label", b: str = "judge_label") -> DataFrame:
    """a, b, n over the full grid of labels seen on either side."""
    labels = pairs.select(F.col(a).alias("l")).union(pairs.select(b)).distinct()
    grid = labels.select(F.col("l").alias(a)).crossJoin(F.broadcast(labels.select(F.col("l").alias(b))))  # label vocabularies, not rows
    return grid.join(pairs.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").fillna(0, ["n"])


def kappa(pairs: DataFrame, a: str = "human_label", b: str = "judge_label") -> DataFrame:
    """n_items, raw_agreement, cohens_kappa (null without items or when chance agreement is 1)."""
    cells = confusion(pairs, a, b)
    total = cells.agg(F.sum("n").alias("n_items"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col(a).alias("l")).agg(F.sum("n").alias("x"))
    right = cells.groupBy(F.col(b).alias("l")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "l").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.try_divide("same", "n_items"), F.try_divide("xy", F.col("n_items") * F.col("n_items"))
    return total.crossJoin(chance).select("n_items", po.alias("raw_agreement"), F.when(F.abs(1 - pe) > 1e-12, (po - pe) / (1 - pe)).alias("cohens_kappa"))


def alpha_two(pairs: DataFrame, a: str = "human_label", b: str = "judge_label") -> DataFrame:
    """krippendorff_alpha of two raters over nominal labels; null under two labels."""
    pooled = pairs.select(F.col(a).alias("l")).union(pairs.select(b)).groupBy("l").agg(F.count("*").alias("c"))
    stats = pooled.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.count("*").alias("k"))
    apart = pairs.agg(F.avg((F.col(a) != F.col(b)).cast("double")).alias("d_o"))
    expected = (1 - F.col("cc") / (F.col("n") * F.col("n"))) * F.col("n") / (F.col("n") - 1)
    return stats.crossJoin(apart).select(F.when(F.col("k") >= 2, 1 - F.col("d_o") / expected).alias("krippendorff_alpha"))


def long_ratings(df: DataFrame, item: str, raters: list[str]) -> DataFrame:
    """item, rater, label without blanks."""
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("rater"), F.col(r).cast("string").alias("label")) for r in raters))).alias("x")
    return df.select(item, rows).select(item, "x.*").filter(~is_blank(F.col("label")))


def alpha_panel(df: DataFrame, item: str, raters: list[str]) -> DataFrame:
    """krippendorff_alpha of a panel, from item-by-label counts: an item of m ratings weighs each pair 1 / (m - 1)."""
    cells = long_ratings(df, item, raters).groupBy(item, "label").agg(F.count("*").alias("c"))
    items = cells.groupBy(item).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("cc")).filter("m > 1")
    observed = items.agg(F.sum((F.col("m") * F.col("m") - F.col("cc")) / (F.col("m") - 1)).alias("o"), F.sum("m").alias("n"))
    labels = cells.join(items.select(item), item, "left_semi").groupBy("label").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("s"), F.count("*").alias("k"))
    return observed.crossJoin(labels).select(F.when(F.col("k") >= 2, 1 - (F.col("n") - 1) * F.col("o") / (F.col("n") * F.col("n") - F.col("s"))).alias("krippendorff_alpha"))


def panel_splits(df: DataFrame, item: str, raters: list[str]) -> DataFrame:
    """item, n_ratings, n_labels, pairwise_agreement, unanimous."""
    cells = long_ratings(df, item, raters).groupBy(item, "label").agg(F.count("*").alias("c"))
    m, cc = F.col("n_ratings"), F.col("cc")
    got = cells.groupBy(item).agg(F.sum("c").alias("n_ratings"), F.count("*").alias("n_labels"), F.sum(F.col("c") * F.col("c")).alias("cc")).filter("n_ratings > 1")
    return got.select(item, "n_ratings", "n_labels", ((cc - m) / (m * (m - 1))).alias("pairwise_agreement"), (F.col("n_labels") == 1).alias("unanimous"))


def calibration(df: DataFrame, correct: str, confidence: str) -> DataFrame:
    """n_items, accuracy, mean_confidence, brier; a confidence outside [0, 1] raises."""
    c = F.col(confidence).cast("double")
    if df.filter(c.isNull() | F.isnan(c) | ~c.between(0, 1)).limit(1).count():
        raise ValueError("confidences must be between 0 and 1")
    y = F.col(correct).cast("double")
    return df.agg(F.count("*").alias("n_items"), F.avg(y).alias("accuracy"), F.avg(c).alias("mean_confidence"), F.avg((c - y) * (c - y)).alias("brier"))


def cox(df: DataFrame, y: str, p: str, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of y on logit(p): Newton steps, each one aggregate of five sums."""
    c = F.least(F.greatest(F.col(p).cast("double"), F.lit(1e-12)), F.lit(1 - 1e-12))
    x, t = F.ln(c / (1 - c)), F.col(y).cast("double")
    slope, intercept = 0.0, 0.0
    for _ in range(rounds):
        mu = 1 / (1 + F.exp(-(F.lit(slope) * x + F.lit(intercept))))
        w, r = mu * (1 - mu), t - mu
        s = df.agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"), F.sum(r).alias("r"), F.sum(r * x).alias("rx")).first()
        det = s.w * s.wxx - s.wx * s.wx
        if not det:
            break
        da, db = (s.wxx * s.r - s.wx * s.rx) / det, (s.w * s.rx - s.wx * s.r) / det
        intercept, slope = intercept + da, slope + db
        if abs(da) + abs(db) < 1e-10:
            break
    return slope, intercept


def funnel(df: DataFrame, group: str, wrong: str) -> DataFrame:
    """group, n, n_disagree, disagreement_rate, warn_low/high, alarm_low/high, outside_warn: control limits about the pooled rate."""
    strata = df.groupBy(F.col(group).cast("string").alias("group")).agg(F.count("*").alias("n"), F.sum(F.col(wrong).cast("long")).alias("n_disagree"))
    pooled = df.agg(F.avg(F.col(wrong).cast("double")).alias("p"))
    both = strata.crossJoin(F.broadcast(pooled)).withColumn("disagreement_rate", F.col("n_disagree") / F.col("n"))  # one row
    for name, share in (("warn", 0.95), ("alarm", 0.998)):
        half = F.lit(NormalDist().inv_cdf(0.5 + share / 2)) * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")) + 0.5 / F.col("n")
        both = both.withColumn(f"{name}_low", F.greatest(F.col("p") - half, F.lit(0.0))).withColumn(f"{name}_high", F.least(F.col("p") + half, F.lit(1.0)))
    r = F.col("disagreement_rate")
    return both.withColumn("outside_warn", (r < F.col("warn_low")) | (r > F.col("warn_high"))).drop("p")


def conformal_sets(df: DataFrame, item: str, judge: str, human: str, confidence: str, order, alpha: float = 0.1, keep_confidence: bool = False) -> DataFrame:
    """item, judge, human, set_size, covers_human for the half of the items that doesn't calibrate. Binary labels '0' and '1'.

    `order` puts the items in a fixed random order; a global row number is what half of them means,
    so this is an operator for audits, whose items people have labelled.
    """
    w = Window.orderBy(order, item)
    rows = df.withColumn("_r", F.row_number().over(w)).crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))
    of_human = F.when(F.col(judge) == F.col(human), F.col(confidence)).otherwise(1 - F.col(confidence))
    scored = rows.withColumn("_s", 1 - of_human).withColumn("_fit", F.col("_r") <= F.floor(F.col("_n") / 2))
    fit = scored.filter("_fit")
    ranked = fit.withColumn("_k", F.row_number().over(Window.orderBy("_s", item))).crossJoin(F.broadcast(fit.agg(F.count("*").alias("_m"))))
    level = F.ceil((F.col("_m") + 1) * F.lit(1 - alpha)) / F.col("_m")
    at = F.ceil(level * (F.col("_m") - 1)) + 1  # the higher order statistic
    threshold = ranked.agg(F.coalesce(F.max(F.when((level < 1) & (F.col("_k") == at), F.col("_s"))), F.lit(1.0)).alias("_t"))
    test = scored.filter("not _fit").crossJoin(F.broadcast(threshold))
    own, other = 1 - F.col(confidence) <= F.col("_t"), F.col(confidence) <= F.col("_t")
    return test.select(item, judge, human, *([confidence] if keep_confidence else []), (own.cast("int") + other.cast("int")).alias("set_size"), F.when(F.col(judge) == F.col(human), own).otherwise(other).alias("covers_human"))

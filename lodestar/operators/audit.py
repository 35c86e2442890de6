"""The blinded audit of a judge against people: sealed labels, agreement, calibration, funnels, conformal sets and contestability."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.labels import is_blank
from lodestar.operators import agreement, geometry, metrics, shaping

#: Items that intervals, and conformal sets, ask for.
LEAST_ITEMS, LEAST_CONFORMAL = 10, 20


def panel(df: DataFrame, item: str, raters: list[str], shown: int = 50) -> dict:
    """n_raters, rater_columns, n_items, krippendorff_alpha, mean_pairwise_agreement, n_unanimous, n_split, split_item_ids (the first `shown`, for reading; panel_splits has all)."""
    splits = agreement.panel_splits(df, item, raters)
    one = splits.agg(F.count("*").alias("n"), F.avg("pairwise_agreement").alias("m"), F.count_if("unanimous").alias("u")).first()
    ids = [r[0] for r in splits.filter("not unanimous").orderBy(item).select(F.col(item).cast("string")).limit(shown).collect()]
    return {"n_raters": len(raters), "rater_columns": raters, "n_items": one.n, "krippendorff_alpha": agreement.alpha_panel(df, item, raters).first()[0], "mean_pairwise_agreement": one.m, "n_unanimous": one.u, "n_split": one.n - one.u, "split_item_ids": ids}


def calibration(df: DataFrame, correct: str, confidence: str) -> DataFrame:
    """n_items, judge_accuracy_vs_human, mean_confidence, brier_score, calibration_slope, calibration_intercept (null where all or none are right)."""
    one = agreement.calibration(df, correct, confidence).withColumnsRenamed({"accuracy": "judge_accuracy_vs_human", "brier": "brier_score"})
    a = one.first()
    fit = agreement.cox(df, correct, confidence) if a.n_items and 0 < a.judge_accuracy_vs_human < 1 else (None, None)
    return one.withColumns({"calibration_slope": F.lit(fit[0]).cast("double"), "calibration_intercept": F.lit(fit[1]).cast("double")})


def bootstrap(df: DataFrame, item: str, replicates: int = 1000, seed: int = 42) -> DataFrame | None:
    """metric, replicates, low, high of accuracy and kappa over resampled items; none for fewer than LEAST_ITEMS."""
    n = df.count()
    if n < LEAST_ITEMS:
        return None
    numbered = df.select((F.row_number().over(Window.orderBy(item)) - 1).cast("long").alias("_i"), "human_label", "judge_label")  # items that people have labelled
    cells = metrics.draws(numbered, "_i", replicates, seed).groupBy("rep", "human_label", "judge_label").agg(F.count("*").alias("n"))
    total = cells.groupBy("rep").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("human_label") == F.col("judge_label"), F.col("n")).otherwise(0)).alias("same"))
    a = cells.groupBy("rep", F.col("human_label").alias("l")).agg(F.sum("n").alias("x"))
    b = cells.groupBy("rep", F.col("judge_label").alias("l")).agg(F.sum("n").alias("y"))
    chance = a.join(b, ["rep", "l"], "left").groupBy("rep").agg(F.sum(F.col("x") * F.coalesce("y", F.lit(0))).alias("xy"))
    po, pe = F.col("same") / F.col("t"), F.col("xy") / (F.col("t") * F.col("t"))
    values = total.join(chance, "rep").select(F.explode(F.array(F.struct(F.lit("raw_agreement").alias("metric"), po.alias("v")), F.struct(F.lit("cohens_kappa").alias("metric"), F.when(F.abs(1 - pe) > 1e-12, (po - pe) / (1 - pe)).alias("v")))).alias("x")).select("x.*")
    return values.groupBy("metric").agg(F.count("v").alias("replicates"), F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"))


def conformal_rows(df: DataFrame, item: str, order, alpha: float = 0.1) -> DataFrame:
    """item, judge_label, human_label, judge_confidence, prediction_set, set_size, covers_human of the items that don't calibrate; needs LEAST_CONFORMAL items and two labels."""
    labels = sorted(r[0] for r in df.select(F.explode(F.array("human_label", "judge_label"))).distinct().limit(3).collect())
    if len(labels) != 2 or df.count() < LEAST_CONFORMAL:
        raise ValueError(f"conformal sets need two labels and {LEAST_CONFORMAL} items")
    rows = agreement.conformal_sets(df, item, "judge_label", "human_label", "judge_confidence", order, alpha, keep_confidence=True)
    a, b = (F.lit(x) for x in labels)
    other = F.when(F.col("judge_label") == a, b).otherwise(a)
    has_human = F.when(F.col("covers_human"), F.array("human_label")).otherwise(F.array().cast("array<string>"))
    not_human = F.when(F.col("human_label") == F.col("judge_label"), other).otherwise(F.col("judge_label"))
    full = F.when(F.col("set_size") == 2, F.array(a, b)).when(F.col("covers_human"), has_human).when(F.col("set_size") == 1, F.array(not_human)).otherwise(F.array().cast("array<string>"))
    return rows.select(item, "judge_label", "human_label", "judge_confidence", full.alias("prediction_set"), "set_size", "covers_human")


def conformal_summary(rows: DataFrame) -> DataFrame:
    """n_test, coverage, mean_set_size, n_empty, n_single, n_double."""
    s = F.col("set_size")
    return rows.agg(F.count("*").alias("n_test"), F.avg(F.col("covers_human").cast("double")).alias("coverage"), F.avg(s).alias("mean_set_size"), F.count_if(s == 0).alias("n_empty"), F.count_if(s == 1).alias("n_single"), F.count_if(s == 2).alias("n_double"))


def flagged(funnel: DataFrame) -> DataFrame:
    """A funnel's strata with `flag`: alarm, warn or ok."""
    r = F.col("disagreement_rate")
    alarm = (r < F.col("alarm_low")) | (r > F.col("alarm_high"))
    return funnel.withColumn("flag", F.when(alarm, "alarm").when(F.col("outside_warn"), "warn").otherwise("ok"))


def funnels(df: DataFrame, wrong: str, groups: list[str] | None = None) -> DataFrame:
    """grouping and the funnel of every group_ column."""
    out = None
    for g in groups or shaping.family(df, "group_"):
        one = flagged(agreement.funnel(df.filter(~is_blank(F.col(g))), g, wrong)).withColumn("grouping", F.lit(g))
        out = one if out is None else out.unionByName(one)
    return out


def verdict_contestability(df: DataFrame, item: str, prefix: str, verdict: str = "judge_label", human: str | None = "human_label", quantile: float = 0.1) -> tuple[DataFrame, dict]:
    """node_contestability of the columns that begin with prefix (criterion_ or embedding_), and how many contested items people judged otherwise: the grey zone."""
    names = shaping.family(df, prefix)
    if not names:
        raise ValueError(f"no {prefix} columns")
    rows = df.withColumn("_v", F.array(*(F.col(f"`{c}`").cast("double") for c in names)))
    fitted = geometry.fit(rows.withColumn("_label", F.when(~is_blank(F.col(verdict)), F.col(verdict).cast("string"))), "_v", "_label")
    out = geometry.node_contestability(rows, item, "_v", verdict, fitted, quantile)
    summary = {"features": names, "n_contested": out.filter("contested").count()}
    if human:
        both = out.join(df.select(F.col(item).cast("string").alias("ID"), F.col(human).cast("string").alias("_h")), "ID")
        wrong = ~is_blank(F.col("_h")) & (F.col("_h") != F.col("outcome"))
        summary |= both.agg(F.count_if(wrong).alias("n_disagreements"), F.count_if(wrong & F.col("contested")).alias("n_grey_zone")).first().asDict()
    return out, summary


class BlindedAudit:
    """People's labels are sealed by a hash before a judge's are seen; results come out once, and the audit closes.

    States: open, sealed, closed. A call out of turn raises RuntimeError.
    """

    def __init__(self, name: str, item: str = "item_id"):
        self.name, self.item, self.state = name, item, "open"
        self.human: DataFrame | None = None
        self.seal_sha256: str | None = None
        self.log: list[str] = []

    def _in(self, state: str) -> None:
        if self.state != state:
            raise RuntimeError(f"the audit is {self.state}, not {state}")

    def seal(self, human: DataFrame) -> str:
        """The digest of people's labels, whatever their row order."""
        self._in("open")
        if human.groupBy(self.item).count().filter("count > 1").limit(1).count():
            raise ValueError("items repeat")
        self.human, self.state = human, "sealed"
        self.seal_sha256 = shaping.frame_digest(human).first().sha256
        self.log.append(f"sealed {self.seal_sha256}")
        return self.seal_sha256

    def close(self, judge: DataFrame, alpha: float = 0.1, replicates: int = 1000) -> dict:
        """All results against the judge's labels; the sealed labels must still have their digest."""
        self._in("sealed")
        if shaping.frame_digest(self.human).first().sha256 != self.seal_sha256:
            raise RuntimeError("the sealed labels have changed")
        pairs = agreement.aligned(self.human, judge, self.item)
        out = {"seal_sha256": self.seal_sha256, "agreement": agreement.kappa(pairs).first().asDict() | {"krippendorff_alpha": agreement.alpha_two(pairs).first()[0], "confusion": [tuple(r) for r in agreement.confusion(pairs).orderBy("human_label", "judge_label").collect()]}}
        boot = bootstrap(pairs, self.item, replicates)
        out["agreement"]["confidence_intervals"] = None if boot is None else {r.metric: (r.low, r.high) for r in boot.collect()}
        if raters := shaping.family(self.human, "human_label_"):
            out["panel"] = panel(self.human, self.item, ["human_label", *raters])
        if "judge_confidence" in pairs.columns:
            right = pairs.withColumn("_ok", F.col("human_label") == F.col("judge_label"))
            out["calibration"] = calibration(right, "_ok", "judge_confidence").first().asDict()
            try:
                out["conformal"] = conformal_summary(conformal_rows(pairs, self.item, F.xxhash64(self.item), alpha)).first().asDict()
            except ValueError as e:
                out["conformal"] = {"skipped": str(e)}
        if groups := shaping.family(pairs, "group_"):
            wrong = pairs.withColumn("_wrong", F.col("human_label") != F.col("judge_label"))
            out["funnels"] = [r.asDict() for r in funnels(wrong, "_wrong", groups).orderBy("grouping", "group").collect()]  # a row a stratum
        for prefix in ("criterion_", "embedding_"):
            if shaping.family(pairs, prefix):
                out[f"{prefix}contestability"] = verdict_contestability(pairs, self.item, prefix)[1]
        self.state = "closed"
        self.log.append("closed")
        return out


def report(results: dict) -> str:
    """The results as Markdown."""
    lines = ["# Audit of a judge against people", "", "A research and education tool, not decision support.", "", f"Sealed labels: `{results['seal_sha256']}`", ""]
    for name, part in results.items():
        if name == "seal_sha256":
            continue
        lines += [f"## {name.replace('_', ' ').strip().capitalize()}", ""]
        rows = part if isinstance(part, list) else [part]
        for row in rows:
            lines += [f"- {k}: {json.dumps(v, default=str)}" for k, v in row.items()] + [""]
    return "\n".join(lines)

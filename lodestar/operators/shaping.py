"""Column selection, joins, group rows, specification sweeps and risk scores: small pieces that analyses are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.labels import is_blank


def comma_list(text: str | None) -> list[str]:
    """Parts between commas, trimmed, without empty ones."""
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def selected(df: DataFrame, key: str, outcome: str | None = None, features: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """key, outcome and the named features, or all columns; what is excluded goes even where it is named."""
    named = features if features else [c for c in df.columns if c not in (key, outcome)]
    if missing := [c for c in (key, *([outcome] if outcome else []), *named) if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    kept = [c for c in named if c not in set(exclude) | {key, outcome}]
    return df.select(key, *([outcome] if outcome else []), *(F.col(f"`{c}`") for c in kept))


def minimal(df: DataFrame, key: str, outcome: str) -> DataFrame:
    return df.select(key, outcome)


def family(df: DataFrame, prefix: str) -> list[str]:
    """Columns that begin with the prefix, in their order."""
    return [c for c in df.columns if c.startswith(prefix)]


def numeric_attributes(df: DataFrame, key: str, exclude: list[str] = ()) -> DataFrame:
    """key as ID, and the numeric columns that are not excluded."""
    kept = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in {key, *exclude}]
    return df.select(F.col(key).cast("string").alias("ID"), *(F.col(f"`{c}`").cast("double").alias(c) for c in kept))


def with_attributes(features: DataFrame, attributes: DataFrame, key: str = "ID") -> DataFrame:
    """features joined to attributes by key; what is missing is 0."""
    own = [c for c in attributes.columns if c == key or c not in features.columns]
    return features.join(attributes.select(*own), key, "left").fillna(0.0, [c for c in own if c != key])


def with_labels(features: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """features joined to labels by key; a row without a label, or with a blank one, has null."""
    known = labels.select(key, F.when(~is_blank(F.col(label)), F.col(label).cast("string")).alias(label))
    return features.join(known, key, "left")


def with_groups(rows: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """rows with their group, -1 where they have none."""
    return rows.join(groups.select(key, F.col(group).cast("long").alias(group)), key, "left").fillna(-1, [group])


def target_rows(df: DataFrame, outcome: str, value: str | float | None = None) -> DataFrame:
    """Rows whose outcome is value, compared as numbers where the column is numeric; without a value those of the largest outcome."""
    c = F.col(outcome)
    if value is None:
        top = df.agg(F.max(F.when(~is_blank(c), c)).alias("_top"))  # one row
        return df.crossJoin(F.broadcast(top)).filter(c == F.col("_top")).drop("_top")
    if isinstance(df.schema[outcome].dataType, T.NumericType):
        return df.filter(c.cast("double") == F.lit(float(value)))
    return df.filter(c.cast("string") == F.lit(str(value)))


def members(df: DataFrame, column: str, values: list | None = None, prefix: str | None = None) -> DataFrame:
    """Rows whose value is among the stated ones, or begins with the prefix."""
    c = F.col(column)
    return df.filter((c.isin(*values) if values is not None else F.lit(True)) & (c.cast("string").startswith(prefix) if prefix is not None else F.lit(True)))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, one, other: values of keys that both sides have, without nulls."""
    return a.select(key, F.col(value).alias("one")).join(b.select(key, F.col(value).alias("other")), key).dropna()


def scaffold_labels(scaffold: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """All rows of the scaffold with their label, blank where there is none; then the labelled rows that the scaffold lacks."""
    one = scaffold.select(key).join(labels.select(key, label), key, "left").fillna("", [label])
    return one.unionByName(labels.join(scaffold, key, "left_anti").select(key, label))


def both_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that are in both."""
    return a.select(key).intersect(b.select(key))


def index_rows(df: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """The row of the largest order in each group, of equal ones that of the largest key: by partial aggregation, no window."""
    return df.groupBy(group).agg(F.max_by(F.struct(*df.columns), F.struct(order, key)).alias("_r")).select("_r.*")


def first_last(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, first, last, change, n of value in the order; ties by value."""
    at = F.struct(order, value)
    out = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.count("*").alias("n"))
    return out.select(group, "first", "last", (F.col("last") - F.col("first")).alias("change"), "n")


def counted(df: DataFrame, group: str, order: str, *within: str) -> DataFrame:
    """df with `place` (from 0, in the order, inside group and `within`) and `group_count`."""
    place = F.row_number().over(Window.partitionBy(group, *within).orderBy(order)) - 1
    return df.withColumns({"place": place.cast("int"), "group_count": F.count("*").over(Window.partitionBy(group))})


def spread(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, readers, median, spread (largest less smallest), ratings (joined in order)."""
    return df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("readers"), F.median(value).alias("median"), (F.max(value) - F.min(value)).alias("spread"), F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda x: x.cast("string")), ";").alias("ratings"))


def participant_growth(participants: DataFrame, growth: DataFrame, screens: DataFrame, key: str) -> DataFrame:
    """participants with their growth and the number of their screens, 0 where there are none."""
    n = screens.groupBy(key).agg(F.count("*").alias("n_screens"))
    return participants.join(growth, key, "left").join(n, key, "left").fillna(0, ["n_screens"])


def operating_point(df: DataFrame, y: Column, flagged: Column, hedged: Column, *by: str) -> DataFrame:
    """by, tp, fn, tn, fp, sensitivity and specificity with Wilson limits, hedge_fraction."""
    from lodestar.operators.metrics import wilson

    n = df.groupBy(*by).agg(F.count_if(y & flagged).alias("tp"), F.count_if(y & ~flagged).alias("fn"), F.count_if(~y & ~flagged).alias("tn"), F.count_if(~y & flagged).alias("fp"), F.avg(hedged.cast("double")).alias("hedge_fraction"))
    out = n
    for name, k, rest in (("sensitivity", "tp", "fn"), ("specificity", "tn", "fp")):
        total = F.nullif(F.col(k) + F.col(rest), F.lit(0))
        low, high = wilson(F.col(k), total)
        out = out.withColumns({name: F.col(k) / total, f"{name}_low": F.when(total.isNotNull(), low), f"{name}_high": F.when(total.isNotNull(), high)})
    return out


def multiverse(df: DataFrame, group: str, value: str, order: str, positive: dict[str, Column], thresholds: list[float]) -> DataFrame:
    """aggregation, threshold, labels, n, tp, fn, tn, fp: every specification of how a group's values become one, from where it is flagged, and which groups are positive. One grouped aggregate."""
    at = F.struct(order, value)
    per = df.groupBy(group).agg(F.max(value).cast("double").alias("max"), F.avg(value).alias("mean"), F.max_by(value, at).cast("double").alias("last"), *(F.max(c.cast("int")).alias(f"_y_{k}") for k, c in positive.items()))
    specs = F.explode(F.array(*(F.struct(F.lit(a).alias("aggregation"), F.lit(float(t)).alias("threshold"), F.lit(k).alias("labels"), F.col(a).alias("v"), F.col(f"_y_{k}").alias("y")) for a in ("max", "mean", "last") for t in thresholds for k in positive))).alias("s")
    on = F.col("v") >= F.col("threshold")
    y = F.col("y") == 1
    return per.select(specs).select("s.*").groupBy("aggregation", "threshold", "labels").agg(F.count("*").alias("n"), F.count_if(y & on).alias("tp"), F.count_if(y & ~on).alias("fn"), F.count_if(~y & ~on).alias("tn"), F.count_if(~y & on).alias("fp"))


def logistic(intercept: float, terms: list[tuple[float, Column]]) -> Column:
    """1 / (1 + exp(-(intercept + sum of weight x value)))."""
    x = F.lit(intercept)
    for weight, value in terms:
        x = x + F.lit(weight) * value.cast("double")
    return 1 / (1 + F.exp(-x))


# Published weights of two nodule models, the weights of a made-up truth, and limits and points of tiers.
BROCK = {"intercept": -6.7892, "age": 0.0287, "female": 0.6011, "family_history": 0.2961, "emphysema": 0.2953, "size": -5.3854, "part_solid": 0.377, "non_solid": -0.1276, "upper_lobe": 0.6581, "count": -0.0824, "spiculation": 0.7729}
MAYO = {"intercept": -6.8272, "age": 0.0391, "smoker": 0.7917, "cancer_history": 1.3388, "diameter": 0.1274, "spiculation": 1.0407, "upper_lobe": 0.7838}
LATENT = {"intercept": -4.2, "root_diameter": 0.62, "spiculation": 0.85, "upper_lobe": 0.45, "age": 0.035, "smoker": 0.55, "part_solid": 0.7, "non_solid": -0.5, "family_history": 0.45}
RISK_TIERS = [(0.10, "low"), (0.50, "intermediate")]
MALIGNANCY = (2.5, 3.5)
NODULE_POINTS = [(1, 1), (5, 4), (10, 10), (30, 18), (65, 28)]
NO_GROWTH = 9999


def brock_probability(age: Column, female: Column, family_history: Column, emphysema: Column, diameter_mm: Column, nodule_type: Column, upper_lobe: Column, count: Column, spiculation: Column) -> Column:
    """The full model with spiculation; nodule_type is solid, part_solid or non_solid."""
    b = BROCK
    size = F.pow(diameter_mm.cast("double") / 10, F.lit(-0.5)) - 1.58113883
    kinds = [(b[k], (nodule_type == k).cast("int")) for k in ("part_solid", "non_solid")]
    return logistic(b["intercept"], [(b["age"], age - 62), (b["female"], female), (b["family_history"], family_history), (b["emphysema"], emphysema), (b["size"], size), *kinds, (b["upper_lobe"], upper_lobe), (b["count"], count - 4), (b["spiculation"], spiculation)])


def mayo_probability(age: Column, smoker: Column, cancer_history: Column, diameter_mm: Column, spiculation: Column, upper_lobe: Column) -> Column:
    m = MAYO
    return logistic(m["intercept"], [(m["age"], age), (m["smoker"], smoker), (m["cancer_history"], cancer_history), (m["diameter"], diameter_mm), (m["spiculation"], spiculation), (m["upper_lobe"], upper_lobe)])


def latent_probability(diameter_mm: Column, spiculation: Column, upper_lobe: Column, age: Column, smoker: Column, nodule_type: Column, family_history: Column) -> Column:
    """A made-up truth of another form than either score."""
    w = LATENT
    kinds = [(w[k], (nodule_type == k).cast("int")) for k in ("part_solid", "non_solid")]
    return logistic(w["intercept"], [(w["root_diameter"], F.sqrt(diameter_mm.cast("double"))), (w["spiculation"], spiculation), (w["upper_lobe"], upper_lobe), (w["age"], age - 60), (w["smoker"], smoker), *kinds, (w["family_history"], family_history)])


def risk_tier(p: Column) -> Column:
    return tier(p, RISK_TIERS, "high")


def malignancy_tier(value: Column, low: float = MALIGNANCY[0], high: float = MALIGNANCY[1]) -> Column:
    return F.when(value < low, "benign_low").when(value > high, "suspicious_high").when(value.isNotNull(), "indeterminate")


def feasibility_tier(n: Column) -> Column:
    return F.when(n >= 4, "broad").when(n >= 2, "partial").otherwise("gap")


def nodule_points(percent: Column) -> Column:
    out = F.when(percent.isNull(), F.lit(None).cast("int"))
    for limit, points in NODULE_POINTS:
        out = out.when(percent < limit, points)
    return out.otherwise(35)


def growth_points(days: Column) -> Column:
    return F.when(days >= NO_GROWTH, 0).when(days < 100, 15).when(days < 400, 13).when(days < 600, 10).when(days.isNotNull(), 8)


def post_ct_score(brock: Column, mayo: Column, days: Column) -> Column:
    """Nodule and growth points, as a share of the 50 that there are, in percent."""
    return 100.0 * (nodule_points(100 * F.greatest(brock, mayo)) + growth_points(days)) / 50


def volume_doubling_time(days: Column, first_mm: Column, last_mm: Column) -> Column:
    """Days in which a sphere of these diameters doubles; null where it doesn't grow."""
    ratio = F.try_divide(last_mm.cast("double"), first_mm.cast("double"))
    return F.when((ratio > 1) & (days > 0), days * F.ln(F.lit(2.0)) / (3 * F.ln(ratio)))


def tier(value: Column, limits: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first limit that the value is below."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, name in limits:
        out = out.when(value < limit, name)
    return out.otherwise(otherwise)


def zscore(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the standardised value; 0 where the deviation is at most 1e-9."""
    s = F.broadcast(df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")))  # one row
    return df.crossJoin(s).withColumn(name, F.when(F.col("_s") <= 1e-9, F.lit(0.0)).otherwise((F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def split_half_tiers(ratings: Column, seed: Column) -> Column:
    """Tiers of the medians of two halves of an array of ratings, dealt out in the order of ((i + seed) * 2654435761) mod 2^32; null without two ratings."""
    keyed = F.transform(ratings, lambda x, i: F.struct(F.pmod((i.cast("long") + seed.cast("long")) * F.lit(2654435761), F.lit(1 << 32)).alias("k"), x.cast("double").alias("v")))
    values = F.transform(F.array_sort(keyed), lambda s: s["v"])
    half = F.greatest(F.floor(F.size(ratings) / 2), F.lit(1)).cast("int")

    def median(part: Column) -> Column:
        s, n = F.array_sort(part), F.size(part)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    a, b = median(F.slice(values, F.lit(1), half)), median(F.slice(values, half + 1, F.greatest(F.size(ratings) - half, F.lit(1))))
    return F.when(F.size(ratings) >= 2, F.struct(malignancy_tier(a).alias("first"), malignancy_tier(b).alias("second")))


def same_everywhere(spark, n: int, one: Column, other: Column, tolerance: float = 1e-9) -> DataFrame:
    """cases, differing, largest: two column expressions over `id` compared on range(n)."""
    d = F.abs(one - other)
    return spark.range(n).agg(F.count("*").alias("cases"), F.count_if(d > tolerance).alias("differing"), F.max(d).alias("largest"))


def frame_digest(df: DataFrame) -> DataFrame:
    """sha256 of a table, whatever its row order: of row hashes, counted by their first byte and summed, never collected."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = df.select(row.alias("h")).select(*(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)").alias(f"s{k}") for k in range(8)))
    return parts.agg(F.count("*").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(8))).select(F.sha2(F.concat_ws(":", "n", *(f"s{k}" for k in range(8))), 256).alias("sha256"))


def reader_split(df: DataFrame, ratings: str, low: float, high: float) -> DataFrame:
    """df with `outcome`: 'split' where readers' ratings reach from at most low to at least high, 'agreed' else; blank without two ratings."""
    r = F.col(ratings)
    return df.withColumn("outcome", F.when(F.size(r) < 2, "").when((F.array_min(r) <= low) & (F.array_max(r) >= high), "split").otherwise("agreed"))


def concordance(df: DataFrame, found: DataFrame, key: str, rated: str, truth: str) -> DataFrame:
    """df's key and `outcome`: 'concordant' where the rating says what was found, 'discordant' else; blank where nothing was found."""
    both = df.select(key, rated).join(found.select(key, truth), key, "left")
    return both.select(key, F.when(F.col(truth).isNull() | F.col(rated).isNull(), "").when(F.col(rated) == F.col(truth), "concordant").otherwise("discordant").alias("outcome"))

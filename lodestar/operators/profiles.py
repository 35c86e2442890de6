"""Table checks: profile, validation of node and edge tables, one-hot design, label leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.labels import is_blank

# Name fragments that hint at a column's role, and thresholds of the profile.
LEAK_NAMES = ("outcome", "label", "target", "response", "result", "diagnosis", "final", "death", "died", "deceased", "survival", "survived", "followup", "follow_up", "post_treatment", "post-treatment", "posttreatment", "mortality", "relapse", "recurrence", "progression", "status")
ROLE_NAMES = {
    "id": ("id", "identifier", "accession", "mrn", "uuid", "guid", "key", "index"),
    "outcome": ("outcome", "label", "target", "class", "response", "subtype", "y"),
    "site": ("site", "hospital", "center", "centre", "cluster", "clinic", "institution"),
    "time": ("date", "time", "year", "month", "day", "timestamp", "diagnosis_year"),
}
DATE_PATTERN = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
OUTCOME_LEVELS, SNIFFED, TEXT_WORDS, TEXT_SHARE = 20, 50, 4, 0.5
ID_RATIO, DATE_SHARE, HIGH_SHARE, HIGH_COUNT = 0.95, 0.6, 0.5, 20


def table_profile(df: DataFrame) -> DataFrame:
    """column, dtype, n_rows, n_unique, n_missing, cardinality_ratio, looks_like_id, high_cardinality: one pass, one row per column."""
    cols = df.columns
    values = [F.count("*").alias("n")]
    for i, c in enumerate(cols):
        values += [F.count_distinct(F.col(f"`{c}`")).alias(f"u{i}"), F.count_if(is_blank(F.col(f"`{c}`"), df.schema[c].dataType)).alias(f"m{i}")]
    one = df.agg(*values)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.col("n").alias("n_rows"), F.col(f"u{i}").alias("n_unique"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(cols)))
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    ratio = F.when(F.col("n_rows") > 0, F.col("n_unique") / F.col("n_rows")).otherwise(0.0)
    # a name that says so and nearly all values distinct, or all distinct and no number: a continuous number is no id
    named = F.lit(False)
    for x in ROLE_NAMES["id"]:
        named = named | F.lower("column").contains(x)
    is_number = F.col("dtype").rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    return out.withColumn("cardinality_ratio", ratio).withColumn("looks_like_id", (named & (ratio > ID_RATIO)) | ((ratio == 1.0) & ~is_number)).withColumn("high_cardinality", (ratio > HIGH_SHARE) & (F.col("n_unique") > HIGH_COUNT))


def leakage_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(x in c.lower() for x in LEAK_NAMES)]


def hits(name: str, fragments: tuple[str, ...]) -> bool:
    return any(x in name.lower() for x in fragments)


def text_shapes(df: DataFrame) -> dict[str, tuple[float, float]]:
    """For each text column the shares of date-like and of long values among SNIFFED non-blank ones (the smallest, so that it is the same sample every time)."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            c = F.col(f"`{f.name}`")
            sample = df.select(c.alias("v")).filter(~is_blank(F.col("v"))).orderBy("v").limit(SNIFFED)
            r = sample.agg(F.avg(F.col("v").rlike(DATE_PATTERN).cast("int")).alias("d"), F.avg((F.size(F.split(F.trim("v"), r"\s+")) >= TEXT_WORDS).cast("int")).alias("t")).first()
            out[f.name] = (r.d or 0.0, r.t or 0.0)
    return out


def infer_schema(df: DataFrame) -> DataFrame:
    """column, role (id, outcome, site, time, text, leakage, feature, excluded), by names, cardinality and shape of values; one row per column."""
    shapes, rows, taken = text_shapes(df), [], set()
    for r in table_profile(df).collect():
        dated, wordy = shapes.get(r.column, (0.0, 0.0))
        numeric = isinstance(df.schema[r.column].dataType, T.NumericType)
        role = "feature" if numeric or r.n_unique <= OUTCOME_LEVELS else "excluded"
        if dated >= DATE_SHARE or isinstance(df.schema[r.column].dataType, (T.DateType, T.TimestampType)):
            role = "time"
        elif wordy >= TEXT_SHARE:
            role = "text"
        elif r.looks_like_id and hits(r.column, ROLE_NAMES["id"]) and "id" not in taken:
            role = "id"
        elif r.n_unique <= OUTCOME_LEVELS and hits(r.column, ROLE_NAMES["outcome"]) and "outcome" not in taken:
            role = "outcome"
        elif not numeric and hits(r.column, ROLE_NAMES["site"]):
            role = "site"
        elif hits(r.column, LEAK_NAMES):
            role = "leakage"
        taken.add(role)
        rows.append((r.column, role))
    return df.sparkSession.createDataFrame(rows, "column string, role string")


def numeric_columns(df: DataFrame, *without: str) -> list[str]:
    """Numbers, not booleans."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in without]


def validate(nodes: DataFrame, edges: DataFrame, node: str = "ID", source: str = "SourceID", target: str = "TargetID") -> DataFrame:
    """node_count, duplicate_nodes, edge_rows, duplicate_edges (by direction), missing_endpoints."""
    for df, names in ((nodes, [node]), (edges, [source, target])):
        if missing := [n for n in names if n not in df.columns]:
            raise ValueError(f"columns missing: {missing}")
    a = nodes.agg(F.count("*").alias("node_count"), (F.count("*") - F.count_distinct(node)).alias("duplicate_nodes"))
    b = edges.agg(F.count("*").alias("edge_rows"), (F.count("*") - F.count_distinct(F.struct(source, target))).alias("duplicate_edges"))
    ends = edges.select(F.col(source).alias(node)).union(edges.select(F.col(target))).distinct()
    c = ends.join(nodes.select(node), node, "left_anti").agg(F.count("*").alias("missing_endpoints"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def one_hot(df: DataFrame, column: str, levels: list[str], *keep: str) -> DataFrame:
    """keep and a 0/1 column for each level, named column_level."""
    return df.select(*keep, *(F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in levels))


def suppressed(counts: DataFrame, min_cell: int = 10, n: str = "n") -> DataFrame:
    """Cells of at least min_cell rows; if just one cell falls below, the smallest of the others goes too, as the total would give it away."""
    state = counts.agg(F.count_if(F.col(n) < min_cell).alias("_low"), F.min(F.when(F.col(n) >= min_cell, F.col(n))).alias("_next"))
    both = counts.crossJoin(F.broadcast(state))  # one row
    return both.filter((F.col(n) >= min_cell) & ~((F.col("_low") == 1) & (F.col(n) == F.col("_next")))).drop("_low", "_next")

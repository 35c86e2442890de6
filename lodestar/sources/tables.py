"""Readers, and the driver tables as node, edge and rating tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.labels import is_blank
from lodestar.operators import neighbours

# Column names taken for the canonical ones, in any case.
ALIASES = {
    "ID": ("id", "node_id", "nodeid", "node", "patient_id", "patientid", "case_id", "caseid", "subject_id", "subjectid"),
    "Outcome": ("outcome", "label", "class", "y", "status", "target_label"),
    "SourceID": ("sourceid", "source", "source_id", "from", "src", "u", "start"),
    "TargetID": ("targetid", "target", "target_id", "to", "dst", "v", "end"),
    "Weight": ("weight", "w", "cost", "strength"),
}


def read_csv(spark: SparkSession, path: str, text: tuple[str, ...] = ("ID", "SourceID", "TargetID"), schema: str | None = None) -> DataFrame:
    """A CSV with a header, or a parquet file; identifier columns stay text, whatever they look like. Without a schema the CSV is read twice, once for its types."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if schema:
        return spark.read.csv(path, header=True, schema=schema)
    df = spark.read.csv(path, header=True, inferSchema=True)
    made = T.StructType([T.StructField(f.name, T.StringType() if f.name in text else f.dataType) for f in df.schema])
    return spark.read.csv(path, header=True, schema=made)


def load_tables(spark: SparkSession, nodes: str, edges: str, nodes_schema: str | None = None, edges_schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The node and the edge table."""
    return read_csv(spark, nodes, schema=nodes_schema), read_csv(spark, edges, schema=edges_schema)


def profile_file(spark: SparkSession, path: str) -> tuple[DataFrame | None, str | None]:
    """The profile of a CSV, or why it can't be read."""
    from lodestar.operators import profiles

    try:
        df = spark.read.csv(path, header=True, inferSchema=True, mode="FAILFAST")
        out = profiles.table_profile(df)
        out.first()
        return out, None
    except Exception as e:  # whatever keeps a file from being read is its error row
        return None, f"file not readable: {str(e).splitlines()[0]}"


def smallest_class(spark: SparkSession, path: str, outcome: str) -> int:
    """Rows of the smallest class that isn't blank; only that column is read."""
    df = read_csv(spark, path).select(F.col(outcome).alias("y"))
    return df.filter(~is_blank(F.col("y"))).groupBy("y").count().agg(F.min("count")).first()[0] or 0


def read_ratings(spark: SparkSession, human: str, judge: str) -> tuple[DataFrame, DataFrame]:
    """People's and a judge's ratings; item_id, labels and groups are text, and judge_confidence is a number."""
    out = []
    for path in (human, judge):
        df = spark.read.csv(path, header=True)
        numbers = [c for c in df.columns if c == "judge_confidence" or c.startswith(("criterion_", "embedding_"))]
        out.append(df.select(*(F.col(f"`{c}`").try_cast("double").alias(c) if c in numbers else F.col(f"`{c}`") for c in df.columns)))
    return out[0], out[1]


def read_diagnosis(spark: SparkSession, path: str, prefix: str = "LIDC") -> DataFrame:
    """pid and code of a diagnosis table as CSV, its first two columns; rows whose id begins with prefix, codes that are numbers."""
    raw = spark.read.csv(path, header=False)
    c = raw.columns
    return raw.select(F.trim(c[0]).alias("pid"), F.col(c[1]).try_cast("int").alias("code")).filter(F.col("pid").startswith(prefix) & F.col("code").isNotNull())


def read_registry(spark: SparkSession, participants: str, findings: str, columns: dict[str, str], key: str = "pid") -> DataFrame:
    """Participants joined to findings, with columns renamed by `columns` (new name to the file's)."""
    def renamed(path: str) -> DataFrame:
        df = spark.read.csv(path, header=True, inferSchema=True)
        known = {c.lower(): c for c in df.columns}
        return df.select(*(F.col(f"`{known[old.lower()]}`").alias(new) for new, old in columns.items() if old.lower() in known))

    one, two = renamed(participants), renamed(findings)
    return one.join(two.select(key, *(c for c in two.columns if c not in one.columns)), key)


def synthetic_nodes(spark: SparkSession, n: int, features: int = 2, seed: int = 42, signal: float = 0.0) -> DataFrame:
    """ID, Outcome (0 or 1), Feature1 ...: normal features, shifted by signal in class 1; values follow Spark's own generator."""
    y = (F.rand(seed) < 0.5).cast("int")
    base = spark.range(n).select(F.concat(F.lit("N"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("ID"), y.alias("Outcome"), *(F.randn(seed + k).alias(f"_{k}") for k in range(1, features + 1)))
    return base.select("ID", "Outcome", *((F.col(f"_{k}") + F.col("Outcome") * signal).alias(f"Feature{k}") for k in range(1, features + 1)))


def synthetic_edges(spark: SparkSession, n: int, degree: int = 3, seed: int = 42) -> DataFrame:
    """SourceID, TargetID, weight: each of n nodes linked to others by hash."""
    i, name = F.col("id"), lambda c: F.concat(F.lit("N"), F.lpad(c.cast("string"), 7, "0"))
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(degree))).alias("k"))
    other = F.pmod(F.xxhash64(F.lit(seed), i, F.col("k")), F.lit(n))
    return rows.select(i, other.alias("o"), (0.1 + 0.9 * F.pmod(F.xxhash64(F.lit(seed + 1), i, F.col("k")), F.lit(1000)) / 1000).alias("weight")).filter("id <> o").select(name(F.col("id")).alias("SourceID"), name(F.col("o")).alias("TargetID"), "weight")


def synthetic_nodules(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """A cohort with both risk scores, growth, and an outcome drawn from a truth of another form."""
    from lodestar.operators import shaping

    draw = lambda k: F.rand(seed + k)
    yes = lambda k, p: (draw(k) < p).cast("int")
    kind = F.when(draw(1) < 0.7, "solid").when(draw(2) < 0.5, "part_solid").otherwise("non_solid")
    base = spark.range(n).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("ID"), F.round(45 + 40 * draw(3)).alias("age"), yes(4, 0.5).alias("female"), yes(5, 0.2).alias("family_history"), yes(6, 0.3).alias("emphysema"), F.round(4 + 26 * draw(7) * draw(8), 1).alias("diameter_mm"), kind.alias("nodule_type"), yes(9, 0.5).alias("upper_lobe"), (1 + F.floor(6 * draw(10))).cast("int").alias("nodule_count"), yes(11, 0.25).alias("spiculation"), yes(12, 0.6).alias("smoker"), yes(13, 0.1).alias("cancer_history"), F.round(3 + 20 * draw(14) * draw(15), 1).alias("prior_diameter_mm"), draw(16).alias("_u"))
    c = F.col
    scored = base.withColumns({"brock": shaping.brock_probability(c("age"), c("female"), c("family_history"), c("emphysema"), c("diameter_mm"), c("nodule_type"), c("upper_lobe"), c("nodule_count"), c("spiculation")), "mayo": shaping.mayo_probability(c("age"), c("smoker"), c("cancer_history"), c("diameter_mm"), c("spiculation"), c("upper_lobe")), "vdt_days": shaping.volume_doubling_time(F.lit(365), c("prior_diameter_mm"), c("diameter_mm"))})
    truth = shaping.latent_probability(c("diameter_mm"), c("spiculation"), c("upper_lobe"), c("age"), c("smoker"), c("nodule_type"), c("family_history"))
    return scored.withColumn("Outcome", (c("_u") < truth).cast("int")).withColumn("tier", shaping.risk_tier(c("brock"))).drop("_u")


def normalised(df: DataFrame, roles: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """df with columns renamed to the roles' canonical names where that is unambiguous, and a log of what was done."""
    log = []
    for role in roles:
        if role in df.columns:
            continue
        exact = [c for c in df.columns if c.lower() == role.lower()]
        found = exact or [c for c in df.columns if c.lower() in ALIASES[role]]
        if len(found) == 1 or exact:
            df = df.withColumnRenamed(found[0], role)
            log.append(f"{'rename_ambiguous' if len(found) > 1 else 'case_match' if exact else 'rename'}: {found[0]} -> {role}")
        elif found:
            log.append(f"ambiguous: {role} could be {', '.join(found)}")
    return df, log


#: Roles of the two kinds of table.
NODE_ROLES, EDGE_ROLES = ("ID", "Outcome"), ("SourceID", "TargetID", "Weight")


def normalised_pair(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Node and edge table, each by its own roles, and both logs."""
    nodes, a = normalised(nodes, NODE_ROLES)
    edges, b = normalised(edges, EDGE_ROLES)
    return nodes, edges, [*(f"nodes: {x}" for x in a), *(f"edges: {x}" for x in b)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def co_purchased_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts, and pairs of parts that at least two orders hold."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return parts, neighbours.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def nation_trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations, and directed edges from a customer's nation to a supplier's, for every pair with order lines (at most the square of the nations); weight is the number of lines as a share of the largest."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    ends = lines.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src")), "o_custkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey")
    counts = ends.groupBy("src", "dst").agg(F.count("*").alias("n"))
    both = counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("most"))))  # one row
    nations = t("nation").select(F.col("n_nationkey").alias("id"))
    return nations, both.select("src", "dst", (F.col("n") / F.col("most")).alias("weight"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, human_label (quality), judge_label (1 for texts of at least the median length), judge_confidence, human_label_2 (1 - toxic), group_lang."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    median = docs.agg(F.percentile("n_chars", F.lit(0.5)).alias("median"))
    both = table(spark, sf_dir, "labels").join(docs, "doc_id").crossJoin(F.broadcast(median))  # one row
    confidence = F.least(F.lit(1.0), 0.5 + F.abs(F.col("n_chars") - F.col("median")) / (4 * F.col("median")))
    return both.select(F.col("doc_id").alias("item_id"), F.col("quality").cast("string").alias("human_label"), (F.col("n_chars") >= F.col("median")).cast("int").cast("string").alias("judge_label"), confidence.alias("judge_confidence"), (1 - F.col("toxic")).cast("string").alias("human_label_2"), F.col("lang").alias("group_lang"))

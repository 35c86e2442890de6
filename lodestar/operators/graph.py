"""Graph features over (vertices, edges) DataFrames, and iterative algorithms on them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Tasks that a hub's edges are spread over.
SALTS = 16


def _kept(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read again; in local mode, as in tests, under /tmp where none is set. The table goes when the application ends."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/lodestar-checkpoints"
    path = f"{base.rstrip('/')}/lodestar-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _salted(rows: DataFrame, one: DataFrame, key: str, spread: str) -> DataFrame:
    """rows joined to one, which has a row per key; a key's rows go to SALTS tasks."""
    a = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    b = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return a.join(b, [key, "_salt"]).drop("_salt")


def canonical(edges: DataFrame, directed: bool = False) -> DataFrame:
    """src, dst, weight of a simple graph: repeated pairs (either way, if undirected) are one edge, and the last row, by `row`, gives its weight."""
    a, b = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    order = F.col("row") if "row" in edges.columns else F.struct(w)
    return edges.select(a.alias("src"), b.alias("dst"), w.alias("weight"), order.alias("o")).groupBy("src", "dst").agg(F.max_by("weight", "o").alias("weight"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree, weighted_degree, is_isolate; a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight")
    got = ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))
    return vertices.select("id").join(got, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"), F.coalesce("degree", F.lit(0)).__eq__(0).cast("int").alias("is_isolate"))


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, triangles, clustering. Edges point to the end of larger (degree, id), so that no vertex has many outgoing ones."""
    simple = edges.filter("src <> dst").select("src", "dst")
    deg = simple.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    e = simple.join(deg.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    o = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    wedges = o.alias("x").join(o.alias("y"), F.col("x.a") == F.col("y.a")).filter(F.col("x.b") < F.col("y.b")).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    closed = simple.select(F.least("src", "dst").alias("b"), F.greatest("src", "dst").alias("c"))
    t = wedges.join(closed, ["b", "c"]).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    out = vertices.select("id").join(deg, "id", "left").join(t, "id", "left")
    n, d = F.coalesce("triangles", F.lit(0)), F.coalesce("d", F.lit(0))
    return out.select("id", n.alias("triangles"), F.when(d >= 2, 2.0 * n / (d * (d - 1))).otherwise(0.0).alias("clustering"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (its smallest id), component_size: large-star and small-star rounds until nothing changes."""
    ends = _kept(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    before = None
    while (state := tuple(ends.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != before:
        before = state
        both = ends.union(ends.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _salted(both.filter("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        ends = _kept(_salted(large, least, "u", "v").select(F.explode(pairs).alias("e")).select("e.*").filter("u <> v").distinct())
    roots = ends.groupBy("u").agg(F.min("v").alias("root"))
    named = vertices.select("id").join(roots.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))
    sizes = named.groupBy("component").agg(F.count("*").alias("component_size"))
    return named.join(sizes, "component").select("id", "component", "component_size")


def node_features(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree, weighted_degree, clustering, component_size, is_isolate."""
    return degrees(vertices, edges).join(clustering(vertices, edges).drop("triangles"), "id").join(components(vertices, edges).drop("component"), "id").select("id", "degree", "weighted_degree", "clustering", "component_size", "is_isolate")


def summary(vertices: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """nodes, edges, components, isolates, density, mean_degree, max_degree."""
    d = degrees(vertices, edges).agg(F.count("*").alias("nodes"), F.sum("is_isolate").alias("isolates"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))
    c = components(vertices, edges).agg(F.count_distinct("component").alias("components"))
    m = edges.agg(F.count("*").alias("edges"))
    both = d.crossJoin(c).crossJoin(m)  # one row each
    n = F.col("nodes")
    return both.select("nodes", "edges", "components", "isolates", F.when(n > 1, F.lit(1.0 if directed else 2.0) * F.col("edges") / (n * (n - 1))).otherwise(0.0).alias("density"), "mean_degree", "max_degree")


def neighbours(edges: DataFrame, directed: bool = False) -> DataFrame:
    e = edges.select("src", "dst", "weight")
    return e if directed else e.union(edges.select("dst", "src", "weight")).distinct()


def shortest_paths(edges: DataFrame, sources: DataFrame, mode: str = "hops", directed: bool = False, max_rounds: int = 10_000) -> DataFrame:
    """source, target, path_cost, hops, path_strength, path, for every reachable target, the source itself included.

    Costs are 1 (hops), the weight (distance) or -ln of the weight clamped to (1e-12, 1] (strength).
    All sources advance together; a (source, node) state is settled again only when it gets cheaper,
    so cycles end. Of equally cheap paths the one smallest in text order stays.
    """
    w = F.col("weight")
    cost = {"hops": F.lit(1.0), "distance": w, "strength": -F.ln(F.least(F.greatest(w, F.lit(1e-12)), F.lit(1.0)))}[mode]
    if mode == "distance" and edges.filter("weight < 0").limit(1).count():
        raise ValueError("negative weights")
    steps = _kept(neighbours(edges, directed).filter("src <> dst").select(F.col("src").cast("string").alias("at"), F.col("dst").cast("string").alias("to"), w.alias("weight"), cost.alias("step")))
    key = F.struct(F.round("cost", 12).alias("cost"), "text")
    best = sources.select(F.col("id").cast("string").alias("source"), F.col("id").cast("string").alias("at"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(1.0).alias("strength"), F.col("id").cast("string").alias("text")).distinct()
    frontier = best = _kept(best)
    for _ in range(max_rounds):
        moved = frontier.join(steps, "at").select("source", F.col("to").alias("at"), (F.col("cost") + F.col("step")).alias("cost"), (F.col("hops") + 1).alias("hops"), (F.col("strength") * F.col("weight")).alias("strength"), F.concat_ws(" -> ", "text", "to").alias("text"))
        row = F.struct("cost", "hops", "strength", "text")
        moved = moved.groupBy("source", "at").agg(F.min_by(row, key).alias("r")).select("source", "at", "r.*")
        old = best.select("source", "at", F.col("cost").alias("c0"), F.col("text").alias("t0"))
        better = F.col("c0").isNull() | (F.struct(F.round("cost", 12), F.col("text")) < F.struct(F.round("c0", 12), F.col("t0")))
        frontier = _kept(moved.join(old, ["source", "at"], "left").filter(better).drop("c0", "t0"))
        if frontier.isEmpty():
            return best.select("source", F.col("at").alias("target"), F.col("cost").alias("path_cost"), "hops", F.col("strength").alias("path_strength"), F.col("text").alias("path"))
        best = _kept(best.join(frontier.select("source", "at"), ["source", "at"], "left_anti").unionByName(frontier))
    raise RuntimeError(f"paths still change after {max_rounds} rounds")


def path_pairs(paths: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Every (source, target) pair of the two stated sets, source <> target, with nulls where no path is."""
    pairs = sources.select(F.col("id").cast("string").alias("source")).distinct().crossJoin(targets.select(F.col("id").cast("string").alias("target")).distinct()).filter("source <> target")
    return pairs.join(paths, ["source", "target"], "left")


def nearest_target(pairs: DataFrame) -> DataFrame:
    """source, nearest_target, path_cost, hops, reachable_target_count; ties go to the target first in text order."""
    best = F.min_by(F.struct("target", "path_cost", "hops"), F.struct(F.round("path_cost", 12), "target")).alias("b")
    got = pairs.filter("path_cost is not null").groupBy("source").agg(best, F.count("*").alias("n"))
    return pairs.select("source").distinct().join(got, "source", "left").select("source", F.col("b.target").alias("nearest_target"), F.col("b.path_cost").alias("path_cost"), F.col("b.hops").alias("hops"), F.coalesce("n", F.lit(0)).alias("reachable_target_count"))


def target_coverage(pairs: DataFrame) -> DataFrame:
    """target, source_count, reachable_source_count, coverage, min/mean/max_distance, mean_hops."""
    return pairs.groupBy("target").agg(F.count("*").alias("source_count"), F.count("path_cost").alias("reachable_source_count"), (F.count("path_cost") / F.count("*")).alias("coverage"), F.min("path_cost").alias("min_distance"), F.avg("path_cost").alias("mean_distance"), F.max("path_cost").alias("max_distance"), F.avg("hops").alias("mean_hops"))


def pagerank(vertices: DataFrame, edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, directed: bool = True) -> DataFrame:
    """id, pagerank: weighted power iteration; what dangling vertices hold is spread evenly."""
    ids = _kept(vertices.select("id").distinct())
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("pagerank"))
    out = neighbours(edges, directed)
    total = out.groupBy("src").agg(F.sum("weight").alias("total"))
    share = _kept(out.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    rank = ids.select("id", F.lit(1.0 / n).alias("r"))
    for _ in range(rounds):
        held = rank.join(share.select(F.col("src").alias("id")).distinct(), "id", "left_anti").agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
        got = share.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("r")).alias("got"))
        new = ids.join(got, "id", "left").select("id", (F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + F.lit(held / n)) + F.lit((1 - alpha) / n)).alias("r"))
        new = _kept(new)
        change = new.join(rank.withColumnRenamed("r", "o"), "id").agg(F.sum(F.abs(F.col("r") - F.col("o")))).first()[0]
        rank = new
        if change < n * tolerance:
            break
    return rank.select("id", F.col("r").alias("pagerank"))


def closeness(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, closeness: reachable others over their summed hops, scaled by the share that is reachable."""
    n = vertices.count()
    paths = shortest_paths(edges, vertices).filter("source <> target").groupBy(F.col("source").alias("id")).agg(F.sum("path_cost").alias("s"), F.count("*").alias("m"))
    return vertices.select(F.col("id").cast("string").alias("id")).join(paths, "id", "left").select("id", F.coalesce(F.col("m") / F.col("s") * F.col("m") / F.lit(max(n - 1, 1)), F.lit(0.0)).alias("closeness"))


def path_table(pairs: DataFrame, mode: str) -> DataFrame:
    """source, target, path_mode, path_cost, distance (of a strength path none), hops, path_strength, path."""
    distance = F.lit(None).cast("double") if mode == "strength" else F.col("path_cost")
    return pairs.select("source", "target", F.lit(mode).alias("path_mode"), "path_cost", distance.alias("distance"), "hops", "path_strength", F.coalesce("path", F.lit("")).alias("path"))


def nearest_table(paths: DataFrame) -> DataFrame:
    """source, nearest_target, path_mode, path_cost, distance, hops, path_strength, path, reachable_target_count, target_count, of a path_table."""
    row = F.struct(F.col("target").alias("nearest_target"), "path_mode", "path_cost", "distance", "hops", "path_strength", "path")
    best = F.min_by(F.when(F.col("path_cost").isNotNull(), row), F.when(F.col("path_cost").isNotNull(), F.struct(F.round("path_cost", 12), "target"))).alias("b")
    return paths.groupBy("source").agg(best, F.count("path_cost").alias("reachable_target_count"), F.count("*").alias("target_count")).select("source", "b.*", "reachable_target_count", "target_count")


def run_summary(paths: DataFrame) -> DataFrame:
    """source_count, target_count, reachable_sources, fully_covered_targets, unreached_targets, of a path_table."""
    targets = target_coverage(paths).agg(F.count("*").alias("target_count"), F.count_if(F.expr("coverage = 1")).alias("fully_covered_targets"), F.count_if(F.expr("reachable_source_count = 0")).alias("unreached_targets"))
    sources = paths.groupBy("source").agg(F.count("path_cost").alias("n")).agg(F.count("*").alias("source_count"), F.count_if(F.expr("n > 0")).alias("reachable_sources"))
    return sources.crossJoin(targets).select("source_count", "target_count", "reachable_sources", "fully_covered_targets", "unreached_targets")  # one row each

"""Betweenness and communities, for graphs of which people look at single vertices."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.graph import _kept, components, neighbours


def levels(edges: DataFrame, sources: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """source, id, hops, paths (how many shortest ones): breadth-first from all sources at once."""
    step = _kept(neighbours(edges).filter("src <> dst").select("src", "dst").distinct())
    seen = front = _kept(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops"), F.lit(1.0).alias("paths")))
    for k in range(1, max_rounds):
        new = front.join(step, front["id"] == step["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        front = _kept(new.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(k).alias("hops"), "paths"))
        if front.isEmpty():
            return seen
        seen = _kept(seen.unionByName(front))
    raise RuntimeError(f"levels still grow after {max_rounds} rounds")


def betweenness(vertices: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """id, betweenness: normalised, undirected, unweighted. Dependencies are summed from the last level of all sources back to the first."""
    n = vertices.count()
    starts = vertices if sources is None else sources
    seen = levels(edges, starts)
    step = _kept(neighbours(edges).filter("src <> dst").select("src", "dst").distinct())
    parents = seen.select("source", F.col("id").alias("src"), F.col("hops").alias("h"), F.col("paths").alias("p")).join(step, "src")
    links = _kept(parents.join(seen.select("source", F.col("id").alias("dst"), "hops", "paths"), ["source", "dst"]).filter("hops = h + 1").select("source", "src", "dst", "hops", (F.col("p") / F.col("paths")).alias("share")))
    last = links.agg(F.max("hops")).first()[0] or 0
    held = None
    for k in range(last, 0, -1):
        at = links.filter(F.col("hops") == k)
        down = at.join(held, (at["source"] == held["s"]) & (at["dst"] == held["v"]), "left").select("source", "src", "share", F.coalesce("d", F.lit(0.0)).alias("d")) if held is not None else at.select("source", "src", "share", F.lit(0.0).alias("d"))
        got = down.groupBy(F.col("source").alias("s"), F.col("src").alias("v")).agg(F.sum(F.col("share") * (1 + F.col("d"))).alias("d"))
        held = _kept(got if held is None else held.unionByName(got))
    scale = (n - 1) * (n - 2)
    if held is None or scale <= 0:
        return vertices.select("id", F.lit(0.0).alias("betweenness"))
    sums = held.filter("v <> s").groupBy(F.col("v").alias("id")).agg((F.sum("d") / F.lit(float(scale))).alias("betweenness"))
    return vertices.select("id").join(sums, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def communities(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, community: greedy modularity merges. They never cross components, so each component is a task, with the edge count of the whole graph.

    The pair of the largest gain is merged, of equal ones that with the smallest members; a
    community is named by its smallest member.
    """
    m = edges.filter("src <> dst").count()
    named = components(vertices, edges)
    inside = edges.filter("src <> dst").select("src", "dst").join(named.select(F.col("id").alias("src"), "component"), "src")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        between: dict = {}
        degree: dict = {}
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            for x, y in ((a, b), (b, a)):
                between.setdefault(x, {}).setdefault(y, 0.0)
                between[x][y] += 1 / m
                degree[x] = degree.get(x, 0.0) + 1 / (2 * m)
        members = {v: [v] for v in between}
        order = {v: k for k, v in enumerate(sorted(between))}
        while len(members) > 1:
            gain, a, b = max(((w - 2 * degree[x] * degree[y], x, y) for x in between for y, w in between[x].items() if x < y), key=lambda g: (round(g[0], 12), -order[g[1]], -order[g[2]]), default=(0.0, None, None))
            if gain <= 1e-12:
                break
            for y, w in between.pop(b).items():
                between[y].pop(b, None)
                if y != a:
                    between[a][y] = between[y][a] = between[a].get(y, 0.0) + w
            degree[a] += degree.pop(b)
            members[a] += members.pop(b)
        return pd.DataFrame([(v, min(vs)) for vs in members.values() for v in vs], columns=["id", "community"])

    kind = dict(vertices.dtypes)["id"]
    got = inside.groupBy("component").applyInPandas(merged, f"id {kind}, community {kind}")
    return vertices.select("id").join(got, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """modularity of a labelling (id, community)."""
    e = edges.filter("src <> dst").select("src", "dst")
    both = e.join(labels.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    m = F.count("*")
    ends = both.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    total = both.agg(m.alias("m"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("inside"))
    return ends.agg(F.sum(F.col("d") * F.col("d")).alias("dd")).crossJoin(total).select((F.col("inside") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


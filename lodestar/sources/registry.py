"""A flat registry export as node and edge tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.labels import number
from lodestar.operators import neighbours, shaping


@dataclass(frozen=True)
class RegistryProfile:
    """Which columns are what, and how edges are made: knn, shared (with edge_column) or none."""

    id_column: str
    feature_columns: tuple[str, ...]
    outcome_column: str | None = None
    edge_strategy: str = "knn"
    edge_column: str | None = None
    k: int = 5
    drop_columns: tuple[str, ...] = field(default=())


def adapt(df: DataFrame, profile: RegistryProfile) -> tuple[DataFrame, DataFrame, dict]:
    """nodes (ID, features as numbers with 0 for what is none, Outcome), edges, and a manifest."""
    if profile.edge_strategy not in ("knn", "shared", "none"):
        raise ValueError(f"edge strategy {profile.edge_strategy}")
    if missing := [c for c in (profile.id_column, *profile.feature_columns) if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    features = [c for c in profile.feature_columns if c not in profile.drop_columns]
    cols = [F.col(profile.id_column).cast("string").alias("ID"), *(number(F.col(c).cast("string"), 0.0).alias(c) for c in features)]
    if profile.outcome_column:
        cols.append(F.col(profile.outcome_column).cast("string").alias("Outcome"))
    nodes = df.select(*cols)
    if profile.edge_strategy == "knn":
        edges = neighbours.knn_edges(neighbours.standardised_columns(nodes, "ID", features), "ID", "z", profile.k)
        note = f"k nearest of standardised features, k = {profile.k}; edges restate the features"
    elif profile.edge_strategy == "shared":
        edges = neighbours.all_shared_pairs(df.select(F.col(profile.id_column).cast("string").alias("ID"), profile.edge_column), "ID", profile.edge_column)
        note = f"cases with equal {profile.edge_column}"
    else:
        edges = nodes.sparkSession.createDataFrame([], "SourceID string, TargetID string, Weight double")
        note = "no edges"
    return nodes, edges, {"n_cases": nodes.count(), "feature_columns": features, "outcome_column": profile.outcome_column, "edge_strategy": profile.edge_strategy, "n_edges": edges.count(), "edge_note": note, "dropped_columns": list(profile.drop_columns), "source_sha256": shaping.frame_digest(df).first().sha256, "note": "edges are made, not observed" if profile.edge_strategy != "none" else "a table without a graph"}


def graph_edges(nodes: DataFrame, key: str, features: list[str], mode: str = "none", k: int = 10, observed: DataFrame | None = None) -> DataFrame:
    """Edges of a graph mode: none, similarity (nearest of mean-filled, standardised features, constant columns kept), or the observed ones as they are."""
    if mode == "observed":
        if observed is None:
            raise ValueError("observed edges are missing")
        return observed
    if mode == "similarity":
        return neighbours.knn_edges(neighbours.standardised_columns(nodes, key, features, impute=True, keep_constant=True), "ID", "z", k)
    if mode != "none":
        raise ValueError(f"graph mode {mode}")
    return nodes.sparkSession.createDataFrame([], "SourceID string, TargetID string, Weight double")

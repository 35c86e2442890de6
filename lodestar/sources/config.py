"""Run configurations: read from YAML, inferred from tables, and checked before anything runs."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from lodestar.operators import profiles

MODELS = ("logistic", "random_forest", "gradient_boosting", "neural", "none")
SPLITS = ("stratified", "community")
GRAPHS = ("none", "similarity", "observed")


@dataclass
class RunConfig:
    """What to read, what is what, and what to run."""

    nodes: str = ""
    edges: str | None = None
    output: str = "out"
    id_column: str = "ID"
    outcome_column: str | None = "Outcome"
    feature_columns: list[str] = field(default_factory=list)
    exclude_columns: list[str] = field(default_factory=list)
    leakage_flags: list[str] = field(default_factory=list)
    graph_mode: str = "none"
    k_neighbors: int = 10
    centrality: bool = False
    semantics: str = "unspecified"
    edge_timing: str = "unknown"
    path_mode: str = "hops"
    targets: str | None = None
    model: str = "none"
    iterations: int = 10
    permutations: int = 0
    split: str = "stratified"
    test_size: float = 0.2
    contest_quantile: float = 0.1
    clusters: int | None = None
    seed: int = 42

    def problems(self) -> list[str]:
        """Everything that is wrong, not only the first."""
        out = [] if self.nodes else ["nodes: a path is needed"]
        for name, known in (("model", MODELS), ("split", SPLITS), ("graph_mode", GRAPHS), ("path_mode", ("hops", "distance", "strength")), ("semantics", ("unspecified", "similarity", "observed_relation")), ("edge_timing", ("unknown", "pre_outcome", "post_outcome"))):
            if getattr(self, name) not in known:
                out.append(f"{name}: {getattr(self, name)!r} is none of {', '.join(known)}")
        if not 0 < self.test_size < 1:
            out.append("test_size: must be between 0 and 1")
        if not 0 < self.contest_quantile < 1:
            out.append("contest_quantile: must be between 0 and 1")
        if self.k_neighbors < 1 or self.iterations < 1 or self.permutations < 0:
            out.append("k_neighbors and iterations must be at least 1, permutations at least 0")
        if self.graph_mode == "observed" and not self.edges:
            out.append("edges: a path is needed for observed edges")
        if self.model != "none" and not self.outcome_column:
            out.append("outcome_column: a model needs one")
        return out


def from_dict(data: dict) -> RunConfig:
    known = {f.name for f in fields(RunConfig)}
    if unknown := sorted(set(data) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return RunConfig(**data)


def load(path: str) -> RunConfig:
    """A YAML file; raises ValueError with all that is wrong."""
    import yaml  # only configuration files need it

    with open(path) as f:
        out = from_dict(yaml.safe_load(f) or {})
    if wrong := out.problems():
        raise ValueError("; ".join(wrong))
    return out


def save(config: RunConfig, path: str) -> None:
    import yaml

    with open(path, "w") as f:
        yaml.safe_dump(asdict(config), f, sort_keys=False)


def plan(spark: SparkSession, nodes: str, edges: str | None = None, table: DataFrame | None = None) -> RunConfig:
    """A configuration inferred from the tables: roles from names and values, columns that look like leakage flagged and excluded, a model only where its classes have five rows."""
    from lodestar.sources import tables

    df = table if table is not None else tables.read_csv(spark, nodes)
    roles = {r["column"]: r["role"] for r in profiles.infer_schema(df).collect()}
    first = lambda role, other: next((c for c, r in roles.items() if r == role), other)
    outcome = first("outcome", None)
    leaks = [c for c, r in roles.items() if r == "leakage"]
    key = first("id", df.columns[0])
    features = [c for c in profiles.numeric_columns(df) if roles[c] == "feature" and c not in (key, outcome)]
    enough = outcome is not None and (df.filter(df[outcome].isNotNull()).groupBy(outcome).count().agg({"count": "min"}).first()[0] or 0) >= 5
    return RunConfig(nodes=nodes, edges=edges, id_column=key, outcome_column=outcome, feature_columns=features, exclude_columns=leaks, leakage_flags=leaks, graph_mode="observed" if edges else "none", model="logistic" if enough else "none")

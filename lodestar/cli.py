"""Command lines: analyse (node and edge tables), plan and run (configurations), audit (ratings)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import sinks
from lodestar.functions.labels import is_blank
from lodestar.operators import audit, claims, geometry, graph, models, profiles, shaping
from lodestar.sources import config, registry, tables


def analyse(spark: SparkSession, c: config.RunConfig) -> dict:
    """Everything a configuration asks for, written to its folder; the summary is returned and written too."""
    if wrong := c.problems():
        raise ValueError("; ".join(wrong))
    out = c.output
    nodes, log = tables.normalised(tables.read_csv(spark, c.nodes, (c.id_column, "ID")), tables.NODE_ROLES)
    key = "ID" if "ID" in nodes.columns else c.id_column
    outcome = ("Outcome" if "Outcome" in nodes.columns else c.outcome_column) if c.outcome_column else None
    features = [f for f in (c.feature_columns or profiles.numeric_columns(nodes, key, outcome)) if f not in c.exclude_columns]
    nodes = sinks.pruned_inputs(nodes, out, key, outcome, features, c.exclude_columns).withColumn(key, F.col(key).cast("string"))
    done: dict = {"ingest": log, "features": features}
    edges = None
    if c.edges:
        edges, more = tables.normalised(tables.read_csv(spark, c.edges), tables.EDGE_ROLES)
        done["ingest"] = [*log, *more]
        checks = profiles.validate(nodes.withColumnRenamed(key, "ID"), edges).first().asDict()
        sinks.write_json(checks, out, "validation")
        if checks["missing_endpoints"]:
            raise ValueError(f"{checks['missing_endpoints']} edge endpoints are no nodes")
    made = registry.graph_edges(nodes, key, features, c.graph_mode, c.k_neighbors, edges) if c.graph_mode != "none" else edges
    if made is not None:
        done |= _graph(spark, c, nodes, key, outcome, made, out)
    labelled = nodes.filter(~is_blank(F.col(outcome))) if outcome else None
    counts = {str(r[0]): r[1] for r in labelled.groupBy(outcome).count().collect()} if outcome else {}
    rows = models.aligned(nodes, features, "_v")
    if len(counts) >= 2 and features:
        done |= _geometry(spark, c, rows, key, outcome, out)
    gate = claims.safety_gate(counts, int(sum(counts.values()) * c.test_size))
    done["safety"] = gate
    gates = {}
    if c.model != "none" and not gate["blocked"] and features:
        run = models.outcome_model(models.aligned(labelled, features, "_v"), key, "_v", outcome, c.model, c.iterations, c.permutations)
        sinks.write_table(run["iterations"], out, "iteration_metrics", single=True)
        sinks.write_table(run["importance"], out, "feature_importance", single=True)
        sinks.write_table(run["learning_curve"], out, "learning_curve", single=True)
        done["metrics"] = [r.asDict() for r in run["summary"].orderBy("metric").collect()]
        done["warnings"] = run["warnings"]
        p = run["permutation"].first().p_value if "permutation" in run else None
        gates = {"permutation": claims.permutation_gate(p), "graph_semantics": claims.graph_semantics_gate(c.semantics, c.edge_timing), "external_validation": "untested", "baselines": "untested", "split_comparison": "untested"}
    record = {"model_trained": bool(gates), "headline": claims.headline(gates, bool(set(c.leakage_flags) & set(features))) if gates else "no model", **gates, "clinical_caveat": sinks.CAVEAT}
    done["claims"] = record
    made_by = sinks.provenance(spark, [c.nodes, c.edges], c.seed)
    sinks.write_json(record, out, "claims")
    sinks.write_json(made_by, out, "provenance")
    sinks.write_json(done, out, "run_summary")
    sinks.write_text(sinks.environment(spark), out, "environment.txt")
    card = sinks.model_card({"model": c.model, "data": {"nodes": c.nodes, "rows": nodes.count()}, "metrics": done.get("metrics"), "claims": record, "warnings": gate["warnings"], "provenance": made_by})
    sinks.write_text(card, out, "model_card.md")
    sinks.write_text(sinks.html_report("Run", {"Summary": json.dumps(done, indent=2, sort_keys=True, default=str)}, record, made_by), out, "report.html")
    sinks.bundle(out)
    return done


def _graph(spark: SparkSession, c: config.RunConfig, nodes: DataFrame, key: str, outcome: str | None, edges: DataFrame, out: str) -> dict:
    weight = [F.col("Weight").cast("double").alias("weight")] if "Weight" in edges.columns else []
    v = nodes.select(F.col(key).alias("id"))
    e = graph.canonical(edges.select(F.col("SourceID").cast("string").alias("src"), F.col("TargetID").cast("string").alias("dst"), *weight))
    sinks.write_table(graph.node_features(v, e).withColumnRenamed("id", "ID"), out, "node_features", single=True)
    summary = graph.summary(v, e).first().asDict() | {"directed": False}
    sinks.write_json(summary, out, "graph_summary")
    done = {"graph": summary}
    targets = None
    if c.targets:
        targets = shaping.members(v, "id", shaping.comma_list(c.targets))
    elif outcome:
        targets = shaping.target_rows(nodes.filter(~is_blank(F.col(outcome))), outcome).select(F.col(key).alias("id"))
    if targets is not None:
        paths = graph.path_table(graph.path_pairs(graph.shortest_paths(e, v, c.path_mode), v, targets), c.path_mode)
        sinks.write_table(paths, out, "shortest_paths", single=True)
        sinks.write_table(graph.nearest_table(paths), out, "nearest_targets", single=True)
        sinks.write_table(graph.target_coverage(paths), out, "target_coverage", single=True)
        done["paths"] = graph.run_summary(paths).first().asDict()
    degrees = graph.degrees(v, e)
    sinks.write_text(sinks.network_html(degrees, e), out, "network.html")
    return done


def _geometry(spark: SparkSession, c: config.RunConfig, rows: DataFrame, key: str, outcome: str, out: str) -> dict:
    fitted = geometry.fit(rows.withColumn("_label", F.when(~is_blank(F.col(outcome)), F.col(outcome).cast("string"))), "_v", "_label")
    table = geometry.node_contestability(rows, key, "_v", outcome, fitted, c.contest_quantile)
    summary = geometry.contest_summary(spark, table, geometry.contestability(rows, "_v", fitted, key), fitted, c.contest_quantile)
    sinks.write_table(table, out, "node_contestability", single=True)
    sinks.write_json(summary, out, "contest_summary")
    most = [r.asDict() for r in geometry.most_contested(table.select("ID", "nearest_class_centroid", "runner_up_class", "flip_distance")).collect()]
    sinks.write_text(sinks.contestability_report(summary, most), out, "contestability_report.md")
    clusters, about = models.clustered(rows, key, "_v", outcome, c.clusters)
    sinks.write_table(clusters, out, "node_clusters", single=True)
    sinks.write_json(about, out, "cluster_summary")
    centroids = spark.createDataFrame([(k, p, float(x)) for k, row in zip(fitted.classes, fitted.centroids, strict=True) for p, x in zip(fitted.kept, row, strict=True)], "class string, feature int, z double")
    sinks.write_table(centroids, out, "cluster_centroids", single=True)
    return {"contestability": {k: summary[k] for k in ("n_scored", "flip_distance", "runner_up_counts")}, "clusters": about}


def audit_files(spark: SparkSession, human: str, judge: str, out: str, alpha: float = 0.1, replicates: int = 1000) -> dict:
    """A blinded audit of two rating files, its results and report written to out."""
    people, machine = tables.read_ratings(spark, human, judge)
    a = audit.BlindedAudit("audit")
    a.seal(people)
    results = a.close(machine, alpha, replicates)
    sinks.write_json(results, out, "judge_audit")
    sinks.write_text(audit.report(results), out, "judge_audit.md")
    return results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar", description="Graph-and-evidence analytics on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyse", help="node and edge tables to a folder of results")
    a.add_argument("--nodes", required=True)
    a.add_argument("--edges")
    a.add_argument("--output", required=True)
    a.add_argument("--id-column", default="ID")
    a.add_argument("--outcome-column", default="Outcome")
    a.add_argument("--features", default="", help="comma list; all numeric columns by default")
    a.add_argument("--exclude", default="", help="comma list")
    a.add_argument("--graph-mode", default=None, choices=config.GRAPHS)
    a.add_argument("--k", type=int, default=10)
    a.add_argument("--path-mode", default="hops", choices=("hops", "distance", "strength"))
    a.add_argument("--targets", help="comma list of ids; nodes of the largest outcome by default")
    a.add_argument("--model", default="none", choices=config.MODELS)
    a.add_argument("--iterations", type=int, default=10)
    a.add_argument("--permutations", type=int, default=0)
    a.add_argument("--contest-quantile", type=float, default=0.1)
    a.add_argument("--seed", type=int, default=42)
    pl = sub.add_parser("plan", help="a configuration inferred from tables")
    pl.add_argument("--nodes", required=True)
    pl.add_argument("--edges")
    pl.add_argument("--config", required=True)
    r = sub.add_parser("run", help="run a configuration")
    r.add_argument("--config", required=True)
    u = sub.add_parser("audit", help="a judge's ratings against people's")
    u.add_argument("--human", required=True)
    u.add_argument("--judge", required=True)
    u.add_argument("--output", required=True)
    u.add_argument("--alpha", type=float, default=0.1)
    u.add_argument("--replicates", type=int, default=1000)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestar").getOrCreate()
    if args.command == "audit":
        audit_files(spark, args.human, args.judge, args.output, args.alpha, args.replicates)
    elif args.command == "plan":
        config.save(config.plan(spark, args.nodes, args.edges), args.config)
    elif args.command == "run":
        analyse(spark, config.load(args.config))
    else:
        mode = args.graph_mode or ("observed" if args.edges else "none")
        analyse(spark, config.RunConfig(nodes=args.nodes, edges=args.edges, output=args.output, id_column=args.id_column, outcome_column=args.outcome_column or None, feature_columns=shaping.comma_list(args.features), exclude_columns=shaping.comma_list(args.exclude), graph_mode=mode, k_neighbors=args.k, path_mode=args.path_mode, targets=args.targets, model=args.model, iterations=args.iterations, permutations=args.permutations, contest_quantile=args.contest_quantile, seed=args.seed))
    return 0


if __name__ == "__main__":
    sys.exit(main())

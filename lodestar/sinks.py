"""Writers: tables in their contract's columns, JSON documents, Markdown and HTML reports, and the bundle."""

from __future__ import annotations

import datetime
import hashlib
import html
import json
import os
import platform
import subprocess
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, folder: str, name: str, form: str = "csv", single: bool = False) -> str:
    """df as a folder of files; `single` makes one file of a table that people read, and is not for large ones. Arrays and maps become JSON in a CSV."""
    if form == "csv":
        df = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes))
    out = (df.coalesce(1) if single else df).write.mode("overwrite")
    path = f"{folder.rstrip('/')}/{name}"
    out.option("header", True).csv(path) if form == "csv" else out.parquet(path)
    return path


def write_json(data, folder: str, name: str) -> str:
    """Keys in order, so that equal content is equal text."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}.json"
    with open(path, "w") as f:
        json.dump(data, f, indent=2, sort_keys=True, default=str)
        f.write("\n")
    return path


def write_text(text: str, folder: str, name: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write(text)
    return path


def file_digest(path: str) -> str:
    """sha256 of a file, or of a folder's files in the order of their names."""
    total = hashlib.sha256()
    names = [path] if os.path.isfile(path) else sorted(os.path.join(d, x) for d, _, xs in os.walk(path) for x in xs if not x.startswith(("_", ".")))
    for name in names:
        with open(name, "rb") as f:
            while block := f.read(1 << 20):
                total.update(block)
    return total.hexdigest()


def provenance(spark: SparkSession, inputs: list[str], seed: int | None = None) -> dict:
    """Versions, code state, seed, time in UTC, and digests of the inputs that are local files."""
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], cwd=os.path.dirname(os.path.abspath(__file__)), capture_output=True, text=True, timeout=10).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        commit = None
    from importlib.metadata import PackageNotFoundError, version

    packages = {}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            packages[name] = version(name)
        except PackageNotFoundError:
            packages[name] = None
    return {"python": platform.python_version(), "spark": spark.version, "packages": packages, "git_commit": commit, "seed": seed, "created_utc": datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "inputs": {p: file_digest(p) for p in inputs if p and os.path.exists(p)}}


def environment(spark: SparkSession) -> str:
    """Versions and the SQL settings of the session, a line each."""
    confs = sorted((r.key, r.value) for r in spark.sql("SET").collect())
    return "\n".join([f"python {platform.python_version()}", f"spark {spark.version}", *(f"{k}={v}" for k, v in confs)]) + "\n"


def fmt(x) -> str:
    return "none" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


def markdown_table(rows: list[dict]) -> str:
    if not rows:
        return "(no rows)\n"
    names = list(rows[0])
    return "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(fmt(r.get(n)) for n in names) + " |" for r in rows)]) + "\n"


CAVEAT = "A research and education tool, not decision support."


def contestability_report(summary: dict, most: list[dict]) -> str:
    """The most contested rows and what moves the border."""
    flip = [{"statistic": k, "value": v} for k, v in summary["flip_distance"].items()]
    return "\n".join(["# Contestability", "", CAVEAT, "", f"{summary['n_scored']} rows, {summary['n_classes']} classes, {summary['distance_metric']} distance.", "", markdown_table(flip), "## Most contested", "", markdown_table(most), "## Leverage", "", markdown_table(summary["feature_leverage"][:15]), "## Caveats", "", *(f"- {c}" for c in summary["caveats"]), ""])


def comparison_report(rows: list[dict]) -> str:
    return "\n".join(["# Representations on the same splits", "", CAVEAT, "", markdown_table(rows)])


def model_card(run: dict) -> str:
    """Seven sections; what a run lacks is said to be missing."""
    parts = [("Model", run.get("model")), ("Data", run.get("data")), ("Metrics", run.get("metrics")), ("Importance", run.get("importance")), ("Claims", run.get("claims")), ("Limits", run.get("warnings")), ("Provenance", run.get("provenance"))]
    lines = ["# Model card", "", CAVEAT, ""]
    for title, body in parts:
        lines += [f"## {title}", ""]
        if body is None or body == []:
            lines.append("Not available in this run.")
        elif isinstance(body, list) and isinstance(body[0], dict):
            lines.append(markdown_table(body))
        elif isinstance(body, dict):
            lines += [f"- {k}: {fmt(v)}" for k, v in body.items()]
        else:
            lines += [f"- {x}" for x in (body if isinstance(body, list) else [body])]
        lines.append("")
    return "\n".join(lines)


def html_report(title: str, sections: dict[str, str], claims: dict | None, made: dict | None) -> str:
    """One page without outside parts; the caveat, claims and provenance are always there."""
    def body(text: str) -> str:
        return f"<pre>{html.escape(text)}</pre>"

    parts = [f"<h1>{html.escape(title)}</h1><p class=caveat>{CAVEAT}</p>"]
    parts += [f"<h2>{html.escape(k)}</h2>{body(v)}" for k, v in sections.items()]
    for name, data in (("Claims", claims), ("Provenance", made)):
        parts.append(f"<h2>{name}</h2>" + (body(json.dumps(data, indent=2, sort_keys=True, default=str)) if data else "<p>Not available.</p>"))
    return "<!doctype html><meta charset=utf-8><title>" + html.escape(title) + "</title><style>body{font-family:sans-serif;max-width:60em;margin:2em auto}pre{background:#f4f4f4;padding:1em;overflow:auto}.caveat{font-weight:bold}</style>" + "".join(parts) + "\n"


def network_html(vertices: DataFrame, edges: DataFrame, most: int = 500) -> str:
    """A picture of the `most` vertices of highest degree and the edges between them: a page for reading, of bounded size. vertices: id, degree; edges: src, dst, weight."""
    top = vertices.orderBy(F.desc("degree"), "id").limit(most)
    ids = [str(r.id) for r in top.collect()]
    at = {x: k for k, x in enumerate(ids)}
    some = top.select(F.col("id"))
    links = edges.join(F.broadcast(some.withColumnRenamed("id", "src")), "src", "left_semi").join(F.broadcast(some.withColumnRenamed("id", "dst")), "dst", "left_semi").select("src", "dst").collect()
    import math

    spot = [(300 + 280 * math.cos(2 * math.pi * k / max(len(ids), 1)), 300 + 280 * math.sin(2 * math.pi * k / max(len(ids), 1))) for k in range(len(ids))]
    lines = "".join(f'<line x1="{spot[at[str(r.src)]][0]:.1f}" y1="{spot[at[str(r.src)]][1]:.1f}" x2="{spot[at[str(r.dst)]][0]:.1f}" y2="{spot[at[str(r.dst)]][1]:.1f}" stroke="#999"/>' for r in links)
    dots = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="4"><title>{html.escape(i)}</title></circle>' for i, (x, y) in zip(ids, spot, strict=True))
    return f'<!doctype html><meta charset=utf-8><title>Network</title><svg width="600" height="600">{lines}{dots}</svg>\n'


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """low, high, n: the data of a histogram, in `bins` rows at most."""
    s = F.broadcast(df.agg(F.min(value).alias("_a"), F.max(value).alias("_b")))  # one row
    width = F.greatest((F.col("_b") - F.col("_a")) / bins, F.lit(1e-300))
    b = F.least(F.floor((F.col(value) - F.col("_a")) / width), F.lit(bins - 1))
    return df.filter(F.col(value).isNotNull()).crossJoin(s).select(b.alias("b"), "_a", width.alias("w")).groupBy("b").agg(F.first("_a").alias("_a"), F.first("w").alias("w"), F.count("*").alias("n")).select((F.col("_a") + F.col("b") * F.col("w")).alias("low"), (F.col("_a") + (F.col("b") + 1) * F.col("w")).alias("high"), "n").orderBy("low")


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, share: the data of a calibration plot."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("share")).orderBy("bin")


def pruned_inputs(nodes: DataFrame, folder: str, key: str, outcome: str | None, features: list[str], exclude: list[str]) -> DataFrame:
    """The node table as analysed, without excluded columns, written and read again."""
    from lodestar.operators import shaping

    path = write_table(shaping.selected(nodes, key, outcome, features or None, exclude), folder, "analysed_nodes", "parquet")
    return nodes.sparkSession.read.parquet(path)


def bundle(folder: str, name: str = "bundle.zip") -> str:
    """All files of a run's folder in one zip, in the order of their names, with the same bytes for the same files."""
    path = f"{folder}/{name}"
    found = sorted(os.path.join(d, x) for d, _, xs in os.walk(folder) for x in xs if x != name and not x.startswith((".", "_")))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in found:
            with open(f, "rb") as data:
                z.writestr(zipfile.ZipInfo(os.path.relpath(f, folder), (2000, 1, 1, 0, 0, 0)), data.read(), zipfile.ZIP_DEFLATED)
    return path

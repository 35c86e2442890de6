"""Spectral embedding of a graph, and the constant feature that stands for no information."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.graph import _kept, neighbours

#: Vertices up to which the Laplacian is decomposed on the driver; beyond, blocks of vectors are multiplied by Spark.
DENSE = 2000


def embedding(vertices: DataFrame, edges: DataFrame, components: int = 8, rounds: int = 200, seed: int = 42) -> DataFrame:
    """ID, spectral (array): eigenvectors of the symmetrically normalised weighted Laplacian after the first, divided by the roots of the degrees.

    At most n - 2 components. A component's largest entry, of equal ones that of the smallest id, is
    positive. Up to DENSE vertices they come from an exact decomposition; beyond, from block power
    iteration, in which the driver holds only matrices of components x components.
    """
    n = vertices.select("id").distinct().count()
    if n < 3:
        raise ValueError("an embedding needs at least 3 vertices")
    k = max(1, min(components, n - 2))
    e = neighbours(edges).filter("src <> dst").groupBy(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).agg(F.max("weight").alias("w"))
    ids = vertices.select(F.col("id").cast("string").alias("ID")).distinct()
    return _dense(ids, e, k) if n <= DENSE else _distributed(ids, e, k, rounds, seed)


def _dense(ids: DataFrame, e: DataFrame, k: int) -> DataFrame:
    names = [r.ID for r in ids.orderBy("ID").collect()]  # DENSE at most
    at = {x: i for i, x in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for r in e.toLocalIterator():
        w[at[r.src], at[r.dst]] = r.w
    degree = w.sum(1)
    root = np.sqrt(np.where(degree > 0, degree, 1.0))
    laplacian = np.diag((degree > 0).astype(float)) - w / np.outer(root, root)
    _, vectors = np.linalg.eigh(laplacian)
    x = vectors[:, 1 : k + 1] / root[:, None]
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return ids.sparkSession.createDataFrame(list(zip(names, x.tolist(), strict=True)), "ID string, spectral array<double>")


def _distributed(ids: DataFrame, e: DataFrame, k: int, rounds: int, seed: int) -> DataFrame:
    """Power iteration of (I + D^-1/2 W D^-1/2) / 2 on k + 1 vectors, made orthonormal by the root of their Gramian."""
    degree = e.groupBy(F.col("src").alias("ID")).agg(F.sum("w").alias("d"))
    vertices = _kept(ids.join(degree, "ID", "left").select("ID", F.sqrt(F.coalesce("d", F.lit(1.0))).alias("root")))
    r = vertices.select(F.col("ID"), "root")
    steps = _kept(e.join(r.select(F.col("ID").alias("src"), F.col("root").alias("a")), "src").join(r.select(F.col("ID").alias("dst"), F.col("root").alias("b")), "dst").select("src", "dst", (F.col("w") / F.col("a") / F.col("b")).alias("w")))
    width = k + 1
    x = vertices.select("ID", F.array(F.col("root"), *(F.xxhash64(F.lit(seed + c), "ID") / F.lit(2.0**63) for c in range(k))).alias("x"))
    held, former = _kept(x), None
    for _ in range(rounds):
        gram = held.agg(F.array(*(F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(width) for j in range(width)))).first()[0]
        values, axes = np.linalg.eigh(np.array(gram).reshape(width, width))
        turn = np.linalg.inv(np.linalg.cholesky(np.array(gram).reshape(width, width) + 1e-18 * np.eye(width))).T if values.min() > 1e-12 * values.max() else axes / np.sqrt(np.maximum(values, 1e-300))
        x = held.select("ID", F.array(*(sum((F.col("x")[i] * float(turn[i, j]) for i in range(width)), F.lit(0.0)) for j in range(width))).alias("x"))
        moved = steps.join(x.withColumnRenamed("ID", "dst"), "dst").groupBy(F.col("src").alias("ID")).agg(F.array(*(F.sum(F.col("w") * F.col("x")[c]) for c in range(width))).alias("y"))
        zero = F.array(*(F.lit(0.0) for _ in range(width)))
        held = _kept(x.join(moved, "ID", "left").select("ID", F.zip_with("x", F.coalesce("y", zero), lambda a, b: (a + b) / 2).alias("x")))
        now = np.sort(np.abs(values))
        if former is not None and np.abs(now - former).max() < 1e-12 * now.max():
            break
        former = now
    out = held.join(vertices, "ID").select("ID", F.transform(F.slice("x", 2, k), lambda v: v / F.col("root")).alias("x"))
    tops = [out.agg(F.max_by(F.col("x")[c], F.struct(F.abs(F.col("x")[c]), F.col("ID")))).first()[0] for c in range(k)]
    return out.select("ID", F.array(*(F.col("x")[c] * (-1.0 if (tops[c] or 0) < 0 else 1.0) for c in range(k))).alias("spectral"))


def no_information(vertices: DataFrame) -> DataFrame:
    """ID, constant 0: the floor that a representation must beat."""
    return vertices.select(F.col("id").cast("string").alias("ID"), F.lit(0.0).alias("constant"))


def with_embedding(features: DataFrame, spectral: DataFrame, key: str = "ID") -> DataFrame:
    """features joined to an embedding; a row without one gets zeros."""
    width = (spectral.select(F.size("spectral").alias("n")).first() or [0])[0]
    zero = F.array(*(F.lit(0.0) for _ in range(width))).cast("array<double>")
    return features.join(spectral, key, "left").withColumn("spectral", F.coalesce("spectral", zero))

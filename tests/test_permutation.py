"""The permutation test shuffles labels, and compares the real score with the shuffled ones."""

import hashlib
import math

from pyspark.sql import functions as F

from lodestar.operators import metrics
from lodestar.plans import catalog

SF = "/root/testdata/sf0.001"


def hashed(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_query_equals_brute_force(spark):
    rows = [(r.y, r.p) for r in catalog._scored(spark, SF).orderBy("doc_id").collect()]
    labels, n = [y for y, _ in rows], len(rows)
    observed, extreme = sum(y == p for y, p in rows), 0
    for rep in range(1000):
        order = sorted(range(n), key=lambda i: (hashed(42, rep, i), i))
        extreme += sum(labels[i] == rows[k][1] for k, i in enumerate(order)) >= observed
    got = catalog.QUERIES["permutation_p_value"](spark, SF).first()
    assert (got.observed, got.permutations, got.p_value) == (round(observed / n, 6), 1000, round((extreme + 1) / 1001, 6))


def shuffles(spark, labels, predicted, n=500):
    rows = spark.createDataFrame([(k, y, p) for k, (y, p) in enumerate(zip(labels, predicted, strict=True))], "i long, y int, p int")
    right = F.avg((F.col("y") == F.col("p")).cast("int")).alias("v")
    return metrics.shuffled(rows, "i", "y", n), rows.agg(right), right


def test_labels_are_permuted(spark):
    y, p = [k % 5 == 0 for k in range(60)], [k % 3 == 0 for k in range(60)]
    drawn, _, right = shuffles(spark, map(int, y), map(int, p))
    got = drawn.groupBy("rep").agg(F.sum("y").alias("ones"), F.count_distinct("i").alias("rows"), F.sum(F.col("i") * F.col("y")).alias("where"), right).collect()
    assert len(got) == 500 and {(r.ones, r.rows) for r in got} == {(12, 60)} and len({r["where"] for r in got}) > 100
    # of shuffled labels, the accuracy's mean and deviation are those of a hypergeometric count
    mean = sum(r.v for r in got) / 500
    sd = math.sqrt(sum((r.v - mean) ** 2 for r in got) / 499)
    hits = 60 * (1 / 5) * (4 / 5) * (1 / 3) * (2 / 3) * 60 / 59
    assert abs(mean - (0.2 / 3 + 0.8 * 2 / 3)) < 0.02 and abs(sd - 2 * math.sqrt(hits) / 60) < 0.02


def test_p_value_tells_a_right_predictor_from_a_constant_one(spark):
    y = [int(k % 2 == 0) for k in range(40)]
    for predicted, want in ((y, 1 / 501), ([1] * 40, 1.0)):
        drawn, observed, right = shuffles(spark, y, predicted)
        assert metrics.permutation_p(observed, drawn.groupBy("rep").agg(right), "v").first().p_value == want

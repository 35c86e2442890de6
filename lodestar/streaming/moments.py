"""Mergeable moments over a stream: windows by event time and site, late rows dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(stream: DataFrame, time: str, site: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, site, n, mean, m2; the same for a batch and for a stream, where rows later than `late` are dropped."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    got = rows.groupBy(F.window(time, width).alias("w"), F.col(site).alias("site")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))
    return got.select(F.col("w.start").alias("window_start"), "site", "n", "mean", "m2")

"""A corpus pipeline over documents: five stages, each on all that the one before it kept.

Every stage but the last returns the columns of documents. The first learns a model and the third
follows links, so there is no SQL for the rows; the tests hold them against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bpe, byte_conv, decontaminate, line_dedup, ngram_join
from lodestar.llm.common import stored
from lodestar.llm.queries import bpe_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (1): documents that it rejects go."""
    return byte_conv.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (9): every document stays, without the lines that an earlier document has."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (7): of each group of near-duplicates the document with the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (5): documents that hold a test item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding (6): doc_id, n_tokens, ids, and whether the ids decode to the text."""
    encoded = bpe.encode(docs.select("doc_id", "text", docs["text"].alias("given")), bpe_path(), "given")
    decoded = bpe.decode(encoded, bpe_path())
    return decoded.selectExpr("doc_id", "n_tokens", "ids", "decoded = coalesce(given, '') AS round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

#: No SQL gives the rows of the first stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the documents of sf_dir; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs

"""Line dedup (9): repeated lines of a corpus, removed except in their first document.

Hashed line keys are range-partitioned by (key, document, position) and sorted so within each
partition. One stream over a partition sees a key's lines in document order: what comes after the
first document is dropped. A frequent key may span many partitions, as the document is part of the
range; each partition therefore also reports its first and last key, and these markers (one row per
partition, whatever the input) say which first runs continue an earlier partition. The result is a
compressed bitmap per document that loses lines, not text.

Defined results: a null or empty text is one empty line. Lines with keys under `min_chars` code
points always stay. Rows that repeat a doc_id are one document: none of them drops a line for the
other. A null doc_id sorts before all others. An empty table gives an empty table. Extra columns are
ignored by the bitmaps and kept by `dedup_lines`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import SPACE, documents, lean, partitions, stored, texts, tune

#: Code points that a key needs to count.
MIN_CHARS = 10

LINES = "h1 long, h2 long, doc_id long, row_fp long, line int"
STREAMED = "kind int, pid int, doc_id long, row_fp long, line int, first1 long, first2 long, last1 long, last2 long, last_doc long, one_run boolean"


def line_keys(text: bytes) -> list[bytes]:
    """The key of every line: white space stripped at both ends, A-Z lower-cased."""
    return [x.strip(SPACE) for x in text.lower().split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars


def hashed_lines(min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps = batch.column("doc_id").to_pylist(), batch.column("row_fp").to_pylist()
            hashes, rows, at = [], [], []
            for k, text in enumerate(texts(batch)):
                for i, key in enumerate(line_keys(text)):
                    if long_enough(key, min_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        rows.append(k)
                        at.append(i)
            h = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([ids[k] for k in rows], pa.int64()), pa.array([fps[k] for k in rows], pa.int64()), pa.array(at, pa.int32())], ["h1", "h2", "doc_id", "row_fp", "line"])

    return run


def later_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: kind 0, lines after the key's first document; kind 1, lines of the first
    run's first document, which an earlier partition may own; kind 2, the marker."""
    pid = TaskContext.get().partitionId()
    schema = pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("doc_id", pa.int64()), ("row_fp", pa.int64()), ("line", pa.int32()), *((n, pa.int64()) for n in ("first1", "first2", "last1", "last2", "last_doc")), ("one_run", pa.bool_())])
    first_key, last, runs = None, None, 0  # last: key and first document (id, whether it is null) of the run at hand
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
        null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new[0] = last is None or (int(a[0]), int(b[0])) != last[:2]
        run = np.cumsum(new)  # 0: the run that the batch before left
        at = np.flatnonzero(new)
        owner, owner_null = np.r_[last[2] if last else 0, doc[at]], np.r_[last[3] if last else False, null[at]]
        later = (doc != owner[run]) | (null != owner_null[run])
        keep = later | (run + runs == 1)
        index = np.flatnonzero(keep)
        made = [pa.array(np.where(later[index], 0, 1).astype(np.int32)), pa.array(np.full(len(index), pid, np.int32)), *(batch.column(c).take(pa.array(index)) for c in ("doc_id", "row_fp", "line"))]
        yield pa.RecordBatch.from_arrays([*made, *(pa.nulls(len(index), pa.int64()) for _ in range(5)), pa.nulls(len(index), pa.bool_())], schema=schema)
        first_key = first_key or (int(a[0]), int(b[0]))
        last = int(a[-1]), int(b[-1]), int(owner[run[-1]]), bool(owner_null[run[-1]])
        runs += len(at)
    if last:
        row = {"kind": 2, "pid": pid, "first1": first_key[0], "first2": first_key[1], "last1": last[0], "last2": last[1], "last_doc": None if last[3] else last[2], "one_run": runs == 1}
        yield pa.RecordBatch.from_pylist([row], schema=schema)


def continued(markers: list) -> dict[int, int | None]:
    """Partitions whose first run began in an earlier one: pid to the key's first document."""
    out: dict[int, int | None] = {}
    last, doc = None, None
    for m in sorted(markers, key=lambda m: m.pid):
        goes_on = (m.first1, m.first2) == last
        if goes_on:
            out[m.pid] = doc
        if not (goes_on and m.one_run):
            doc = m.last_doc
        last = (m.last1, m.last2)
    return out


def bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, fp, lines = batch.columns
        made = [zlib.compress(np.packbits(_kept(x), bitorder="little").tobytes(), 6) for x in lines.to_pylist()]
        yield pa.RecordBatch.from_arrays([doc, fp, pa.array(made, pa.binary())], ["doc_id", "row_fp", "keep"])


def _kept(dropped: list[int]) -> np.ndarray:
    """Whole bytes of keep bits, up to that of the last dropped line."""
    at = np.asarray(dropped, np.int64)
    keep = np.ones((int(at.max()) // 8 + 1) * 8, bool)
    keep[at] = False
    return keep


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, row_fp, keep: a bitmap for each row of documents that loses a line."""
    spark = docs.sparkSession
    tune(spark)
    # written, as dealing out by ranges reads its rows twice
    lines = stored(documents(docs).select("doc_id", "text", "row_fp").mapInArrow(lean(hashed_lines(min_chars)), LINES), "lines")
    order = ["h1", "h2", "doc_id", "row_fp", "line"]
    ranged = lines.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    streamed = stored(ranged.mapInArrow(lean(later_lines), STREAMED), "later_lines")
    markers = streamed.filter("kind = 2").select("pid", "first1", "first2", "last1", "last2", "last_doc", "one_run").collect()  # one row per partition
    begun = spark.createDataFrame([(pid, doc) for pid, doc in continued(markers).items()], "pid int, first_doc long").withColumn("goes_on", F.lit(True))
    owned = streamed.filter("kind < 2").join(F.broadcast(begun), "pid", "left")  # a row per partition at most
    dropped = (F.col("kind") == 0) | F.col("goes_on") & ~F.col("doc_id").eqNullSafe(F.col("first_doc"))
    per_doc = owned.filter(dropped).groupBy("doc_id", "row_fp").agg(F.collect_list("line").alias("lines"))  # a document's own lines
    return per_doc.mapInArrow(lean(bitmaps), "doc_id long, row_fp long, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """Lines before, lines dropped, and the text that stays."""
    lines = text.split(b"\n")
    if not keep:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[: len(lines)]
    stay = [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


def _with_bitmaps(docs: DataFrame, min_chars: int, *more: str) -> DataFrame:
    bits = keep_bitmaps(docs, min_chars)
    left, right = documents(docs, *more).alias("l"), bits.alias("r")
    on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.row_fp") == F.col("r.row_fp"))
    return left.join(right, on, "left").select("l.*", "r.keep")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the same columns and rows, each text without its later lines (n_chars follows, where there is one)."""
    names = docs.columns
    # the text goes through the join and to Python once, beside the row's other columns
    others = F.struct(F.col("text").isNull().alias("none"), *(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names) if n != "text"))
    joined = _with_bitmaps(docs.select("doc_id", "text", others.alias("_row")), min_chars, "_row")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [kept_lines(t, k)[2].decode("utf-8", "replace") for t, k in zip(texts(batch), batch.column("keep").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(new, pa.string())], ["_row", "_new"])

    schema = joined.select("_row").schema.add("_new", "string")
    out = joined.select("_row", "text", "keep").mapInArrow(lean(run), schema)
    none = F.col("_row.none")
    cols = {n: F.col(f"_row.c{i}") for i, n in enumerate(names) if n != "text"} | {"text": F.when(~none, F.col("_new"))}
    if "n_chars" in names:
        cols["n_chars"] = F.when(none, cols["n_chars"]).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(cols[n].alias(n) for n in names))


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kept_lines(t, k) for t, k in zip(texts(batch), batch.column("keep").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _with_bitmaps(docs, min_chars).select("doc_id", "text", "keep").mapInArrow(lean(run), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


#: The query's result in DuckDB SQL.
SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM lines WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT l.*, (f.first_doc IS NOT NULL AND f.first_doc <> l.doc_id) AS dropped FROM lines l LEFT JOIN firsts f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

"""Quality rules (3): base rules of a text, and the frequency of its lines across documents.

Lines are normalised (white space stripped at both ends, A-Z lower-cased) and hashed to 128 bits. For
each host, here the column `source`, the distinct documents of each line are counted. A line found
in more than `limit` documents of its host is removed, where the limit is `max_share` of the host's
documents, at least `min_docs`. A document that keeps less than `min_left` of its words is depleted
and rejected, as is one that fails the base rules. `removed_lines` gives the places of the removed
lines, `remove_lines` the texts without them, `apply_rules` the verdicts that follow from them.

Defined results: a null or empty text has no words and fails the base rules. A null host is a host.
Rows that repeat a doc_id are one document to the counts, and each gives a row. A null doc_id is a
document. An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import SPACE, chunks, documents, salted_lookup, texts, tune

#: A line's limit: this share of the host's documents, and at least so many.
MAX_SHARE, MIN_DOCS = 0.01, 10
#: Share of its words that a document must keep.
MIN_LEFT = 0.5
#: Base rules: least words, and most words in repeated 3-word windows per 100 words.
MIN_WORDS, MAX_REPEATED = 50, 50

# Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

CHUNK_BYTES = 4 << 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: pa.Array, begins: np.ndarray) -> np.ndarray:
    """Words of each text in 3-word windows that the text has twice or more. begins: where each text's words begin, and the end."""
    n = len(words)
    if n < 3:
        return np.zeros(len(begins) - 1, np.int64)
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    pair = np.unique(code[:-1] * (int(code.max()) + 1) + code[1:], return_inverse=True)[1]
    key = pair[:-1] * (int(code.max()) + 1) + code[2:]
    inside = np.flatnonzero(text[:-2] == text[2:])
    order = inside[np.argsort(key[inside], kind="stable")]  # equal windows by place, so by text
    same = (key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    repeated = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[repeated + k] = True
    return np.bincount(text[covered], minlength=len(begins) - 1)


def base_counts(batch: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text."""
    split = [t.split() for t in batch]  # bytes split at the six ASCII white-space characters
    begins = np.cumsum([0, *map(len, split)])
    chars = [sum(map(len, w)) if t.isascii() else len(b"".join(w).decode("utf-8", "replace")) for t, w in zip(batch, split, strict=True)]
    dup = []
    for t in batch:
        lines = [x for x in t.split(b"\n") if x.strip(SPACE)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.diff(begins),
        "word_chars": np.array(chars, np.int64),
        "n_symbols": np.array([sum(map(t.count, (bytes([c]) for c in SYMBOLS))) for t in batch], np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": repeat_words(pa.array([w for ws in split for w in ws], pa.binary()), begins),
    }


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, CHUNK_BYTES):
        got = base_counts(texts(batch))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row_fp", "host")), *(pa.array(got[c], pa.int64()) for c in COUNTS)], ["doc_id", "row_fp", "host", *COUNTS])


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct line with a word of each text: its hash, the words of all its copies there, and their places: begins and ends in bytes, in turn, each with its line feed."""
    for batch in batches:
        rows, hashes, words, places = [], [], [], []
        for k, text in enumerate(texts(batch)):
            found: dict[bytes, list[int]] = {}
            begin = 0
            for x in text.lower().split(b"\n"):
                end = min(begin + len(x) + 1, len(text))
                if line := x.strip(SPACE):
                    found.setdefault(line, []).extend((begin, end))
                begin = end
            for line, at in found.items():
                rows.append(k)
                hashes.append(xxhash.xxh3_128_digest(line))
                words.append(len(at) // 2 * len(line.split()))
                places.append(at)
        h = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("doc_id", "row_fp", "host")), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(words, pa.int64()), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "row_fp", "host", "h1", "h2", "words", "places"])


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    tune(docs.sparkSession)
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return documents(docs.select("doc_id", "text", host.alias("host"), *more), "host", *more)


def _removed(rows: DataFrame, max_share: float, min_docs: int) -> DataFrame:
    lines = rows.select("doc_id", "text", "row_fp", "host").mapInArrow(_lines, "doc_id long, row_fp long, host string, h1 long, h2 long, words long, places array<int>")
    # distinct documents first by (line, document), which no frequent line gathers in one task, then partial counts by line
    frequent = lines.select("host", "h1", "h2", "doc_id").distinct().groupBy("host", "h1", "h2").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    hosts = rows.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    frequent = frequent.join(hosts, "host").filter(F.col("n_docs") > F.greatest(F.lit(float(min_docs)), F.col("host_docs") * F.lit(max_share))).select("host", "h1", "h2")
    # a set, as rows alike in all three keys give each line again
    cut = F.collect_set(F.struct("places", "words")).alias("cut")
    found = salted_lookup(lines, frequent, ["host", "h1", "h2"], "doc_id", "inner").groupBy("doc_id", "row_fp", "host").agg(cut)
    of_line = lambda x: F.transform(F.sequence(F.lit(0), F.size(x["places"]) - 2, F.lit(2)), lambda i: F.struct(F.get(x["places"], i).alias("begin"), F.get(x["places"], i + 1).alias("end")))
    spans = F.array_sort(F.flatten(F.transform("cut", of_line)))
    return found.select("doc_id", "row_fp", "host", spans.alias("spans"), F.aggregate("cut", F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("removed_words"))


def _with_removed(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """rows with the spans and removed_words of their lines above the limit, null where there are none."""
    a, b = rows.alias("a"), removed.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row_fp") == F.col("b.row_fp")) & (F.col("a.host") == F.col("b.host"))
    return a.join(b, same, "left").select("a.*", "b.spans", "b.removed_words")


def removed_lines(docs: DataFrame, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, row_fp, host, spans, removed_words of each document with lines above the limit.

    spans: begin and end in bytes of the UTF-8 text of every such line, in order, each with its line feed.
    """
    return _removed(_rows(docs), max_share, min_docs)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without their spans; those without spans as they are."""
    for batch in batches:
        out = []
        for text, spans in zip(texts(batch), batch.column("spans").to_pylist(), strict=True):
            kept, at = [], 0
            for s in spans or ():
                kept.append(text[at : s["begin"]])
                at = s["end"]
            out.append(b"".join([*kept, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.binary()).cast(pa.string()), batch.column("spans").is_valid()], ["_row", "text", "is_cut"])


def remove_lines(docs: DataFrame, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of docs with the same columns, their texts without the lines above the limit (n_chars follows, where there is one)."""
    names = docs.columns
    rows = _rows(docs.select("doc_id", "text", "source", F.struct(*names).alias("_row")), "_row")
    both = _with_removed(rows, _removed(rows, max_share, min_docs)).select("_row", "text", "spans")
    cut = both.mapInArrow(_cut, both.select("_row", "text").schema.add("is_cut", "boolean"))
    cols = {n: F.col(f"_row.`{n}`") for n in names} | {"text": F.when(F.col("is_cut"), F.col("text")).otherwise(F.col("_row.text"))}
    if "n_chars" in names:
        cols["n_chars"] = F.when(F.col("is_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return cut.select(*(cols[n].alias(n) for n in names))


def apply_rules(docs: DataFrame, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, the base counts, base_failed, removed_words, kept; the last two from the lines that removed_lines gives."""
    rows = _rows(docs)
    counts = rows.mapInArrow(_counted, "doc_id long, row_fp long, host string, " + ", ".join(f"{c} long" for c in COUNTS))
    both = _with_removed(counts, _removed(rows, max_share, min_docs)).withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("removed_words")) < F.lit(min_left) * F.col("n_words")
    return both.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).select("doc_id", *COUNTS, "base_failed", "removed_words", "kept")


#: The query's result in DuckDB SQL, with the parameters above.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) AS n, c FROM g),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE c IS NOT NULL AND n > 1) GROUP BY doc_id),
words AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY doc_id),
raw AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT doc_id, host, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM raw),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE k <> '' GROUP BY doc_id),
freq AS (SELECT host, k, count(DISTINCT doc_id) AS n FROM l WHERE k <> '' GROUP BY host, k),
hosts AS (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY host),
bad AS (SELECT f.host, f.k FROM freq f JOIN hosts h ON f.host = h.host WHERE f.n > greatest(10.0, h.n * 0.01::DOUBLE)),
removed AS (SELECT l.doc_id, sum(len(regexp_extract_all(l.k, '[^\x20\x09-\x0D]+')))::BIGINT AS removed_words FROM l JOIN bad b ON l.host = b.host AND l.k = b.k GROUP BY l.doc_id),
t AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM d LEFT JOIN words w ON d.doc_id = w.doc_id LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN dups u ON d.doc_id = u.doc_id LEFT JOIN removed x ON d.doc_id = x.doc_id
), v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM t)
SELECT *, (NOT base_failed AND NOT (n_words - removed_words < 0.5 * n_words)) AS kept FROM v
"""

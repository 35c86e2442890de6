"""Benchmark decontamination (5): test items whose text stands inside documents.

An item is in a document if the document has at least 75 of 100 of the item's distinct 5-word
shingles, however long the document is. Items are partitioned by the size of their shingle sets, in
powers of two. A partition has one sketch length: the item's smallest shingle hashes (a bottom-k
MinHash), so many that an item within the partition's bound that reaches the threshold shares at
least one of them with the document: k = u - ceil(0.75 u) + 1 for the bound u. So no item is missed,
and a document that shares none is passed over. Candidates are then verified on the words themselves,
by exact containment of shingle sets.

Only DataFrame functions are used. Sketches are broadcast while they have at most BROADCAST_ROWS
rows, else joined by hash.

Defined results: words are runs of other characters than ASCII white space, in lower case. A text of
fewer than five words is one shingle, its whole sequence; without words it has none and is in
nothing and holds nothing. Null texts are empty. Rows that repeat a doc_id, and items that repeat an
item_id, with the same text give one row, with different texts one each by pair. Null ids are ids.
Empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import documents

WORDS = 5
#: Percent of an item's shingles that a document must hold.
PERCENT = 75
#: Sketch rows (16 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def shingle_hashes(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `hashes`, the array of a text's shingle hashes, repeats included."""
    w = df.select(*keys, words(F.col("text")).alias("w"))
    h = w.select(*keys, F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    at = lambda i: F.xxhash64(*(F.get(F.col("h"), i + k) for k in range(WORDS)))
    many = F.transform(F.sequence(F.lit(0), F.col("n") - WORDS), at)
    few = F.array(F.aggregate("h", F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
    return h.select(*keys, F.when(F.col("n") >= WORDS, many).when(F.col("n") > 0, few).otherwise(F.array().cast("array<long>")).alias("hashes"))


def shingle_texts(w: Column) -> Column:
    """A text's distinct shingles as strings; words hold no spaces."""
    many = F.transform(F.sequence(F.lit(1), F.size(w) - WORDS + 1), lambda i: F.array_join(F.slice(w, i, WORDS), " "))
    return F.array_distinct(F.when(F.size(w) >= WORDS, many).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))


def _items(benchmark: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"), F.xxhash64(text).alias("item_fp"))


def sketches(benchmark: DataFrame) -> DataFrame:
    """hash, item_id, item_fp, n_item: each item's smallest hashes, as many as its size partition asks for."""
    sets = shingle_hashes(_items(benchmark), ["item_id", "item_fp"]).select("item_id", "item_fp", F.array_sort(F.array_distinct("hashes")).alias("hashes"))
    n = F.size("hashes")
    bound = F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int")
    k = bound - F.ceil(bound * PERCENT / 100) + 1
    sized = sets.filter(n > 0).select("item_id", "item_fp", n.alias("n_item"), F.slice("hashes", 1, F.least(n, k).cast("int")).alias("sketch"))
    return sized.select(F.explode("sketch").alias("hash"), "item_id", "item_fp", "n_item")


def candidates(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row_fp, item_id, item_fp: pairs that share a hash of the item's sketch, where the document is large enough."""
    sketch = sketches(benchmark)
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    hashes = shingle_hashes(documents(docs), ["doc_id", "row_fp"])
    rows = hashes.select("doc_id", "row_fp", F.size("hashes").alias("n_doc"), F.explode_outer("hashes").alias("hash"))  # a plain explode would filter by the arrays, and compute them again for that
    found = rows.join(sketch, "hash").filter(100 * F.col("n_doc") >= PERCENT * F.col("n_item"))
    return found.select("doc_id", "row_fp", "item_id", "item_fp").distinct()


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row_fp, item_id, n_item, n_shared, containment of all pairs at the threshold or above."""
    a, b = documents(docs).select("doc_id", "row_fp", "text").alias("a"), candidates(docs, benchmark).alias("b")
    rows = b.join(a, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row_fp") == F.col("b.row_fp"))).select("b.*", words(F.col("a.text")).alias("w"))
    items = _items(benchmark).select("item_id", "item_fp", words(F.col("text")).alias("w")).alias("i")
    on = F.col("r.item_id").eqNullSafe(F.col("i.item_id")) & (F.col("r.item_fp") == F.col("i.item_fp"))
    pairs = rows.alias("r").join(items, on).select("r.doc_id", "r.row_fp", "r.item_id", "r.item_fp", shingle_texts(F.col("r.w")).alias("d"), shingle_texts(F.col("i.w")).alias("s"))
    shared = pairs.select("doc_id", "row_fp", "item_id", "item_fp", F.size("s").cast("long").alias("n_item"), F.size(F.array_intersect("d", "s")).cast("long").alias("n_shared"))
    kept = shared.filter(100 * F.col("n_shared") >= PERCENT * F.col("n_item")).distinct()
    return kept.select("doc_id", "row_fp", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contained(docs, benchmark).drop("row_fp")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with the same columns."""
    names = docs.columns
    rows = documents(docs.select("doc_id", "text", F.struct(*names).alias("_row")), "_row").drop("text").alias("a")
    bad = contained(docs, benchmark).select("doc_id", "row_fp").distinct().alias("b")
    clean = rows.join(bad, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row_fp") == F.col("b.row_fp")), "left_anti")
    return clean.select(*(F.col(f"_row.`{n}`").alias(n) for n in names))


#: The query's result in DuckDB SQL.
SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w)::BIGINT - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t
), i AS (SELECT *, count(*) OVER (PARTITION BY id) AS n_item FROM s WHERE kind = 'i')
SELECT s.id AS doc_id, i.id AS item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM s JOIN i ON s.g = i.g AND s.kind = 'd' GROUP BY s.id, i.id, n_item HAVING 100 * count(*) >= 75 * n_item
"""

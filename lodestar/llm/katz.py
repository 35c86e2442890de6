"""LM scoring (8): a Katz backoff bigram model of a corpus, and every document's log10 probability under it.

Counts are discounted by Good-Turing (counts up to GT_MAX); what that frees goes to the words that a
history was not seen with, by their unigram probability, with a backoff weight that makes each
history's probabilities sum to exactly 1 over the vocabulary and one class of unknown words.

Data moves as packed arrays, not as rows of tokens:
  1. each block of documents is coded by its own dictionary; its word counts are added up by word;
  2. the totals go back to the blocks, which then know each token's unigram count;
  3. each (history, word, document) goes to the history's bucket, where bigrams are counted, the
     bigram table is stored, and seen tokens are scored but for the discount of their count;
  4. with all counts of counts known, histories get their backoff weights and documents their sums.
A history that is more than 1/HOT of all tokens is split over buckets by its followers; there are
fewer than HOT such histories, so their sums may meet in one place. Only those, the counts of counts
and the totals reach the driver.

Defined results: a null or empty text is one end token. Rows that repeat a doc_id are scored and
counted each. A null doc_id counts as the text "". Without training tokens every word is unknown and
scores 0. An empty table gives an empty table; extra columns are ignored. No tie matters.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import chunks, documents, pack, partitions, small, steps, stored, summed_up, texts, tune, unpack

#: Counts up to this one are discounted.
GT_MAX = 5
#: Histories that may hold more than one in HOT of all tokens are split into SPLIT parts.
HOT, SPLIT = 1000, 32
#: Bytes of text in a block, and training tokens that a bucket of histories is meant for.
BLOCK_BYTES, BUCKET_TOKENS = 8 << 20, 1_000_000

ROW = "kind int, bucket int, block long, data binary, stats array<long>"
ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("stats", pa.list_(pa.int64()))])

#: What stands for the end token; no word's hash has it.
END = np.uint64(1)

HELD_OUT, MODULUS = 1, 5


def held_out(doc_id: int | None, remainder: int = HELD_OUT) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % MODULUS == remainder


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, ARROW, strict=True)], schema=ARROW)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            kind, bucket, block, data = (batch.column(i)[k].as_py() for i in range(4))
            yield kind, bucket, block, unpack(data)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hash bits for buckets."""
    return (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def word_hash(word: bytes) -> int:
    return max(xxhash.xxh3_64_intdigest(word), 2)


def discounts(n: list[int]) -> np.ndarray:
    """Factors for counts 0..GT_MAX (0 unused) from counts of counts n[1..GT_MAX + 1]; absolute discounting where Good-Turing gives no factor between 0 and 1."""
    out = np.ones(GT_MAX + 1)
    last = (GT_MAX + 1) * n[GT_MAX + 1] / n[1] if n[1] else 1.0
    for r in range(1, GT_MAX + 1):
        made = ((r + 1) * n[r + 1] / n[r] / r - last) / (1 - last) if n[r] and last < 1 else 0.0
        flat = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        out[r] = made if 0 < made < 1 else (r - flat) / r
    return out


class Unigrams:
    """Discounted unigram probabilities by count."""

    def __init__(self, total: int, types: int, counts_of_counts: list[int]):
        self.total, self.types = total, types
        self.factor = discounts(counts_of_counts)
        left = sum((1 - self.factor[r]) * r * counts_of_counts[r] for r in range(1, GT_MAX + 1)) / total if total else 1.0
        self.scale = 1.0
        if left <= 1e-12:  # nothing was discounted: one more token stands for the unknown
            self.scale, left = total / (total + 1), 1 / (total + 1)
        self.unknown = left

    def probability(self, c: np.ndarray) -> np.ndarray:
        known = c * self.factor[np.minimum(c, GT_MAX)] if self.total else c * 1.0
        known = np.where(c > GT_MAX, c, known) / max(self.total, 1) * self.scale
        return np.where(c > 0, known, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.types + 1)))


def coded(n_buckets: int):
    """1: kind 0, a block's documents in its own codes; kind 1, its counts of the words of a bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        for i, batch in enumerate(chunks(batches, BLOCK_BYTES)):
            block = (pid << 24) + i
            split = [t.lower().split() for t in texts(batch)]
            ids = batch.column("doc_id").to_pylist()
            sizes = np.array([len(w) + 1 for w in split], np.int64)
            words = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
            hashes = np.array([END, *map(word_hash, words.dictionary.to_pylist())], np.uint64)
            codes = np.zeros(int(sizes.sum()), np.int64)
            inner = np.ones(len(codes), bool)
            inner[np.cumsum(sizes) - 1] = False
            codes[inner] = words.indices.to_numpy() + 1
            often = np.argsort(-np.bincount(codes, minlength=len(hashes)), kind="stable")  # frequent words get small codes
            place = np.empty(len(often), np.int64)
            place[often] = np.arange(len(often))
            codes, hashes = place[codes], hashes[often]
            train = np.array([not held_out(d) for d in ids], bool)
            counts = np.bincount(codes[np.repeat(train, sizes)], minlength=len(hashes))
            yield batch_of([(0, -1, block, pack(np.array([d or 0 for d in ids], np.int64), np.array([d is None for d in ids]), train, small(sizes), small(codes), np.array([len(hashes)])), None)])
            where = mixed(hashes) % np.uint64(n_buckets)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(n_buckets + 1))
            for b in range(n_buckets):
                at = order[cuts[b] : cuts[b + 1]]
                if len(at):
                    yield batch_of([(1, b, block, pack(steps(at), hashes[at], small(counts[at])), None)])

    return run


def by_bucket(rows: Iterator[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of one bucket in sorted rows."""
    held: list[tuple] = []
    for row in rows:
        if held and held[0][1] != row[1]:
            yield held[0][1], held
            held = []
        held.append(row)
    if held:
        yield held[0][1], held


def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """2: kind 2, the total counts of a block's words in a bucket; kind 3, its tokens, types, counts of counts, words, and the words that may be hot."""
    for bucket, rows in by_bucket(rows_of(batches)):
        hashes = np.concatenate([r[3][1] for r in rows])
        counts = np.concatenate([r[3][2] for r in rows]).astype(np.int64)
        words, at = np.unique(hashes, return_inverse=True)
        total = np.bincount(at, counts, len(words)).astype(np.int64)
        begin = 0
        for _, _, block, (codes, own, _) in rows:
            span = at[begin : begin + len(own)]
            yield batch_of([(2, bucket, block, pack(codes, small(total[span]), small(span)), None)])
            begin += len(own)
        n = [int((total == r).sum()) for r in range(1, GT_MAX + 2)]
        top = np.argsort(-total)[: HOT + 1]  # no more than HOT words can have more than one in HOT of all tokens
        hot = [x for k in top for x in (int(k), int(total[k]))]
        yield batch_of([(3, bucket, -1, pack(), [int(total.sum()), int((total > 0).sum()), *n, len(words), *hot])])


def placed(unigrams: Unigrams, offsets: dict[int, int], start: int, hot: np.ndarray, n_buckets: int):
    """3a, words now known by a number of their own (START has the last), for a block's rows: kind 4, its documents with what needs no bigram; kind 5, its (history, word, document) for a bucket."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        docs, counts = None, []
        for kind, bucket, block, data in rows_of(table.to_batches()):
            if kind == 0:
                docs, own = data, block
            else:
                counts.append((offsets[bucket], *data))
        ids, nulls, train, sizes, codes, n_words = docs
        sizes, codes, n_words = sizes.astype(np.int64), codes.astype(np.int64), int(n_words[0])
        total, number = np.zeros(n_words, np.int64), np.zeros(n_words + 1, np.int64)
        number[-1] = start
        for offset, at, c, rank in counts:
            at = summed_up(at)
            total[at], number[at] = c, offset + rank.astype(np.int64)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        c = total[codes]
        base = np.bincount(doc, unigrams.base(total)[codes], len(sizes))
        known = np.bincount(doc, c > 0, len(sizes)).astype(np.int64)
        out = [(4, int(own % n_buckets), own, pack(ids, nulls, train, sizes, known, base), None)]
        before = np.empty(len(codes), np.int64)
        before[1:] = codes[:-1]
        starts = np.cumsum(sizes) - sizes
        before[starts] = n_words  # START's code
        # equal (history, word, document) become one row with a count
        pair = before * n_words + codes
        order = np.lexsort((doc, pair))
        p, d = pair[order], doc[order]
        first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])])
        times = np.diff(np.r_[first, len(p)])
        p, d = p[first], d[first]
        h, w = p // n_words, p % n_words
        split = np.isin(number, hot)
        where = mixed(number)[h] + np.where(split[h], mixed(number)[w] % np.uint64(SPLIT), np.uint64(0))
        where = (where % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")  # still by history
        cuts = np.searchsorted(where[order], np.arange(n_buckets + 1))
        context = np.append(total, -1)
        for b in range(n_buckets):
            at = order[cuts[b] : cuts[b + 1]]
            if not len(at):
                continue
            at = at[np.lexsort((d[at], number[w[at]], number[h[at]]))]
            run_at = np.flatnonzero(np.r_[True, h[at][1:] != h[at][:-1]])
            hs = h[at][run_at]
            numbers, one, wi = np.unique(number[w[at]], return_index=True, return_inverse=True)
            step = np.diff(wi, prepend=0)
            out.append((5, b, own, pack(steps(number[hs]), small(context[hs] + 1), small(np.diff(np.r_[run_at, len(at)])), steps(numbers), small(total[w[at][one]]), small(np.where(step < 0, step + len(numbers), step)), small(d[at]), small(times[at]), np.packbits(train[d[at]])), None))
        return pa.Table.from_batches([batch_of(out)])

    return run


def counted(unigrams: Unigrams, start: int, hot: np.ndarray, n_start: int):
    """3b, by bucket: kind 4 goes through; kind 6, documents' sums from seen tokens and unigram parts; kind 7, histories
    that someone backs off from, and who; kind 8, the bigram table; kind 9, a hot history's part of the sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(rows_of(batches)):
            for r in rows:
                if r[0] == 4:
                    yield batch_of([(*r[:3], pack(*r[3]), None)])
            rows = [r for r in rows if r[0] == 5]
            if not rows:
                continue
            h = np.concatenate([np.repeat(summed_up(r[3][0]), r[3][2]) for r in rows])
            context = np.concatenate([np.repeat(r[3][1].astype(np.int64) - 1, r[3][2]) for r in rows])
            words = [summed_up(r[3][5]) % len(r[3][3]) for r in rows]
            w = np.concatenate([summed_up(r[3][3])[i] for r, i in zip(rows, words, strict=True)])
            cw = np.concatenate([r[3][4].astype(np.int64)[i] for r, i in zip(rows, words, strict=True)])
            doc = np.concatenate([r[3][6] for r in rows]).astype(np.int64)
            times = np.concatenate([r[3][7] for r in rows]).astype(np.int64)
            train = np.concatenate([np.unpackbits(r[3][8], count=len(r[3][6])).astype(bool) for r in rows])
            blocks = np.array([r[2] for r in rows], np.int64)
            block = np.repeat(np.arange(len(rows)), [len(r[3][6]) for r in rows])
            hs, hi = np.unique(h, return_inverse=True)
            ws, wi = np.unique(w, return_inverse=True)
            pairs, pi = np.unique(hi * len(ws) + wi, return_inverse=True)
            c = np.bincount(pi, times * train, len(pairs)).astype(np.int64)
            ph, pw = pairs // len(ws), pairs % len(ws)
            seen = c > 0
            ch = np.zeros(len(hs), np.int64)
            ch[hi] = np.where(h == start, n_start, context)
            cs = np.zeros(len(ws), np.int64)
            cs[wi] = cw
            # what the backoff weight needs of a history: followers by count, tokens of large counts, unigram mass of followers
            few = np.zeros((len(hs), GT_MAX + 1), np.int64)
            np.add.at(few, (ph[seen & (c <= GT_MAX)], c[seen & (c <= GT_MAX)]), 1)
            large = np.bincount(ph, np.where(c > GT_MAX, c, 0), len(hs)).astype(np.int64)
            mass = np.bincount(ph, np.where(seen, unigrams.probability(cs)[pw], 0.0), len(hs))
            n = [int((c == r).sum()) for r in range(1, GT_MAX + 2)]
            yield batch_of([(8, bucket, -1, pack(steps(hs), small(np.bincount(ph[seen], minlength=len(hs))), small(ws[pw[seen]]), small(c[seen])), n)])
            split = np.isin(hs, hot)
            if split.any():
                yield batch_of([(9, bucket, -1, pack(hs[split], few[split], large[split], mass[split], ch[split]), None)])
            tc = c[pi]
            unseen = tc == 0
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.where(unseen, np.log10(unigrams.probability(cs))[wi], np.log10(tc / ch[hi]))
            value = value * times
            # documents' sums, by block
            key = block.astype(np.int64) << 32 | doc
            keys, ki = np.unique(key, return_inverse=True)
            sums = np.bincount(ki, value, len(keys))
            by_count = np.zeros((GT_MAX + 1, len(keys)), np.int64)
            for r in range(1, GT_MAX + 1):
                by_count[r] = np.bincount(ki, np.where(tc == r, times, 0), len(keys))
            cuts = np.searchsorted(keys >> 32, np.arange(len(rows) + 1))
            for k in range(len(rows)):
                at = slice(cuts[k], cuts[k + 1])
                yield batch_of([(6, bucket, int(blocks[k]), pack(small(keys[at] & 0xFFFFFFFF), sums[at], small(by_count[1:, at])), None)])
            # who backs off from a known history; and seen tokens of histories whose counts are all large
            at = np.flatnonzero((ch[hi] > 0) & (unseen | (tc > GT_MAX)))
            at = at[unseen[at] | (few[hi[at], 1:].sum(1) == 0)]
            if not len(at):
                continue
            used, ui = np.unique(hi[at], return_inverse=True)
            yield batch_of([(7, bucket, -1, pack(hs[used], split[used], few[used], large[used], mass[used], ch[used], small(ui), blocks, small(block[at]), small(doc[at]), small(times[at]), unseen[at]), None)])

    return run


def weights(few: np.ndarray, large: np.ndarray, mass: np.ndarray, ch: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of histories' backoff weights, and of the scale of their seen probabilities (1 unless nothing was discounted)."""
    r = np.arange(GT_MAX + 1)
    left = 1 - (few * (r * factor)).sum(1) / ch - large / ch
    none = few[:, 1:].sum(1) == 0
    left = np.where(none, 1 / (ch + 1), left)
    with np.errstate(divide="ignore"):
        return np.log10(left / (1 - mass)), np.where(none, np.log10(ch / (ch + 1)), 0.0)


def backed_off(factor: np.ndarray, hot_hashes: np.ndarray, hot_weights: np.ndarray, hot_scales: np.ndarray):
    """4a: documents' sums, by block, from discounts (kind 6) and backoff weights (kind 7)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.log10(factor[1:])
        for kind, bucket, block, data in rows_of(batches):
            if kind == 4:
                yield batch_of([(4, bucket, block, pack(*data), None)])
            elif kind == 6:
                docs, sums, by_count = data
                yield batch_of([(6, bucket, block, pack(docs, sums + logs @ by_count), None)])
            elif kind == 7:
                hs, split, few, large, mass, ch, ui, names, place, doc, times, unseen = data
                blocks = names[place]
                weight, scale = weights(few, large, mass, ch, factor)
                if split.any():
                    at = np.searchsorted(hot_hashes, hs[split])
                    weight[split], scale[split] = hot_weights[at], hot_scales[at]
                value = np.where(unseen, weight[ui], scale[ui]) * times
                order = np.argsort(blocks, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(blocks[order]) != 0, True])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    docs, at = np.unique(doc[order[a:b]], return_inverse=True)
                    yield batch_of([(6, bucket, int(blocks[order[a]]), pack(docs, np.bincount(at, value[order[a:b]], len(docs))), None)])

    return run


def finished(total: int):
    """4b: a block's documents with all their sums."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        docs, sums = None, []
        for kind, _, _, data in rows_of(table.to_batches()):
            if kind == 4:
                docs = data
            else:
                sums.append(data)
        ids, nulls, train, sizes, known, base = docs
        score = np.zeros(len(sizes))
        for at, value in sorted(sums, key=lambda s: (len(s[0]), s[1].tobytes())):  # in an order of their own, so that sums don't vary
            score[at] += value
        made = [pa.array(np.where(nulls, 0, ids).astype(np.int64), mask=nulls), pa.array(~train), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), total, np.int64)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(made, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, by a model of the documents not held out."""
    spark = docs.sparkSession
    tune(spark)
    p = partitions(spark)
    made = stored(documents(docs).select("doc_id", "text").mapInArrow(coded(p), ROW), "coded", ["kind"]).select("kind", "bucket", "block", "data", "stats")
    words = made.filter("kind = 1").repartition(p, "bucket").sortWithinPartitions("bucket", "block")
    summed = stored(words.mapInArrow(totals, ROW), "totals", ["kind"]).select("kind", "bucket", "block", "data", "stats")
    stats = summed.filter("kind = 3").select("bucket", "stats")
    flat = stats.select("bucket", *(F.col("stats")[i].alias(f"s{i}") for i in range(GT_MAX + 4)))
    offsets, start, sums = {}, 0, [0] * (GT_MAX + 3)
    for r in flat.collect():  # one row for each of p buckets
        offsets[r.bucket], start = start, start + r[GT_MAX + 4]
        sums = [a + b for a, b in zip(sums, r[1:], strict=False)]
    total, types, *n = sums
    unigrams = Unigrams(total, types, [0, *n])
    top = stats.select("bucket", F.explode(F.transform(F.sequence(F.lit(GT_MAX + 4), F.size("stats") - 2, F.lit(2)), lambda i: F.struct(F.get("stats", i).alias("rank"), F.get("stats", i + 1).alias("n")))).alias("x"))
    hot = np.array([start, *(offsets[r.bucket] + r.rank for r in top.select("bucket", "x.*").filter(F.col("n") > total / HOT).collect())], np.int64)  # fewer than HOT and START
    n_buckets = max(p, math.ceil(total / BUCKET_TOKENS))
    both = made.filter("kind = 0").unionByName(summed.filter("kind = 2"))
    n_start = total and _train_documents(docs)
    at_blocks = both.groupBy("block").applyInArrow(placed(unigrams, offsets, start, hot, n_buckets), ROW)
    bigrams = stored(at_blocks.repartition(p, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(counted(unigrams, start, hot, n_start), ROW), "bigrams", ["kind"]).select("kind", "bucket", "block", "data", "stats")
    tables = bigrams.filter("kind = 8").select(*(F.col("stats")[i].alias(f"n{i}") for i in range(GT_MAX + 1)))
    factor = discounts([0, *(int(x or 0) for x in tables.groupBy().sum().first())])
    hot_hashes, hot_weights, hot_scales = _hot_sums(bigrams, factor)
    sums = bigrams.filter("kind in (4, 6, 7)").mapInArrow(backed_off(factor, hot_hashes, hot_weights, hot_scales), ROW)
    return sums.groupBy("block").applyInArrow(finished(total), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _train_documents(docs: DataFrame) -> int:
    """Times that a training text begins."""
    return docs.filter(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(MODULUS)) != HELD_OUT).count()


def _hot_sums(bigrams: DataFrame, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the hot histories, whose parts are added up by Spark; fewer than HOT rows come back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, (hs, few, large, mass, ch) in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(hs), pa.array(large), pa.array(mass), pa.array(ch), *(pa.array(few[:, r].copy()) for r in range(1, GT_MAX + 1))], ["h", "large", "mass", "ch", *(f"n{r}" for r in range(1, GT_MAX + 1))])

    counts = ", ".join(f"n{r} long" for r in range(1, GT_MAX + 1))
    parts = bigrams.filter("kind = 9").mapInArrow(run, f"h long, large long, mass double, ch long, {counts}")
    rows = parts.groupBy("h").agg(F.sum("large").alias("large"), F.sum("mass").alias("mass"), F.max("ch").alias("ch"), *(F.sum(f"n{r}").alias(f"n{r}") for r in range(1, GT_MAX + 1))).filter("ch > 0").collect()
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    hs = np.array([r.h for r in rows], np.int64)
    order = np.argsort(hs)
    few = np.array([[0, *(r[f"n{k}"] for k in range(1, GT_MAX + 1))] for r in rows])
    weight, scale = weights(few, np.array([r.large for r in rows]), np.array([r.mass for r in rows]), np.array([r.ch for r in rows]), factor)
    return hs[order], weight[order], scale[order]

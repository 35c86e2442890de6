"""Quality classifier (1): a byte-level convolutional network in numpy.

A text's bytes are embedded; small filters (4 bytes, every 2) are averaged over overlapping chunks
(256 bytes, every 128) that cover the whole text; a second layer turns each chunk into features, and
the largest value of each feature over all chunks gives one probability. All weights are learned,
from a bounded sample of labelled rows: the SAMPLE_ROWS labelled documents with the smallest hash of
their doc_id, but for each that doesn't fit in what is left of SAMPLE_BYTES. Only text reaches the network.

Defined results: a null or empty text has one chunk of padding and gets a score as any other. A null
label is no label; of several labels of a doc_id the smallest counts. Without both labels in the
sample the score is the share of label 1 (0.5 without labels). Every row gives a row, whatever
repeats; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import documents, lean, texts, tune

#: Bound of the sample that the driver learns from.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 24 << 20
HELD_OUT, MODULUS = 0, 5
#: A document with a lower score is rejected.
THRESHOLD = 0.3

#: Bytes of half a chunk; embedding, filters and chunk features; updates in all, texts in each, step size, decay.
HALF, EMBED, FILTERS, FEATURES = 128, 8, 16, 16
UPDATES, BATCH, STEP, DECAY = 600, 32, 0.01, 1e-4
#: Bytes scored at once.
SCORED_BYTES = 512 << 10
PAD = 256


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % MODULUS == HELD_OUT


def laid_out(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each padded to whole halves, two at least, with 4 bytes of padding at its end; and how many halves each has."""
    halves = np.array([max(2, -(-(len(t) + 4) // HALF)) for t in batch], np.int64)
    out = np.full(int(halves.sum()) * HALF, PAD, np.int32)
    at = 0
    for t, n in zip(batch, halves, strict=True):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(n) * HALF
    return out, halves


def chunks_of(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First half of each chunk (two neighbours in one text), and where each text's chunks begin."""
    ends = np.cumsum(halves)
    first = np.ones(int(halves.sum()), bool)
    first[ends - 1] = False
    return np.flatnonzero(first), np.cumsum(halves - 1) - (halves - 1)


class ByteConv:
    """The network. Weights: embedding, filters (for two byte pairs), chunk layer, output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda n, *shape: (rng.standard_normal(shape) / np.sqrt(n)).astype(np.float32)
        self.w = {"embed": normal(1, 257, EMBED), "left": normal(4 * EMBED, 2 * EMBED, FILTERS), "right": normal(4 * EMBED, 2 * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32), "chunk": normal(FILTERS, FILTERS, FEATURES) * 2, "chunk_bias": np.zeros(FEATURES, np.float32), "out": normal(FEATURES, FEATURES), "out_bias": np.zeros(1, np.float32)}
        self._pairs: tuple[np.ndarray, np.ndarray] | None = None

    def _pool(self, values: np.ndarray, real: np.ndarray, halves: np.ndarray):
        """Averages over chunks of filter values at real positions."""
        first, begins = chunks_of(halves)
        sums = (values * real[:, None]).reshape(-1, HALF // 2, FILTERS).sum(1)
        n = real.reshape(-1, HALF // 2).sum(1)
        n = np.maximum(n[first] + n[first + 1], 1).astype(np.float32)
        return (sums[first] + sums[first + 1]) / n[:, None], n, first, begins

    def _features(self, mean: np.ndarray) -> np.ndarray:
        return np.maximum(mean @ self.w["chunk"] * 4 + self.w["chunk_bias"], 0)

    def scores(self, batch: list[bytes]) -> np.ndarray:
        """Probabilities of label 1, from slices of at most SCORED_BYTES: the features' maxima are kept from slice to slice."""
        best = np.full((len(batch), FEATURES), -np.inf, self.w["out"].dtype)
        held, size = [], 0  # (text, its slice, chunks of the slice that count)
        most = SCORED_BYTES // HALF

        def pooled() -> None:
            if held:
                feat, begins = self._chunk_features([piece for _, piece, _ in held])
                for (k, _, n), a in zip(held, begins.tolist(), strict=True):
                    best[k] = np.maximum(best[k], feat[a : a + n].max(0))
                held.clear()

        for k, t in enumerate(batch):
            n_chunks = max(2, -(-(len(t) + 4) // HALF)) - 1
            for a in range(0, n_chunks, most):
                piece = t[a * HALF : (a + most + 2) * HALF]  # with the half after its last chunk, which the last filter value reaches into
                if size + len(piece) > SCORED_BYTES:
                    pooled()
                    size = 0
                held.append((k, piece, min(most, n_chunks - a)))
                size += len(piece)
        pooled()
        return 1 / (1 + np.exp(-(best @ self.w["out"] + self.w["out_bias"]).astype(np.float64)))

    def _chunk_features(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all chunks, and where each text's begin. A filter's value at a byte pair is looked up, not computed anew."""
        if self._pairs is None:
            e = self.w["embed"]
            both = np.concatenate([np.repeat(e, 257, 0), np.tile(e, (257, 1))], 1)
            self._pairs = both @ self.w["left"] + self.w["bias"], both @ self.w["right"]
        data, halves = laid_out(batch)
        pair = data[0::2] * 257 + data[1::2]
        values = self._pairs[0][pair]
        values[:-1] += self._pairs[1][pair[1:]]
        np.maximum(values, 0, out=values)
        mean, _, _, begins = self._pool(values, data[0::2] != PAD, halves)
        return self._features(mean), begins

    def gradients(self, batch: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the log loss."""
        w = self.w
        data, halves = laid_out(batch)
        e = w["embed"][data].reshape(-1, 2 * EMBED)
        nxt = np.concatenate([e[1:], e[-1:]])
        values = np.maximum(e @ w["left"] + nxt @ w["right"] + w["bias"], 0)
        real = data[0::2] != PAD
        mean, n, first, begins = self._pool(values, real, halves)
        feat = self._features(mean)
        text = np.repeat(np.arange(len(batch)), halves - 1)
        best = np.maximum.reduceat(feat, begins, axis=0)
        p = 1 / (1 + np.exp(-(best @ w["out"] + w["out_bias"])))
        d = ((p - labels) / len(batch)).astype(np.float32)
        g = {"out": best.T @ d, "out_bias": d.sum(keepdims=True)}
        # the chunk that gave the largest value takes the gradient; of equal ones the first
        top = feat == best[text]
        rank = np.cumsum(top, 0)
        before = np.where(begins[:, None] > 0, rank[np.maximum(begins - 1, 0)], 0)
        top &= rank - before[text] == 1
        d_feat = top * (d[:, None] * w["out"])[text] * (feat > 0)
        g["chunk"], g["chunk_bias"] = mean.T @ d_feat * 4, d_feat.sum(0)
        d_mean = (d_feat @ w["chunk"].T * 4) / n[:, None]
        d_half = np.zeros((int(halves.sum()), FILTERS), np.float32)
        d_half[first] += d_mean
        d_half[first + 1] += d_mean
        d_values = np.repeat(d_half, HALF // 2, 0) * ((values > 0) & real[:, None])
        g["left"], g["right"], g["bias"] = e.T @ d_values, nxt.T @ d_values, d_values.sum(0)
        d_e = d_values @ w["left"].T
        d_e[1:] += (d_values @ w["right"].T)[:-1]
        d_e = d_e.reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(data, d_e[:, k], 257) for k in range(EMBED)], 1).astype(np.float32)
        return g

    def fit(self, batch: list[bytes], labels: np.ndarray, seed: int = 11) -> ByteConv:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        share = float(np.mean(labels)) if len(labels) else 0.5
        if share in (0.0, 1.0) or not len(labels):
            self.w["out"][:] = 0
            share = min(max(share, 1e-6), 1 - 1e-6)
            self.w["out_bias"][:] = np.log(share / (1 - share))
            return self
        self.w["out_bias"][:] = np.log(share / (1 - share))
        one = {k: np.zeros_like(v) for k, v in self.w.items()}
        two = {k: np.zeros_like(v) for k, v in self.w.items()}
        t = 0
        while t < UPDATES:
            order = rng.permutation(len(batch))
            for k in range(0, len(order), BATCH):
                if t == UPDATES:
                    break
                at = order[k : k + BATCH]
                g = self.gradients([batch[i] for i in at], labels[at])
                t += 1
                step = STEP * (1 - (t - 1) / UPDATES)
                for name, w in self.w.items():
                    d = g[name] + DECAY * w
                    one[name] = 0.9 * one[name] + 0.1 * d
                    two[name] = 0.999 * two[name] + 0.001 * d * d
                    w -= (step * (one[name] / (1 - 0.9**t)) / (np.sqrt(two[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self._pairs = None
        return self


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels to learn from, none of them held out: in hash order, each that fits in what is left of `size`; a longer one is left out alone."""
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(MODULUS)) != HELD_OUT
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & train)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = documents(docs).withColumn("n", F.octet_length("text").cast("long"))
    sizes = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "row_fp", "label", "n")  # `rows` rows at most
    order = sizes.filter(F.col("n") <= size).orderBy(F.xxhash64("doc_id"), "doc_id", "row_fp").limit(rows).collect()
    taken, used = {}, 0
    for r in order:
        if used + r.n <= size:
            used += r.n
            taken[len(taken)] = r
    if not taken:
        return [], np.zeros(0, np.float32)
    wanted = docs.sparkSession.createDataFrame([(k, r.doc_id, r.row_fp) for k, r in taken.items()], "place int, doc_id long, row_fp long")
    found = own.join(F.broadcast(wanted), ["doc_id", "row_fp"]).groupBy("place").agg(F.first("text").alias("text"))  # `size` bytes at most
    by_place = {r.place: r.text.encode("utf-8", "replace") for r in found.toLocalIterator()}
    out, held = [by_place[k] for k in taken], [r.label for r in taken.values()]
    return out, np.array(held, np.float32)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> ByteConv:
    return ByteConv().fit(*sample(docs, labels, rows, size))


def score(docs: DataFrame, model: ByteConv, *more: str) -> DataFrame:
    """doc_id, held_out, score, predicted, and the columns asked for."""
    spark = docs.sparkSession
    tune(spark)
    weights = spark.sparkContext.broadcast(pickle.dumps(model.w, 5))  # of fixed size
    rows = documents(docs, *more).drop("row_fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteConv()
        own.w = pickle.loads(weights.value)
        for batch in batches:
            p = own.scores(texts(batch))
            out = [pa.array([held_out(d) for d in batch.column("doc_id").to_pylist()], pa.bool_()), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in more), *out], ["doc_id", *more, "held_out", "score", "predicted"])

    schema = rows.drop("text").schema.add("held_out", "boolean").add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(lean(run), schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with the same columns."""
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names))).alias("_row"))
    scored = score(packed, train(docs, labels), "_row").filter("predicted = 1")
    return scored.select(*(F.col(f"_row.c{i}").alias(n) for i, n in enumerate(names)))

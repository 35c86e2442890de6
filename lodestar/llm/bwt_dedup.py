"""Suffix-array dedup (2): byte strings of 50 that an earlier document has too, found by merging Burrows-Wheeler transforms.

Strings that could be equal are first brought together: every 50-byte string has an anchor, the
smallest hash among its 16-byte substrings, and equal strings have equal anchors. A document is cut
into runs of strings with the same anchor. Anchors go to their buckets alone first; those that only
one document has are done with, and only of the others the runs' bytes follow. Equal runs of a chunk
become one before they are sent, with the least and the largest of their documents, so that a passage
that a third of all documents have costs its bucket a run for each chunk, not for each document; the
chunk keeps their places and lays the answer out on them. In the bucket equal runs become one again.
Documents are dealt out once, by hash into chunks, and each step meets them there again. A bucket is
indexed in PARTS by anchor, one after another, so that a part stays in the processor's cache.

In a bucket the runs are the strings of an index. Two shards of them get a suffix array and a BWT
each. The two BWTs are merged without sorting suffixes anew: an interleave (which shard each row
comes from), true to the first h bytes, is refined to h + 1 bytes by one stable partition by the byte
before each row. Two bytes are taken in one step. Block borders are refined alongside, so at depth h
they mark where the common prefix of neighbours is shorter than h; at depth 50 each block is a
repeated interval: all places of one 50-byte string. Its smallest doc_id decides which of these places
are removed. A row that is alone in its block leaves the interleave: no string before it can repeat.

Defined results: a null or empty text has no bytes and stays. Texts under 50 bytes stay. Rows that
repeat a doc_id don't remove each other's bytes. A null doc_id is smaller than all others. A byte
0xFF, which UTF-8 never has, ends a run in the index. An empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import documents, lean, pack, partitions, small, texts, tune, unpack

#: Bytes of a string, of an anchor, and most strings of a run.
LENGTH, GRAM, RUN = 50, 16, 64
#: Bytes of text that a chunk and of runs that a bucket are meant for; runs with shared anchors hold about SHARED bytes for each byte of text.
#: A chunk sends a row to each bucket, so rows grow with the square of the input over these two: a task holds as much as it can at once.
CHUNK_BYTES, BUCKET_BYTES, SHARED = 16 << 20, 24 << 20, 1.5
#: Parts of a bucket, by anchor, that are indexed one after another, and bytes of text whose anchors are found at once: both fit in the processor's cache.
PARTS, SLICE_BYTES = 32, 1 << 17
#: The byte that ends a run, the pair before rows that have no two bytes before them, the depth of the first interleave.
END, NO_PAIR, FIRST = 0xFF, 0xFFFF, 8
NO_ID = -(1 << 63)

ROW = "kind int, bucket int, chunk long, data binary"
ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, ARROW, strict=True)], schema=ARROW)


def ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for each begin, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def anchors(data: np.ndarray) -> np.ndarray:
    """The anchor of the string at each place where one fits."""
    v = data.astype(np.uint64)
    for k in (1, 2, 4):
        v = (v[:-k] << np.uint64(8 * k)) | v[k:]
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v[:-8] ^ (v[:-8] >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + v[8:]
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    width, n = 1, LENGTH - GRAM + 1
    while 2 * width <= n:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (n - width)], v[n - width :])


def runs_of(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, text, begin (in data), strings of each run; data holds texts of these sizes, one after another."""
    ends = np.cumsum(sizes)
    out, lo = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))], 0
    while lo < len(sizes):
        base = int(ends[lo] - sizes[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        key, text, begin, strings = runs_of_slice(data[base : ends[hi - 1]], sizes[lo:hi])
        out.append((key, text + lo, begin + base, strings))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def runs_of_slice(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    keys = anchors(data)
    ends = np.cumsum(sizes)
    count = np.maximum(sizes - LENGTH + 1, 0)
    at = ranges(ends - sizes, count)
    text = np.repeat(np.arange(len(sizes)), count)
    keys = keys[at]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])]) if len(at) else np.zeros(0, np.int64)
    length = np.diff(np.r_[first, len(at)])
    parts = -(-length // RUN)
    step = ranges(np.zeros(len(first), np.int64), parts) * RUN
    owner = np.repeat(np.arange(len(first)), parts)
    begin = first[owner] + step
    return keys[begin], text[begin], at[begin], np.minimum(length[owner] - step, RUN)


def digests(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each run, as two words."""
    view = memoryview(data)
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[b : b + n]) for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)), np.uint64).reshape(-1, 2)


KEYS = "bucket int, chunk long, data binary"


def key_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "chunk", "data"])


def buckets_of(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, and where each bucket begins in it."""
    where = ((keys >> np.uint64(7)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(n_buckets + 1))


def laid_out(ids: list, held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, bytes, sizes of texts."""
    return np.array([NO_ID if d is None else d for d in ids], np.int64), np.frombuffer(b"".join(held), np.uint8), np.array([len(t) for t in held], np.int64)


def anchor_keys(n_buckets: int):
    """For each bucket a chunk's distinct anchors, and which of them two of its documents have; from rows sorted by chunk."""

    def out(chunk: int, ids: list, held: list[bytes]) -> pa.RecordBatch:
        doc, data, sizes = laid_out(ids, held)
        key, text, _, _ = runs_of(data, sizes)
        order = np.argsort(key)
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, np.int64)
        own = doc[text[order]]
        many = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first) if len(first) else np.zeros(0, bool)
        key = key[order][first]
        order, cuts = buckets_of(key, n_buckets)
        return key_rows([(b, chunk, pack(key[at], np.packbits(many[at]))) for b in range(n_buckets) if len(at := order[cuts[b] : cuts[b + 1]])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, held = None, [], []
        for batch in batches:
            for c, d, t in zip(batch.column("chunk").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                if held and c != chunk:
                    yield out(chunk, ids, held)
                    ids, held = [], []
                chunk = c
                ids.append(d)
                held.append(t)
        if held:
            yield out(chunk, ids, held)

    return run


def shared_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of a bucket those of its anchors that two documents have, from sorted buckets."""

    def out() -> pa.RecordBatch:
        key = np.concatenate([k for _, k, _ in held])
        _, at, times = np.unique(key, return_inverse=True, return_counts=True)
        many = np.zeros(len(times), bool)
        many[at[np.concatenate([m for _, _, m in held])]] = True
        keep = (many | (times > 1))[at]
        ends = np.cumsum([len(k) for _, k, _ in held])
        return key_rows([(bucket, c, pack(k[u])) for (c, k, _), u in zip(held, np.split(keep, ends[:-1]), strict=True) if u.any()])

    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    bucket = None
    for batch in batches:
        for b, c, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held and b != bucket:
                yield out()
                held = []
            bucket = b
            key, many = unpack(data)
            held.append((c, key, np.unpackbits(many, count=len(key)).astype(bool)))
    if held:
        yield out()


def spread(n_buckets: int):
    """kind 0: a chunk's documents, and where each run with a shared anchor is; kind 1: these runs, each once, for a bucket."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows or not shared.num_rows:
            return pa.Table.from_batches([batch_of([])])
        chunk = docs.column("chunk")[0].as_py()
        ids, data, sizes = laid_out(docs.column("doc_id").to_pylist(), [x or b"" for x in docs.column("text").cast(pa.binary()).to_pylist()])
        key, text, begin, strings = runs_of(data, sizes)
        wanted = np.sort(np.concatenate([unpack(d.as_py())[0] for d in shared.column("data")]))
        order = np.argsort(key)  # a search for sorted keys stays in the processor's cache
        use = np.empty(len(key), bool)
        use[order] = wanted[np.minimum(np.searchsorted(wanted, key[order]), len(wanted) - 1)] == key[order]
        key, text, begin, strings = key[use], text[use], begin[use], strings[use]
        length = strings + LENGTH - 1
        where = (key >> np.uint64(7)) % np.uint64(n_buckets * PARTS)
        digest = digests(data, begin, length)
        by = np.argsort(where << np.uint64(40) | digest[:, 0] >> np.uint64(24))  # equal runs come together, as good as always
        new = np.ones(len(by), bool)
        new[1:] = (digest[by][1:] != digest[by][:-1]).any(1)
        first = np.flatnonzero(new)
        own = ids[text[by]]
        least, most = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
        one = by[first]
        cuts = np.searchsorted(where[one], np.arange(n_buckets * PARTS + 1, dtype=np.uint64))
        rows = [(0, chunk % n_buckets, chunk, pack(ids, docs.column("row_fp").to_numpy(), small(text[by]), small((begin - (np.cumsum(sizes) - sizes)[text])[by]), np.packbits(new)))]
        for b in range(n_buckets):
            part = cuts[b * PARTS : (b + 1) * PARTS + 1]
            lo, hi = int(part[0]), int(part[-1])
            if lo < hi:
                at = one[lo:hi]
                rows.append((1, b, chunk, pack(np.array([lo]), np.diff(part), least[lo:hi], most[lo:hi] - least[lo:hi], small(strings[at]), data[ranges(begin[at], length[at])])))
        return pa.Table.from_batches([batch_of(rows)])

    return run


class Shard:
    """Suffix array, to the depth of a string, and BWT (two bytes before each row) of runs, each ended by END.

    Rows are the places with at least FIRST bytes before their run's end. `before` is the last-to-first map by two bytes.
    """

    def __init__(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
        n = len(data)
        long = np.concatenate([data, np.full(8, END, np.uint8)])
        key = long[:-1].astype(np.uint64) << np.uint64(8) | long[1:]
        key = key[:-2] << np.uint64(16) | key[2:]
        prefix = key[:n] << np.uint64(32) | key[4 : n + 4]
        order = self._sorted(prefix, n)
        offset = (np.arange(n, dtype=np.int32) - np.repeat(begins, sizes).astype(np.int32))[order]
        left = np.repeat(sizes, sizes).astype(np.int32)[order] - 1 - offset  # bytes to the run's end
        use = left >= FIRST
        self.order, offset = order[use], offset[use]
        self.prefix = prefix[self.order]
        self.bwt = (key[self.order - 2] >> np.uint64(16)).astype(np.uint16)
        self.bwt[offset < 2] = NO_PAIR
        row = np.zeros(n, np.int32)
        row[self.order] = np.arange(len(self.order), dtype=np.int32)
        self.before = row[self.order - 2]

    @staticmethod
    def _sorted(prefix: np.ndarray, n: int) -> np.ndarray:
        """Places by the LENGTH bytes from each on. Ranks double their depth; only rows that are still tied are sorted again."""
        order = np.argsort(prefix, kind="stable") if n >= 1 << 32 else Shard._by(prefix >> np.uint64(32), prefix & np.uint64(0xFFFFFFFF), n)
        new = np.empty(n, bool)
        new[:1], new[1:] = True, np.diff(prefix[order].view(np.int64)) != 0
        rank = np.zeros(n + LENGTH, np.int64)  # the slot of the first row that is equal so far
        slots = np.arange(n)
        rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
        depth = 8
        while depth < LENGTH:
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots = slots[tied]
            if not len(slots):
                break
            step = min(depth, LENGTH - depth)
            places = order[slots]
            own, ahead = rank[places], rank[places + step]
            by = Shard._by(own.view(np.uint64), ahead.view(np.uint64), n)
            places, own, ahead = places[by], own[by], ahead[by]
            order[slots] = places
            new = np.ones(len(slots), bool)
            new[1:] = (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])
            rank[places] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            depth += step
        return order

    @staticmethod
    def _by(high: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
        """The order by (high, low), each below max(n, 2 ** 32): one sort of words that hold both and the place where those fit."""
        bits, place = [np.uint64(max(int(x.max()) if len(x) else 0, 1).bit_length()) for x in (high, low)], np.uint64(max(len(high), 2).bit_length())
        mask = (np.uint64(1) << place) - np.uint64(1)
        at = np.arange(len(high), dtype=np.uint64)
        if int(bits[0]) + int(bits[1]) + int(place) <= 64:
            return (np.sort((high << bits[1] | low) << place | at) & mask).astype(np.int64)
        first = (np.sort(low << place | at) & mask).astype(np.int64)
        return first[(np.sort(high[first] << place | at) & mask).astype(np.int64)]


def repeated(block: np.ndarray) -> np.ndarray:
    """Which rows, in blocks marked by their first rows, share a block with another."""
    out = ~block
    out[:-1] |= ~block[1:]
    return out


def merged(one: Shard, two: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of strings that another place has too, in the order of the strings: which are of the second shard, where in their shard, and where blocks of equal strings begin.

    The first interleave is by FIRST bytes, by which the shards' rows come sorted, so it is one merge of two sorted lists.
    A row alone in its block has no equal at any greater depth, nor has any row before it: it leaves the interleave.
    """
    n = len(one.order)
    prefix = np.concatenate([one.prefix, two.prefix])
    before = np.concatenate([one.before.astype(np.int64), two.before.astype(np.int64) + n]) << 16 | np.concatenate([one.bwt, two.bwt])
    row = np.argsort(prefix, kind="stable")  # in the first shard's rows, or from n on in the second's
    border = np.ones(len(row), bool)
    border[1:] = np.diff(prefix[row].view(np.int64)) != 0
    for _ in range(FIRST, LENGTH, 2):
        stay = repeated(border)
        block = np.cumsum(border, dtype=np.int32)[stay]
        link = before[row[stay]]
        pair = link.astype(np.uint16)
        order = np.argsort(pair, kind="stable")[: np.count_nonzero(pair != NO_PAIR)]
        row, pair, block = link[order] >> 16, pair[order], block[order]
        border = np.ones(len(row), bool)
        border[1:] = (block[1:] != block[:-1]) | (pair[1:] != pair[:-1])
    stay = repeated(border)
    row, border = row[stay], border[stay]
    return row >= n, np.concatenate([one.order, two.order])[row], border


def first_documents(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each place of a string in the given runs (each with its smallest document) the smallest document that has the string."""
    out = np.repeat(doc, sizes)
    if not len(sizes):
        return out
    half = int(np.searchsorted(np.cumsum(sizes), len(data) / 2)) + 1 if len(sizes) > 1 else 1
    half = min(half, len(sizes))
    cut = int(begins[half - 1] + sizes[half - 1])
    second, at, border = merged(Shard(data[:cut], begins[:half], sizes[:half]), Shard(data[cut:], begins[half:] - cut, sizes[half:]))
    at += np.where(second, cut, 0)
    if not len(at):
        return out
    starts = np.flatnonzero(border)
    least = np.minimum.reduceat(out[at], starts)
    out[at] = np.repeat(least, np.diff(np.r_[starts, len(at)]))
    return out


def found(low_doc: np.ndarray, high_doc: np.ndarray, strings: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of runs that are in smaller documents: run, first string, one past the last, a document.

    The document is the first that has the strings, or NO_ID where that is smaller than all of the run's documents (low_doc to high_doc).
    """
    sizes = strings + LENGTH - 1
    begins = np.cumsum(sizes) - sizes
    digest = digests(body, begins, sizes)
    # equal runs become one, with the smallest of their documents; runs of the first documents come first
    by = np.argsort(digest[:, 0])
    new = np.r_[True, (digest[by][1:] != digest[by][:-1]).any(1)]
    which = np.empty(len(by), np.int64)
    which[by] = np.cumsum(new) - 1
    unique, first = by[new], np.minimum.reduceat(low_doc[by], np.flatnonzero(new))
    rank = np.argsort(first, kind="stable")
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    which, unique = place[which], unique[rank]
    size = sizes[unique]
    data = np.full(int((size + 1).sum()), END, np.uint8)
    start = np.cumsum(size + 1) - (size + 1)
    data[ranges(start, size)] = body[ranges(begins[unique], size)]
    least = first_documents(data, start, size + 1, first[rank])
    # a string is removed where its document is larger than the first that has it
    n = strings[unique]
    every = least[ranges(start, n)]
    cuts = np.cumsum(n) - n
    whole = low_doc > np.maximum.reduceat(every, cuts)[which]
    part = np.flatnonzero(~whole & (high_doc > np.minimum.reduceat(every, cuts)[which]))
    whole = np.flatnonzero(whole)
    m = strings[part]
    who = np.repeat(part, m)
    inside = ranges(np.zeros(len(part), np.int64), m)
    value = every[ranges(cuts[which[part]], m)]
    value = np.where(value < low_doc[who], NO_ID, value)
    edge = np.ones(len(who), bool)
    edge[1:] = (who[1:] != who[:-1]) | (value[1:] != value[:-1])
    begin = np.flatnonzero(edge)
    end = np.r_[begin[1:], len(who)][: len(begin)]
    gone = value[begin] < high_doc[who[begin]]
    begin, end = begin[gone], end[gone]
    run = np.r_[whole, who[begin]]
    lo, hi = np.r_[np.zeros(len(whole), np.int64), inside[begin]], np.r_[strings[whole], inside[end - 1] + 1]
    return run, lo, hi, np.r_[np.full(len(whole), NO_ID), value[begin]]


def found_in_bucket(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """For each chunk of a bucket the parts of its runs that are in smaller documents, as `found` gives them, with the chunk's numbers of the runs."""
    first, count, low, more, strings, body = zip(*(unpack(data) for _, data in rows), strict=True)
    ends = [np.cumsum(c) for c in count]  # of each part, in runs and in bytes
    size = [n.astype(np.int64) + LENGTH - 1 for n in strings]
    until = [np.r_[0, np.cumsum(n)] for n in size]
    got: list[list[tuple]] = [[] for _ in rows]
    for k in range(PARTS):
        cut = [slice(int(e[k] - c[k]), int(e[k])) for e, c in zip(ends, count, strict=True)]
        runs = np.array([int(c[k]) for c in count])
        if not runs.sum():
            continue
        pick = lambda of: np.concatenate([x[c] for x, c in zip(of, cut, strict=True)])  # noqa: E731, B023
        low_doc = pick(low)
        run, lo, hi, doc = found(low_doc, low_doc + pick(more), pick(size) - LENGTH + 1, np.concatenate([b[u[c.start] : u[c.stop]] for b, u, c in zip(body, until, cut, strict=True)]))
        order = np.argsort(run, kind="stable")
        run, lo, hi, doc = run[order], lo[order], hi[order], doc[order]
        before = np.cumsum(runs) - runs
        edges = np.searchsorted(run, np.r_[before, runs.sum()])
        for r in np.flatnonzero(np.diff(edges)).tolist():
            s = slice(edges[r], edges[r + 1])
            got[r].append((run[s] - before[r] + cut[r].start + first[r][0], lo[s], hi[s], doc[s]))
    for (chunk, _), parts in zip(rows, got, strict=True):
        if parts:
            run, lo, hi, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield chunk, pack(small(run), small(lo), small(hi), doc)


def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0 goes through; kind 2: parts of a chunk's runs, from sorted buckets."""

    def out() -> pa.RecordBatch:
        return batch_of([(2, bucket, c, spans) for c, spans in found_in_bucket(held)])

    held: list[tuple[int, bytes]] = []
    bucket = None
    for batch in batches:
        for kind, b, chunk, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held and b != bucket:
                yield out()
                held = []
            bucket = b
            if kind == 0:
                yield batch_of([(0, b, chunk, data)])
            else:
                held.append((chunk, data))
    if held:
        yield out()


def united(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of overlapping or touching ones."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
    return begin[first], end[np.r_[first[1:] - 1, len(end) - 1]]


def spans_by_document(table: pa.Table) -> dict[tuple[int, int], bytes]:
    """Packed spans of a chunk's texts that lose bytes, by doc_id and row_fp."""
    places, parts = None, []
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
        if kind == 0:
            places = unpack(data.as_py())
        else:
            parts.append(unpack(data.as_py()))
    if not parts:
        return {}
    ids, fps, text, begin, new = places
    run, lo, hi, first = (np.concatenate([p[k].astype(np.int64) for p in parts]) for k in range(4))
    head = np.flatnonzero(np.unpackbits(new, count=len(text)))
    times = np.diff(np.r_[head, len(text)])[run]
    at, part = ranges(head[run], times), np.repeat(np.arange(len(run)), times)
    gone = first[part] < ids[text[at]]
    at, part = at[gone], part[gone]
    text, begin = text[at].astype(np.int64), begin[at].astype(np.int64)
    begin, end = begin + lo[part], begin + hi[part] + LENGTH - 1
    order = np.argsort(text, kind="stable")
    cuts = np.searchsorted(text[order], np.arange(len(ids) + 1))
    out = {}
    for k in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[k] : cuts[k + 1]]
        out[int(ids[k]), int(fps[k])] = pack(*united(begin[at], end[at]))
    return out


def with_spans(docs: pa.Table, found_rows: pa.Table) -> pa.Table:
    """doc_id, row_fp, text, spans (packed begins and ends in bytes, null where nothing goes) of a chunk."""
    spans = spans_by_document(found_rows)
    made = [spans.get((NO_ID if d is None else d, f)) for d, f in zip(docs.column("doc_id").to_pylist(), docs.column("row_fp").to_pylist(), strict=True)]
    return pa.table({"doc_id": docs.column("doc_id"), "row_fp": docs.column("row_fp"), "text": docs.column("text"), "spans": pa.array(made, pa.binary())})


def dealt_in(size: int, p: int) -> tuple[int, int]:
    """Chunks and buckets for texts of `size` bytes and p partitions."""
    return max(p, math.ceil(size / CHUNK_BYTES)), max(p, math.ceil(SHARED * size / BUCKET_BYTES))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row_fp, text, spans of each row of docs."""
    spark = docs.sparkSession
    tune(spark)
    own = documents(docs).select("doc_id", "text", "row_fp")
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    p = partitions(spark)
    n_chunks, n_buckets = dealt_in(size, p)
    dealt = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row_fp"), F.lit(n_chunks))).repartition(p, "chunk")
    by_bucket = lambda rows: rows.repartition(p, "bucket").sortWithinPartitions("bucket", "chunk")
    keys = by_bucket(dealt.sortWithinPartitions("chunk").mapInArrow(lean(anchor_keys(n_buckets)), KEYS)).mapInArrow(lean(shared_keys), KEYS)
    rows = dealt.groupBy("chunk").cogroup(keys.groupBy("chunk")).applyInArrow(spread(n_buckets), ROW)
    spans = by_bucket(rows).mapInArrow(lean(searched), ROW)
    return dealt.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(with_spans, "doc_id long, row_fp long, text string, spans binary")


def without(text: bytes, spans: bytes | None) -> tuple[bytes, int]:
    """A text's bytes outside its spans, and the number of spans."""
    if spans is None:
        return text, 0
    begin, end = (x.tolist() for x in unpack(spans))
    return b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)], strict=True)), len(begin)


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    both = repeated_spans(docs).select("doc_id", "text", "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = texts(batch)
            got = [without(t, s) for t, s in zip(held, batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in held], pa.int64()), pa.array([len(t) - len(g[0]) for t, g in zip(held, got, strict=True)], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

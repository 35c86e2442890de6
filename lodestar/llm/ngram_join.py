"""N-gram Jaccard join (7): near-duplicate documents by their sets of 5-word shingles.

Two sets are linked when 100 * shared >= 75 * union. Equal sets are one node, named by the smallest
doc_id. A shingle is a 48-bit hash. Texts are read once, in chunks. The chunks' shingles meet in
buckets, and come back to their chunks with the number of sets that have them if that is more than
one. All that follows needs only these: a shingle of one set is in no intersection.

Points for the tree are first dealt out without loss: in any order of shingles that is the same for
all, two linked sets share one of the first n - ceil(0.75 n) + 1. The order is by that exact number,
so a set with enough shingles of its own needs no partner at all. Nodes that share such a shingle,
directly or in turn, form a class, as far as their sizes allow a link; sharing is passed on as runs
of sizes for each chunk of text and each shingle, never as pairs.

Inside a class, shingles are hashed into GROUPS groups, and a node is the point of its group counts.
Two sets share at most the sum of the smaller counts. An R-tree over the points (pages, then nodes
of the tree, with the largest count in each group and the smallest set) finds the pairs whose bound
reaches the threshold, and those are verified on the sets; only verified pairs are links. A class
larger than a page is first held against its smallest node. Nodes not linked to it are searched for
in the class's pages, the leaves of its tree, as far as the leaves' bounds allow.

A shingle that very many sets of a chunk have goes to its bucket as one count; its places go straight
to the chunk. So a bucket holds at most FEW places for each chunk and shingle, however common it is.

Defined results: a null or empty text has no shingles and is its own component. A text of fewer than
five words is one shingle. A row without doc_id is linked with nothing and has no component. Rows
that repeat a doc_id are one node where their texts agree, and one document otherwise too: what is
linked to either is linked to both. An empty table gives an empty table; extra columns are ignored.
Sets are compared by their 48-bit hashes, which could only matter where two shingles of the very pair
at hand collide (for two sets of 1000 about 4 in a billion).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import chunks, connected, documents, lean, pack, partitions, salted_lookup, small, steps, stored, summed_up, texts, tune, unpack

WORDS = 5
#: Links: OF * shared >= NEED * (both sizes), which is 100 * shared >= 75 * union.
OF, NEED = 7, 3
#: Bits of a shingle's hash; places that fit in the rest of a word.
BITS, PLACES = np.uint64(48), 1 << 16
#: Groups of shingles; entries of the tree's nodes; points of a page.
GROUPS, FANOUT, PAGE = 64, 16, 512
#: Bytes of text in a chunk; shingles that a bucket is meant for; places of a shingle that a chunk sends to its bucket.
CHUNK_BYTES, BUCKET_KEYS, FEW = 6 << 20, 2_000_000, 4

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

MET = "kind int, bucket int, chunk long, doc_id long, row_fp long, place int, n long, k1 long, k2 long, data binary"
_MET = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("row_fp", pa.int64()), ("place", pa.int32()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("data", pa.binary())])
DIGEST, POSTED, HOT = 0, 1, 2


def shingle_sets(batch: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes of 64 bits, ascending."""
    split = [t.lower().split() for t in batch]
    sizes = np.array([len(w) for w in split], np.int64)
    coded = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    h = hashes[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    n = max(len(h) - WORDS + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(WORDS):
        rolled = rolled * _STEP + h[k : k + n]
    rolled = (rolled ^ (rolled >> np.uint64(31))) * _MIX
    rolled ^= rolled >> np.uint64(29)
    out, at = [], 0
    for size in sizes.tolist():
        if size >= WORDS:
            out.append(np.unique(rolled[at : at + size - WORDS + 1]))
        elif size:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[at : at + size].tobytes(), seed=size)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def met_rows(kind: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Rows of packed data for buckets: (bucket, chunk, data)."""
    n = len(rows)
    cols = {"kind": [kind] * n, "bucket": [r[0] for r in rows], "chunk": [r[1] for r in rows], "data": [r[2] for r in rows]}
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _MET], schema=_MET)


def bucket_cuts(words: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending words that have a hash above 16 bits; a bucket is a range of hashes."""
    begins = np.array([-(-(b << 32) // n_buckets) for b in range(n_buckets)], np.uint64) << np.uint64(32)
    return np.r_[np.searchsorted(words, begins), len(words)]


def digested(n_buckets: int):
    """DIGEST: a text's set by size and 128-bit hash, and its place in a chunk. POSTED: for a bucket the chunk's shingles with their
    places, and the counts of those with more than FEW. HOT: the places of those. Of a chunk's equal sets the one with the smallest doc_id posts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, CHUNK_BYTES, PLACES):
            sets, rows = shingle_sets(texts(batch)), batch.num_rows
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            keys = np.frombuffer(b"".join(digest), ">i8").reshape(-1, 2).astype(np.int64)
            ids, fps = batch.column("doc_id"), batch.column("row_fp")
            yield pa.RecordBatch.from_arrays([pa.array([DIGEST] * rows, pa.int32()), pa.array(np.arange(rows) % n_buckets, pa.int32()), pa.array([chunk] * rows, pa.int64()), ids, fps, pa.array(np.arange(rows), pa.int32()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.nulls(rows, pa.binary())], schema=_MET)
            first: dict[bytes, tuple[int, int, int]] = {}
            for k, (d, doc, fp) in enumerate(zip(digest, ids.to_pylist(), fps.to_pylist(), strict=True)):
                if len(sets[k]) and doc is not None and (d not in first or (doc, fp) < first[d][:2]):
                    first[d] = doc, fp, k
            post = sorted(k for _, _, k in first.values())
            if post:
                words = np.concatenate([sets[k] for k in post]) >> (np.uint64(64) - BITS) << np.uint64(16)
                words |= np.repeat(np.array(post, np.uint64), [len(sets[k]) for k in post])
                del sets
                words.sort()
                yield from posted(words, chunk, n_buckets)
            chunk += 1

    return run


def posted(words: np.ndarray, chunk: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    keys, places = words >> np.uint64(16), words.astype(np.uint16)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    count = np.diff(np.r_[np.flatnonzero(new), len(keys)])
    many = count > FEW
    hot_words, hot_counts = words[new][many], count[many]
    hot = np.repeat(many, count)
    cold_words, cold_keys, cold_places = words[~hot], keys[~hot], places[~hot]
    at, hot_at = bucket_cuts(cold_words, n_buckets), bucket_cuts(hot_words, n_buckets)
    rows = []
    for b in range(n_buckets):
        c, h = slice(at[b], at[b + 1]), slice(hot_at[b], hot_at[b + 1])
        if c.start < c.stop or h.start < h.stop:
            rows.append((b, chunk, pack(steps(cold_keys[c]), small(cold_places[c]), steps(hot_words[h] >> np.uint64(16)), small(hot_counts[h]))))
    yield met_rows(POSTED, rows)
    if hot.any():
        yield met_rows(HOT, [(chunk % n_buckets, chunk, pack(steps(hot_words >> np.uint64(16)), small(hot_counts), small(places[hot])))])


def times_code(times: np.ndarray) -> np.ndarray:
    """Numbers of sets in a byte: exact below 128, then in eighths of a power of two."""
    return np.where(times < 128, times, np.minimum(128 + 8 * np.log2(np.maximum(times, 128) / 128), 255)).astype(np.uint8)


def shared_by_chunk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DIGEST and HOT go through; POSTED comes back to each chunk: the shingles that other sets have too, with places and codes of their numbers. From sorted buckets."""

    def out() -> Iterator[pa.RecordBatch]:
        parts = [h[1] for h in held]
        keys = np.concatenate([x for q in parts for x in (q[0], q[2])])
        own = np.concatenate([x for q in parts for x in (np.ones(len(q[0]), np.int64), q[3].astype(np.int64))])
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = np.diff(keys[order]) != 0
        starts = np.flatnonzero(new)
        total = np.add.reduceat(own[order], starts)
        times = np.empty(len(keys), np.int64)
        times[order] = np.repeat(total, np.diff(np.r_[starts, len(keys)]))
        code, at, rows = times_code(times), 0, []
        for chunk, (cold, places, hot, _) in held:
            use = code[at : at + len(cold)] > 1
            mine, hot_codes = code[at : at + len(cold)][use], code[at + len(cold) : at + len(cold) + len(hot)]
            at += len(cold) + len(hot)
            if use.any() or len(hot):
                rows.append((bucket, chunk, pack(steps(cold[use]), places[use], mine, steps(hot), hot_codes)))
        if rows:
            yield met_rows(POSTED, rows)

    held: list[tuple[int, tuple[np.ndarray, ...]]] = []
    bucket = None
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        through = np.flatnonzero(kind != POSTED)
        if len(through):
            yield batch.take(pa.array(through))
        for k in np.flatnonzero(kind == POSTED).tolist():
            b = batch.column("bucket")[k].as_py()
            if held and b != bucket:
                yield from out()
                held = []
            bucket = b
            cold, places, hot, counts = unpack(batch.column("data")[k].as_py())
            held.append((batch.column("chunk")[k].as_py(), (summed_up(cold), places, summed_up(hot), counts)))
    if held:
        yield from out()


def chained(keys: np.ndarray, low: np.ndarray, high: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set sizes (low to high) of a key, joined where one reaches three quarters of the next: the joined
    runs, each named by one node, and edges (two columns) from that to the nodes that named its parts.

    Two sets of a key whose sizes allow a link are always in one run.
    """
    if not len(keys):
        return keys, low, high, nodes, np.zeros((0, 2), np.int64)
    order = np.lexsort((nodes, low, keys))
    keys, low, high, nodes = keys[order], low[order], high[order], nodes[order]
    new_key = np.r_[True, keys[1:] != keys[:-1]]
    reach = np.maximum.accumulate(high + np.cumsum(new_key) * (1 << 40)) - np.cumsum(new_key) * (1 << 40)
    first = np.flatnonzero(np.r_[True, new_key[1:] | (4 * reach[:-1] < 3 * low[1:])])
    name = np.repeat(nodes[first], np.diff(np.r_[first, len(keys)]))
    edges = np.stack([name, nodes], 1)[name != nodes]
    return keys[first], low[first], np.maximum.reduceat(high, first), nodes[first], edges


def attached(keys: np.ndarray, low: np.ndarray, high: np.ndarray, names: np.ndarray, late_keys: np.ndarray, late_sizes: np.ndarray, late_nodes: np.ndarray) -> np.ndarray:
    """Edges from runs (sorted by key and low) to late nodes that a smaller set of the run could be linked to; there is one such run at most."""
    both = np.unique(np.concatenate([keys, late_keys]))
    code, late_code = np.searchsorted(both, keys), np.searchsorted(both, late_keys)
    at = np.searchsorted((code << 32) + low, (late_code << 32) + late_sizes, side="right") - 1
    ok = at >= 0
    ok[ok] = (code[at[ok]] == late_code[ok]) & (4 * high[at[ok]] >= 3 * late_sizes[ok])
    edges = np.stack([names[at[ok]], late_nodes[ok]], 1)
    return edges[edges[:, 0] != edges[:, 1]]


KEYED = "kind int, bucket int, node long, n long, data binary"
RUNS, SET = 0, 1


def six_bytes(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def keyed(n_buckets: int):
    """Of a chunk's nodes that may be linked: RUNS, for each bucket the runs of early shingles, and the late shingles, the first row also with
    the edges inside the chunk; SET, a node's size and those of its shingles that others have.

    The first shingle that two linked sets share stands among the first seventh of the smaller one: it is early there.
    """

    def run(met: pa.Table, nodes: pa.Table) -> pa.Table:
        empty = pa.table({"kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        if not met.num_rows or not nodes.num_rows:
            return empty
        node_of, size_of = np.full(PLACES, -1), np.zeros(PLACES, np.int64)
        at = nodes.column("place").to_numpy()
        has = np.zeros(PLACES, bool)
        node_of[at], size_of[at], has[at] = nodes.column("node").to_numpy(), nodes.column("n").to_numpy(), True
        keys, places, codes, hot_keys, hot_codes, hot_posted = [], [], [], [], [], []
        for kind, data in zip(met.column("kind").to_pylist(), met.column("data"), strict=True):
            if kind == HOT:
                hot_posted.append(unpack(data.as_py()))
            else:
                cold, where, code, hot, hot_code = unpack(data.as_py())
                keys.append(summed_up(cold))
                places.append(where.astype(np.int64))
                codes.append(code)
                hot_keys.append(summed_up(hot))
                hot_codes.append(hot_code)
        if hot_posted:
            known, code_of = np.concatenate(hot_keys), np.concatenate(hot_codes)
            by = np.argsort(known)
            for hot, counts, where in hot_posted:
                hot = summed_up(hot)
                keys.append(np.repeat(hot, counts))
                codes.append(np.repeat(code_of[by[np.searchsorted(known, hot, sorter=by)]], counts))
                places.append(where.astype(np.int64))
        keys, places, codes = np.concatenate(keys), np.concatenate(places), np.concatenate(codes)
        use = has[places]
        keys, places, codes = keys[use], places[use], codes[use]
        order = np.lexsort((keys, places << 8 | codes))
        keys, places = keys[order], places[order]
        if not len(keys):
            return empty
        new = np.ones(len(keys), bool)
        new[1:] = places[1:] != places[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(keys)])
        twice = int(np.count_nonzero(~new[1:] & (keys[1:] == keys[:-1])))  # shingles of one set with one hash: at most so many ranks are off
        n = size_of[places[first]]
        alone = n - count
        rank = np.arange(len(keys)) - np.repeat(first - alone, count) - twice
        sizes = np.repeat(n, count)
        in_prefix = rank < sizes - -(-3 * sizes // 4) + 1
        asks = np.maximum.reduceat(in_prefix, first)
        rows = [(SET, None, int(node_of[places[f]]), int(m), six_bytes(np.sort(keys[f : f + c]))) for f, c, m in zip(first[asks].tolist(), count[asks].tolist(), n[asks].tolist(), strict=True)]
        keys, sizes, owner, early = keys[in_prefix].astype(np.uint64), sizes[in_prefix], node_of[places[in_prefix]], (OF * (sizes - np.maximum(rank, 0)) >= 2 * NEED * sizes)[in_prefix]
        run_keys, low, high, names, edges = chained(keys[early], sizes[early], sizes[early], owner[early])
        edges = np.unique(edges, axis=0)
        every = np.concatenate([run_keys, keys[~early]])
        low, high, owner = np.concatenate([low, sizes[~early]]), np.concatenate([high, sizes[~early]]), np.concatenate([names, owner[~early]])
        is_late = np.arange(len(every)) >= len(run_keys)
        where = ((every * _MIX >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(n_buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[b] : cuts[b + 1]]
            known, code = np.unique(owner[at], return_inverse=True)
            rows.append((RUNS, b, None, None, pack(every[at], small(low[at]), small(high[at] - low[at]), known, small(code), np.packbits(is_late[at]), edges)))
            edges = edges[:0]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in empty.schema]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, empty.schema, strict=True)], schema=empty.schema)

    return run


def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges, inside and between chunks, from sorted buckets."""

    def out() -> pa.RecordBatch:
        keys, low, high, nodes, late = (np.concatenate(x) for x in zip(*(h[:5] for h in held), strict=True))
        *runs, edges = chained(keys[~late], low[~late], high[~late], nodes[~late])
        edges = np.concatenate([edges, attached(*runs, keys[late], low[late], nodes[late]), *(h[5] for h in held)])
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], ["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    bucket = None
    for batch in batches:
        for b, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
            if held and b != bucket:
                yield out()
                held = []
            bucket = b
            keys, low, more, names, code, late, edges = unpack(data.as_py())
            low = low.astype(np.int64)
            held.append((keys, low, low + more.astype(np.int64), names[code], np.unpackbits(late, count=len(keys)).astype(bool), edges))
    if held:
        yield out()


class CountRTree:
    """An R-tree over group counts. A node keeps the largest count of each group and the smallest set below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._packed(points, sizes)
        self.levels = []
        upper, least = points[self.order], sizes[self.order]
        while True:
            self.levels.append((upper, least))
            if len(upper) <= FANOUT:
                break
            cuts = np.arange(0, len(upper), FANOUT)
            upper, least = np.maximum.reduceat(upper, cuts, axis=0), np.minimum.reduceat(least, cuts)

    @staticmethod
    def _packed(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Slabs by size, each ordered by its most varied group."""
        order = np.argsort(sizes, kind="stable")
        slab = FANOUT * max(1, math.isqrt(max(len(order) // FANOUT, 1)))
        return np.concatenate([s[np.argsort(points[s][:, np.argmax(np.ptp(points[s], axis=0))], kind="stable")] for s in np.split(order, range(slab, len(order), slab))])

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points that may share enough with a set of these counts."""
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            upper, least = self.levels[level]
            at = at[OF * np.minimum(upper[at], point).sum(1) >= NEED * (size + least[at])]
            if level:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1)
                at = at[at < len(self.levels[level - 1][0])]
        return self.order[at]


def group_counts(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles >> (BITS - np.uint64(6))).astype(np.int64), minlength=GROUPS)


def linked(one: np.ndarray, size: int, others: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Which of the others have a Jaccard similarity of at least 0.75 with one; of the sets (sorted) only what others have too is given, and their whole sizes."""
    if not others:
        return np.zeros(0, bool)
    lengths = np.array([len(s) for s in others], np.int64)
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    both = np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum(lengths) - lengths)
    return OF * both >= NEED * (size + sizes)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def tree_links(queries: list[int], sets: list[np.ndarray], sizes: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
    """Links that join what the forest has apart, from searches of the given sets in a tree of all."""
    points = np.stack([group_counts(s) for s in sets])
    tree, out = CountRTree(points, sizes), []
    for q in queries:
        found = [int(k) for k in tree.search(points[q], int(sizes[q])) if k != q]
        while found:
            root = forest.find(q)
            apart: dict[int, list[int]] = {}
            for k in found:
                if (r := forest.find(k)) != root:
                    apart.setdefault(r, []).append(k)
            tried = [ks[-1] for ks in apart.values()]  # one of each class still apart, until none is left to try
            if not tried:
                break
            for k, ok in zip(tried, linked(sets[q], int(sizes[q]), [sets[k] for k in tried], sizes[tried]), strict=True):
                if ok and forest.join(q, k):
                    out.append((q, k))
            done = set(tried)
            found = [k for ks in apart.values() for k in ks if k not in done]
    return out


def page_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in each task (a run of rows with one `task`); rows: task, node, home (linked to the class's smallest node), query, n, shingles."""

    def out() -> pa.RecordBatch:
        forest, home = Forest(len(held)), [k for k, r in enumerate(held) if r[2]]
        for k in home[1:]:
            forest.join(home[0], k)
        found = tree_links([k for k, r in enumerate(held) if r[3]], [r[5] for r in held], np.array([r[4] for r in held], np.int64), forest)
        return pa.RecordBatch.from_arrays([pa.array([held[a][1] for a, _ in found], pa.int64()), pa.array([held[b][1] for _, b in found], pa.int64())], ["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("task", "node", "home", "query", "n", "shingles")), strict=True):
            if held and held[0][0] != row[0]:
                yield out()
                held = []
            held.append((*row[:5], from_six(row[5])))
    if held:
        yield out()


def home_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, home: whether a node is linked to its class's smallest node, by bound and then by sets; point: its group counts."""
    for batch in batches:
        ok, points = [], []
        for own, n, centre, m in zip(*(batch.column(c).to_pylist() for c in ("shingles", "n", "centre", "centre_n")), strict=True):
            a, b = from_six(own), from_six(centre)
            points.append(group_counts(a))
            may = OF * int(np.minimum(points[-1], group_counts(b)).sum()) >= NEED * (n + m)
            ok.append(may and bool(linked(b, m, [a], np.array([n]))[0]))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(ok, pa.bool_()), pa.array([x.tolist() for x in points], pa.list_(pa.int32()))], ["node", "home", "point"])


def _large_links(large: DataFrame) -> DataFrame:
    """Links in classes of more than a page: to the smallest node first, then of the nodes that are not linked to it.

    Pages are leaves of the class's tree: nodes of like size, the linked and the others apart. A page of
    others meets the leaves whose sizes and summed coordinate minima allow a link, itself among them.
    """
    centre = large.filter("node = class").select("class", F.col("shingles").alias("centre"), F.col("n").alias("centre_n"))
    homes = salted_lookup(large.select("class", "node", "n", "shingles"), centre, ["class"], "node", "inner").mapInArrow(lean(home_links), "node long, home boolean, point array<int>")
    homes = stored(homes, "homes")
    rows = large.join(homes, "node").withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.02))))
    bands = rows.groupBy("class", "band", "home").agg(F.ceil(F.count("*") / PAGE).alias("parts"))
    rows = salted_lookup(rows, bands, ["class", "band", "home"], "node", "inner").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("page", F.xxhash64("class", "band", "home", "part"))
    paged = stored(rows.select("class", "page", "node", "home", "n", "point", "shingles"), "pages")
    pages = paged.groupBy("class", "page", "home").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.array(*(F.max(F.col("point")[g]) for g in range(GROUPS))).alias("upper"))
    a, b = pages.filter("not home").alias("a"), pages.alias("b")
    # sets are linked only if the smaller has three quarters of the larger
    near = (F.col("a.class") == F.col("b.class")) & (4 * F.col("a.high") >= 3 * F.col("b.low")) & (4 * F.col("b.high") >= 3 * F.col("a.low"))
    bound = F.aggregate(F.zip_with("a.upper", "b.upper", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    near = near & (F.col("b.home") | (F.col("a.page") <= F.col("b.page"))) & (OF * bound >= NEED * (F.col("a.low") + F.col("b.low")))
    tasks = a.join(b, near).select(F.xxhash64("a.page", "b.page").alias("task"), F.col("a.page").alias("asking"), F.col("b.page").alias("asked"))
    asking = tasks.select("task", F.col("asking").alias("page"), F.lit(True).alias("query"))
    asked = tasks.filter("asking <> asked").select("task", F.col("asked").alias("page"), F.lit(False).alias("query"))
    dealt = asking.unionByName(asked).join(paged, "page").select("task", "node", "home", "query", "n", "shingles")
    return _by_task(dealt).unionByName(homes.filter("home").join(large.select("node", "class"), "node").select(F.col("node").alias("a"), F.col("class").alias("b")))


def _by_task(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "task").sortWithinPartitions("task").mapInArrow(lean(page_links), "a long, b long")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, row_fp, n_shingles, component_id."""
    spark = docs.sparkSession
    tune(spark)
    p = partitions(spark)
    own = documents(docs).select("doc_id", "row_fp", "text")
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_buckets = max(p, math.ceil(size / WORDS / BUCKET_KEYS))
    posted_rows = own.mapInArrow(lean(digested(n_buckets)), MET).repartition(p, "bucket").sortWithinPartitions("bucket")
    met = stored(posted_rows.mapInArrow(lean(shared_by_chunk), MET), "met", ["kind"]).select("kind", "chunk", "doc_id", "row_fp", "place", "n", "k1", "k2", "data")
    digests = met.filter(F.col("kind") == DIGEST).select("doc_id", "row_fp", "chunk", "place", "n", "k1", "k2")
    # one row of a set stands for it: the first in its chunk, which has posted the set
    least = F.min(F.struct("doc_id", "row_fp", "chunk", "place")).alias("m")
    nodes = stored(digests.filter("doc_id is not null and n > 0").groupBy("k1", "k2").agg(least, F.max("n").alias("n")).select("k1", "k2", F.col("m.doc_id").alias("node"), "m.chunk", "m.place", "n"), "nodes")
    back = met.filter(F.col("kind") != DIGEST).select("chunk", "kind", "data")
    made = stored(back.groupBy("chunk").cogroup(nodes.select("chunk", "place", "node", "n").groupBy("chunk")).applyInArrow(keyed(n_buckets), KEYED), "keyed", ["kind"]).select("kind", "bucket", "node", "n", "data")
    runs = made.filter(F.col("kind") == RUNS).select("bucket", "data")
    edges = runs.repartition(p, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(shared), "a long, b long")
    classes = connected(edges)
    members = classes.groupBy("root").agg(F.count("*").alias("members"))
    classes = stored(salted_lookup(classes, members, ["root"], "node", "inner").select("node", F.col("root").alias("class"), "members"), "classes")
    # a doc_id with several texts is several sets of one node: they are joined as they are, and linked through it
    sets = stored(made.filter(F.col("kind") == SET).select("node", "n", F.col("data").alias("shingles")).join(classes, "node"), "sets")
    few = sets.filter(F.col("members") <= PAGE).select(F.col("class").alias("task"), "node", F.lit(False).alias("home"), F.lit(True).alias("query"), "n", "shingles")
    links = _by_task(few).unionByName(_large_links(sets.filter(F.col("members") > PAGE).select("class", "node", "n", "shingles")))
    roots = connected(links)
    at = nodes.join(roots, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("component_id"))
    out = digests.join(at, ["k1", "k2"], "left")
    found = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row_fp", F.col("n").alias("n_shingles"), found.cast("long").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return components(docs).drop("row_fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the rows of docs whose doc_id names it, or that have none; with the same columns."""
    names = docs.columns
    row = F.struct(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)))
    rows = documents(docs.select("doc_id", "text", row.alias("_row")), "_row").drop("text").alias("a")
    gone = components(docs).filter("component_id <> doc_id").select("doc_id", "row_fp").distinct().alias("b")
    kept = rows.join(gone, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.row_fp") == F.col("b.row_fp")), "left_anti")
    return kept.select(*(F.col(f"_row.c{i}").alias(n) for i, n in enumerate(names)))

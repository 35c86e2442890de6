"""Queries on the whole of their input, against brute force."""

import heapq
import math
from collections import Counter

import duckdb
import pytest

from lodestar.plans import catalog
from lodestar.sources import tables

SF = "/root/testdata/sf0.001"
N = 4
NAMES = {"hops": "hop_paths", "distance": "distance_paths", "strength": "strength_paths"}


@pytest.fixture
def even_trade(spark, tmp_path):
    """Four nations that trade alike: each ordered pair has one to three order lines, but for 3 -> 0, which has none."""
    counts = {(a, b): 2 for a in range(N) for b in range(N)} | {(0, 1): 3, (1, 2): 1, (3, 2): 1}
    counts.pop((3, 0))
    frames = {
        "nation": ([(n,) for n in range(N)], "n_nationkey int"),
        "customer": ([(n, n) for n in range(N)], "c_custkey long, c_nationkey int"),
        "supplier": ([(n, n) for n in range(N)], "s_suppkey long, s_nationkey int"),
        "orders": ([(n, n) for n in range(N)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(a, b) for (a, b), n in counts.items() for _ in range(n)], "l_orderkey long, l_suppkey long"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), counts


def counted(sf_dir):
    con = duckdb.connect()
    t = lambda n: f"'{sf_dir}/{n}.parquet'"
    rows = con.sql(f"SELECT c_nationkey, s_nationkey, count(*) FROM {t('lineitem')} JOIN {t('orders')} ON l_orderkey = o_orderkey JOIN {t('customer')} ON o_custkey = c_custkey JOIN {t('supplier')} ON l_suppkey = s_suppkey GROUP BY ALL").fetchall()
    return [r[0] for r in con.sql(f"SELECT n_nationkey FROM {t('nation')}").fetchall()], {(a, b): n for a, b, n in rows}


def brute_paths(nations, counts, mode):
    """(source, target) -> cost, hops, strength, path, by Dijkstra over (cost, path in text order)."""
    most, out = max(counts.values()), {}
    step = {"hops": lambda w: 1.0, "distance": lambda w: w, "strength": lambda w: -math.log(w)}[mode]
    for s in nations:
        heap, seen = [(0.0, str(s), 0, 1.0, s)], set()
        while heap:
            cost, path, hops, strength, at = heapq.heappop(heap)
            if at in seen:
                continue
            seen.add(at)
            out[str(s), str(at)] = (cost, hops, strength, path)
            for (a, b), n in counts.items():
                if a == at and b not in seen:
                    heapq.heappush(heap, (round(cost + step(n / most), 12), f"{path} -> {b}", hops + 1, strength * n / most, b))
    return out


def assert_paths(spark, sf_dir):
    nations, counts = counted(sf_dir)
    for mode in ("hops", "distance", "strength"):
        got = {(r.source, r.target): r for r in catalog.QUERIES[NAMES[mode]](spark, sf_dir).collect()}
        want = brute_paths(nations, counts, mode)
        assert set(got) == set(want)
        for k, (cost, hops, strength, path) in want.items():
            r = got[k]
            assert (r.hops, r.path) == (hops, path) and abs(r.path_cost - cost) < 2e-6 and abs(r.path_strength - strength) < 2e-6


def test_even_trade_keeps_every_pair(spark, even_trade):
    sf_dir, counts = even_trade
    v, e = tables.nation_trade(spark, sf_dir)
    assert {(r.src, r.dst): r.weight for r in e.collect()} == {k: n / 3 for k, n in counts.items()}
    assert_paths(spark, sf_dir)


def test_paths_over_all_trade_equal_brute_force(spark):
    assert_paths(spark, SF)


def test_every_nation_is_a_target(spark, even_trade):
    sf_dir, counts = even_trade
    want = {k: v for k, v in brute_paths(range(N), counts, "hops").items() if k[0] != k[1]}
    got = {r.target: r for r in catalog.QUERIES["target_coverage"](spark, sf_dir).collect()}
    for t in map(str, range(N)):
        costs = [c for (_, b), (c, *_) in want.items() if b == t]
        assert (got[t].source_count, got[t].reachable_source_count, got[t].max_distance) == (N - 1, N - 1, max(costs))
    near = {r.source: (r.nearest_target, r.reachable_target_count) for r in catalog.QUERIES["nearest_target"](spark, sf_dir).collect()}
    assert near == {"0": ("1", 3), "1": ("0", 3), "2": ("0", 3), "3": ("1", 3)}


def test_pagerank_of_all_trade_equals_brute_force(spark):
    nations, counts = counted(SF)
    out, rank = Counter(), dict.fromkeys(nations, 1 / len(nations))
    for (a, _), n in counts.items():
        out[a] += n
    for _ in range(200):
        held = sum(r for v, r in rank.items() if not out[v])
        new = dict.fromkeys(nations, 0.15 / len(nations) + 0.85 * held / len(nations))
        for (a, b), n in counts.items():
            new[b] += 0.85 * rank[a] * n / out[a]
        rank = new
    got = {r.id: r.pagerank for r in catalog.QUERIES["pagerank"](spark, SF).collect()}
    assert set(got) == set(nations) and all(abs(got[v] - rank[v]) < 2e-6 for v in nations)


def test_hop_graph_of_even_trade(spark, even_trade):
    """Either way counts as an edge, so the four nations are one complete graph."""
    sf_dir, _ = even_trade
    assert {r.closeness for r in catalog.QUERIES["closeness"](spark, sf_dir).collect()} == {1.0}
    assert {r.betweenness for r in catalog.QUERIES["betweenness"](spark, sf_dir).collect()} == {0.0}
    assert {r.community for r in catalog.QUERIES["communities"](spark, sf_dir).collect()} == {0}

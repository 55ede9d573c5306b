"""Components, cycles, levels, dominators and topology against plain versions, many small graphs at a time."""

import random
from collections import defaultdict

import pytest

from tidewright.operators import graph as G

EDGE = "src long, dst long"


def reach(edges, start, without=None):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    seen, left = set(), [start] if start != without else []
    while left:
        v = left.pop()
        for w in out[v]:
            if w != without and w not in seen:
                seen.add(w)
                left.append(w)
    return seen


def plain_components(nodes, edges):
    ways = {v: reach(edges, v) for v in nodes}
    return {v: min([v, *(w for w in ways[v] if v in ways[w])]) for v in nodes}


def plain_levels(nodes, edges):
    before = {v: {a for a, b in edges if b == v} for v in nodes}
    level = {}
    while True:
        free = [v for v in nodes if v not in level and before[v] <= level.keys()]
        if not free:
            return {v: level.get(v) for v in nodes}
        level.update({v: max((level[u] + 1 for u in before[v]), default=0) for v in free})


def graphs(seed, many=40):
    """Disjoint random graphs of all densities, with chains, rings and loops among them: (nodes, edges, first nodes)."""
    rnd = random.Random(seed)
    nodes, edges, firsts, at = [], [], [], 0
    for k in range(many):
        n = rnd.randint(1, 12)
        mine = list(range(at, at + n))
        shape = k % 5
        some = [(rnd.choice(mine), rnd.choice(mine)) for _ in range(rnd.randint(0, n * (1 + shape) // 2))]
        if shape == 1:
            some = [(min(e), max(e)) for e in some if e[0] != e[1]]
        if shape == 2:
            some += list(zip(mine, mine[1:]))
        if shape == 3:
            some += list(zip(mine, mine[1:] + mine[:1]))
        nodes, edges, firsts, at = nodes + mine, edges + some, [*firsts, at], at + n
    return nodes, edges, firsts


@pytest.fixture(scope="module")
def frames(spark):
    def make(nodes, edges):
        return spark.createDataFrame([(v,) for v in nodes], "node long"), spark.createDataFrame(edges, EDGE)

    return make


@pytest.mark.parametrize("seed", [1])
def test_random_graphs(frames, seed):
    nodes, edges, _ = graphs(seed)
    n, e = frames(nodes, edges)
    want = plain_components(nodes, edges)
    assert {r.node: r.component for r in G.strong_components(n, e).collect()} == want
    assert {r.node: r.level for r in G.levels(n, e).collect()} == plain_levels(nodes, edges)
    groups = defaultdict(list)
    for v, c in want.items():
        groups[c].append(v)
    cyclic = {c: sorted(vs) for c, vs in groups.items() if len(vs) > 1 or (c, c) in set(edges)}
    assert sorted(r.members for r in G.cycle_members(n, e).collect()) == sorted(cyclic.values())
    ways = defaultdict(dict)
    for r in G.cycle_paths(n, e).collect():
        ways[r.component][r.place] = r.node
    assert set(ways) == set(cyclic)
    for c, way in ways.items():
        path = [way[k] for k in range(len(way))]
        assert path[0] == path[-1] == min(path) and len(set(path)) == len(path) - 1 > 0
        assert all(step in set(edges) for step in zip(path, path[1:])) and set(path) <= set(cyclic[c])


@pytest.mark.parametrize("seed", [3])
def test_random_dominators(spark, frames, seed):
    nodes, edges, firsts = graphs(seed)
    n, e = frames(nodes, edges)
    want = {}
    for root in firsts:
        for v in reach(edges, root) | {root}:
            want[v] = [root] if v == root else sorted(d for d in reach(edges, root) | {root} if d in (v, root) or v not in reach(edges, root, without=d))
    tree = G.dominator_tree(e, spark.createDataFrame([(v,) for v in firsts], "node long"))
    got = defaultdict(list)
    for r in G.dominator_pairs(tree).collect():
        got[r.node].append(r.dominator)
    assert {v: sorted(d) for v, d in got.items()} == want
    rows = {r.node: (r.parent, r.depth) for r in tree.collect()}
    assert {v: d for v, (_, d) in rows.items()} == {v: len(d) for v, d in want.items()}
    assert all(p is None or p in want[v] and len(want[p]) == len(want[v]) - 1 for v, (p, _) in rows.items())
    assert {r.node: r.dominates for r in G.dominated(tree).collect()} == {v: sum(v in d for d in want.values()) - 1 for v in want}


def test_several_roots(spark, frames):
    _, e = frames([], [(1, 3), (2, 3), (3, 4), (1, 5), (9, 1)])
    tree = G.dominator_tree(e, spark.createDataFrame([(1,), (2,)], "node long"))
    assert {r.node: (r.parent, r.depth) for r in tree.collect()} == {1: (None, 1), 2: (None, 1), 3: (None, 1), 4: (3, 2), 5: (1, 2)}


def test_a_chain_and_a_ring_of_ten_thousand(frames, monkeypatch):
    many, calls = 10_000, []
    cut = G.cut
    monkeypatch.setattr(G, "cut", lambda df: (calls.append(1), cut(df))[1])
    n, e = frames(range(many), [(k, k + 1) for k in range(many - 1)])
    levels = G.levels(n, e)
    assert levels.where("level = node").count() == many
    assert len(calls) < 40
    assert G.strong_components(n, e).where("component = node").count() == many
    closed = e.union(frames([0], [(many - 1, 0)])[1])
    assert G.strong_components(n, closed).where("component = 0").count() == many
    assert G.levels(n, closed).where("level is null").count() == many
    path = G.cycle_paths(n, closed)
    assert path.where("place = node or (place = 10000 and node = 0)").count() == many + 1
    tree = G.dominator_tree(e, n.where("node = 0"))
    assert tree.where("depth = node + 1 and coalesce(parent, -1) = node - 1").count() == many


def test_empty_graphs(spark):
    n, e = spark.createDataFrame([], "node long"), spark.createDataFrame([], EDGE)
    assert G.strong_components(n, e).count() == G.levels(n, e).count() == G.cycle_paths(n, e).count() == G.dominator_tree(e, n).count() == 0
    one = spark.createDataFrame([(1,), (1,)], "node long")
    assert [tuple(r) for r in G.strong_components(one, spark.createDataFrame([(1, 8), (8, 1)], EDGE)).collect()] == [(1, 1)]


# --- topology


SERVICE = "src string, dst string, kind string, band string"


def table(spark, edges, **options):
    rows = [(a, b, kind, band) for a, b, kind, band in ((*e, "sync_call", "proven")[:4] if len(e) == 2 else (*e, "proven")[:4] for e in edges)]
    return {r.node: r for r in G.topology(spark.createDataFrame(rows, SERVICE), **options).collect()}


def test_topology_counts_and_bands(spark):
    got = table(spark, [("gateway", "backend"), ("backend", "db"), ("backend", "db", "async_message"), ("x", "y", "sync_call", "weak")], least="likely")
    assert set(got) == {"gateway", "backend", "db"}
    assert (got["backend"].fan_in, got["backend"].fan_out, got["gateway"].is_entry, got["db"].is_entry) == (1, 1, True, False)
    assert not any(r.in_cycle or r.single_point_of_failure for r in got.values())


def test_topology_single_points(spark):
    got = table(spark, [("gateway", "hub"), ("hub", "svc1"), ("hub", "svc2"), ("hub", "svc3")])
    assert got["hub"].single_point_of_failure and got["hub"].dominates == 3 and "dominates_many" in got["hub"].criticality_inputs
    # a message that isn't waited for carries no failure on
    soft = table(spark, [("gateway", "hub"), ("hub", "svc1"), ("hub", "svc2", "async_message"), ("hub", "svc3")])
    assert not soft["hub"].single_point_of_failure and soft["svc2"].dominates == 0
    shared = table(spark, [("a", "shared"), ("b", "shared"), ("c", "shared")])
    assert shared["shared"].criticality_inputs == ["high_fan_in"] and all(shared[x].dominates == 0 for x in "abc")


def test_topology_cycles_entries_and_unnamed_callers(spark):
    got = table(spark, [("a", "b"), ("b", "a", "async_message"), ("b", "c")], missing=spark.createDataFrame([("b",), ("zzz",)], "callee string"), entries=spark.createDataFrame([("a",), ("nowhere",)], "node string"))
    assert got["a"].in_cycle and got["b"].in_cycle and not got["c"].in_cycle
    assert got["b"].unnamed_callers == 1 and set(got["b"].criticality_inputs) == {"in_cycle", "unobserved_dependents"}
    assert [v for v, r in got.items() if r.is_entry] == ["a"] and got["a"].dominates == 2

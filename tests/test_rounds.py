"""Work must not grow with the length of a graph's ways, nor with the square of a group."""

import numpy as np
import pytest

from tidewright.operators import graph as G, series_pairs as SP
from tidewright.operators.statistics import rho_critical
from tidewright.session import by_rows


def test_ragged_series_are_ranked_by_patterns(monkeypatch):
    rnd = np.random.default_rng(3)
    a, b = rnd.random((2, 90, 16)).round(1)
    for x in (a, b):
        x[np.arange(90), np.arange(90) % 16] = np.nan
    calls, standard = [], SP._standard
    monkeypatch.setattr(SP, "_standard", lambda x: calls.append(1) or standard(x))
    rho, n = SP.lag_table(a, b, 1, 5)
    assert len(calls) <= 2 * 17 * 17
    for i, j in ((0, 0), (3, 4), (15, 80), (89, 2)):
        x, y = a[i, :-1], b[j, 1:]
        both = ~np.isnan(x) & ~np.isnan(y)
        assert n[i, j] == both.sum()
        assert abs(rho[i, j] - np.corrcoef(SP.ranks(x[both]), SP.ranks(y[both]))[0, 1]) < 1e-9


def some_series(rnd, kinds):
    """40 whole series, some with ties, some flat; 40 that miss the first bucket; 60 with gaps of their own."""
    x = rnd.random((140, 16))
    x[::3] = x[::3].round(1)
    x[5:8] = 0.5
    x[40:80, 0] = np.nan
    x[80:][rnd.random((60, 16)) < 0.4] = np.nan
    x[::10] = x[:1] + x[::10] * 0.1
    return x if kinds else np.where(np.isnan(x), x, rnd.random(x.shape).round(1))


@pytest.mark.parametrize("large", [1, 8, 1000])
def test_pairs_of_patterns_like_tables_of_all_pairs(monkeypatch, large):
    monkeypatch.setattr(SP, "TILE", 24)
    monkeypatch.setattr(SP, "CHUNK", 3000)
    monkeypatch.setattr(SP, "LARGE", large)
    ways = {"_by_pattern": [], "_by_row": [], "_one_by_one": []}
    for name, many in ways.items():
        monkeypatch.setattr(SP, name, lambda *a, way=getattr(SP, name), many=many: (many.append(len(part[0])) or part for part in way(*a)))
    rnd, lags = np.random.default_rng(7), [-2, -1, 0, 1, 3, 20]
    critical = np.array([np.inf, *(round(rho_critical(n), 9) for n in range(1, 17))])
    for kinds in (True, False):
        a, b = some_series(rnd, kinds), some_series(rnd, True)
        lag, rho, n = SP.best_lags(a, b, np.ones((140, 140), bool), lags[:-1], 5)
        expected = {(i, j): (lag[i, j], rho[i, j], n[i, j]) for i, j in zip(*np.nonzero((n > 0) & (np.abs(rho) >= critical[n])))}
        parts = list(SP.exceeding(SP.side(a, np.arange(140)), SP.side(b, np.arange(140)), lags, 5, critical))
        got = {(i, j): rest for part in parts for i, j, *rest in zip(*part)}
        assert len(got) == sum(len(part[0]) for part in parts) == len(expected) > 50
        assert all(expected[at] == tuple(rest) for at, rest in got.items())
    assert [sum(many) > 0 for many in ways.values()] == {1: [True, False, False], 8: [True, True, True], 1000: [False, False, True]}[large]


def test_series_with_gaps_of_their_own_are_ranked_together(monkeypatch):
    rnd = np.random.default_rng(3)
    x = rnd.random((600, 16))
    x[rnd.random(x.shape) < 0.4] = np.nan
    calls, ranked = [], SP._ranked
    monkeypatch.setattr(SP, "_ranked", lambda *a: calls.append(1) or ranked(*a))
    critical = np.array([np.inf, *(rho_critical(n) for n in range(1, 17))])
    assert len({row.tobytes() for row in np.isnan(x)}) > 590
    assert sum(len(found[0]) for found in SP.exceeding(SP.side(x, np.arange(600)), SP.side(x, np.arange(600)), [-1, 0, 1], 5, critical)) > 600
    assert len(calls) < 500  # one by one, 360,000 pairs


def test_blocks_of_names_and_batches_keep_all_pairs_of_series(spark, monkeypatch):
    """Series up to 64 buckets and wider ones, in one block and several, give the same pairs."""
    rnd = np.random.default_rng(11)
    data = [(f"s{k % 7}{k}", b, float(v)) for k, row in enumerate(some_series(rnd, True)) for b, v in enumerate(np.cumsum(row) if k % 9 == 0 else row) if v == v]
    df = spark.createDataFrame(data, "s string, b int, v double")
    pairs = lambda **more: sorted(map(tuple, SP.correlated_pairs(df, "s", "b", "v", [-1, 0, 2], **more).collect()))
    got = pairs()
    assert len(got) > 100 and any(r[5] for r in got) and all(r[0] < r[1] for r in got) and len({r[:2] for r in got}) == len(got)
    monkeypatch.setattr(SP, "SENT", 10)
    assert pairs(block=30) == got
    monkeypatch.setattr(SP, "COMPARED", 0)
    assert pairs(block=50) == got


def test_reaching_along_a_row_of_cycles_takes_few_rounds(spark, monkeypatch):
    """Each ring of three leads to the next; a round for each ring would be 60 of them."""
    n, cuts, cut = 600, [], G.cut
    edges = [(k, k + 2) for k in range(0, n - 2, 2)] + [(k, k - 4) for k in range(6, n, 10)]
    monkeypatch.setattr(G, "cut", lambda df: cuts.append(1) or cut(df))
    assert G.creates_cycle(spark.createDataFrame(edges, "src long, dst long"), n - 2, 8)
    assert len(cuts) <= 60


def test_partitions_grow_with_the_rows(spark):
    dealt = by_rows(spark.range(1000), "id", rows=100)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 1000


def test_dominators_send_no_table_through_the_driver(spark, monkeypatch):
    """Small files hold many numbers in a row: their size is no reason to broadcast them."""
    plans, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    nodes = spark.range(1, 200).withColumnRenamed("id", "node")
    edges = nodes.where("node > 1").selectExpr("node div 2 as src", "node as dst").unionAll(spark.createDataFrame([(2, 7), (3, 8), (8, 2)], "src long, dst long"))
    got = {r.node: r.dominators for r in G.dominators(nodes, edges, 1).collect()}
    assert got[199] == [1, 3, 6, 12, 24, 49, 99, 199] and got[7] == [1, 7] and got[8] == [1, 8] and got[35] == [1, 8, 17, 35] and len(got) == 199
    assert plans and not any("Broadcast" in p for p in plans)

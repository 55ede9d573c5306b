"""Vector cells, attribute paths, shapes, criticality, table functions and keyed state in their corner cases."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import payloads as P, text as T
from tidewright.operators import aggregates as A, graph as G, series_pairs as SP, shapes as SH, vectors as V
from tidewright.streaming import signals as SG, states as ST


def clustered(n, width=8, middles=6, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(middles, width))
    return [(k, (centre[k % middles] + 0.2 * rng.normal(size=width)).tolist()) for k in range(n)]


def plain_nearest(rows, queries, k):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    return {q: [i for _, _, i in sorted((-round(float(unit(x) @ unit(v)), 9), str(i), i) for i, x in rows)[:k]] for q, v in queries}


def nearest(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_cells_and_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 40)  # many shards a cell
    rows = [*clustered(400), (900, [0.0] * 8), (901, clustered(1)[0][1])]
    v = spark.createDataFrame([*rows, (950, None)], "vec_id long, embedding array<double>").repartition(5)
    some = [(q, x) for q, x in rows if q % 20 == 0]
    queries = spark.createDataFrame([*some, (7777, None)], "query_id long, query array<double>")
    want = plain_nearest(rows, some, 5)
    exact = V.search_exact(v, queries, 5)
    assert nearest(exact) == want
    centroids = V.fit_cells(v, 6)
    indexed = V.with_cells(v, centroids, "embedding")
    assert indexed.count() == len(rows) and nearest(V.search_cells(indexed, centroids, queries, 5, 6)) == want
    assert V.recall(V.search_cells(indexed, centroids, queries, 5, 2), exact) >= 0.9
    assert V.search_exact(v, queries.where("query_id < 0"), 5).count() == V.search_exact(v.where("vec_id < 0"), queries, 5).count() == 0
    with pytest.raises(Exception, match="different length"):
        V.search_exact(v.unionAll(spark.createDataFrame([(1000, [1.0])], v.schema)), queries, 5).count()


def test_attribute_paths(spark):
    row = spark.createDataFrame([('{"a": {"b": [1, {"c": "x"}], "n": null, "0": "key"}, "s": "t"}',)], "t string").select(F.parse_json("t").alias("d"))
    get = lambda path: tuple(row.select(P.is_missing(P.resolved(F.col("d"), path)), F.try_variant_get(P.resolved(F.col("d"), path), "$", "string")).first())
    assert get("a.b.0") == (False, "1") and get("a.b.1.c") == (False, "x") and get("a.0") == (False, "key")
    assert get("a.n") == (False, None) and get("a.missing") == (True, None) and get("a.b.2") == (True, None) and get("s.x") == (True, None) and get("a.b.c") == (True, None)
    for bad in ("", "a..b", "a b", "a." * 8 + "a", "a.-1"):
        with pytest.raises(ValueError):
            P.path_segments(bad)


def test_shapes(spark):
    rnd = random.Random(1)
    noise = lambda: rnd.uniform(-0.3, 0.3)
    made = {"spike": lambda k: 20 * (k == 13), "step": lambda k: 5 * (k >= 18), "drift": lambda k: 0.4 * k, "steady": lambda k: 0.0}
    data = [(name, k, f(k) + noise()) for name, f in made.items() for k in range(30)] + [("flat", k, 2.0) for k in range(9)] + [("few", k, float(k)) for k in range(4)] + [("drift", 99, None)]
    got = {r.s: (r.shape, r["at"]) for r in SH.shapes(spark.createDataFrame(data, "s string, k int, v double"), ["s"], "k", "v").collect()}
    assert got == {"spike": ("spike", 13), "step": ("step", 18), "drift": ("drift", None), "steady": ("steady", None), "flat": ("steady", None), "few": (None, None)}


def test_distributions_and_criticality(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 1)], "x string, y int")
    got = {(r.dimension, r.value): r.n for r in A.distributions(df, {"x": F.col("x"), "y": F.col("y")}).collect()}
    assert got == {("x", "a"): 2, ("x", "b"): 1, ("y", "1"): 2, ("y", None): 1, (None, None): 3}
    nodes = spark.createDataFrame([(k,) for k in "abcde"], "node string")
    edges = spark.createDataFrame([("a", "d"), ("b", "d"), ("c", "d"), ("d", "a")], "src string, dst string")
    scores = {r.node: r.score for r in G.criticality(nodes, edges).collect()}
    assert max(scores, key=scores.get) == "d" and scores["b"] == scores["c"] == pytest.approx(0.15) and scores["e"] == pytest.approx(1.0)
    row = G.graph_statistics(nodes, edges, spark.createDataFrame([("e", 100.0)], "node string, weight double"), top=2).first()
    assert (row.node_count, row.orphan_count, row.relationship_count, row.components, row.critical_assets[0], row.max_degree) == (5, 1, 4, 2, "e", 4)


def test_chunk_table_function(spark, sf_dir):
    docs = spark.createDataFrame([(1, "One. Two! " * 40), (2, ""), (3, None), (4, "x" * 95)], "id int, text string")
    rows = docs.lateralJoin(T.ChunkText(F.col("text").outer(), F.lit(50), F.lit(10))).collect()
    arrays = docs.select("id", F.explode(T.chunked(F.col("text"), 50, 10)).alias("c")).select("id", "c.*").collect()
    key = lambda r: (r.id, r.sequence, r.content, r.start_at, r.end_at)
    assert sorted(map(key, rows)) == sorted(map(key, arrays)) and {r.id for r in rows} == {1, 4}


# --- keyed state


def fed(spark, tmp_path, batches, schema, run):
    """Batches one after the other, the stream restarted for each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        SG.drain(run(stream), f"{tmp_path}/state", lambda batch, number: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}"))
    return spark.read.parquet(f"{tmp_path}/out").collect()


T0 = datetime(2024, 1, 1)
at = lambda minutes: T0 + timedelta(minutes=minutes)


def test_incidents_close_reopen_and_are_forgotten(spark, tmp_path):
    batches = [
        [("f", at(0), None), ("f", at(10), None), (None, at(1), None), ("f", None, None)],
        [("f", at(20), "resolved"), ("f", at(21), None), ("f", at(22), "cancelled"), ("f", at(23), "investigating"), ("g", at(24), "resolved")],
        [("f", at(30), None), ("f", at(46), None)],
        [("f", at(5000), None)],
        [("f", at(5010), None)],
    ]
    rows = fed(spark, tmp_path, batches, "k string, at timestamp, status string", lambda s: ST.incidents(s, "k", "at", "status", 900.0, keep_seconds=3600.0, watermark="1 minute"))
    got = sorted((round((r.t - T0.timestamp()) / 60) % 100_000, r.key, r.number, r.status, r.is_status) for r in rows)
    plain = [(0, "f", 1, "new", False), (1, None, 1, "new", False), (10, "f", 1, "new", False), (20, "f", 1, "resolved", True), (21, "f", 2, "new", False), (22, "f", 2, "cancelled", True), (23, "f", 2, "investigating", True), (30, "f", 2, "investigating", False), (46, "f", 3, "new", False)]
    assert got[:9] == sorted(plain, key=lambda r: (r[0], r[1] or ""))
    # the timer fires after the batch that moves the watermark on; the numbers begin again after it
    assert [r[2] for r in got[9:]] in ([1, 1], [4, 1], [4, 4], [1, 2])


def test_sliding_limit_across_batches(spark, tmp_path):
    rnd = random.Random(2)
    times = sorted(rnd.uniform(0, 600) for _ in range(120))
    rows = [(rnd.choice(["a", "b", None]), at(t)) for t in times]
    got = fed(spark, tmp_path, [rows[:50], rows[50:51], rows[51:]], "k string, at timestamp", lambda s: ST.sliding_limited(s, "k", "at", 4, 3600.0))
    want, kept = [], {}
    for k, t in rows:
        mine = kept[k] = [x for x in kept.get(k, []) if (t - x).total_seconds() < 3600]
        allowed = len(mine) < 4
        if allowed:
            mine.append(t)
        want.append((k, round(t.timestamp(), 3), allowed, 4 - len(mine)))
    order = lambda r: (r[0] or "", *r[1:])
    assert sorted(((r.key, round(r.t, 3), r.allowed, r.remaining) for r in got), key=order) == sorted(want, key=order)


def plain_pairs(data, lags, least=5):
    series = {}
    for s, b, v in data:
        if v is not None:
            series.setdefault(s, {}).setdefault(b, []).append(v)
    series = {s: {b: sum(v) / len(v) for b, v in x.items()} for s, x in series.items()}

    def ranks(x):
        return [sum(y < v for y in x) + (sum(y == v for y in x) + 1) / 2 for v in x]

    def corr(x, y):
        return None if len(set(x)) < 2 or len(set(y)) < 2 else float(np.corrcoef(x, y)[0, 1])

    def steps(x):
        at = sorted(x)
        return {b: x[b] - x[a] for a, b in zip(at, at[1:])}

    def auto(x):
        at = sorted(x)
        r = corr([x[b] for b in at[1:]], [x[b] for b in at[:-1]]) if len(at) > 2 else None
        return r is not None and r > 0.5

    out = {}
    for a in series:
        for z in series:
            if a < z:
                d = auto(series[a]) or auto(series[z])
                x, y = (steps(series[k]) if d else series[k] for k in (a, z))
                best = None
                for lag in lags:
                    both = [b for b in x if b + lag in y]
                    r = corr(ranks([x[b] for b in both]), ranks([y[b + lag] for b in both])) if len(both) >= least else None
                    if r is not None:
                        key = (round(abs(r), 9), -abs(lag), -lag)
                        best = max(best, (key, lag, r, len(both))) if best else (key, lag, r, len(both))
                if best and abs(best[2]) >= max(0.5, min(1.0, 2.576 / (best[3] - 1) ** 0.5)) - 1e-9:
                    out[a, z] = (best[1], round(best[2], 6), best[3], d)
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_pairs_of_series_like_plain_lists(spark, block):
    rnd = random.Random(5)
    base = [rnd.random() for _ in range(40)]
    data = []
    for s in range(9):
        for b in range(3, 40):
            v = base[b - s % 3] + rnd.random() * 0.4 if s < 6 else b * 0.5 + rnd.random() if s == 6 else rnd.random()
            if s % 2 == 0 or rnd.random() < 0.8:
                data.append((f"s{s}", b, v))
    data += [("flat", b, 1.0) for b in range(20)] + [("few", 1, 2.0), ("s1", 3, None), ("s2", 5, 0.3)]
    df = spark.createDataFrame(data, "s string, b int, v double")
    lags = [-2, -1, 0, 1, 3]
    got = {(r["first"], r["second"]): (r.lag, round(r.rho, 6), r.n, r.differenced) for r in SP.correlated_pairs(df, "s", "b", "v", lags, block=block).collect()}
    assert got == plain_pairs(data, lags) and len(got) > 5
    assert {r.s: r.reason for r in SP.unmeasurable(df, "s", "b", "v").collect()} == {"flat": "constant", "few": "too_few_buckets"}
    assert SP.correlated_pairs(df.where("false"), "s", "b", "v", lags).count() == 0


def test_keys_of_a_group_are_kept_and_forgotten_one_by_one(spark, tmp_path, monkeypatch):
    """Calls to the state grow with the groups, not with the keys."""
    monkeypatch.setattr(ST, "GROUPS", 1)
    batches = [[("f", at(0), None), ("g", at(0), None), *((f"k{n}", at(0), None) for n in range(50))], [("g", at(50), None)], [("g", at(100), None)], [("g", at(150), None)], [("f", at(151), None), ("g", at(200), None)]]
    rows = fed(spark, tmp_path, batches, "k string, at timestamp, status string", lambda s: ST.incidents(s, "k", "at", "status", 900.0, keep_seconds=3600.0, watermark="1 minute"))
    got = {k: [r.number for r in sorted(rows, key=lambda r: r.t) if r.key == k] for k in {r.key for r in rows}}
    assert got == {"f": [1, 1], "g": [1, 2, 3, 4, 5]} | {f"k{n}": [1] for n in range(50)}
    groups = ST._grouped(spark.range(5000).selectExpr("cast(id as string) as key"))
    assert groups.select("group").distinct().count() == 1

"""Centroid clustering, source mixing and conversation repair against plain versions and their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import centroid_clustering as cc, conversation_repair as cr, queries, source_mixing as sm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sorted_rows(data):
    return sorted((tuple(r) for r in data), key=lambda r: [(x is not None, str(x)) for x in r])


def from_sql(name, folder, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    return [d[0] for d in cursor.description], cursor.fetchall()


def check_sql(spark, name, folder, table):
    names, want = from_sql(name, folder, table)
    got = queries.QUERIES[name](spark, str(folder)).select(*names).collect()
    assert sorted_rows(got) == sorted_rows(want)
    return got


# --- clustering


def plain_clusters(rows, k, rounds, width, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)[:k]
    centre = [x for _, x in first]
    for turn in range(rounds + 1):
        out = []
        for i, x in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(x, m)), c) for c, m in enumerate(centre))
            out.append((i, c, d))
        if turn < rounds:
            for c in range(len(centre)):
                mine = [x for (_, x), (_, at, _) in zip(kept, out) if at == c]
                if mine:
                    centre[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return out, centre


def vectors(seed, n, width, spread, ties):
    rnd = random.Random(seed)
    middles = [[rnd.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    rows = [(k, [x + rnd.gauss(0, spread) for x in rnd.choice(middles)]) for k in range(n)]
    if ties:  # few values a component: many equal distances and repeated vectors
        rows = [(k, [round(x * 2) / 1024 for x in v]) for k, v in rows]
    rows += [(n, None), (n + 1, [0.5] * (width - 1)), (n + 2, [float("nan")] + [0.0] * (width - 1)), (n + 3, [float("-inf")] * width), (n + 4, [None] * width), (None, [0.25] * width), (None, [0.5] * width), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("seed", "k", "groups", "spread", "ties"), [(1, 8, None, 0.3, False), (3, 8, 3, 0.3, True), (4, 30, 30, 0.5, True)])
def test_clusters_like_plain_rounds(spark, seed, k, groups, spread, ties):
    width = 5
    rows = vectors(seed, 150, width, spread, ties)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, cluster string, distance int").repartition(3)
    # floats as the table holds them
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    found, centroids = cc.cluster_vectors(df, k=k, rounds=5, width=width, groups=groups)
    want, centre = plain_clusters(exact, k, 5, width)
    assert sorted_rows(found.select("vec_id", "cluster", "distance").collect()) == sorted_rows(want)
    assert centroids.tolist() == centre


def test_filters_save_distances_and_keep_clusters():
    rng = np.random.default_rng(3)
    middles = rng.integers(-4000, 4000, (40, 16))
    x = np.concatenate([m + rng.integers(-150, 150, (50, 16)) for m in middles])
    centroids = x[rng.choice(len(x), 40, replace=False)].copy()
    group = cc.grouped(centroids, 4)
    cluster, _, upper, lower = cc.first_scan(x, centroids, group)
    measured = 0
    for _ in range(8):
        moved = np.array([x[cluster == c].sum(0) // max(1, (cluster == c).sum()) if (cluster == c).any() else centroids[c] for c in range(40)])
        drift, centroids = cc.above(cc.squared(moved, centroids)), moved
        cluster, upper, lower, n = cc.next_scan(x, cluster, upper, lower, centroids, drift, group)
        measured += n
        assert (cluster == ((x[:, None] - centroids[None]) ** 2).sum(2).argmin(1)).all()
        exact = np.sqrt(((x[:, None] - centroids[None]) ** 2).sum(2))
        assert (exact[np.arange(len(x)), cluster] <= upper).all()
        for g in range(4):
            others = np.where((group == g)[None] & (np.arange(40)[None] != cluster[:, None]), exact, np.inf)
            assert (lower[:, g] <= others.min(1)).all()
    assert measured < 0.5 * 8 * len(x) * 40


def test_clustering_query_and_edges(spark, sf_dir, tmp_path):
    rows = vectors(9, 60, 64, 0.3, False)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k, some in enumerate((df, df.where("vec_id < 3"), df.where("false"))):
        some.write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        got = check_sql(spark, "op11_centroid_clustering", f"{tmp_path}/{k}", "embeddings")
        assert len(got) == (64, 5, 0)[k]
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").write.parquet(f"{tmp_path}/all/embeddings.parquet")
    check_sql(spark, "op11_centroid_clustering", f"{tmp_path}/all", "embeddings")
    with pytest.raises(Exception, match="beyond"):
        cc.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


# --- mixing


def test_permutations(spark):
    for n in (1, 2, 3, 5, 64, 777):
        for name in (0, 1, 9):
            tag, size = F.lit(name).cast("long"), F.lit(n).cast("long")
            rows = spark.range(n).withColumn("at", sm.shuffled(F.col("id"), size, sm.keys(tag))).withColumn("back", sm.shuffled(F.col("at"), size, sm.keys(tag), True)).collect()
            assert sorted(r["at"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)
    far = (1 << 33) + 7
    rows = spark.range(far - 50, far).withColumn("at", sm.shuffled(F.col("id"), F.lit(far), sm.keys(F.lit(2).cast("long")))).withColumn("back", sm.shuffled(F.col("at"), F.lit(far), sm.keys(F.lit(2).cast("long")), True)).collect()
    assert all(r["back"] == r["id"] for r in rows) and len({r["at"] for r in rows}) == 50


def filled(sizes, weights=(5, 2, 1), limit=3):
    """Targets by the rule's own words: stop what is above, share the rest again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        share = {s: weight[s] * rest / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > limit * sizes[s]}
        if not above:
            return {s: limit * sizes[s] if s in stopped else share[s] for s in names}
        stopped |= above


def check_mix(df, **options):
    rows = df.select("doc_id", "source", "text").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    found, places, sources = sm.mix(df, **options)
    got = sm.digest(found, places, sources).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows)
    target = filled(sizes)
    taken = Counter()
    named = {r.src: r.source for r in sources.collect()}
    for r in found.groupBy("src").agg(F.sum("length").alias("n")).collect():
        taken[named[r.src]] = r.n
    for s, want in target.items():
        assert taken[s] == math.floor(want + 0.5) or abs(taken[s] - want) <= 0.5 + 1e-6
        mine = [r for r in sources.collect() if r.source == s]
        assert len(mine) == 1 and mine[0].target == pytest.approx(want, rel=1e-12)
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert sum(r.taken for r in got) == sum(taken.values())
    return found, places, sources, got


def test_mix_meets_targets(spark, docs, odd, none, tmp_path):
    small = spark.createDataFrame([(1, "a b c", "x"), (2, "d", "y"), (3, " ".join(map(str, range(1000))), "z"), (4, None, None), (5, "", "w"), (6, "q " * 700, None)], "doc_id long, text string, source string")
    blank = spark.createDataFrame([(1, None, "x"), (2, " ", None)], "doc_id long, text string, source string")
    for k, df in enumerate((docs, odd, small, blank, none.select("doc_id", "text", "source"))):
        *_, got = check_mix(df)
        if k < 2:
            check_mix(df, block=7, shard=16)
        again = sm.digest(*sm.mix(df.repartition(5, F.rand(k)))).collect()
        assert sorted_rows(again) == sorted_rows(got)
        df.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        check_sql(spark, "op12_source_mixing", f"{tmp_path}/{k}", "documents")


def test_shards_are_drawn_by_weight(spark, docs):
    found, _, sources = sm.mix(docs, block=8, shard=512)
    slots = found.select("shard", "slot", "src").distinct()
    counts = {(r.shard, r.src): r.n for r in sm.shard_counts(slots).collect()}
    want = {r.src: r.slots for r in sources.collect()}
    total = sum(want.values())
    assert {k: sum(n for (_, s), n in counts.items() if s == k) for k in want} == want
    whole = [h for h in {h for h, _ in counts} if sum(n for (x, _), n in counts.items() if x == h) == 512]
    chi = [sum((counts.get((h, s), 0) - 512 * n / total) ** 2 / (512 * n / total) for s, n in want.items()) for h in whole]
    # 19 degrees of freedom a shard; neither far too even nor far too uneven
    assert len(whole) > 10 and 15 < sum(chi) / len(chi) < 23


def test_mix_texts(spark, docs):
    found, _, sources = sm.mix(docs, block=50)
    got = sm.texts(docs, found, sources)
    rows = got.collect()
    words = found.groupBy("slot").agg(F.sum("length").alias("n")).collect()
    assert {r.slot: len(WORD.findall(r.text)) for r in rows} == {r.slot: r.n for r in words}
    texts = {r.doc_id: WORD.findall(r.text or "") for r in docs.collect()}
    some = found.where("shard = 0").orderBy("slot", "at").collect()
    by_slot = {}
    for r in some:
        by_slot.setdefault(r.slot, []).extend(texts[r.doc_id][r["skip"] : r["skip"] + r["length"]])
    assert {r.slot: r.text for r in rows if r.shard == 0} == {k: " ".join(v) for k, v in by_slot.items()}


# --- repair


def plain_repair(rows):
    """Every way of editing a short conversation, by recursion over all states and rows."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @cache
    def best(i, state, inserts):
        ways = [(0, "")] if i == len(rows) and state in (0, 3) else []

        def add(cost, letter, j, to, left=2):
            if to is not None and (rest := best(j, to, left)) is not None:
                ways.append((cost + rest[0], letter + rest[1]))

        if inserts:
            for role in "ua":
                add(3, "I", i, after.get((state, role)), inserts - 1)
        if i < len(rows):
            add(4, "D", i + 1, state)
            if rows[i] != "-":
                charge = 3 if rows[i].isupper() else 0
                add(charge, "K", i + 1, after.get((state, rows[i].lower())))
                for role in "ua":
                    add(charge + 3, "R", i + 1, after.get((state, role)))
        return min(ways) if ways else None

    return best(0, 0, 2)


def test_search_like_every_way():
    rnd = random.Random(8)
    for _ in range(600):
        rows = "".join(rnd.choice("suaxSUAX-") for _ in range(rnd.randint(0, 9)))
        want = plain_repair(rows)
        assert cr.short_repair(rows) == want, rows
        for chunk in (1, 2, 4):
            assert cr.repair(rows, chunk) == want, (rows, chunk)


def test_long_conversations():
    rnd = random.Random(4)
    rows = "".join(rnd.choice("uauaua-xUA") for _ in range(5000))
    assert cr.repair(rows) == cr.repair(rows, 700)
    assert cr.repair("ua" * 20_000) == (0, "K" * 40_000)


def plain_digest(turns):
    """The contract's rows, from lists."""
    solid = re.compile(r"[^\x20\x09-\x0D]")
    convs = {}
    for conv, turn, role, text in turns:
        convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, letters, faults = set(), "", Counter()
        for _, role, text in rows:
            found = solid.findall(text)
            fault = "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "none"
            seen.add((role, text))
            faults[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters += "-" if fault in ("blank", "duplicate") else letter.upper() if fault == "truncated" else letter
        cost, audit = cr.repair(letters) if len(letters) > 12 else plain_repair(letters)
        known = [t for t, *_ in rows if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        text = "\n".join(f"{r}:{t}" for r, t, _ in cr.edited(audit, iter([r[1:] for r in rows])))
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, faults["blank"], faults["duplicate"], faults["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


CONV = "conv_id long, turn long, role string, text string, head int, audit string"


def odd_turns():
    rnd = random.Random(6)
    rows = []
    for conv in (*range(80), None):
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant", "system", "tool", None, "", "User"]) if rnd.random() < 0.4 else ("assistant" if turn % 2 else "user")
            text = rnd.choice(["Well done.", "No end", "", " \t\r\n", "Why? \x0b\x0c ", None, "été…", "same.", "x" * 5000 + "!"])
            rows.append((conv, None if rnd.random() < 0.1 else turn * rnd.choice([1, 1, 2]), role, text, 1, "z"))
    rows += [rows[0], rows[0], rows[7]]
    rows += [(500, t, "assistant" if t % 2 else "user", f"row {t}" + "." * (t % 3 > 0), 0, "") for t in range(900)]
    dropped = next(k for k in range(1000, 9000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    return rows + [(dropped, 1, "user", "gone.", 0, "")], dropped


def test_digest_like_lists_and_sql(spark, sf_dir, tmp_path):
    rows, dropped = odd_turns()
    df = spark.createDataFrame(rows, CONV).repartition(3)
    got = [tuple(r) for r in cr.digest(df).collect()]
    assert sorted_rows(got) == sorted_rows(plain_digest([r[:4] for r in rows]))
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got
    for k, some in enumerate((df.where("conv_id <> 500 or conv_id is null"), spark.read.parquet(f"{sf_dir}/conversations.parquet"), df.where("false"))):
        some.write.parquet(f"{tmp_path}/{k}/conversations.parquet")
        check_sql(spark, "op13_conversation_repair", f"{tmp_path}/{k}", "conversations")


def test_repaired_rows_are_legal_and_hash_alike(spark):
    rows = cr.damaged(spark.createDataFrame(odd_turns()[0], CONV))
    found = cr.audits(rows)
    out = {}
    for r in cr.repaired(rows, found).orderBy("conv_id", "place").collect():
        out.setdefault(r.conv_id, []).append(r)
    hashes = {r.conv_id: r.repaired_sha256 for r in cr.hashes(rows, found).collect()}
    audits = {r.conv_id: r.audit for r in found.collect()}
    assert set(hashes) == set(audits)
    for conv, audit in audits.items():
        mine = out.get(conv, [])
        assert [r.place for r in mine] == list(range(len(mine)))
        assert "".join(r.edit for r in mine) == audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in mine))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == hashes[conv]

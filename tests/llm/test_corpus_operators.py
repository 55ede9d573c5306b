"""Operators over the corpus: quality rules, SimHash, packing, LM scoring and the pipeline."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
import zlib

from tidewright.llm import lm_score, packing, quality_rules, queries, simhash_dedup
from tidewright.llm.common import fold_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- quality rules


def counts_by_hand(text):
    text = text or ""
    words, lines, seen, dup = WORD.findall(text), text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    again = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), len(words) < 20 or 100 * len(again) > 30 * len(words)


def test_counts_match_brute_force(spark, odd, docs, none):
    extra = spark.createDataFrame([(1, "a b\na b\n\n \n#$%\n#$%\na b", "en", "s"), (2, "w " * 50, "en", "s"), (3, " ".join(map(str, range(60))) + " " + " ".join(map(str, range(20))), None, None)], "doc_id long, text string, lang string, source string")
    for df in (odd, docs, extra):
        want = Counter((r.doc_id, *counts_by_hand(r.text)) for r in df.select("doc_id", "text").collect())
        rows = quality_rules.outliers(df).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
        assert not any(r.kept and r.base_failed for r in rows)
    assert quality_rules.outliers(none).count() == 0


def test_outliers_go_and_clean_rows_stay(spark):
    import random

    rnd = random.Random(2)
    plain = [(k, " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(60, 300))), "en" if k % 2 else None, "s") for k in range(1200)]
    junk = [(5000 + k, " ".join("#$%&|<>*" * 4 + str(i * k) for i in range(100)), "en", "s") for k in range(1, 100)]
    rows = {r.doc_id: r.kept for r in quality_rules.outliers(spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(rows[k] for k, *_ in plain) >= 1195 and not any(rows[k] for k, *_ in junk)


@pytest.mark.parametrize("kind", ["lines", "symbols", "width"])
@pytest.mark.parametrize("share", [20, 450])
def test_each_statistic_can_reject(spark, kind, share):
    """Every second line the same, two symbols a word, or words of double length, as single rows and as three tenths of the group."""
    import random

    rnd = random.Random(7)
    word = lambda a, b: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(a, b)))

    def text(kind):
        lines = []
        for _ in range(rnd.randint(8, 30)):
            lines.append(" ".join(word(4, 16) if kind == "width" else word(2, 8) + ("#$" if kind == "symbols" else "") for _ in range(10)))
            lines += ["read more"] if kind == "lines" else []
        return "\n".join(lines)

    rows = [(k, text(""), "en", "s") for k in range(1000)] + [(5000 + k, text(kind), "en", "s") for k in range(share)]
    kept = {r.doc_id: r.kept for r in quality_rules.outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(kept[k] for k in range(1000)) >= 990 and sum(kept[5000 + k] for k in range(share)) <= 0.05 * share


def test_chi_squared_quantiles():
    assert abs(quality_rules.quantile(0.999) - 20.515) < 1e-3 and abs(quality_rules.quantile(0.975) - 12.833) < 1e-3 and abs(quality_rules.quantile(0.5) - 4.351) < 1e-3
    rng = np.random.default_rng(3)
    d = np.sort((rng.normal(size=(200_000, 5)) ** 2).sum(axis=1))
    for share in (0.5, 0.75, 0.975):
        inside = d[: int(share * len(d))]
        assert abs(5 / inside.mean() - quality_rules.consistency(share)) < 0.02


def test_concentration_matches_numpy(spark):
    """The location of the tightest share of one group, as plain concentration steps over all rows find it."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, quality_rules.DIM))
    x[:60] += 12
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{n} double" for n in quality_rules.NAMES))
    model = quality_rules.estimates(quality_rules.moments(rows), 1.0).first()
    cov = np.cov(x.T, bias=True)
    cov[np.diag_indices(quality_rules.DIM)] += quality_rules.FLOOR**2
    assert np.allclose([model[f"m{i}"] for i in range(quality_rules.DIM)], x.mean(axis=0))
    assert np.allclose(model["i0_1"], np.linalg.inv(cov)[0, 1])


# --- SimHash


def fingerprint_by_hand(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(rows):
    """(doc_id, fingerprint) -> smallest id reachable; all pairs."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return [least.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("sliced", [512, 2])
def test_components_match_brute_force(odd, docs, none, sliced):
    for df in (odd, docs):
        data = [(r.doc_id, fingerprint_by_hand(r.text)) for r in df.select("doc_id", "text").collect()]
        want = Counter((a, f"{fp:016x}", c) for (a, fp), c in zip(data, components_by_hand(data)))
        assert Counter(tuple(r) for r in simhash_dedup.digest(simhash_dedup.link_components(df, sliced=sliced)).collect()) == want
    assert simhash_dedup.link_components(none, sliced=sliced).count() == 0


@pytest.mark.parametrize("sliced", [512, 3])
def test_chains_of_links_match_brute_force(spark, sliced):
    rng = np.random.default_rng(6)
    fps, now = [], 0
    for k in range(260):
        if k % 40 == 0:
            now = int(rng.integers(0, 1 << 63))
        now ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
        fps.append(now)
    ids = [int(x) for x in rng.permutation(len(fps))]
    nodes = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp, i) for fp, i in zip(fps, ids)], "fp long, rep long")
    roots = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.edges_of(nodes, sliced)).collect()}
    assert [roots.get(i, i) for i in ids] == components_by_hand(list(zip(ids, fps)))


def test_sliced_links_find_every_pair():
    rng = np.random.default_rng(8)
    fps = np.array([int(x) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for x in rng.choice(rng.integers(0, 1 << 62, 20), 200)], np.uint64)
    for radius in (0, 1, 2):
        pairs = {(i, j) for i in range(200) for j in range(i + 1, 200) if int(fps[i] ^ fps[j]).bit_count() <= radius}
        found = set(simhash_dedup.sliced_links(fps, radius))
        assert found <= pairs
        join = lambda links: components_of(200, links)
        assert join(found) == join(pairs)


def components_of(n, links):
    root = list(range(n))
    for i, j in sorted(links):
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def kept_by_hand(rows):
    """The (doc_id, text) that stay, from all pairs: of each component the smallest id (null last), then the smallest signed fingerprint."""
    prints = [(a, fingerprint_by_hand(t)) for a, t in rows]
    # components by row numbers, so that rows without id have one too
    of = components_by_hand([(k, fp) for k, (_, fp) in enumerate(prints)])
    best = {}
    for (a, fp), c in zip(prints, of):
        key = (a is None, a or 0, fp - (1 << 64) if fp >> 63 else fp)
        best[c] = min(key, best.get(c, key))
    return sorted((a is None, a or 0, fp) for a, fp in {(None if k[0] else k[1], k[2] % (1 << 64)) for k in best.values()})


@pytest.mark.parametrize("sliced", [512, 2])
def test_one_of_each_group_stays(odd, none, sliced):
    out = simhash_dedup.without_copies(odd, sliced=sliced)
    assert out.columns == odd.columns
    rows = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, fingerprint_by_hand(r.text)) for r in rows) == kept_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    assert {tuple(r) for r in rows} <= {tuple(r) for r in odd.collect()}
    assert simhash_dedup.without_copies(none).count() == 0


def test_texts_that_share_an_id_are_kept_apart(spark):
    a, b = " ".join(f"alpha{k}" for k in range(40)), " ".join(f"beta{k}" for k in range(40))
    rows = [(5, a, "x"), (5, b, "y"), (3, a, "z"), (None, b, "w"), (None, "lone text of a row without id", "v"), (None, "lone text of a row without id", "u"), (7, None, "t"), (7, None, "t"), (7, "", "s")]
    out = simhash_dedup.without_copies(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == [(False, 3, a), (False, 5, b), (False, 7, ""), (True, 0, "lone text of a row without id")]


def test_small_buckets_together_find_every_pair():
    rng = np.random.default_rng(12)
    sizes = rng.integers(1, 14, 300)
    keys = np.repeat(np.arange(300), sizes)
    seeds = rng.integers(0, 1 << 62, 300)
    fps = np.array([int(seeds[k]) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 4), replace=False)) for k in keys], np.uint64)
    for radius in (0, 1, 2, 3):
        i, j = simhash_dedup.bucket_links(keys, fps, radius)
        pairs = {(a, b) for a in range(len(keys)) for b in range(a + 1, min(len(keys), a + 14)) if keys[a] == keys[b] and int(fps[a] ^ fps[b]).bit_count() <= radius}
        found = set(zip(i.tolist(), j.tolist()))
        assert found <= pairs and components_of(len(keys), found) == components_of(len(keys), pairs)


# --- packing


def test_pieces_are_those_of_the_library(odd, docs, none):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df, window, group in ((odd, 4096, 8_000_000), (odd, 64, 2_000), (docs, 4096, 100_000)):
        rows = packing.pack(df, path, window=window, group_tokens=group).collect()
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
            for k in range(0, len(ids), window):
                piece = np.array(ids[k : k + window], "<u4").tobytes()
                want[r.doc_id, k, len(piece) // 4, zlib.crc32(piece), len(ids)] += 1
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for of in places.values():
            at = 0
            for offset, length in sorted(of):
                assert offset == at
                at += length
            assert at <= window
        total = sum(r.length for r in rows)
        groups = -(-total // group)
        assert len(places) <= total / window * 1.02 + 2 * groups
    assert packing.pack(none, path).count() == 0


def test_equal_rows_are_dealt_to_all_groups(spark):
    rows = spark.createDataFrame([(None, "the same text again and again")] * 4000, "doc_id long, text string").repartition(4)
    placed = packing.pack(rows, queries.vocabulary("word_bpe_49k.json"), window=64, group_tokens=2_000).collect()
    groups = -(-sum(r.length for r in placed) // 2_000)
    sizes = Counter(r.sequence_id % groups for r in placed)
    assert len(sizes) == groups and max(sizes.values()) < 2 * len(placed) / groups


def test_words_of_awkward_texts_encode_like_the_library():
    import random

    enc, rnd = packing.encoder(queries.vocabulary("word_bpe_49k.json")), random.Random(1)
    parts = ["a", "The", " ", "  ", "\n", ".", ",", "...", "'s", "it's", "é", "é", "̸", "你", "\U0001f600", "<|endoftext|>", "\t", "0", "12", "don't", " ", "\x0b", " ", "İ", "ǅ", "-", "</w>", "\x85"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert enc.encode(text) == enc._whole(text), repr(text)


def test_best_fit_is_the_plain_rule():
    import random

    rnd = random.Random(3)
    for _ in range(40):
        window = rnd.randint(4, 60)
        lengths = sorted((rnd.randint(1, window) for _ in range(rnd.randint(0, 80))), reverse=True)
        number, offset = packing.best_fit(lengths, window)
        rooms = []
        for n, at, start in zip(lengths, number, offset):
            fitting = [r for r in rooms if r >= n]
            if fitting:
                assert rooms[at] == min(fitting)
            else:
                rooms.append(window)
                assert at == len(rooms) - 1
            assert start == window - rooms[at]
            rooms[at] -= n


# --- LM scoring


def scores_by_hand(rows):
    """Counts in dictionaries; only the mixture's fit is the operator's own function."""
    texts = [(i, [*WORD.findall(lower(t)), "\n"]) for i, t in rows]

    def count(keep):
        one, two = Counter(), Counter()
        for i, words in texts:
            if keep(fold_of(i, 5)):
                one.update(words)
                two.update(zip(["\n", *words], words))
        return one, two

    one, two = count(lambda f: f not in (0, 1))
    n, v, histogram = sum(one.values()), len(one), Counter()
    grain = lambda p: int(np.rint(-math.log2(p) * 4)) if p > 0 else -1
    for i, words in texts:
        if fold_of(i, 5) == 0:
            for a, b in zip(["\n", *words], words):
                histogram[int(lm_score.bucket_of(np.array([one[a]]))[0]), grain(two[a, b] / max(1, one[a])), grain(one[b] / max(1, n))] += 1
    weights = lm_score.learn_weights(sorted((*k, x) for k, x in histogram.items()), 1 / (v + 1))
    one, two = count(lambda f: f != 1)
    n, v, out = sum(one.values()), len(one), []
    for i, words in texts:
        score = 0.0
        # a training document doesn't know itself
        own, own_two = (Counter(words), Counter(zip(["\n", *words], words))) if fold_of(i, 5) != 1 else (Counter(), Counter())
        for a, b in zip(["\n", *words], words):
            c = one[a] - own[a]
            w = weights[int(lm_score.bucket_of(np.array([c]))[0])]
            score += math.log10(w[0] * (two[a, b] - own_two[a, b]) / max(1, c) + w[1] * (one[b] - own[b]) / max(1, n - own.total()) + w[2] / (v + 1))
        out.append((i, fold_of(i, 5) == 1, len(words), sum(one[x] > 0 for x in words), n, sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in words), score))
    return out


@pytest.mark.parametrize(("block", "part", "places"), [(2_000_000, 4_000_000, 4096), (500, 300, 4096), (500, 300, 3)])
def test_scores_match_brute_force(odd, docs, none, block, part, places, monkeypatch):
    monkeypatch.setattr(lm_score, "MAX_PLACES", places)
    for df in (odd, docs.where("doc_id < 60")):
        order = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
        want = sorted(scores_by_hand([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]), key=order)
        got = sorted((tuple(r) for r in lm_score.score_documents(df, block, part).collect()), key=order)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    assert lm_score.score_documents(none, block, part).count() == 0


def test_the_model_beats_the_base_on_held_out_rows(spark):
    rows = [r for r in queries.op9_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_each_slot_has_a_partition_of_its_own(spark, n):
    from pyspark.sql import functions as F

    keys = lm_score.slots(spark, n)
    got = spark.createDataFrame([(k,) for k in keys], "key long").repartition(n, "key").select(F.spark_partition_id().alias("p")).collect()
    assert len(set(keys)) == n and len({r.p for r in got}) == n


def test_numbers_come_back():
    rng = np.random.default_rng(2)
    for x in (np.empty(0, "<u8"), np.zeros(5, "<u8"), rng.integers(0, 1 << 63, 1000).astype("<u8"), np.array([1, 255, 256, 70_000], "<u8"), np.array([(1 << 64) - 1, 0], "<u8")):
        assert (lm_score.numbers(lm_score.squeezed(x)) == x).all() and (lm_score.numbers(lm_score.squeezed(x, 5)) == x).all()
        assert (lm_score.keys_of(lm_score.squeezed_keys(np.sort(x))) == np.sort(x)).all()


def test_texts_that_occur_again_stand_out(spark):
    rows = queries.op9_lm_score(spark, "/root/testdata/sf0.01").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    often = Counter(text[r.doc_id] for r in rows if not r.held_out)  # copies that training has
    mean = {k: [r.score / r.n_tokens for r in rows if 50 < r.n_tokens < 1000 and not r.held_out and (often[text[r.doc_id]] > 1) == k] for k in (True, False)}
    edge = np.quantile(mean[False], 0.95)
    assert len(mean[True]) > 10 and np.mean(np.array(mean[True]) > edge) > 0.7


def test_weights_are_shares():
    w = lm_score.learn_weights([(3, 4, 8, 10), (3, -1, 20, 5), (0, -1, 12, 2)], 1e-4)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and w[0, 0] == 0


# --- the pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as C

    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in C.STAGES[:-1]:
        from tidewright.llm.common import written

        out = written(stage(spark, docs, sf_dir), "test-stage")
        assert out.columns == docs.columns
        seen.append((docs, out))
        docs = out
    ids = [({r.doc_id for r in a.collect()}, {r.doc_id for r in b.collect()}) for a, b in seen]
    assert all(b <= a for a, b in ids) and ids[3][0] == ids[3][1]
    data = [(r.doc_id, fingerprint_by_hand(r.text)) for r in seen[1][0].collect()]
    assert ids[1][1] == set(components_by_hand(data))
    bad = {r.doc_id for r in queries.op6_decontamination(spark, sf_dir).collect() if r.contaminated}
    assert ids[2][1] == ids[2][0] - bad
    packed = C.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids[3][1]


def test_pipeline_like_plain_python(spark, odd, odd_rows, none, tmp_path):
    """Every stage against a plain version: repeated ids with equal and other texts, null ids, clashing columns, an empty table."""
    from pyspark.sql import functions as F

    import corpus_pipeline as C
    from tidewright.llm import decontaminate, language_id, secret_scan
    from tidewright.llm.common import fold, written

    passage = "these thirteen words are one item of a test and must not be left anywhere"
    other = " ".join(f"word{k}" for k in range(400))
    more = [(5, f"{odd_rows[5][1]} and so on", None, "s", 1, "", 0, "", "", 0.0, ""), (5, odd_rows[7][1], "en", "s", 1, "", 0, "", "", 0.0, ""), (6000, passage, "en", "s", 1, "", 0, "", "", 0.0, ""), (6001, f"{other} {passage} {other}", "en", "s", 7, "", 0, "", "", 0.0, ""), (6002, f"{other} the token is qWeRtYuIoPaSdFgHjKlZ", "en", "s", 7, "", 0, "", "", 0.0, "")]
    docs = odd.unionAll(spark.createDataFrame(more, odd.schema)).repartition(3)
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = language_id.train(docs.where(fold(docs["doc_id"], 4) != 2))
    automaton, crf = decontaminate.Automaton([("1", decontaminate.words_of(passage))]), secret_scan.default_model()

    def plain(stage, rows):
        if stage == "language_id":
            found = [(r, language_id.judge(model, r.text)) for r in rows]
            return Counter((r.doc_id, r.text, r.lang or lang) for r, (lang, _, known) in found if lang != "und" and known >= model["bound"])
        if stage == "simhash_dedup":
            return kept_by_hand([(r.doc_id, r.text) for r in rows])
        if stage == "decontamination":
            spans = [(r, automaton.hits(decontaminate.words_of(r.text))[0]) for r in rows]
            return Counter((r.doc_id, decontaminate.clean_text(r.text, s)) for r, s in spans if not s or 20 * sum(b - a for a, b in s) < len(decontaminate.words_of(r.text)))
        return Counter((r.doc_id, secret_scan.masked(r.text, secret_scan.all_spans(r.text, crf), "[SECRET]")) for r in rows)

    for start in (docs, none):
        now = start
        for name, stage in C.STAGES[:-1]:
            out = written(stage(spark, now, str(tmp_path)), "test-stage")
            assert out.columns == start.columns
            want, rows = plain(name, now.collect()), out.collect()
            if name == "language_id":
                assert Counter((r.doc_id, r.text, r.lang) for r in rows) == want
            elif name == "simhash_dedup":
                assert sorted((r.doc_id is None, r.doc_id or 0, fingerprint_by_hand(r.text)) for r in rows) == want
            else:
                assert Counter((r.doc_id, r.text) for r in rows) == want
            now = out
        packed = C.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in now.collect())
        if start is docs:
            left = {r.doc_id: r.text for r in now.collect()}
            assert 6000 not in left and passage not in left[6001] and "qWeRtY" not in left[6002] and left[6001].startswith("word0")
            assert {5, 6001, 6002} <= left.keys() and now.where(F.col("doc_id") == 5).count() >= 2

"""Language ID: first the family, then one-versus-one linear SVMs among the family's languages.

Features are the relative frequencies of a text's hashed character 1- to 3-grams, over the whole
text, letters in lower case, each run of other characters as one space.  A linear score is then a
mean of weights over the text's n-grams, so prediction needs no feature vector.  Families are
told apart by one linear SVM for each family against the rest, so their number may grow, and the
languages of one family by one for each pair; votes decide, summed margins break ties.  ``score`` is
the product of both levels' confidence.

The SVMs are fitted, a task for each, on about ``PER_LANG`` labelled rows for each language (fewer if ``SAMPLE`` in all would be passed), drawn by a hash
of the text from all labelled rows and each text once.  A language's share is ``PER_LANG`` over its number of *distinct* texts,
so every language that labels a row is learned, however often its texts repeat; those bounds are parameters, and more than
``MAX_LANGS`` languages are refused, as the model (128 KB of weights for each family and each pair of a family's languages) goes to every task.

Beside the SVMs the model knows which n-grams each language's sample holds twice or more.  The share of a text's n-grams that the
two best families know tells language from noise: a sixth of the sample, left out of that count, sets the bound,
``SLACK`` times as far from 1 as the least of its shares, ``MOST`` at most (numbers, keys and marks among sound prose are no n-grams of it).

Defined results: null, empty and letterless texts are ``und`` with score 0; without any labelled
row every text is ``und``; one learned language is predicted for all with score 1; extra columns
are ignored.  ``with_language`` keeps the rows whose language is known by that bound (never
``und``), and writes the prediction where ``lang`` is null; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship

BITS, PER_LANG, SAMPLE, MAX_LANGS, EPOCHS, SLACK, MOST, LEFT_OUT = 15, 600, 20_000, 300, 12, 2.0, 0.85, 6
PIECE = 1 << 18
#: The families of languages; any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi fo", "romance": "fr es it pt ro ca gl oc rm la", "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv", "uralic": "fi et hu", "turkic": "tr az kk ky uz", "indic": "hi bn ur pa mr gu ne", "semitic": "ar he mt am",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_TABLE = None


def _classes() -> np.ndarray:
    """For each code point of the BMP: its lower-case letter, or 32."""
    global _TABLE
    if _TABLE is None:
        low = [c.lower() if (c := chr(i)).isalpha() else " " for i in range(0x10000)]
        _TABLE = np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], np.uint32)
    return _TABLE


def grams(text: str) -> np.ndarray:
    """The hashed 1-, 2- and 3-grams of a text, repeats included; empty if it has no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = points < 0x10000
    c = np.where(low, _classes()[np.where(low, points, 32)], points)
    if not low.all():
        c[~low] = [x if chr(x).isalpha() else 32 for x in points[~low]]
    space = c == 32
    if space.all():
        return np.empty(0, np.int64)
    keep = ~space
    keep[1:] |= ~space[:-1]
    c = np.concatenate(([32], c[keep], [32])).astype(np.uint64)
    mask, shift = np.uint64((1 << 32) - 1), np.uint64(32 - BITS)

    def slot(x: np.ndarray, salt: int) -> np.ndarray:
        x = x + np.uint64(salt)
        x = ((x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return ((x & mask) >> shift).astype(np.int64)

    one, two, three = c[c != 32], c[:-1] << np.uint64(21) | c[1:], c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]
    return np.concatenate((slot(one, 1), slot(two, 2), slot(three, 3)))


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and relative frequencies of the n-grams of a whole text."""
    total = np.zeros(1 << BITS)
    for piece in pieces(text):
        total += np.bincount(grams(piece), minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at] / max(1.0, total.sum())


def pieces(text: str) -> Iterator[str]:
    """Parts of a very long text, overlapping by the two characters that n-grams span."""
    for start in range(0, max(1, len(text)), PIECE):
        yield text[max(0, start - 2) : start + PIECE]


def fit_pair(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """A linear SVM (hinge loss, dual coordinate descent) over profiles scaled to unit length; the last weight is the bias."""
    w, alpha = np.zeros((1 << BITS) + 1), np.zeros(len(rows))
    rng = np.random.default_rng(11)
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            g = y[i] * (w[at] @ x + w[-1]) - 1
            new = min(max(alpha[i] - g / (x @ x + 1), 0.0), 10.0 * weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * x
                w[-1] += step
                alpha[i] = new
    return w


Row = tuple[str, np.ndarray, np.ndarray]
Problem = tuple[list[str], list[str]]


def unit(rows: list[Row]) -> list[Row]:
    return [(lang, at, f / max(1e-12, math.sqrt(f @ f))) for lang, at, f in rows if len(at)]


def solve(rows: list[Row], problem: Problem) -> np.ndarray:
    """The weights that tell the languages of one side from those of the other."""
    sides = {lang: y for y, side in ((1.0, problem[0]), (-1.0, problem[1])) for lang in side}
    some = [(at, x, sides[lang]) for lang, at, x in rows if lang in sides]
    return fit_pair([s[:2] for s in some], np.array([s[2] for s in some])).astype(np.float32)


def fit(rows: list[Row], each: Callable[[list[Row], list[Problem]], list[np.ndarray]] = lambda rows, problems: [solve(rows, p) for p in problems]) -> dict:
    """From (language, slots, frequencies): families, languages, the weights of each family and of each pair of languages, and what is known.

    ``each`` solves the problems, each by itself.
    """
    langs = sorted({r[0] for r in rows})
    families = sorted({FAMILY.get(x, x) for x in langs})
    by = {f: [x for x in langs if FAMILY.get(x, x) == f] for f in families}
    problems: list[Problem] = [(by[f], [x for x in langs if x not in by[f]]) for f in families] if len(families) > 1 else []
    pairs = [(f, i, j) for f in families for i, j in combinations(range(len(by[f])), 2)]
    weights = each(unit(rows), problems + [([by[f][i]], [by[f][j]]) for f, i, j in pairs])
    lang_svm: dict[str, list] = {f: [] for f in families}
    for (f, i, j), w in zip(pairs, weights[len(problems) :]):
        lang_svm[f].append((i, j, w))
    model = {"families": families, "langs": by, "family_svm": weights[: len(problems)], "lang_svm": lang_svm}
    counts = {f: np.zeros(1 << BITS, np.int32) for f in families}
    counted = {x: np.zeros(1 << BITS, np.int32) for x in langs}
    for k, (lang, at, _) in enumerate(rows):
        if k % LEFT_OUT:
            counted[lang][at] += 1
    for x in langs:
        counts[FAMILY.get(x, x)] |= counted[x] > 1
    model["known"] = {f: c.astype(bool) for f, c in counts.items()}
    least = min((known_share(model, at, f) for k, (_, at, f) in enumerate(rows) if not k % LEFT_OUT and len(at)), default=0.0)
    return model | {"bound": min(MOST, 1 - SLACK * (1 - least))}


def known_share(model: dict, at: np.ndarray, f: np.ndarray) -> float:
    """The share of a text's n-grams that its two best families know."""
    x = f / max(1e-12, math.sqrt(f @ f))
    margins = [float(w[at] @ x + w[-1]) for w in model["family_svm"]] or [0.0]
    best = sorted(range(len(margins)), key=lambda k: (-margins[k], k))[:2]
    return float(f[np.logical_or.reduce([model["known"][model["families"][k]][at] for k in best])].sum())


def surest(classes: list[str], svms: list[np.ndarray], at: np.ndarray, x: np.ndarray) -> tuple[str, float]:
    """The class whose margin against the rest is the largest, and how sure it is over the next one."""
    if len(classes) < 2:
        return (classes[0], 1.0) if classes else ("und", 0.0)
    margins = [float(w[at] @ x + w[-1]) for w in svms]
    best, second = sorted(range(len(classes)), key=lambda k: (-margins[k], k))[:2]
    return classes[best], sigmoid(2 * (margins[best] - margins[second]))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def vote(classes: list[str], svms: list, at: np.ndarray, x: np.ndarray) -> tuple[str, float]:
    if len(classes) < 2:
        return (classes[0], 1.0) if classes else ("und", 0.0)
    votes, margins = np.zeros(len(classes)), np.zeros(len(classes))
    for i, j, w in svms:
        m = float(w[at] @ x + w[-1])
        votes[i if m >= 0 else j] += 1
        margins[i] += m
        margins[j] -= m
    best = max(range(len(classes)), key=lambda k: (votes[k], margins[k], -k))
    return classes[best], sigmoid(4 * margins[best] / (len(classes) - 1))


def predict(model: dict, text: str | None) -> tuple[str, float]:
    return judge(model, text)[:2]


def judge(model: dict, text: str | None) -> tuple[str, float, float]:
    """Language, score and the known share of n-grams."""
    at, f = profile(text) if text else (np.empty(0, np.int64), None)
    if not len(at) or not model["families"]:
        return "und", 0.0, 0.0
    x = f / math.sqrt(f @ f)
    family, sure = surest(model["families"], model["family_svm"], at, x)
    lang, surer = vote(model["langs"][family], model["lang_svm"][family], at, x)
    return lang, sure * surer, known_share(model, at, f)


# --- Spark --------------------------------------------------------------------------------------


def train(labelled: DataFrame, per_lang: int = PER_LANG, sample: int = SAMPLE, max_langs: int = MAX_LANGS) -> dict:
    """Fit on (text, lang); distinct texts are counted over all rows, the fit takes a bounded sample of them, however often a text or an id repeats."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    mark = F.xxhash64("text", F.lit(17))
    # one more than allowed tells that there are too many
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(mark, 0.02).alias("texts")).limit(max_langs + 1).collect()
    if not counts:
        return fit([])
    if len(counts) > max_langs:
        raise ValueError(f"over {max_langs} languages label the rows; clean the column, or raise max_langs")
    most = min(per_lang, sample / len(counts))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, most / r["texts"]))))
    drawn = F.pmod(mark, F.lit(1 << 30)) / F.lit(float(1 << 30))

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profile(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([f.astype(np.float32) for _, f in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "slots", "shares"])

    some = rows.where(drawn < F.element_at(share, F.col("lang"))).select("lang", "text").distinct().mapInArrow(profiles, "lang string, slots array<int>, shares array<float>")
    # a bounded sample; sorted so that the fit doesn't depend on the order in which rows arrive
    got = some.toArrow()
    data = sorted(zip(got.column("lang").to_pylist(), (np.array(x, np.int64) for x in got.column("slots").to_pylist()), (np.array(x) for x in got.column("shares").to_pylist())), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))

    def in_tasks(rows: list[Row], problems: list[Problem]) -> list[np.ndarray]:
        if not problems:
            return []
        sent = spark.sparkContext.broadcast((rows, problems))  # bounded by ``sample`` and ``max_langs``

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([solve(*(sent.value[0], sent.value[1][k])).tobytes()], pa.binary())], names=["id", "weights"])

        found = spark.range(0, len(problems), 1, len(problems)).mapInArrow(run, "id long, weights binary").collect()
        sent.unpersist()
        return [np.frombuffer(r["weights"], np.float32) for r in sorted(found, key=lambda r: r["id"])]

    return fit(data, in_tasks)


def identify(docs: DataFrame, model: dict, held_out: Column | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the predicted language of the whole text and a score."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by ``max_langs``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(sent.value, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def with_language(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` whose text is in a known language, which fills ``lang`` (if there) where that is null."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(sent.value, t) for t in batch.column(text).to_pylist()]
            if lang >= 0:
                named = [old if old is not None else new for old, (new, *_) in zip(batch.column(lang).to_pylist(), found)]
                batch = batch.set_column(lang, batch.schema.field(lang), pa.array(named, batch.schema.field(lang).type))
            yield batch.filter(pa.array([x != "und" and known >= sent.value["bound"] for x, _, known in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

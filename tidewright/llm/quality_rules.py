"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Each document's whole text becomes a vector of transformed statistics.  For each language and
source the location and scatter of the tightest ``SUPPORT`` share of its documents (half of them, so
that junk of less than half cannot move them) are estimated by concentration steps over *all* rows:
distances under the current estimate, their quantile from a histogram of counts, then the moments of
the rows below it.  A step shuffles only partial sums and counts by group, so a group with a third of
all rows costs no more than another.  The steps run from ``STARTS``: all rows' moments, and the medians
with the medians of the absolute deviations or with the least spreads; each group keeps the estimate of
the least determinant.  As usual, that estimate is then made efficient by one step over the rows within
its ``INNER`` quantile.  A document is rejected if its squared Mahalanobis distance exceeds the
chi-squared quantile ``OUTER``.

Groups of fewer than ``MIN_GROUP`` rows are put together by language, and what is still small
altogether; if even that is small, its rows have no verdict and stay.  Each row belongs to one
group.  ``STATS`` has a least standard deviation for each statistic, which stands in for a smaller
one and adds nothing to a larger one: ordinary spread of short texts must not look extreme in a group
whose documents are nearly alike.  ``FLOOR`` is added and only keeps the scatter invertible.

Defined results: null text counts as empty and fails the base rule (fewer than 20 words); null
language or source is a group value of its own; repeated rows are separate rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, written

SHINGLE, MIN_WORDS, MAX_REPEAT = 8, 20, 30
MIN_GROUP, SUPPORT, STEPS, INNER, OUTER = 200, 0.5, 6, 0.975, 0.999
#: Bins of squared distances: so many for each doubling, from 2**LOW to 2**HIGH; what lies beyond is in the outermost ones.
GRAIN, LOW, HIGH = 16, -6, 12
STARTS = ("all", "deviations", "least")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Transformed statistics and the least standard deviation of each.
STATS = {"size": 0.8, "width": 0.12, "marks": 0.25, "lines": 0.14, "repeats": 0.15}
NAMES = list(STATS)
LEAST = np.array(list(STATS.values()))
DIM = len(NAMES)
FLOOR = np.full(DIM, 1e-4)
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def chi_squared(x: float, dim: int) -> float:
    """The distribution function, for an odd number of degrees of freedom."""
    out = math.erf(math.sqrt(x / 2))
    for k in range(1, dim, 2):
        out -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return out


def quantile(share: float, dim: int = DIM) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared(middle, dim) < share else (low, middle)
    return high


def consistency(share: float, dim: int = DIM) -> float:
    """The factor that makes the scatter of the tightest ``share`` of normal rows that of all."""
    return share / chi_squared(quantile(share, dim), dim + 2)


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, repeated_words(words)


def repeated_words(words: list[str], k: int = SHINGLE) -> int:
    """Words inside k-word windows that occur twice or more, exactly: windows get dense ranks by doubling."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    index: dict[str, int] = {}
    rank = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(index) == len(words):
        return 0
    size = 1
    while size < k:
        pair = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
        rank = np.unique(pair, return_inverse=True)[1]
        size *= 2
    again = np.bincount(rank)[rank] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover) > 0).sum())


def statistics(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, lang, source, text): counts, base verdict and transformed statistics."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_counts(t or "") for t in batch.column(3).to_pylist()], np.int64).reshape(-1, 5)
            lines = pa.array([(t or "").count("\n") + 1 for t in batch.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in rows.T), lines], names=["doc_id", "lang", "source", *(x.split()[0] for x in BASE.split(", ")), "n_lines"])

    counts = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, lang string, source string, {BASE}, n_lines long")
    words, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return counts.select(
        "*", failed.alias("base_failed"), F.log1p("n_words").alias("size"), F.log(chars / words).alias("width"), F.sqrt(F.col("n_symbols") / words).alias("marks"),
        F.sqrt(F.col("n_dup_lines") / F.col("n_lines")).alias("lines"), F.sqrt(F.col("n_repeat_words") / words).alias("repeats"),
    )


def with_group(stats: DataFrame, least: int) -> DataFrame:
    """Adds ``grp``: language and source, else the language's rest, else the rest; null for a rest that is too small."""
    lang, source = F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00"))
    keyed = stats.withColumn("k_lang", lang).withColumn("k_source", source)
    # counted first, with partial sums; the joined side has a row for each language and source
    cells = stats.where("not base_failed").groupBy(lang.alias("k_lang"), source.alias("k_source")).count()
    small = F.when(F.col("count") < least, F.col("count")).otherwise(0)
    rest = cells.groupBy(F.col("k_lang").alias("r_lang")).agg(F.sum(small).alias("rest"))
    left = rest.agg(F.sum(F.when(F.col("rest") < least, F.col("rest")).otherwise(0)).alias("left")).first()["left"] or 0
    named = cells.join(rest, F.col("k_lang") == F.col("r_lang")).select(
        "k_lang", "k_source",
        F.when(F.col("count") >= least, F.concat_ws("\x01", F.lit("cell"), "k_lang", "k_source")).when(F.col("rest") >= least, F.concat_ws("\x01", F.lit("lang"), "k_lang")).when(F.lit(left >= least), F.lit("all")).alias("grp"),
    )
    return keyed.join(written(named, "quality-groups"), ["k_lang", "k_source"], "left").drop("k_lang", "k_source")


def moments(rows: DataFrame) -> DataFrame:
    """Sums by group: n, of each statistic and of each product."""
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(NAMES)]
    products = [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i in range(DIM) for j in range(i, DIM)]
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *sums, *products)


MODEL = "grp string, " + ", ".join(f"m{i} double" for i in range(DIM)) + ", " + ", ".join(f"i{i}_{j} double" for i in range(DIM) for j in range(i, DIM)) + ", logdet double"


def estimates(sums: DataFrame, factor: float) -> DataFrame:
    """From ``moments``: each group's centre and inverse scatter (``factor`` makes it consistent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(c.to_pylist(), float) for c in batch.columns[1:]]
            out: list[list[float]] = []
            for r in zip(*rows):
                n, s, p = r[0], np.array(r[1 : 1 + DIM]), iter(r[1 + DIM :])
                mean, cov = s / n, np.zeros((DIM, DIM))
                for i in range(DIM):
                    for j in range(i, DIM):
                        cov[i, j] = cov[j, i] = next(p) / n - mean[i] * mean[j]
                cov *= factor
                # a least spread: the diagonal never lies under it
                cov[np.diag_indices(DIM)] = np.maximum(cov.diagonal(), LEAST**2) + FLOOR**2
                inverse = np.linalg.inv(cov)
                out.append([*mean, *(inverse[i, j] for i in range(DIM) for j in range(i, DIM)), np.linalg.slogdet(cov)[1]])
            cols = list(zip(*out)) or [[]] * (DIM + DIM * (DIM + 1) // 2 + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in cols)], names=[x.split()[0] for x in MODEL.split(", ")])

    return sums.mapInArrow(run, MODEL)


def median_starts(fit: DataFrame) -> DataFrame:
    """The starts from each group's medians, as ``estimates`` has them: mergeable sketches, no group in one task."""

    def median(x: Column) -> Column:
        return F.percentile_approx(x, 0.5, 1000)

    centre = written(fit.groupBy("grp").agg(*(median(F.col(n)).alias(f"m{i}") for i, n in enumerate(NAMES))), "quality-medians")
    spread = fit.join(centre, "grp").groupBy("grp").agg(*(median(F.abs(F.col(n) - F.col(f"m{i}"))).alias(f"d{i}") for i, n in enumerate(NAMES)))
    both = centre.join(written(spread, "quality-deviations"), "grp")

    def start(name: str) -> DataFrame:
        var = [F.greatest((1.4826 * F.col(f"d{i}")) ** 2, F.lit(float(LEAST[i] ** 2))) if name == "deviations" else F.lit(float(LEAST[i] ** 2)) for i in range(DIM)]
        inverse = [(1 / var[i] if i == j else F.lit(0.0)).alias(f"i{i}_{j}") for i in range(DIM) for j in range(i, DIM)]
        return both.select(F.concat_ws("\x02", F.lit(name), "grp").alias("grp"), *(f"m{i}" for i in range(DIM)), *inverse, F.lit(0.0).alias("logdet"))

    return start("deviations").unionByName(start("least"))


def distance() -> Column:
    d = [F.col(n) - F.col(f"m{i}") for i, n in enumerate(NAMES)]
    terms = [d[i] * d[j] * F.col(f"i{i}_{j}") * (1 if i == j else 2) for i in range(DIM) for j in range(i, DIM)]
    return sum(terms[1:], terms[0])


def outliers(docs: DataFrame, least: int = MIN_GROUP, support: float = SUPPORT, steps: int = STEPS, inner: float = INNER, outer: float = OUTER) -> DataFrame:
    """Per row of ``docs``: counts, ``base_failed``, ``distance`` (null without estimate) and ``kept``.

    The estimates are fitted on the rows that pass the base rule; the verdict falls on every row.
    """
    # the small tables of groups are written, so their size is known and Spark broadcasts them if it is small
    stats = with_group(written(statistics(docs), "quality-stats"), least)
    fit = stats.where("not base_failed and grp is not null").select("grp", *NAMES)
    first = estimates(moments(fit), 1.0).withColumn("grp", F.concat_ws("\x02", F.lit("all"), "grp"))
    model = written(first.unionByName(median_starts(fit)), "quality-model")
    # each row once for each start; a start's name leads the group's
    each = fit.withColumn("start", F.explode(F.array(*map(F.lit, STARTS)))).select(F.concat_ws("\x02", "start", "grp").alias("grp"), *NAMES)
    depth = F.least(F.greatest(F.log2(F.col("d2") + 2.0 ** (LOW - 1)), F.lit(LOW)), F.lit(HIGH))
    for _ in range(steps):
        far = each.join(model, "grp").withColumn("d2", distance()).withColumn("bin", F.floor(depth * GRAIN).cast("int"))
        # counts by group and bin of the distance: where the share of ``support`` is reached
        bins = far.groupBy("grp", "bin").count()
        edge = bins.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("bins"), F.sum("count").alias("all"))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("bin"))

        def reach(acc, x):
            n = acc["n"] + x["count"]
            return F.struct(n.alias("n"), F.coalesce(acc["bin"], F.when(n >= F.col("all") * support, x["bin"])).alias("bin"))

        edges = written(edge.select("grp", F.aggregate("bins", start, reach)["bin"].alias("edge")), "quality-edges")
        model = written(estimates(moments(far.join(edges, "grp").where("bin <= edge")), consistency(support)), "quality-model")
    named = model.withColumn("grp", F.substring_index("grp", "\x02", -1))
    model = written(named.groupBy("grp").agg(F.min_by(F.struct(*named.columns[1:]), F.struct("logdet", *(f"m{i}" for i in range(DIM)))).alias("best")).select("grp", "best.*"), "quality-model")
    near = fit.join(model, "grp").withColumn("d2", distance()).where(F.col("d2") <= quantile(inner))
    model = written(estimates(moments(near), consistency(inner)), "quality-model")
    scored = stats.join(model, "grp", "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= quantile(outer)))
    return scored.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")

"""Lagged rank correlation of all pairs of series, by blocks of the bucket matrix.

Series are rows of a matrix over buckets.  They are dealt by name to blocks, and each pair of blocks is a group.  Rows that miss the same buckets are one
pattern.  Up to ``COMPARED`` buckets a block keeps the signs of all differences within a row: their product with a pattern ranks all rows in its buckets,
in whole numbers, and one matrix product of such ranks gives a lag's correlations of all pairs of two large patterns; rows of small patterns are taken
together.  Only pairs that exceed the critical correlation at some lag are looked at one by one.  Wider series are ranked pattern by pattern.
What leaves a task is the pairs that exceed it, in batches, not all pairs.  A task holds two blocks; buckets are bounded by ``MAX_BUCKETS``, beyond which coarser buckets are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .statistics import correlation, rho_critical

BLOCK, CELLS, MAX_BUCKETS, LEAST_PAIRS, AUTOCORRELATED = 1024, 2_500_000, 10_000, 5, 0.5
#: Up to so many buckets, ranks come from comparing all of a row's values.
COMPARED = 64
#: Then a block has so many series at most, and so many signs.
NARROW, SIGNS = 16_384, 4_194_304
#: A pattern of so many rows is large; tables of ranks have so many cells.
LARGE, CHUNK = 32, 1_048_576
#: A partition has few groups, as many have none.
TILE, SENT, SPREAD, MAX_TASKS = 256, 200_000, 4, 4096

#: Places of the rows on either side, lag, rho and n of pairs that exceed the critical correlation
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks of a vector, ties averaged."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def _standard(x: np.ndarray) -> np.ndarray:
    """Ranks of each row, centred and of unit length; rows without spread become NaN."""
    if x.shape[1] <= COMPARED:
        r = np.empty(x.shape)
        for k in range(x.shape[1]):
            at = x[:, k : k + 1]
            r[:, k] = (x < at).sum(1) + (x == at).sum(1) / 2
    else:
        r = np.array([ranks(row) for row in x]).reshape(x.shape)
    r -= r.mean(1, keepdims=True)
    length = np.sqrt((r * r).sum(1, keepdims=True))
    return np.divide(r, length, out=np.full_like(r, np.nan), where=length > 1e-12)


def _patterns(seen: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(the observed buckets, the rows) of each pattern of observation."""
    found: dict[bytes, list[int]] = {}
    for k, row in enumerate(np.packbits(seen, axis=1)):
        found.setdefault(row.tobytes(), []).append(k)
    return [(seen[rows[0]], np.array(rows)) for rows in found.values()]


def lag_table(left: np.ndarray, right: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(rho, n) of every row of ``left`` with every row of ``right`` ``lag`` buckets later; NaN where unmeasurable."""
    width = left.shape[1]
    a, b = (left[:, : width - lag], right[:, lag:]) if lag >= 0 else (left[:, -lag:], right[:, : width + lag])
    n, rho = np.zeros((len(a), len(b)), np.int64), np.full((len(a), len(b)), np.nan)
    theirs = _patterns(~np.isnan(b))
    for seen_a, rows_a in _patterns(~np.isnan(a)):
        ranked: dict[bytes, np.ndarray] = {}
        for seen_b, rows_b in theirs:
            both = seen_a & seen_b
            many, at = int(both.sum()), np.ix_(rows_a, rows_b)
            n[at] = many
            if many >= least:
                if (key := both.tobytes()) not in ranked:
                    if len(ranked) >= 8:
                        ranked.clear()
                    ranked[key] = _standard(a[np.ix_(rows_a, both)])
                rho[at] = ranked[key] @ _standard(b[np.ix_(rows_b, both)]).T
    return rho, n


def best_lags(a: np.ndarray, b: np.ndarray, first: np.ndarray, lags: Sequence[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lag, rho, n) of all pairs at their best lag, which counts from the row that ``first`` tells; n is 0 where none is measurable."""
    tables = {k: lag_table(a, b, k, least) for k in {*lags, *(-k for k in lags)}}
    best, told, n = np.full(first.shape, np.nan), np.zeros(first.shape, np.int32), np.zeros(first.shape, np.int64)
    for lag in sorted({*lags}, key=lambda k: (abs(k), k)):  # the earlier one keeps a tie
        rho, many = (np.where(first, x, y) for x, y in zip(tables[lag], tables[-lag]))
        rho = np.round(rho, 9)
        better = ~np.isnan(rho) & ((n == 0) | (np.abs(rho) > np.abs(best)))
        best[better], told[better], n[better] = rho[better], lag, many[better]
    return told, best, n


class Side(NamedTuple):
    """The rows of a block by patterns, the largest first, those with ties apart; patterns of ``LARGE`` rows or more lie before ``large``, their rows before ``small``."""

    place: np.ndarray
    seen: np.ndarray
    signs: np.ndarray
    patterns: np.ndarray
    tied: np.ndarray
    starts: np.ndarray
    large: int
    small: int


def side(x: np.ndarray, place: np.ndarray) -> Side:
    """``signs`` has a row a bucket: how each value of each series compares with that bucket's, 0 where either is unobserved."""
    inorder, width = np.sort(x, axis=1), x.shape[1]
    tied = (inorder[:, 1:] == inorder[:, :-1]).any(1)
    groups = sorted(_patterns(np.column_stack([~np.isnan(x), tied])), key=lambda g: -len(g[1]))
    order, sizes = np.concatenate([rows for _, rows in groups]), np.array([len(rows) for _, rows in groups])
    x = x[order]
    signs = np.empty((width, *x.shape), np.float32)
    for k in range(width):
        np.subtract(x > x[:, k : k + 1], x < x[:, k : k + 1], out=signs[k], dtype=np.float32)
    keys, starts, large = np.array([key for key, _ in groups]), np.concatenate([[0], np.cumsum(sizes)]), int((sizes >= LARGE).sum())
    return Side(place[order], ~np.isnan(x), signs.reshape(width, -1), keys[:, :-1], keys[:, -1], starts, large, starts[large])


def _later(x: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """What there is so many buckets later, 0 beyond the last: for each lag a table of all of ``x``, or of its own table there."""
    width = x.shape[-1]
    out = np.zeros((len(lags), *x.shape[-2:]), np.float32)
    for k, lag in enumerate(lags.tolist()):
        out[k, :, max(0, -lag) : width - max(0, lag)] = (x[k] if x.ndim == 3 else x)[:, max(0, lag) : width - max(0, -lag)]
    return out


def _ranked(at: Side, start: int, end: int, masks: np.ndarray) -> np.ndarray:
    """For each mask, twice the centred ranks of rows among its buckets, 0 elsewhere: whole numbers, whose products are exact in 24 bits up to ``COMPARED`` buckets."""
    width = at.seen.shape[1]
    found = (masks @ at.signs[:, start * width : end * width]).reshape(len(masks), end - start, width)
    found *= masks[:, None]
    return found


def _squares(ranked: np.ndarray) -> np.ndarray:
    """Squared lengths, infinite without spread."""
    found = np.einsum("...w,...w->...", ranked, ranked).astype(float)
    found[found == 0] = np.inf
    return found


def _best(rho: np.ndarray, n: np.ndarray, lags: np.ndarray, critical: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which pairs, lag, rho, n) of those that exceed the critical correlation at their best lag; a row of ``rho`` and ``n`` a lag, of which the earlier one keeps a tie."""
    rho = np.round(rho, 9)
    best, every = np.abs(rho).argmax(0), np.arange(rho.shape[1])
    top, many = rho[best, every], n[best, every if n.shape[1] > 1 else 0]
    keep = np.flatnonzero(np.abs(top) >= critical[many])
    return keep, lags[best[keep]], top[keep], many[keep]


def _at(x: np.ndarray, part: slice | np.ndarray) -> np.ndarray:
    """Some columns; one that holds for all stays."""
    return x[:, part] if x.shape[1] > 1 else x


def _tiles(ours: np.ndarray, theirs: np.ndarray, a: np.ndarray, b: np.ndarray, lags: np.ndarray, n: np.ndarray, critical: np.ndarray) -> Iterator[Found]:
    """Pairs of ``ours`` (a table of rows a lag) and ``theirs`` (of columns); ``a`` and ``b``: squared lengths, infinite where unmeasurable, ``n``: for each lag, of all or of each of ours."""
    # without ties all rows of a pattern are of one length
    a, b = (x[:, :1] if (x == x[:, :1]).all() else x for x in (a, b))
    # rounding may lift what lies just below
    low_a, low_b = (np.sqrt(a) * (critical[n] - 1e-6)).astype(np.float32), np.sqrt(b).astype(np.float32)
    for p in range(0, ours.shape[1], TILE):
        for q in range(0, theirs.shape[2], TILE):
            products = ours[:, p : p + TILE] @ theirs[:, :, q : q + TILE]
            low = _at(low_a, slice(p, p + TILE))[:, :, None] * _at(low_b, slice(q, q + TILE))[:, None]
            at = np.flatnonzero((np.abs(products) >= low).any(0))
            if len(at):
                x, y = np.divmod(at, products.shape[2])
                x, y, found = x + p, y + q, products.reshape(len(lags), -1)[:, at]
                keep, *rest = _best(found / np.sqrt(_at(a, x) * _at(b, y)), _at(n, x), lags, critical)
                yield x[keep], y[keep], *rest


def _by_pattern(ours: Side, theirs: Side, lags: np.ndarray, least: int, critical: np.ndarray) -> Iterator[Found]:
    """Pairs of rows of large patterns, two patterns at a time."""
    masks = _later(theirs.patterns[: theirs.large], lags).transpose(1, 0, 2)
    for one in range(ours.large if theirs.large else 0):
        start, end = ours.starts[one : one + 2]
        n = (masks * ours.patterns[one]).sum(2).astype(int)
        ranked = _later(_ranked(theirs, 0, theirs.small, _later(ours.patterns[one : one + 1], -lags)[:, 0]), lags)
        b = _squares(ranked)
        for other in range(theirs.large):
            table, part, many = _ranked(ours, start, end, masks[other]), slice(*theirs.starts[other : other + 2]), n[other][:, None]
            a = np.where(many >= least, _squares(table), np.inf)
            for x, y, *rest in _tiles(table, ranked[:, part].transpose(0, 2, 1), a, b[:, part], lags, many, critical):
                yield start + x, part.start + y, *rest


def _by_row(few: Side, many: Side, lags: np.ndarray, least: int, critical: np.ndarray) -> Iterator[Found]:
    """Pairs of a row of a small pattern and one without ties of a large pattern, ``lag`` buckets earlier.

    Each row of the latter is ranked in the former's buckets: these ranks are sums of signs, so their products with the former's ranks are sums of signs
    times differences of the former's, and without ties their length depends on their number only.
    """
    width = few.seen.shape[1]
    early, late = np.triu_indices(width, 1)
    step = max(1, CHUNK // max(1, len(lags) * len(early)))
    for one in np.flatnonzero(~many.tied[: many.large]) if few.small < len(few.place) else ():
        start, end = many.starts[one : one + 2]
        signs = many.signs.reshape(width, -1, width)[:, start:end][late, :, early][None]
        back = _later(many.patterns[one : one + 1], -lags)[:, 0]
        for p in range(few.small, len(few.place), step):
            stop = min(p + step, len(few.place))
            ranked, seen = _later(_ranked(few, p, stop, back), lags), _later(few.seen[p:stop], lags)
            n = (seen * many.patterns[one]).sum(2).astype(int)
            a = np.where(n >= max(least, 2), _squares(ranked), np.inf) * np.maximum(n**3 - n, 1) / 3
            for x, y, *rest in _tiles(ranked[..., early] * seen[..., late] - ranked[..., late] * seen[..., early], signs, a, np.ones((len(lags), end - start)), lags, n, critical):
                yield p + x, start + y, *rest


def _one_by_one(ours: Side, theirs: Side, rows: tuple[int, int], others: tuple[int, int], lags: np.ndarray, least: int, critical: np.ndarray) -> Iterator[Found]:
    """Pairs of any rows: each is ranked by the pattern of each row of the other side."""
    step = max(1, math.isqrt(CHUNK // ours.seen.shape[1]))
    for p in range(*rows, step):
        for q in range(*others, step):
            end_p, end_q = min(p + step, rows[1]), min(q + step, others[1])
            rho, n = np.zeros((len(lags), end_p - p, end_q - q)), np.zeros((len(lags), end_p - p, end_q - q), int)
            for k in range(len(lags)):
                lag = lags[k : k + 1]
                masks, back = _later(theirs.seen[q:end_q], lag)[0], _later(ours.seen[p:end_p], -lag)[0]
                n[k] = ours.seen[p:end_p].astype(np.float32) @ masks.T
                a, b = _ranked(ours, p, end_p, masks).transpose(1, 0, 2), _ranked(theirs, q, end_q, back)
                products = np.einsum("abw,abw->ab", a, _later(b.reshape(-1, b.shape[2]), lag).reshape(b.shape))
                np.divide(products, np.sqrt(_squares(a) * _squares(b)), out=rho[k], where=n[k] >= least)
            keep, *rest = _best(rho.reshape(len(lags), -1), n.reshape(len(lags), -1), lags, critical)
            yield p + keep // (end_q - q), q + keep % (end_q - q), *rest


def exceeding(ours: Side, theirs: Side, lags: Sequence[int], least: int, critical: np.ndarray) -> Iterator[Found]:
    """All pairs of a row of ``ours`` and one of ``theirs``, ``lag`` buckets later, whose best lag exceeds the critical correlation."""
    told = np.array(sorted({k for k in lags if abs(k) < ours.seen.shape[1]}, key=lambda k: (abs(k), k)), np.int32)
    if not len(told):
        return
    for x, y, *rest in _by_pattern(ours, theirs, told, least, critical):
        yield ours.place[x], theirs.place[y], *rest
    for y, x, *rest in _by_row(theirs, ours, told, least, critical):
        yield ours.place[x], theirs.place[y], *rest
    for x, y, lag, *rest in _by_row(ours, theirs, -told, least, critical):
        yield ours.place[x], theirs.place[y], -lag, *rest
    whole, others = (ours.small, len(ours.place)), (theirs.small, len(theirs.place))
    parts = [(whole, others), *((tuple(ours.starts[k : k + 2]), others) for k in np.flatnonzero(ours.tied[: ours.large])), *((whole, tuple(theirs.starts[k : k + 2])) for k in np.flatnonzero(theirs.tied[: theirs.large]))]
    for part in parts:
        for x, y, *rest in _one_by_one(ours, theirs, *part, told, least, critical):
            yield ours.place[x], theirs.place[y], *rest


def unmeasurable(df: DataFrame, series: str, bucket: str, value: str, least: int = LEAST_PAIRS) -> DataFrame:
    """(series, reason) of series that no pair can be measured with: too_few_buckets or constant."""
    found = df.where(F.col(value).isNotNull()).groupBy(series).agg(F.count_distinct(bucket).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    reason = F.when(F.col("n") < least, "too_few_buckets").when(F.col("low") == F.col("high"), "constant")
    return found.select(series, reason.alias("reason")).where("reason is not null")


def correlated_pairs(df: DataFrame, series: str, bucket: str, value: str, lags: Sequence[int], least: int = LEAST_PAIRS, block: int | None = None) -> DataFrame:
    """(first, second, lag, rho, n, differenced): pairs of series whose best lag exceeds the critical rank correlation.

    ``second`` is the series with the larger name, ``lag`` by how many buckets it follows the first.  Only buckets that both have count; NULL values are unobserved,
    several of a bucket are averaged.  If either series' correlation with its own value before exceeds ``AUTOCORRELATED``, both are replaced by their differences
    from one observed value to the next.  The best lag has the largest absolute correlation, then the smallest absolute
    lag, then the smaller lag.
    """
    kind = dict(df.dtypes)[series]
    rows = df.where(F.col(value).isNotNull() & F.col(series).isNotNull()).groupBy(F.col(series).alias("s"), F.col(bucket).cast("long").alias("b")).agg(F.avg(value).alias("v"))
    order = Window.partitionBy("s").orderBy("b")
    rows = rows.withColumn("p", F.lag("v").over(order))
    spread = (F.count("p") >= 2) & (F.min("p") < F.max("p")) & (F.min(F.when(F.col("p").isNotNull(), F.col("v"))) < F.max(F.when(F.col("p").isNotNull(), F.col("v"))))
    # a row a series: at most ``MAX_BUCKETS`` values
    packed = cut(rows.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("b", "v"))).alias("x"), F.coalesce(F.when(spread, correlation("v", "p")) > AUTOCORRELATED, F.lit(False)).alias("auto")))
    low, high, many = packed.agg(F.min(F.col("x.b")[0]), F.max(F.element_at("x.b", -1)), F.count("s")).first()
    width = 0 if low is None else high - low + 1
    if width > MAX_BUCKETS:
        raise ValueError(f"{width} buckets; take coarser ones ({MAX_BUCKETS} at most)")
    narrow = width <= COMPARED
    block = block or max(1, min(NARROW, SIGNS // max(width, 1) ** 2) if narrow else min(BLOCK, CELLS // width))
    # pairs of blocks for all cores, also of few series
    blocks = max(1, math.ceil(many / block), min(math.isqrt(12 * df.sparkSession.sparkContext.defaultParallelism), many // LARGE))
    # by ranges of names: of two blocks, one has all the smaller ones
    packed = packed.select("s", F.transform("x.b", lambda b: (b - F.lit(low)).cast("short")).alias("bs"), F.col("x.v").alias("vs"), "auto").repartitionByRange(blocks, "s")
    packed = cut(packed.withColumn("own", F.spark_partition_id()))
    blocks = (packed.agg(F.max("own")).first()[0] or 0) + 1
    dealt = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    # small as the rows are, each pair of blocks is much work: no joining of partitions
    dealt = dealt.repartition(min(SPREAD * blocks * (blocks + 1) // 2, MAX_TASKS), "i", "j")
    critical = np.array([np.inf, *(round(rho_critical(n), 9) for n in range(1, width + 1))])

    def found(table: pa.Table, i: int, j: int) -> Iterator[tuple[Found, bool]]:
        own, auto = table["own"].to_numpy(), table["auto"].to_numpy()
        sizes = pa.compute.list_value_length(table["bs"]).to_numpy()
        values, changes = np.full((len(own), width), np.nan), np.full((len(own), width), np.nan)
        at = (np.repeat(np.arange(len(own)), sizes), pa.compute.list_flatten(table["bs"]).to_numpy())
        values[at] = v = pa.compute.list_flatten(table["vs"]).to_numpy()
        d = np.diff(v, prepend=np.nan)
        d[np.cumsum(sizes) - sizes] = np.nan  # a series' first value has none before it
        changes[at] = d
        for x, y in ((x, y) for x in (False, True) for y in (False, True)):
            ours, theirs = np.flatnonzero((own == i) & (auto == x)), np.flatnonzero((own == j) & (auto == y))
            if not len(ours) or not len(theirs):
                continue
            data = changes if x or y else values
            if narrow:
                for p, q, *rest in exceeding(side(data[ours], ours), side(data[theirs], theirs), lags, least, critical):
                    # in one block a pair comes both ways
                    once = p < q if i == j else slice(None)
                    yield (p[once], q[once], *(c[once] for c in rest)), x or y
            else:
                first = ours[:, None] < theirs[None]
                lag, rho, n = best_lags(data[ours], data[theirs], first, lags, least)
                k, m = np.nonzero((n > 0) & (np.abs(rho) >= critical[n]) & (first if i == j else True))
                p, q = ours[k], theirs[m]
                yield (np.minimum(p, q), np.maximum(p, q), lag[k, m], rho[k, m], n[k, m]), x or y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("s")  # so a row's place tells which name is the larger one
        names, held, rows = table["s"].combine_chunks(), [], 0

        def sent() -> pa.RecordBatch:
            p, q, lag, rho, n, differenced = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays([names.take(pa.array(p)), names.take(pa.array(q)), pa.array(lag, pa.int32()), pa.array(rho), pa.array(n, pa.int64()), pa.array(differenced)], ["first", "second", "lag", "rho", "n", "differenced"])

        for pairs, differenced in found(table, table["i"][0].as_py(), table["j"][0].as_py()):
            held.append((*pairs, np.full(len(pairs[0]), differenced)))
            rows += len(pairs[0])
            if rows >= SENT:
                yield sent()
                held, rows = [], 0
        if held:
            yield sent()

    return dealt.groupBy("i", "j").applyInArrow(run, f"first {kind}, second {kind}, lag int, rho double, n long, differenced boolean")

"""Text ranking and vectors: BM25, rank fusion, cosine search, hashing encoder, field-weighted search."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import SEARCH_TOKEN, search_tokens

K1, B, RRF_K = 1.2, 0.75, 60
MAX_TERMS = 5000


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of documents with a matched term; a repeated query term counts each time.

    docs: doc_id, text; queries: query_id, text.  Only postings of query terms leave a document's array of
    tokens: up to ``MAX_TERMS`` distinct terms are tested inside the array, more by a join on the terms.
    """
    tokens = docs.select("doc_id", search_tokens(F.col("text")).alias("ts"))
    size = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ts")).alias("mean")).first()
    wanted = queries.select("query_id", F.explode(search_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = wanted.select("term").distinct()
    few = [r["term"] for r in terms.limit(MAX_TERMS + 1).collect()]
    length = F.size("ts").alias("len")
    if len(few) <= MAX_TERMS:
        found = tokens.select("doc_id", length, F.explode(F.filter("ts", lambda t: t.isin(few))).alias("term"))
    else:
        found = tokens.select("doc_id", length, F.explode("ts").alias("term")).join(terms, "term", "left_semi")
    postings = found.groupBy("doc_id", "term", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (size["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / float(size["mean"] or 1.0)))
    return postings.join(df, "term").join(wanted, "term").groupBy("query_id", "doc_id").agg(F.sum(part * F.col("times")).alias("score"))


def top_per_query(scored: DataFrame, n: int, ident: str = "doc_id") -> DataFrame:
    """The n best of each query; ties by the id as text."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(ident).cast("string"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _normalised() -> Column:
    arm = Window.partitionBy("query_id", "arm")
    low, high = F.min("score").over(arm), F.max("score").over(arm)
    return F.when(high <= low, 1.0).otherwise((F.col("score") - low) / (high - low))


def fuse(arms: DataFrame, method: str, weights: Mapping[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(query_id, key, score, rank) from (query_id, arm, key, score, rank) by ``rrf``, ``weighted`` or ``max``.

    Scores fall, then the best rank rises, then the key; an arm without a weight counts nothing.
    """
    if method == "rrf":
        scored, total = arms.withColumn("part", 1.0 / (k + F.col("rank"))), F.sum("part")
    elif method == "max":
        scored, total = arms.withColumn("part", _normalised()), F.max("part")
    else:
        if not weights:
            raise ValueError("weighted fusion needs weights")
        weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("arm")), F.lit(0.0))
        scored, total = arms.withColumn("part", weight * _normalised()), F.sum("part")
    fused = scored.groupBy("query_id", "key").agg(total.alias("score"), F.min("rank").alias("best_rank"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "key")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; vectors of different length are an error."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different length")).cast("double")).otherwise(value)


def similarity_from_distance(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)


def vector_search(vectors: DataFrame, query: Sequence[float], k: int, scope: Column | None = None, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest by unclamped cosine, ties by the id as text; the score reported is clamped at 0."""
    kept = vectors if scope is None else vectors.where(scope)
    c = cosine(F.col(column), F.array(*(F.lit(float(x)) for x in query)))
    return kept.select(ident, c.alias("cosine")).orderBy(F.desc("cosine"), F.col(ident).cast("string")).limit(k).select(ident, F.greatest(F.lit(0.0), F.col("cosine")).alias("score"), "cosine")


def encode(c: Column, width: int = 1536) -> Column:
    """Signed feature hashing of words and padded 4-grams (blake2b), scaled to unit length; in Arrow batches."""
    if width < 8:
        raise ValueError("at least 8 dimensions")
    word = re.compile(SEARCH_TOKEN)

    def vector(text: str | None) -> list[float]:
        out = np.zeros(width)
        words = word.findall((text or "").lower())
        for f in [*words, *(g for w in words for p in (f" {w} ",) for g in (p[i : i + 4] for i in range(max(len(p) - 3, 0))))]:
            h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            out[h % width] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(float(out @ out))
        return (out / norm if norm else out).tolist()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(vector)

    return run(c)


def field_score(query: Column, title: Column, keywords: Column, summary: Column) -> Column:
    """(3 title + 2 keyword + 1 summary overlap) / query words; all are arrays of lower-case words."""
    q = F.array_distinct(query)
    hit = 3 * F.size(F.array_intersect(q, title)) + 2 * F.size(F.array_intersect(q, keywords)) + F.size(F.array_intersect(q, summary))
    return F.when(F.size(q) == 0, 0.0).otherwise(hit / F.size(q))


def search_keyword(chunks: DataFrame, terms: Sequence[str], text: str, owners: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Chunks that hold any of the terms, in any case; with ``owners`` only those of the documents listed there."""
    if not terms:
        return chunks.limit(0)
    found = chunks.where(reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(t.lower())) for t in terms)))
    return found if owners is None else found.join(owners.select(key), key, "left_semi")


def search_text(df: DataFrame, text: str, query: str, mode: str, least: float = 0.3) -> DataFrame:
    """Rows by ``contains`` (any case), ``words`` (all of the query's words) or ``trigram`` (similarity above ``least``)."""
    c = F.col(text)
    if mode == "contains":
        return df.where(F.contains(F.lower(c), F.lit(query.lower())))
    if mode == "words":
        return df.where(F.size(F.array_except(search_tokens(F.lit(query)), search_tokens(c))) == 0)
    if mode == "trigram":
        return df.withColumn("similarity", trigram_similarity(c, F.lit(query))).where(F.col("similarity") > least)
    raise ValueError(f"unknown search mode {mode}")


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of the padded lower-case texts."""

    def grams(c: Column) -> Column:
        padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))

    x, y = grams(a), grams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))

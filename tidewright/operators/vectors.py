"""Vector search: an inverted-file index with exact re-ranking, and the exact way for everything.

Vectors lie in shards of about ``SHARD`` rows; queries travel to the shards they ask.  In a task a shard's vectors
come first and stay as one matrix, then its queries stream past in batches, each leaving its best k and what ties with
the last of them.  So no shard, cell or number of queries is too large for a task, nothing is
collected, and vectors are moved once.

The index is k-means over a bounded sample (``sample`` rows with the smallest hashes of their id); every row is
assigned to the cell of the centroid it is most alike.  A search asks the ``probes`` nearest cells of each query
and ranks their rows by exact cosine; with as many probes as cells it is exact.

Null vectors are left out; a zero vector has cosine 0 with everything; vectors of another width are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SHARD, BATCH = 20_000, 256


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // max(1, len(rows))
    if len(flat) and not (np.diff(rows.offsets.to_numpy()) == width).all():
        raise ValueError("vectors of different length")
    return flat.reshape(len(rows), width)


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def fit_cells(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 10, ident: str = "vec_id", column: str = "embedding") -> np.ndarray:
    """Unit centroids of k-means by cosine over the sample; fewer if the sample has fewer vectors."""
    drawn = vectors.where(F.col(column).isNotNull()).orderBy(F.xxhash64(F.col(ident).cast("string")), F.col(ident).cast("string")).limit(sample).select(column).toArrow()  # ``sample`` rows
    x = _unit(_matrix(drawn.column(0))) if drawn.num_rows else np.zeros((0, 1))
    if not len(x):
        return x
    centre = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        centre = np.where(np.bincount(near, minlength=len(centre))[:, None] > 0, _unit(sums), centre)
    return centre


def with_cells(rows: DataFrame, centroids: np.ndarray, column: str, most: int = 1) -> DataFrame:
    """``rows`` once for each of the ``most`` nearest cells, named in ``cell``."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)  # cells x width, both parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(batch.schema.get_field_index(column)))) @ sent.value.T
            near = np.argsort(-x, axis=1, kind="stable")[:, :most]
            taken = batch.take(pa.array(np.repeat(np.arange(len(x)), near.shape[1])))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(near.ravel(), pa.int32())], names=[*batch.schema.names, "cell"])

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    return rows.where(F.col(column).isNotNull()).mapInArrow(run, schema)


def _best(rows: DataFrame, k: int, ident: str, id_type: str, query_type: str) -> DataFrame:
    """(query_id, ident, score) over rows (shard, kind, query_id, ident, v) sorted by shard and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, x, names = None, [], None, None
        for batch in batches:
            keys, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != shard:
                    shard, held, x = keys[a], [], None
                if kinds[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if not held:
                    continue
                if x is None:
                    table = pa.Table.from_batches(held)
                    x, names = _unit(_matrix(table.column(4))), table.column(3).combine_chunks()
                for at in range(a, b, BATCH):
                    some = batch.slice(at, min(BATCH, b - at))
                    q = _unit(_matrix(some.column(4)))
                    scores = np.round(q @ x.T, 9) + 0.0
                    last = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(q), -np.inf)
                    which, near = np.nonzero(scores >= last[:, None])
                    yield pa.RecordBatch.from_arrays([some.column(2).take(pa.array(which)), names.take(pa.array(near)), pa.array(scores[which, near])], names=["query_id", ident, "score"])

    return rows.mapInArrow(run, f"query_id {query_type}, {ident} {id_type}, score double")


def _ranked(vectors: DataFrame, queries: DataFrame, k: int, ident: str, column: str) -> DataFrame:
    """The best k of each query among the vectors of its cells; both sides have ``cell``, a query has a row for each."""
    kinds = dict(vectors.dtypes), dict(queries.dtypes)
    # how many shards a cell has; a row for each cell
    sizes = vectors.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("long").alias("shards"))
    place = lambda n: F.col("cell").cast("long") * (1 << 32) + n
    ours = vectors.where(F.col(column).isNotNull()).join(sizes, "cell").select(place(F.pmod(F.xxhash64(F.col(ident).cast("string")), F.col("shards"))).alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast(kinds[1]["query_id"]).alias("query_id"), F.col(ident), F.col(column).cast("array<double>").alias("v"))
    theirs = queries.where(F.col("query").isNotNull()).join(sizes, "cell").withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    theirs = theirs.select(place(F.col("n")).alias("shard"), F.lit(1).alias("kind"), "query_id", F.lit(None).cast(kinds[0][ident]).alias(ident), F.col("query").cast("array<double>").alias("v"))
    met = ours.unionByName(theirs).repartition("shard").sortWithinPartitions("shard", "kind")
    found = _best(met, k, ident, kinds[0][ident], kinds[1]["query_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(ident).cast("string")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", F.greatest(F.lit(0.0), "score"))


def search_exact(vectors: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, ident, score, rank): the k nearest of each query (query_id, query) by cosine, ties by the id as text."""
    return _ranked(vectors.select(ident, column).withColumn("cell", F.lit(0)), queries.select("query_id", "query").withColumn("cell", F.lit(0)), k, ident, column)


def search_cells(indexed: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """As ``search_exact``, among the rows of each query's ``probes`` nearest cells; ``indexed`` has ``cell``."""
    return _ranked(indexed.select(ident, column, "cell"), with_cells(queries.select("query_id", "query"), centroids, "query", probes), k, ident, column)


def search_similar(indexed: DataFrame, centroids: np.ndarray, queries: DataFrame, chunks: DataFrame, documents: DataFrame, k: int, probes: int, scope: Column | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, document_id, title, content, distance): nearest chunks with their documents.

    Indexed rows: chunk_id, embedding, cell and what ``scope`` (a tenant, a model, kinds of source) reads; chunks: chunk_id, document_id, content;
    documents: document_id, title.  Rows without a chunk or a document are no results, so these joins come before the ranking.
    """
    rows = indexed if scope is None else indexed.where(scope)
    whole = rows.join(chunks.join(documents.select("document_id"), "document_id", "left_semi").select("chunk_id"), "chunk_id", "left_semi")
    found = search_cells(whole, centroids, queries, k, probes, "chunk_id")
    return found.join(chunks, "chunk_id").join(documents, "document_id").select("query_id", "rank", "chunk_id", "document_id", "title", "content", (1 - F.col("score")).alias("distance"))


def recall(found: DataFrame, exact: DataFrame, ident: str = "vec_id") -> float:
    """The share of exact results that were found, by score: a result that ties with the last exact one counts as one."""
    last = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("wanted"))
    hits = found.join(last, "query_id").where(F.col("score") >= F.col("least")).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    got = last.join(hits, "query_id", "left").agg(F.sum(F.least("wanted", F.coalesce("hits", F.lit(0)))).alias("h"), F.sum("wanted").alias("w")).first()
    return 1.0 if not got["w"] else got["h"] / got["w"]

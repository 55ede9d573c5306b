"""LM scoring by deleted interpolation of bigram, unigram and uniform estimates.

Maximum-likelihood estimates come from the counts of all training documents.  They are mixed with
weights that depend on how often the context was seen (buckets of doubling frequency); expectation-
maximisation learns the weights on training documents held out from the counts it sees (``HELD``
of ``PARTS`` folds), after which the held-out counts are put back.  A training document is scored
without its own counts (they are subtracted), so that it isn't known only from itself: texts that occur
again stand out, and scores of training and tested documents compare.

The work is dealt so that no word, context or group of copies is too large for a task:

1. *Blocks*: each task turns its documents into blocks of about ``BLOCK_TOKENS`` tokens, a row each,
   with the block's distinct words as 64-bit hashes and its documents as numbers into them.
2. *Requests*: each block sends its distinct words and bigrams, once each, with its counts, to parts
   by hash.  A part adds up what all blocks counted and answers each block in the order asked.
   A very common word is one entry a block, so it makes no part large.  There are no more request rows
   than entries, however many parts there are.
3. *Scores*: each block meets its answers and scores its own documents.

Parts hold about ``PART_TOKENS`` tokens and shuffles have as many partitions as there are parts or
blocks, up to ``MAX_PLACES``: then a partition holds several, which a task works off one by one, so what a task holds stays alike at any
size.  Up to that number the driver knows the blocks' numbers, beyond it only how many there are.  Blocks and answers are deleted once the scores are written.  A document is never cut, so a block is as large as its
largest document at least.  What is gathered (distinct words and bigrams by block) grows with the
corpus; to the driver go only the totals and a histogram of bounded size for the weights.  Words are
told apart by 64 bits of a hash, bigrams by 64 bits and, independently, by their part.

Defined results: null text counts as empty, which is its end token alone; without training
documents all counts are zero and each token scores log10 of 1 over 1; repeated rows count and
score each, and each subtracts only itself; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import drop_written, fold, ship, written

#: Partitions of a shuffle at most; beyond that many blocks or parts a partition holds several, one after the other.
MAX_PLACES = 4096
BLOCK_TOKENS, PART_TOKENS, BUCKETS, ROUNDS, GRAIN = 1_000_000, 4_000_000, 24, 40, 4
#: Folds of the ids: one is tested, one of the others is held out for the weights.
PARTS, TESTED, HELD = 5, 1, 0
COUNTED_ROLE, HELD_ROLE, TESTED_ROLE = 0, 1, 2
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
END = b"\n"
BLOCK = "block long, role int, n_tokens long, doc_ids array<long>, lengths binary, words binary, tokens binary"
REQUEST = "place long, part int, block long, role int, words binary, word_counts binary, pairs binary, pair_counts binary"
REPLY = "place long, block long, role int, part int, words_counted binary, words_held binary, pairs_counted binary, pairs_held binary, v_counted long, v_all long, n_counted long, n_all long"
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeezed(x: np.ndarray, raw: int = 0) -> bytes:
    """Numbers from 0 on as byte planes, as many as the largest needs; all but the lowest ``raw`` ones are compressed."""
    x = np.ascontiguousarray(x).astype("<u8")
    planes = max(1, raw, (int(x.max()).bit_length() + 7) // 8 if len(x) else 0)
    cut = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return bytes([planes, raw]) + cut[:raw].tobytes() + zlib.compress(cut[raw:].tobytes(), 1) + len(x).to_bytes(8, "little")


def numbers(packed: bytes) -> np.ndarray:
    """What ``squeezed`` packed."""
    planes, raw, n = packed[0], packed[1], int.from_bytes(packed[-8:], "little")
    out = np.zeros((n, 8), np.uint8)
    low = np.frombuffer(packed, np.uint8, raw * n, 2).reshape(raw, n)
    high = np.frombuffer(zlib.decompress(packed[2 + raw * n : -8]), np.uint8).reshape(planes - raw, n)
    out[:, :raw], out[:, raw:planes] = low.T, high.T
    return out.reshape(-1).view("<u8")


def squeezed_keys(x: np.ndarray) -> bytes:
    """Rising 64-bit keys, by their differences: the low bytes are noise and stay as they are."""
    return squeezed(np.diff(x, prepend=np.uint64(0)), 5)


def keys_of(packed: bytes) -> np.ndarray:
    return np.cumsum(numbers(packed), dtype="<u8")


def stirred(x: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of a hash."""
    x = (x ^ (x >> np.uint64(32)) ^ np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class BlockMaker:
    """Collects documents of one role until they make a block."""

    def __init__(self, role: int):
        self.role = role
        self.clear()

    def clear(self) -> None:
        self.ids, self.tokens, self.docs, self.lengths = {END: 0}, array("I"), [], array("I")

    def add(self, doc_id: int | None, text: str | None) -> None:
        ids = self.ids
        words = WORD.findall(text.encode().lower()) if text else []
        self.tokens.extend([ids.setdefault(w, len(ids)) for w in words])
        self.tokens.append(0)
        self.docs.append(doc_id)
        self.lengths.append(len(words) + 1)

    def row(self, block: int) -> dict:
        words = np.fromiter(map(xxhash.xxh64_intdigest, self.ids), "<u8", len(self.ids))
        out = {"block": block, "role": self.role, "n_tokens": len(self.tokens), "doc_ids": self.docs, "lengths": squeezed(np.array(self.lengths, "<u4")), "words": words.tobytes(), "tokens": squeezed(np.array(self.tokens, "<u4"))}
        self.clear()
        return out


class BlockTypes:
    """A block's tokens, and its distinct words and bigrams in the order in which they are asked for."""

    def __init__(self, words: bytes, tokens: bytes, parts: int):
        self.hashes = np.frombuffer(words, "<u8")
        self.tokens = numbers(tokens).astype(np.int64)
        # each document ends with the end token, which is the next one's context
        self.before = np.concatenate(([0], self.tokens[:-1]))
        pairs, self.pair_of, self.pair_counts = np.unique(self.before << 32 | self.tokens, return_inverse=True, return_counts=True)
        self.context, self.word = pairs >> 32, pairs & 0xFFFFFFFF
        self.word_counts = np.bincount(self.tokens, minlength=len(self.hashes))
        first, second = self.hashes[self.context], self.hashes[self.word]
        self.pair_keys = stirred(stirred(first, 1) + second, 2)
        self.word_order, self.word_cuts = self._dealt(stirred(self.hashes, 3), self.hashes, parts)
        self.pair_order, self.pair_cuts = self._dealt(stirred(stirred(second, 4) + first, 5), self.pair_keys, parts)

    @staticmethod
    def _dealt(dealing: np.ndarray, keys: np.ndarray, parts: int) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
        """The order by part and key, and where each part that gets anything stands in it."""
        part = ((dealing >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        order = np.lexsort((keys, part))
        some, starts = np.unique(part[order], return_index=True)
        return order, {k: (i, j) for k, i, j in zip(some.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)])}

    def put_back(self, order: np.ndarray, answers: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.concatenate(answers) if answers else []
        return out

    def own_counts(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each token's context, bigram and word occur in its own document."""
        doc = np.repeat(np.arange(len(lengths)), lengths)
        words, at, n = np.unique(doc * len(self.hashes) + self.tokens, return_inverse=True, return_counts=True)
        contexts = n[np.searchsorted(words, doc * len(self.hashes) + self.before)]
        _, pair_at, pair_n = np.unique(doc * max(1, len(self.word)) + self.pair_of.reshape(-1), return_inverse=True, return_counts=True)
        return contexts, pair_n[pair_at.reshape(-1)], n[at.reshape(-1)]


def bucket_of(seen: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then one bucket for each doubling."""
    return np.where(seen > 0, np.minimum(1 + np.floor(np.log2(np.maximum(seen, 1))), BUCKETS - 1), 0).astype(np.int64)


def learn_weights(histogram: list[tuple[int, int, int, int]], uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """EM: for each bucket the weights of bigram, unigram and uniform estimate.

    ``histogram``: (bucket, grain of the bigram estimate's -log2 or -1, that of the unigram one, count).
    A bucket without held-out tokens takes the weights of all buckets together.
    """
    h = np.array(histogram, np.float64).reshape(-1, 4)
    p = np.stack([np.where(h[:, k] < 0, 0.0, np.exp2(-np.maximum(h[:, k], 0) / GRAIN)) for k in (1, 2)] + [np.full(len(h), uniform)], axis=1)

    def fit(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        w = start
        if rows.any():
            for _ in range(rounds):
                share = p[rows] * w
                share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
                w = (share * h[rows, 3:4]).sum(axis=0)
                w = np.maximum(w / max(w.sum(), 1e-300), 1e-7)
                w /= w.sum()
        return w

    pooled = fit(np.ones(len(h), bool), np.array([0.4, 0.5, 0.1]))
    weights = np.stack([fit(h[:, 0] == b, pooled) for b in range(BUCKETS)])
    weights[0] = np.array([0, *weights[0, 1:]]) / weights[0, 1:].sum()  # a context never seen has no bigram estimate
    return weights


# --- Spark --------------------------------------------------------------------------------------


def slots(spark: SparkSession, n: int) -> list[int]:
    """Keys for slots 0 to n - 1: ``repartition(n, key)`` puts each into a partition of its own.

    Numbers are tried in order until each remainder of their hash has one, so no task gets two parts or
    blocks by chance; a slot that none hits (hardly ever) gets a number of its own.  Only for ``MAX_PLACES`` slots at
    most: beyond that many parts or blocks share a partition, dealt by the hash of their number.
    """
    tried = spark.range(n * (n.bit_length() + 8)).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("slot")).agg(F.min("id").alias("key"))
    found = {r["slot"]: r["key"] for r in tried.collect()}
    return [found.get(k, k - n) for k in range(n)]


def make_blocks(docs: DataFrame, role: Column, block_tokens: int) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers, base, n = [BlockMaker(r) for r in range(3)], TaskContext.get().partitionId() << 32, 0
        schema = pa.schema([("block", pa.int64()), ("role", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary())])
        for batch in batches:
            for doc_id, r, text in zip(*(c.to_pylist() for c in batch.columns)):
                makers[r].add(doc_id, text)
                if len(makers[r].tokens) >= block_tokens:
                    yield pa.RecordBatch.from_pylist([makers[r].row(base + n)], schema)
                    n += 1
        for maker in makers:
            if maker.docs:
                yield pa.RecordBatch.from_pylist([maker.row(base + n)], schema)
                n += 1

    return docs.select(F.col("doc_id").cast("long"), role.cast("int").alias("role"), F.col("text").cast("string")).mapInArrow(run, BLOCK)


def ask(blocks: DataFrame, parts: int, keys: list[int] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("place", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("role", pa.int32()), *((x, pa.binary()) for x in ("words", "word_counts", "pairs", "pair_counts"))])
        for batch in batches:
            for row in batch.to_pylist():
                t, rows = BlockTypes(row["words"], row["tokens"], parts), []
                for k in sorted(t.word_cuts.keys() | t.pair_cuts.keys()):
                    w, p = (order[slice(*cuts.get(k, (0, 0)))] for order, cuts in ((t.word_order, t.word_cuts), (t.pair_order, t.pair_cuts)))
                    rows.append({"place": keys[k] if keys else k, "part": k, "block": row["block"], "role": row["role"], "words": squeezed_keys(t.hashes[w]), "word_counts": squeezed(t.word_counts[w]), "pairs": squeezed_keys(t.pair_keys[p]), "pair_counts": squeezed(t.pair_counts[p])})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return blocks.select("block", "role", "words", "tokens").mapInArrow(run, REQUEST)


def answer(requests: DataFrame, parts: int, places: Broadcast | None) -> DataFrame:
    def totals(keys: list[np.ndarray], counts: list[np.ndarray], roles: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate(counts).astype(np.float64)
        role = np.repeat(roles, [len(k) for k in keys])
        return at, *(np.bincount(at, n * (role == r), len(found)).astype("<u8") for r in (COUNTED_ROLE, HELD_ROLE))

    def add_up(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        roles = [r["role"] for r in rows]
        words, pairs = [keys_of(r["words"]) for r in rows], [keys_of(r["pairs"]) for r in rows]
        w_at, w_counted, w_held = totals(words, [numbers(r["word_counts"]) for r in rows], roles)
        p_at, p_counted, p_held = totals(pairs, [numbers(r["pair_counts"]) for r in rows], roles)
        both, out, w, p = w_counted + w_held, [], 0, 0
        for k, r in enumerate(rows):
            wi, pi = w_at[w : w + len(words[k])], p_at[p : p + len(pairs[k])]
            w, p = w + len(words[k]), p + len(pairs[k])
            first = k == 0  # the part's totals, once
            out.append({
                "place": places.value[r["block"]] if places else r["block"], "block": r["block"], "role": r["role"], "part": r["part"], "words_counted": squeezed(w_counted[wi]), "words_held": squeezed(w_held[wi]), "pairs_counted": squeezed(p_counted[pi]), "pairs_held": squeezed(p_held[pi]),
                "v_counted": first * int((w_counted > 0).sum()), "v_all": first * int((both > 0).sum()), "n_counted": first * int(w_counted.sum()), "n_all": first * int(both.sum()),
            })
        binary = ("words_counted", "words_held", "pairs_counted", "pairs_held")
        schema = pa.schema([("place", pa.int64()), ("block", pa.int64()), ("role", pa.int32()), ("part", pa.int32()), *((x, pa.binary()) for x in binary), *((x, pa.int64()) for x in ("v_counted", "v_all", "n_counted", "n_all"))])
        return pa.Table.from_pylist(out, schema)

    return requests.repartition(min(parts, MAX_PLACES), "place").groupBy("place").applyInArrow(add_up, REPLY)


def answers_of(types: BlockTypes, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = replies.sort_by("part").select(["words_counted", "words_held", "pairs_counted", "pairs_held"]).to_pydict()
    words = [types.put_back(types.word_order, [numbers(x) for x in rows[c]]) for c in ("words_counted", "words_held")]
    pairs = [types.put_back(types.pair_order, [numbers(x) for x in rows[c]]) for c in ("pairs_counted", "pairs_held")]
    return *words, *pairs


def meet(blocks: DataFrame, replies: DataFrame, places: Broadcast | None):
    """Each block with its answers: a block to a partition, or ``MAX_PLACES`` partitions of many blocks each."""
    if places is None:
        n, placed = MAX_PLACES, blocks.withColumn("place", F.col("block"))
    else:
        n = max(1, len(places.value))
        # one narrow row for each block
        placed = blocks.join(F.broadcast(blocks.sparkSession.createDataFrame(list(places.value.items()), "block long, place long")), "block")
    ours, theirs = (df.repartition(n, "place").groupBy("place") for df in (placed, replies))
    return ours.cogroup(theirs)


def held_out_histogram(blocks: DataFrame, replies: DataFrame, places: Broadcast | None, parts: int, n_counted: int) -> DataFrame:
    """Counts of held-out tokens by context bucket and grains of the bigram and unigram estimates."""

    def grain(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.rint(-np.log2(np.maximum(p, 1e-300)) * GRAIN), -1).astype(np.int64)

    def run(block: pa.Table, got: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        t = BlockTypes(row["words"], row["tokens"], parts)
        words, _, pairs, _ = answers_of(t, got)
        seen = words[t.context]
        keys = np.stack([bucket_of(seen), grain(pairs / np.maximum(seen, 1)), grain(words[t.word] / max(1, n_counted))], axis=1)
        cells, at = np.unique(keys, axis=0, return_inverse=True)
        n = np.bincount(at.reshape(-1), t.pair_counts, len(cells)).astype(np.int64)
        return pa.table({"bucket": cells[:, 0], "two": cells[:, 1], "one": cells[:, 2], "n": n})

    held = meet(*(df.where(F.col("role") == HELD_ROLE) for df in (blocks.select("block", "role", "words", "tokens"), replies)), places)
    return held.applyInArrow(run, "bucket long, two long, one long, n long").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))


def score_documents(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its tokens, base score and interpolated log10 probability."""
    part = fold(docs["doc_id"], PARTS)
    role = F.when(part == TESTED, TESTED_ROLE).when(part == HELD, HELD_ROLE).otherwise(COUNTED_ROLE)
    blocks = written(make_blocks(docs, role, block_tokens), "lm-blocks")
    n_blocks, n_tokens = blocks.agg(F.count("*"), F.sum("n_tokens")).first()
    # a block's distinct words and bigrams number at most twice its tokens
    parts, spark = max(1, -(-(n_tokens or 0) // part_tokens)), docs.sparkSession
    places = None
    if n_blocks <= MAX_PLACES:
        ids = sorted(r["block"] for r in blocks.select("block").collect())  # ``MAX_PLACES`` at most
        places = spark.sparkContext.broadcast(dict(zip(ids, slots(spark, max(1, n_blocks)))))
    replies = written(answer(ask(blocks, parts, slots(spark, parts) if parts <= MAX_PLACES else None), parts, places), "lm-replies")
    v_counted, v_all, n_counted, n_all = (int(x or 0) for x in replies.agg(*(F.sum(c) for c in ("v_counted", "v_all", "n_counted", "n_all"))).first())
    # at most BUCKETS x (grains + 1)^2 rows, whatever the corpus
    found = held_out_histogram(blocks, replies, places, parts, n_counted).collect()
    weights = learn_weights([tuple(r) for r in sorted(found)], 1 / (v_counted + 1))

    def run(block: pa.Table, got: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        t, tested = BlockTypes(row["words"], row["tokens"], parts), row["role"] == TESTED_ROLE
        words, words_held, pairs, pairs_held = answers_of(t, got)
        words, pairs = words + words_held, pairs + pairs_held
        lengths = numbers(row["lengths"]).astype(np.int64)
        starts, n = np.concatenate(([0], np.cumsum(lengths)[:-1])), len(lengths)
        context, pair, word = words[t.before], pairs[t.pair_of.reshape(-1)], words[t.tokens]
        others = np.full(n, n_all) if tested else n_all - lengths
        if not tested:
            context, pair, word = (all_of - own for all_of, own in zip((context, pair, word), t.own_counts(lengths)))
        w = weights[bucket_of(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / np.repeat(np.maximum(others, 1), lengths) + w[:, 2] / (v_all + 1)
        base = np.log10((words + 0.5) / (n_all + 0.5 * (v_all + 1)))
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array([tested] * n), "n_tokens": lengths, "n_known": np.add.reduceat((words > 0)[t.tokens].astype(np.int64), starts),
            "train_tokens": np.full(n, n_all), "base_score": np.add.reduceat(base[t.tokens], starts), "score": np.add.reduceat(np.log10(p), starts),
        })

    scores = written(meet(blocks, replies, places).applyInArrow(run, SCORE), "lm-scores")
    drop_written(blocks)
    drop_written(replies)
    return scores

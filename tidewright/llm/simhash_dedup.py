"""SimHash near-dedup: bit-sliced comparison of the distinct fingerprints, then connected components.

Fingerprints of equal value are one node from the start, so a group of copies costs one node however
large it is.  Two nodes at ``RADIUS`` differing bits or fewer agree on at least two of four 16-bit
blocks, so each node goes to six buckets, one for each pair of blocks.  Buckets of up to ``SLICED``
nodes are compared bit-sliced: 64 vertical bit planes hold fingerprints, one machine word a plane for
each block of 64; the distances of a whole block are kept in carry-save counters (ones, twos,
overflow) over the planes, and a block is abandoned when every member has overflowed the radius.  A
larger bucket's members are queries against the bucket's planes, and it reports a spanning forest of
its links, never all pairs; buckets of up to ``SMALL`` nodes, which are nearly all of them, are
compared many at a time, the lanes of the planes being their pairs.

Larger buckets are found beforehand by counting and go another exact way: each of their nodes is
sent to itself and to its single-bit neighbours in the two blocks the bucket leaves open.  Two
nodes of a bucket lie within two bits of each other if and only if they meet at such a place, and
no place gathers more than 33 nodes of a bucket.

Components come from alternating large-star and small-star steps over the edges, each a join and an
aggregation, written to the shared folder.  A star with very many distinct fingerprints is a hot key
of the joins; Spark's skew handling (``spark.sql.adaptive.skewJoin``) splits it, as the other side has
one row for it.

Defined results: null and wordless texts have fingerprint zero and link like any other; repeated
rows share their component; a null doc_id counts in no minimum and gets its fingerprint's
component (null if no row there has an id); extra columns are ignored; an empty table gives an empty
result.  ``without_copies`` keeps one row of each component, with all its columns, clashing names or
not: that of the smallest doc_id (a null one comes last), of equal ids that of the smallest
fingerprint, and of rows equal in both the one whose values hash lowest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import drop_written, fresh_name, ship, written

SHINGLE, RADIUS, SEED, SLICED, SMALL = 3, 2, 42, 512, 8
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BLOCKS = tuple(combinations(range(4), 2))
PIECE = 1 << 16


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text, unsigned."""
    words = WORD.findall(text.encode().lower()) if text else []
    if not words:
        return 0
    count, n = np.zeros(64, np.int64), max(1, len(words) - k + 1)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        h = np.fromiter((digest(b" ".join(words[i : i + k]), SEED) for i in range(at, min(n, at + PIECE))), np.dtype(">u8"))
        count += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def sliced_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest (i, j), i < j, of the pairs at ``radius`` (under 4) or fewer bits, compared bit-sliced."""
    n = len(fps)
    words = -(-n // 64)
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8)).reshape(n, 64)
    padded = np.zeros((words * 64, 64), np.uint8)
    padded[:n] = bits
    planes = np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view("<u8")  # 64 planes, a machine word for each 64 members
    live = np.zeros(words * 64, np.uint8)
    live[:n] = 1
    members = np.packbits(live, bitorder="little").view("<u8")
    # planes on which all members agree can't tell any two apart
    varied = np.flatnonzero(bits.any(axis=0) & ~bits.all(axis=0))
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in range(n - 1):
        first = (i + 1) // 64
        blocks = np.arange(first, words)
        ones, twos = np.zeros(len(blocks), "<u8"), np.zeros(len(blocks), "<u8")
        over = ~members[first:]
        if first * 64 <= i:
            over[0] |= np.uint64((1 << (i % 64 + 1)) - 1)
        for step, plane in enumerate(varied):
            row = planes[plane, blocks]
            differ = ~row if bits[i, plane] else row
            carry = ones & differ
            ones = ones ^ differ
            over = over | (twos & carry)
            twos = twos ^ carry
            if radius < 3:
                over = over | (twos & ones) if radius == 2 else over | twos if radius == 1 else over | twos | ones
            if step & 3 == 3:
                going = over != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not going.all():
                    blocks, ones, twos, over = blocks[going], ones[going], twos[going], over[going]
                    if not len(blocks):
                        break
        for block, near in zip(blocks.tolist(), (~over).tolist()):
            while near:
                low = near & -near
                j = block * 64 + low.bit_length() - 1
                near ^= low
                if (a := find(i)) != (b := find(j)):
                    root[max(a, b)] = min(a, b)
                    links.append((i, j))
    return links


def sliced_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) lie at ``radius`` (under 4) or fewer bits, 64 pairs to a machine word."""
    n, words = len(a), -(-len(a) // 64)
    lanes = np.full((words * 64, 64), 1, np.uint8)  # lanes without a pair overflow
    lanes[:n] = np.unpackbits((a ^ b).astype(">u8").view(np.uint8)).reshape(n, 64)
    planes = np.ascontiguousarray(np.packbits(lanes.T, axis=1, bitorder="little")).view("<u8")
    blocks = np.arange(words)
    ones, twos, over = (np.zeros(words, "<u8") for _ in range(3))
    near = np.zeros(words, "<u8")
    for step, plane in enumerate(planes):
        differ = plane[blocks]
        carry = ones & differ
        ones = ones ^ differ
        over = over | (twos & carry)
        twos = twos ^ carry
        over = over | ((twos & ones) if radius == 2 else twos if radius == 1 else (twos | ones) if radius == 0 else 0)
        if step & 7 == 7:
            going = over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not going.all():
                blocks, ones, twos, over = blocks[going], ones[going], twos[going], over[going]
    near[blocks] = ~over
    return np.unpackbits(near.view(np.uint8), bitorder="little")[:n].astype(bool)


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked members of the same bucket; ``keys`` are sorted."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    left, right = [], []
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        links = np.array(sliced_links(fps[start : start + size], radius), np.int64).reshape(-1, 2) + start
        left.append(links[:, 0])
        right.append(links[:, 1])
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, SMALL):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:])
        if not len(at):
            break
        at = at[sliced_pairs(fps[at], fps[at + step], radius)]
        left.append(at)
        right.append(at + step)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


# --- Spark --------------------------------------------------------------------------------------


def with_fingerprint(docs: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with all its columns and the fingerprint of ``text`` under ``name``."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and ``fp``, the fingerprint's bits as a long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def block_of(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * k).bitwiseAND(0xFFFF)


def edges_of(nodes: DataFrame, sliced: int = SLICED) -> DataFrame:
    """Links (a, b), a < b, of a spanning forest for each bucket over ``nodes`` (fp, rep)."""
    keyed = nodes.select(
        "fp", "rep",
        F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("pair"), F.shiftleft(block_of(F.col("fp"), i), 16).bitwiseOR(block_of(F.col("fp"), j)).alias("value")) for n, (i, j) in enumerate(BLOCKS)))).alias("k"),
    ).select((F.col("k.pair") * (1 << 32) + F.col("k.value")).alias("key"), "fp", "rep")
    counts = written(keyed.groupBy("key").count().where("count > 1"), "simhash-buckets")
    some = keyed.join(counts, "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets as they come, sorted; a bucket cut by a batch's end waits for the next one."""
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns)]
            done = int(np.searchsorted(held[0], held[0][-1]))
            yield linked(*(h[:done] for h in held))
            held = [h[done:] for h in held]
        yield linked(*held)

    def linked(keys: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
        i, j = bucket_links(keys, np.ascontiguousarray(fps).view(np.uint64)) if len(keys) else (np.empty(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(reps[i], reps[j])), pa.array(np.maximum(reps[i], reps[j]))], names=["a", "b"])

    usual = some.where(F.col("count") <= sliced).select("key", "fp", "rep").repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
    # the two blocks a bucket leaves open, for each pair of blocks: their bits
    free = F.create_map(*(x for n, pair in enumerate(BLOCKS) for x in (F.lit(n), F.array(*(F.lit(_long(1 << (16 * k + bit))) for k in range(4) if k not in pair for bit in range(16))))))
    pair = F.shiftright("key", 32).cast("int")
    places = some.where(F.col("count") > sliced).select("key", "fp", "rep", F.explode(F.concat(F.array(F.lit(0).cast("long")), F.element_at(free, pair))).alias("flip")).select("key", F.col("fp").bitwiseXOR(F.col("flip")).alias("place"), "rep")
    meet = places.groupBy("key", "place").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("all")).where(F.size("all") > 1)
    hot = meet.select("a", F.explode("all").alias("b")).where("a <> b")
    return usual.unionByName(hot).distinct()


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; root is the component's smallest node."""
    now, mark = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), "components"), None
    for _ in range(rounds):
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        mid = written(large, "components")
        down = mid.groupBy("v").agg(F.min("u").alias("m"))
        small = mid.join(down, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").unionByName(down.select("v", F.col("m").alias("u"))).distinct()
        after = written(small, "components")
        drop_written(mid)
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        drop_written(now)
        now = after
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("components have not settled")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def component_of(nodes: DataFrame, sliced: int = SLICED) -> DataFrame:
    """(fp, root) for each distinct fingerprint of ``nodes`` (fp); root is the component's smallest fingerprint."""
    roots = components(edges_of(nodes.select("fp", F.col("fp").alias("rep")), sliced))
    return nodes.select("fp").join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def link_components(docs: DataFrame, shingle: int = SHINGLE, sliced: int = SLICED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fp and component_id (smallest doc_id reachable)."""
    prints = written(fingerprints(docs, shingle), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    named = written(nodes.join(component_of(nodes, sliced), "fp"), "simhash-named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def digest(linked: DataFrame) -> DataFrame:
    """The digest columns of the ``op7`` query, from ``link_components``."""
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_copies(docs: DataFrame, shingle: int = SHINGLE, sliced: int = SLICED) -> DataFrame:
    """``docs`` with one row of each component; which one, the module's text says.

    Only the rows that share id and fingerprint with another kept one are grouped; all others pass by a
    semi-join with one narrow row for each component.
    """
    fp, of = fresh_name("fp", docs.columns), fresh_name("rows", docs.columns)
    rows = written(with_fingerprint(docs, fp, shingle), "simhash-rows")
    ids = written(rows.groupBy(F.col(fp).alias("fp"), F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "simhash-ids")
    named = ids.join(component_of(ids.select("fp").distinct(), sliced), "fp")
    order = F.struct(F.col("id").isNull(), "id", "fp")
    kept = named.groupBy("root").agg(F.min_by(F.struct("fp", "id", "n"), order).alias("k")).select(F.col("k.fp").alias("_k_fp"), F.col("k.id").alias("_k_id"), F.col("k.n").alias("_k_n"))
    kept = written(kept, "simhash-kept")
    same = (rows[fp] == F.col("_k_fp")) & rows["doc_id"].eqNullSafe(F.col("_k_id"))
    once = rows.join(kept.where("_k_n = 1"), same, "left_semi").select(docs.columns)
    whole = F.struct(*docs.columns)
    several = rows.join(kept.where("_k_n > 1"), same, "left_semi").groupBy(fp).agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias(of)).select(f"{of}.*")
    return once.unionByName(several)

"""Mixing sources to target weights, in DataFrame functions throughout.

The words of a source form one stream, its documents in a pseudorandom order, and the stream is cut into
blocks of ``block`` words (the last one is shorter).  A target says how many words the mix takes of each
source; it is met by whole passes over the source's blocks and one part pass, whose last slot is cut to
the word.  All slots of the mix form output shards of ``shard`` slots.  A shard's counts by source are drawn
multinomially, given that the whole mix meets its targets: independent draws would miss a target of n slots
by about the root of n, and break the limit of repeats.  (Each slot of the mix goes through a pseudorandom
permutation of all slots; the source in whose range it falls is drawn.)  A slot's number among its source's
slots then goes through that source's own permutation of block numbers, another one for each pass, and the
block is joined by (source, number).

The permutations are swap-or-not shuffles: ``ROUNDS`` rounds, in each of which x and key - x change places
if a bit that depends on the larger of both says so.  They work on any number of items without tables, as
column expressions, and can be undone by the same rounds in reverse order.

At scale: texts are read once for their word counts, and everything later moves rows of a few numbers.
Places in a source's stream come from sums over ``BINS`` bins a source, so a source with a third of all
documents is no single group; equal rows (id, source and size) are counted before they are dealt.  Blocks
are met by number, at most three slots to a block.  The table of sources (one row each) is the only one
that a single task orders.

Targets: weights repeat over the sources in code-point order, the null source last; a source's target stops at
``limit`` times its size, and what is over is shared by weight among the rest until none is above.

Defined results: null, empty and blank texts have size 0 and nothing is taken of them; a null id or source is a value
like others; of rows with the same id, source and size each has its own part of the stream, so they may
differ in ``taken``; an empty table, or one without any word, gives targets of 0; extra columns are ignored.
The same rows give the same mix, in whatever order they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

WEIGHTS, LIMIT, BLOCK, SHARD, BINS, STRETCHES, ROUNDS = (5, 2, 1), 3, 256, 1024, 1024, 4096, 24
#: The bits come from a polynomial modulo this prime, so that products stay within a long.
PRIME = (1 << 31) - 1
WORD = r"[^\x20\x09-\x0D]+"


def div(a: Column, b: Column | int) -> Column:
    """Integer division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def mixed(x: Column, salt: int = 0) -> Column:
    """A pseudorandom number below ``PRIME`` for a long of 0 or more."""
    a, b = 1103515245 + 65537 * salt, 12345 + salt
    y = (x.bitwiseAND(F.lit(PRIME)) * F.lit(a) + F.shiftright(x, 31) + F.lit(b)) % F.lit(PRIME)
    z = (y * y + F.lit(a)) % F.lit(PRIME)
    return (z * y + F.lit(b)) % F.lit(PRIME)


def keys(seed: Column) -> Column:
    """The keys of the rounds of the permutation that ``seed`` (0 or more) names."""
    rounds = F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))
    return F.transform(rounds, lambda r: mixed(seed * ROUNDS + r, 1) * F.lit(PRIME) + mixed(seed * ROUNDS + r, 2))


def shuffled(x: Column, n: Column, rounds: Column, undo: bool = False) -> Column:
    """The item of ``n`` at place ``x`` in the permutation with these keys; ``undo``: the place of item ``x``."""

    def swapped(at: Column, key: Column) -> Column:
        other = F.pmod(key % n - at, n)
        larger = F.greatest(at, other)
        low = larger.bitwiseAND(F.lit(PRIME)) + F.shiftright(larger, 31)
        bit = (low * key.bitwiseAND(F.lit(PRIME)) + F.shiftright(key, 31)) % F.lit(PRIME)
        return F.when(bit.bitwiseAND(F.lit(1 << 20)) == 0, at).otherwise(other)

    return F.when(n > 0, F.aggregate(F.reverse(rounds) if undo else rounds, x.cast("long"), swapped))


# --- sizes, targets and places


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, copies): rows with the same three are counted together."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))


def targets(counted: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """One row a source: its number, size, target and slots; ``begin`` is where its slots begin among all."""
    every = Window.partitionBy()
    named, filled = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "src")
    exact = "decimal(38,0)"
    table = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    table = table.withColumn("src", (F.row_number().over(named) - 1).cast("long"))
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")).cast("long"))
    table = table.withColumn("most", F.col("words") * limit).withColumn("ratio", F.col("most") / F.col("weight")).withColumn("total", F.sum("words").over(every))
    # in ascending order of limit over weight, those that the level of the rest still covers are stopped
    before = lambda c: F.sum(c).over(filled) - F.col(c)
    table = table.withColumn("left", F.col("total") - before("most")).withColumn("shares", F.sum("weight").over(every) - before("weight"))
    table = table.withColumn("stopped", F.col("most").cast(exact) * F.col("shares") <= F.col("left").cast(exact) * F.col("weight"))
    level = F.col("total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("most"))).over(every), F.lit(0))
    open_ = F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(every)
    target = F.when(F.col("stopped"), F.col("most").cast("double")).otherwise(F.col("weight") * level.cast("double") / open_)
    table = table.withColumn("target", target).withColumn("blocks", div(F.col("words") + (block - 1), block))
    # whole passes, then as many slots as the rest needs; the short block may be among them
    want = F.least(F.floor(F.col("target") + 0.5), F.col("most"))
    some = F.col("words") > 0
    table = table.withColumn("passes", F.when(some, div(want, F.col("words"))).otherwise(0)).withColumn("rest", F.when(some, want % F.col("words")).otherwise(0))
    table = table.withColumn("short", F.col("blocks") * block - F.col("words")).withColumn("short_at", shuffled(F.col("blocks") - 1, F.col("blocks"), keys(seed(F.col("src"), F.col("passes"), limit)), undo=True))
    plain = div(F.col("rest") + (block - 1), block)
    part = F.when(F.col("rest") == 0, 0).when(plain <= F.col("short_at"), plain).otherwise(div(F.col("rest") + F.col("short") + (block - 1), block))
    table = table.withColumn("part", part).withColumn("over", F.when(F.col("part") > 0, F.col("part") * block - F.when(F.col("part") > F.col("short_at"), F.col("short")).otherwise(0) - F.col("rest")).otherwise(0))
    table = table.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("part"))
    table = table.withColumn("begin", F.sum("slots").over(Window.orderBy("src")) - F.col("slots"))
    return table.select("source", "src", "words", "target", "blocks", "slots", "begin", "over")


def seed(src: Column, turn: Column, limit: int = LIMIT) -> Column:
    """What names a source's permutation in a pass; 0 is the permutation of all slots."""
    return src * (limit + 1) + turn + 1


def placed(counted: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, size, src, start): where each document begins in its source's stream, one row a document."""
    key = F.coalesce(F.col("doc_id"), F.lit(-1)).bitwiseAND(F.lit((1 << 63) - 1))
    rows = counted.join(sources.select("source", "src"), counted["source"].eqNullSafe(sources["source"])).select("doc_id", "src", "size", "copies", (mixed(key, 4) % BINS).alias("bin"), mixed(key, 5).alias("turn"))
    words = F.col("size") * F.col("copies")
    bins = rows.groupBy("src", "bin").agg(F.sum(words).alias("words"))
    bins = bins.select("src", "bin", (F.sum("words").over(Window.partitionBy("src").orderBy("bin")) - F.col("words")).alias("first"))
    within = Window.partitionBy("src", "bin").orderBy("turn", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum(words).over(within) - words).join(bins, ["src", "bin"])
    each = rows.select("doc_id", "size", "src", "within", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return each.select("doc_id", "size", "src", "copy", (F.col("first") + F.col("within") + F.col("copy") * F.col("size")).alias("start"))


# --- the mix


def drawn(sources: DataFrame, total: int, shard: int = SHARD, limit: int = LIMIT) -> DataFrame:
    """Every slot of the mix (shard, slot) with the source drawn for it and the block there; both steps are written, so that no later filter works the permutations out again."""
    spark = sources.sparkSession
    shards = -(-total // shard)
    rows = spark.range(0, shards, 1, max(1, min(shards, max(spark.sparkContext.defaultParallelism, shards // 1000)))).withColumnRenamed("id", "shard")
    ends = F.least(F.col("shard") * shard + shard, F.lit(total)) - 1
    rows = rows.select("shard", F.explode(F.sequence(F.col("shard") * shard, ends)).alias("slot"))
    rows = written(rows.withColumn("drawn", shuffled(F.col("slot"), F.lit(total).cast("long"), keys(F.lit(0).cast("long")))), "mix-drawn")
    # the ranges of the sources' passes cover 0 .. total; both sides are met by the stretch of numbers they lie in
    width = max(1, -(-total // STRETCHES))
    last = F.least(F.col("begin") + F.col("slots"), F.col("begin") + (F.col("turn") + 1) * F.col("blocks"))
    turns = sources.where("slots > 0").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("slots") - 1, F.col("blocks")))))
    turns = turns.select("src", "blocks", (F.col("begin") + F.col("turn") * F.col("blocks")).alias("low"), last.alias("high"), keys(seed(F.col("src"), F.col("turn"), limit)).alias("keys"), (F.col("begin") + F.col("slots") - 1).alias("cut"), "over")
    turns = turns.withColumn("stretch", F.explode(F.sequence(div(F.col("low"), width), div(F.col("high") - 1, width))))
    rows = rows.withColumn("stretch", div(F.col("drawn"), width)).join(turns, "stretch").where((F.col("drawn") >= F.col("low")) & (F.col("drawn") < F.col("high")))
    block = shuffled(F.col("drawn") - F.col("low"), F.col("blocks"), F.col("keys"))
    return written(rows.select("shard", "slot", "src", block.alias("block"), F.when(F.col("drawn") == F.col("cut"), F.col("over")).otherwise(0).alias("over")), "mix-slots")


def shard_counts(slots: DataFrame) -> DataFrame:
    """(shard, src, n): the counts drawn for each output shard."""
    return slots.groupBy("shard", "src").agg(F.count("*").alias("n"))


def pieces(places: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, block, doc_id, copy, size, start, at, skip, length): the parts of documents in each block; ``at`` counts within the block, ``skip`` within the document."""
    some = places.where("size > 0")
    cut = some.withColumn("block", F.explode(F.sequence(div(F.col("start"), block), div(F.col("start") + F.col("size") - 1, block))))
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), F.col("block") * block + block)
    return cut.select("src", "block", "doc_id", "copy", "size", "start", (low - F.col("block") * block).alias("at"), (low - F.col("start")).alias("skip"), (high - low).alias("length"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix, the places of the documents and the sources.

    The mix has a row for each piece: shard, slot, src, block, doc_id, copy, size, start (all of the document), at
    (word in the slot), skip (word of the document) and length.
    """
    counted = written(sizes(docs), "mix-sizes")
    sources = written(targets(counted, weights, limit, block), "mix-sources")
    total = sources.agg(F.sum("slots")).first()[0] or 0
    places = written(placed(counted, sources), "mix-places")
    found = drawn(sources, total, shard, limit).join(pieces(places, block), ["src", "block"])
    short = sources.select("src", "words")
    room = F.least(F.lit(block), F.col("words") - F.col("block") * block) - F.col("over")
    found = found.join(short, "src").withColumn("length", F.least(F.col("length"), room - F.col("at"))).where("length > 0")
    return found.select("shard", "slot", "src", "block", "doc_id", "copy", "size", "start", "at", "skip", "length"), places, sources


def digest(found: DataFrame, places: DataFrame, sources: DataFrame) -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mix takes of it, repeats counted."""
    taken = found.groupBy("src", "start").agg(F.sum("length").alias("taken"))
    some, none = places.where("size > 0"), places.where("size = 0")
    rows = some.join(taken, ["src", "start"], "left").select("doc_id", "size", "src", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    rows = rows.unionAll(none.select("doc_id", "size", "src", F.lit(0).cast("long").alias("taken")))
    return rows.join(sources.select("src", F.col("words").alias("source_size"), "target"), "src").select("doc_id", "size", "source_size", "target", "taken")


def texts(docs: DataFrame, found: DataFrame, sources: DataFrame) -> DataFrame:
    """(shard, slot, src, text): the words of each slot, joined by one space."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    rows = rows.withColumn("size", F.regexp_count("text", F.lit(WORD)).cast("long"))
    same = Window.partitionBy("doc_id", "source", "size").orderBy("text")
    rows = rows.withColumn("copy", (F.row_number().over(same) - 1).cast("long"))
    rows = rows.join(sources.select("source", "src"), rows["source"].eqNullSafe(sources["source"])).select("src", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "size", "copy", "text")
    wanted = found.withColumns({"id": F.coalesce("doc_id", F.lit(-1)), "no_id": F.col("doc_id").isNull()})
    words = F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.col("skip").cast("int") + 1, F.col("length").cast("int"))
    parts = wanted.join(rows, ["src", "id", "no_id", "size", "copy"]).select("shard", "slot", "src", "at", F.array_join(words, " ").alias("part"))
    # at most ``block`` pieces a slot
    return parts.groupBy("shard", "slot", "src").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), " ").alias("text"))

"""Benchmark decontamination: a generalised suffix automaton of the normalised test items.

Words are taken from the lower-cased (A-Z) text as UTF-8 bytes.  The automaton holds every item's
words; a document's words stream through it while the longest matching length is tracked.  Where
that length reaches the window (13 words, or a whole item of fewer), the window's words are hit.

The items are dealt by a hash into blocks of about ``BLOCK_CHARS`` code points, and a task builds each
block's automaton, which is written to the shared folder.  The driver takes one automaton at a time
and broadcasts it, so what it holds and what a task holds has a bound.  With one block (test sets of a
few megabytes) a single scan of the documents gives the results and nothing is shuffled.  With several,
each block's scan gives only the texts that it hits, by their digest; their stretches are united and
joined to the documents by a left join.

Defined results: null texts have no words; an item without words has no window; equal items all
count (a null item_id counts as the empty name); repeated documents give repeated results; extra
columns are ignored, and kept by ``without_contaminated``; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh_name, ship, written

WINDOW, COVERAGE, BLOCK_CHARS = 13, 20, 2_000_000
#: Fixed value: what a word is, over UTF-8 bytes (every byte from 0x80 belongs to a word).
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"
HITS = "text_md5 string, starts array<int>, ends array<int>, items array<string>"
TYPES = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class Automaton:
    """A generalised suffix automaton over word ids, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.least = window
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self._mark(coded)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """windows: by state, (length, items) of the windows that end there; along[s]: the nearest marked state on s's suffix links, itself included."""
        found: dict[tuple[int, int], set[str]] = {}
        for name, ids in coded:
            k = min(self.window, len(ids))
            self.least = min(self.least, k)
            for state, matched in self.walk(ids):
                if matched >= k:
                    while self.length[self.link[state]] >= k:
                        state = self.link[state]
                    found.setdefault((state, k), set()).add(name)
        self.windows: dict[int, list[tuple[int, frozenset[str]]]] = {}
        for (state, k), names in found.items():
            self.windows.setdefault(state, []).append((k, frozenset(names)))
        self.along = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.along[s] = s if s in self.windows else self.along[self.link[s]] if s else -1

    def walk(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, longest matching length) after each word."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for w in ids:
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            yield state, matched

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches of words (end exclusive, apart from each other) and the items of their windows."""
        get, least = self.ids.get, self.least
        ids = list(map(get, words))
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        n, at = len(ids), 0
        while at < n:
            # only stretches of known words that are long enough can hold a window
            if at + least > n:
                break
            if (gone := next((k for k in range(at + least - 1, at - 1, -1) if ids[k] is None), -1)) >= 0:
                at = gone + 1
                continue
            end = at + least
            while end < n and ids[end] is not None:
                end += 1
            for k, (state, matched) in enumerate(self.walk(ids[at:end]), at + 1):
                mark = self.along[state]
                while mark > 0:
                    for size, who in self.windows[mark]:
                        if matched >= size:
                            names |= who
                            if spans and k - size <= spans[-1][1]:
                                while spans and k - size <= spans[-1][0]:
                                    spans.pop()
                                if spans and k - size <= spans[-1][1]:
                                    spans[-1] = (spans[-1][0], k)
                                else:
                                    spans.append((k - size, k))
                            else:
                                spans.append((k - size, k))
                    mark = self.along[self.link[mark]]
            at = end + 1
        return spans, names


# --- Spark --------------------------------------------------------------------------------------


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


@lru_cache(maxsize=1)
def revived(blob: bytes) -> Automaton:
    """The automaton, once in each Python worker as long as the same one is asked for."""
    return pickle.loads(zlib.decompress(blob))


def automata(items: DataFrame, window: int, block_chars: int) -> DataFrame:
    """(block, blob): an automaton for each block of items, built in tasks; equal rows count once."""
    ship(items.sparkSession)
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = named.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_chars))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        pairs = sorted(zip(rows.column("id").to_pylist(), rows.column("text").to_pylist()))
        blob = zlib.compress(pickle.dumps(Automaton([(name, words_of(text)) for name, text in pairs], window)), 1)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([blob], pa.binary())})

    dealt = named.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("long"))
    return written(dealt.groupBy("block").applyInArrow(build, "block long, blob binary"), "automata")


def each_automaton(built: DataFrame) -> Iterator[Broadcast]:
    """The blocks' automata, broadcast one after the other; at least one, which may be empty."""
    spark = built.sparkSession
    blocks = sorted(r[0] for r in built.select("block").collect())
    for block in blocks:
        yield spark.sparkContext.broadcast(bytes(built.where(F.col("block") == block).first()["blob"]))
    if not blocks:
        yield spark.sparkContext.broadcast(zlib.compress(pickle.dumps(Automaton([]))))


def hits_of(docs: DataFrame, built: DataFrame) -> DataFrame:
    """(text_md5, starts, ends, items) of the texts of ``docs`` (text) that any block hits, each once."""
    keyed, parts = docs.select(text_key(docs["text"]).alias("text_md5"), F.col("text").cast("string")), []
    for sent in each_automaton(built):

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(key, *revived(sent.value).hits(words_of(text))) for key, text in zip(*(c.to_pylist() for c in batch.columns))]
                rows = [(key, [a for a, _ in spans], [b for _, b in spans], sorted(names)) for key, spans, names in rows if spans]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), *TYPES))], names=["text_md5", "starts", "ends", "items"])

        parts.append(written(keyed.mapInArrow(run, HITS).dropDuplicates(["text_md5"]), "hits"))
        sent.unpersist()
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    # a text has one row for each block at most
    by = found.groupBy("text_md5").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [united(list(zip(a, b))) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([[s[k] for s in xs] for xs in spans], TYPES[k]) for k in (0, 1)), batch.column(3)], names=batch.schema.names)

    return written(by.mapInArrow(unite, HITS), "hits")


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches that ``spans`` cover, in order and apart from each other."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def match(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its words, the hit stretches of words and the items hit."""
    ship(docs.sparkSession)
    built = automata(items, window, block_chars)
    narrow = docs.select(F.col("doc_id").cast("long"), text_key(docs["text"]).alias("text_md5"), F.col("text").cast("string"))
    if built.count() > 1:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(words_of(t)) for t in batch.column(2).to_pylist()], pa.int64())], names=["doc_id", "text_md5", "n_words"])

        counted = narrow.mapInArrow(count, "doc_id long, text_md5 string, n_words long")
        none = {"starts": "array<int>", "ends": "array<int>", "items": "array<string>"}
        return counted.join(hits_of(docs, built), "text_md5", "left").select("doc_id", "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()))
    sent = next(each_automaton(built))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                spans, names = revived(sent.value).hits(words) if words else ([], ())
                for col, x in zip(cols, (len(words), [a for a, _ in spans], [b for _, b in spans], sorted(names))):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), *TYPES)))], names=["doc_id", "n_words", "starts", "ends", "items"])

    return narrow.select("doc_id", "text").mapInArrow(run, SCHEMA)


def digest(matched: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """The digest columns of the ``op6`` query, from ``match``."""
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return matched.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def clean_text(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the given stretches of words: what stands from each first word to each last one."""
    if not text or not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def with_texts(batch: pa.RecordBatch, text: int, new: list[str | None]) -> pa.RecordBatch:
    """``batch`` with other texts, and ``n_chars`` (if there) put right where the text is another."""
    old, names = batch.column(text).to_pylist(), batch.schema.names
    batch = batch.set_column(text, batch.schema.field(text), pa.array(new, batch.schema.field(text).type))
    if "n_chars" in names:
        at = names.index("n_chars")
        n = [n if a == b else len(b) for n, a, b in zip(batch.column(at).to_pylist(), old, new)]
        batch = batch.set_column(at, batch.schema.field(at), pa.array(n, batch.schema.field(at).type))
    return batch


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, without their hit stretches; with one block of items nothing is shuffled."""
    ship(docs.sparkSession)
    text, width = docs.columns.index("text"), len(docs.columns)
    built = automata(items, window, block_chars)

    def judged(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        keep, new = [], []
        for t, found in zip(batch.column(text).to_pylist(), spans):
            n_hit = sum(b - a for a, b in found)
            keep.append(not n_hit or coverage * n_hit < len(words_of(t)))
            new.append(clean_text(t, found) if keep[-1] else t)
        return with_texts(batch, text, new).filter(pa.array(keep, pa.bool_()))

    if built.count() > 1:
        # the stretches and the verdict depend on the text alone
        key, starts, ends = (fresh_name(x, docs.columns) for x in ("md5", "starts", "ends"))
        found = hits_of(docs, built).select(F.col("text_md5").alias(key), F.col("starts").alias(starts), F.col("ends").alias(ends))
        joined = docs.join(found, text_key(docs["text"]) == found[key], "left").select(*docs.columns, starts, ends)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = [list(zip(a or (), b or ())) for a, b in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())]
                yield judged(batch.select(range(width)), spans)

        return joined.mapInArrow(cut, docs.schema)
    sent = next(each_automaton(built))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield judged(batch, [revived(sent.value).hits(words_of(t))[0] if t else [] for t in batch.column(text).to_pylist()])

    return docs.mapInArrow(run, docs.schema)

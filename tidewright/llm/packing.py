"""Packing by best-fit decreasing: a segment tree over remaining capacity finds the tightest open window.

Documents are tokenised whole; one of more than a window's tokens is first cut into full windows
and a rest.  Pieces are dealt by a hash of their place in the written table (not of what they hold, so
equal rows spread like any others) into groups of about ``GROUP_TOKENS`` tokens, so that each group is
packed in one task of bounded size; within a group, pieces go longest first into the open
window they leave least room in, which a segment tree indexed by remaining capacity finds in
log(window) steps.  Only each group's last windows can stay partly empty.

Tokens come from the ``tokenizers`` library.  For a vocabulary that never merges across ASCII white
space (``splits_at_space``, read off its description) a text's new words are encoded together and
remembered (two generations of ``REMEMBERED`` words), a trailing run of full stops and commas apart
from a letter; the ids are those of the whole text.

Defined results: a null or empty text is its end token alone; pieces of equal length are taken in
the order of (doc_id, start, ids_crc32); repeated rows are packed each; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import ship, written

WINDOW, END_ID, GROUP_TOKENS, REMEMBERED = 4096, 2, 8_000_000, 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = f"{PIECES}, sequence_id long, offset long"
GROUP_BYTES = 8 << 20


class WordEncoder:
    """Ids of whole texts, by way of remembered words where the vocabulary allows that."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            description = json.load(f)
        self.by_word = splits_at_space(description)
        # a unit of the pre-tokenizer ends with an id whose piece has the vocabulary's suffix
        suffix = description["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if suffix and piece.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        return next(self.encode_all(pa.array([text], pa.string()))).tobytes()

    def encode_all(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """The ids of each text; distinct words are found for groups of texts of about ``GROUP_BYTES``."""
        if not self.by_word:
            yield from (np.frombuffer(self._whole(t), "<u4") for t in texts.to_pylist())
            return
        filled = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // GROUP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(texts)]
        for low, high in zip(cuts, cuts[1:]):
            part = texts.slice(low, high - low)
            for blank in "\n\t\r":
                part = pc.replace_substring(part, blank, " ")
            words = pc.split_pattern(part, " ")
            coded = words.flatten().dictionary_encode()
            ids, sizes = self._ids_of(coded.dictionary.to_pylist())
            codes = coded.indices.to_numpy()
            ends = np.cumsum(sizes[codes])
            # for each word its ids, from where they stand among those of the distinct words
            moved = (np.cumsum(sizes) - sizes)[codes] - (ends - sizes[codes])
            all_ids = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(moved, sizes[codes])]
            last = np.cumsum(pc.list_value_length(words).to_numpy())
            bounds = np.concatenate(([0], ends))[np.concatenate(([0], last))]
            yield from (all_ids[i:j] for i, j in zip(bounds, bounds[1:]))

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and how many each has."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        self._learn([w for w in words if w not in self.known])
        found = list(map(self.known.__getitem__, words))
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _learn(self, words: list[str]) -> None:
        known, before, apart = self.known, self.before, {}
        for w in words:
            if (ids := before.get(w)) is None:
                apart[w] = tail_apart(w)
            else:
                known[w] = ids
        found = self._cores({core for core, _ in apart.values()})
        for w, (core, tail) in apart.items():
            if tail not in self.tails:
                if len(self.tails) > 1000:
                    self.tails = {"": b""}
                self.tails[tail] = self._whole(tail)
            known[w] = found[core] + self.tails[tail]

    def _cores(self, cores: set[str]) -> dict[str, bytes]:
        """Letters alone are one unit each, so they are encoded in one call and cut where units end."""
        found, letters = {}, [c for c in cores if c.isalpha() and c.lower().isalpha()]
        if letters:
            some = [" ".join(letters[k : k + 200]) for k in range(0, len(letters), 200)]
            ids = np.array([i for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False) for i in e.ids], "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(letters):  # more where normalising makes something else of a letter
                raw = ids.tobytes()
                found = {c: raw[i:j] for c, i, j in zip(letters, [0, *cuts], cuts)}
        return found | {c: self._whole(c) for c in cores if c not in found}


def tail_apart(word: str) -> tuple[str, str]:
    """A trailing run of full stops and commas after a letter stands alone in the pre-tokenizer."""
    core = word.rstrip(".,")
    return (core, word[len(core) :]) if core and core[-1].lower()[-1].isalpha() else (word, "")


def splits_at_space(description: dict) -> bool:
    """True if the pre-tokenizer keeps runs of letters, digits or marks apart and drops white space, so no id depends on both sides of a blank."""
    split = (description.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    normal = (description.get("normalizer") or {}).get("normalizers") or []
    pattern = str((split[0].get("pattern") or {}).get("Regex", ""))
    return (
        split[0].get("type") == "Split" and split[0].get("behavior") == "Removed" and split[0].get("invert") is True and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and [x.get("type") for x in normal] == ["NFC", "Replace", "Lowercase"] and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in description.get("added_tokens", []))
        and description.get("post_processor") is None and split[-1].get("add_prefix_space") is False
    )


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class TightestFit:
    """A segment tree over remaining capacities 1..size: which capacities have an open window."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, window: int) -> None:
        self.open.setdefault(room, []).append(window)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) of the least room that is ``least`` or more."""
        at = least + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        window = self.open[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, window


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; lengths must not rise and none exceeds the window."""
    tree, number, offset, used = TightestFit(window), [], [], 0
    for n in lengths:
        found = tree.take(n)
        if found is None:
            found = (window, used)
            used += 1
        room, at = found
        number.append(at)
        offset.append(window - room)
        if room > n:
            tree.add(room - n, at)
    return number, offset


# --- Spark --------------------------------------------------------------------------------------


def cut(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text): full windows and a rest."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            names, rows, end = batch.column(0).to_pylist(), [], end_id.to_bytes(4, "little")
            for name, found in zip(names, enc.encode_all(pc.fill_null(batch.column(1), ""))):
                ids = found.tobytes() + end
                for k in range(0, len(ids), 4 * window):
                    piece = ids[k : k + 4 * window]
                    rows.append((name, k // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Each piece of each row of ``docs`` with its sequence and its offset there."""
    pieces = written(cut(docs, path, window, end_id), "pieces")
    groups = max(1, -(-int(pieces.agg(F.sum("length")).first()[0] or 0) // group_tokens))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        number, offset = best_fit(rows.column("length").to_pylist(), window)
        rows = rows.drop_columns(["grp"])
        return rows.append_column("sequence_id", pa.array(np.array(number, np.int64) * groups + key[0].as_py())).append_column("offset", pa.array(offset, pa.int64()))

    # a scan of written files gives the same rows the same numbers again if a task is repeated
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(place, PLACED)

"""Token counts: overlapping chunks of huge documents, spliced where both encodings agree.

A text of more than ``chunk`` code points is encoded in chunks that overlap by ``overlap``.  Two
neighbouring chunks are spliced at a boundary that both encodings have inside the overlap and that
is *proven stable*: the vocabulary (checked when it is loaded) has no piece with white space after
another character, so no merge crosses from a non-space to a space, and what stands left of such a
place cannot change what stands right of it.  If an overlap holds no such place, it is widened (up
to the end of the text), so the count is that of the whole text in every case.

Defined results: null text counts as empty (0 bytes, 0 tokens); nothing is truncated; repeated
rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship

CHUNK, OVERLAP, LIMIT = 65_536, 512, 4096
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Encoder:
    """Pieces with offsets; a mark (U+2581) stands for a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i).replace("▁", " ") for i in range(self.model.get_piece_size()))
        self.spaces_first = not any(" " in piece.lstrip(" ") for piece in pieces)

    def count(self, text: str) -> int:
        return len(self.model.encode(text))

    def begins(self, text: str) -> list[int]:
        """Where each piece begins, in bytes."""
        return [p.begin for p in self.model.encode(text, return_type="proto").pieces]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def whole_count(enc: Encoder, text: str, chunk: int, overlap: int) -> int:
    """Tokens of the whole text, from chunks."""
    n, start, total = len(text), 0, 0
    if n <= chunk or not enc.spaces_first:
        return enc.count(text)
    while True:
        end = start + chunk
        if end >= n:
            return total + enc.count(text[start + (start > 0) :])
        wide, skip = overlap, int(start > 0)  # after a splice the model's own leading mark is the space cut at
        while True:
            stop = min(n, end + wide)
            left = enc.begins(text[start + skip : stop])
            if stop == n:
                return total + len(left)
            both = set(enc.begins(text[end:stop]))
            shift = len(text[start + skip : end].encode())
            if place := stable_place(text, end, stop, both, set(left), shift):
                total += bisect_left(left, shift + len(text[end:place].encode()))
                start = place
                break
            wide *= 4


def stable_place(text: str, low: int, high: int, right: set[int], left: set[int], shift: int) -> int:
    """The first place in (low, high) between a non-space and a space where both encodings have a boundary, or 0."""
    at = low
    while 0 < (at := text.find(" ", at + 1, high)):
        gone = len(text[low:at].encode())
        if text[at - 1] not in " \u2581" and gone in right and gone + shift in left:
            return at
    return 0


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its UTF-8 bytes and its tokens under the model at ``path``."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [whole_count(enc, t, chunk, overlap) for t in texts]
            columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, SCHEMA)

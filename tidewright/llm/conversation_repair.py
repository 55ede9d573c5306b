"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``.  Each row is kept (free), given the
role user or assistant (``REROLE``) or deleted (``DELETE``); empty user and assistant rows can be inserted
anywhere (``INSERT``); a truncated row that isn't deleted adds ``TRUNCATED``; blank and duplicate rows must go.
The search is A* on the lattice of (rows read, state of the pattern).  Its heuristic is the suffix sum of
deletions that must come and of the charge that each truncated row costs in any case (it is 3 or 4), so it is
admissible and consistent.  The queue is keyed (cost plus heuristic, audit), so the first goal that comes out has the
least cost and, among those, the ASCII-least audit: a prefix never sorts after its extension, and two
equally dear audits of one node are never prefixes of each other (each further letter without a row costs 3).

Short conversations are remembered by their shape.  Long ones (over ``CHUNK`` rows) are cut into chunks; A* gives each
chunk's best (cost, audit) between each two states, and the chunks are chained over the four states,
which is exact for the reason above.

On Spark: which row is a duplicate is a row number by (conversation, role, text), which deals a huge conversation's rows
to many tasks.  Rows are then dealt by conversation, sorted and streamed, a byte for each row held and no text: that gives
counts, cost and audit.  The repaired rows (``repaired``) stream a second time, sorted behind the audit of their
conversation, so texts are never gathered; the hash over a repaired conversation is updated row by row.

Defined results: a null role or text is one space, and so is a null id or turn in the key of the damage; a null conv_id is a
conversation of its own; rows go by turn, nulls first, those of one turn by role and text (repeats side by side); an empty
role has no initial and is never legal; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ship, written

REROLE, DELETE, INSERT, TRUNCATED, CHUNK = 3, 4, 3, 3, 256
#: States of the pattern: nothing yet, after the system row, after a user row, after an assistant row.
STATES, GOALS = range(4), (0, 3)
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Which row comes next in a state, as far as rows can be inserted or given a role.
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: A row of the lattice is one letter: s, u, a or x (any other initial), in upper case if truncated, or - if it must go.
MUST_GO = "-"


def search(rows: str, start: int, goals: Iterable[int]) -> tuple[int, str] | None:
    """A* over a row string: the least (cost, audit) from ``start`` to one of ``goals``, or None if there is no way."""
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i] == MUST_GO else TRUNCATED if rows[i].isupper() else 0)
    queue, closed = [(rest[0], "", 0, start, 0)], set()
    while queue:
        _, audit, i, state, cost = heapq.heappop(queue)
        if i == n and state in goals:
            return cost, audit
        if (i, state) in closed:
            continue
        closed.add((i, state))
        steps = [(cost + INSERT, "I", i, AFTER[state, NEXT[state]])]
        if i < n:
            steps.append((cost + DELETE, "D", i + 1, state))
            if rows[i] != MUST_GO:
                charge = cost + (TRUNCATED if rows[i].isupper() else 0)
                steps.append((charge + REROLE, "R", i + 1, AFTER[state, NEXT[state]]))
                kept = AFTER.get((state, rows[i].lower()))
                if kept is not None:
                    steps.append((charge, "K", i + 1, kept))
        for c, letter, j, to in steps:
            if (j, to) not in closed:
                heapq.heappush(queue, (c + rest[j], audit + letter, j, to, c))
    return None


@lru_cache(1 << 16)
def short_repair(rows: str) -> tuple[int, str]:
    return search(rows, 0, GOALS)


def repair(rows: str, chunk: int = CHUNK) -> tuple[int, str]:
    """Least cost and, at that, the ASCII-least audit of a whole conversation."""
    if len(rows) <= chunk:
        return short_repair(rows)
    best = {0: (0, "")}
    for at in range(0, len(rows), chunk):
        part = rows[at : at + chunk]
        ways = [(to, best[s], w) for s in sorted(best) for to in STATES if (w := search(part, s, (to,))) is not None]
        best = {}
        for to, (c, audit), (more, letters) in ways:
            found = c + more, audit + letters
            if to not in best or found < best[to]:
                best[to] = found
    return min(best[s] for s in GOALS if s in best)


# --- Spark


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after damage that the crc32 of ``conv_id:turn`` decides."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``: blank, duplicate, truncated or none."""
    solid = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(*in_order())) > 1
    fault = F.when(solid == "", "blank").when(again, "duplicate").when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "truncated").otherwise("none")
    return rows.withColumn("fault", fault)


class Tally:
    """Counts over the rows of one conversation, in order."""

    def __init__(self) -> None:
        self.letters: list[str] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "none": 0}
        self.illegal = self.distinct = 0
        self.before = self.first = self.last = None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        self.faults[fault] += 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        letter = initial if initial in ("s", "u", "a") else "x"
        self.letters.append(MUST_GO if fault in ("blank", "duplicate") else letter.upper() if fault == "truncated" else letter)

    def row(self) -> tuple:
        cost, audit = repair("".join(self.letters))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, cost, audit


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv_id long, place long, role string, text string, edit string"


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation with rows in ``rows``: counts, cost and audit."""
    ship(rows.sparkSession)
    initial = F.substring("role", 1, 1)
    # of rows alike in everything the one that is no duplicate comes first
    dealt = marked(rows).repartition("conv_id").sortWithinPartitions("conv_id", *in_order(), F.col("fault") == "duplicate").select("conv_id", "turn", initial.alias("initial"), "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tally, done = None, None, []
        for batch in batches:
            for conv, turn, letter, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if tally is None or conv != now:
                    if tally is not None:
                        done.append((now, *tally.row()))
                    now, tally = conv, Tally()
                tally.add(turn, letter, fault)
            if done:
                yield _batch(done, AUDIT)
                done = []
        if tally is not None:
            yield _batch([(now, *tally.row())], AUDIT)

    return dealt.mapInArrow(run, AUDIT)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(zip(*rows), kinds)], names=list(names))


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """The rows (role, text, edit) that an audit leaves of the rows (role, text) of a conversation."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = AFTER[state, role[:1]]
        else:
            role, state = ROLES[NEXT[state]], AFTER[state, NEXT[state]]
        yield role, text, edit


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation in order behind a row (``head``) with its audit."""
    heads = found.select("conv_id", F.lit(0).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("copy"))
    both = heads.unionByName(rows.select("conv_id", F.lit(1).alias("head"), "turn", "role", "text", "copy"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "head", *in_order()).select("conv_id", "head", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, Iterator[tuple[str, str]]]]:
    """(conv_id, audit, rows) of each conversation in a stream of ``_with_audits``; the rows must be used up."""

    def flat() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    stream = flat()
    ahead = next(stream, None)
    while ahead is not None:
        conv, _, _, audit = ahead

        def rows() -> Iterator[tuple[str, str]]:
            nonlocal ahead
            for ahead in stream:
                if ahead[1] == 0:
                    return
                yield ahead[2], ahead[3]
            ahead = None

        rest = rows()
        yield conv, audit, rest
        for _ in rest:
            pass


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place, role, text and the edit that gave the row."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, audit, its in _conversations(batches):
            for place, (role, text, edit) in enumerate(edited(audit, its)):
                out.append((conv, place, role, text, edit))
                size += len(text)
                if len(out) >= 4096 or size > 1 << 22:
                    yield _batch(out, REPAIRED)
                    out, size = [], 0
        if out:
            yield _batch(out, REPAIRED)

    return _with_audits(rows, found).mapInArrow(run, REPAIRED)


def hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the same rows, without passing them on."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, audit, its in _conversations(batches):
            digest = hashlib.sha256()
            for place, (role, text, _) in enumerate(edited(audit, its)):
                digest.update((("\n" if place else "") + f"{role}:{text}").encode())
            out.append((conv, digest.hexdigest()))
            if len(out) >= 4096:
                yield _batch(out, "conv_id long, repaired_sha256 string")
                out = []
        if out:
            yield _batch(out, "conv_id long, repaired_sha256 string")

    return _with_audits(rows, found).mapInArrow(run, "conv_id long, repaired_sha256 string")


def digest(turns: DataFrame) -> DataFrame:
    """Per original conversation: its faults after damage, cost and audit of the repair, and the hash of the repaired rows."""
    rows = damaged(turns)
    found = written(audits(rows), "audits")
    key = [F.coalesce("conv_id", F.lit(0)).alias("key"), F.col("conv_id").isNull().alias("no_id")]
    counted = found.join(hashes(rows, found).withColumnRenamed("conv_id", "same"), F.col("conv_id").eqNullSafe(F.col("same"))).drop("same")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", *key)
    counted = counted.select(*key, *(c for c in counted.columns if c != "conv_id"))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return every.join(counted, ["key", "no_id"], "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))

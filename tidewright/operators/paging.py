"""Sorting and paging with the NULL order stated, offset and keyset pages, search requests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_PAGE, MAX_PAGE = 20, 200
PRIORITY_RANK = {"critical": 0, "high": 1, "normal": 2, "low": 3}


def parse_sort(text: str) -> list[tuple[str, str, str | None]]:
    """``field[:asc|desc[:nulls_first|nulls_last]]``, comma-separated."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, *rest = part.split(":")
        way, nulls = (rest + ["asc", None])[0] if rest else "asc", rest[1] if len(rest) > 1 else None
        if way not in ("asc", "desc") or nulls not in (None, "nulls_first", "nulls_last") or len(rest) > 2:
            raise ValueError(f"unknown sort expression {part!r}")
        out.append((name, way, nulls))
    return out


def sort_columns(fields: Sequence[tuple[str, str, str | None]]) -> list[Column]:
    """NULLs last when rising and first when falling, unless stated otherwise."""
    out = []
    for name, way, nulls in fields:
        nulls = nulls or ("nulls_last" if way == "asc" else "nulls_first")
        out.append(getattr(F, f"{way}_{nulls}")(name))
    return out


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    page: int
    page_size: int

    @property
    def total_pages(self) -> int:
        return -(-self.total // self.page_size)

    @property
    def has_next(self) -> bool:
        return self.page < self.total_pages


def offset_page(df: DataFrame, fields: Sequence[tuple[str, str, str | None]], page: int = 1, size: int = DEFAULT_PAGE) -> Page:
    """A page by offset with its totals: two plans, the count and the page."""
    if page < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError("page from 1, page size from 1 to 200")
    return Page(df.orderBy(*sort_columns(fields)).offset((page - 1) * size).limit(size), df.count(), page, size)


def keyset_page(df: DataFrame, at: str, ident: str, cursor: tuple | None, size: int) -> DataFrame:
    """The n + 1 rows after a cursor (the extra one tells that more follow), in (at, id) order."""
    if cursor is not None:
        t, i = (F.lit(x) for x in cursor)
        df = df.where((F.col(at) > t) | ((F.col(at) == t) & (F.col(ident) > i)))
    return df.orderBy(F.asc(at), F.asc(ident)).limit(size + 1)


@dataclass(frozen=True)
class SearchLimits:
    max_range: timedelta
    max_filters: int = 20
    max_page: int = MAX_PAGE


def refuse_search(start: datetime, end: datetime, filters: Sequence[tuple[str, str]], text: str | None, page_size: int, cursor: str | None, limits: SearchLimits, now: datetime) -> str | None:
    """Why a search is refused, or None."""
    if end <= start:
        return "inverted_range"
    if start > now:
        return "range_in_future"
    if end - start > limits.max_range:
        return "range_too_wide"
    if len(filters) > limits.max_filters:
        return "too_many_filters"
    if text is not None and not text.strip():
        return "blank_text"
    if not 1 <= page_size <= limits.max_page:
        return "page_size"
    if cursor is not None and decode_cursor(cursor) is None:
        return "bad_cursor"
    return None


def canonical_filters(filters: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(set(filters))


def encode_cursor(at: datetime, ident: str) -> str:
    import base64

    return base64.urlsafe_b64encode(f"{at.isoformat()}|{ident}".encode()).decode()


def decode_cursor(cursor: str) -> tuple[datetime, str] | None:
    import base64
    import binascii

    try:
        at, _, ident = base64.urlsafe_b64decode(cursor.encode()).decode().partition("|")
        return datetime.fromisoformat(at), ident
    except (ValueError, binascii.Error):
        return None


def top_by(df: DataFrame, score: str, ties: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(score), *(F.asc(t) for t in ties)).limit(n)


def queue_order(df: DataFrame, priority: str, queued_at: str) -> DataFrame:
    from ..functions.scoring import lookup

    return df.orderBy(lookup(PRIORITY_RANK, F.col(priority)).asc_nulls_last(), F.asc(queued_at))

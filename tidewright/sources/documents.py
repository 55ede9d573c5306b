"""Documents: format detection by magic bytes and content, decoding, pages, merging, size limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

SNIFFED, MAX_BYTES = 8192, 52_428_800
#: Leading bytes, file name endings and MIME types of formats.
MAGIC = [("255044462D", "pdf"), ("7B5C727466", "rtf"), ("89504E470D0A1A0A", "image"), ("FFD8FF", "image"), ("474946383761", "image"), ("474946383961", "image"), ("424D", "image"), ("49492A00", "tiff"), ("4D4D002A", "tiff")]
ZIP = ["504B0304", "504B0506", "504B0708"]
ENDINGS = {"pdf": "pdf", "docx": "docx", "txt": "txt", "text": "txt", "log": "txt", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "rtf": "rtf", "csv": "csv", "tsv": "csv", "xlsx": "xlsx", "xlsm": "xlsx", "json": "json", "xml": "xml", "yaml": "yaml", "yml": "yaml", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image", "webp": "image", "tif": "tiff", "tiff": "tiff", "zip": "zip"}
TYPES = {
    "application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "text/plain": "txt", "text/markdown": "markdown", "text/html": "html",
    "application/rtf": "rtf", "text/rtf": "rtf", "text/csv": "csv", "application/json": "json", "application/xml": "xml", "text/xml": "xml", "application/yaml": "yaml", "text/yaml": "yaml", "image/png": "image", "image/jpeg": "image", "image/gif": "image", "image/bmp": "image", "image/webp": "image", "image/tiff": "tiff", "application/zip": "zip",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def detect_format(data: Column, name: Column, content_type: Column) -> Column:
    """(format, confidence): leading bytes, then content where the declared type is plain or none, the declared type, content, the ending, text or unknown."""
    head = F.substring(F.hex(F.substring(data, 1, 16)), 1, 32)
    window = F.substring(data, 1, SNIFFED)
    # a character cut in two at the end of the window is left out
    whole = F.get(F.filter(F.transform(F.array(*(F.lit(k) for k in range(4))), lambda k: F.substring(window, F.lit(1), F.length(window) - k)), lambda b: F.is_valid_utf8(b)), F.lit(0))
    text = F.decode(whole, "UTF-8")
    body = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    first = F.lower(F.substring(body, 1, 512))
    html = F.startswith(first, F.lit("<!doctype html")) | F.contains(first, F.lit("<html"))
    base = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    declared = F.element_at(_map(TYPES), base)
    ending = F.element_at(_map(ENDINGS), F.lower(F.regexp_extract(name, r"\.([^.\\/]+)$", 1)))

    def guess(kind: Column | str, sure: float) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("format"), F.lit(sure).alias("confidence"))

    nothing = F.lit(None).cast("struct<format:string,confidence:double>")
    content = (
        F.when(F.length(body) == 0, nothing)
        .when(F.startswith(body, F.lit("<?xml")) | F.startswith(body, F.lit("<")) & ~html, guess("xml", 0.9))
        .when(html, guess("html", 0.9))
        .when(body.rlike(r"^[\[{]") & (F.try_parse_json(body).isNotNull() | (F.length(text) >= SNIFFED)), guess("json", 0.92))
    )
    magic = reduce(lambda acc, m: acc.when(F.startswith(head, F.lit(m[0])), guess(m[1], 0.99)), MAGIC, F.when(F.lit(False), nothing))
    zipped = reduce(lambda a, b: a | b, (F.startswith(head, F.lit(z)) for z in ZIP))
    inside = F.decode(window, "ISO-8859-1")
    office = F.when(F.contains(inside, F.lit("word/document.xml")), guess("docx", 0.97)).when(F.contains(inside, F.lit("xl/workbook.xml")), guess("xlsx", 0.97)).otherwise(guess("zip", 0.8))
    plain = F.coalesce(declared == "txt", F.lit(True))
    textual = whole.isNotNull() & ~F.contains(F.hex(window), F.lit("0000"))
    return F.coalesce(
        F.when(F.coalesce(F.length(data), F.lit(0)) == 0, guess("unknown", 0.0)), magic, F.when(zipped, office), F.when(plain, content), F.when(declared.isNotNull(), guess(declared, 0.85)), content, F.when(ending.isNotNull(), guess(ending, 0.6)), F.when(textual, guess("txt", 0.4)), guess("unknown", 0.0)
    )


def detect_kind(name: Column, content_type: Column) -> Column:
    """By ending first, then by type; the content isn't read."""
    ending = F.element_at(_map(ENDINGS), F.lower(F.regexp_extract(name, r"\.([^.\\/]+)$", 1)))
    return F.coalesce(ending, F.element_at(_map(TYPES), F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))))


def decode(data: Column) -> tuple[Column, Column]:
    """(text, warning): UTF-8 without its byte order mark, otherwise Latin-1 with a warning."""
    good = F.is_valid_utf8(data)
    text = F.when(good, F.regexp_replace(F.decode(data, "UTF-8"), "^﻿", "")).otherwise(F.decode(data, "ISO-8859-1"))
    return text, F.when(~good, F.lit("decoded as latin-1"))


def oversized(data: Column, limit: int = MAX_BYTES) -> Column:
    return F.length(data) > limit


def pages_of(text: Column, per_page: int) -> Column:
    """Split at form feeds if there are any, otherwise slices of ``per_page`` characters."""
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / per_page).cast("int"))), lambda i: F.substring(text, i * per_page + 1, F.lit(per_page)))
    return F.when(F.contains(text, F.lit("\f")), F.split(text, "\f")).otherwise(slices)


def merge_documents(pages: DataFrame, order: list[str]) -> DataFrame:
    """Pages of several documents of a ``merge_id`` in one numbering from 1."""
    return pages.withColumn("page_no", F.row_number().over(Window.partitionBy("merge_id").orderBy(*order)))


def limit_text(text: Column, limit: int = MAX_BYTES) -> tuple[Column, Column]:
    """(text, cut?): at most ``limit`` UTF-8 bytes, cut between characters."""
    over = F.octet_length(text) > limit
    raw = F.substring(F.encode(text, "UTF-8"), 1, limit)
    # up to three bytes of a character cut in two are left out
    tries = F.filter(F.transform(F.array(*(F.lit(k) for k in range(4))), lambda k: F.substring(raw, F.lit(1), F.lit(limit) - k)), lambda b: F.is_valid_utf8(b))
    return F.when(over, F.decode(F.get(tries, F.lit(0)), "UTF-8")).otherwise(text), over

"""JSON payloads and parameters: paths set, renamed, removed and enriched; typed values; display texts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Texts that are read as booleans.
TRUE, FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")


def _type_at(of: T.DataType, path: Sequence[str]) -> T.DataType | None:
    for part in path:
        if not isinstance(of, T.StructType) or part not in of.names:
            return None
        of = of[part].dataType
    return of


def value_at(c: Column, of: T.DataType, path: str) -> Column:
    """The value at a dotted path; NULL if the payload's type has no such path."""
    parts = path.split(".")
    if _type_at(of, parts) is None:
        return F.lit(None)
    for part in parts:
        c = c.getField(part)
    return c


def with_value(c: Column, of: T.DataType, path: str, value: Column) -> Column:
    """The payload with a value set at a dotted path; what is missing on the way is made."""
    first, _, rest = path.partition(".")
    if not rest:
        return c.withField(first, value)
    inner = _type_at(of, [first])
    if not isinstance(inner, T.StructType):
        made = value
        for part in reversed(rest.split(".")):
            made = F.struct(made.alias(part))
        return c.withField(first, made)
    below = F.coalesce(c.getField(first), F.from_json(F.lit("{}"), inner))
    return c.withField(first, with_value(below, inner, rest, value))


def _stepwise(df: DataFrame, column: str, steps: Sequence) -> DataFrame:
    for step in steps:
        df = df.withColumn(column, step(F.col(column), df.schema[column].dataType))
    return df


def removed(df: DataFrame, column: str, paths: Sequence[str]) -> DataFrame:
    """Without the named paths; unknown ones are passed over."""
    return _stepwise(df, column, [lambda c, of, p=p: c.dropFields(p) if _type_at(of, p.split(".")) is not None else c for p in paths])


def mapped(df: DataFrame, column: str, mappings: Sequence[tuple[str, str]]) -> DataFrame:
    """Values copied from one path to another, all read from the payload as it was; a NULL one leaves its target as it is."""
    kept = df.withColumn("_was", F.col(column))
    was = kept.schema["_was"].dataType

    def copied(source: str, target: str):
        return lambda c, of: with_value(c, of, target, F.coalesce(value_at(F.col("_was"), was, source), value_at(c, of, target)))

    return _stepwise(kept, column, [copied(a, b) for a, b in mappings if _type_at(was, a.split(".")) is not None]).drop("_was")


def renamed(df: DataFrame, column: str, renames: Sequence[tuple[str, str]]) -> DataFrame:
    """Values moved from one path to another, one after the other; a NULL one leaves its target as it is."""
    for source, target in renames:
        of = df.schema[column].dataType
        if _type_at(of, source.split(".")) is not None:
            moved = df.withColumn("_v", F.coalesce(value_at(F.col(column), of, source), value_at(F.col(column), of, target)))
            df = _stepwise(removed(moved, column, [source]), column, [lambda c, of, t=target: with_value(c, of, t, F.col("_v"))]).drop("_v")
    return df


def enriched(df: DataFrame, column: str, fields: Mapping[str, object]) -> DataFrame:
    """Static values at paths that have none."""
    return _stepwise(df, column, [lambda c, of, p=p, v=v: with_value(c, of, p, F.coalesce(value_at(c, of, p), F.lit(v))) for p, v in fields.items()])


def parsed_or(c: Column, schema: str, default: Column) -> Column:
    """JSON by a schema; the default where the text is no JSON."""
    return F.when(F.try_parse_json(c).isNull(), default).otherwise(F.from_json(c, schema))


def rewritten(path: Column, pattern: str | None, replacement: str | None) -> Column:
    """A path rewritten by a regular expression; without pattern or replacement it stays."""
    return path if not pattern or replacement is None else F.regexp_replace(path, pattern, replacement)


def parameter(text: Column, kind: str) -> tuple[Column, Column]:
    """(value, refused): a text as a declared kind; NULL is no value and not refused."""
    bare = F.trim(text)
    low = F.lower(bare)
    value = {
        "string": lambda: text, "enum": lambda: text, "integer": lambda: F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare.try_cast("long")), "number": lambda: F.when(bare.rlike(r"[0-9]"), bare.try_cast("double")),
        "boolean": lambda: F.when(low.isin(*TRUE), F.lit(True)).when(low.isin(*FALSE), F.lit(False)), "date": lambda: F.when(bare.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), bare.try_cast("date")),
        "datetime": lambda: F.when(bare.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.regexp_replace(bare, "Z$", "+00:00").try_cast("timestamp")), "uuid": lambda: F.when(low.rlike(r"^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"), low),
    }[kind]()
    return value, text.isNotNull() & value.isNull()


def display_text(c: Column, of: T.DataType) -> Column:
    """A cell as text: NULL is empty, lists go by commas, maps and structs as sorted name=value."""
    if isinstance(of, T.ArrayType):
        out = F.array_join(F.transform(c, lambda x: display_text(x, of.elementType)), ", ")
    elif isinstance(of, T.MapType):
        out = F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"].cast("string"), F.lit("="), display_text(x["value"], of.valueType))), ", ")
    elif isinstance(of, T.StructType):
        out = F.concat_ws(", ", *(F.concat(F.lit(f"{f.name}="), display_text(c.getField(f.name), f.dataType)) for f in sorted(of.fields, key=lambda f: f.name)))
    elif isinstance(of, T.TimestampType | T.TimestampNTZType):
        out = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    else:
        out = c.cast("string")
    return F.when(c.isNull(), F.lit("")).otherwise(out)


def batches_of(c: Column, size: int) -> Column:
    """An array in pieces of ``size`` elements."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1)), F.lit(size))
    return F.when(F.size(c) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(starts, lambda at: F.slice(c, at, F.lit(size))))


def tool_success_rate(trace: Column) -> Column:
    """Of a trace's tool calls (structs with type and status) the share that succeeded; NULL without any."""
    calls = F.filter(trace, lambda x: x["type"] == "tool_call")
    return F.try_divide(F.size(F.filter(calls, lambda x: x["status"] == "succeeded")).cast("double"), F.size(calls).cast("double"))


def execution_quality(trace: Column, error: Column) -> Column:
    """0 with an error; else 1 less the share of tool calls that were denied or failed."""
    calls = F.filter(trace, lambda x: x["type"] == "tool_call")
    bad = F.size(F.filter(calls, lambda x: x["status"].isin("denied", "failed")))
    clean = F.coalesce(1.0 - F.try_divide(bad.cast("double"), F.size(calls).cast("double")), F.lit(1.0))
    return F.when(F.coalesce(F.length(error), F.lit(0)) > 0, 0.0).otherwise(F.greatest(F.lit(0.0), clean))


MAX_DEPTH = 8
SEGMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*|[0-9]+")


def path_segments(path: str) -> list[str]:
    """The segments of an attribute path; a path that is empty, too deep or malformed is an error."""
    segments = path.strip().split(".")
    if len(segments) > MAX_DEPTH:
        raise ValueError(f"a path has {MAX_DEPTH} segments at most: {path!r}")
    for segment in segments:
        if not SEGMENT.fullmatch(segment):
            raise ValueError(f"not a path segment: {segment!r} in {path!r}")
    return segments


def resolved(document: Column, path: str) -> Column:
    """What a VARIANT holds at a path through objects and list places, as a VARIANT; SQL NULL if nothing is there.

    A JSON null that is there stays a VARIANT null (``is_missing`` is false for it).  A number is a key of an object and a place of a list.
    """
    at = document
    for segment in path_segments(path):
        key = F.try_variant_get(at, f"$['{segment}']", "variant")
        at = F.coalesce(key, F.try_variant_get(at, f"$[{segment}]", "variant")) if segment.isdigit() and int(segment) < 1 << 31 else key
    return at


def is_missing(value: Column) -> Column:
    """Whether ``resolved`` found nothing, as against a null that is there."""
    return value.isNull()

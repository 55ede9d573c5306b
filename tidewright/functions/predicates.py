"""Predicates from filter descriptions, in the three dialects that treat NULL and types differently.

``sql_predicate``: SQL comparison, three-valued; a NULL is dropped by ``ne`` as by ``eq``.
``display_predicate``: two-valued, values compared as text; a NULL passes ``ne``, ``not_in`` and ``is_null`` only.
``event_predicate``: two-valued, values compared by type; a NULL passes nothing, not even ``ne``.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

COMPARE = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
RANGES, UNARY = ("between", "date_range"), ("is_null", "is_not_null", "is_true", "is_false", "exists")


@dataclass(frozen=True)
class Filter:
    """field, operator and its one or two values; arity is checked at once."""

    field: str
    op: str
    value: object = None
    value2: object = None

    def __post_init__(self) -> None:
        if self.op in RANGES and (self.value is None or self.value2 is None):
            raise ValueError(f"{self.op} needs two values")
        if self.op not in RANGES and self.op not in UNARY and self.value is None:
            raise ValueError(f"{self.op} needs a value")


def like_pattern(term: str, *, anchor_start: bool = False, anchor_end: bool = False) -> str:
    """A LIKE pattern for a literal term, wildcards escaped by a backslash."""
    escaped = re.sub(r"([\\%_])", r"\\\1", term)
    return ("" if anchor_start else "%") + escaped + ("" if anchor_end else "%")


def sql_predicate(c: Column, op: str, value: object = None, value2: object = None) -> Column:
    if op in COMPARE:
        return COMPARE[op](c, F.lit(value))
    if op in ("contains", "starts_with", "ends_with"):
        return c.ilike(like_pattern(str(value), anchor_start=op == "starts_with", anchor_end=op == "ends_with"))
    if op == "like":
        return c.ilike(str(value))
    if op in RANGES:
        return c.between(F.lit(value), F.lit(value2))
    if op in ("in", "not_in"):
        return c.isin(list(value)) if op == "in" else ~c.isin(list(value))
    if op == "jsonb_has_key":
        return F.array_contains(F.json_object_keys(c), str(value))
    if op == "jsonb_contains":
        return reduce(operator.and_, (F.get_json_object(c, f"$.{k}") == F.lit(_json_text(v)) for k, v in dict(value).items()))
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    if op in ("is_true", "is_false"):
        return F.coalesce(c if op == "is_true" else ~c, F.lit(False))
    raise ValueError(f"unknown operator {op}")


def _json_text(v: object) -> str:
    return ("true" if v else "false") if isinstance(v, bool) else str(v)


def display_predicate(c: Column, op: str, value: object = None, value2: object = None) -> Column:
    text = c.cast("string")
    if op in ("is_null", "is_not_null"):
        return c.isNull() if op == "is_null" else c.isNotNull()
    if op in ("eq", "ne"):
        found = COMPARE[op](text, F.lit(_json_text(value)))
    elif op in ("in", "not_in"):
        found = text.isin([_json_text(v) for v in value])
        found = found if op == "in" else ~found
    elif op in ("contains", "starts_with"):
        found = F.contains(F.lower(text), F.lit(str(value).lower())) if op == "contains" else F.startswith(F.lower(text), F.lit(str(value).lower()))
    elif op in COMPARE:
        found = COMPARE[op](coerced(c, value), F.lit(value))
    elif op == "between":
        found = coerced(c, value).between(F.lit(value), F.lit(value2))
    else:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(found, F.lit(op in ("ne", "not_in")))


def coerced(c: Column, value: object) -> Column:
    """The column as the operand's type; NULL if it can't be."""
    if isinstance(value, bool) or not isinstance(value, int | float):
        return c
    return c.cast("string").try_cast("double")


def event_predicate(c: Column, op: str, value: object = None) -> Column:
    if op == "exists":
        return c.isNotNull() if value in (None, True) else c.isNull()
    if op == "contains":
        found = F.contains(c, F.lit(value))
    elif op in ("in", "not_in"):
        found = c.isin(list(value))
        found = found if op == "in" else ~found
    else:
        found = COMPARE[op](c, F.lit(value))
    return F.coalesce(found, F.lit(False))


def all_of(predicates: Sequence[Column]) -> Column:
    """AND of the predicates; none at all is true."""
    return reduce(operator.and_, predicates, F.lit(True))


def any_of(predicates: Sequence[Column]) -> Column:
    """OR of the predicates; none at all is true (no rules: nothing is refused)."""
    return reduce(operator.or_, predicates) if predicates else F.lit(True)


def rule_matches(predicates: Sequence[Column], mode: str = "ALL") -> Column:
    """A rule with conditions: true only if it has any; an error or NULL in one counts as false."""
    kept = [F.coalesce(p, F.lit(False)) for p in predicates]
    return F.lit(False) if not kept else all_of(kept) if mode == "ALL" else any_of(kept)


def rule_tree(node: Mapping, leaf: Mapping[str, Column]) -> Column:
    """A boolean tree {"all": [...]} / {"any": [...]} / {"not": x} / "leaf name" as one expression."""
    if isinstance(node, str):
        return F.coalesce(leaf[node], F.lit(False))
    (kind, below), = node.items()
    return ~rule_tree(below, leaf) if kind == "not" else (all_of if kind == "all" else any_of)([rule_tree(x, leaf) for x in below])


def path_pattern(pattern: str) -> str:
    """A path glob as a regular expression: ``*`` is one segment, ``**`` any number of them or none."""
    out = ""
    for part in pattern.strip("/").split("/"):
        out += "(?:/[^/]+)*" if part == "**" else "/" + ("[^/]+" if part == "*" else re.escape(part))
    return f"^{out}/?$"


def topic_pattern(pattern: str) -> str:
    """A topic glob as a regular expression: ``*`` anything, ``?`` one character, ``[...]`` a set; case counts."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + 2) if c == "[" else -1
        if end > 0:
            body = pattern[at + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", r"\\") + "]"
            at = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        at += 1
    return f"(?s)^{out}$"


def labels_match(labels: Column, required: Mapping[str, str], forbidden: Mapping[str, str]) -> Column:
    """Every required label equal, no forbidden label equal."""
    need = [F.coalesce(labels[k] == v, F.lit(False)) for k, v in required.items()]
    ban = [~F.coalesce(labels[k] == v, F.lit(False)) for k, v in forbidden.items()]
    return all_of([*need, *ban])


def tenant_readable(organization: Column, classification_rank: Column, allowed_roles: Column, project: Column, *, organization_id: str, clearance: int, roles: Sequence[str], projects: Sequence[str], administrator: bool = False) -> Column:
    """Row-level read access: same organisation, clearance, a shared role (none named: open) and project scope."""
    own = F.array(*(F.lit(r.strip().lower()) for r in roles)) if roles else F.array().cast("array<string>")
    wanted = F.transform(allowed_roles, lambda r: F.lower(F.trim(r)))
    by_role = (F.size(allowed_roles) == 0) | F.lit(administrator) | F.arrays_overlap(wanted, own)
    by_scope = project.isNull() | F.lit(administrator) | project.isin(list(projects))
    return (organization == organization_id) & (classification_rank <= clearance) & by_role & by_scope


def same_share(key: Column, ratio: float) -> Column:
    """A deterministic sample by key: true for about ``ratio`` of the keys."""
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(int(ratio * 1_000_000))


def rollout_bucket(flag: Column, target: Column) -> Column:
    """A target's place in a flag's roll-out, 0 to 99.99, from the first 32 bits of sha256("flag:target")."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", flag, target), 256), 1, 8), 16, 10).cast("long") % 10000 / 100.0


def flag_enabled(enabled: Column, killed: Column, rollout: Column, bucket: Column, starts_at: Column, ends_at: Column, now: Column) -> Column:
    """Killed, disabled, before its start, after its end: off; otherwise on below the roll-out percentage."""
    off = killed | ~enabled | F.coalesce(now < starts_at, F.lit(False)) | F.coalesce(now >= ends_at, F.lit(False))
    return F.when(off, F.lit(False)).otherwise(bucket < rollout)

"""The filter language compiled to Columns, so that Catalyst can push it to the scan.

A filter is a dict: field conditions, ``$and`` and ``$or``. Missing values follow the rules of a document
store: they pass ``$ne`` and ``$nin``, fail every range and equal only null. An empty ``$and`` holds, an empty or
non-list ``$or`` and an unknown operator fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUE, FALSE = True, False


class FilterCompiler:
    def __init__(self, schema: T.StructType):
        self.schema = schema

    def _type(self, field: str):
        kind = self.schema
        for part in field.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            kind = kind[part].dataType
        return kind

    def compile(self, where: dict | None) -> Column:
        out = F.lit(True)
        for key, condition in (where or {}).items():
            if key == "$and":
                ok = isinstance(condition, list) and all(isinstance(c, dict) for c in condition)
                out = out & (self._all([self.compile(c) for c in condition]) if ok else F.lit(False))
            elif key == "$or":
                parts = [self.compile(c) for c in condition if isinstance(c, dict)] if isinstance(condition, list) else []
                any_of = F.lit(False)
                for part in parts:
                    any_of = any_of | part
                out = out & any_of
            else:
                out = out & self._field(key, condition)
        return out

    @staticmethod
    def _all(parts: list[Column]) -> Column:
        out = F.lit(True)
        for part in parts:
            out = out & part
        return out

    def _field(self, field: str, condition) -> Column:
        kind = self._type(field)
        value = F.col(field) if kind is not None else F.lit(None)
        if not isinstance(condition, dict):
            return self._equal(value, kind, condition)
        return self._all([self._operator(value, kind, op, expected) for op, expected in condition.items()])

    @staticmethod
    def _comparable(kind, expected) -> bool:
        if isinstance(expected, bool):
            return isinstance(kind, T.BooleanType)
        if isinstance(expected, (int, float)):
            return isinstance(kind, (T.NumericType, T.BooleanType))
        if isinstance(expected, str):
            return isinstance(kind, T.StringType)
        return False

    def _equal(self, value: Column, kind, expected) -> Column:
        if expected is None:
            return value.isNull()
        if isinstance(kind, T.ArrayType):
            return value.eqNullSafe(F.array(*map(F.lit, expected))) if isinstance(expected, list) else F.lit(False)
        return value.eqNullSafe(F.lit(expected)) if self._comparable(kind, expected) else F.lit(False)

    def _member(self, value: Column, kind, expected) -> Column:
        items = list(expected or [])
        if isinstance(kind, T.ArrayType):
            usable = [i for i in items if self._comparable(kind.elementType, i)]
            return F.coalesce(F.arrays_overlap(value, F.array(*map(F.lit, usable))), F.lit(False)) if usable else F.lit(False)
        usable = [i for i in items if self._comparable(kind, i)]
        found = value.isNotNull() & value.isin(*usable) if usable else F.lit(False)
        return found | value.isNull() if None in items else found

    def _operator(self, value: Column, kind, op: str, expected) -> Column:
        ranges = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}
        if op in ranges:
            return value.isNotNull() & ranges[op](value, F.lit(expected)) if self._comparable(kind, expected) else F.lit(False)
        if op == "$in":
            return self._member(value, kind, expected)
        if op == "$nin":
            return ~self._member(value, kind, expected)
        if op == "$eq":
            return self._equal(value, kind, expected)
        if op == "$ne":
            return ~self._equal(value, kind, expected)
        return F.lit(False)


def where(df: DataFrame, condition: dict | None) -> DataFrame:
    return df.where(FilterCompiler(df.schema).compile(condition))


def scope(tenant_id: str, user_id: str, domain_id: str, conversation_id: str | None = None) -> Column:
    """The hard isolation predicate: three equalities, four with a conversation."""
    out = (F.col("tenant_id") == tenant_id) & (F.col("user_id") == user_id) & (F.col("domain_id") == domain_id)
    return out & (F.col("conversation_id") == conversation_id) if conversation_id is not None else out


def kind_matches(kind: Column, pattern: str) -> Column:
    """An exact kind, or ``root.*`` for everything below a root; the root itself belongs to it."""
    p = pattern.strip().lower()
    if p.endswith(".*"):
        return F.coalesce((kind == p[:-2]) | kind.startswith(p[:-1]), F.lit(False))
    return F.coalesce(kind == p, F.lit(False))


def is_trace(kind: Column, turn_role: Column) -> Column:
    root = F.split(kind, r"\.")[0]
    return F.coalesce(turn_role.isin("action", "observation") | root.isin("material", "tool") | (kind == "memory.operation_digest"), F.lit(False))


def admitted(visibility: Column, kind: Column, turn_role: Column, patterns: list[str] | None = None) -> Column:
    """Default: visible and no trace. With kind patterns: also explicit rows or traces of those kinds."""
    trace = is_trace(kind, turn_role)
    out = (visibility == "default") & ~trace
    if patterns:
        asked = F.lit(False)
        for p in patterns:
            asked = asked | kind_matches(kind, p)
        out = out | (asked & ((visibility == "explicit") | (trace & (visibility != "never"))))
    return F.coalesce(out, F.lit(False))


def visibility_of(policy: Column, requested: Column) -> Column:
    """Stored visibility from the retrieval policy; ``auto`` keeps what was asked, else default."""
    return F.when(policy == "never", "never").when(policy == "explicit", "explicit").when(policy == "always", "default").otherwise(F.coalesce(requested, F.lit("default")))


def overlaps_any(column: str, values: list[str]) -> Column:
    """OR inside a field: any of the values; no values: no restriction."""
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))), F.lit(False)) if values else F.lit(True)

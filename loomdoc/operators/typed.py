"""Paths over typed columns: steps become Column expressions, and all matches one array in document order.

A typed document has every member of its schema, in the schema's order; SQL null is the JSON null, so a null member is a
match and what it would hold is not. Where the types of a step's matches differ, Untyped is raised: such documents go to
the exact evaluator as text (json_text).
"""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType, StructType

from loomdoc.functions.paths import CompiledPath, Step, compiled

COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
LONGEST = (1 << 31) - 1  # elements of an array column


class Untyped(TypeError):
    """The matches have no one type."""


def json_text(column: Column) -> Column:
    """A typed document as JSON text with all its members; floats and temporal values are written Spark's way."""
    return F.to_json(column, {"ignoreNullFields": "false"})


def matches(column: Column, dtype: DataType, expression: str | CompiledPath) -> Column | None:
    """An array of all matches; None where the schema allows no match."""
    found, kind = F.array(column), dtype
    for step in compiled(expression).steps:
        pair = _apply(F.filter(found, lambda x: x.isNotNull()), kind, step)
        if pair is None:
            return None
        found, kind = pair
    return found


def _apply(found: Column, kind: DataType, step: Step) -> tuple[Column, DataType] | None:
    """found: matches that are not null."""
    if step.kind == "descend":
        below = _descended(kind, step.args[0])
        return below and (F.flatten(F.transform(found, below[0])), below[1])
    if step.kind == "field":
        if not isinstance(kind, StructType) or step.args[0] not in kind.names:
            return None
        return F.transform(found, lambda x: x.getField(step.args[0])), kind[step.args[0]].dataType
    if step.kind == "wildcard" and isinstance(kind, StructType):
        if len({f.dataType for f in kind}) > 1:
            raise Untyped("members of several types")
        return F.flatten(F.transform(found, lambda x: F.array(*[x.getField(n) for n in kind.names]))), kind[0].dataType
    if not isinstance(kind, ArrayType):
        return None
    if step.kind == "wildcard":
        return F.flatten(found), kind.elementType
    if step.kind == "index":
        n = step.args[0]
        if abs(n) > LONGEST:
            return None
        inside = F.filter(found, lambda x: F.size(x) > (n if n >= 0 else -n - 1))
        return F.transform(inside, lambda x: F.get(x, F.lit(n) if n >= 0 else F.size(x) + n)), kind.elementType
    if step.kind == "slice":
        return F.flatten(F.transform(found, lambda x: _slice(x, *step.args))), kind.elementType
    return F.flatten(F.transform(found, lambda x: F.filter(x, lambda e: F.coalesce(_passes(e, kind.elementType, *step.args), F.lit(False))))), kind.elementType


def _descended(kind: DataType, name: str):
    """(a function from a value that is not null to the array of matches below it, their type), or None."""
    if isinstance(kind, ArrayType):
        below = _descended(kind.elementType, name)
        if below is None:
            return None
        return (lambda x: F.flatten(F.transform(F.filter(x, lambda e: e.isNotNull()), below[0]))), below[1]
    if not isinstance(kind, StructType):
        return None
    parts, types = [], set()
    for f in kind:
        if f.name == name:
            parts.append(lambda x, n=f.name: F.array(x.getField(n)))
            types.add(f.dataType)
        if below := _descended(f.dataType, name):
            of = below[0]
            parts.append(lambda x, n=f.name, of=of: F.flatten(F.transform(F.filter(F.array(x.getField(n)), lambda v: v.isNotNull()), of)))
            types.add(below[1])
    if len(types) > 1:
        raise Untyped("matches of several types")
    return ((lambda x: F.concat(*[p(x) for p in parts])), types.pop()) if parts else None


def _slice(x: Column, start: int | None, end: int | None, step: int) -> Column:
    if step < 0:
        return F.filter(x, lambda e: F.lit(False))
    size, clip = F.size(x), lambda n: max(-LONGEST, min(LONGEST, n))
    start, end, step = clip(start or 0), None if end is None else clip(end), min(step, LONGEST)
    lo = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
    hi = size if end is None else F.lit(end) if end >= 0 else size + end
    return F.filter(x, lambda e, i: (i >= lo) & (i < hi) & ((i - lo) % step == 0))


def _passes(e: Column, kind: DataType, name: str, op: str, literal: float | str) -> Column:
    if not isinstance(kind, StructType) or name not in kind.names:
        return F.lit(False)
    field = kind[name].dataType
    if isinstance(literal, str):
        return COMPARE[op](e.getField(name), F.lit(literal)) if isinstance(field, StringType) else F.lit(False)
    if not isinstance(field, NumericType) or isinstance(field, BooleanType):
        return F.lit(False)
    return COMPARE[op](e.getField(name).cast("double"), F.lit(literal))

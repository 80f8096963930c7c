"""Operators over columns of JSON text that typed columns cannot express exactly: Arrow batches, one parse a row.

Paths are evaluated inside the batch, so matches leave it, never trees. Policies and expressions are literals of the plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from loomdoc.functions.evaluate import evaluated
from loomdoc.functions.parse import InvalidJson, parse_json, status_of
from loomdoc.functions.paths import CompiledPath, Step, compiled
from loomdoc.functions.revive import checked_registry, recognized, revived
from loomdoc.functions.serialize import Writer, tree_text
from loomdoc.sources.files import checked, is_lines, lines_in, path_table

MATCHES = "array<struct<kind:string,value:string>>"
_MATCH = pa.struct([("kind", pa.string()), ("value", pa.string())])
MEMBERS = "array<struct<key:string,kind:string,value:string>>"


def kind_of(x: Any) -> str:
    if x is None:
        return "null"
    return {bool: "boolean", str: "string", dict: "object", list: "array", int: "number", float: "number"}.get(type(x), type(x).__name__)


def value_text(x: Any) -> str:
    return tree_text(x) if isinstance(x, (dict, list, str, int, float, bool)) or x is None else Writer(native=True).text(x)


def matches(json: Column, expression: str | CompiledPath, *, policy: str = "first", parse_types: Any = False) -> Column:
    """All matches in document order: (kind, value as JSON text). Null for a null text; text that is no JSON raises ValueError."""
    steps, registry = compiled(expression).steps, None if parse_types is False else checked_registry(parse_types)

    @arrow_udf(MATCHES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch:
                source = text.as_py()
                if source is None:
                    out.append(None)
                    continue
                tree = parse_json(source, policy)
                if registry is not None:
                    tree = revived(tree, registry)
                out.append([{"kind": kind_of(x), "value": value_text(x)} for x in evaluated(tree, steps)])
            yield pa.array(out, pa.list_(_MATCH))

    return run(json)


def statuses(json: Column) -> Column:
    """ok, invalid or too deep; null for null. Takes strings or binary (which must be UTF-8)."""
    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else status_of(x) for x in batch.to_pylist()], pa.string())

    return run(json)


def canonical(json: Column, *, policy: str = "first") -> Column:
    """The document serialised again: compact, members in their order, names once by the policy. Null for null; bad text raises."""
    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else tree_text(parse_json(x, policy)) for x in batch.to_pylist()], pa.string())

    return run(json)


def members(json: Column, *, policy: str = "first") -> Column:
    """What a walk over the root gives: an object's (key, kind, value), a list's elements without key, or the scalar itself."""
    @arrow_udf(MEMBERS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("key", pa.string()), ("kind", pa.string()), ("value", pa.string())]))
        for batch in batches:
            out = []
            for source in batch.to_pylist():
                if source is None:
                    out.append(None)
                    continue
                tree = parse_json(source, policy)
                pairs = tree.items() if isinstance(tree, dict) else ((None, x) for x in (tree if isinstance(tree, list) else [tree]))
                out.append([{"key": k, "kind": kind_of(x), "value": value_text(x)} for k, x in pairs])
            yield pa.array(out, kind)

    return run(json)


def revived_kind(text: Column) -> Column:
    """What a string value stands for: (kind, value in its canonical form); kind string if for itself alone."""
    @arrow_udf("struct<kind:string,value:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                y = x if x is None else recognized(x)
                out.append(None if x is None else {"kind": "string" if y is x else type(y).__name__, "value": x if y is x else Writer(native=True).text(y)[1:-1]})
            yield pa.array(out, _MATCH)

    return run(text)


def float_texts(x: Column) -> Column:
    """Doubles as JSON text: the shortest repr, null for NaN and infinities (and for null)."""
    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([value_text(v) for v in batch.to_pylist()], pa.string())

    return run(x.cast("double"))


FOUND = "file_ord long, pos long, match_ord long, path string, kind string, value string, status string"


def search(spark: SparkSession, path: str, expression: str | CompiledPath, *, policy: str = "first", parse_types: Any = False, errors: str = "check") -> DataFrame:
    """Matches in a file or in a folder's files: file_ord, pos, match_ord (their order), path, kind, value (JSON text).

    A newline-delimited file is one root, the list of its records. Where the first step takes every record, ranges of the
    file are searched side by side; other expressions need the whole list in one task.
    """
    steps, registry = compiled(expression).steps, None if parse_types is False else checked_registry(parse_types)
    apart = bool(steps) and steps[0] == Step("wildcard")

    def searched(source: bytes, own: tuple) -> list:
        tree = parse_json(source, policy)
        return evaluated(revived(tree, registry) if registry is not None else tree, own)

    def of(p: str, start: int, end: int) -> Iterator[tuple]:
        if not is_lines(p):
            with open(p, "rb") as f:
                raw = f.read()
            if not raw:
                yield 0, 0, None, None, "empty"
                return
            pieces: Iterable = [(0, raw)]
        else:
            pieces = lines_in(p, start, end)
        whole: list = []
        for at, raw in pieces:
            try:
                if is_lines(p) and not apart:
                    tree = parse_json(raw, policy)
                    whole.append(revived(tree, registry) if registry is not None else tree)
                    continue
                found = searched(raw, steps[1:] if is_lines(p) else steps)
            except InvalidJson as e:
                yield at, 0, None, None, "invalid" if str(e) == "Invalid JSON" else "too deep"
                return
            for k, x in enumerate(found):
                yield at, k, kind_of(x), value_text(x), "ok"
        if is_lines(p) and not apart:
            for k, x in enumerate(evaluated(whole, steps)):
                yield 0, k, kind_of(x), value_text(x), "ok"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_ord", "pos", "match_ord", "path", "kind", "value", "status"]
        kinds = [pa.int64()] * 3 + [pa.string()] * 4
        for batch in batches:
            for i, p, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list = []
                for pos, k, kind, value, status in of(p, start, end):
                    rows.append((i, pos, k, p, kind, value, status))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    table = path_table(spark, path) if apart else path_table(spark, path, 1 << 62)
    return checked(table.mapInArrow(run, FOUND), errors)

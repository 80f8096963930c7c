"""Documents as Python objects: parse, serialise, load, dump, query, search.

For one process: what a driver, a notebook or a web handler needs. Tables of documents go through loomdoc.sources,
loomdoc.operators and loomdoc.sinks, which share the parser, evaluator and serialiser of this module and so agree with it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Any

from loomdoc import config
from loomdoc.cursor import JsonCursor
from loomdoc.functions.evaluate import evaluated
from loomdoc.functions.parse import INVALID, TOO_DEEP, InvalidJson, parse_json, records_of
from loomdoc.functions.paths import CompiledPath, compiled
from loomdoc.functions.revive import checked_registry, recognized, revived
from loomdoc.functions.serialize import Writer
from loomdoc.sinks.files import write_groups, write_text
from loomdoc.sources.files import SUFFIXES, discovered, is_lines

Path = str | os.PathLike


def _types(parse_types: Any, return_type: str = "dict") -> dict | None:
    if parse_types is False:
        return None
    registry = checked_registry(parse_types)
    if return_type == "cursor":
        raise ValueError("parse_types needs return_type='dict'")
    return registry


def _root_items(tree: Any) -> Iterator[Any]:
    return iter(tree.items()) if isinstance(tree, dict) else iter(tree if isinstance(tree, list) else [tree])


def _parsed(source: str | bytes, registry: dict | None) -> Any:
    tree = parse_json(source, config.get("duplicate_key_policy"))
    return tree if registry is None else revived(tree, registry)


def loads(source: str | bytes, *, return_type: str = "dict", iterator: bool = False, parse_types: Any = False) -> Any:
    """The document's tree, an iterator over its root, or a cursor."""
    if return_type not in ("dict", "cursor"):
        raise ValueError(f"invalid return_type: {return_type}")
    registry = _types(parse_types, return_type)
    if not isinstance(source, (str, bytes)):
        raise TypeError(f"loads() expects str or bytes, not {type(source).__name__}")
    tree = _parsed(source, registry)
    return JsonCursor(tree) if return_type == "cursor" else _root_items(tree) if iterator else tree


def _native(native: Any) -> bool:
    if native is not False and native is not True:
        raise TypeError(f"native must be a bool, not {type(native).__name__}")
    return native


def _text(obj: Any, native: bool, default: Callable | None = None) -> str:
    return Writer(native=native, default=default, cycles=config.get("cycle_policy")).text(obj)


def _returned(text: str, return_type: str) -> str | bytes:
    return text.encode() if return_type == "bytes" else text


def _return_type(return_type: str) -> None:
    if return_type not in ("str", "bytes"):
        raise ValueError(f"invalid return_type: {return_type}")


def dumps(obj: Any, *, return_type: str = "str", native: bool = False) -> str | bytes:
    _native(native)
    _return_type(return_type)
    return _returned(_text(obj, native), return_type)


def dumps_with_default(obj: Any, default: Callable[[Any], Any], *, return_type: str = "str", native: bool = True) -> str | bytes:
    _native(native)
    _return_type(return_type)
    if not callable(default):
        raise TypeError(f"default must be callable, not {type(default).__name__}")
    return _returned(_text(obj, native, default), return_type)


def _lines(path: str, registry: dict | None, skip_errors: bool) -> Iterator[Any]:
    with open(path, "rb") as f:
        lines = records_of(f.read())
    for n, line in lines:
        try:
            yield _parsed(line, registry)
        except InvalidJson as e:
            if not skip_errors:
                raise InvalidJson(f"{e} on line {n}") from None


def _file(path: str, registry: dict | None) -> Any:
    with open(path, "rb") as f:
        raw = f.read()
    if not raw:
        raise InvalidJson("Empty file")
    return _parsed(raw, registry)


def _folder(path: str, registry: dict | None, skip_errors: bool) -> Iterator[Any]:
    for p in discovered(path):
        if is_lines(p):
            yield from _lines(p, registry, skip_errors)
            continue
        try:
            tree = _file(p, registry)
        except InvalidJson:
            if skip_errors:
                continue
            raise
        yield from tree if isinstance(tree, list) else [tree]


def load(path: Path, *, return_type: str = "dict", iterator: bool = False, skip_errors: bool = False, parse_types: Any = False) -> Any:
    """A file's document, a newline-delimited file's records, or a folder's records."""
    registry, path = _types(parse_types, return_type), os.fspath(path)
    kind = "a directory" if os.path.isdir(path) else "NDJSON" if is_lines(path) else None
    if return_type == "cursor" and kind:
        raise ValueError(f'return_type="cursor" is not supported for {kind}')
    if return_type not in ("dict", "cursor"):
        raise ValueError(f"invalid return_type: {return_type}")
    if kind:
        if kind == "a directory":
            found = _folder(path, registry, skip_errors)
        else:
            found = _lines(path, registry, skip_errors)
        return found if iterator else list(found)
    tree = _file(path, registry)
    return JsonCursor(tree) if return_type == "cursor" else _root_items(tree) if iterator else tree


def dump(obj: Any, path: Path, *, split_by: Any = None, native: bool = False) -> None:
    """One file, or with split_by a folder of files by the values of members."""
    _native(native)
    path = os.fspath(path)
    if split_by is None:
        if os.path.isdir(path):
            raise ValueError("a directory target requires split_by")
        write_text(path, _text(obj, native))
    elif os.path.exists(path) and not os.path.isdir(path):
        raise ValueError("split_by requires a directory target")
    else:
        write_groups(obj, path, split_by, lambda rows: _text(rows, native))


def compile(expression: str) -> CompiledPath:  # noqa: A001
    return compiled(expression)


def query(data: dict | list | tuple, expression: str | CompiledPath, *, iterator: bool = False, parse_types: bool = False) -> Any:
    """All matches in a tree, which is not changed."""
    if parse_types is not False and parse_types is not True:
        raise TypeError(f"query() parse_types must be a bool, not {type(parse_types).__name__}")
    if not isinstance(data, (dict, list, tuple)):
        raise TypeError(f"query() expects dict, list or tuple, not {type(data).__name__}")
    found = evaluated(data, compiled(expression).steps)
    if parse_types:
        found = [recognized(str(x)) if isinstance(x, str) else x for x in found]
    return iter(found) if iterator else found


def search(path: Path, expression: str | CompiledPath, *, iterator: bool = False, parse_types: Any = False) -> Any:
    """All matches in a file, or in a folder's files one after the other."""
    registry, path, own = _types(parse_types), os.fspath(path), compiled(expression)
    if os.path.isdir(path):
        files = discovered(path)
    elif path.lower().endswith(SUFFIXES):
        files = [path]
    else:
        raise TypeError(f"search() expects a {', '.join(SUFFIXES)} file or a directory")

    def found() -> Iterator[Any]:
        for p in files:
            yield from evaluated(list(_lines(p, registry, False)) if is_lines(p) else _file(p, registry), own.steps)

    return found() if iterator else list(found())


__all__ = ["INVALID", "TOO_DEEP", "CompiledPath", "InvalidJson", "JsonCursor", "compile", "dump", "dumps", "dumps_with_default", "load", "loads", "query", "search"]

"""A PySpark-native engine for JSON documents: sources, paths, types, serialisation and sinks."""

from loomdoc import config
from loomdoc.api import CompiledPath, JsonCursor, compile, dump, dumps, dumps_with_default, load, loads, query, search

__all__ = ["CompiledPath", "JsonCursor", "compile", "config", "dump", "dumps", "dumps_with_default", "load", "loads", "query", "search"]

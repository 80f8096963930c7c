"""One file, or a folder of files by the values of members.

Groups are checked in full before anything is made; a group is one file, a list in the order of the records.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, IntegralType, StringType

UNSAFE = ("", ".", "..")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def write_text(path: str, text: str) -> None:
    """text and a newline, mode 0644, replacing what was there."""
    data = text.encode() + b"\n"
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o644)
    with os.fdopen(fd, "wb") as f:
        os.fchmod(f.fileno(), 0o644)
        f.write(data)


def keys_of(split_by: Any) -> list[str]:
    if isinstance(split_by, str):
        return [split_by]
    if not isinstance(split_by, Sequence):
        raise TypeError(f"split_by must be str or a sequence of str, not {type(split_by).__name__}")
    if not split_by:
        raise ValueError("split_by must name at least one key")
    for k in split_by:
        if not isinstance(k, str):
            raise TypeError(f"split_by keys must be str, not {type(k).__name__}")
    return list(split_by)


def component(value: Any) -> str:
    """A split value as the name of a file or folder."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return int.__repr__(value)
    if isinstance(value, str):
        return str(value)
    raise TypeError(f"split_by values must be str, int or bool, not {type(value).__name__}")


def safe(text: str) -> bool:
    return text not in UNSAFE and not any(c in text for c in "/\\\0")


def grouped(records: Any, keys: list[str]) -> dict[tuple[str, ...], list]:
    """Records by the texts of their split values, in the order in which groups are met."""
    if not isinstance(records, list):
        raise TypeError(f"folder dump expects a list of dicts, not {type(records).__name__}")
    groups: dict[tuple[str, ...], list] = {}
    raw: dict[tuple[int, str], Any] = {}
    for r in records:
        if not isinstance(r, dict):
            raise TypeError(f"every record must be a dict, not {type(r).__name__}")
        names = []
        for level, key in enumerate(keys):
            if key not in r:
                raise ValueError(f"record is missing split key {key!r}")
            value = r[key]
            text = component(value)
            if not safe(text):
                raise ValueError(f"split value {value!r} is not usable as a path component")
            known = raw.setdefault((level, text), value)
            if isinstance(known, str) != isinstance(value, str) or isinstance(known, bool) != isinstance(value, bool):
                raise ValueError(f"split values {known!r} and {value!r} both name {text}")
            names.append(text)
        groups.setdefault(tuple(names), []).append(r)
    lowered: dict[str, str] = {}
    for names in groups:
        path = "/".join(names)
        other = lowered.setdefault(path.translate(LOWER), path)
        if other != path:
            raise ValueError(f"group names {other} and {path} differ only by case")
    return groups


def write_groups(records: Any, folder: str, split_by: Any, text: Callable[[Any], str]) -> None:
    groups = grouped(records, keys_of(split_by))
    os.makedirs(folder, exist_ok=True)
    for names, rows in groups.items():
        at = os.path.join(folder, *names[:-1])
        os.makedirs(at, exist_ok=True)
        write_text(os.path.join(at, f"{names[-1]}.json"), text(rows))


def _kind(kind: DataType) -> bool:
    return isinstance(kind, (StringType, IntegralType, BooleanType))


def group_table(table: DataFrame, split_by: Any) -> DataFrame:
    """Of a table with the columns of split_by: group (its path without the suffix), n records. Raises where a split has no file."""
    keys = keys_of(split_by)
    for k in keys:
        if k not in table.columns:
            raise ValueError(f"record is missing split key {k!r}")
        if not _kind(table.schema[k].dataType):
            raise TypeError(f"split_by values must be str, int or bool, not {table.schema[k].dataType.simpleString()}")
    texts = [F.col(f"`{k}`").cast("string") for k in keys]
    bad = [t.isNull() | t.isin(*UNSAFE) | t.rlike(r"[/\\\x00]") for t in texts]
    named = table.select(F.concat_ws("/", *texts).alias("group"), F.coalesce(*[F.when(b, F.coalesce(t, F.lit("null"))) for b, t in zip(bad, texts, strict=True)]).alias("bad"))
    groups = named.groupBy("group").agg(F.count("*").alias("n"), F.min("bad").alias("bad"))
    return groups


def write_split(table: DataFrame, folder: str, split_by: Any, *, order: str, json: str = "json") -> int:
    """Writes each group's json texts, in the order of the column `order`, as one list. Returns the number of files.

    Groups are dealt by their path and sorted within their task, so a group is streamed to its file and never held; a task
    that runs again writes the same file. All checks run before the first file is made.
    """
    keys = keys_of(split_by)
    groups = group_table(table, keys).cache()
    try:
        if (bad := groups.where("bad is not null").select(F.min("bad")).first()[0]) is not None:
            raise ValueError(f"split value {bad!r} is not usable as a path component")
        twins = groups.groupBy(F.translate("group", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a != b").first()
        if twins:
            raise ValueError(f"group names {twins.a} and {twins.b} differ only by case")
        made = groups.count()
    finally:
        groups.unpersist()
    os.makedirs(folder, exist_ok=True)
    named = table.select(F.concat_ws("/", *[F.col(f"`{k}`").cast("string") for k in keys]).alias("group"), F.col(f"`{order}`").alias("at"), F.col(f"`{json}`").alias("json"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, target, files = None, None, "", 0

        def closed() -> None:
            if out is not None:
                out.write(b"]\n")
                out.close()
                os.chmod(out.name, 0o644)
                os.replace(out.name, target)

        for batch in batches:
            for group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if group != now:
                    closed()
                    now, target, files = group, os.path.join(folder, f"{group}.json"), files + 1
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    out = open(f"{target}.{os.getpid()}.part", "wb")  # noqa: SIM115
                    out.write(b"[")
                else:
                    out.write(b",")
                out.write(text.encode())
        closed()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    dealt = named.repartition("group").sortWithinPartitions("group", "at").select("group", "json")
    dealt.mapInArrow(run, "files long").agg(F.sum("files")).collect()
    return made

"""Files, newline-delimited files and folders as tables of records.

A table has explicit order columns, (file_ord, pos), and a status: nothing relies on the order of rows, and a bad record is
a row that the caller drops or raises for. Files are opened by the executors, so a path must name a place that all of them
see. A newline-delimited file is read in ranges of bytes by many tasks; a .json file is one document and one task's work.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions.parse import INVALID, TOO_DEEP, InvalidJson, parse_json
from loomdoc.functions.serialize import tree_text

LINES = (".ndjson", ".jsonl")
SUFFIXES = (".json", *LINES)
RANGE = 1 << 23
MESSAGES = {"invalid": INVALID, "too deep": TOO_DEEP, "empty": "Empty file"}


def is_lines(path: str) -> bool:
    return path.lower().endswith(LINES)


def discovered(folder: str) -> list[str]:
    """All files of the three suffixes below folder, in the order of their relative paths' bytes. Hidden entries and links are left out."""
    found, todo = [], [(os.fspath(folder), "")]
    while todo:
        at, below = todo.pop()
        with os.scandir(at) as entries:
            for e in entries:
                if e.name.startswith(".") or e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    todo.append((e.path, f"{below}{e.name}/"))
                elif e.is_file(follow_symlinks=False) and e.name.lower().endswith(SUFFIXES):
                    found.append((os.fsencode(below + e.name), e.path))
    return [path for _, path in sorted(found)]


def path_table(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """One row for each range of bytes to read: file_ord, path, start, end. Whole files but for newline-delimited ones."""
    files = discovered(path) if os.path.isdir(path) else [os.fspath(path)]
    rows = []
    for i, f in enumerate(files):
        n = os.stat(f).st_size
        cuts = [*range(0, n, size), n] if is_lines(f) and n > size else [0, n]
        rows += [(i, f, a, b) for a, b in zip(cuts, cuts[1:])]
    table = spark.createDataFrame(rows, "file_ord long, path string, start long, end long")
    return table.repartition(max(1, min(len(rows), 10_000)), "path", "start")


def lines_in(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(byte offset, line without blanks around it) of the lines that begin in the range; blank lines are left out."""
    with open(path, "rb") as f:
        if start:
            f.seek(start - 1)
            f.readline()  # the line before belongs to the range that it begins in
        at = f.tell()
        while at < end:
            raw = f.readline()
            if not raw:
                return
            line = raw.rstrip(b"\n").strip(b"\r \t")
            if line:
                yield at, line
            at += len(raw)


def _status(e: InvalidJson) -> str:
    return "too deep" if str(e) == TOO_DEEP else "invalid"


def _records(path: str, start: int, end: int, policy: str) -> Iterator[tuple[int, str | None, str]]:
    """(place, JSON text, status) of a file's records: its lines, its list's elements, or the document itself."""
    if is_lines(path):
        for at, line in lines_in(path, start, end):
            try:
                yield at, tree_text(parse_json(line, policy)), "ok"
            except InvalidJson as e:
                yield at, None, _status(e)
        return
    with open(path, "rb") as f:
        raw = f.read()
    if not raw:
        yield 0, None, "empty"
        return
    try:
        tree = parse_json(raw, policy)
    except InvalidJson as e:
        yield 0, None, _status(e)
        return
    for i, x in enumerate(tree if isinstance(tree, list) else [tree]):
        yield i, tree_text(x), "ok"


def records(spark: SparkSession, path: str, *, policy: str = "first", size: int = RANGE) -> DataFrame:
    """All records of a file or folder: file_ord, pos, path, json (canonical text) and status. Bad ones have no json.

    Cases. Empty folder, or a file of blank lines: no rows. An empty .json file: one row, status empty. pos: the place of a
    list's element, or a line's offset in bytes.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_ord", "pos", "path", "json", "status"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for i, p, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list = []
                held = 0
                for pos, text, status in _records(p, start, end, policy):
                    rows.append((i, pos, p, text, status))
                    held += len(text or "")
                    if len(rows) >= 4096 or held > 1 << 24:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    return path_table(spark, path, size).mapInArrow(run, "file_ord long, pos long, path string, json string, status string")


def message(path: str, pos: int, status: str) -> str:
    """The error of a bad record; a line's number is counted only here, up to the line."""
    if not is_lines(path) or status == "empty":
        return MESSAGES[status]
    with open(path, "rb") as f:
        line = 1
        while pos > 0:
            part = f.read(min(pos, 1 << 20))
            line, pos = line + part.count(b"\n"), pos - len(part)
    return f"{MESSAGES[status]} on line {line}"


def checked(table: DataFrame, errors: str = "check") -> DataFrame:
    """The good rows. errors: check (a pass of its own raises ValueError for the first bad row in order, with its line's
    number), raise (one pass, which Spark ends at a bad row with its path and place), or skip."""
    if errors == "check":
        bad = table.where("status != 'ok'").select(F.struct("file_ord", "pos", "path", "status").alias("b")).agg(F.min("b").alias("b")).first()["b"]
        if bad is not None:
            raise ValueError(message(bad["path"], bad["pos"], bad["status"]))
    elif errors == "raise":
        texts = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
        text = F.concat(F.element_at(texts, F.col("status")), F.lit(": "), F.col("path"), F.lit(" at "), F.col("pos").cast("string"))
        table = table.withColumn("status", F.when(F.col("status") == "ok", F.col("status")).otherwise(F.raise_error(text)))
    return table.where("status = 'ok'").drop("status")


def load_records(spark: SparkSession, path: str, *, errors: str = "check", policy: str = "first") -> DataFrame:
    """A folder's files one after the other, or a file's records, as rows (file_ord, pos, path, json)."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return checked(records(spark, path, policy=policy), errors)


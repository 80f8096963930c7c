"""What the training-data operators share: staged tables, bounded memo tables, row-wise Arrow columns, summed vectors."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

#: Bytes that end a word: space and the ASCII controls 09-0D. Python's bytes.split() ends words at the same six.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loomdoc-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and outlives lost executors. See release()."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_staged_at"] = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes staged tables after their last reader, and lets Spark's cleaner drop the shuffle files of ended jobs."""
    for table in tables:
        sc, path = table.sparkSession.sparkContext, table.__dict__.pop("_staged_at", None)
        if path:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        sweep(tables[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of jobs that have ended: it learns of them when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def settle(spark: SparkSession, most: int = 8) -> int:
    """Sweeps until no shuffle is left, or `most` times, and returns how many are left: just after a job listeners and the
    scheduler still hold its shuffles, so one sweep would leave them on disk during the next job. Other queries' stay."""
    sc = spark.sparkContext._jsc.sc()
    left = sc.env().mapOutputTracker().shuffleStatuses()
    for _ in range(most):
        with contextlib.suppress(Py4JJavaError):  # listeners that are still busy after ten seconds
            sc.listenerBus().waitUntilEmpty(10_000)
        sweep(spark)
        time.sleep(0.2)  # the cleaner works beside
        if not left.size():
            break
    return left.size()


def trim(spark: SparkSession) -> str:
    """Has the driver's JVM give native memory that it has freed back to the machine, and returns what it says of that; "" if
    it cannot. Planning and compiling leave freed pages in the C library's arenas, one for each of many threads."""
    sc = spark.sparkContext
    lang, management = sc._jvm.java.lang, sc._jvm.javax.management
    try:
        # by the interface's method: the server's own class is not open to reflection
        invoke = next(m for m in lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = sc._gateway.new_array(lang.Object, 4)
        args[0], args[1] = management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), args) or ""
    except Py4JJavaError:  # older JVMs and other C libraries have no such command
        return ""


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Memo(dict):
    """A memo table of bounded size: when a generation is full it becomes the old one, and what is not asked for again goes."""

    def __init__(self, fn: Callable, limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.fn, self.limit, self.longest, self.old = fn, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def per_text(text: Column, make: Callable[[], Callable[[str], object]], returns: str) -> Column:
    """A column of make()(whole text) for each row; null texts count as empty. returns: the type, a struct's values come as a tuple.

    make is called once for each Python worker's task, so it can look up tables that the worker keeps.
    """
    arrow = to_arrow_type(_parse_datatype_string(returns))

    @arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        for batch in batches:
            out = [fn(x.as_py() or "") for x in batch]
            if pa.types.is_struct(arrow):
                columns = list(zip(*out, strict=True)) or [()] * arrow.num_fields
                yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], fields=list(arrow))
            else:
                yield pa.array(out, arrow)

    return run(text)


def slices(texts: pa.Array, most: int = 1 << 24) -> Iterator[pa.Array]:
    """texts, null as empty, in parts of some `most` bytes; a longer text is a part of its own."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    yield from (texts.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def summed_vectors(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int, blocks: int = 64) -> np.ndarray:
    """The sum over all tasks of task(batches), a vector of fixed length; the result's size does not depend on the data.

    Each task sends its vector in blocks; a block's parts meet in one task, which adds them as they come.
    """
    blocks = min(blocks, length)
    edges = [length * i // blocks for i in range(blocks + 1)]
    schema = "block int, part binary"

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.asarray(task(iter(batches)), dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([v[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], ["block", "part"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(part.as_py(), dtype=np.float64)
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "part"])

    rows = df.mapInArrow(parts, schema).repartition(blocks, "block").mapInArrow(add, schema).collect()
    out = np.zeros(length)
    for r in rows:
        out[edges[r["block"]] : edges[r["block"] + 1]] += np.frombuffer(r["part"], dtype=np.float64)
    return out


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def arrow_type(ddl: str) -> DataType:
    return _parse_datatype_string(ddl)

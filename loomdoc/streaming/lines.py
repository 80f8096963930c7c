"""Newline-delimited files that keep arriving in a folder, searched as they come, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions.paths import CompiledPath
from loomdoc.operators import exact


def line_matches(spark: SparkSession, folder: str, expression: str | CompiledPath, *, policy: str = "first", files_per_batch: int = 1000) -> DataFrame:
    """A stream of rows (path, json, status, matches), one for each line with text; matches is null where status is not ok.

    Each line is a document of its own. Stateless: no order between lines is kept, and none is needed.
    """
    read = spark.readStream.option("lineSep", "\n").option("pathGlobFilter", "*.{[nN][dD][jJ][sS][oO][nN],[jJ][sS][oO][nN][lL]}").option("maxFilesPerTrigger", files_per_batch)
    lines = read.text(folder).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"^[\r \t]+|[\r \t]+$", "").alias("json")).where("json != ''")
    known = lines.withColumn("status", exact.statuses(F.col("json")))
    good = F.when(F.col("status") == "ok", F.col("json"))
    return known.withColumn("matches", exact.matches(good, expression, policy=policy))

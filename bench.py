"""Times the headline queries, the best of three runs after one to warm up; prints one JSON line.

Typed paths read the Parquet tables. The others work on JSON text that is made once beforehand, one document for each
customer with orders and items: a column of texts (query, loads, dumps), a newline-delimited file (load, search) and a
folder of files split by a member (dump).
"""

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomdoc.operators import exact
from loomdoc.operators.typed import json_text
from loomdoc.plans.queries import QUERIES, order_documents
from loomdoc.sinks.files import write_split
from loomdoc.sources.files import records

TYPED = ("path_nested_filter", "path_wildcard_nested", "path_index_first", "path_index_last", "path_slice_step", "path_slice_negative_bounds", "path_slice_negative_step", "path_wildcard", "path_recursive", "path_filter_le_num", "path_filter_ne_str")


def text_queries(spark: SparkSession, sf: str, folder: str) -> dict:
    """Name to a function that makes a table, or, for the sink, does its work."""
    docs = order_documents(spark, sf).select(F.col("o_custkey").alias("id"), (F.col("o_custkey") % 50).cast("string").alias("part"), json_text(F.col("doc")).alias("json"))
    docs.write.parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    lines = f"{folder}/users.ndjson"
    with open(lines, "w", encoding="utf-8") as f:
        for r in texts.select("json").toLocalIterator():
            f.write(f"{r.json}\n")
    found = {
        "query_ids": lambda: texts.select(exact.matches(F.col("json"), "$.orders[*].id")),
        "query_totals": lambda: texts.select(exact.matches(F.col("json"), "$.orders[*].total")),
        "query_recursive": lambda: texts.select(exact.matches(F.col("json"), "$..total")),
        "loads": lambda: texts.select(exact.statuses(F.col("json"))),
        "dumps": lambda: texts.select(exact.canonical(F.col("json"))),
        "load_ndjson": lambda: records(spark, lines, size=1 << 21),
        "search_totals": lambda: exact.search(spark, lines, "$[*].orders[*].total", errors="raise"),
        "search_recursive": lambda: exact.search(spark, lines, "$[*]..total", errors="raise"),
    }
    return found | {"dump_split": lambda: write_split(texts, f"{folder}/split", "part", order="id")}


if __name__ == "__main__":
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        queries = {name: lambda q=QUERIES[name]: q(spark, sf) for name in TYPED} | text_queries(spark, sf, folder)
        took = {}
        for name, query in queries.items():
            runs = []
            for _ in range(4):
                began = time.time()
                out = query()
                if hasattr(out, "write"):
                    out.write.format("noop").mode("overwrite").save()
                runs.append(time.time() - began)
            took[name] = round(min(runs[1:]), 3)
    finally:
        shutil.rmtree(folder)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))

"""Queries over documents made of the test tables, with the same in SQL.

Typed documents are nested columns: customers' orders and their items, of which only the members that a path names are
built. Text documents are JSON text, evaluated exactly.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions.paths import compiled
from loomdoc.operators import exact
from loomdoc.operators.typed import json_text, matches
from loomdoc.sinks.files import group_table, write_split
from loomdoc.sources.files import load_records

ORDER = {"id": "o_orderkey", "total": "o_totalprice", "status": "o_orderstatus", "paid": "o_orderstatus = 'F'", "note": "case when o_orderstatus = 'F' then null else o_orderpriority end"}
SOURCES = {"id": ("o_orderkey",), "total": ("o_totalprice",), "status": ("o_orderstatus",), "paid": ("o_orderstatus",), "note": ("o_orderstatus", "o_orderpriority")}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named_by(expression: str) -> set[str] | None:
    """The members that an expression can reach, None if any."""
    steps = compiled(expression).steps
    last = steps[-1] if steps else None
    if last is None or last.kind not in ("field", "descend") and not any(s.args == ("items",) for s in steps):
        return None
    return {s.args[0] for s in steps if s.kind in ("field", "descend", "filter")}


def order_documents(spark: SparkSession, sf_dir: str, members: set[str] | None = None) -> DataFrame:
    """One document for each customer with orders: {orders: [{id, total, ..., items: [part]}]}, by order; members: those needed."""
    need = [m for m in ORDER if members is None or m in members]
    orders = read(spark, sf_dir, "orders").select("o_custkey", *dict.fromkeys(["o_orderkey", *(c for m in need for c in SOURCES[m])]))
    fields = [F.expr(ORDER[m]).alias(m) for m in need]
    if members is None or "items" in members:
        lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        items = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("i"))
        orders = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        fields.append(F.coalesce(F.col("i.l_partkey"), F.array().cast("array<bigint>")).alias("items"))
    one = F.struct(F.col("o_orderkey").alias("k"), F.struct(*fields).alias("d"))
    return orders.select("o_custkey", one.alias("o")).groupBy("o_custkey").agg(F.struct(F.sort_array(F.collect_list("o"))["d"].alias("orders")).alias("doc"))


def path_query(expression: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = order_documents(spark, sf_dir, named_by(expression))
        found = matches(F.col("doc"), docs.schema["doc"].dataType, expression)
        if found is None:
            found = F.array().cast("array<bigint>")
        return docs.select("o_custkey", F.posexplode(found).alias("match_ord", "value")).withColumn("match_ord", F.col("match_ord").cast("long"))

    return run


ORDERS = "with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as k, count(*) over (partition by o_custkey) as n from orders) "
ITEMS = "row_number() over (partition by o_custkey order by k, l_linenumber, l_partkey) - 1 as match_ord, l_partkey as value from o join lineitem on l_orderkey = o_orderkey"


def orders_where(condition: str, value: str = "o_orderkey") -> str:
    return f"{ORDERS}select o_custkey, row_number() over (partition by o_custkey order by k) - 1 as match_ord, {value} as value from o where {condition}"


PATHS = {
    "path_nested_filter": ("$.orders[?(@.total > 100000)].items[*]", f"{ORDERS}select o_custkey, {ITEMS} where o_totalprice > 100000"),
    "path_wildcard_nested": ("$.orders[*].items[*]", f"{ORDERS}select o_custkey, {ITEMS}"),
    "path_index_first": ("$.orders[0].id", orders_where("k = 1")),
    "path_index_last": ("$.orders[-1].id", orders_where("k = n")),
    "path_index_huge": ("$.orders[99999999999].id", orders_where("false")),
    "path_slice": ("$.orders[1:4].id", orders_where("k in (2, 3, 4)")),
    "path_slice_step": ("$.orders[0:5:2].id", orders_where("k in (1, 3, 5)")),
    "path_slice_negative_bounds": ("$.orders[-3:-1].id", orders_where("k > n - 3 and k < n")),
    "path_slice_negative_step": ("$.orders[::-1].id", orders_where("false")),
    "path_wildcard": ("$.orders[*].id", orders_where("true")),
    "path_quoted_field": ("$['orders'][*][\"id\"]", orders_where("true")),
    "path_recursive": ("$..total", orders_where("true", "o_totalprice")),
    "path_null_member": ("$.orders[*].note", orders_where("true", "case when o_orderstatus = 'F' then null else o_orderpriority end")),
    "path_filter_eq_num": ("$.orders[?(@.id == 7)].id", orders_where("o_orderkey = 7")),
    "path_filter_ne_num": ("$.orders[?(@.id != 7)].id", orders_where("o_orderkey <> 7")),
    "path_filter_lt_num": ("$.orders[?(@.total < 50000)].id", orders_where("o_totalprice < 50000")),
    "path_filter_le_num": ("$.orders[?(@.total <= 50000)].id", orders_where("o_totalprice <= 50000")),
    "path_filter_gt_num": ("$.orders[?(@['total'] > 2.5e5)].id", orders_where("o_totalprice > 250000")),
    "path_filter_ge_num": ("$.orders[?(@.total >= 250000.)].id", orders_where("o_totalprice >= 250000")),
    "path_filter_eq_str": ("$.orders[?(@.status == 'F')].id", orders_where("o_orderstatus = 'F'")),
    "path_filter_ne_str": ("$.orders[?(@.status != 'F')].id", orders_where("o_orderstatus <> 'F'")),
    "path_filter_null_ne_str": ("$.orders[?(@.note != '5-LOW')].id", orders_where("o_orderstatus <> 'F' and o_orderpriority <> '5-LOW'")),
    "path_filter_missing": ("$.orders[?(@.absent != 1)].id", orders_where("false")),
    "path_filter_bool_not_number": ("$.orders[?(@.paid == 1)].id", orders_where("false")),
    "path_filter_str_not_number": ("$.orders[?(@.status != 1)].id", orders_where("false")),
    "path_step_on_each_match": ("$.orders[?(@.total > 0)][0]", orders_where("false")),
}


def events_text(make: Callable[[], Column], expression: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    """All matches in a text made of each event: event_id, match_ord, kind, value."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read(spark, sf_dir, "events").select("event_id", exact.matches(make(), expression, **options).alias("m"))
        return docs.select("event_id", F.posexplode("m").alias("match_ord", "x")).select("event_id", F.col("match_ord").cast("long").alias("match_ord"), "x.kind", "x.value")

    return run


def text(template: str) -> Callable[[], Column]:
    """JSON text with an event's id in place of # and its props in place of %."""
    return lambda: F.replace(F.replace(F.lit(template), F.lit("#"), F.col("event_id").cast("string")), F.lit("%"), F.col("props"))


def found_sql(*values: tuple[str, str], table: str = "events", key: str = "event_id") -> str:
    parts = [f"select {key}, cast({i} as bigint) as match_ord, {kind} as kind, {value} as value from {table}" for i, (kind, value) in enumerate(values)]
    return " union all ".join(parts)


ID = "cast(event_id as varchar)"
TEXTS = {
    "path_field_text": (events_text(lambda: F.col("props"), "$.k"), "select event_id, cast(0 as bigint) as match_ord, 'number' as kind, json_extract_string(props, '$.k') as value from events where json_extract(props, '$.k') is not null"),
    "dup_key_first": (events_text(text('{"a":#,"b":0,"a":"x"}'), "$.a"), found_sql(("'number'", ID))),
    "dup_key_last": (events_text(text('{"a":#,"b":0,"a":"x"}'), "$.*", policy="last"), found_sql(("'string'", "'\"x\"'"), ("'number'", "'0'"))),
    "bigint_exact": (events_text(text('[9#00000000000000000000000000000000000000000007]'), "$[0]"), found_sql(("'number'", f"'9' || {ID} || '00000000000000000000000000000000000000000007'"))),
    "path_null_and_missing": (events_text(text('[{"a":null},{},{"a":[]},{"a":#}]'), "$[*].a"), found_sql(("'null'", "'null'"), ("'array'", "'[]'"), ("'number'", ID))),
    "path_object_wildcard": (events_text(text('{"b":#,"a":"é","c":[1.50,1e400],"_":true}'), "$.*"), found_sql(("'number'", ID), ("'string'", "'\"é\"'"), ("'array'", "'[1.5,null]'"), ("'boolean'", "'true'"))),
    "path_recursive_text": (events_text(text('{"k":{"k":#},"a":[{"k":"x"},%]}'), "$..k"), found_sql(("'object'", f"'{{\"k\":' || {ID} || '}}'"), ("'number'", ID), ("'string'", "'\"x\"'")) + " union all select event_id, 3, 'number', json_extract_string(props, '$.k') from events where json_extract(props, '$.k') is not null"),
    "path_filter_text": (events_text(text('[{"x":true},{"x":1,"n":#},{"x":"1"},7,{"y":1}]'), "$[?(@.x == 1)].n"), found_sql(("'number'", ID))),
    "revived_search": (events_text(text('{"d":"2024-02-29","e":"2023-02-29","n":#}'), "$.*", parse_types=True), found_sql(("'date'", "'\"2024-02-29\"'"), ("'string'", "'\"2023-02-29\"'"), ("'number'", ID))),
}


def strict_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of texts that break the grammar's rules one by one."""
    bad = ["[#]", "[#,]", "[NaN]", "['#']", "[0#]", "[#] x", '["\\ud800"]', '{"a":#,"a":1}', "[1.]", "[-]", '{"a" 1}', "﻿[#]", '["\t"]', "nul", "[1e5,-0.0,#]", ""]
    picked = F.element_at(F.array(*[text(b)() for b in bad]), (F.col("event_id") % len(bad) + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", exact.statuses(picked).alias("status"))


def depth_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lit(1023) + (F.col("event_id") % 4).cast("int")
    return read(spark, sf_dir, "events").select("event_id", exact.statuses(F.concat(F.repeat(F.lit("["), n), F.repeat(F.lit("]"), n))).alias("status"))


def root_iter_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.posexplode(exact.members(text('{"id":#,"a":[1],"props":%}')())).alias("ord", "m"))
    return rows.select("event_id", F.col("ord").cast("long").alias("ord"), "m.key", "m.kind", "m.value")


def root_iter_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list("o_orderkey"))).alias("doc"))
    return lists.select("o_custkey", F.posexplode(exact.members(F.col("doc"))).alias("ord", "m")).select("o_custkey", F.col("ord").cast("long").alias("ord"), "m.value")


def customer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", json_text(one).alias("json"))


CUSTOMER = "'{\"id\":' || c_custkey || ',\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || ',\"segment\":\"' || c_mktsegment || '\"}'"


def doc_serialize_ints_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_text(spark, sf_dir).select("c_custkey", exact.canonical(F.concat(F.lit(" "), "json")).alias("text"))


def float_repr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", exact.float_texts(F.col("c_acctbal")).alias("text"))


def split_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_table(read(spark, sf_dir, "customer").withColumn("rich", F.col("c_acctbal") > 5000), ["c_mktsegment", "c_nationkey", "rich"]).select("group", "n")


def split_folder(spark: SparkSession, sf_dir: str) -> str:
    """Customers' documents in a new folder, split by segment and nation."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = tempfile.mkdtemp(prefix="split-", dir=shared.removeprefix("file://") if shared else None)
    write_split(customer_text(spark, sf_dir), folder, ["c_mktsegment", "c_nationkey"], order="c_custkey")
    return folder


def folder_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_records(spark, split_folder(spark, sf_dir)).select("file_ord", "pos", "json")


def folder_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.search(spark, split_folder(spark, sf_dir), "$[-1].id").select("file_ord", "match_ord", "value")


FILES = "with f as (select *, c_mktsegment || '/' || c_nationkey || '.json' as path from customer), g as (select *, dense_rank() over (order by encode(path)) - 1 as file_ord, row_number() over (partition by path order by c_custkey) - 1 as pos, count(*) over (partition by path) as n from f) "


def revive(make: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, "orders").select("o_orderkey", exact.revived_kind(make()).alias("r")).select("o_orderkey", "r.kind", "r.value")

    return run


def _uuid() -> Column:
    h = F.md5(F.col("o_orderkey").cast("string"))
    return F.upper(F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def near_miss() -> Column:
    misses = ["2024-02-30", "2024-01-01 10:00:00", "10:20", "23:59:60", "2024-01-01T10:00:00.1234567", " 2024-01-01", "0000-01-01", "2024-01-01T10:00:00+24:00"]
    return F.element_at(F.array(*map(F.lit, misses)), (F.col("o_orderkey") % len(misses) + 1).cast("int"))


H = "md5(cast(o_orderkey as varchar))"
OTHERS = {
    "strict_validate": (strict_validate, "select event_id, case when event_id % 16 in (0, 7, 14) then 'ok' else 'invalid' end as status from events"),
    "depth_cap": (depth_cap, "select event_id, case when event_id % 4 < 2 then 'ok' else 'too deep' end as status from events"),
    "root_iter_object": (root_iter_object, f"select event_id, cast(0 as bigint) as ord, 'id' as key, 'number' as kind, {ID} as value from events union all select event_id, 1, 'a', 'array', '[1]' from events union all select event_id, 2, 'props', 'object', replace(props, ' ', '') from events"),
    "root_iter_array": (root_iter_array, "select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as ord, cast(o_orderkey as varchar) as value from orders"),
    "doc_serialize_ints_strings": (doc_serialize_ints_strings, f"select c_custkey, {CUSTOMER} as text from customer"),
    "float_repr_text": (float_repr_text, "select c_custkey, cast(c_acctbal as varchar) as text from customer"),
    "split_group_counts": (split_group_counts, "select c_mktsegment || '/' || c_nationkey || '/' || (c_acctbal > 5000) as \"group\", count(*) as n from customer group by 1"),
    "folder_union_all": (folder_union_all, f"{FILES}select file_ord, pos, {CUSTOMER} as json from g"),
    "folder_search": (folder_search, f"{FILES}select file_ord, cast(0 as bigint) as match_ord, cast(c_custkey as varchar) as value from g where pos = n - 1"),
    "revive_date": (revive(lambda: F.date_format("o_orderdate", "yyyy-MM-dd")), "select o_orderkey, 'date' as kind, strftime(o_orderdate, '%Y-%m-%d') as value from orders"),
    "revive_datetime": (revive(lambda: F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("t10:20:30.5z"))), "select o_orderkey, 'datetime' as kind, strftime(o_orderdate, '%Y-%m-%d') || 'T10:20:30.500000+00:00' as value from orders"),
    "revive_uuid": (revive(_uuid), f"select o_orderkey, 'UUID' as kind, substr({H}, 1, 8) || '-' || substr({H}, 9, 4) || '-' || substr({H}, 13, 4) || '-' || substr({H}, 17, 4) || '-' || substr({H}, 21, 12) as value from orders"),
    "revive_near_miss": (revive(near_miss), "select o_orderkey, 'string' as kind, ['2024-02-30', '2024-01-01 10:00:00', '10:20', '23:59:60', '2024-01-01T10:00:00.1234567', ' 2024-01-01', '0000-01-01', '2024-01-01T10:00:00+24:00'][o_orderkey % 8 + 1] as value from orders"),
}
QUERIES = {name: path_query(expression) for name, (expression, _) in PATHS.items()} | {name: q for name, (q, _) in (TEXTS | OTHERS).items()}
SQL = {name: sql for name, (_, sql) in (PATHS | TEXTS | OTHERS).items()}

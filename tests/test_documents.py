"""Parsing, serialising, files and folders, types, cursors and settings, on Python objects and on tables."""

import dataclasses
import datetime as dt
import decimal
import enum
import json
import math
import os
import random
import stat
import uuid

import pytest
from pyspark.sql import functions as F

import loomdoc
from loomdoc.operators import exact
from loomdoc.sinks.files import group_table, write_split
from loomdoc.sources.files import discovered, load_records, records

STORE = {"store": {"book": [{"title": "Moby Dick", "price": 8.99, "year": 1851, "tags": ["sea", "whale"]}, {"title": "Dune", "price": 12.5, "year": 1965, "tags": ["desert"]}, {"title": "Ubik", "price": 5.0, "year": 1969, "tags": []}], "bicycle": {"color": "red", "price": 19.95}}, "expensive": 10, "nested": {"price": {"price": 1}}}
PATHS = {
    "$.store.book[-1].title": ["Ubik"],
    "$.store.book[99]": [],
    "$.store.book[-99]": [],
    "$.store.bicycle.*": ["red", 19.95],
    "$..price": [8.99, 12.5, 5.0, 19.95, {"price": 1}, 1],
    "$.store.book[0:3:2].title": ["Moby Dick", "Ubik"],
    "$.store.book[::-1]": [],
    "$.store.book[-2:].title": ["Dune", "Ubik"],
    "$.store.book[?(@.price >= 8.99)].title": ["Moby Dick", "Dune"],
    "$.store.book[?(@.title != 'Dune')].year": [1851, 1969],
    "$.store.book[?(@.absent != 1)]": [],
    "$.store.book[?(@.title == 1)]": [],
    "$..book[*].price": [8.99, 12.5, 5.0],
    "$.store.book[?(@.price > 10)][0]": [],
    "$.store.book[*].tags[0]": ["sea", "desert"],
    "$.store[0]": [],
    "$.expensive.*": [],
    "$": [STORE],
}
REFUSED = ["", " ", "[1,]", "[,1]", "{\"a\":1,}", "[01]", "[+1]", "[.5]", "[1.]", "[1e]", "[-]", "[NaN]", "[Infinity]", "[-Infinity]", "['a']", "[\"\x01\"]", "[\"\t\"]", r'["\x41"]', r'["\ud800"]', r'["\udc00\ud800"]', r'{"\ud800":1}', r'{"a":"\ud800","a":1}', r'{"a":1,"a":["\udfff"]}', "\ufeff[]", "[1] x", "nul", "tru", "{1:2}", "{a:1}", "[1]\u00a0", "// x\n1", "\"\ud800\""]


@pytest.mark.parametrize("expression", PATHS)
def test_paths(expression):
    assert loomdoc.query(STORE, expression) == PATHS[expression]


@pytest.mark.parametrize("text", REFUSED)
def test_refused(text):
    with pytest.raises(ValueError, match="^Invalid JSON$"):
        loomdoc.loads(text)


def test_accepted():
    assert loomdoc.loads(b'\t\r\n {"a" : [1, -0, -0.0, 1e5, 1E-2, true, null, "\\u00e9\\ud83d\\ude00\\/"]} ') == {"a": [1, 0, -0.0, 1e5, 0.01, True, None, "\u00e9\U0001f600/"]}
    assert loomdoc.loads("[1e400,-1e400,1e-999]") == [math.inf, -math.inf, 0.0] and loomdoc.loads("1" * 5000) == 10**5000 // 9
    assert isinstance(loomdoc.loads("1.0"), float) and loomdoc.loads(str(2**70)) == 2**70
    for bad in (b'"\xff"', b'"\xc0\x80"', b'"\xed\xa0\x80"', b"\xef\xbb\xbf[]"):
        with pytest.raises(ValueError, match="^Invalid JSON$"):
            loomdoc.loads(bad)
    with pytest.raises(TypeError, match="str or bytes, not int"):
        loomdoc.loads(1)


@pytest.mark.parametrize("opening,closing", ["[]", ("{\"a\":", "}")])
def test_depth(opening, closing):
    assert loomdoc.loads(opening * 1023 + "[]" + closing * 1023)
    for text in (opening * 1024 + "[]" + closing * 1024, opening * 100_000, '["]]]",' + opening * 1024):
        with pytest.raises(ValueError, match="^Maximum nesting depth exceeded$"):
            loomdoc.loads(text)
    with pytest.raises(ValueError, match="^Invalid JSON$"):
        loomdoc.loads("[x" + opening * 2000)
    assert loomdoc.loads('["' + "[" * 5000 + '"]') == ["[" * 5000]


def test_repeated_names():
    text = '{"a":1,"b":2,"a":3,"c":{"d":1,"d":2}}'
    try:
        assert list(loomdoc.loads(text).items()) == [("a", 1), ("b", 2), ("c", {"d": 1})]
        loomdoc.config.set("duplicate_key_policy", "last")
        assert list(loomdoc.loads(text).items()) == [("a", 3), ("b", 2), ("c", {"d": 2})]
        loomdoc.config.set("duplicate_key_policy", "error")
        with pytest.raises(ValueError, match="^Invalid JSON$"):
            loomdoc.loads(text)
        loomdoc.config.set("duplicate_key_policy", "warn")
        with pytest.warns(RuntimeWarning, match="^Duplicate key encountered: a$"):
            assert loomdoc.loads(text)["a"] == 1
    finally:
        loomdoc.config.set("duplicate_key_policy", "first")


def test_settings():
    assert loomdoc.config.list() == {"duplicate_key_policy": "first", "cycle_policy": "warn"} and loomdoc.config.get("x") is None
    for key, value, error in (("x", "first", KeyError), ("cycle_policy", "no", ValueError), ("cycle_policy", 1, TypeError)):
        with pytest.raises(error):
            loomdoc.config.set(key, value)


def tree(r: random.Random, depth: int = 0):
    k = r.randrange(6 if depth < 4 else 4)
    if k == 4:
        return [tree(r, depth + 1) for _ in range(r.randrange(4))]
    if k == 5:
        return {r.choice(["a", "b", "c", "id", "name", "items"]): tree(r, depth + 1) for _ in range(r.randrange(4))}
    return r.choice([1, -2, 3.5, "s", "", True, False, None, 10**25, "é\n\"\\/\x7f\u2028", 1e16, 1e-5, 123456789.0, 5e-324, -0.0])


def test_round_trip():
    r = random.Random(7)
    for _ in range(500):
        x = tree(r)
        text = loomdoc.dumps(x)
        assert text == json.dumps(x, ensure_ascii=False, separators=(",", ":")) and loomdoc.loads(text) == x and loomdoc.loads(loomdoc.dumps(x, return_type="bytes")) == x


def test_serialise_rules():
    assert loomdoc.dumps([float("nan"), math.inf, (1, 2), {"b": 1, "a": [True, None]}, "\x0b\x1f\x7f/"]) == '[null,null,[1,2],{"b":1,"a":[true,null]},"\\u000b\\u001f\x7f/"]'
    for bad, error, what in (({1: 2}, TypeError, "^keys must be str, not int$"), ([{1}], TypeError, "^Object of type set is not JSON serializable$"), (["\ud800"], UnicodeEncodeError, "")):
        with pytest.raises(error, match=what):
            loomdoc.dumps(bad)
    with pytest.raises(TypeError, match="^native must be a bool, not int$"):
        loomdoc.dumps(1, native=1)
    with pytest.raises(ValueError, match="^invalid return_type: x$"):
        loomdoc.dumps(1, return_type="x")
    deep = []
    for _ in range(5000):
        deep = [deep]
    with pytest.raises(ValueError, match="^Maximum serialization depth exceeded$"):
        loomdoc.dumps(deep)


def test_cycles():
    loop = {"a": [1]}
    loop["a"].append(loop)
    with pytest.warns(RuntimeWarning, match="Circular"):
        assert loomdoc.dumps([loop["a"][0], loop, loop]) == '[1,{"a":[1,null]},{"a":[1,null]}]'
    try:
        loomdoc.config.set("cycle_policy", "error")
        with pytest.raises(ValueError, match="^Circular reference detected$"):
            loomdoc.dumps(loop)
        loomdoc.config.set("cycle_policy", "ignore")
        assert loomdoc.dumps(loop) == '{"a":[1,null]}'
    finally:
        loomdoc.config.set("cycle_policy", "warn")


class Colour(enum.Enum):
    RED = "red"
    DEEP = 7


@dataclasses.dataclass
class Point:
    x: int
    y: int = 2


def test_native():
    import numpy as np

    zone = dt.timezone(dt.timedelta(hours=-5, minutes=-30))
    cases = {
        dt.datetime(2024, 2, 3, 4, 5, 6): '"2024-02-03T04:05:06"', dt.datetime(24, 2, 3, 4, 5, 6, 70, tzinfo=dt.timezone.utc): '"0024-02-03T04:05:06.000070+00:00"', dt.datetime(2024, 2, 3, tzinfo=zone): '"2024-02-03T00:00:00-05:30"',
        dt.date(1, 2, 3): '"0001-02-03"', dt.time(1, 2, 3, 4): '"01:02:03.000004"', uuid.UUID(int=255): '"00000000-0000-0000-0000-0000000000ff"', decimal.Decimal("1.50"): "1.50", decimal.Decimal("1E+2"): "1E+2", decimal.Decimal("NaN"): "null",
        Colour.RED: '"red"', frozenset([1]): "[1]", np.float32(0.1): "0.10000000149011612", np.int8(-3): "-3", np.bool_(True): "true",
    }
    for x, text in cases.items():
        assert loomdoc.dumps(x, native=True) == text
        if not isinstance(x, float):
            with pytest.raises(TypeError, match="is not JSON serializable"):
                loomdoc.dumps([x])
    assert loomdoc.dumps([Point(1), np.arange(4).reshape(2, 2), {Colour.DEEP}], native=True) == '[{"x":1,"y":2},[[0,1],[2,3]],[7]]'
    for bad in (dt.timedelta(1), b"x", 1j, np.datetime64("2024-01-01"), object()):
        with pytest.raises(TypeError, match="is not JSON serializable"):
            loomdoc.dumps(bad, native=True)


def test_default():
    assert loomdoc.dumps_with_default({"a": {1}, "b": dt.date(2024, 1, 2)}, str) == '{"a":[1],"b":"2024-01-02"}'
    assert loomdoc.dumps_with_default([b"x", [1j]], repr) == "[\"b'x'\",[\"1j\"]]"
    assert loomdoc.dumps_with_default([dt.date(2024, 1, 2)], lambda x: [x.year, {"m": x.month}], native=False) == '[[2024,{"m":1}]]'
    with pytest.raises(TypeError, match=r"^default\(\) returned an object of type bytes that is not JSON serializable$"):
        loomdoc.dumps_with_default(1j, lambda x: b"")
    with pytest.raises(TypeError, match="^default must be callable, not NoneType$"):
        loomdoc.dumps_with_default(1, None)


def test_types():
    text = '{"d":"2024-02-03","t":"10:20:30.5","w":"2024-02-03t10:20:30z","o":"2024-02-03T10:20:30-05:30","u":"0A0b0c0d-0000-0000-0000-00000000000f","2024-01-01":["2024-02-30","23:59:60"],"c":"red","l":["red","2024-01-01",["2024-01-01"]],"p":{"x":"2024-01-01"},"q":{"z":1}}'
    got = loomdoc.loads(text, parse_types={"c": Colour, "l": Colour, "p": Point, "q": Point})
    utc = dt.timezone.utc
    assert got == {
        "d": dt.date(2024, 2, 3), "t": dt.time(10, 20, 30, 500000), "w": dt.datetime(2024, 2, 3, 10, 20, 30, tzinfo=utc), "o": dt.datetime(2024, 2, 3, 10, 20, 30, tzinfo=dt.timezone(-dt.timedelta(hours=5, minutes=30))),
        "u": uuid.UUID("0a0b0c0d-0000-0000-0000-00000000000f"), "2024-01-01": ["2024-02-30", "23:59:60"], "c": Colour.RED, "l": [Colour.RED, "2024-01-01", [dt.date(2024, 1, 1)]], "p": Point(dt.date(2024, 1, 1)), "q": {"z": 1},
    }
    assert loomdoc.loads('"2024-02-03"', parse_types=True) == dt.date(2024, 2, 3) and loomdoc.query(["10:20:30", ["10:20:30"]], "$[*]", parse_types=True) == [dt.time(10, 20, 30), ["10:20:30"]]
    for option, what in ((0, "parse_types must be a bool or a dict, not int"), ({1: Point}, "parse_types keys must be str, not int"), ({"a": int}, "parse_types values must be")):
        with pytest.raises(TypeError, match=what):
            loomdoc.loads("1", parse_types=option)
    with pytest.raises(ValueError, match="^parse_types needs return_type='dict'$"):
        loomdoc.loads("1", parse_types=True, return_type="cursor")


def test_cursor():
    c = loomdoc.loads('{"a":[1,2.5,"x",null,true,1e30],"n":{}}', return_type="cursor")
    assert c.is_object() and c.field("a").is_array() and c.field("a").at(3).is_null() and c.field("a").at(4).get_bool() and c.field("a").at(0).get_int() == 1 and c.field("a").at(1).get_float() == 2.5 and c.field("a").at(2).get_str() == "x"
    assert c.object_keys() == ["a", "n"] and c.field("a").array_size() == 6 and c.field("a").at(-1).get_float() == 1e30
    for run, what in ((lambda: c.field("z"), "^field not found$"), (lambda: c.field("a").at(6), "^index out of range$"), (lambda: c.at(0), "not an array"), (lambda: c.field("a").field("b"), "not an object"), (lambda: c.get_str(), "not a string"), (lambda: c.get_bool(), "not a bool"), (lambda: c.field("a").at(1).get_int() and c.field("a").at(5).get_int(), "not a number")):
        with pytest.raises(RuntimeError, match=what):
            run()
    assert [x.get_float() for x in loomdoc.compile("$.a[:2]").execute(c)] == [1.0, 2.5]
    with pytest.raises(TypeError, match=r"^execute\(\) expects a JsonCursor$"):
        loomdoc.compile("$").execute({})


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def folder(tmp_path):
    for name, text in {"a.JSON": '["a"]', "b.json": '"b"', "sub/c.NdJson": '"c"\r\n\n "d" \n', "sub/deep/d.jsonl": '{"e":1}', "ignored.txt": "x", "noextension": "x", ".secret.json": "x", ".hidden/visible.json": "x", "_x.json": '["_"]', "with space%.json": "[]", "sub-x.json": '[["x"]]'}.items():
        write(tmp_path / name, text)
    os.symlink(tmp_path / "a.JSON", tmp_path / "link.json")
    os.symlink(tmp_path / "sub", tmp_path / "linked")
    return tmp_path


def test_folder(spark, folder):
    want = ["_", "a", "b", ["x"], "c", "d", {"e": 1}]
    assert [os.path.relpath(p, folder) for p in discovered(folder)] == ["_x.json", "a.JSON", "b.json", "sub-x.json", "sub/c.NdJson", "sub/deep/d.jsonl", "with space%.json"]
    assert loomdoc.load(folder) == want == list(loomdoc.load(folder, iterator=True))
    assert [json.loads(r.json) for r in load_records(spark, str(folder)).orderBy("file_ord", "pos").collect()] == want
    for e in ("$", "$[*]", "$[0]", "$[-1:]", "$..e", "$[*][0]"):
        each = [m for p in discovered(folder) for m in loomdoc.search(p, e)]
        assert loomdoc.search(folder, e) == each == [json.loads(r.value) for r in exact.search(spark, str(folder), e).orderBy("file_ord", "pos", "match_ord").collect()]


def test_errors(spark, tmp_path):
    write(tmp_path / "a.json", '[{"i":1}]')
    write(tmp_path / "b.json", "{oops}")
    write(tmp_path / "c.ndjson", '{"i":3}\n\nbad\n{"i":5}\n' + "[" * 1025)
    write(tmp_path / "d.json", "")
    assert loomdoc.load(tmp_path, skip_errors=True) == [{"i": 1}, {"i": 3}, {"i": 5}]
    assert [json.loads(r.json)["i"] for r in load_records(spark, str(tmp_path), errors="skip").orderBy("file_ord", "pos").collect()] == [1, 3, 5]
    for path, what in (("", "^Invalid JSON$"), ("c.ndjson", "^Invalid JSON on line 3$"), ("d.json", "^Empty file$")):
        with pytest.raises(ValueError, match=what):
            loomdoc.load(tmp_path / path)
        with pytest.raises(ValueError, match=what):
            load_records(spark, str(tmp_path / path))
    with pytest.raises(Exception, match="Invalid JSON: .*c.ndjson at 9"):
        load_records(spark, str(tmp_path / "c.ndjson"), errors="raise").collect()
    write(tmp_path / "e.jsonl", "1\n" + "[" * 1025)
    with pytest.raises(ValueError, match="^Maximum nesting depth exceeded on line 2$"):
        loomdoc.load(tmp_path / "e.jsonl")
    found = loomdoc.load(tmp_path / "c.ndjson", iterator=True)
    assert next(found) == {"i": 3}
    with pytest.raises(ValueError, match="^Invalid JSON on line 3$"):
        next(found)
    with pytest.raises(FileNotFoundError):
        loomdoc.load(tmp_path / "none.json")
    with pytest.raises(TypeError):
        loomdoc.search(tmp_path / "x.txt", "$")
    for p in ("", "c.ndjson"):
        with pytest.raises(ValueError, match="return_type"):
            loomdoc.load(tmp_path / p, return_type="cursor")


def test_ranges(spark, tmp_path):
    """Lines of a file read in small ranges of bytes are each read once, in order."""
    rows = [{"i": i, "t": "é" * (i % 50)} for i in range(500)]
    write(tmp_path / "x.ndjson", "\n\r\n".join(loomdoc.dumps(r) for r in rows))
    got = records(spark, str(tmp_path / "x.ndjson"), size=97).orderBy("pos").collect()
    assert [json.loads(r.json) for r in got] == rows == loomdoc.load(tmp_path / "x.ndjson")


def test_dump(tmp_path):
    path = tmp_path / "x.json"
    write(path, "something longer than what follows")
    path.chmod(0o600)
    loomdoc.dump({"a": [1]}, path)
    assert path.read_text() == '{"a":[1]}\n' and stat.S_IMODE(path.stat().st_mode) == 0o644
    with pytest.raises(TypeError):
        loomdoc.dump({1}, path)
    assert path.read_text() == '{"a":[1]}\n'
    for run, what in ((lambda: loomdoc.dump([], tmp_path), "^a directory target requires split_by$"), (lambda: loomdoc.dump([], path, split_by="a"), "^split_by requires a directory target$")):
        with pytest.raises(ValueError, match=what):
            run()


def test_split(spark, tmp_path):
    r = random.Random(4242)
    rows = [{"a": r.choice("xyz"), "b": r.randint(1, 3), "c": r.random() < 0.5, "i": i, "v": r.random(), "big": 10**20 + i, "n": {"d": [1, None]}} for i in range(120)]
    for n, keys in enumerate((["a"], ["a", "b"], ["b", "a"], ["a", "b", "c"])):
        at = tmp_path / str(n)
        loomdoc.dump(rows, at, split_by=keys)
        path = lambda x, keys=keys: ("/".join(str(x[k]).lower() if isinstance(x[k], bool) else str(x[k]) for k in keys) + ".json").encode()
        want = sorted(rows, key=path)
        assert loomdoc.load(at) == want
        table = spark.createDataFrame([(x["i"], x["a"], x["b"], x["c"], loomdoc.dumps(x)) for x in rows], "i long, a string, b int, c boolean, json string").repartition(5)
        made = write_split(table, str(tmp_path / f"t{n}"), keys, order="i")
        assert loomdoc.load(tmp_path / f"t{n}") == want and made == len(discovered(tmp_path / f"t{n}"))
    loomdoc.dump([], tmp_path / "none", split_by="a")
    assert loomdoc.load(tmp_path / "none") == []


def test_split_refused(spark, tmp_path):
    for rows, error, what in (
        ([{"b": 1}], ValueError, "missing split key 'a'"), ([{"a": 1.5}], TypeError, "split_by values must be str, int or bool, not float"), ([{"a": None}], TypeError, "not NoneType"), ({"a": 1}, TypeError, "folder dump expects a list of dicts, not dict"), ([1], TypeError, "every record must be a dict, not int"),
        ([{"a": ""}], ValueError, "not usable"), ([{"a": ".."}], ValueError, "not usable"), ([{"a": "x/y"}], ValueError, "not usable"), ([{"a": "\0"}], ValueError, "not usable"), ([{"a": 1}, {"a": "1"}], ValueError, "both name 1"), ([{"a": True}, {"a": "true"}], ValueError, "both name true"), ([{"a": "x"}, {"a": "X"}], ValueError, "differ only by case"),
    ):
        with pytest.raises(error, match=what):
            loomdoc.dump(rows, tmp_path / "no", split_by="a")
    for keys, error in ((1, TypeError), ([], ValueError), ([1], TypeError)):
        with pytest.raises(error):
            loomdoc.dump([], tmp_path / "no", split_by=keys)
    assert not (tmp_path / "no").exists()
    table = spark.createDataFrame([(1, "x", "{}", 0.5), (2, "X", "{}", 0.5)], "i long, a string, json string, v double")
    for t, keys, error in ((table, "a", ValueError), (table, "v", TypeError), (table, "z", ValueError), (table.withColumn("a", F.lit("a/b")), "a", ValueError), (table.withColumn("a", F.lit(None).cast("string")), "a", ValueError)):
        with pytest.raises(error):
            write_split(t, str(tmp_path / "no"), keys, order="i")
    assert not (tmp_path / "no").exists() and group_table(table, "a").count() == 2


def test_tiers_agree(spark):
    """Random documents: the exact evaluator on text in a table, and the one on Python trees."""
    r = random.Random(31337)
    docs = [{"k": tree(r), "items": [tree(r) for _ in range(3)]} for _ in range(60)]
    table = spark.createDataFrame([(i, loomdoc.dumps(d)) for i, d in enumerate(docs)], "i long, json string")
    for e in ("$..a", "$.*", "$.items[*].*", "$.items[-1]", "$.items[::2].id", "$..items[?(@.a == 1)]", "$..name"):
        got = {x.i: [json.loads(m.value) for m in x.m] for x in table.select("i", exact.matches(F.col("json"), e).alias("m")).collect()}
        assert got == {i: loomdoc.query(d, e) for i, d in enumerate(docs)}


def test_typed_nulls(spark):
    """A null member of a typed document is a match; a missing one does not exist there."""
    from loomdoc.operators.typed import Untyped, json_text, matches

    docs = spark.sql("select named_struct('a', cast(null as int), 'b', array(1, null, 3), 's', named_struct('a', 5, 't', 'x'), 'l', array(named_struct('a', 7), null)) as d")
    kind = docs.schema["d"].dataType
    for e, want in (("$.a", [None]), ("$.b[*]", [1, None, 3]), ("$.b[1]", [None]), ("$.b[9]", []), ("$.b[-4]", []), ("$.l[*].a", [7]), ("$..a", [None, 5, 7]), ("$.b[1:]", [None, 3]), ("$.l[?(@.a == 7)].a", [7])):
        assert docs.select(matches(F.col("d"), kind, e)).first()[0] == want == [json.loads(m.value) for m in docs.select(exact.matches(json_text(F.col("d")), e)).first()[0]]
    assert matches(F.col("d"), kind, "$.zz") is None and matches(F.col("d"), kind, "$.b[99999999999]") is None
    with pytest.raises(Untyped):
        matches(F.col("d"), kind, "$.*")


def test_adapters():
    """Each adapter imports its framework alone; those that are installed serialise."""
    for name, cls in (("flask", "JSONProvider"), ("django", "JSONEncoder"), ("aiohttp", "json_response"), ("falcon", "json_handler"), ("fastapi", "JSONResponse"), ("pydantic", "dumps")):
        try:
            module = __import__(f"loomdoc.integrations.{name}", fromlist=[cls])
        except ImportError as e:
            assert not e.name.startswith("loomdoc")
        else:
            assert hasattr(module, cls)
    from loomdoc.integrations.structlog import dumps

    assert dumps({"a": 1j, "d": dt.date(2024, 1, 2)}, default=repr) == '{"a":"1j","d":"datetime.date(2024, 1, 2)"}'


def test_stream(spark, tmp_path):
    """Lines of files that arrive one after the other."""
    from loomdoc.streaming.lines import line_matches

    write(tmp_path / "in" / "a.ndjson", '{"a":1}\n\r\nbad\n')
    out = line_matches(spark, str(tmp_path / "in"), "$.a", files_per_batch=1).select("status", F.to_json("matches").alias("m"))
    for n in range(2):
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        if not n:
            write(tmp_path / "in" / "b.JSONL", ' {"b":1} ')
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).fillna("-").collect())
    assert got == [("invalid", "-"), ("ok", "[]"), ("ok", '[{"kind":"number","value":"1"}]')]

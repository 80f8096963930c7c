"""The path grammar, and every query against its SQL."""

import pickle

import duckdb
import pytest

import loomdoc
from loomdoc.functions.paths import CompiledPath, Step, parse
from loomdoc.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
BAD = [
    "", "a", "$.", "$..", "$[", "$[]", "$[+1]", "$[0:1:0]", "$..*", "$..[0]", "$[?(@.a < 'x')]", "$[?(@)]", "$[?(@.x)]", "$[1,2]", "$['a','b']", "$ x", "$.a b", "$. a",
    "$['unclosed", '$["unclosed', r"$['a\q']", r"$['\u0041']", "$.a[?(@.x && @.y == 1)]", "$.a[?(@.x == )]", "$.a[?@.x == 1]", "$.a]", "$[?(@ .x == 1)]", "$[?(@.x == +1)]",
    "$[?(@.x == 1e400)]", "$[?(@.x == 1.2.3)]", "$[?(@.x == true)]", "$[?(@.a.b == 1)]", "$[99999999999999999999]", "$[-9223372036854775809]", "$[1:99999999999999999999]", "$[1 2]", "$.é", "$\n.a",
]


@pytest.mark.parametrize("bad", BAD)
def test_refused(bad):
    with pytest.raises(ValueError, match="^Invalid JSONPath expression$"):
        parse(bad)


def test_parsed():
    assert parse("$.a[-1]['b c'][1:][*]..d") == (Step("field", ("a",)), Step("index", (-1,)), Step("field", ("b c",)), Step("slice", (1, None, 1)), Step("wildcard"), Step("descend", ("d",)))
    assert parse("\t $ .0a [ \"x\\\"\\n\" ] [ : -2 : 3 ] [ ? ( @[ 'y' ] >= -.5e1 ) ] ") == (Step("field", ("0a",)), Step("field", ('x"\n',)), Step("slice", (None, -2, 3)), Step("filter", ("y", ">=", -5.0)))
    assert parse("$[?(@.x==01)][?(@.x==1.)][9223372036854775807]") == (Step("filter", ("x", "==", 1.0)),) * 2 + (Step("index", (2**63 - 1,)),)


def test_compiled():
    own = loomdoc.compile("$.a")
    assert repr(own) == "CompiledPath('$.a')" and pickle.loads(pickle.dumps(own)) == own and len({own, loomdoc.compile("$.a")}) == 1 and isinstance(own, CompiledPath)
    assert loomdoc.query({"a": 1}, own) == [1]
    with pytest.raises(TypeError, match="expression must be str or CompiledPath, not int"):
        loomdoc.query({}, 1)


@pytest.mark.parametrize("name", QUERIES)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "events"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    out = QUERIES[name](spark, DIR)
    columns = ", ".join(f'"{c}"' for c in out.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(map(tuple, out.collect()), key=key)
    assert got == sorted(con.execute(f"select {columns} from ({SQL[name]})").fetchall(), key=key)

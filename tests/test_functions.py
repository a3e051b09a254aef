"""What functions may do, and that what cannot be translated is right all the same."""

import datetime
import math
import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F, types as T
from pyspark.sql.conversion import ArrowTableToRowsConversion
from pyspark.sql.pandas.types import to_arrow_type

from arborframe.functions.translate import Untranslatable, behave, required
from arborframe.operators import NestedFrame, batches
from arborframe.schema import Schema, infer
from arborframe.sources.readers import nest
from arborframe.sources import FolderDatabase, Database, bits_of_mask, from_arrays, from_npy, group_by_prefix, mask_of_bits


@pytest.fixture()
def nested(spark):
    rows = [(1, [(1, 1.1), (2, 2.2), (3, 3.3)]), (2, []), (3, [(-4, 4.4), (5, 5.5)])]
    return NestedFrame(spark.createDataFrame(rows, "k int, hey array<struct<x:bigint,y:double>>"))


def xs(frame):
    return [[i["x"] for i in r["hey"]] for r in frame.df.orderBy("k").collect()]


def test_two_functions_on_one_line(nested):
    assert xs(nested.filter(lambda h: h.x > 1, at="hey").filter(lambda h: h.x < 4, at="hey")) == [[2, 3], [], []]
    low, high = (lambda h: h.x > 1), (lambda h: h.x < 4)
    assert xs(nested.filter(high, at="hey").filter(low, at="hey")) == [[2, 3], [], []]


def test_statements_have_pythons_meaning(nested):
    def two(h):
        y = h.x % 3
        return y == 2

    assert xs(nested.filter(two, at="hey")) == [[2], [], [-4, 5]]

    def branch(h):
        if h.x > 2:
            return h.x // 2
        return -1

    got = nested.define("z", branch, at="hey", fieldtype="bigint").df.orderBy("k").collect()
    assert [[i["z"] for i in r["hey"]] for r in got] == [[-1, -1, 1], [], [-1, 2]]


def test_integers_are_exact(spark):
    values = [(9007199254740993, 1), (-9007199254740993, 2), (7, -2), (-7, 2), (2**62 + 1, 3), (5, -5), (0, 4)]
    frame = NestedFrame(spark.createDataFrame(values, "a bigint, b bigint"))
    got = frame.define("q", "a // b").define("r", "a % b").df.collect()
    assert [(r.q, r.r) for r in got] == [(a // b, a % b) for a, b in values]
    assert [r.s for r in frame.define("s", "b ** 3").df.collect()] == [b**3 for _, b in values]
    doubles = [(1.0, 0.1), (-7.5, 2.0), (7.5, -2.0), (6.0, 3.0)]
    got = NestedFrame(spark.createDataFrame(doubles, "a double, b double")).define("q", "a // b").define("r", "a % b").df.collect()
    assert [(r.q, pytest.approx(r.r)) for r in got] == [(a // b, a % b) for a, b in doubles]


def test_lists_in_functions(spark):
    frame = NestedFrame(spark.createDataFrame([(1, [1, 2, 3], [2**40], [0.5, 1.5], (7, "a"))], "k int, l array<int>, m array<bigint>, d array<double>, t struct<_0:int,_1:string>"))
    for text, want in {
        "l + l": [1, 2, 3, 1, 2, 3], "l * 2": [1, 2, 3, 1, 2, 3], "2 * l": [1, 2, 3, 1, 2, 3], "l * -1": [], "sum(l)": 6, "sum(m) + 1": 2**40 + 1, "sum(d)": 2.0,
        "[x * 2 for x in l if x > 1]": [4, 6], "max(x for x in l)": 3, "any(x > 2 for x in l)": True, "all(x > 2 for x in l)": False, "len(t)": 2, "t[1]": "a",
        "l == l": True, "l[1:] == [x for x in l if x > 1]": True, "l is l": True, "(l + [4])[-1]" if False else "(l + l)[-1]": 3,
    }.items():
        assert frame.define("out", text).df.first()["out"] == want, text


def test_required(spark):
    frame = NestedFrame(spark.createDataFrame([(1,), (None,)], "x int"))
    assert frame.filter("x is not None").define("y", lambda r: required(r.x) + 1).df.first()["y"] == 2
    with pytest.raises(Exception, match="required"):
        frame.define("y", "required(x)").df.collect()


def test_behaviors(nested):
    behave(["x", "y"], pz=lambda h: h.y * math.sinh(h.x))
    got = nested.define("z", lambda h: h.pz, at="hey").df.orderBy("k").first()["hey"]
    assert got[0]["z"] == pytest.approx(1.1 * math.sinh(1))


def test_map(nested):
    assert sorted(r[0] for r in nested.map(lambda h: h.x, at="hey").collect()) == [-4, 1, 2, 3, 5]

    def loop(h):
        total = 0
        for i in range(abs(h.x)):
            total += i
        return (h.x, total) if total else None

    got = nested.map(loop, at="hey", names=["x", "total"])
    assert got.columns == ["x", "total"] and sorted(map(tuple, got.collect())) == [(-4, 6), (2, 1), (3, 3), (5, 10)]
    assert sorted(r[0] for r in nested.map(lambda h: math.erf(h.y) if h.x < 2 else None, at="hey").collect()) == pytest.approx([math.erf(1.1), math.erf(4.4)])


def test_python_below_records(spark):
    frame = NestedFrame(spark.createDataFrame([(1, ([(1, "a"), (2, "b")], 5)), (2, None)], "k int, r struct<l:array<struct<x:int,s:string>>,n:int>"))

    def odd(h):
        return len([i for i in range(h.x) if i % 2 == 0]) % 2 == 1 and h.s != "q"

    got = frame.filter(odd, at="r/l").df.orderBy("k").collect()
    assert [tuple(x) for x in got[0]["r"]["l"]] == [(1, "a"), (2, "b")] and got[0]["r"]["n"] == 5 and got[1]["r"] is None
    got = frame.define("z", lambda h: math.lgamma(h.x + 2), at="r/l").df.orderBy("k").first()["r"]["l"]
    assert [x["z"] for x in got] == pytest.approx([math.lgamma(3), math.lgamma(4)])
    got = frame.define("z", lambda r: math.erf(r.n), at="r").df.orderBy("k").collect()
    assert got[0]["r"]["z"] == pytest.approx(1) and got[1]["r"] is None
    with pytest.raises(TypeError):
        frame.define("z", "n", at="k")


def test_reduce_counts_the_tally_once(spark):
    for parts in (1, 2, 5, 40):
        frame = NestedFrame(spark.range(10).repartitionByRange(parts, "id"))
        assert frame.reduce(100, lambda x, t: t + x, combiner=lambda a, b: a + b) == 145
        assert frame.reduce(2, lambda x, t: t * (x + 1), combiner=lambda a, b: a * b) == 2 * math.factorial(10)
        assert frame.reduce(">", lambda x, t: t + str(x), combiner=lambda a, b: a + b, zero="") == ">0123456789"
    with pytest.raises(ValueError):
        frame.reduce(3, lambda x, t: t - x, combiner=lambda a, b: a - b - 1)
    assert NestedFrame(spark.range(0)).reduce(5, lambda x, t: t + x, combiner=lambda a, b: a + b) == 5


def test_index_of_rows(spark, tmp_path):
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/t")
    got = NestedFrame(spark.read.parquet(f"{tmp_path}/t")).index("at").df.collect()
    assert sorted(r["at"] for r in got) == list(range(1000)) and all(r["at"] == r["id"] for r in got)
    got = NestedFrame(spark.read.parquet(f"{tmp_path}/t")).filter("id % 3 == 1").index("at").df.collect()
    assert len(got) == 333 and all(r["at"] == r["id"] // 3 for r in got)
    assert sorted(r["at"] for r in NestedFrame(spark.range(50, numPartitions=4)).index("at").df.collect()) == list(range(50))


def test_scans_read_what_is_kept(spark, tmp_path):
    rows = [(1, [(1, 1.1, "a"), None, (2, 2.2, "b")]), (2, [])]
    spark.createDataFrame(rows, "k int, hey array<struct<x:int,y:double,s:string>>").write.parquet(f"{tmp_path}/t")
    frame = NestedFrame.read(spark, f"{tmp_path}/t")
    for out in (frame.keep("k", "hey/x"), frame.drop("hey/y", "hey/s"), frame.project("hey/x"), frame.keep("k", "hey/x").filter("x > 1", at="hey"), frame.drop("hey/y", "hey/s").define("z", "x + 1", at="hey")):
        plan = out.df._jdf.queryExecution().executedPlan().toString()
        read = plan[plan.index("ReadSchema") :].split("\n")[0]
        assert "x:int" in read and "y:double" not in read and "s:string" not in read, read
    assert frame.keep("hey/x").df.first()["hey"][1] is None and [r[0] for r in frame.keep("hey/x").df.select("hey.x").collect()] == [[1, None, 2], []]


def test_unknown_names(spark):
    with pytest.raises(Untranslatable):
        NestedFrame(spark.range(3)).filter("nowhere(id)")


def test_folder_database(spark, tmp_path):
    db = FolderDatabase(spark, str(tmp_path / "db"))
    assert db.list() == []
    db.fromdata("one", [{"x": 1}, {"x": 2}, {"x": 3}], [{"x": 4}, {"x": 5}], doc="it's one", metadata={"from": "here"})
    assert db.list() == ["one"] and db.descriptor("one")["offsets"] == [0, 3, 5] and db.descriptor("one")["doc"] == "it's one"
    assert Schema.fromjson(db.descriptor("one")["schema"]) == infer([{"x": 1}])
    data = [1, 2, 3, 4, 5]
    for s in (slice(None), slice(1, -1), slice(None, None, 2), slice(None, None, -1), slice(-2, None), slice(4, 0, -2), slice(9, 20)):
        assert [r["x"] for r in db.slice("one", s.start, s.stop, s.step)] == data[s], s
    db.data.two = db.data.one.define("y", "x * x")
    db.data.two = db.data.two.filter("y > 4")
    assert sorted(r["y"] for r in db.data.two.df.collect()) == [9, 16, 25]
    db.delete("two")
    with pytest.raises(KeyError):
        db.get("two")


def test_iterators_fill_part_by_part(spark, tmp_path):
    read = []

    def values():
        for i in range(10):
            read.append(i)
            yield {"x": i}

    schema = infer([{"x": 1}])
    for db in (Database(spark, "iterdb"), FolderDatabase(spark, str(tmp_path / "db"))):
        db.fromiterdata("it", values(), schema, limit=4)
        assert db.descriptor("it")["offsets"] == [0, 4, 8, 10] and [r["x"] for r in db.partition("it", 1).df.orderBy("_pos").collect()] == [4, 5, 6, 7]
        db.fromiterdata("odd", values(), schema, limit=lambda count, x: x["x"] % 5 != 0)
        assert db.descriptor("odd")["offsets"] == [0, 5, 10] and [r["x"] for r in db.slice("odd", -1, None)] == [9]
        db.fromiterdata("none", [], schema)
        assert db.slice("none", 0, 5) == [] and db.get("none").df.count() == 0
        for name in ("it", "odd", "none"):
            db.delete(name)


def test_columns_of_several_datasets(spark):
    db = Database(spark, "zipdb")
    db.fromdata("a", [{"x": 1}, {"x": 2}], [{"x": 3}])
    db.fromdata("b", [{"y": 10}, {"y": 20}], [{"y": 30}])
    got = db.zipped("c", "a", "b").df.orderBy("_part", "_pos").collect()
    assert [(r["x"], r["y"]) for r in got] == [(1, 10), (2, 20), (3, 30)]
    for name in ("a", "b", "c"):
        db.delete(name)


def test_arrays_by_name(spark):
    schema = infer([{"x": 1, "y": [1.5, 2.5]}, {"x": 2, "y": [0.5]}])
    arrays = {
        "object-B": np.array([0]), "object-E": np.array([3]), "object-L-Fx-Du1": np.array([1, 2, 3]), "object-L-Fy-B": np.array([0, 2, 2]), "object-L-Fy-E": np.array([2, 2, 3]),
        "object-L-Fy-L-Df8": np.array([1.5, 2.5, 0.5]),
    }
    assert [tuple(r) for r in from_arrays(spark, schema, arrays).df.collect()] == [(1, [1.5, 2.5]), (2, []), (3, [0.5])]
    masked = Schema("list", parts=[Schema("primitive", "int64", nullable=True)])
    got = from_arrays(spark, masked, {"object-B": np.array([0]), "object-E": np.array([3]), "object-L-M": np.array([0, -1, 1]), "object-L-Di8": np.array([7, 9])})
    assert [r[0] for r in got.df.collect()] == [7, None, 9]


def test_masks_and_files(spark, tmp_path):
    mask = np.array([False, True, False, False, True, False, False, False, True, False])
    assert (mask_of_bits(bits_of_mask(mask), len(mask)) == mask).all() and len(bits_of_mask(mask)) == 2
    np.save(tmp_path / "a.npy", np.arange(25))
    np.save(tmp_path / "b.npy", np.arange(25) / 2)
    frame = from_npy(spark, str(tmp_path), rows=10)
    assert sorted(map(tuple, frame.df.collect())) == [(i, i / 2) for i in range(25)]


def test_prefixes(spark):
    df = spark.createDataFrame([(2, [1, 2], [3.0, 4.0], 5.0, True, 1, 9)], "nMu int, Mu_pt array<int>, Mu_eta array<double>, MET_pt double, HLT_a boolean, run int, Odd_one int")
    out = group_by_prefix(df).df
    assert out.columns == ["Mu", "MET", "HLT", "run", "Odd_one"]
    row = out.first()
    assert [tuple(m) for m in row["Mu"]] == [(1, 3.0), (2, 4.0)] and row["MET"]["pt"] == 5 and row["HLT"]["a"] is True


def test_filters_of_nested_rows_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 5), (1, None), (2, 1), (9, 7), (None, 8)], "k int, x int").write.parquet(f"{tmp_path}/t")
    frame = nest(spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.read.parquet(f"{tmp_path}/t"), "id", "k", ["x"])
    out = frame.filter("x > 1", at="items").filter(lambda r: r.x < 6, at="items")
    assert {r["id"]: [i["x"] for i in r["items"]] for r in out.df.collect()} == {1: [5], 2: [], 3: []}
    assert "GreaterThan(x,1), LessThan(x,6)" in out.df._jdf.queryExecution().executedPlan().toString()
    held = frame.index("i", at="items").filter("i == 1", at="items")  # the place in the list before the filter
    assert {r["id"]: [i["x"] for i in r["items"]] for r in held.df.collect()} == {1: [5], 2: [], 3: []}


def test_python_filters_run_once_an_item(nested, spark):
    calls = spark.sparkContext.accumulator(0)

    def odd(h):
        calls.add(1)
        return len([i for i in range(abs(h.x)) if i % 2 == 0]) % 2 == 1

    out = nested.filter(odd, at="hey").df.select("k", F.inline("hey"))
    calls.value = 0  # the function was tried on symbols
    assert sorted(r["x"] for r in out.collect()) == [1, 2, 5] and calls.value == 5


def test_values_of_arrow_columns():
    names = T._parse_datatype_string("struct<x:int,count:string,l:array<struct<y:double>>,t:timestamp,b:binary,m:map<string,int>>")
    when = datetime.datetime(2020, 1, 2, tzinfo=datetime.timezone.utc)
    rows = [{"x": 1, "count": "a", "l": [{"y": 0.5}, None], "t": when, "b": b"q", "m": [("k", 2)]}, None, {"x": None, "count": None, "l": None, "t": None, "b": None, "m": None}] * 2
    got = batches.values(pa.array(rows, to_arrow_type(names)).slice(1, 3), names)  # a part of an array is read as such
    want = ArrowTableToRowsConversion._create_converter(names)
    assert got == [want(x) for x in rows[1:4]] and got[0] is None and got[1].l is None
    full = got[2]
    assert full.x == full["x"] == full[0] == 1 and full.l[0].y == 0.5 and full.l[1] is None and callable(full.count) and full["count"] == "a"
    assert isinstance(full, Row) and full.asDict(True)["l"] == [{"y": 0.5}, None] and "x" in full and full.__fields__ == names.names and pickle.loads(pickle.dumps(full)) == full
    with pytest.raises(AttributeError):
        full.nowhere
    lists = T.ArrayType(T.LongType())
    array = pa.array([[9], [1, 2, 3], None, [], [4]], to_arrow_type(lists)).slice(1)
    assert batches.kept(array, lists, lambda x: x != 2).to_pylist() == [[1, 3], None, [], [4]] and batches.kept(array.slice(4), lists, bool).to_pylist() == []


def test_python_definitions_run_once_a_record(nested, spark):
    calls = spark.sparkContext.accumulator(0)

    def shown(h):
        calls.add(1)
        return f"{h.x:+d}"

    out = nested.define("s", shown, at="hey", fieldtype="string").df.select(F.inline("hey"))
    calls.value = 0
    assert sorted(r["s"] for r in out.collect()) == ["+1", "+2", "+3", "+5", "-4"] and calls.value == 5
    out = NestedFrame(nested.df.select(F.inline("hey"))).define("s", shown, fieldtype="string").df.where("s > '+' and s is not null")
    calls.value = 0
    assert out.count() == 5 and calls.value == 5
    rows = [(1, [[(1, None), None], None, []]), (2, None), (3, [[(7, 8)]])]
    deep = NestedFrame(spark.createDataFrame(rows, "k int, l array<array<struct<x:int,y:int>>>"))
    got = deep.define("x", lambda h: f"{h.x:03d}", at="l", fieldtype="string").df.orderBy("k").collect()
    assert [r["l"] for r in got] == [[[("001", None), None], None, []], None, [[("007", 8)]]]


def test_python_maps_run_once_an_item_and_are_tried_on_few(nested, spark):
    calls = spark.sparkContext.accumulator(0)

    def shown(h):
        calls.add(1)
        if h.x == 99:
            raise ValueError("no parent has it")
        return (h.x, f"{h.x:+d}") if h.x != 3 else None

    out = nested.map(shown, at="hey", names=["x", "s"])
    calls.value = 0
    assert sorted(map(tuple, out.collect())) == [(-4, "-4"), (1, "+1"), (2, "+2"), (5, "+5")] and calls.value == 5
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            read.add(part.num_rows)
            yield part

    children = spark.range(0, 4000, 1, 4).selectExpr("if(id % 10 = 0, 9, id % 10) as k", "if(id % 10 in (0, 9), 99, id) as x").mapInArrow(counted, "k bigint, x bigint")
    frame = nest(spark.range(9), children, "id", "k", ["x"])
    out = frame.map(shown, at="items")
    assert read.value <= 1000  # of four parts at most one is read to its end, and none is shuffled
    assert out.dtypes == [("f0", "bigint"), ("f1", "string")] and out.count() == sum(i % 10 not in (0, 9) and i != 3 for i in range(4000))

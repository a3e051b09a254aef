"""The fifteen operators on small literals."""

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from arborframe.functions import Untranslatable
from arborframe.operators import NestedFrame


@pytest.fixture()
def nested(spark):
    """Rows with 3, 0 and 2 items."""
    rows = [(1, [(1, 1.1), (2, 2.2), (3, 3.3)]), (2, []), (3, [(4, 4.4), (5, 5.5)])]
    return NestedFrame(spark.createDataFrame(rows, "k int, hey array<struct<x:bigint,y:double>>"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def xs(frame, column="hey"):
    return [[i["x"] for i in r[column]] for r in frame.df.orderBy("k").collect()]


def test_fieldname_moves_to_the_end_and_overwrites(nested):
    assert nested.fieldname("z", "hey/x").df.schema["hey"].dataType.elementType.names == ["y", "z"]
    assert nested.fieldname("y", "hey/x").df.schema["hey"].dataType.elementType.names == ["y"]
    assert nested.fieldname("id", "k").df.columns == ["hey", "id"]
    with pytest.raises(TypeError):
        nested.fieldname("z", "")


def test_recordname(nested):
    out = nested.recordname("Hit", "hey")
    assert out.names[("hey",)] == "Hit"
    assert out.df.schema["hey"].metadata == {"record:hey": "Hit"}
    with pytest.raises(TypeError):
        nested.recordname("Hit", "k")


def test_project_unwraps(nested):
    assert [r[0] for r in rows(nested.project("hey/x").df)] == [[1, 2, 3], [], [4, 5]]
    with pytest.raises(TypeError):
        nested.project("none")


def test_keep_and_drop(nested):
    assert nested.keep("hey/x").df.columns == ["hey"]
    assert xs(nested.keep("k", "*/x")) == [[1, 2, 3], [], [4, 5]]
    assert nested.drop("hey/y").df.schema["hey"].dataType.elementType.names == ["x"]
    assert nested.drop("hey/*").df.columns == ["k"]
    assert nested.drop("none") is nested
    with pytest.raises(TypeError):
        nested.drop("*")
    with pytest.raises(TypeError):
        nested.keep("none")


def test_split_and_merge(nested):
    out = nested.split("hey/x", "hey/y")
    assert set(out.df.columns) == {"k", "x", "y"}
    assert xs(out.merge("hey", "x", "y")) == [[1, 2, 3], [], [4, 5]]
    assert set(nested.split("k")) == {"original", "k"}
    with pytest.raises(TypeError):
        nested.split("none")
    with pytest.raises(ValueError):
        out.merge("a/b", "x", "y")


def test_merge_of_unequal_lists_fails(spark):
    frame = NestedFrame(spark.createDataFrame([([1, 2], [1])], "a array<int>, b array<int>"))
    with pytest.raises(Exception, match="differ in length"):
        frame.merge("c", "a", "b").df.collect()


def test_parent_and_index(nested):
    out = nested.parent("up", "hey").index("i", "hey").df.orderBy("k").collect()
    assert [(i["up"]["k"], i["i"]) for r in out for i in r["hey"]] == [(1, 0), (1, 1), (1, 2), (3, 0), (3, 1)]


def test_tomask(spark):
    frame = NestedFrame(spark.createDataFrame([(float("nan"),), (2.0,), (3.0,)], "one double"))
    assert [r[0] for r in rows(frame.tomask("one", float("nan")).df)] == [None, 2.0, 3.0]
    assert [r[0] for r in rows(frame.tomask("one", 2.0).df)][1:] == [None, 3.0]
    out = [r[0] for r in rows(frame.tomask("one", 2.0, 3.0).df)]
    assert math.isnan(out[0]) and out[1:] == [None, None]
    with pytest.raises(ValueError):
        frame.tomask("one", float("nan"), 1.0)


def test_flatten(spark):
    frame = NestedFrame(spark.createDataFrame([([[1, 2, 3], [], [4, 5]],), ([],), ([[], []],)], "x array<array<int>>"))
    assert [r[0] for r in rows(frame.flatten("x").df)] == [[1, 2, 3, 4, 5], [], []]
    assert sorted(r[0] for r in rows(NestedFrame(spark.createDataFrame([([1],), ([2, 3],)], "v array<int>")).flatten().df)) == [1, 2, 3]


def test_filter(nested, spark):
    assert xs(nested.filter("x > 2", at="hey")) == [[3], [], [4, 5]]
    assert xs(nested.filter(lambda h, least: h.x > least, args=2, at="hey").filter(lambda h: h.x < 5, at="hey")) == [[3], [], [4]]
    flat = NestedFrame(spark.createDataFrame([(i,) for i in range(1, 6)], "value int"))
    assert [r[0] for r in rows(flat.filter("value % 2 == 1").df)] == [1, 3, 5]
    assert rows(nested.filter(lambda r: len(r.hey) == 0).df)[0][0] == 2


def test_filter_by_a_loop_stays_python(nested):
    def odd(h):
        total = 0
        for _ in range(int(h.x)):
            total = 1 - total
        return total == 1

    assert xs(nested.filter(odd, at="hey")) == [[1, 3], [], [5]]


def test_define(nested):
    out = nested.define("z", "x + y", at="hey").df.orderBy("k").collect()
    assert [round(i["z"], 1) for i in out[0]["hey"]] == [2.1, 4.2, 6.3]
    out = nested.define("z", lambda h: h.x + 10 if h.x % 2 != 0 else None, at="hey").df.orderBy("k").collect()
    assert [i["z"] for i in out[0]["hey"]] == [11, None, 13]
    assert [r[0] for r in rows(nested.define("n", lambda r: len(r.hey)).df.orderBy("k").select("n"))] == [3, 0, 2]


def test_map(nested):
    assert sorted(rows(nested.map(lambda h: (h.x, h.y), at="hey"))) == [(1, 1.1), (2, 2.2), (3, 3.3), (4, 4.4), (5, 5.5)]
    assert nested.map(lambda h: (h.x, h.y), at="hey").columns == ["f0", "f1"]
    assert sorted(rows(nested.map("x", at="hey", names=["one"]))) == [(i,) for i in range(1, 6)]
    assert sorted(rows(nested.map(lambda h: (h.x,) if h.x % 2 == 1 else None, at="hey"))) == [(1,), (3,), (5,)]


def test_reduce(nested):
    assert nested.reduce(0, lambda h, t: h.x + t, at="hey") == 15
    assert nested.reduce(100, lambda h, t: t + h.x * h.x, at="hey") == 155
    assert nested.reduce(9, lambda h, t: min(h.x, t), at="hey") == 1
    assert nested.reduce(1, lambda h, t: h["x"] * t, at="hey", combiner=lambda a, b: a * b) == 120
    with pytest.raises(Untranslatable):
        nested.reduce(1, lambda h, t: t * h.x, at="hey")


def test_python_semantics(spark):
    frame = NestedFrame(spark.createDataFrame([(-7, 2, [1, 2, 3])], "a int, b int, l array<int>"))
    for text, want in {"a // b": -4, "a % b": 1, "b ** 3": 8, "1 if a < 0 < b else 2": 1, "len(l)": 3, "l[-1]": 3, "2 in l": True, "not (a > b or b > 5)": True, "l.index(3)": 2, "max(a, b)": 2, "sqrt(b * 2)": 2.0}.items():
        assert frame.define("out", text).df.first()["out"] == want, text


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(-12, 12) | st.none(), st.integers(-12, 12) | st.none(), st.sampled_from([1, 2, 3, -1, -2, None]))
def test_slices(spark, start, stop, step):
    from arborframe.functions.translate import slice_

    df = spark.createDataFrame([(list(range(10)),), ([],)], "a array<int>")
    got = [r[0] for r in df.select(slice_(df.a, start, stop, step)).collect()]
    assert got == [list(range(10))[start:stop:step], []]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(-50, 50), max_size=5), min_size=1, max_size=4), st.integers(-20, 20), st.integers(-20, 20))
def test_stacked_filters(spark, data, low, high):
    df = spark.createDataFrame([(i, [(x,) for x in v]) for i, v in enumerate(data)], "k int, hey array<struct<x:int>>")
    frame = NestedFrame(df)
    stacked = frame.filter(lambda h: h.x > low, at="hey").filter(lambda h: h.x < high, at="hey")
    assert xs(stacked) == xs(frame.filter(lambda h: h.x > low and h.x < high, at="hey")) == [[x for x in v if low < x < high] for v in data]

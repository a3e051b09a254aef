"""Types, inference, sources, catalog, pointers, unions and streams."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborframe.operators import NestedFrame, links
from arborframe.schema import Schema, infer
from arborframe.sources import Database, from_arrow, from_npy, fromdata, group_by_prefix, to_json, with_position, write_npy
from arborframe.streaming import running


@pytest.mark.parametrize(
    "value, dtype",
    [(0, "uint8"), (255, "uint8"), (256, "uint16"), (65535, "uint16"), (65536, "uint32"), (2**32 - 1, "uint32"), (2**32, "uint64"), (2**64 - 1, "uint64"), (2**64, "float64")]
    + [(-1, "int8"), (-128, "int8"), (-129, "int16"), (-(2**15) - 1, "int32"), (-(2**63), "int64"), (-(2**63) - 1, "float64")],
)
def test_smallest_integer(value, dtype):
    assert infer([value]).parts[0].dtype == dtype


def test_inference():
    assert infer([1, 2.5]).parts[0].dtype == "float64"
    assert infer([255, -1]).parts[0].dtype == "int16"
    assert infer([1, None]).parts[0].nullable
    assert infer([[1], 2]).parts[0].kind == "union"
    assert infer([{"a": 1}, {"b": 2}]).parts[0].kind == "union"
    assert infer([{"a": None}, {"a": 2}]).parts[0].parts[0].nullable
    for bad in ([], [None]):
        with pytest.raises(TypeError):
            infer(bad)
    loop: list = []
    loop.append(loop)
    with pytest.raises(ValueError):
        infer(loop)


def test_json_and_membership():
    s = infer([{"a": 1, "b": [1.5, None]}, {"a": 300, "b": [2.0]}])
    assert Schema.fromjson(s.tojsonstring()) == s
    assert [{"a": 7, "b": []}] in s and [{"a": -7, "b": []}] not in s
    assert s.path("a").dtype == "uint16" and [p for p, _ in s.paths("*")] == [()]
    with pytest.raises(TypeError):
        s.cast(3)


def test_fromdata_round_trip(spark):
    data = [{"a": 1, "b": [1.5, None]}, {"a": 2, "b": [0.5]}]
    assert [r.asDict() for r in fromdata(spark, data).df.collect()] == data
    mixed = fromdata(spark, [1, [2, 3]]).df.collect()
    assert [r["value"]["tag"] for r in mixed] == [0, 1]


def test_sources(spark, tmp_path):
    frame = from_arrow(spark, pa.table({"x": [1, 2], "y": [[1.0], []]}))
    assert frame.df.count() == 2
    write_npy(frame.keep("x"), str(tmp_path / "c"))
    assert [r[0] for r in from_npy(spark, str(tmp_path / "c")).df.collect()] == [1, 2]
    df = spark.createDataFrame([([1, 2], [3.0, 4.0], 5)], "Mu_pt array<int>, Mu_eta array<double>, MET_pt int")
    out = group_by_prefix(df).df.first()
    assert [tuple(m) for m in out["Mu"]] == [(1, 3.0), (2, 4.0)] and out["MET"]["pt"] == 5
    assert to_json(frame).first()[0] == '{"x":1,"y":[1.0]}'
    placed = with_position(spark.range(100, numPartitions=7).selectExpr("99 - id as v"), ["v"]).collect()
    assert all(r["v"] == r["_pos"] for r in placed)


def test_catalog(spark):
    db = Database(spark, "testdb")
    db.fromdata("one", [{"x": 1}, {"x": 2}, {"x": 3}], [{"x": 4}, {"x": 5}, {"x": 6}])
    assert [r["x"] for r in db.slice("one", -2)] == [5, 6] and [r["x"] for r in db.slice("one", 2, 4)] == [3, 4]
    assert db.partition("one", 1).reduce(0, lambda r, t: r.x + t) == 15
    db.data.two = db.data.one.filter("x > 4").define("y", "x * 2")
    assert db.list() == ["one", "two"]
    assert sorted(r["y"] for r in db.data.two.df.collect()) == [10, 12]
    del db.data.two
    db.delete("one")
    assert db.list() == []
    with pytest.raises(KeyError):
        db.get("one")


def test_pointers_and_unions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, s string")
    rows, target = links.dictionary(df, ["s"])
    assert target.count() == 2
    back = links.deref(rows, "_pos", target.withColumnRenamed("_pos", "p"), "p", ["s"])
    assert sorted((r["k"], r["s"]) for r in back.collect()) == [(1, "a"), (2, "b"), (3, "a")]
    nodes = spark.createDataFrame([(0, 1), (1, 2), (2, None)], "n bigint, next bigint")
    assert [r["node"] for r in links.chase(spark, nodes, "n", "next", 0).orderBy("depth").collect()] == [0, 1, 2]
    u = df.select(links.union((F.col("k") == 1, F.col("k")), (F.lit(True), F.col("s"))).alias("u"))
    assert [r[0] for r in u.select(links.case(F.col("u"), 0)).collect()] == [True, False, False]
    with pytest.raises(Exception, match="not alternative"):
        u.select(links.cast(F.col("u"), 0)).collect()


def test_streams(spark, tmp_path):
    spark.createDataFrame([([1, 2, 3],), ([4],)], "v array<int>").write.parquet(str(tmp_path / "in"))
    stream = NestedFrame(spark.readStream.schema("v array<int>").parquet(str(tmp_path / "in")))
    out = running(stream.filter(lambda x: x > 1, at="v"), 10, lambda x, t: x + t, at="v")
    q = out.writeStream.format("memory").queryName("folded").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("folded").first()[0] == 19

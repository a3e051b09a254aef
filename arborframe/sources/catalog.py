"""Named datasets: recast ones as views, others as tables, in the warehouse or in a folder of their own."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from arborframe.operators.frame import NestedFrame
from arborframe.schema import Schema, infer

_DESCRIPTOR = "arborframe.dataset"


class _Data:
    def __init__(self, database: Database):
        object.__setattr__(self, "_database", database)

    def __getattr__(self, name: str) -> NestedFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._database.get(name)

    def __setattr__(self, name: str, frame) -> None:
        self._database.put(name, frame)

    def __delattr__(self, name: str) -> None:
        self._database.delete(name)


def described(schema: Schema | None, offsets: list[int], doc: str | None = None, metadata=None, columns: T.StructType | None = None) -> dict:
    """A dataset's descriptor, as JSON has it: its type, where its parts begin, and what is said about it."""
    out = {"schema": schema.tojson() if schema else None, "offsets": offsets, "doc": doc, "metadata": metadata}
    return out | ({"columns": columns.jsonValue()} if columns is not None else {})


class Database:
    """db.data.x reads, sets and deletes; put(..., materialize=True) writes a table, else a view is kept."""

    def __init__(self, spark: SparkSession, name: str = "default"):
        self.spark, self.name, self.data = spark, name, _Data(self)
        spark.sql(f"create database if not exists `{name}`")

    def _table(self, name: str) -> str:
        return f"`{self.name}`.`{name}`"

    # -- what a database of another kind does its own way

    def list(self) -> list[str]:
        views = {t.name.removeprefix(f"{self.name}__") for t in self.spark.catalog.listTables() if t.isTemporary and t.name.startswith(f"{self.name}__")}
        return sorted(views | {t.name for t in self.spark.catalog.listTables(self.name) if not t.isTemporary})

    def get(self, name: str) -> NestedFrame:
        view = f"{self.name}__{name}"
        if self.spark.catalog.tableExists(view):
            return NestedFrame(self.spark.table(view))
        if not self.spark.catalog.tableExists(self._table(name)):
            raise KeyError(name)
        return NestedFrame(self.spark.table(self._table(name)))

    def put(self, name: str, frame: NestedFrame | DataFrame, materialize: bool = False) -> None:
        df = frame.df if isinstance(frame, NestedFrame) else frame
        if materialize:
            df.write.mode("overwrite").saveAsTable(self._table(name))
            self.spark.catalog.dropTempView(f"{self.name}__{name}")
        else:
            df.createOrReplaceTempView(f"{self.name}__{name}")

    def delete(self, name: str) -> None:
        if name not in self.list():
            raise KeyError(name)
        self.spark.catalog.dropTempView(f"{self.name}__{name}")
        self.spark.sql(f"drop table if exists {self._table(name)}")

    def descriptor(self, name: str) -> dict:
        """The dataset's descriptor, from the table's properties; of a table without one, its columns only."""
        if name not in self.list():
            raise KeyError(name)
        if not self.spark.catalog.tableExists(self._table(name)):
            return described(None, [], columns=self.get(name).df.schema)
        held = {r[0]: r[1] for r in self.spark.sql(f"show tblproperties {self._table(name)}").collect()}
        return json.loads(held[_DESCRIPTOR]) if _DESCRIPTOR in held else described(None, [], columns=self.get(name).df.schema)

    def describe(self, name: str, descriptor: dict) -> None:
        body = json.dumps(descriptor).replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"alter table {self._table(name)} set tblproperties ('{_DESCRIPTOR}' = '{body}')")

    def _append(self, name: str, df: DataFrame, first: bool) -> None:
        df.write.mode("overwrite" if first else "append").saveAsTable(self._table(name))

    # -- the same for all

    def fromdata(self, name: str, *partitions, schema: Schema | None = None, doc: str | None = None, metadata=None) -> NestedFrame:
        """A table from Python data, one part an argument, with columns _part and _pos that keep the order."""
        schema = schema or infer([x for p in partitions for x in p])
        return self._filled(name, partitions, schema, doc, metadata)

    def fromiterdata(self, name: str, values: Iterable, schema: Schema, limit: int | Callable[[int, object], bool] = 10_000, doc: str | None = None, metadata=None) -> NestedFrame:
        """A table from an iterator, part by part, each written before the next is read: a part has `limit` values, or
        as long as limit(its number of values, the next value) holds."""
        full = limit if callable(limit) else lambda count, _: count < limit

        def parts():
            held = []
            for x in values:
                if held and not full(len(held), x):
                    yield held
                    held = []
                held.append(x)
            if held:
                yield held

        return self._filled(name, parts(), schema, doc, metadata)

    def _filled(self, name, partitions, schema: Schema, doc, metadata) -> NestedFrame:
        item = schema.parts[0]
        record = item.spark() if item.kind == "record" else T.StructType([T.StructField("value", item.spark(), True)])
        kind = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_pos", T.LongType()), *record.fields])
        offsets = [0]
        for i, part in enumerate(partitions):
            rows = [(i, k, *(item.fill(x) if item.kind == "record" else (item.fill(x),))) for k, x in enumerate(part)]
            self._append(name, self.spark.createDataFrame(rows, kind), i == 0)
            offsets.append(offsets[-1] + len(rows))
        if len(offsets) == 1:
            self._append(name, self.spark.createDataFrame([], kind), True)
        self.describe(name, described(schema, offsets, doc, metadata))
        return self.get(name)

    def partition(self, name: str, i: int) -> NestedFrame:
        return NestedFrame(self.get(name).df.where(F.col("_part") == i))

    def slice(self, name: str, start: int | None, stop: int | None = None, step: int | None = None) -> list:
        """Rows by place over all parts, as Python slices a list, collected: for a few rows."""
        df = self.get(name).df
        offsets = self.descriptor(name)["offsets"]
        if not offsets:
            counts = [r[1] for r in df.groupBy("_part").count().orderBy("_part").collect()]
            offsets = [sum(counts[:i]) for i in range(len(counts) + 1)]
        if offsets[-1] == 0:
            return []
        lo, hi, by = slice(start, stop, step).indices(offsets[-1])
        first, last = (lo, hi) if by > 0 else (hi + 1, lo + 1)
        at = F.element_at(F.array(*map(F.lit, offsets[:-1])), F.col("_part") + 1) + F.col("_pos")
        some = df.withColumn("_at", at).where((F.col("_at") >= first) & (F.col("_at") < last) & (F.pmod(F.col("_at") - lo, F.lit(abs(by))) == 0))
        return some.orderBy("_at" if by > 0 else F.col("_at").desc()).drop("_part", "_pos", "_at").collect()

    def zipped(self, name: str, *parts: str) -> NestedFrame:
        """A dataset whose columns come from several, joined by part and place; kept as a view where views are."""
        out = self.get(parts[0]).df
        for p in parts[1:]:
            out = out.join(self.get(p).df, ["_part", "_pos"])
        self.put(name, NestedFrame(out))
        return self.get(name)


class FolderDatabase(Database):
    """Datasets as folders below one: Parquet files and a descriptor, on any store that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.data = spark, folder.rstrip("/"), _Data(self)

    def _path(self, *names: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def list(self) -> list[str]:
        files, path = self._path()
        return sorted(x.getPath().getName() for x in files.listStatus(path) if x.isDirectory()) if files.exists(path) else []

    def get(self, name: str) -> NestedFrame:
        if name not in self.list():
            raise KeyError(name)
        return NestedFrame.read(self.spark, f"{self.folder}/{name}/data")

    def put(self, name: str, frame: NestedFrame | DataFrame, materialize: bool = True) -> None:
        """Written beside what is there and then put in its place, as the frame may read it."""
        df = frame.df if isinstance(frame, NestedFrame) else frame
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/next")
        files, there = self._path(name, "data")
        files.delete(there, True)
        files.rename(self._path(name, "next")[1], there)
        self.describe(name, described(None, [], columns=df.schema))

    def delete(self, name: str) -> None:
        if name not in self.list():
            raise KeyError(name)
        files, path = self._path(name)
        files.delete(path, True)

    def descriptor(self, name: str) -> dict:
        if name not in self.list():
            raise KeyError(name)
        return json.loads(self.spark.read.text(f"{self.folder}/{name}/dataset.json", wholetext=True).first()[0])

    def describe(self, name: str, descriptor: dict) -> None:
        files, path = self._path(name, "dataset.json")
        out = files.create(path, True)
        out.write(bytearray(json.dumps(descriptor).encode()))
        out.close()

    def _append(self, name: str, df: DataFrame, first: bool) -> None:
        df.write.mode("overwrite" if first else "append").parquet(f"{self.folder}/{name}/data")

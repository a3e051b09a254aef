"""Readers and writers: Python data, Arrow tables, column directories, prefixed columns, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from arborframe.operators.frame import NestedFrame
from arborframe.plans.places import placed
from arborframe.schema import Schema, infer


def fromdata(spark: SparkSession, data: list, schema: Schema | None = None) -> NestedFrame:
    """A frame of Python objects; the schema is inferred where none is given."""
    schema = schema or infer(data)
    item = schema.parts[0]
    if item.kind == "record":
        return NestedFrame(spark.createDataFrame([item.fill(x) for x in data], item.spark()))
    return NestedFrame(spark.createDataFrame([(item.fill(x),) for x in data], T.StructType([T.StructField("value", item.spark(), True)])))


def from_arrow(spark: SparkSession, table) -> NestedFrame:
    return NestedFrame(spark.createDataFrame(table))


def from_npy(spark: SparkSession, directory: str, rows: int = 1 << 20) -> NestedFrame:
    """Columns of equal length, one .npy file each.  From a folder that executors share, tasks of `rows` rows map the
    parts of the files they need, and the driver reads the headers only; from elsewhere, whole files reach the driver."""
    import io
    from pathlib import Path, PurePosixPath

    import numpy as np
    import pyarrow as pa

    folder = Path(directory.removeprefix("file://"))
    if not folder.is_dir():
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(directory).select("path", "content").orderBy("path").collect()
        return from_arrow(spark, pa.table({PurePosixPath(f.path).stem: pa.array(np.load(io.BytesIO(bytes(f.content)))) for f in files}))
    heads = {f.stem: np.load(f, mmap_mode="r") for f in sorted(folder.glob("*.npy"))}
    sizes = {len(a) for a in heads.values()}
    if len(sizes) != 1:
        raise ValueError("the columns differ in length")
    (n,) = sizes
    empty = pa.table({c: pa.array(a[:0]) for c, a in heads.items()})
    schema = spark.createDataFrame(empty).schema
    paths = {c: str(folder / f"{c}.npy") for c in heads}

    def read(batches):
        for batch in batches:
            for at in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({c: pa.array(np.array(np.load(p, mmap_mode="r")[at * rows : (at + 1) * rows])) for c, p in paths.items()})

    parts = max(1, -(-n // rows))
    return NestedFrame(spark.range(0, parts, 1, parts).mapInArrow(read, schema))


def from_arrays(spark: SparkSession, schema: Schema, arrays, prefix: str = "object", delimiter: str = "-") -> NestedFrame:
    """A frame of anything that gives flat arrays by name, for data of the driver's size.

    Names are the path of types from the prefix: N and a name, M mask, B and E begins and ends of lists, L their
    content, F and a field, T and O tags and offsets of unions, U and an alternative, D and a type code.
    """
    return fromdata(spark, _objects(schema, arrays, prefix, delimiter), schema)


def _named(arrays, stem: str, delimiter: str):
    """The array whose name goes on from the stem with a type code."""
    found = [k for k in arrays if k.startswith(stem + delimiter + "D")]
    if len(found) != 1:
        raise KeyError(stem)
    return arrays[found[0]]


def _objects(schema: Schema, arrays, stem: str, delimiter: str):
    """Python values, one for each entry of the arrays; of a list at the top, its items."""
    import numpy as np

    def values(s: Schema, stem: str, count: int | None):
        stem = stem + delimiter + "N" + s.name if s.name else stem
        here = None
        if s.nullable:
            mask = np.asarray(arrays[stem + delimiter + "M"])
            # a mask gives each value's place, or a negative number where it is null
            here, count = mask, int(mask.max(initial=-1)) + 1
        if s.kind == "primitive":
            data = np.asarray(_named(arrays, stem, delimiter))
            out = data.tolist()
        elif s.kind == "list":
            begin, end = (np.asarray(arrays[stem + delimiter + x]) for x in "BE")
            inside = values(s.parts[0], stem + delimiter + "L", int(end.max(initial=0)))
            out = [inside[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        elif s.kind in ("record", "tuple"):
            names = s.fields if s.kind == "record" else [str(i) for i in range(len(s.parts))]
            parts = [values(p, stem + delimiter + "F" + n, count) for n, p in zip(names, s.parts)]
            out = [dict(zip(names, x)) if s.kind == "record" else x for x in zip(*parts)]
        elif s.kind == "union":
            tags, offsets = (np.asarray(arrays[stem + delimiter + x]).tolist() for x in "TO")
            parts = [values(p, f"{stem}{delimiter}U{i}", None) for i, p in enumerate(s.parts)]
            out = [parts[t][o] for t, o in zip(tags, offsets)]
        else:
            raise TypeError(f"no arrays of a {s.kind}")
        return out if here is None else [None if i < 0 else out[i] for i in here.tolist()]

    top = values(schema, stem, None)
    return top[0] if schema.kind == "list" else top[:1]


def bits_of_mask(column):
    """A mask of nulls as packed bits, one a value, lowest first."""
    import numpy as np

    return np.packbits(~np.asarray(column, bool), bitorder="little")


def mask_of_bits(bits, count: int):
    """The mask of nulls that bits_of_mask() packed: padding bits are left out."""
    import numpy as np

    return ~np.unpackbits(np.asarray(bits, np.uint8), count=count, bitorder="little").astype(bool)


def write_npy(frame: NestedFrame, directory: str) -> None:
    """For small frames of flat columns: one .npy file a column, in a local folder."""
    from pathlib import Path

    import numpy as np

    table = frame.df.toArrow()
    Path(directory).mkdir(parents=True, exist_ok=True)
    for name in table.column_names:
        np.save(Path(directory) / f"{name}.npy", table.column(name).to_numpy())


#: Prefixes whose columns are always one record.
RECORDS = ("MET", "LHE", "Pileup", "PV", "HLT", "Flag")


def group_by_prefix(df: DataFrame, lists: bool = True, records: tuple[str, ...] = RECORDS) -> NestedFrame:
    """Columns `Muon_pt, Muon_eta` become `Muon`: a list of records where they are lists, else a record.  Prefixes of
    `records` become records even of a single column; a lone column of another prefix stays as it is.

    Lists of one prefix must be of one length, or an error is raised; a column `nMuon` that counts them goes.
    """
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(c.split("_", 1)[0] if "_" in c else c, []).append(c)
    listed = {p for p, columns in groups.items() if lists and all("_" in c and isinstance(df.schema[c].dataType, T.ArrayType) for c in columns)}
    out = []
    for prefix, columns in groups.items():
        if columns == [prefix]:
            if not (prefix.startswith("n") and prefix[1:] in listed):
                out.append(F.col(prefix))
            continue
        parts = [F.col(c).alias(c.split("_", 1)[1] if "_" in c else c) for c in columns]
        if prefix in listed:
            sizes = [F.size(c) for c in columns]
            same = F.lit(True)
            for s in sizes[1:]:
                same = same & sizes[0].eqNullSafe(s)
            out.append(F.when(same, F.arrays_zip(*parts)).otherwise(F.raise_error(F.lit(f"lists of {prefix} differ in length"))).alias(prefix))
        elif len(columns) > 1 or prefix in records:
            out.append(F.struct(*parts).alias(prefix))
        else:
            out.append(F.col(columns[0]))
    return NestedFrame(df.select(*out))


def nest(parents: DataFrame, children: DataFrame, key: str, child_key: str, fields: list[str], name: str = "items") -> NestedFrame:
    """Parents with the list of their children, sorted on the whole record; childless parents keep an empty one.

    Filters of that list, directly after, are filters of the children: their scan gets them, and what they drop is not
    shuffled.  They then see children without a parent, too.
    """
    rows = children.select(F.col(child_key).alias("_key"), *fields)

    def nested(rows: DataFrame) -> NestedFrame:
        listed = rows.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
        joined = parents.join(listed, parents[key] == F.col("_key"), "left").drop("_key")
        empty = F.array().cast(listed.schema[name].dataType)
        out = NestedFrame(joined.withColumn(name, F.coalesce(name, empty)))
        out.nested = name, rows, nested, lambda n: firsts(rows, n)
        return out

    def firsts(rows: DataFrame, n: int) -> list:
        """Up to n of the listed records, of the first rows that the scan gives: nothing is shuffled for them."""
        some = rows.select("_key", F.struct(*fields)).limit(n).collect()
        keys = [r[0] for r in some if r[0] is not None]
        there = {r[0] for r in parents.where(F.col(key).isin(keys)).select(key).distinct().collect()}
        return [r[1] for r in some if r[0] in there]

    return nested(rows)


def with_position(df: DataFrame, order: list[str], name: str = "_pos") -> DataFrame:
    """Each row's place in the order, from 0, without gathering rows in one task: range partitions and their offsets."""
    return placed(df, order, name)


def to_json(frame: NestedFrame) -> DataFrame:
    """One JSON text a row; NaN and infinities become strings, as they have no JSON form."""
    return frame.df.select(F.to_json(F.struct("*")).alias("json"))

"""A lazy DataFrame whose rows are the items of a top-level list of records."""

from __future__ import annotations

import functools
import logging
import math
import pickle

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from arborframe.functions.translate import Maybe, Tally, Untranslatable, column, compiled, typed
from arborframe.operators import batches
from arborframe.plans.paths import inner, narrowed_type, pruned, rebuilt, resolve, rewritten, through_lists, type_at
from arborframe.plans.places import placed

_log = logging.getLogger(__name__)
#: Items on which a function that stays Python is tried to learn the type of its results, and partial tallies that one
#: task combines.
TRIED, COMBINED = 100, 512


class NestedFrame:
    """Operators are lazy and return a new frame; map and reduce give a DataFrame and a value."""

    def __init__(self, df: DataFrame, names: dict[tuple[str, ...], str] | None = None, scan=None):
        """scan: reads the same rows by a narrower schema, so that keep, drop and project leave the rest unread."""
        self.df, self.names, self.scan = df, dict(names or {}), scan
        #: Of a frame that nest() made: the list's name, its records as rows, how such rows are nested again, and the
        #: first of them that have a parent.
        self.nested = None

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> NestedFrame:
        """A frame of a stored Parquet table, of which only the fields that are kept are read."""
        return cls(spark.read.parquet(path), scan=lambda schema: spark.read.schema(schema).parquet(path))

    # -- helpers ---------------------------------------------------------------------------------------------

    def _new(self, df: DataFrame, names=None) -> NestedFrame:
        return NestedFrame(df, self.names if names is None else names)

    def _one(self, at: str) -> tuple[str, ...]:
        return resolve(self.df.schema, at, one=True)[0]

    def _rewrite(self, path, function) -> NestedFrame:
        top = path[0]
        return self._new(self.df.withColumn(top, rewritten(F.col(f"`{top}`"), self.df.schema[top].dataType, path[1:], function)))

    def _parent_fields(self, path, change) -> NestedFrame:
        """change(fields of the record that holds the end of path) -> fields, as (name, column) lists."""
        if len(path) == 1:
            fields = change([(n, F.col(f"`{n}`")) for n in self.df.columns])
            return self._new(self.df.select(*[c.alias(n) for n, c in fields]))

        def of(col, dtype):
            return through_lists(col, dtype, lambda x, t: rebuilt(x, change([(n, x[n]) for n in t.names])))

        return self._rewrite(path[:-1], of)

    def _function(self, fcn, args, dtype):
        t = inner(dtype)
        return compiled(fcn, args, t.names if isinstance(t, T.StructType) else None)

    def _stays(self, fcn) -> None:
        if not callable(fcn):
            raise Untranslatable(str(fcn))
        _log.warning("%s has no column form and stays Python", getattr(fcn, "__name__", fcn))

    def _udf(self, fcn, args, kind: str):
        """The last resort: a Python function of the row, as a function of the row's struct."""
        self._stays(fcn)
        args, dtype, made = args if isinstance(args, (tuple, list)) else (args,), self.df.schema, T._parse_datatype_string(kind)

        def run(array):
            return batches.arrayed([fcn(x, *args) for x in batches.each(array, dtype)], made)

        return batches.udf(run, made)

    def _python(self, fcn, path, change, kind) -> NestedFrame:
        """The last resort at a path: change(array there, its type) in Python, `kind` being the top column's type after it.

        To Spark it is not deterministic: else filters of what it makes, which unnesting adds by itself, run the
        function once more for each item.
        """
        self._stays(fcn)
        top, dtype = path[0], self.df.schema[path[0]].dataType
        run = batches.udf(lambda array: batches.at_path(array, dtype, path[1:], change), kind).asNondeterministic()
        return self._new(self.df.withColumn(top, run(F.col(f"`{top}`"))))

    # -- recastings ------------------------------------------------------------------------------------------

    def fieldname(self, newname: str, at: str) -> NestedFrame:
        """Renames the field; it moves to the end and replaces one of that name."""
        path = self._one(at)
        if not path:
            raise TypeError("only a record's field has a name")
        old = path[-1]
        return self._parent_fields(path, lambda fields: [x for x in fields if x[0] not in (old, newname)] + [(newname, dict(fields)[old])])

    def recordname(self, newname: str, at: str = "") -> NestedFrame:
        """Names the record type at the path, through lists; kept in the frame and in columns' metadata."""
        path = self._one(at)
        if not isinstance(inner(type_at(self.df.schema, path)), T.StructType):
            raise TypeError("not a record")
        df = self.df
        if path:
            df = df.withMetadata(path[0], {**df.schema[path[0]].metadata, "record:" + "/".join(path): newname})
        return self._new(df, self.names | {path: newname})

    def _pruned(self, keep, unwrap=False) -> DataFrame:
        out = []
        for f in self.df.schema.fields:
            said = keep((f.name,))
            c, t = (F.col(f"`{f.name}`"), f.dataType) if said else (None, None)
            if said is None and isinstance(inner(f.dataType), T.StructType):
                c, t = pruned(F.col(f"`{f.name}`"), f.dataType, keep, (f.name,), unwrap)
            if t is not None:
                out.append(c.alias(f.name))
        if not out:
            raise TypeError("nothing is left")
        return self.df.select(*out)

    def _chosen(self, patterns):
        found = set(resolve(self.df.schema, *patterns))
        return lambda path: True if path in found else (None if any(p[: len(path)] == path for p in found) else False)

    def _narrowed(self, keep, unwrap=False) -> NestedFrame:
        if self.scan is not None and (schema := narrowed_type(self.df.schema, keep)) is not None:
            out = NestedFrame(self.scan(schema), self.names, self.scan)
            return out._new(out._pruned(keep, unwrap)) if unwrap else out
        return self._new(self._pruned(keep, unwrap))

    def keep(self, *paths: str) -> NestedFrame:
        return self if () in resolve(self.df.schema, *paths) else self._narrowed(self._chosen(paths))

    def drop(self, *paths: str) -> NestedFrame:
        found = set(resolve(self.df.schema, *paths))
        if () in found:
            raise TypeError("nothing is left")
        keep = lambda path: False if path in found else (None if any(p[: len(path)] == path for p in found) else True)
        return self._narrowed(keep) if found else self

    def project(self, at: str) -> NestedFrame:
        """Keeps what matches and unwraps records of a single field; a single column takes the last step's name."""
        found = resolve(self.df.schema, at)
        if not found:
            raise TypeError(f"no node at {at!r}")
        out = self._narrowed(self._chosen([at]), unwrap=True)
        return self._new(out.df.toDF(found[0][-1]) if len(out.df.columns) == 1 else out.df)

    def split(self, *paths: str):
        """Moves fields out of a list of records into lists beside it.  Fields of the rows themselves become frames
        of their own: then the result is a dict of frames, the rest as `original`."""
        found = resolve(self.df.schema, *paths)
        if not found:
            raise TypeError(f"no node at {paths!r}")
        tops = [p[0] for p in found if len(p) == 1]
        if tops:
            rest = self.df.drop(*tops)
            return ({"original": self._new(rest)} if rest.columns else {}) | {t: self._new(self.df.select(t)) for t in tops}
        out = self
        for path in found:
            holder, field = path[:-1], path[-1]
            if not isinstance(type_at(out.df.schema, holder), T.ArrayType):
                raise TypeError("split is of fields of listed records")

            def change(fields, holder=holder, field=field, left=len(inner(type_at(out.df.schema, holder)).names)):
                at = dict(fields)[holder[-1]]
                beside = [(field, at[field])]
                if left == 1:
                    return [x for x in fields if x[0] != holder[-1]] + beside
                return [(n, F.transform(c, lambda x: x.dropFields(field)) if n == holder[-1] else c) for n, c in fields] + beside

            out = out._parent_fields(holder, change)
        return out

    def merge(self, container: str, *paths: str) -> NestedFrame:
        """Zips lists of one record into the list of records `container`; unequal lengths raise an error."""
        found = resolve(self.df.schema, *paths)
        levels = {p[:-1] for p in found}
        holder = tuple(container.split("/"))
        if len(levels) != 1 or levels != {holder[:-1]}:
            raise ValueError("merge is of lists at one level")
        if any(not isinstance(type_at(self.df.schema, p), T.ArrayType) for p in found):
            raise ValueError("merge is of lists")
        names = [p[-1] for p in found]
        there = holder in resolve(self.df.schema, container)
        inside = inner(type_at(self.df.schema, holder)).names if there else []

        def change(fields):
            by = dict(fields)
            lists = [by[holder[-1]][n].alias(n) for n in inside] + [by[n].alias(n) for n in names]
            sizes = [F.size(x) for x in lists]
            same = functools.reduce(lambda a, b: a & b, [sizes[0].eqNullSafe(s) for s in sizes[1:]], F.lit(True))
            zipped = F.when(same, F.arrays_zip(*lists)).otherwise(F.raise_error(F.lit("merged lists differ in length")))
            return [x for x in fields if x[0] not in (*names, holder[-1])] + [(holder[-1], zipped)]

        return self._parent_fields(holder, change)

    # -- transformations -------------------------------------------------------------------------------------

    def parent(self, fieldname: str, at: str) -> NestedFrame:
        """Gives each item of the list at the path a record of its parent's other fields."""
        path = self._one(at)
        if not path or not isinstance(type_at(self.df.schema, path), T.ArrayType):
            raise TypeError("not a list inside a record")

        def change(fields):
            up = F.struct(*[c.alias(n) for n, c in fields if n != path[-1]])
            return [(n, F.transform(c, lambda x: x.withField(fieldname, up)) if n == path[-1] else c) for n, c in fields]

        return self._parent_fields(path, change)

    def index(self, fieldname: str, at: str = "") -> NestedFrame:
        """Gives each item its position in its list; at the top, each row its place: of rows of files by file and
        place there, of others in the order of Spark's partitions, which need then be the same each time."""
        path = self._one(at)
        if path:
            return self._rewrite(path, lambda col, dtype: F.transform(col, lambda x, i: x.withField(fieldname, i)))
        names = [c for c in self.df.columns if c != fieldname]
        try:
            df, order = self.df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")), ["_file", "_row"]
        except AnalysisException:  # not rows of files
            df, order = self.df.withColumn("_row", F.monotonically_increasing_id()), ["_row"]
        return self._new(placed(df, order, "_place").select(*names, F.col("_place").alias(fieldname)))

    def tomask(self, at: str, low, high=None) -> NestedFrame:
        """Makes values null that equal low (NaN too), or that lie in [low, high] (NaN never does)."""
        path = self._one(at)
        nan = lambda x: isinstance(x, float) and math.isnan(x)
        if high is not None and (nan(low) or nan(high)):
            raise ValueError("a range cannot end in NaN")
        if isinstance(inner(type_at(self.df.schema, path)), T.StructType):
            raise NotImplementedError("only primitives are masked")

        def of(x, _):
            if high is not None:
                return F.when(~x.between(low, high), x)
            return F.when(~F.isnan(x), x) if nan(low) else F.when(~x.eqNullSafe(F.lit(low)), x)

        return self._rewrite(path, lambda col, dtype: through_lists(col, dtype, of))

    def flatten(self, at: str = "") -> NestedFrame:
        """Joins the lists in a list, one level; at the top, the rows' only list becomes the rows."""
        path = self._one(at)
        if not path:
            (name,) = self.df.columns
            return self._new(self.df.select(F.explode(name).alias(name)))
        return self._rewrite(path, lambda col, dtype: F.flatten(F.filter(col, lambda x: x.isNotNull()) if dtype.containsNull else col))

    def filter(self, fcn, args=(), at: str = "") -> NestedFrame:
        """Keeps items for which fcn is true; parents of emptied lists stay."""
        path = self._one(at)
        if not path:
            _, item, dtype = self._items("")
            test = self._function(fcn, args, dtype)
            try:
                return self._new(self.df.where(test(item)))
            except Untranslatable:
                return self._new(self.df.where(self._udf(fcn, args, "boolean")(F.struct("*"))))
        if not isinstance(type_at(self.df.schema, path), T.ArrayType):
            raise TypeError("filter is of lists")
        test = self._function(fcn, args, type_at(self.df.schema, path))
        if self.nested is not None and path == (self.nested[0],):  # the rows are filtered before they are shuffled
            _, rows, again, _ = self.nested
            try:
                out = again(rows.where(column(test(_Row(rows)))))
                out.names = dict(self.names)
                return out
            except Untranslatable:
                pass
        try:
            return self._rewrite(path, lambda col, dtype: F.filter(col, lambda x: column(test(typed(x, dtype.elementType)))))
        except Untranslatable:
            more = args if isinstance(args, (tuple, list)) else (args,)
            return self._python(fcn, path, lambda array, dtype: batches.kept(array, dtype, lambda x: fcn(x, *more)), self.df.schema[path[0]].dataType)

    def define(self, fieldname: str, fcn, args=(), at: str = "", fieldtype: str = "double") -> NestedFrame:
        """Adds or replaces a field by a function of its record; fieldtype is only for functions that stay Python."""
        path = self._one(at)
        value = self._function(fcn, args, type_at(self.df.schema, path))
        if not path:
            try:
                return self._new(self.df.withColumn(fieldname, column(value(_Row(self.df)))))
            except Untranslatable:
                return self._new(self.df.withColumn(fieldname, self._udf(fcn, args, fieldtype).asNondeterministic()(F.struct("*"))))
        if not isinstance(inner(type_at(self.df.schema, path)), T.StructType):
            raise TypeError("only a record has fields")
        try:
            return self._rewrite(path, lambda col, dtype: through_lists(col, dtype, lambda x, t: x.withField(fieldname, column(value(typed(x, t))))))
        except Untranslatable:
            more = args if isinstance(args, (tuple, list)) else (args,)
            made = T._parse_datatype_string(fieldtype)

            def change(array, dtype):
                return batches.defined(array, dtype, fieldname, lambda x: fcn(x, *more), made)

            def grown(dtype, path):
                if isinstance(dtype, T.ArrayType):
                    return T.ArrayType(grown(dtype.elementType, path), dtype.containsNull)
                if path:
                    return T.StructType([T.StructField(f.name, grown(f.dataType, path[1:]) if f.name == path[0] else f.dataType, f.nullable) for f in dtype.fields])
                there = [T.StructField(f.name, made if f.name == fieldname else f.dataType) for f in dtype.fields]
                return T.StructType(there + ([] if fieldname in dtype.names else [T.StructField(fieldname, made)]))

            return self._python(fcn, path, change, grown(self.df.schema[path[0]].dataType, path[1:]))

    # -- actions ---------------------------------------------------------------------------------------------

    def _items(self, at: str) -> tuple[DataFrame, Column | _Row, T.DataType]:
        """One row an item of the list at the path, across all parents."""
        path = self._one(at)
        if not path and len(self.df.columns) > 1:
            return self.df, _Row(self.df), self.df.schema
        if not path:  # items that are not records; the column's name stands for them, too
            (name,) = self.df.columns
            item = typed(F.col(f"`{name}`"), self.df.schema[0].dataType)
            item.__dict__["_arbor_name"] = name
            return self.df, item, self.df.schema[0].dataType
        df, col, dtype = self.df, None, self.df.schema
        for step in path:
            col = F.col(f"`{step}`") if col is None else col[step]
            dtype = dtype[step].dataType
            while isinstance(dtype, T.ArrayType):
                df = df.select(F.explode(col).alias("_item"))
                col, dtype = F.col("_item"), dtype.elementType
        return df, col, dtype

    def map(self, fcn, args=(), at: str = "", names: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
        """A flat table of fcn's results; where it is None there is no row.

        types are only for functions that stay Python; without them, the first items tell.
        """
        df, item, dtype = self._items(at)
        try:
            value = self._function(fcn, args, dtype)(typed(item, dtype))
        except Untranslatable:
            return self._map_python(fcn, args, df, item, names, types, self._one(at))
        if isinstance(value, Maybe):
            df = df.where(value.condition)
        if isinstance(value, tuple):
            fields = names or getattr(value, "_fields", None) or [f"f{i}" for i in range(len(value))]
            return df.select(*[column(v).alias(n) for n, v in zip(fields, value)])
        name = (names or ["f0"])[0]
        return df.select(column(value).alias(name)).where(F.col(name).isNotNull())

    def _map_python(self, fcn, args, df, item, names, types, path) -> DataFrame:
        args = args if isinstance(args, (tuple, list)) else (args,)
        if not callable(fcn):
            raise Untranslatable(str(fcn))
        whole = item if isinstance(item, Column) else F.struct(*[F.col(f"`{n}`") for n in df.columns])
        items = df.select(whole.alias("_item"))
        tried = []
        if not (types and names):
            firsts = self.nested[3](TRIED) if self.nested is not None and path == (self.nested[0],) else []
            for some in (firsts, None):  # what nest() listed is tried before it is listed, all that only if that gives nothing
                some = [r[0] for r in items.limit(TRIED).collect()] if some is None else some
                if tried := [y for x in some if (y := fcn(x, *args)) is not None]:
                    break
        if not tried and not types:
            raise TypeError("the first items give no result that tells its type")
        flat = not (isinstance(tried[0], tuple) if tried else len(names) > 1)
        rows = [(y,) if flat else tuple(y) for y in tried]
        fields = names or getattr(tried[0] if tried else None, "_fields", None) or [f"f{i}" for i in range(len(rows[0]))]
        kinds = [T._parse_datatype_string(t) for t in types] if types else [_kind([r[i] for r in rows]) for i in range(len(fields))]
        kind = T.StructType([T.StructField(n, t) for n, t in zip(fields, kinds)])

        self._stays(fcn)
        dtype = items.schema[0].dataType

        def run(parts):
            import pyarrow as pa

            for part in parts:
                made = [(y,) if flat else tuple(y) for x in batches.each(part.column(0), dtype) if (y := fcn(x, *args)) is not None]
                columns = zip(*made, strict=True) if made else [()] * len(kind)
                yield pa.RecordBatch.from_arrays([batches.arrayed(list(c), f.dataType) for c, f in zip(columns, kind, strict=True)], names=kind.names)

        return items.mapInArrow(run, kind)

    def reduces(self, folds: dict, at: str = "") -> dict:
        """The folds name -> (tally, fcn) by +, min or max over the same items, as one aggregation."""
        df, item, dtype = self._items(at)
        made = {n: self._function(fcn, (), dtype)(typed(item, dtype), Tally()) for n, (_, fcn) in folds.items()}
        if any(not isinstance(m, Tally) or m.kind is None for m in made.values()):
            raise Untranslatable("these folds need a combiner")
        got = df.agg(*[getattr(F, m.kind)(column(m.value)).alias(n) for n, m in made.items()]).first()
        out = {}
        for n, (tally, _) in folds.items():
            joined = {"sum": lambda a, b: a + b, "min": min, "max": max}[made[n].kind]
            out[n] = tally if got[n] is None else joined(tally, got[n])
        return out

    def reduce(self, tally, fcn, args=(), at: str = "", combiner=None, zero=None):
        """The fold of fcn(item, tally) over all items.

        Folds by +, min or max run as one aggregation, the first tally counted once.  Any other fold needs
        `combiner`, a function of two partial tallies, which are combined in order of the partitions.  All but the
        first fold from `zero`, which must change no tally that it is combined with; if it is not given, 0, 1, an
        empty tally of the same kind or the tally itself are tried, and without one a ValueError is raised, so that the result
        never depends on the number of partitions.
        """
        df, item, dtype = self._items(at)
        if combiner is None:
            made = self._function(fcn, args, dtype)(typed(item, dtype), Tally())
            if not isinstance(made, Tally) or made.kind is None:
                raise Untranslatable("this fold needs a combiner")
            got = df.agg(getattr(F, made.kind)(column(made.value)).alias("t")).first()[0]
            if got is None:
                return tally
            return tally + got if made.kind == "sum" else {"min": min, "max": max}[made.kind](tally, got)
        more = args if isinstance(args, (tuple, list)) else (args,)
        zero = _neutral(tally, combiner) if zero is None else zero
        rows = df.select((item if isinstance(item, Column) else F.struct(*[F.col(f"`{n}`") for n in df.columns])).alias("_item"))
        start = cloudpickle.dumps(zero)

        def fold(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            out, some = pickle.loads(start), False
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    out, some = fcn(_rowed(x), out, *more), True
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([cloudpickle.dumps(out)], pa.binary())], names=["part", "tally"])

        def join(batches):
            import pyarrow as pa

            held = {}
            for batch in batches:
                for part, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                    x, group = pickle.loads(x.as_py()), part // COMBINED
                    held[group] = combiner(held[group], x) if group in held else x
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([cloudpickle.dumps(x) for x in held.values()], pa.binary())], names=["part", "tally"])

        # neighbours are combined on executors, so that few partials reach the driver
        parts = rows.mapInArrow(fold, "part int, tally binary").repartition(F.floor(F.col("part") / COMBINED)).sortWithinPartitions("part").mapInArrow(join, "part int, tally binary")
        out = tally
        for r in sorted(parts.collect()):
            out = combiner(out, pickle.loads(bytes(r[1])))
        return out


def _neutral(tally, combiner):
    def same(a, b):
        try:
            return bool(a == b)
        except (ValueError, TypeError):  # arrays
            return bool((a == b).all())

    copy = lambda x: pickle.loads(cloudpickle.dumps(x))  # noqa: E731  a combiner may change what it is given
    for make in (lambda: type(tally)(), lambda: type(tally)(1), lambda: copy(tally)):
        try:
            zero = make()
            if all(same(combiner(copy(a), copy(b)), want) for a, b, want in ((zero, tally, tally), (tally, zero, tally), (zero, zero, zero))):
                return zero
        except Exception:  # the kind has no such value, or the combiner does not take it
            continue
    raise ValueError("give a zero that changes no tally when combined with it")


def _rowed(x):
    """Arrow's dicts as rows, whose fields are attributes and keys."""
    if isinstance(x, dict):
        return Row(**{n: _rowed(v) for n, v in x.items()})
    return [_rowed(v) for v in x] if isinstance(x, list) else x


def _kind(values: list) -> T.DataType:
    """The Spark type of Python results."""
    from arborframe.schema import infer

    some = [v.item() if hasattr(v, "item") and not isinstance(v, (list, tuple)) else v for v in values if v is not None]
    if not some:
        raise TypeError("the first items give no result that tells its type")
    if all(isinstance(v, int) and not isinstance(v, bool) for v in some):
        return T.LongType()
    return infer(some).parts[0].spark()


class _Row:
    """The top-level record: attributes and keys are columns."""

    def __init__(self, df: DataFrame):
        self._names, self._schema = df.columns, df.schema

    def __getitem__(self, name: str) -> Column:
        if name not in self._names:
            raise Untranslatable(name)
        return typed(F.col(f"`{name}`"), self._schema[name].dataType)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

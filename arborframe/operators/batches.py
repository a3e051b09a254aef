"""Python functions on the items of Arrow columns.

The function gets an item as pyspark's own Arrow functions would give it, but only what it is given becomes Python's:
the lists and records around the items, and what a filter keeps, stay Arrow's.
"""

from __future__ import annotations

from functools import partial
from operator import itemgetter

from pyspark.sql import Row, functions as F, types as T
from pyspark.sql.conversion import ArrowTableToRowsConversion, LocalDataToArrowConversion
from pyspark.sql.pandas.types import to_arrow_type

#: Items that are Python's at a time.
AT_ONCE = 8192


def record(names: list[str]):
    """A maker of Rows of these names from tuples, whose fields are found without a search."""
    found = {n: property(itemgetter(i)) for i, n in reversed(list(enumerate(names))) if not n.startswith("__") and not hasattr(Row, n)}
    return partial(tuple.__new__, type("Row", (Row,), found | {"__fields__": list(names)}))


def values(array, dtype: T.DataType) -> list:
    """An array's Python values."""
    import pyarrow as pa

    if isinstance(dtype, T.StructType):
        columns = [values(array.field(i), f.dataType) for i, f in enumerate(dtype.fields)]
        out = list(map(record(dtype.names), zip(*columns) if columns else [()] * len(array)))
        return [x if there else None for x, there in zip(out, array.is_valid().to_pylist())] if array.null_count else out
    if isinstance(dtype, T.ArrayType):
        items, out, at = values(array.flatten(), dtype.elementType), [], 0
        for n in array.value_lengths().to_pylist():
            out.append(None if n is None else items[at : at + n])
            at += n or 0
        return out
    if not array.null_count and (pa.types.is_integer(array.type) or pa.types.is_floating(array.type)):
        return array.to_numpy(zero_copy_only=False).tolist()
    convert = ArrowTableToRowsConversion._create_converter(dtype, none_on_identity=True)
    return array.to_pylist() if convert is None else [convert(x) for x in array.to_pylist()]


def each(array, dtype: T.DataType):
    """An array's Python values, a part at a time."""
    for at in range(0, len(array), AT_ONCE):
        yield from values(array.slice(at, AT_ONCE), dtype)


def udf(function, kind: T.DataType):
    """Spark's function for one of a single array, the parameter `array`."""
    import pyarrow as pa

    function.__annotations__ = {"array": pa.Array, "return": pa.Array}
    return F.arrow_udf(function, kind)


def arrayed(results: list, dtype: T.DataType):
    """The array of a function's results."""
    import pyarrow as pa

    convert, kind = LocalDataToArrowConversion._create_converter(dtype, none_on_identity=True), to_arrow_type(dtype)
    results = results if convert is None else [convert(x) for x in results]
    try:
        return pa.array(results, type=kind)
    except pa.lib.ArrowInvalid:
        return pa.array(results).cast(target_type=kind, safe=True)


def _lists(lengths, missing, items, like):
    """Lists of these lengths over the items; missing: which of them are null, if any is."""
    import numpy as np
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), items, type=pa.list_(like.value_field.with_type(items.type)), mask=missing)


def _lengths(array):
    """How many items each list has, 0 if it is null, and which are null, or None if none is."""
    return array.value_lengths().fill_null(0).to_numpy(), array.is_null() if array.null_count else None


def at_path(array, dtype: T.DataType, path, change):
    """The array with what stands at path replaced by change(array, type); lists on the way are passed through."""
    import pyarrow as pa

    if not path:
        return change(array, dtype)
    if isinstance(dtype, T.ArrayType):
        return _lists(*_lengths(array), at_path(array.flatten(), dtype.elementType, path, change), array.type)
    i = dtype.names.index(path[0])
    inside = at_path(array.field(i), dtype.fields[i].dataType, path[1:], change)
    return _records(array, [inside if j == i else array.field(j) for j in range(len(dtype))], [f.with_type(inside.type) if j == i else f for j, f in enumerate(array.type)])


def _records(array, columns, fields):
    import pyarrow as pa

    return pa.StructArray.from_arrays(columns, fields=fields, mask=array.is_null() if array.null_count else None)


def kept(array, dtype: T.ArrayType, test):
    """The lists with the items for which test is true."""
    import numpy as np
    import pyarrow as pa

    items, (lengths, missing) = array.flatten(), _lengths(array)
    mask = np.fromiter((bool(test(x)) for x in each(items, dtype.elementType)), bool, len(items))
    before = np.concatenate([[0], np.cumsum(mask)])
    ends = np.cumsum(lengths)
    return _lists(before[ends] - before[ends - lengths], missing, items.filter(pa.array(mask)), array.type)


def defined(array, dtype: T.DataType, name: str, function, made: T.DataType):
    """The records, in any lists, with a field of the function's results; they need not be there."""
    import pyarrow as pa

    if isinstance(dtype, T.ArrayType):
        return _lists(*_lengths(array), defined(array.flatten(), dtype.elementType, name, function, made), array.type)
    new = arrayed([None if x is None else function(x) for x in each(array, dtype)], made)
    columns, fields, field = [array.field(i) for i in range(len(dtype))], list(array.type), pa.field(name, new.type)
    if name in dtype.names:
        return _records(array, [new if n == name else c for n, c in zip(dtype.names, columns)], [field if n == name else f for n, f in zip(dtype.names, fields)])
    return _records(array, [*columns, new], [*fields, field])

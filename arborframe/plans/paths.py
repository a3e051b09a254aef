"""A path is record fields joined by '/', as a case-sensitive glob; lists add no step and `*` crosses '/'."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import Column, functions as F, types as T


def inner(dtype):
    """The type inside any lists."""
    while isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    return dtype


def resolve(schema: T.DataType, *patterns: str, one: bool = False) -> list[tuple[str, ...]]:
    """Concrete paths that match; a match hides what is below it."""
    out: list[tuple[str, ...]] = []

    def walk(dtype, path):
        if any(fnmatchcase("/".join(path), p) for p in patterns):
            out.append(path)
        elif isinstance(dtype := inner(dtype), T.StructType):
            for f in dtype.fields:
                walk(f.dataType, (*path, f.name))

    walk(schema, ())
    if one and len(out) != 1:
        raise ValueError(f"path {patterns[0]!r} matches {len(out)} nodes")
    return out


def type_at(schema: T.DataType, path) -> T.DataType:
    for name in path:
        schema = inner(schema)[name].dataType
    return schema


def rebuilt(col: Column, fields: list[tuple[str, Column]], nullable: bool = True) -> Column:
    out = F.struct(*[c.alias(n) for n, c in fields])
    return F.when(col.isNotNull(), out) if nullable else out


def rewritten(col: Column, dtype: T.DataType, path, function) -> Column:
    """col with what stands at path replaced by function(column, type); lists on the way are mapped over."""
    if not path:
        return function(col, dtype)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: rewritten(x, dtype.elementType, path, function))
    return col.withField(path[0], rewritten(col[path[0]], dtype[path[0]].dataType, path[1:], function))


def through_lists(col: Column, dtype: T.DataType, function) -> Column:
    """function on the innermost items of lists."""
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: through_lists(x, dtype.elementType, function))
    return function(col, dtype)


def narrowed(col: Column, dtype: T.DataType, fields: list[str]) -> tuple[Column, T.DataType]:
    """A list of records with only `fields`, in a form from which the scan prunes the others.

    A lambda reads every leaf of its argument; zipping single fields does not.  Only where no item is null:
    zipping would make records of null items.
    """
    record = dtype.elementType if isinstance(dtype, T.ArrayType) else None
    if not isinstance(record, T.StructType) or dtype.containsNull or not fields or set(fields) == set(record.names):
        return col, dtype
    kept = [f for f in record.fields if f.name in fields]
    new = T.ArrayType(T.StructType(kept), False)
    return F.arrays_zip(*[col[f.name].alias(f.name) for f in kept]), new


def narrowed_type(dtype: T.DataType, keep, path=()):
    """The type with only the leaves for which keep(path) is True or None to look below; None if nothing is left."""
    if isinstance(dtype, T.ArrayType):
        inside = narrowed_type(dtype.elementType, keep, path)
        return None if inside is None else T.ArrayType(inside, dtype.containsNull)
    if not isinstance(dtype, T.StructType):
        return None
    fields = []
    for f in dtype.fields:
        said = keep((*path, f.name))
        t = f.dataType if said else narrowed_type(f.dataType, keep, (*path, f.name)) if said is None else None
        if t is not None:
            fields.append(T.StructField(f.name, t, f.nullable, f.metadata))
    return T.StructType(fields) if fields else None


def pruned(col: Column, dtype: T.DataType, keep, path=(), unwrap: bool = False):
    """(column, type) with only the leaves for which keep(path) is True or None to look below; (None, None) if
    nothing is left."""
    if isinstance(dtype, T.ArrayType):
        probe = pruned(col, dtype.elementType, keep, path, unwrap)
        if probe[1] is None:
            return None, None
        if probe[1] == dtype.elementType:
            return col, dtype
        record = dtype.elementType
        if isinstance(record, T.StructType):
            left = [f.name for f in record.fields if keep((*path, f.name)) is True]
            whole = all(keep((*path, f.name)) is not None or isinstance(inner(f.dataType), T.StructType) is False for f in record.fields)
            if unwrap and whole and len(left) == 1:
                return col[left[0]], T.ArrayType(record[left[0]].dataType, True)
            if whole and left and not dtype.containsNull:
                return narrowed(col, dtype, left)
        return F.transform(col, lambda x: pruned(x, dtype.elementType, keep, path, unwrap)[0]), T.ArrayType(probe[1], dtype.containsNull)
    if not isinstance(dtype, T.StructType):
        return (col, dtype) if keep(path) else (None, None)
    parts = []
    for f in dtype.fields:
        at = (*path, f.name)
        said = keep(at)
        if said:
            parts.append((f, col[f.name], f.dataType))
        elif said is None and isinstance(inner(f.dataType), T.StructType):
            c, t = pruned(col[f.name], f.dataType, keep, at, unwrap)
            if t is not None:
                parts.append((f, c, t))
    if not parts:
        return None, None
    if unwrap and len(parts) == 1:
        return parts[0][1], parts[0][2]
    new = T.StructType([T.StructField(f.name, t, f.nullable, f.metadata) for f, _, t in parts])
    return rebuilt(col, [(f.name, c) for f, c, _ in parts]), new

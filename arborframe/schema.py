"""Types of nested data: primitives, lists, unions, records, tuples and pointers, and inference from Python data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import types as T

#: NumPy type codes and the Spark types that hold them (unsigned ones widened).
PRIMITIVES = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(),
    "complex64": T.StructType([T.StructField("real", T.DoubleType()), T.StructField("imag", T.DoubleType())]),
    "complex128": T.StructType([T.StructField("real", T.DoubleType()), T.StructField("imag", T.DoubleType())]),
    "bytes": T.BinaryType(), "str": T.StringType(),
}
_ORDER = {n: i for i, n in enumerate(("bool", "uint8", "uint16", "uint32", "uint64", "int8", "int16", "int32", "int64", "float64", "complex128"))}


@dataclass
class Schema:
    """kind: primitive, list, union, record, tuple or pointer; parts hold what is inside."""

    kind: str
    dtype: str = ""
    parts: list = field(default_factory=list)
    fields: list = field(default_factory=list)
    nullable: bool = False
    name: str | None = None
    bounds: tuple | None = field(default=None, compare=False)

    def __eq__(self, other):
        if not isinstance(other, Schema) or (self.kind, self.dtype, self.nullable, self.name) != (other.kind, other.dtype, other.nullable, other.name):
            return False
        if self.kind == "record":  # fields have no order
            return dict(zip(self.fields, self.parts)) == dict(zip(other.fields, other.parts))
        return self.parts == other.parts

    def tojson(self) -> dict:
        out = {"type": self.kind} | ({"dtype": self.dtype} if self.dtype else {}) | ({"nullable": True} if self.nullable else {}) | ({"name": self.name} if self.name else {})
        if self.kind == "record":
            out["fields"] = [[n, p.tojson()] for n, p in zip(self.fields, self.parts)]
        elif self.parts:
            out["parts"] = [p.tojson() for p in self.parts]
        return out

    def tojsonstring(self) -> str:
        return json.dumps(self.tojson())

    @staticmethod
    def fromjson(x: dict | str) -> Schema:
        x = json.loads(x) if isinstance(x, str) else x
        parts = [Schema.fromjson(p) for p in x.get("parts", [])] or [Schema.fromjson(p) for _, p in x.get("fields", [])]
        return Schema(x["type"], x.get("dtype", ""), parts, [n for n, _ in x.get("fields", [])], x.get("nullable", False), x.get("name"))

    def spark(self) -> T.DataType:
        if self.kind == "primitive":
            return PRIMITIVES[self.dtype]
        if self.kind == "list":
            return T.ArrayType(self.parts[0].spark(), self.parts[0].nullable)
        if self.kind == "pointer":
            return T.LongType()
        if self.kind == "union":
            return T.StructType([T.StructField("tag", T.ByteType(), False), *[T.StructField(f"u{i}", p.spark()) for i, p in enumerate(self.parts)]])
        names = self.fields if self.kind == "record" else [f"_{i}" for i in range(len(self.parts))]
        return T.StructType([T.StructField(n, p.spark(), p.nullable) for n, p in zip(names, self.parts)])

    def paths(self, *patterns: str, at: tuple = ()):
        """(path, node) for the nodes that match; lists, unions and pointers add no step."""
        if any(fnmatchcase("/".join(at), p) for p in patterns):
            yield at, self
        elif self.kind in ("record", "tuple"):
            for n, p in zip(self.fields or map(str, range(len(self.parts))), self.parts):
                yield from p.paths(*patterns, at=(*at, n))
        else:
            for p in self.parts:
                yield from p.paths(*patterns, at=at)

    def path(self, pattern: str) -> Schema:
        found = list(self.paths(pattern))
        if len(found) != 1:
            raise ValueError(f"path {pattern!r} matches {len(found)} nodes")
        return found[0][1]

    def replace(self, function) -> Schema:
        """function on every node, inner ones first."""
        return function(Schema(self.kind, self.dtype, [p.replace(function) for p in self.parts], list(self.fields), self.nullable, self.name, self.bounds))

    def __contains__(self, x) -> bool:
        if x is None:
            return self.nullable
        if self.kind == "primitive":
            if self.dtype in ("str", "bytes"):
                return isinstance(x, str if self.dtype == "str" else bytes)
            if isinstance(x, bool) or self.dtype == "bool":
                return isinstance(x, bool) and self.dtype == "bool"
            if isinstance(x, int) and ("int" in self.dtype):
                bits, low = int(self.dtype.lstrip("uint")), 0 if self.dtype[0] == "u" else 1
                return -(low << (bits - 1)) <= x < (1 << (bits - low))
            return isinstance(x, (int, float)) and "float" in self.dtype or isinstance(x, (int, float, complex)) and "complex" in self.dtype
        if self.kind == "list":
            return isinstance(x, (list, range)) and all(y in self.parts[0] for y in x)
        if self.kind == "union":
            return any(x in p for p in self.parts)
        if self.kind == "tuple":
            return isinstance(x, tuple) and len(x) == len(self.parts) and all(y in p for y, p in zip(x, self.parts))
        if self.kind == "record":
            get = x.get if isinstance(x, dict) else lambda n: getattr(x, n, None)
            return all((n in x if isinstance(x, dict) else hasattr(x, n)) and get(n) in p for n, p in zip(self.fields, self.parts))
        return False

    case = __contains__

    def cast(self, x):
        if x not in self:
            raise TypeError(f"{x!r} is not of the type")
        return x

    def fill(self, x):
        """A Python value in the form that spark() holds."""
        if x is None:
            return None
        if self.kind == "list":
            return [self.parts[0].fill(y) for y in x]
        if self.kind == "tuple":
            return tuple(p.fill(y) for p, y in zip(self.parts, x))
        if self.kind == "record":
            return tuple(p.fill(x[n] if isinstance(x, dict) else getattr(x, n)) for n, p in zip(self.fields, self.parts))
        if self.kind == "union":  # the first alternative that takes it
            tag = next(i for i, p in enumerate(self.parts) if x in p)
            return (tag, *[p.fill(x) if i == tag else None for i, p in enumerate(self.parts)])
        if self.dtype.startswith("complex"):
            return (complex(x).real, complex(x).imag)
        if "float" in self.dtype:
            return float(x)
        if self.dtype == "uint64":
            from decimal import Decimal

            return Decimal(x)
        return x


def _integer(low: int, high: int) -> str:
    for bits in (8, 16, 32, 64):
        if low >= 0 and high < 1 << bits:
            return f"uint{bits}"
        if low < 0 and -(1 << (bits - 1)) <= low and high < 1 << (bits - 1):
            return f"int{bits}"
    return "float64"


def _merged(a: Schema, b: Schema) -> Schema | None:
    """One type for both without a union, or None."""
    nullable = a.nullable or b.nullable
    if a.kind == b.kind == "primitive" and a.dtype in _ORDER and b.dtype in _ORDER and ("bool" not in (a.dtype, b.dtype) or a.dtype == b.dtype):
        if a.bounds and b.bounds:
            bounds = min(a.bounds[0], b.bounds[0]), max(a.bounds[1], b.bounds[1])
            return Schema("primitive", _integer(*bounds), nullable=nullable, bounds=bounds)
        return Schema("primitive", max(a.dtype, b.dtype, key=_ORDER.get), nullable=nullable)
    if (a.kind, a.dtype, a.name, set(a.fields), len(a.parts)) != (b.kind, b.dtype, b.name, set(b.fields), len(b.parts)) or a.kind == "union":
        return None
    if a.kind == "primitive":
        return Schema("primitive", a.dtype, nullable=nullable)
    if a.kind == "record":
        other = dict(zip(b.fields, b.parts))
        return Schema("record", parts=[unify(p, other[n]) for n, p in zip(a.fields, a.parts)], fields=a.fields, nullable=nullable, name=a.name)
    return Schema(a.kind, parts=[unify(p, q) for p, q in zip(a.parts, b.parts)], nullable=nullable)


def unify(a: Schema | None, b: Schema | None) -> Schema | None:
    """The smallest type that takes what either takes; records of different fields make a union."""
    if a is None or b is None:
        return a or b
    if (whole := _merged(a, b)) is not None:
        return whole
    parts = list(a.parts if a.kind == "union" else [a])
    for q in b.parts if b.kind == "union" else [b]:
        for i, p in enumerate(parts):
            if (u := _merged(p, q)) is not None:
                parts[i] = u
                break
        else:
            parts.append(q)
    nullable = a.nullable or b.nullable
    for p in parts:
        p.nullable = False
    return Schema("union", parts=parts, nullable=nullable)


def infer(x, _seen: tuple = ()) -> Schema:
    """The schema of Python data."""
    if isinstance(x, bool):
        return Schema("primitive", "bool")
    if isinstance(x, int):
        return Schema("primitive", _integer(x, x), bounds=(x, x))
    if isinstance(x, float):
        return Schema("primitive", "float64")
    if isinstance(x, complex):
        return Schema("primitive", "complex128")
    if isinstance(x, (str, bytes)):
        return Schema("primitive", type(x).__name__)
    if x is None:
        raise TypeError("nothing but None")
    if any(x is y for y in _seen):
        raise ValueError("the data refer to themselves")
    seen = (*_seen, x)
    if isinstance(x, dict) or hasattr(x, "_fields") or hasattr(x, "__dict__"):
        items = x if isinstance(x, dict) else x._asdict() if hasattr(x, "_fields") else x.__dict__
        names = sorted(items)
        parts = [Schema("none") if items[n] is None else infer(items[n], seen) for n in names]
        return Schema("record", parts=parts, fields=names, name=None if isinstance(x, dict) else type(x).__name__)
    if isinstance(x, tuple):
        return Schema("tuple", parts=[Schema("none") if y is None else infer(y, seen) for y in x])
    content, null = None, False
    for y in x:
        if y is None:
            null = True
        else:
            content = _unify_none(content, infer(y, seen))
    if content is None:
        raise TypeError("an empty list, or of nothing but None")
    content.nullable = content.nullable or null
    return Schema("list", parts=[content])


def _unify_none(a, b):
    """unify(), where a part that was only None so far makes the other nullable."""
    if a is None:
        return b
    if a.kind == b.kind and a.kind in ("record", "tuple") and set(a.fields) == set(b.fields) and len(a.parts) == len(b.parts):
        other = dict(zip(b.fields, b.parts)) if a.fields else dict(enumerate(b.parts))
        parts = []
        for n, p in zip(a.fields or range(len(a.parts)), a.parts):
            q = other[n]
            if "none" in (p.kind, q.kind):
                known = q if p.kind == "none" else p
                known.nullable = known.kind != "none"
                parts.append(known)
            else:
                parts.append(_unify_none(p, q))
        return Schema(a.kind, parts=parts, fields=a.fields, nullable=a.nullable or b.nullable, name=a.name)
    return unify(a, b)

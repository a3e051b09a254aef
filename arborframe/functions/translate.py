"""Translates Python functions and expression strings to Column expressions.

Three ways, in this order: the function's source is translated; if it is more than one expression, the function runs
on symbols, which give operators Python's meaning and refuse what has no Column form; a function that itself uses
pyspark's functions runs on plain columns.  What none of them can do raises Untranslatable.
"""

from __future__ import annotations

import ast
import inspect
import math
import types

from pyspark.sql import Column, functions as F, types as T


class Untranslatable(TypeError):
    """The function uses something that has no Column form."""


def typed(x, dtype):
    """The column with its type at hand, where it is known."""
    if isinstance(x, Column) and dtype is not None:
        x.__dict__["_arbor_type"] = dtype
    return x


def dtype_of(x):
    return x.__dict__.get("_arbor_type") if isinstance(x, Column) else getattr(x, "dtype", None) if isinstance(x, Symbol) else None


def column(x):
    return x if isinstance(x, Column) else F.lit(x)


def modulo(a, b):
    """Python's sign: that of the divisor."""
    a, b = column(a), column(b)
    m = a % b
    return F.when((m != 0) & ((m < 0) != (b < 0)), m + b).otherwise(m)


def floordiv(a, b):
    """Exact for integers of any size: the remainder is taken off first, and what the double lost is put back."""
    a, b = column(a), column(b)
    whole = a - modulo(a, b)
    q = F.floor(whole / b + 0.5)
    return q + F.floor((whole - q * b) / b + 0.5)


def add(a, b):
    if any(isinstance(dtype_of(x), (T.ArrayType, T.StringType)) for x in (a, b)):
        return typed(F.concat(column(a), column(b)), dtype_of(a) or dtype_of(b))
    return a + b


def multiply(a, b):
    if isinstance(dtype_of(b), T.ArrayType):
        a, b = b, a
    if isinstance(dtype_of(a), T.ArrayType):  # a list repeated; Python's list * -1 is empty
        return typed(F.flatten(F.array_repeat(a, F.greatest(column(b), F.lit(0)).cast("int"))), dtype_of(a))
    return a * b


def power(a, b):
    """Small whole powers by multiplication, so that integers stay exact."""
    if isinstance(b, int) and not isinstance(b, bool) and 1 <= b <= 8 and isinstance(a, Column):
        out = a
        for _ in range(b - 1):
            out = out * a
        return out
    return F.pow(column(a), column(b))


def total(a):
    """A list's sum in its own kind of number."""
    zero = F.coalesce(F.when(F.lit(False), F.get(a, F.lit(0))), F.lit(0).cast("bigint"))
    return F.aggregate(a, zero, lambda t, x: t + x)


def length(a):
    if isinstance(dtype_of(a), T.StructType):
        return F.lit(len(dtype_of(a)))
    return F.length(a) if isinstance(dtype_of(a), (T.StringType, T.BinaryType)) else F.size(a)


def required(x):
    """The value, which must be there."""
    return typed(F.coalesce(x, F.raise_error(F.lit("a required value is missing"))), dtype_of(x))


_BINARY = {
    ast.Add: add,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: multiply,
    ast.Div: lambda a, b: column(a) / column(b),
    ast.FloorDiv: floordiv,
    ast.Mod: modulo,
    ast.Pow: power,
}
_COMPARE = {
    ast.Eq: lambda a, b: column(a).eqNullSafe(column(b)),
    ast.NotEq: lambda a, b: ~column(a).eqNullSafe(column(b)),
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.In: lambda a, b: F.array_contains(b, a),
    ast.NotIn: lambda a, b: ~F.array_contains(b, a),
}
_ONE = "sqrt exp expm1 log10 log1p sin cos tan asin acos atan sinh cosh tanh asinh acosh atanh degrees radians floor ceil factorial isnan".split()
MATH = {n: getattr(F, n) for n in _ONE} | {
    "log": lambda x, base=None: F.ln(x) if base is None else F.ln(x) / F.ln(column(base)),
    "log2": F.log2,
    "pow": lambda a, b: F.pow(column(a), column(b)),
    "hypot": F.hypot,
    "atan2": F.atan2,
    "fabs": F.abs,
    "fmod": lambda a, b: column(a) % column(b),
    "trunc": lambda x: x.cast("bigint"),
    "isinf": lambda x: F.abs(x) == float("inf"),
    "copysign": lambda a, b: F.abs(a) * F.when(column(b) < 0, -1).otherwise(1),
    "pi": math.pi,
    "e": math.e,
}
BUILTIN = {
    "len": length,
    "abs": F.abs,
    "min": lambda *a: F.array_min(a[0]) if len(a) == 1 else F.least(*map(column, a)),
    "max": lambda *a: F.array_max(a[0]) if len(a) == 1 else F.greatest(*map(column, a)),
    "sum": total,
    "any": lambda a: F.exists(a, lambda x: x),
    "all": lambda a: F.forall(a, lambda x: x),
    "round": lambda x, n=0: F.bround(x, n),
    "int": lambda x: x.cast("bigint"),
    "float": lambda x: x.cast("double"),
    "bool": lambda x: x.cast("boolean"),
    "str": lambda x: x.cast("string"),
    "reversed": lambda a: typed(F.reverse(a), dtype_of(a)),
    "list": lambda a: a,
    "required": required,
}


#: What records of at least these fields can do besides: (fields, properties).
_BEHAVIORS: list[tuple[frozenset, dict]] = []


def behave(fields, **properties) -> None:
    """Gives records that have the fields further attributes, each a function of the record.  Later ones go first."""
    _BEHAVIORS.insert(0, (frozenset(fields), properties))


def field(base, name: str):
    record = dtype_of(base)
    if isinstance(base, Column) and base.__dict__.get("_arbor_name") == name and not isinstance(record, T.StructType):
        return base  # the only column of its rows
    if record is not None and not isinstance(record, (T.StructType, T.MapType, T.ArrayType)):
        raise Untranslatable(name)
    if isinstance(record, T.StructType) and name not in record.names:
        for fields, properties in _BEHAVIORS:
            if name in properties and fields <= set(record.names):
                return compiled(properties[name])(base)
        raise Untranslatable(name)
    return typed(base[name], record[name].dataType if isinstance(record, T.StructType) else None)


def index(a, i: int):
    if isinstance(dtype_of(a), T.StructType):  # a tuple
        return field(a, dtype_of(a).names[i])
    return typed(F.element_at(a, i + 1 if i >= 0 else i), element(a))


def element(a):
    return dtype_of(a).elementType if isinstance(dtype_of(a), T.ArrayType) else None


def slice_(a, start: int | None, stop: int | None, step: int | None):
    """Python's a[start:stop:step]."""
    n, step = F.size(a), step or 1

    def place(x, default):
        if x is None:
            return default
        low = F.lit(0) if step > 0 else F.lit(-1)
        high = n if step > 0 else n - 1
        return F.least(F.greatest(F.lit(x) if x >= 0 else n + x, low), high)

    first, last = (place(start, F.lit(0)), place(stop, n)) if step > 0 else (place(start, n - 1), place(stop, F.lit(-1)))
    if step == 1:
        return F.slice(a, first + 1, F.greatest(last - first, F.lit(0)))
    end = last - (1 if step > 0 else -1)
    some = (first <= end) if step > 0 else (first >= end)
    return F.when(some, F.transform(F.sequence(first, F.when(some, end).otherwise(first), F.lit(step)), lambda i: F.get(a, i))).otherwise(F.slice(a, 1, 0))


class _Translator(ast.NodeVisitor):
    def __init__(self, names: dict, functions: dict | None = None):
        self.names, self.functions = names, functions or {}

    def generic_visit(self, node):
        raise Untranslatable(type(node).__name__)

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_Constant(self, node):
        return node.value

    def visit_Name(self, node):
        if node.id in self.names:
            return self.names[node.id]
        if node.id in ("math",):
            return math
        if node.id in MATH:
            return MATH[node.id]
        raise Untranslatable(node.id)

    def visit_Attribute(self, node):
        if isinstance(node.value, ast.Name) and node.value.id == "math" and node.attr in MATH:
            return MATH[node.attr]
        base = self.visit(node.value)
        if isinstance(base, (int, float, str, tuple, Tally)) or base is math:
            raise Untranslatable(node.attr)
        return field(base, node.attr)

    def visit_Tuple(self, node):
        return tuple(self.visit(x) for x in node.elts)

    visit_List = visit_Tuple

    def visit_BinOp(self, node):
        try:
            left, right = self.visit(node.left), self.visit(node.right)
            if isinstance(right, Tally):
                left, right = right, left
                if not isinstance(node.op, ast.Add):
                    raise Untranslatable("a fold by another operation than +, min and max")
            if isinstance(left, Tally) and not isinstance(node.op, (ast.Add, ast.Sub)):
                raise Untranslatable("a fold by another operation than +, min and max")
            return _BINARY[type(node.op)](left, right)
        except KeyError:
            raise Untranslatable(type(node.op).__name__) from None

    def visit_UnaryOp(self, node):
        x = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return ~x
        return -x if isinstance(node.op, ast.USub) else x

    def visit_BoolOp(self, node):
        out, *rest = [self.visit(x) for x in node.values]
        for x in rest:
            out = out & x if isinstance(node.op, ast.And) else out | x
        return out

    def visit_Compare(self, node):
        out, left = None, self.visit(node.left)
        before = node.left
        for op, after in zip(node.ops, node.comparators):
            right = self.visit(after)
            if isinstance(op, (ast.Is, ast.IsNot)):
                if right is None:
                    now = left.isNull() if isinstance(op, ast.Is) else left.isNotNull()
                elif ast.dump(before) == ast.dump(after):  # one thing by one name
                    now = F.lit(isinstance(op, ast.Is))
                else:
                    raise Untranslatable("is")
            elif isinstance(right, tuple):
                now = column(left).isin(*right)
                now = ~now if isinstance(op, ast.NotIn) else now
            else:
                now = _COMPARE[type(op)](left, right)
            out = now if out is None else out & now
            left, before = right, after
        return out

    def visit_IfExp(self, node):
        yes, no = self.visit(node.body), self.visit(node.orelse)
        if isinstance(yes, tuple) and no is None:
            return Maybe(self.visit(node.test), yes)
        return F.when(self.visit(node.test), column(yes)).otherwise(column(no))

    def visit_Subscript(self, node):
        base = self.visit(node.value)
        if isinstance(node.slice, ast.Slice):
            return typed(slice_(base, *(None if x is None else ast.literal_eval(x) for x in (node.slice.lower, node.slice.upper, node.slice.step))), dtype_of(base))
        i = self.visit(node.slice)
        if isinstance(i, str):
            return field(base, i)
        return index(base, i) if isinstance(i, int) else typed(F.get(base, i), element(base))

    def visit_ListComp(self, node):
        """One loop over a list, with conditions."""
        if len(node.generators) != 1 or not isinstance(node.generators[0].target, ast.Name):
            raise Untranslatable("loops in loops")
        loop = node.generators[0]
        items = self.visit(loop.iter)
        inner = element(items)

        def inside(tree):
            return lambda x: column(_Translator(self.names | {loop.target.id: typed(x, inner)}, self.functions).visit(tree))

        for test in loop.ifs:
            items = F.filter(items, inside(test))
        return F.transform(items, inside(node.elt))

    visit_GeneratorExp = visit_ListComp

    def visit_Call(self, node):
        if node.keywords:
            raise Untranslatable("arguments by name")
        args = [self.visit(x) for x in node.args]
        if isinstance(node.func, ast.Name) and node.func.id in self.functions:
            return compiled(self.functions[node.func.id])(*args)
        if isinstance(node.func, ast.Name) and node.func.id in BUILTIN and node.func.id not in self.names:
            if node.func.id in ("min", "max") and any(isinstance(a, Tally) for a in args):
                return next(a for a in args if isinstance(a, Tally)).extreme(node.func.id, next(a for a in args if not isinstance(a, Tally)))
            return BUILTIN[node.func.id](*args)
        if isinstance(node.func, ast.Attribute) and node.func.attr in ("count", "index") and args:
            base = self.visit(node.func.value)
            if node.func.attr == "count":
                return F.size(F.filter(base, lambda x: x.eqNullSafe(column(args[0]))))
            return F.nullif(F.array_position(base, args[0]), F.lit(0)) - 1
        f = self.visit(node.func)
        if not callable(f) or isinstance(f, Column):
            raise Untranslatable("call")
        return f(*args)

    def visit_Lambda(self, node):
        return self.visit(node.body)


class Maybe(tuple):
    """A tuple that is there where a condition holds."""

    def __new__(cls, condition, values):
        out = super().__new__(cls, values)
        out.condition = condition
        return out


class Tally:
    """Stands for the running tally; remembers which monoid the function folds with."""

    def __init__(self, kind: str | None = None, value=None):
        self.kind, self.value = kind, value

    def _with(self, kind, other):
        if self.kind not in (None, kind):
            raise Untranslatable("mixed fold")
        other = plain(other)
        return Tally(kind, other if self.value is None else self.value + other)

    def __add__(self, other):
        return self._with("sum", other)

    __radd__ = __add__

    def __sub__(self, other):
        return self._with("sum", -plain(other))

    def extreme(self, kind, other):
        if self.kind is not None:
            raise Untranslatable("mixed fold")
        return Tally(kind, other)


class Symbol:
    """A value that a function is run on to see what it computes, with Python's meaning of the operators.  What would
    need the value itself (a condition, a loop, a conversion) is refused."""

    def __init__(self, value, dtype=None):
        self.__dict__["value"], self.__dict__["dtype"] = value, dtype or dtype_of(value)

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return _symbol(field(self.value, name))

    def __getitem__(self, i):
        if isinstance(i, slice):
            return _symbol(typed(slice_(self.value, i.start, i.stop, i.step), self.dtype))
        if isinstance(i, str):
            return _symbol(field(self.value, i))
        return _symbol(index(self.value, i) if isinstance(i, int) else F.get(self.value, plain(i)))

    def __setattr__(self, name, value):
        raise Untranslatable("assignment")

    def __neg__(self):
        return _symbol(-self.value)

    def __abs__(self):
        return _symbol(F.abs(self.value))

    __hash__ = None


def _symbol(x):
    return Symbol(x, dtype_of(x)) if isinstance(x, Column) else x


def plain(x):
    return x.value if isinstance(x, Symbol) else x


def _operator(f, swapped=False):
    def run(self, other):
        if isinstance(other, Tally):
            return NotImplemented
        a, b = self.value, plain(other)
        return _symbol(f(b, a) if swapped else f(a, b))

    return run


def _refused(self, *args):
    raise Untranslatable("it needs the value itself")


for _name, _node in (("add", ast.Add), ("sub", ast.Sub), ("mul", ast.Mult), ("truediv", ast.Div), ("floordiv", ast.FloorDiv), ("mod", ast.Mod), ("pow", ast.Pow)):
    setattr(Symbol, f"__{_name}__", _operator(_BINARY[_node]))
    setattr(Symbol, f"__r{_name}__", _operator(_BINARY[_node], True))
for _name, _node in (("eq", ast.Eq), ("ne", ast.NotEq), ("lt", ast.Lt), ("le", ast.LtE), ("gt", ast.Gt), ("ge", ast.GtE)):
    setattr(Symbol, f"__{_name}__", _operator(_COMPARE[_node]))
for _name in ("bool", "iter", "len", "contains", "int", "float", "index", "str", "round", "call"):
    setattr(Symbol, f"__{_name}__", _refused)


def parameters_of(text: str) -> list[str]:
    """Free names of an expression string, in order of first occurrence."""
    tree, out = ast.parse(text.strip(), mode="eval"), []
    bound = {n.target.id for n in ast.walk(tree) if isinstance(n, ast.comprehension) and isinstance(n.target, ast.Name)}
    for node in sorted((n for n in ast.walk(tree) if isinstance(n, ast.Name)), key=lambda n: (n.lineno, n.col_offset)):
        if node.id not in out and node.id not in bound and node.id not in BUILTIN and node.id not in MATH and node.id != "math":
            out.append(node.id)
    return out


def _within(node, code) -> bool:
    """Whether all of the code's instructions stand in the node's body."""
    body = node.body if isinstance(node.body, list) else [node.body]
    first, last = (body[0].lineno, body[0].col_offset), (body[-1].end_lineno, body[-1].end_col_offset)
    seen = [p for p in code.co_positions() if None not in p and (p[0], p[2]) != (p[1], p[3])]
    return bool(seen) and all(first <= (a, c) and (b, d) <= last for a, b, c, d in seen)


def _source(function):
    """The function's parameter names and the expression it returns: of all functions of its file the one at the
    place that its code names, so that two on one line are not confused."""
    code = function.__code__
    try:
        lines, _ = inspect.findsource(function)
        tree = ast.parse("".join(lines))
    except (OSError, TypeError, SyntaxError, IndexError) as e:
        raise Untranslatable("no source") from e
    wanted = code.co_varnames[: code.co_argcount]
    found = [n for n in ast.walk(tree) if isinstance(n, (ast.Lambda, ast.FunctionDef)) and tuple(a.arg for a in n.args.args) == wanted and _within(n, code)]
    # of functions in one another, the innermost that holds all of the code
    found = [n for n in found if not any(m is not n and any(m is x for x in ast.walk(n)) for m in found)]
    if len(found) != 1:
        raise Untranslatable("the source is not certain")
    (n,) = found
    if isinstance(n, ast.Lambda):
        return list(wanted), n.body
    body = [s for s in n.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
    if len(body) == 1 and isinstance(body[0], ast.Return) and body[0].value is not None:
        return list(wanted), body[0].value
    raise Untranslatable("more than one expression")


def _writes_columns(function, depth: int = 2) -> bool:
    """Whether the function, or one that it calls, uses pyspark itself: then its operators are meant as Spark's."""
    try:
        seen = inspect.getclosurevars(function)
    except (TypeError, ValueError):
        return False
    for x in {**seen.globals, **seen.nonlocals}.values():
        if (getattr(x, "__module__", None) or getattr(x, "__name__", None) or "").startswith("pyspark."):
            return True
        if isinstance(x, types.FunctionType) and depth and _writes_columns(x, depth - 1):
            return True
    return False


def _unwrapped(x):
    if isinstance(x, tuple) and not isinstance(x, Maybe):
        values = [plain(v) for v in x]
        return type(x)(*values) if hasattr(x, "_fields") else tuple(values)
    return plain(x)


def compiled(function, args: tuple = (), fields: list[str] | None = None):
    """A Python function of symbolic values for `function` (callable or expression string).

    In a string, names of `fields` mean the item's fields, unless it names the item itself by attribute use.
    """
    if not isinstance(args, (tuple, list)):
        args = (args,)
    if isinstance(function, str):
        tree, names = ast.parse(function.strip(), mode="eval"), parameters_of(function)
        if fields and any(n in fields for n in names):
            others = [n for n in names if n not in fields]
            return lambda item, *more: _Translator({n: field(item, n) for n in names if n in fields} | dict(zip(others, [*more, *args]))).visit(tree)
        return lambda item, *more: _Translator(dict(zip(names, [item, *more, *args]))).visit(tree)

    def call(item, *more):
        try:
            closure = inspect.getclosurevars(function)
        except (TypeError, ValueError) as e:
            raise Untranslatable("not a Python function") from e
        free = {**closure.globals, **closure.nonlocals}
        known = {k: v for k, v in free.items() if isinstance(v, (int, float, str, bool))}
        helpers = {k: v for k, v in free.items() if isinstance(v, types.FunctionType) and v is not function}
        helpers = {k: required if v is required else v for k, v in helpers.items()}
        try:
            names, body = _source(function)
            return _Translator(known | ({"required": required} if required in helpers.values() else {}) | dict(zip(names, [item, *more, *args])), {k: v for k, v in helpers.items() if v is not required}).visit(body)
        except Untranslatable:
            pass
        try:
            if _writes_columns(function):
                return function(item, *more, *args)
            return _unwrapped(function(_symbolic(item), *[x if isinstance(x, Tally) else _symbol(x) for x in more], *args))
        except Exception as e:  # whatever the function does with symbols it cannot use
            raise Untranslatable(str(e)) from e

    return call


def _symbolic(item):
    return item if isinstance(item, Tally) else Symbol(item, dtype_of(item))

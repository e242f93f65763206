"""Built-in functions and predicates of queries as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.edn import pr_str

Typed = tuple[Column, T.DataType]


def _fold(op: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda *a: reduce(op, (c for c, _ in a))


def rank(kind: T.DataType) -> str:
    """The class by which values of different types order."""
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.StringType):
        return "string"
    return "other"


def _compare(a: Typed, b: Typed, op: str) -> Column:
    (x, s), (y, t) = a, b
    if rank(s) != rank(t) and "other" not in (rank(s), rank(t)):  # never an error: types order by name
        x, y = F.lit(rank(s)), F.lit(rank(t))
    if isinstance(s, T.ArrayType) and isinstance(t, T.ArrayType):  # shorter ones come first
        x, y = F.struct(F.size(x), x), F.struct(F.size(y), y)
    return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def _chain(op: str) -> Callable[..., Column]:
    return lambda *a: reduce(Column.__and__, (_compare(x, y, op) for x, y in zip(a, a[1:], strict=False)), F.lit(True))


def _same(x: Typed, y: Typed) -> Column:
    return x[0].eqNullSafe(y[0]) if rank(x[1]) == rank(y[1]) else F.lit(False)


def _equal(*a: Typed) -> Column:
    return reduce(Column.__and__, (_same(x, y) for x, y in zip(a, a[1:], strict=False)), F.lit(True))


def truthy(x: Typed) -> Column:
    return F.coalesce(x[0], F.lit(False)) if isinstance(x[1], T.BooleanType) else x[0].isNotNull()


def _minus(*a: Typed) -> Column:
    return -a[0][0] if len(a) == 1 else reduce(Column.__sub__, (c for c, _ in a))


def _divide(*a: Typed) -> Column:
    return F.lit(1.0) / a[0][0] if len(a) == 1 else reduce(Column.__truediv__, (c.cast("double") for c, _ in a))


def _quot(a: Typed, b: Typed) -> Column:
    whole = isinstance(a[1], T.IntegralType) and isinstance(b[1], T.IntegralType)
    q = a[0].cast("double") / b[0]
    return F.call_function("div", a[0].cast("long"), b[0].cast("long")) if whole else F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("double")


def _mod(a: Typed, b: Typed) -> Column:
    r = a[0] % b[0]
    return F.when((r != 0) & ((r < 0) != (b[0] < 0)), r + b[0]).otherwise(r)


def _and(*a: Typed) -> Column:
    out = a[-1][0]
    for x in reversed(a[:-1]):
        out = F.when(truthy(x), out).otherwise(x[0])
    return out


def _or(*a: Typed) -> Column:
    out = a[-1][0]
    for x in reversed(a[:-1]):
        out = F.when(truthy(x), x[0]).otherwise(out)
    return out


def _str(*a: Typed) -> Column:
    return F.concat(*(F.coalesce(c.cast("string"), F.lit("")) for c, _ in a)) if a else F.lit("")


def _count(x: Typed) -> Column:
    n = F.char_length(x[0]) if isinstance(x[1], T.StringType) else F.size(x[0])
    return F.when(x[0].isNull(), 0).otherwise(n).cast("long")


def _range(*a: Typed) -> Column:
    start, end, step = {1: (F.lit(0), a[0][0], F.lit(1)), 2: (a[0][0], a[1][0] if len(a) > 1 else None, F.lit(1)), 3: (a[0][0], a[1][0] if len(a) > 1 else None, a[2][0] if len(a) > 2 else None)}[len(a)]
    start, end, step = (x.cast("long") for x in (start, end, step))
    last = F.when(step > 0, end - 1).otherwise(end + 1)
    some = F.when(step > 0, start < end).otherwise(start > end)
    return F.when(some, F.sequence(start, last, step)).otherwise(F.array().cast("array<long>"))


def _subs(s: Typed, start: Typed, end: Typed | None = None) -> Column:
    length = (end[0] if end else F.char_length(s[0])) - start[0]
    return F.substring(s[0], start[0].cast("int") + 1, length.cast("int"))


def _contains(c: Typed, k: Typed) -> Column:
    if isinstance(c[1], T.MapType):
        return F.map_contains_key(c[0], k[0])
    return (k[0] >= 0) & (k[0] < F.size(c[0])) if isinstance(k[1], T.IntegralType) else F.array_contains(c[0], k[0])


def _get(c: Typed, k: Typed, default: Typed | None = None) -> Column:
    if isinstance(c[1], T.MapType):
        found = F.try_element_at(c[0], k[0])
    elif isinstance(c[1], T.StructType):
        found = c[0].getItem(k[0])
    else:
        found = F.when(k[0] >= 0, F.get(c[0], k[0].cast("int")))
    return F.coalesce(found, default[0]) if default else found


def _found(s: Typed, p: Typed) -> Column:
    return F.regexp_substr(s[0], p[0])


def _matches(s: Typed, p: Typed) -> Column:
    return F.when(F.regexp_like(s[0], F.concat(F.lit("^(?:"), p[0], F.lit(")$"))), s[0])


def _name(x: Typed) -> Column:
    return F.regexp_extract(x[0], r"^:?(?:.*/)?([^/]+)$", 1)


def _namespace(x: Typed) -> Column:
    found = F.regexp_extract(x[0], r"^:?(.*)/[^/]+$", 1)
    return F.when(found != "", found)


def _keyword(*a: Typed) -> Column:
    return F.concat(F.lit(":"), *([a[0][0]] if len(a) == 1 else [a[0][0], F.lit("/"), a[1][0]]))


def _shown(x: Typed) -> Column:
    c, kind = x
    if isinstance(kind, T.StringType):
        text = F.when(c.startswith(":"), c).otherwise(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda y: _shown((y, kind.elementType))), " "), F.lit("]"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("nil"))


def _prn(*a: Typed) -> Column:
    return F.concat_ws(" ", *map(_shown, a))


def _print(*a: Typed) -> Column:
    return F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("nil")) for c, _ in a))


def _differ(*a: Typed) -> Column:
    half = len(a) // 2
    return ~reduce(Column.__and__, (_same(x, y) for x, y in zip(a[:half], a[half:], strict=True)), F.lit(True))


def _compared(a: Typed, b: Typed) -> Column:
    return F.when(_compare(a, b, "<"), -1).when(_compare(a, b, ">"), 1).otherwise(0).cast("long")


def _list(*a: Typed) -> Column:
    kinds = {rank(t) for _, t in a}
    return F.array(*(c for c, _ in a)) if len(kinds) <= 1 else F.struct(*(c.alias(f"_{i}") for i, (c, _) in enumerate(a)))


def _map(*a: Typed) -> Column:
    return F.create_map(*(c for c, _ in a))


def _not_empty(x: Typed) -> Column:
    return F.when(_count(x) > 0, x[0])


def _even(x: Typed) -> Column:
    if not isinstance(x[1], T.IntegralType):
        raise TypeError("Argument must be an integer")
    return x[0] % 2 == 0


def _blank(x: Typed) -> Column:
    return F.coalesce(F.trim(x[0]) == "", F.lit(True))


def _type(x: Typed) -> Column:
    return F.lit(x[1].simpleString())


#: By the name that queries use.
BUILT_INS: dict[str, Callable[..., Column]] = {
    "=": _equal, "==": _equal, "not=": lambda *a: ~_equal(*a), "!=": lambda *a: ~_equal(*a),
    "<": _chain("<"), ">": _chain(">"), "<=": _chain("<="), ">=": _chain(">="),
    "+": _fold(Column.__add__), "-": _minus, "*": _fold(Column.__mul__), "/": _divide,
    "quot": _quot, "rem": lambda a, b: a[0] % b[0], "mod": _mod, "inc": lambda a: a[0] + 1, "dec": lambda a: a[0] - 1,
    "max": lambda *a: F.greatest(*(c for c, _ in a)) if len(a) > 1 else a[0][0], "min": lambda *a: F.least(*(c for c, _ in a)) if len(a) > 1 else a[0][0],
    "zero?": lambda a: a[0] == 0, "pos?": lambda a: a[0] > 0, "neg?": lambda a: a[0] < 0, "even?": _even, "odd?": lambda a: ~_even(a),
    "compare": _compared, "rand": lambda *a: F.rand() * a[0][0] if a else F.rand(), "rand-int": lambda a: F.floor(F.rand() * a[0]),
    "true?": lambda a: a[0].eqNullSafe(F.lit(True)) if isinstance(a[1], T.BooleanType) else F.lit(False),
    "false?": lambda a: a[0].eqNullSafe(F.lit(False)) if isinstance(a[1], T.BooleanType) else F.lit(False),
    "nil?": lambda a: a[0].isNull(), "some?": lambda a: a[0].isNotNull(), "not": lambda a: ~truthy(a), "and": _and, "or": _or,
    "identical?": _equal, "identity": lambda a: a[0], "ground": lambda a: a[0], "untuple": lambda a: a[0],
    "keyword": _keyword, "name": _name, "namespace": _namespace, "meta": lambda a: F.lit(None).cast("string"), "type": _type,
    "vector": _list, "list": _list, "tuple": lambda *a: F.struct(*(c.alias(f"_{i}") for i, (c, _) in enumerate(a))), "set": lambda a: F.array_distinct(a[0]),
    "hash-map": _map, "array-map": _map, "count": _count, "range": _range, "not-empty": _not_empty, "empty?": lambda a: _count(a) == 0,
    "contains?": _contains, "get": _get, "str": _str, "subs": _subs,
    "pr-str": _prn, "prn-str": lambda *a: F.concat(_prn(*a), F.lit("\n")), "print-str": _print, "println-str": lambda *a: F.concat(_print(*a), F.lit("\n")),
    "re-pattern": lambda a: a[0], "re-find": lambda p, s: _found(s, p), "re-matches": lambda p, s: _matches(s, p),
    "re-seq": lambda p, s: F.when(F.regexp_like(s[0], p[0]), F.regexp_extract_all(s[0], p[0], F.lit(0))),
    "-differ?": _differ, "clojure.string/blank?": _blank,
    "clojure.string/includes?": lambda s, t: F.contains(s[0], t[0]), "clojure.string/starts-with?": lambda s, t: F.startswith(s[0], t[0]), "clojure.string/ends-with?": lambda s, t: F.endswith(s[0], t[0]),
}

#: Those that look into a database; the compiler joins for them.
DATABASE = ("get-else", "get-some", "missing?")

__all__ = ["BUILT_INS", "DATABASE", "pr_str", "truthy"]

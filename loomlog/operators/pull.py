"""Pull: nested projections of entities, for single entities on the driver and for many as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.edn import Keyword, Seq, Symbol, pr_str, read_string
from loomlog.errors import DatalogError
from loomlog.sources.db import Db, literal, sort_key
from loomlog.sources.schema import reverse

ID = Keyword(":db/id")
LIMIT = 1000
WILDCARDS = ("*", ":*")
UNBOUNDED = -1


@dataclass
class Attr:
    name: Any  # as asked for
    attribute: Any  # the stored attribute
    back: bool = False
    key: Any = None
    limit: int | None = LIMIT
    default: Any = None
    has_default: bool = False
    xform: Callable | None = None
    sub: Pattern | None = None
    depth: int | None = None  # recursion: how deep, UNBOUNDED for no limit


@dataclass
class Pattern:
    attrs: list[Attr] = field(default_factory=list)
    wildcard: bool = False
    with_id: bool = False


def parse_pattern(form: Any, functions: dict[str, Callable] | None = None) -> Pattern:
    form = read_string(form) if isinstance(form, str) and not isinstance(form, Keyword) else form
    if not isinstance(form, list | tuple):
        raise DatalogError(f"Expected pattern to be sequential?, got: {pr_str(form)}")
    out = Pattern()
    for x in form:
        if isinstance(x, dict):
            for spec, sub in x.items():
                a = attr_spec(list(spec) if isinstance(spec, tuple) else spec, functions)
                if isinstance(sub, int) and not isinstance(sub, bool):
                    if sub <= 0:
                        raise DatalogError(f"Expected pull pattern or recursion limit, got: {pr_str(sub)}")
                    a.depth = sub
                elif sub in (Symbol("..."), "..."):
                    a.depth = UNBOUNDED
                else:
                    a.sub = parse_pattern(sub, functions)
                out.attrs.append(a)
        elif not isinstance(x, list | tuple) and str(x) in WILDCARDS:
            out.wildcard = True
        elif x == ID:
            out.with_id = True
        else:
            out.attrs.append(attr_spec(x, functions))
    return out


def attr_spec(x: Any, functions: dict[str, Callable] | None) -> Attr:
    if isinstance(x, list | tuple):
        if x and x[0] in (Symbol("limit"), Symbol("default"), "limit", "default") and len(x) == 3:
            a = attr_spec(x[1], functions)
            options = [Keyword(str(x[0])), x[2]]
        else:
            a, options = attr_spec(x[0], functions), list(x[1:])
        for k, v in zip(options[::2], options[1::2], strict=True):
            option = str(k).lstrip(":")
            if option == "limit":
                if v is not None and (not isinstance(v, int) or v <= 0):
                    raise DatalogError(f"Expected limit to be positive or nil, got: {pr_str(v)}")
                a.limit = v
            elif option == "default":
                a.default, a.has_default = v, True
            elif option == "as":
                a.key = v
            elif option == "xform":
                a.xform = v if callable(v) else (functions or {}).get(str(v))
                if a.xform is None:
                    raise DatalogError(f"Can't resolve symbol {v}")
            else:
                raise DatalogError(f"Unexpected attribute option: {pr_str(k)}")
        return a
    back = reverse(x)
    return Attr(x, back or x, back is not None, key=x)


# -- one entity at a time


def pull(db: Db, pattern: Any, ref: Any, visitor: Callable | None = None, functions: dict[str, Callable] | None = None) -> dict | None:
    """The pattern's map for an entity; None where nothing is found."""
    eid = db.entid(ref)
    parsed = pattern if isinstance(pattern, Pattern) else parse_pattern(pattern, functions)
    return None if eid is None else _pulled(db, parsed, eid, frozenset(), {}, visitor)


def pull_many(db: Db, pattern: Any, refs: list, **options: Any) -> list[dict | None]:
    parsed = parse_pattern(pattern, options.get("functions"))
    return [pull(db, parsed, r, **options) for r in refs]


def _pulled(db: Db, p: Pattern, eid: int, seen: frozenset, left: dict, visitor: Callable | None) -> dict | None:
    facts = db.facts_of(eid)
    out: dict = {}
    attrs = list(p.attrs)
    if p.wildcard:
        named = {a.attribute for a in attrs if not a.back}
        attrs += [Attr(a, a, key=a) for a in facts if a not in named]
    for a in attrs:
        if visitor:
            visitor(Keyword(":db.pull/reverse") if a.back else Keyword(":db.pull/attr"), eid, a.attribute, None)
        values = db.having(a.attribute, eid) if a.back else [v for v, _ in facts.get(a.attribute, ())]
        single = (db.schema.component(a.attribute) if a.back else not db.schema.many(a.attribute))
        if a.limit is not None:
            values = values[: a.limit]
        if a.back or db.schema.ref(a.attribute):
            values = [r for v in values if (r := _referred(db, p, a, v, seen | {eid}, left, visitor)) is not None]
        elif a.sub or a.depth:
            values = []
        value = (values[0] if single else values) if values else None
        if a.xform:
            value = a.xform(value)
        if value is None and a.has_default:
            value = a.default
        if value is not None:
            out[a.key] = value
    if (p.with_id or p.wildcard) and (facts or out):
        out = {ID: eid, **out}
    return out or None


def _referred(db: Db, p: Pattern, a: Attr, v: int, seen: frozenset, left: dict, visitor: Callable | None) -> dict | None:
    if a.depth is not None:
        if v in seen:
            return {ID: v}
        if a.depth != UNBOUNDED:
            rest = left.get(a.name, a.depth)
            if rest <= 0:
                return None
            left = {**left, a.name: rest - 1}
        return _pulled(db, p, v, seen, left, visitor)
    if a.sub is not None:
        return _pulled(db, a.sub, v, seen, left if False else {}, visitor)
    if db.schema.component(a.attribute) and not a.back:
        if v in seen:
            return {ID: v}
        return _pulled(db, Pattern(wildcard=True), v, seen, {}, visitor)
    return {ID: v}


# -- many entities as a DataFrame


def field_name(key: Any) -> str:
    return str(key).lstrip(":").replace("/", "_").replace(".", "_").replace("-", "_")


def pull_frame(db: Db, pattern: Any, ids: DataFrame | None = None, depth: dict | None = None) -> DataFrame:
    """``e`` and ``pulled``, a struct with a field for each attribute of the pattern (null where absent), for every
    entity that has any of them, or for those of ``ids`` (column ``e``). Attributes of one value from one table come
    from a single scan; each many-valued, reverse or nested one is an aggregation by entity and a join. A recursion is
    unrolled to its depth."""
    p = pattern if isinstance(pattern, Pattern) else parse_pattern(pattern)
    attrs = list(p.attrs)
    if p.wildcard:
        named = {a.attribute for a in attrs if not a.back}
        attrs += [Attr(a, a, key=a) for a in db.attributes() if a not in named]
    flat = [a for a in attrs if not a.back and not a.sub and a.depth is None and not db.schema.many(a.attribute)]
    out: DataFrame | None = None
    columns: dict[str, Column] = {}
    groups: dict[Any, list[Attr]] = {}
    for a in flat:
        home = db.home(a.attribute)
        groups.setdefault(id(home[0].frame) if home and db.fused([a.attribute]) is not None else ("own", str(a.attribute)), []).append(a)
    frames = []
    for g, own in groups.items():
        names = [f"_{len(columns) + i}" for i in range(len(own))]
        df = db.attr(own[0].attribute).select("e", F.col("v").alias("a0")) if isinstance(g, tuple) else db.fused([a.attribute for a in own])
        frames.append(df.select("e", *(F.col(f"a{i}").alias(n) for i, n in enumerate(names))))
        for a, n in zip(own, names, strict=True):
            v = F.col(n)
            if db.schema.ref(a.attribute):
                v = F.when(v.isNotNull(), F.struct(v.alias("db_id")))
            columns[field_name(a.key)] = _defaulted(v, a)
    for a in attrs:
        if a in flat:
            continue
        n = f"_{len(columns)}"
        df = db.attr(a.attribute).select(F.col("v").cast("long").alias("e"), F.col("e").alias("v")) if a.back else db.attr(a.attribute).select("e", "v")
        single = db.schema.component(a.attribute) if a.back else not db.schema.many(a.attribute)
        if a.back or db.schema.ref(a.attribute):
            sub = a.sub
            if a.depth is not None:
                if a.depth == UNBOUNDED:
                    raise DatalogError("A DataFrame has a bounded depth: give the recursion a number")
                rest = (depth or {}).get(a.name, a.depth)
                if rest <= 0:
                    continue
                inner = pull_frame(db, p, depth={**(depth or {}), a.name: rest - 1})
            else:
                inner = pull_frame(db, sub) if sub else None
            if inner is not None:
                inner = inner.select(F.col("e").alias("__e"), "pulled")
                df = df.join(inner, F.col("v") == F.col("__e")).select("e", F.col("v").alias("id"), F.col("pulled").alias("v"))
            else:
                df = df.select("e", F.col("v").alias("id"), F.struct(F.col("v").alias("db_id")).alias("v"))
        else:
            df = df.select("e", F.col("v").alias("id"), "v")
        if single:
            df = df.groupBy("e").agg(F.min_by("v", "id").alias(n)) if a.back else df.select("e", F.col("v").alias(n))
        else:
            own = F.array_sort(F.collect_list(F.struct("id", "v")))
            own = own if a.limit is None else F.slice(own, 1, a.limit)
            df = df.groupBy("e").agg(F.transform(own, lambda x: x["v"]).alias(n))
        frames.append(df)
        columns[field_name(a.key)] = _defaulted(F.col(n), a)
    for df in frames:
        out = df if out is None else out.join(df, "e", "full_outer")
    if out is None:
        out = db.tagged().select("e").distinct()
    if ids is not None:
        out = ids.select("e").distinct().join(out, "e", "left" if any(a.has_default for a in attrs) else "inner")
    fields = [c.alias(k) for k, c in columns.items()]
    if p.with_id or p.wildcard or not fields:
        fields = [F.col("e").alias("db_id"), *fields]
    raw = [c for c in out.columns if c != "e"]
    if raw and not any(a.has_default for a in attrs):
        out = out.where(F.coalesce(*(F.col(c).isNotNull() & F.lit(True) for c in raw)) if len(raw) == 1 else F.greatest(*(F.col(c).isNotNull() for c in raw)))
    return out.select("e", F.struct(*fields).alias("pulled"))


def _defaulted(v: Column, a: Attr) -> Column:
    return F.coalesce(v, literal(a.default)) if a.has_default else v


__all__ = ["Seq", "parse_pattern", "pull", "pull_frame", "pull_many", "sort_key"]

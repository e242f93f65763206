"""From a query's clauses to DataFrames.

A context is a list of disjoint relations (DataFrames whose columns are variables) and constants. Each clause scans,
joins, filters, unites or subtracts. Before that, patterns on one entity variable that a single table answers are fused
into one scan, constants are inlined so that they reach the files, and bodies of ``or`` and ``not`` are compiled by
themselves where they don't need the context, so that they join once, on what they share. Joins are plain equalities
where neither side can be null and null-safe otherwise. A relation remembers what is unique in it, and a final distinct
is left out where the result has that.
"""

from __future__ import annotations

import datetime as dt
import itertools
import typing
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.edn import Keyword, frozen, pr_str
from loomlog.errors import DatalogError
from loomlog.functions.scalar import BUILT_INS, DATABASE, rank, truthy
from loomlog.plans import query as Q
from loomlog.sources.db import Db, literal, native, spark_type
from loomlog.sources.schema import reverse
from loomlog.sources.shared import written

fresh = itertools.count()


def col(v: str) -> Column:
    return F.col(f"`{v}`")


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    vars: frozenset[str]
    keys: frozenset[str] | None = None  # variables that are unique together
    nullable: frozenset[str] = frozenset()
    textual: frozenset[str] = frozenset()  # values of unknown attributes, as text

    def kind(self, v: str) -> T.DataType:
        return self.df.schema[v].dataType

    def where(self, condition: Column) -> Rel:
        return replace(self, df=self.df.where(condition))

    def project(self, names: set[str] | frozenset[str]) -> Rel:
        own = sorted(self.vars & names)
        return Rel(self.df.select(*map(col, own)), frozenset(own), self.keys if self.keys is not None and self.keys <= set(own) else None, self.nullable & names, self.textual & names)


@dataclass(frozen=True)
class Stored:
    """A clause that is a relation already: what a recursive rule has so far."""

    rel: DataFrame
    args: tuple


def _condition(a: Rel, b: Rel, x: str, renamed: str) -> Column:
    left, right = col(x), col(renamed)
    s, t = a.kind(x), b.kind(x)
    if x in a.textual and x not in b.textual or x in b.textual and x not in a.textual:
        left, right = left.cast("string"), right.cast("string")
    elif rank(s) != rank(t):
        return F.lit(False)
    return left.eqNullSafe(right) if x in a.nullable and x in b.nullable else left == right


def join(a: Rel, b: Rel) -> Rel:
    shared = sorted(a.vars & b.vars)
    names = {x: f"{x}__{next(fresh)}" for x in shared}
    right = b.df.withColumnsRenamed(names)
    if shared:
        on = _condition(a, b, shared[0], names[shared[0]])
        for x in shared[1:]:
            on = on & _condition(a, b, x, names[x])
        df = a.df.join(right, on).drop(*names.values())
    else:
        df = a.df.crossJoin(right)
    keys = None
    if a.keys is not None and b.keys is not None:
        keys = a.keys if b.keys <= set(shared) else b.keys if a.keys <= set(shared) else a.keys | b.keys
    return Rel(df, a.vars | b.vars, keys, a.nullable | b.nullable, a.textual | b.textual)


@dataclass(frozen=True)
class Negated:
    """The complement of a predicate."""

    of: Any


class Context:
    def __init__(self, spark: SparkSession, sources: dict[str, Any], rules: dict[str, Q.Rule], consts: dict[str, Any] | None = None) -> None:
        self.spark, self.sources, self.rules = spark, sources, rules
        self.consts: dict[str, Any] = dict(consts or {})
        self.rels: list[Rel] = []
        self.empty = False
        self.fixpoints: dict[tuple, dict[str, DataFrame]] = {}

    def sub(self, names: set[str] | None = None) -> Context:
        """A context for a clause's body; with ``names``, it has what is bound of them."""
        new = Context(self.spark, self.sources, self.rules, self.consts)
        new.fixpoints = self.fixpoints
        if names:
            for r in self.rels:
                if own := r.vars & names:
                    p = r.project(own)
                    new.rels.append(p if p.keys is not None else replace(p, df=p.df.distinct(), keys=p.vars))
        return new

    @property
    def bound(self) -> set[str]:
        return set(self.consts).union(*(r.vars for r in self.rels))

    def add(self, rel: Rel) -> None:
        """Joins every relation that shares a variable with ``rel``."""
        rest = []
        for r in self.rels:
            if r.vars & rel.vars:
                rel = join(r, rel)
            else:
                rest.append(r)
        self.rels = [*rest, rel]

    def together(self, names: set[str]) -> Rel | None:
        """The relations that have any of ``names``, as one."""
        own = [r for r in self.rels if r.vars & names]
        if not own:
            return None
        out = own[0]
        for r in own[1:]:
            out = join(out, r)
        self.rels = [*(r for r in self.rels if r not in own), out]
        return out

    def put(self, old: Rel, new: Rel) -> None:
        self.rels = [new if r is old else r for r in self.rels]

    def nothing(self) -> None:
        self.empty = True
        self.rels = [r.where(F.lit(False)) for r in self.rels]

    def result(self, names: list[str]) -> Rel:
        """The relations restricted to ``names``, as one; constants are columns of it."""
        own = set(names)
        parts = [r for r in self.rels if r.vars & own]
        rest = [r for r in self.rels if not r.vars & own]
        out = None
        for r in parts:
            p = r.project(own)
            out = p if out is None else join(out, p)
        if out is None:
            df = self.spark.range(1).select()
            out = Rel(df.where(F.lit(False)) if self.empty else df, frozenset(), frozenset())
        for r in rest:  # what is not asked for must still have a row
            out = replace(out, df=out.df.join(r.df.select(F.lit(1).alias(f"__{next(fresh)}")).limit(1), F.lit(True), "left_semi"))
        missing = [n for n in names if n not in out.vars]
        if missing:
            out = replace(out, df=out.df.select("*", *(const_column(self.consts[n]).alias(n) for n in missing)), vars=out.vars | set(missing))
        return out

    # -- clauses

    def run(self, clauses: tuple) -> None:
        check_bound(clauses, self.bound, self.consts)
        for c in self.planned(clauses):
            self.resolve(c)

    def planned(self, clauses: tuple) -> list:
        """The clauses with patterns on one entity gathered into scans of one table."""
        groups: dict[tuple, list[Q.Pattern]] = {}
        for c in clauses:
            if (k := self._scan_key(c)) is not None:
                groups.setdefault(k, []).append(c)
        out, done = [], set()
        for c in clauses:
            k = self._scan_key(c)
            if k is None:
                out.append(c)
            elif k not in done:
                done.add(k)
                out.append(groups[k])
        return out

    def _scan_key(self, c: Any) -> tuple | None:
        if not isinstance(c, Q.Pattern) or len(c.terms) not in (2, 3) or not isinstance(self.sources.get(c.source), Db):
            return None
        db, e, a = self.sources[c.source], c.terms[0], self.known(c.terms[1])
        if not isinstance(a, Q.Const) or not isinstance(e, Q.Var) or e.name in self.consts:
            return None
        return (c.source, e.name, id(db.home(a.value)[0].frame)) if db.fused([a.value]) is not None else None

    def known(self, t: Any) -> Any:
        """A term with its constant, where it is one."""
        return Q.Const(self.consts[t.name]) if isinstance(t, Q.Var) and t.name in self.consts else t

    def resolve(self, c: Any) -> None:
        if isinstance(c, list):
            self.scan(c)
        elif isinstance(c, Q.Pattern):
            self.pattern(c)
        elif isinstance(c, Stored):
            self.add(frame_pattern(c.rel, c.args, self))
        elif isinstance(c, Q.Predicate):
            self.predicate(c)
        elif isinstance(c, Q.Function):
            self.function(c)
        elif isinstance(c, Q.And):
            for x in self.planned(c.clauses):
                self.resolve(x)
        elif isinstance(c, Q.Or):
            self.either(c)
        elif isinstance(c, Q.Not):
            self.negated(c)
        elif isinstance(c, Q.RuleCall):
            self.rule(c)
        else:
            raise DatalogError(f"Cannot resolve {c}")

    def scan(self, patterns: list[Q.Pattern]) -> None:
        """Patterns on one entity variable as one scan."""
        db: Db = self.sources[patterns[0].source]
        e = patterns[0].terms[0].name
        attributes = list(dict.fromkeys(self.known(p.terms[1]).value for p in patterns))
        equal: dict[int, Any] = {}
        for p in patterns:
            v = self.known(p.terms[2]) if len(p.terms) == 3 else Q.Blank()
            a = self.known(p.terms[1]).value
            if isinstance(v, Q.Const):
                value = db.entid_strict(v.value) if db.schema.ref(a) and not isinstance(v.value, int) else v.value
                i = attributes.index(a)
                if i in equal and equal[i] != value:
                    self.nothing()
                equal[i] = value
        df = db.fused(attributes, equal=equal)
        present = F.lit(True)
        for i in range(len(attributes)):
            present = present & F.col(f"a{i}").isNotNull()
        df = df.where(present)
        names: dict[str, str] = {}
        for p in patterns:
            v = p.terms[2] if len(p.terms) == 3 else Q.Blank()
            i = attributes.index(self.known(p.terms[1]).value)
            if isinstance(v, Q.Var) and v.name not in self.consts:
                if v.name == e:
                    df = df.where(F.col("e") == F.col(f"a{i}"))
                elif v.name in names and names[v.name] != f"a{i}":
                    df = df.where(F.col(names[v.name]) == F.col(f"a{i}"))
                else:
                    names[v.name] = f"a{i}"
        self.add(Rel(df.select(F.col("e").alias(e), *(F.col(c).alias(v) for v, c in names.items())), frozenset({e, *names}), frozenset({e})))

    def pattern(self, c: Q.Pattern) -> None:
        source = self.sources.get(c.source)
        if source is None:
            raise DatalogError(f"Where uses unknown source vars: [{c.source}]")
        if isinstance(source, Db):
            self.add(db_pattern(source, c.terms, self))
        elif isinstance(source, DataFrame):
            self.add(frame_pattern(source, c.terms, self))
        else:
            self.add(list_pattern(source, c.terms, self))

    def argument(self, t: Any, rel: Rel | None) -> tuple[Column, T.DataType]:
        t = self.known(t)
        if isinstance(t, Q.Const):
            value = t.value
            return literal(value), spark_type([value]) or T.StringType()
        if isinstance(t, Q.Var):
            return col(t.name), rel.kind(t.name)
        raise DatalogError(f"Cannot use {t} as an argument")

    def callable_of(self, f: Any) -> Callable | str:
        """A built-in's name, or a function of the program's."""
        if isinstance(f, Q.Var):
            found = self.consts.get(f.name)
            if isinstance(found, Negated):
                return found
            if isinstance(found, Q.Name):
                return self.callable_of(found)
            if callable(found):
                return found
            raise DatalogError(f"Unknown function '{f.name}'")
        if isinstance(f, Q.Const) and callable(f.value):
            return f.value
        if isinstance(f, Negated):
            return f
        name = f.name
        if name in BUILT_INS or name in DATABASE:
            return name
        if name in REGISTRY:
            return REGISTRY[name]
        raise DatalogError(f"Unknown predicate or function '{name}'")

    def applied(self, f: Any, args: tuple, rel: Rel | None, kind: str | None = None) -> Column:
        if isinstance(f, Negated):
            inner = self.applied(f.of, args, rel, kind or "boolean")
            return ~truthy((inner, (rel.df if rel else self.spark.range(1)).select(inner.alias("x")).schema["x"].dataType))
        if isinstance(f, str):
            own = [self.argument(t, rel) for t in args if not isinstance(t, Q.Source)]
            return BUILT_INS[f](*own)
        own = [self.argument(t, rel)[0] for t in args]
        return F.udf(f, kind or return_type(f))(*own)

    def _names(self, args: tuple) -> set[str]:
        return {t.name for t in args if isinstance(t, Q.Var) and t.name not in self.consts}

    def predicate(self, c: Q.Predicate) -> None:
        f = self.callable_of(c.function)
        if f == "missing?":
            self.missing(c)
            return
        if f in DATABASE:
            out = f"?__{next(fresh)}"
            self.function(Q.Function(c.source, c.function, c.args, Q.BindScalar(Q.Var(out))))
            return
        names = self._names(c.args)
        rel = self.together(names)
        if f == "ground" and not names:
            return
        condition = self.applied(f, c.args, rel, "boolean" if callable(f) and return_type(f) == "string" else None)
        if rel is None:
            probe = self.spark.range(1).select(condition.alias("x"))
            if not probe.where(truthy((F.col("x"), probe.schema["x"].dataType))).take(1):
                self.nothing()
            return
        kind = rel.df.select(condition.alias("x")).schema["x"].dataType
        self.put(rel, rel.where(condition if isinstance(kind, T.BooleanType) else condition.isNotNull()))  # null doesn't pass a filter

    def _entity(self, t: Any, db: Db) -> tuple[Rel | None, Column]:
        """The relation and column of a database function's entity argument; lookup refs are resolved."""
        t = self.known(t)
        if isinstance(t, Q.Const):
            return None, F.lit(db.entid(t.value)).cast("long")
        return self.together({t.name}), col(t.name)

    def missing(self, c: Q.Predicate) -> None:
        db, e, a = self.sources[c.args[0].name], c.args[1], self.known(c.args[2]).value
        back = reverse(a)
        df = db.attr(back).select(F.col("v").cast("long").alias("__e")) if back else db.attr(a).select(F.col("e").alias("__e"))
        rel, column = self._entity(e, db)
        if rel is None:
            if df.where(F.col("__e") == column).take(1):
                self.nothing()
            return
        self.put(rel, replace(rel, df=rel.df.join(df, column == F.col("__e"), "left_anti")))

    def function(self, c: Q.Function) -> None:
        if c.function == Q.Name("complement"):
            of = self.callable_of(c.args[0])
            self.consts[c.binding.var.name] = Negated(of)
            return
        f = self.callable_of(c.function)
        if f in ("ground", "identity", "untuple") and not self._names(c.args):
            self.bind(c.binding, self.known(c.args[0]).value)
            return
        if f in DATABASE:
            self.database_function(f, c)
            return
        rel = self.together(self._names(c.args))
        if rel is None:
            rel = Rel(self.spark.range(1).select(F.lit(1).alias("__one")), frozenset(), frozenset())
            self.rels.append(rel)
        column = self.applied(f, c.args, rel)
        self.put(rel, self.destructured(rel, c.binding, column))

    def database_function(self, f: str, c: Q.Function) -> None:
        db: Db = self.sources[c.args[0].name]
        rel, column = self._entity(c.args[1], db)
        if rel is None:
            rel = Rel(self.spark.range(1).select(F.lit(1).alias("__one")), frozenset(), frozenset())
            self.rels.append(rel)
        out, df = f"__{next(fresh)}", rel.df
        if f == "missing?":
            a = self.known(c.args[2]).value
            own = db.attr(a).select(F.col("e").alias(f"{out}e")).distinct()
            df = df.join(own, column == F.col(f"{out}e"), "left").withColumn(out, F.col(f"{out}e").isNull()).drop(f"{out}e")
        else:
            attributes = [self.known(t).value for t in (c.args[2:3] if f == "get-else" else c.args[2:])]
            values = []
            if f == "get-some":  # those that nothing has decide neither value nor type
                attributes = [a for a in attributes if db.home(a) or db.local(a)] or attributes[:1]
            for i, a in enumerate(attributes):
                own = db.attr(a).select(F.col("e").alias(f"{out}e{i}"), F.col("v").alias(f"{out}v{i}"))
                if db.schema.many(a):
                    own = own.groupBy(f"{out}e{i}").agg(F.min(f"{out}v{i}").alias(f"{out}v{i}"))
                df = df.join(own, column == F.col(f"{out}e{i}"), "left").drop(f"{out}e{i}")
                values.append((a, f"{out}v{i}", own.schema[f"{out}v{i}"].dataType))
            if f == "get-else":
                default = self.known(c.args[3])
                if isinstance(default, Q.Const) and default.value is None:
                    raise DatalogError("get-else: nil default value is not supported")
                value = F.coalesce(F.col(values[0][1]), self.argument(default, rel)[0])
            else:
                same = len({rank(k) for _, _, k in values}) == 1
                each = [F.when(F.col(v).isNotNull(), F.struct(F.lit(str(a)).alias("_0"), (F.col(v) if same else F.col(v).cast("string")).alias("_1"))) for a, v, _ in values]
                value = F.coalesce(*each)
            df = df.withColumn(out, value).drop(*(v for _, v, _ in values))
        new = self.destructured(replace(rel, df=df), c.binding, F.col(f"`{out}`"))
        self.put(rel, replace(new, df=new.df.drop(out)))

    def destructured(self, rel: Rel, b: Any, column: Column) -> Rel:
        """A relation with what a function's result binds; rows without a result go."""
        name = f"__{next(fresh)}"
        rel = replace(rel, df=rel.df.withColumn(name, column))
        return self._bound(rel, b, name, first=True)

    def _bound(self, rel: Rel, b: Any, name: str, first: bool = False) -> Rel:
        kind = rel.df.schema[name].dataType
        if isinstance(b, Q.BindScalar):
            if first:
                rel = rel.where(col(name).isNotNull())
            v = b.var.name if isinstance(b.var, Q.Var) else None
            if v is None:
                return replace(rel, df=rel.df.drop(name))
            if v in self.consts:
                value = self.consts[v]
                same = literal(value).eqNullSafe(col(name)) if rank(spark_type([value]) or T.StringType()) == rank(kind) else F.lit(False)
                return replace(rel.where(same), df=rel.where(same).df.drop(name))
            if v in rel.vars:
                same = col(v).eqNullSafe(col(name)) if rank(rel.kind(v)) == rank(kind) else F.lit(False)
                return replace(rel, df=rel.df.where(same).drop(name))
            out = Rel(rel.df.withColumnRenamed(name, v), rel.vars | {v}, rel.keys, rel.nullable | {v}, rel.textual)
            for r in [r for r in self.rels if v in r.vars]:  # bound elsewhere: join
                self.rels.remove(r)
                out = join(out, r)
            return out
        if first:
            rel = rel.where(col(name).isNotNull())
        if isinstance(b, Q.BindColl):
            inner = f"__{next(fresh)}"
            if isinstance(kind, T.MapType):
                df = rel.df.select("*", F.explode(F.map_entries(col(name))).alias(inner)).drop(name)
            elif isinstance(kind, T.StructType):
                df = rel.df.select("*", F.explode(F.array(*(col(name).getField(f) for f in kind.names))).alias(inner)).drop(name)
            else:
                df = rel.df.select("*", F.explode(col(name)).alias(inner)).drop(name)
            return self._bound(replace(rel, df=df, keys=None), b.part, inner)
        parts = []
        for i, p in enumerate(b.parts):
            inner = f"__{next(fresh)}"
            if isinstance(kind, T.StructType):
                if len(kind) < len(b.parts):
                    raise DatalogError(f"Not enough elements in a collection to bind tuple {len(b.parts)}")
                value = col(name).getField(kind.names[i])
            else:
                value = F.get(col(name), i)
            rel = replace(rel, df=rel.df.withColumn(inner, value))
            parts.append((p, inner))
        rel = replace(rel, df=rel.df.drop(name))
        for p, inner in parts:
            rel = self._bound(rel, p, inner)
        return rel

    # -- inputs

    def bind(self, b: Any, value: Any) -> None:
        """An input or a ground value."""
        if isinstance(b, Q.BindScalar):
            if isinstance(b.var, Q.Var):
                v = b.var.name
                if v in self.consts:
                    if frozen(self.consts[v]) != frozen(value):
                        self.nothing()
                elif rel := self.together({v}):
                    self.put(rel, rel.where(col(v).eqNullSafe(literal(value))))
                else:
                    self.consts[v] = value
            return
        if isinstance(value, DataFrame):
            names = [v.name for v in Q.bound_vars(b)]
            self.add(Rel(value.toDF(*names) if len(names) == len(value.columns) else value.select(*value.columns[: len(names)]).toDF(*names), frozenset(names), None, frozenset(names)))
            return
        if isinstance(b, Q.BindTuple):
            if not isinstance(value, list | tuple):
                raise DatalogError(f"Cannot bind value {pr_str(value)} to tuple {shown(b)}")
            if len(value) < len(b.parts):
                raise DatalogError(f"Not enough elements in a collection {pr_str(list(value))} to bind tuple {shown(b)}")
            for p, x in zip(b.parts, value, strict=False):
                self.bind(p, x)
            return
        if isinstance(value, dict):
            value = [list(x) for x in value.items()]
        if isinstance(value, str) or not isinstance(value, list | tuple | set | frozenset | range):
            raise DatalogError(f"Cannot bind value {pr_str(value)} to collection {shown(b)}")
        names = [v.name for v in Q.bound_vars(b)]
        rows: list[dict] = []
        for x in value:
            rows += flattened(b.part, x)
        self.add(local_rel(self.spark, names, [tuple(r[n] for n in names) for r in rows]))

    # -- or, not, rules

    def body(self, clauses: tuple, names: set[str], always: bool = False) -> Context:
        """A context in which a body has been resolved: by itself, or with what it needs of this one."""
        try:
            check_bound(clauses, set(self.consts), self.consts)
            needs = always
        except DatalogError:
            needs = True
        sub = self.sub(names if needs else None)
        sub.run(clauses)
        return sub

    def either(self, c: Q.Or) -> None:
        names = {v.name for v in (*c.required, *c.free)} if c.free is not None else Q.clause_vars(c)
        wanted = sorted(n for n in names if n not in self.consts)
        visible = self.bound if c.free is None else names
        parts: list[Rel] = []
        for b in c.branches:
            sub = self.body((b,), visible & (names | Q.clause_vars(b)))
            parts.append(sub.result(wanted))
        if not wanted:
            alive = [p for p in parts if p.df.take(1)]
            if not alive:
                self.nothing()
            return
        out = unite([p.project(set(wanted)) for p in parts], wanted)
        self.add(out)

    def negated(self, c: Q.Not) -> None:
        inner = set().union(*map(Q.clause_vars, c.clauses))
        names = {v.name for v in c.vars} if c.vars is not None else inner & self.bound
        sub = self.body(c.clauses, names)
        shared = sorted(n for n in names if n not in self.consts)
        if not shared:
            if sub.result([]).df.take(1):
                self.nothing()
            return
        rel, other = self.together(set(shared)), sub.result(shared)
        renamed = {x: f"{x}__{next(fresh)}" for x in shared}
        on = _condition(rel, other, shared[0], renamed[shared[0]])
        for x in shared[1:]:
            on = on & _condition(rel, other, x, renamed[x])
        self.put(rel, replace(rel, df=rel.df.join(other.df.withColumnsRenamed(renamed), on, "left_anti")))

    def rule(self, c: Q.RuleCall) -> None:
        if c.name not in self.rules:
            raise DatalogError(f"Unknown rule '{c.name} in ({c.name} {' '.join(map(show_term, c.args))})")
        rule = self.rules[c.name]
        if len(rule.vars) != len(c.args):
            raise DatalogError(f"Wrong number of arguments for rule '{c.name}': {len(c.args)}, expected {len(rule.vars)}")
        from loomlog.operators.rules import fixpoint, inlined, recursive

        if recursive(self.rules, c.name):
            self.add(frame_pattern(fixpoint(self, c.name, c.source), c.args, self))
        else:
            self.resolve(inlined(self, rule, c))


REGISTRY: dict[str, Callable] = {}


def register(name: str, function: Callable) -> None:
    """Makes a function known to queries by a name like ``my.ns/f``."""
    REGISTRY[name] = function


def return_type(f: Callable) -> Any:
    """A function's result type: its attribute ``returns``, or its annotation, or text."""
    found = getattr(f, "returns", None) or getattr(f, "__annotations__", {}).get("return")
    simple = {int: "long", float: "double", str: "string", bool: "boolean", dt.datetime: "timestamp", "int": "long", "float": "double", "str": "string", "bool": "boolean"}
    if found in simple if isinstance(found, type | str) else False:
        return simple[found]
    if isinstance(found, str) and found.startswith("list["):
        return f"array<{simple[found[5:-1]]}>"
    if typing.get_origin(found) is list:
        return f"array<{simple[typing.get_args(found)[0]]}>"
    return found or "string"


def const_column(value: Any) -> Column:
    if isinstance(value, list | tuple | dict) and not isinstance(value, str):
        return F.lit(pr_str(list(value) if isinstance(value, tuple) else value))
    if isinstance(value, Db) or callable(value):
        return F.lit(str(value))
    return literal(value)


def shown(b: Any) -> str:
    if isinstance(b, Q.BindScalar):
        return b.var.name if hasattr(b.var, "name") else "_"
    if isinstance(b, Q.BindColl):
        return f"[{shown(b.part)} ...]"
    return "[" + " ".join(map(shown, b.parts)) + "]"


def show_term(t: Any) -> str:
    return t.name if hasattr(t, "name") else pr_str(t.value) if isinstance(t, Q.Const) else "_"


def flattened(b: Any, value: Any) -> list[dict]:
    """The rows that a value gives to a nested binding."""
    if isinstance(b, Q.BindScalar):
        return [{b.var.name: value} if isinstance(b.var, Q.Var) else {}]
    if isinstance(b, Q.BindTuple):
        if not isinstance(value, list | tuple):
            raise DatalogError(f"Cannot bind value {pr_str(value)} to tuple {shown(b)}")
        if len(value) < len(b.parts):
            raise DatalogError(f"Not enough elements in a collection {pr_str(list(value))} to bind tuple {shown(b)}")
        rows: list[dict] = [{}]
        for p, x in zip(b.parts, value, strict=False):
            rows = [{**r, **s} for r in rows for s in flattened(p, x)]
        return rows
    items = [list(x) for x in value.items()] if isinstance(value, dict) else value
    if isinstance(items, str) or not hasattr(items, "__iter__"):
        raise DatalogError(f"Cannot bind value {pr_str(value)} to collection {shown(b)}")
    return [r for x in items for r in flattened(b.part, x)]


def local_rel(spark: SparkSession, names: list[str], rows: list[tuple]) -> Rel:
    """A relation of the driver's rows."""
    if not names:
        df = spark.range(len(rows)).select(F.lit(1).alias("__one"))
        return Rel(df, frozenset(), None)
    kinds = [spark_type([r[i] for r in rows]) or T.StringType() for i in range(len(names))]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    df = spark.createDataFrame([tuple(native(v, k) for v, k in zip(r, kinds, strict=True)) for r in rows], schema)
    nullable = frozenset(n for i, n in enumerate(names) if any(r[i] is None for r in rows))
    return Rel(df, frozenset(names), None, nullable)


def unite(parts: list[Rel], names: list[str]) -> Rel:
    """The union of relations over the same variables, distinct."""
    df = parts[0].df.select(*map(col, names))
    for p in parts[1:]:
        df = df.unionByName(p.df.select(*map(col, names)))
    union = Rel(df, frozenset(names), frozenset(names), frozenset().union(*(p.nullable for p in parts)), frozenset().union(*(p.textual for p in parts)))
    return replace(union, df=union.df.distinct())


# -- patterns


def positional(df: DataFrame, columns: list[str], terms: tuple, ctx: Context) -> tuple[DataFrame, dict[str, str]]:
    """Constants of a pattern as filters; variables by column, the last of a repeated one."""
    names: dict[str, str] = {}
    for t, c in zip(terms, columns, strict=False):
        t = ctx.known(t)
        if isinstance(t, Q.Const):
            kind = df.schema[c].dataType
            same = rank(spark_type([t.value]) or T.StringType()) == rank(kind)
            df = df.where((col(c).eqNullSafe(literal(t.value)) if t.value is None else col(c) == literal(t.value)) if same else F.lit(False))
        elif isinstance(t, Q.Var):
            names[t.name] = c
    return df, names


def frame_pattern(df: DataFrame, terms: tuple, ctx: Context) -> Rel:
    """A pattern over a DataFrame's columns by position."""
    columns = df.columns[: len(terms)]
    df, names = positional(df, columns, terms, ctx)
    nullable = frozenset(v for v, c in names.items() if df.schema[c].nullable)
    return Rel(df.select(*(col(c).alias(v) for v, c in names.items())), frozenset(names), None, nullable)


def list_pattern(rows: Any, terms: tuple, ctx: Context) -> Rel:
    """A pattern over a plain collection of tuples."""
    if isinstance(rows, dict):
        rows = [list(x) for x in rows.items()]
    known = [ctx.known(t) for t in terms]
    names = {t.name: i for i, t in enumerate(known) if isinstance(t, Q.Var)}
    kept = []
    for r in rows:
        r = tuple(r)
        if all(frozen(x) == frozen(t.value) for x, t in zip(r, known, strict=False) if isinstance(t, Q.Const)):
            kept.append(tuple(r[i] if i < len(r) else None for i in names.values()))
    rel = local_rel(ctx.spark, list(names), kept)
    return rel


def db_pattern(db: Db, terms: tuple, ctx: Context) -> Rel:
    """A pattern over a database that is no fused scan: ids by lookup, unknown attributes, transactions."""
    e, a, v, tx, *rest = [*map(ctx.known, terms), Q.Blank(), Q.Blank(), Q.Blank()][: max(4, len(terms))]
    if len(terms) > 5:
        raise DatalogError(f"Pattern is too long: {pr_str([show_term(t) for t in terms])}")
    textual: frozenset[str] = frozenset()
    eid = db.entid_strict(e.value) if isinstance(e, Q.Const) else None
    if isinstance(a, Q.Const):
        if isinstance(v, Q.Const) and v.value is not None and db.schema.ref(a.value):
            v = Q.Const(db.entid_strict(v.value))
        df = None
        if isinstance(tx, Q.Blank):
            df = db.fused([a.value], e=eid, equal={0: v.value} if isinstance(v, Q.Const) and not isinstance(v.value, list | tuple) else None)
        if df is not None:
            df = df.select("e", F.col("a0").alias("v")).where(F.col("v").isNotNull())
        else:
            df = db.attr(a.value)
        keys = frozenset({"e", "v"}) if db.schema.many(a.value) else frozenset({"e"})
    else:
        df = db.tagged()
        text = F.coalesce(F.col("v.s"), F.col("v.l").cast("string"), F.col("v.d").cast("string"), F.col("v.b").cast("string"), F.col("v.ts").cast("string"), F.col("v.j"))
        df, keys = df.select("e", "a", text.alias("v"), "tx"), frozenset({"e", "a", "v"})
        if isinstance(v, Q.Var):
            textual = frozenset({v.name})
        elif isinstance(v, Q.Const):
            v = Q.Const(str(v.value) if isinstance(v.value, str) else pr_str(v.value))
    if eid is not None:
        df = df.where(F.col("e") == eid)
    own = {"e": Q.Blank() if eid is not None else e, "a": a if not isinstance(a, Q.Const) else Q.Blank(), "v": v, "tx": tx}
    if rest and isinstance(rest[0], Q.Const | Q.Var):
        df = df.withColumn("added", F.lit(True))
        own["added"] = rest[0]
    df, names = positional(df, list(own), tuple(own.values()), ctx) if set(own) <= set(df.columns) else positional(df, [k for k in own if k in df.columns], tuple(t for k, t in own.items() if k in df.columns), ctx)
    by_column = {c: n for n, c in names.items()}
    unique = frozenset(by_column[k] for k in keys) if all(k in by_column for k in keys) else None
    if unique is None and eid is not None and "v" in by_column and isinstance(a, Q.Const):
        unique = frozenset({by_column["v"]})
    return Rel(df.select(*(col(c).alias(n) for n, c in names.items())), frozenset(names), unique, frozenset(), textual)


# -- checks on the written order


def check_bound(clauses: tuple, bound: set[str], consts: dict[str, Any]) -> set[str]:
    """Whether every clause has what it needs of the clauses before it; returns what is bound after."""
    bound = set(bound)

    def need(names: set[str], c: Any) -> None:
        if lacking := names - bound:
            raise DatalogError(f"Insufficient bindings: #{{{' '.join(sorted(lacking))}}} not bound in {text_of(c)}")

    for c in clauses:
        if isinstance(c, Q.Pattern | Stored | Q.RuleCall):
            bound |= {t.name for t in (c.terms if isinstance(c, Q.Pattern) else c.args) if isinstance(t, Q.Var)}
        elif isinstance(c, Q.Predicate):
            need(Q.clause_vars(c), c)
        elif isinstance(c, Q.Function):
            need({t.name for t in (*c.args, c.function) if isinstance(t, Q.Var)}, c)
            bound |= {v.name for v in Q.bound_vars(c.binding)}
        elif isinstance(c, Q.And):
            bound = check_bound(c.clauses, bound, consts)
        elif isinstance(c, Q.Or):
            own = {v.name for v in (*c.required, *c.free)} if c.free is not None else None
            if c.free is None:
                each = [Q.clause_vars(b) - bound for b in c.branches]
                if any(x != each[0] for x in each):
                    raise DatalogError(f"All clauses in 'or' must use same set of free vars, had {[sorted(x) for x in each]} in {c.form}")
            else:
                need({v.name for v in c.required}, c)
                for b in c.branches:
                    if lacking := {v.name for v in c.free} - Q.clause_vars(b) - bound:
                        raise DatalogError(f"All clauses in 'or' must use same set of free vars, {sorted(lacking)} not used in {c.form}")
            for b in c.branches:
                check_bound((b,), bound if own is None else bound & own, consts)
            bound |= own if own is not None else Q.clause_vars(c)
        elif isinstance(c, Q.Not):
            inner = set().union(*map(Q.clause_vars, c.clauses))
            if c.vars is not None:
                need({v.name for v in c.vars}, c)
                check_bound(c.clauses, bound & {v.name for v in c.vars} | set(consts), consts)
            else:
                if not inner & bound:
                    raise DatalogError(f"Insufficient bindings: none of #{{{' '.join(sorted(inner))}}} is bound in {c.form}")
                check_bound(c.clauses, bound, consts)
    return bound


def text_of(c: Any) -> str:
    if isinstance(c, Q.Predicate | Q.Function):
        return "[(" + " ".join([show_term(c.function), *map(show_term, c.args)]) + ")" + (f" {shown(c.binding)}" if isinstance(c, Q.Function) else "") + "]"
    return getattr(c, "form", str(c))


__all__ = ["Context", "Rel", "Keyword", "register", "uuid", "written"]

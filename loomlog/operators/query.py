"""``q``: a query and its inputs to a result, as a DataFrame or in its own shape."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomlog.edn import Keyword, Symbol, frozen
from loomlog.errors import DatalogError
from loomlog.functions import aggregates
from loomlog.functions.scalar import BUILT_INS
from loomlog.operators.compiler import Context, col, const_column, register, return_type, show_term
from loomlog.operators.pull import parse_pattern, pull, pull_frame
from loomlog.plans import query as Q
from loomlog.sources.db import Db


class Result:
    """``df`` has a column for each find element; ``value()`` is the result in the query's shape."""

    def __init__(self, df: DataFrame, query: Q.Query, consts: dict[str, Any], sources: dict[str, Any], refs: dict[str, dict] | None = None) -> None:
        self.df, self.query, self.consts, self.sources = df, query, consts, sources
        self.refs = refs or {}  # variables that were given as lookup refs: entity to ref

    def rows(self, limit: int | None = None) -> list[tuple]:
        rows = self.df.take(limit) if limit else self.df.collect()
        return [tuple(self._plain(f, x) for f, x in zip(self.query.find, r, strict=True)) for r in rows]

    def _plain(self, f: Any, x: Any) -> Any:
        if isinstance(f, Q.Var) and f.name in self.consts:
            return self.consts[f.name]
        if isinstance(f, Q.Var) and f.name in self.refs:
            return self.refs[f.name].get(x, x)
        if isinstance(f, Q.Pull):
            if not isinstance(x, Row):
                pattern = self.consts.get(f.pattern.name) if isinstance(f.pattern, Q.Var) else f.pattern.value
                return pull(self.sources[f.source], pattern, x)
            return plain(x)
        return plain(x)

    def value(self) -> Any:
        q = self.query
        if q.shape == "scalar":
            rows = self.rows(1)
            return rows[0][0] if rows else None
        if q.shape == "tuple":
            rows = self.rows(1)
            return self._mapped(rows[0]) if rows else None
        if q.shape == "collection":
            return [r[0] for r in self.rows()]
        rows = self.rows()
        if q.keys:
            return [self._mapped(r) for r in rows]
        return rows if q.with_ or any(isinstance(f, Q.Aggregate | Q.Pull) for f in q.find) else {tuple(map(frozen, r)) for r in rows}

    def _mapped(self, row: tuple) -> Any:
        if not self.query.keys:
            return list(row)
        make = {"keys": Keyword, "syms": Symbol, "strs": str}[self.query.key_kind]
        return dict(zip(map(make, self.query.keys), row, strict=True))


def plain(x: Any) -> Any:
    """A value of a row in plain Python; fields that are absent are left out."""
    if isinstance(x, Row):
        names = x.__fields__
        if names and all(n == f"_{i}" for i, n in enumerate(names)):
            return tuple(map(plain, x))
        return {n: plain(v) for n, v in zip(names, x, strict=True) if v is not None and v != []}
    if isinstance(x, list):
        return [plain(v) for v in x]
    return Keyword(x) if isinstance(x, str) and len(x) > 1 and x[0] == ":" and " " not in x else x


def q(query: Any, *inputs: Any, spark: SparkSession | None = None) -> Result:
    """Runs a query (EDN text or Python forms) over databases, DataFrames and plain collections."""
    parsed = Q.parse(query)
    if len(inputs) > len(parsed.ins):
        raise DatalogError(f"Extra inputs passed, expected: {ins_text(parsed)}, got: {len(inputs)}")
    if len(inputs) < len(parsed.ins):
        raise DatalogError(f"Too few inputs passed, expected: {ins_text(parsed)}, got: {len(inputs)}")
    found = next((i.spark for i in inputs if isinstance(i, Db) and i._spark), None) or next((i.sparkSession for i in inputs if isinstance(i, DataFrame)), None)
    ctx = Context(spark or found or SparkSession.builder.getOrCreate(), {}, {})
    refs: dict[str, dict] = {}
    for b, value in zip(parsed.ins, inputs, strict=True):
        name = b.var.name if isinstance(b, Q.BindScalar) and isinstance(b.var, Q.Source | Q.Name) else None
        if isinstance(b, Q.BindScalar) and isinstance(b.var, Q.Source):
            ctx.sources[name] = value
        elif name == "%":
            ctx.rules = Q.parse_rules(value)
        elif name:
            register(name, value) if callable(value) else ctx.consts.__setitem__(name, value)
        elif not lookups(ctx, b, value, refs):
            ctx.bind(b, value)
    given = dict(ctx.consts)
    ctx.run(parsed.where)
    return Result(finished(ctx, parsed, given), parsed, ctx.consts, ctx.sources, refs)


def ins_text(parsed: Q.Query) -> str:
    from loomlog.operators.compiler import shown

    return "[" + " ".join(map(shown, parsed.ins)) + "]"


def lookups(ctx: Context, b: Any, value: Any, refs: dict[str, dict]) -> bool:
    """Lookup refs that come as a collection are resolved here: the variable's relation has their entities, and the
    result shows the refs as they were given."""
    if not (isinstance(b, Q.BindColl) and isinstance(b.part, Q.BindScalar) and isinstance(value, list | tuple)):
        return False
    db = next((s for s in ctx.sources.values() if isinstance(s, Db)), None)
    if db is None or not value or not all(isinstance(x, list | tuple) and len(x) == 2 and isinstance(x[0], Keyword) for x in value):
        return False
    found = {db.entid_strict(list(x)): list(x) for x in value}
    if isinstance(b.part.var, Q.Var):
        refs[b.part.var.name] = found
    ctx.bind(b, list(found))
    return True


def finished(ctx: Context, parsed: Q.Query, given: dict[str, Any]) -> DataFrame:
    """Projection, set semantics, aggregation, pulls, names."""
    wanted = list(dict.fromkeys([*Q.find_vars(parsed.find), *(v.name for v in parsed.with_)]))
    rel = ctx.result(wanted)
    df = rel.df.select(*map(col, wanted))
    if rel.keys is None or not rel.keys <= set(wanted):
        df = df.distinct()
    names = [k for k in parsed.keys] if parsed.keys else [element_name(f) for f in parsed.find]
    names = [n if names.index(n) == i else f"{n}_{i}" for i, n in enumerate(names)]
    aggregated = [f for f in parsed.find if isinstance(f, Q.Aggregate)]
    if aggregated:
        keys = list(dict.fromkeys(f.name if isinstance(f, Q.Var) else f.var.name for f in parsed.find if not isinstance(f, Q.Aggregate)))
        each = [aggregate(ctx, f, df, given).alias(f"__agg{i}") for i, f in enumerate(parsed.find) if isinstance(f, Q.Aggregate)]
        if not keys:
            each.append(F.count(F.lit(1)).alias("__n"))
        df = df.groupBy(*map(col, keys)).agg(*each)
        if not keys:  # nothing in, nothing out
            df = df.where("__n > 0")
    columns: list[Column] = []
    for i, (f, n) in enumerate(zip(parsed.find, names, strict=True)):
        if isinstance(f, Q.Aggregate):
            columns.append(col(f"__agg{i}").alias(n))
        elif isinstance(f, Q.Pull):
            df, c = pulled(ctx, f, df, i)
            columns.append(c.alias(n))
        else:
            columns.append((const_column(ctx.consts[f.name]) if f.name in ctx.consts else col(f.name)).alias(n))
    if parsed.order:
        df = df.orderBy(*ordering(parsed, names))
    df = df.select(*columns)
    return df.limit(parsed.limit) if parsed.limit is not None else df


def ordering(parsed: Q.Query, names: list[str]) -> list[Column]:
    out: list[Column] = []
    for x in parsed.order:
        if isinstance(x, Keyword):
            out[-1] = {":desc": F.desc, ":asc": F.asc}[str(x)](out[-1]._loom_name)
        else:
            i = next((i for i, f in enumerate(parsed.find) if isinstance(f, Q.Aggregate) and element_name(f) == str(x).lstrip("?")), None)
            name = f"`__agg{i}`" if i is not None else f"`{x}`"
            c = F.asc(name)
            c._loom_name = name
            out.append(c)
    return out


def element_name(f: Any) -> str:
    if isinstance(f, Q.Var):
        return f.name.lstrip("?").replace("-", "_")
    if isinstance(f, Q.Pull):
        return f"pull_{f.var.name.lstrip('?')}"
    return "_".join([show_term(f.function).lstrip("?").replace("-", "_").replace("/", "_"), f.args[-1].name.lstrip("?") if isinstance(f.args[-1], Q.Var) else "x"])


def aggregate(ctx: Context, f: Q.Aggregate, df: DataFrame, given: dict[str, Any]) -> Column:
    x = col(f.args[-1].name) if isinstance(f.args[-1], Q.Var) else const_column(f.args[-1].value)
    extra = [given[t.name] if isinstance(t, Q.Var) else t.value for t in f.args[:-1]]
    function = given.get(f.function.name) if isinstance(f.function, Q.Var) else f.function.name
    if callable(function) or isinstance(function, str) and function not in aggregates.PLAIN:
        own = function if callable(function) else ctx.callable_of(Q.Name(function))
        if not callable(own):
            raise DatalogError(f"Unknown aggregate '{function}'")
        if hasattr(own, "returnType"):  # a Spark aggregate already
            return own(x)
        return F.udf(own, return_type(own))(F.collect_list(x))
    if extra:
        if function not in aggregates.WITH_NUMBER:
            raise DatalogError(f"Aggregate '{function}' takes no number")
        return aggregates.WITH_NUMBER[function](extra[0], x)
    return aggregates.PLAIN[function](x)


def pulled(ctx: Context, f: Q.Pull, df: DataFrame, i: int) -> tuple[DataFrame, Column]:
    """The pull of a find element as a column; recursions without a limit, and functions, stay ids and are pulled by
    the driver."""
    pattern = ctx.consts.get(f.pattern.name) if isinstance(f.pattern, Q.Var) else f.pattern.value
    db = ctx.sources[f.source]
    e = f.var.name
    parsed = parse_pattern(pattern)
    if by_driver(parsed):
        return df, col(e)
    own = pull_frame(db, parsed).select(F.col("e").alias(f"__e{i}"), F.col("pulled").alias(f"__pull{i}"))
    return df.join(own, col(e) == F.col(f"__e{i}"), "left").drop(f"__e{i}"), F.col(f"__pull{i}")


def by_driver(p: Any) -> bool:
    return any(a.depth == -1 or a.xform or a.sub and by_driver(a.sub) for a in p.attrs)


__all__ = ["BUILT_INS", "Result", "q"]

"""Rules: those that don't recur are expanded in place, the others are computed from below, step by step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.errors import DatalogError
from loomlog.operators.compiler import Stored, col, fresh
from loomlog.plans import query as Q
from loomlog.sources.shared import written

if TYPE_CHECKING:
    from loomlog.operators.compiler import Context


def calls(clauses: Any) -> set[str]:
    out: set[str] = set()
    for c in clauses:
        if isinstance(c, Q.RuleCall):
            out.add(c.name)
        elif isinstance(c, Q.Not | Q.And):
            out |= calls(c.clauses)
        elif isinstance(c, Q.Or):
            out |= calls(c.branches)
    return out


def reachable(rules: dict[str, Q.Rule], name: str) -> set[str]:
    """Rules that a rule calls, directly or not."""
    seen: set[str] = set()
    left = [name]
    while left:
        rule = rules.get(left.pop())
        for x in calls(c for _, body in rule.branches for c in body) if rule else ():
            if x not in seen:
                seen.add(x)
                left.append(x)
    return seen


def recursive(rules: dict[str, Q.Rule], name: str) -> bool:
    return name in reachable(rules, name)


def renamed(c: Any, to: Callable[[str], Any], source: str) -> Any:
    """A clause with its variables replaced by terms and the default source by ``source``."""
    t = lambda x: to(x.name) if isinstance(x, Q.Var) else Q.Source(source) if x == Q.Source("$") else x
    src = lambda s: source if s == "$" else s
    if isinstance(c, Q.Pattern):
        return Q.Pattern(src(c.source), tuple(map(t, c.terms)))
    if isinstance(c, Stored):
        return Stored(c.rel, tuple(map(t, c.args)))
    if isinstance(c, Q.Predicate):
        return Q.Predicate(src(c.source), t(c.function), tuple(map(t, c.args)))
    if isinstance(c, Q.Function):
        return Q.Function(src(c.source), t(c.function), tuple(map(t, c.args)), rebound(c.binding, to))
    if isinstance(c, Q.RuleCall):
        return Q.RuleCall(src(c.source), c.name, tuple(map(t, c.args)))
    if isinstance(c, Q.Not):
        own = None if c.vars is None else tuple(v for v in map(t, c.vars) if isinstance(v, Q.Var))
        return replace(c, source=src(c.source), vars=own, clauses=tuple(renamed(x, to, source) for x in c.clauses))
    if isinstance(c, Q.Or):
        only = lambda vs: tuple(v for v in map(t, vs) if isinstance(v, Q.Var))
        return replace(c, source=src(c.source), required=only(c.required), free=None if c.free is None else only(c.free), branches=tuple(renamed(x, to, source) for x in c.branches))
    return Q.And(tuple(renamed(x, to, source) for x in c.clauses))


def rebound(b: Any, to: Callable[[str], Any]) -> Any:
    if isinstance(b, Q.BindScalar):
        return Q.BindScalar(to(b.var.name)) if isinstance(b.var, Q.Var) else b
    if isinstance(b, Q.BindColl):
        return Q.BindColl(rebound(b.part, to))
    return Q.BindTuple(tuple(rebound(p, to) for p in b.parts))


def instance(head: tuple, body: tuple, args: tuple, source: str) -> tuple:
    """A branch's clauses with the call's arguments; its own variables are fresh."""
    known = {v.name: Q.Var(f"?__{next(fresh)}") if isinstance(a, Q.Blank) else a for v, a in zip(head, args, strict=True)}

    def to(name: str) -> Any:
        if name not in known:
            known[name] = Q.Var(f"{name}__{next(fresh)}")
        return known[name]

    return tuple(renamed(c, to, source) for c in body)


def inlined(ctx: Context, rule: Q.Rule, call: Q.RuleCall) -> Any:
    """A call as an ``or-join`` of its branches."""
    args = tuple(Q.Var(f"?__{next(fresh)}") if isinstance(a, Q.Blank) else a for a in call.args)
    free = tuple(a for a in args if isinstance(a, Q.Var) and not callable(ctx.consts.get(a.name)))
    branches = tuple(Q.And(instance(head, body, args, call.source)) for head, body in rule.branches)
    form = f"({call.name})"
    if len(branches) == 1:
        return branches[0]
    return Q.Or(call.source, (), tuple(dict.fromkeys(free)), branches, form)


def transitive(rule: Q.Rule) -> tuple | None:
    """The base clauses, if the rule is a plain closure of them: ``(r a b) base(a, b)``, ``(r a b) base(a, c) (r c b)``
    or its mirror."""
    if len(rule.vars) != 2 or len(rule.branches) != 2 or rule.required:
        return None
    for (h1, base), (h2, step) in (rule.branches, rule.branches[::-1]):
        own = [c for c in step if isinstance(c, Q.RuleCall)]
        if calls(base) or len(own) != 1 or own[0].name != rule.name or any(calls([c]) for c in step if c is not own[0]):
            continue
        rest = tuple(c for c in step if c is not own[0])
        a, b = h2
        x, y = own[0].args
        if not (isinstance(x, Q.Var) and isinstance(y, Q.Var)):
            continue
        if y == b and x not in (a, b):
            back = {x.name: h1[1], a.name: h1[0]}
        elif x == a and y not in (a, b):
            back = {y.name: h1[0], b.name: h1[1]}
        else:
            continue
        if tuple(renamed(c, lambda n, back=back: back.get(n, Q.Var(n)), "$") for c in rest) == base:
            return h1, base
    return None


def solved(ctx: Context, head: tuple, body: tuple, source: str) -> DataFrame:
    """A branch's relation over its head, columns by place."""
    args = tuple(Q.Var(f"?__{next(fresh)}") for _ in head)
    clauses = instance(head, body, args, source)
    sub = ctx.sub()
    sub.run(clauses)
    out = sub.result([a.name for a in args])
    return out.df.select(*(col(a.name).alias(f"_{i}") for i, a in enumerate(args)))


def fixpoint(ctx: Context, name: str, source: str) -> DataFrame:
    """The whole relation of a recursive rule: each round joins only what the last one found."""
    group = tuple(sorted(n for n in {name} | reachable(ctx.rules, name) if name in reachable(ctx.rules, n) or n == name))
    if found := ctx.fixpoints.get((source, *group)):
        return found[name]
    if len(group) == 1 and (closed := transitive(ctx.rules[name])):
        totals = {name: doubled(solved(ctx, *closed, source))}
    else:
        totals = stepwise(ctx, group, source)
    ctx.fixpoints[(source, *group)] = totals
    return totals[name]


def doubled(edges: DataFrame) -> DataFrame:
    """A transitive closure by joining paths with paths: as many rounds as the logarithm of the longest path."""
    total = written(edges.distinct(), "paths")
    n = total.count()
    while True:
        a, b = total.select(F.col("_0").alias("x"), F.col("_1").alias("m")), total.select(F.col("_0").alias("m2"), F.col("_1").alias("y"))
        longer = a.join(b, F.col("m") == F.col("m2")).select(F.col("x").alias("_0"), F.col("y").alias("_1"))
        total = written(total.unionByName(longer).distinct(), "paths")
        if (new := total.count()) == n:
            return total
        n = new


def stepwise(ctx: Context, group: tuple, source: str) -> dict[str, DataFrame]:
    plain = {n: [(h, b) for h, b in ctx.rules[n].branches if not calls(b) & set(group)] for n in group}
    again = {n: [(h, b) for h, b in ctx.rules[n].branches if calls(b) & set(group)] for n in group}
    deltas: dict[str, DataFrame | None] = {}
    for n in group:
        parts = [solved(ctx, h, b, source) for h, b in plain[n]]
        deltas[n] = written(union(parts).distinct(), "rule") if parts else None
    if all(d is None for d in deltas.values()):
        raise DatalogError(f"Rule '{group[0]}' has no branch that ends")
    totals = dict(deltas)
    while True:
        new: dict[str, DataFrame | None] = {}
        for n in group:
            parts = []
            for head, body in again[n]:
                places = [i for i, c in enumerate(body) if isinstance(c, Q.RuleCall) and c.name in group]
                for at in places:  # one call sees what is new, those before it everything, so nothing is found twice
                    frames = [deltas[body[i].name] if i == at else totals[body[i].name] for i in places]
                    if any(f is None for f in frames):
                        continue
                    own = dict(zip(places, frames, strict=True))
                    parts.append(solved(ctx, head, tuple(Stored(own[i], c.args) if i in own else c for i, c in enumerate(body)), source))
            if not parts:
                new[n] = None
                continue
            df = union(parts).distinct()
            if totals[n] is not None:
                df = df.subtract(totals[n])
            df = written(df, "rule")
            new[n] = None if df.isEmpty() else df
        if all(d is None for d in new.values()):
            break
        for n in group:
            if new[n] is not None:
                totals[n] = new[n] if totals[n] is None else totals[n].unionByName(new[n])
        deltas = new
    schema = next(t for t in totals.values() if t is not None)
    return {n: t if t is not None else schema.limit(0) for n, t in totals.items()}


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Queries as data: parsing of text or Python forms into a checked tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from loomlog.edn import Keyword, Seq, Symbol, frozen, pr_str, read_string
from loomlog.errors import DatalogError


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Blank:
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Source:
    name: str


@dataclass(frozen=True)
class Name:
    """A plain symbol: a function, predicate or rule."""

    name: str


# -- bindings


@dataclass(frozen=True)
class BindScalar:
    var: Var | Source | Name | Blank


@dataclass(frozen=True)
class BindTuple:
    parts: tuple


@dataclass(frozen=True)
class BindColl:
    part: Any


# -- clauses


@dataclass(frozen=True)
class Pattern:
    source: str
    terms: tuple


@dataclass(frozen=True)
class Predicate:
    source: str
    function: Any
    args: tuple


@dataclass(frozen=True)
class Function:
    source: str
    function: Any
    args: tuple
    binding: Any


@dataclass(frozen=True)
class RuleCall:
    source: str
    name: str
    args: tuple


@dataclass(frozen=True)
class Not:
    source: str
    vars: tuple | None
    clauses: tuple
    form: str


@dataclass(frozen=True)
class Or:
    source: str
    required: tuple
    free: tuple | None  # None: or
    branches: tuple
    form: str


@dataclass(frozen=True)
class And:
    clauses: tuple


# -- find


@dataclass(frozen=True)
class Aggregate:
    function: Any
    args: tuple


@dataclass(frozen=True)
class Pull:
    source: str
    var: Var
    pattern: Any


@dataclass
class Query:
    find: tuple = ()
    shape: str = "relation"
    with_: tuple = ()
    keys: tuple | None = None
    key_kind: str | None = None
    ins: tuple = ()
    where: tuple = ()
    order: tuple = ()
    limit: int | None = None


@dataclass
class Rule:
    name: str
    required: tuple
    vars: tuple
    branches: list = field(default_factory=list)


PLACEHOLDER = Symbol("_")
SECTIONS = ("find", "with", "keys", "syms", "strs", "in", "where", "order-by", "limit")


def is_var(x: Any) -> bool:
    return isinstance(x, Symbol) and x.startswith("?")


def is_source(x: Any) -> bool:
    return isinstance(x, Symbol) and x.startswith("$")


def term(x: Any) -> Any:
    if isinstance(x, Symbol):
        if x == PLACEHOLDER:
            return Blank()
        if is_var(x):
            return Var(str(x))
        return Source(str(x)) if is_source(x) else Name(str(x))
    return Const(x)


def as_map(form: Any) -> dict[str, list]:
    """A query's sections, from a vector or a map."""
    if isinstance(form, dict):
        return {str(k).lstrip(":"): list(v) if isinstance(v, list | tuple) else [v] for k, v in form.items()}
    if not isinstance(form, list | tuple):
        raise DatalogError(f"Query should be a vector or a map: {pr_str(form)}")
    out: dict[str, list] = {}
    own: list | None = None
    for x in form:
        if isinstance(x, Keyword) and x[1:] in SECTIONS:
            own = out.setdefault(x[1:], [])
        elif own is None:
            raise DatalogError(f"Query should begin with a section: {pr_str(x)}")
        else:
            own.append(x)
    return out


def binding(x: Any) -> Any:
    if isinstance(x, list | tuple):
        if len(x) == 2 and x[1] == Symbol("..."):
            return BindColl(binding(x[0]))
        if len(x) == 1 and isinstance(x[0], list | tuple):
            return BindColl(binding(x[0]))
        if not x:
            raise DatalogError("Tuple binding cannot be empty")
        return BindTuple(tuple(map(binding, x)))
    if isinstance(x, Symbol):
        t = term(x)
        return BindScalar(t)
    raise DatalogError(f"Cannot parse binding, expected (bind-scalar | bind-tuple | bind-coll | bind-rel): {pr_str(x)}")


def bound_vars(b: Any) -> list[Var]:
    if isinstance(b, BindScalar):
        return [b.var] if isinstance(b.var, Var) else []
    if isinstance(b, BindColl):
        return bound_vars(b.part)
    return [v for p in b.parts for v in bound_vars(p)]


def _head(form: Any) -> tuple[str | None, tuple]:
    """A clause's own source, and the rest."""
    if form and is_source(form[0]):
        return str(form[0]), tuple(form[1:])
    return None, tuple(form)


def _vars(form: Any, what: Any) -> tuple[tuple, tuple]:
    """Required and free variables of ``[[?r ...] ?v ...]``."""
    if not isinstance(form, list | tuple):
        raise DatalogError(f"Cannot parse rule-vars, expected [ variable+ | ([ variable+ ] variable*) ]: {pr_str(form)}")
    required, free = (tuple(form[0]), tuple(form[1:])) if form and isinstance(form[0], list | tuple) else ((), tuple(form))
    every = required + free
    if not every or not all(is_var(v) for v in every):
        raise DatalogError(f"Cannot parse rule-vars, expected [ variable+ | ([ variable+ ] variable*) ]: {pr_str(form)}")
    if len(set(every)) != len(every):
        raise DatalogError(f"Rule variables should be distinct: {pr_str(what)}")
    return tuple(Var(str(v)) for v in required), tuple(Var(str(v)) for v in free)


def clause(form: Any, source: str = "$") -> Any:
    if not isinstance(form, list | tuple) or not form:
        raise DatalogError(f"Cannot parse clause, expected (data-pattern | pred-expr | fn-expr | rule-expr | not-clause | not-join-clause | or-clause | or-join-clause): {pr_str(form)}")
    own, rest = _head(form)
    src = own or source
    op = rest[0] if rest else None
    text = pr_str(form)
    call = isinstance(form, Seq) or isinstance(form, tuple)
    if isinstance(op, Symbol) and (call or op in (Symbol("not"), Symbol("or"), Symbol("and"), Symbol("not-join"), Symbol("or-join"))):
        if op == Symbol("not"):
            if len(rest) < 2:
                raise DatalogError(f"Cannot parse 'not' clause, expected [ src-var? 'not' clause+ ]: {text}")
            return Not(src, None, tuple(clause(c, src) for c in rest[1:]), text)
        if op == Symbol("not-join"):
            if len(rest) < 3:
                raise DatalogError(f"Cannot parse 'not-join' clause, expected [ src-var? 'not-join' [variable+] clause+ ]: {text}")
            _, free = _vars(rest[1], form)
            return Not(src, free, tuple(clause(c, src) for c in rest[2:]), text)
        if op in (Symbol("or"), Symbol("or-join")):
            joined = op == Symbol("or-join")
            if len(rest) < (3 if joined else 2):
                raise DatalogError(f"Cannot parse '{op}' clause: {text}")
            required, free = _vars(rest[1], form) if joined else ((), None)
            return Or(src, required, free, tuple(clause(c, src) for c in rest[2 if joined else 1 :]), text)
        if op == Symbol("and"):
            return And(tuple(clause(c, src) for c in rest[1:]))
        if not isinstance(form, list):
            return RuleCall(src, str(op), tuple(map(term, rest[1:])))
    if own is None and isinstance(form[0], Seq) or own is None and isinstance(form[0], tuple) and form[0] and isinstance(form[0][0], Symbol):
        inner = tuple(form[0])
        if not inner:
            raise DatalogError(f"Cannot parse predicate clause: {text}")
        args = tuple(map(term, inner[1:]))
        if len(form) == 1:
            return Predicate(src, term(inner[0]), args)
        return Function(src, term(inner[0]), args, binding(form[1]))
    if not rest:
        raise DatalogError(f"Pattern could not be empty: {text}")
    return Pattern(src, tuple(map(term, rest)))


def clause_vars(c: Any) -> set[str]:
    """Variables that a clause shares with what is around it."""
    if isinstance(c, Pattern):
        return {t.name for t in c.terms if isinstance(t, Var)}
    if isinstance(c, Predicate):
        return {t.name for t in (*c.args, c.function) if isinstance(t, Var)}
    if isinstance(c, Function):
        return {t.name for t in (*c.args, c.function) if isinstance(t, Var)} | {v.name for v in bound_vars(c.binding)}
    if isinstance(c, RuleCall):
        return {t.name for t in c.args if isinstance(t, Var)}
    if isinstance(c, Not):
        return {v.name for v in c.vars} if c.vars is not None else set().union(*map(clause_vars, c.clauses))
    if isinstance(c, Or):
        return {v.name for v in (*c.required, *c.free)} if c.free is not None else set().union(*map(clause_vars, c.branches))
    return set().union(*map(clause_vars, c.clauses))


def find_element(x: Any) -> Any:
    if is_var(x):
        return Var(str(x))
    if isinstance(x, Seq | tuple | list) and x and isinstance(x[0], Symbol):
        if x[0] == Symbol("pull"):
            own = str(x[1]) if len(x) == 4 else "$"
            pattern = x[-1]
            return Pull(own, Var(str(x[-2])), term(pattern) if isinstance(pattern, Symbol) else Const(pattern))
        if x[0] == Symbol("aggregate"):
            return Aggregate(term(x[1]), tuple(map(term, x[2:])))
        return Aggregate(Name(str(x[0])), tuple(map(term, x[1:])))
    raise DatalogError("Cannot parse :find, expected (find-rel | find-coll | find-tuple | find-scalar)")


def find_spec(form: list) -> tuple[tuple, str]:
    if len(form) == 2 and form[1] == Symbol("."):
        return (find_element(form[0]),), "scalar"
    if len(form) == 1 and isinstance(form[0], list):
        own = form[0]
        if len(own) == 2 and own[1] == Symbol("..."):
            return (find_element(own[0]),), "collection"
        return tuple(map(find_element, own)), "tuple"
    if not form:
        raise DatalogError("Cannot parse :find, expected (find-rel | find-coll | find-tuple | find-scalar)")
    return tuple(map(find_element, form)), "relation"


def find_vars(find: tuple) -> list[str]:
    out = []
    for f in find:
        own = [f.name] if isinstance(f, Var) else [f.var.name] if isinstance(f, Pull) else [t.name for t in f.args if isinstance(t, Var)][-1:]
        out += own
    return out


def has_source(clauses: Any) -> set[str]:
    out: set[str] = set()
    for c in clauses:
        if isinstance(c, Pattern):
            out.add(c.source)
        elif isinstance(c, Predicate | Function):
            out |= {t.name for t in c.args if isinstance(t, Source)}
        elif isinstance(c, RuleCall):
            out |= {c.source} - {"$"}
        elif isinstance(c, Not | And):
            out |= has_source(c.clauses)
        elif isinstance(c, Or):
            out |= has_source(c.branches)
    return out


def uses_rules(clauses: Any) -> bool:
    return any(isinstance(c, RuleCall) or isinstance(c, Not | And) and uses_rules(c.clauses) or isinstance(c, Or) and uses_rules(c.branches) for c in clauses)


def parse(form: Any) -> Query:
    """A query from EDN text or forms."""
    if isinstance(form, str):
        return _parse_text(form)
    return _parse(form)


@lru_cache(100)
def _parse_text(text: str) -> Query:
    return _parse(read_string(text))


def _parse(form: Any) -> Query:
    sections = as_map(form)
    find, shape = find_spec(sections.get("find", []))
    where = tuple(clause(c) for c in sections.get("where", []))
    if "in" in sections:
        ins = tuple(binding(x) for x in sections["in"])
    else:
        ins = (BindScalar(Source("$")),) if has_source(where) else ()
    q = Query(find, shape, tuple(Var(str(v)) for v in sections.get("with", [])), ins=ins, where=where, order=tuple(sections.get("order-by", [])), limit=next(iter(sections.get("limit", [])), None))
    kinds = [k for k in ("keys", "syms", "strs") if k in sections]
    if kinds:
        if len(kinds) > 1:
            raise DatalogError("Only one of :keys/:syms/:strs must be present")
        if shape in ("scalar", "collection"):
            raise DatalogError(f":{kinds[0]} does not work with {'single-scalar' if shape == 'scalar' else 'collection'} :find")
        q.key_kind, q.keys = kinds[0], tuple(map(str, sections[kinds[0]]))
        if len(q.keys) != len(find):
            raise DatalogError(f"Count of :{kinds[0]} must match count of :find")
    _check(q, form)
    return q


def _check(q: Query, form: Any) -> None:
    wanted, with_ = find_vars(q.find), [v.name for v in q.with_]
    ins = [v.name for b in q.ins for v in bound_vars(b)]
    sources = [b.var.name for b in q.ins if isinstance(b, BindScalar) and isinstance(b.var, Source)]
    names = [b.var.name for b in q.ins if isinstance(b, BindScalar) and isinstance(b.var, Name)]
    known = set(ins) | set().union(*map(clause_vars, q.where)) if q.where else set(ins)
    show = lambda names: "[" + " ".join(sorted(names)) + "]"
    if shared := set(wanted) & set(with_):
        raise DatalogError(f":find and :with should not use same variables: {show(shared)}")
    if unknown := (set(wanted) | set(with_)) - known:
        raise DatalogError(f"Query for unknown vars: {show(unknown)}")
    for group in (ins, sources, names):
        if len(set(group)) != len(group):
            raise DatalogError("Vars used in :in should be distinct")
    if len(set(with_)) != len(with_):
        raise DatalogError("Vars used in :with should be distinct")
    if unknown := (has_source(q.where) | {f.source for f in q.find if isinstance(f, Pull)}) - set(sources):
        raise DatalogError(f"Where uses unknown source vars: {show(unknown)}")
    if uses_rules(q.where) and "%" not in names:
        raise DatalogError("Missing rules var '%' in :in")


def parse_rules(form: Any) -> dict[str, Rule]:
    """Rules from text or forms, by name."""
    form = read_string(form) if isinstance(form, str) else form
    out: dict[str, Rule] = {}
    for branch in form:
        if not isinstance(branch, list | tuple) or len(branch) < 2:
            raise DatalogError(f"Rule branch should have clauses: {pr_str(branch)}")
        head = branch[0]
        name = str(head[0])
        required, free = _vars(list(head[1:]), branch)
        rule = out.setdefault(name, Rule(name, required, required + free))
        if len(rule.vars) != len(required + free):
            raise DatalogError(f"Arity mismatch for rule '{name}': {len(rule.vars)} vs. {len(required + free)}")
        rule.branches.append((required + free, tuple(clause(c) for c in branch[1:])))
    return out


__all__ = ["Query", "parse", "parse_rules", "frozen"]

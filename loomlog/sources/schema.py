"""Attribute properties: what a schema may say, and what follows from it."""

from __future__ import annotations

from typing import Any

from loomlog.edn import Keyword, pr_str
from loomlog.errors import DatalogError

K = Keyword
IDENT = K(":db/ident")


class Schema:
    """A partial, per-attribute schema; attributes that it doesn't mention hold one value of any type."""

    def __init__(self, spec: dict[Any, dict] | None = None) -> None:
        self.spec = {a: {Keyword(k) if not isinstance(k, Keyword) else k: _kw(v) for k, v in (p or {}).items()} for a, p in (spec or {}).items()}
        self.tuples: dict[Any, list] = {}  # source attribute -> composite attributes
        for a, p in self.spec.items():
            for s in p.get(K(":db/tupleAttrs"), ()):
                self.tuples.setdefault(s, []).append(a)
        self._validate()

    def _validate(self) -> None:
        for a, p in self.spec.items():
            self._one_of(a, K(":db/unique"), p, (K(":db.unique/value"), K(":db.unique/identity")))
            self._one_of(a, K(":db/valueType"), p, (K(":db.type/ref"), K(":db.type/tuple")))
            self._one_of(a, K(":db/cardinality"), p, (K(":db.cardinality/one"), K(":db.cardinality/many")))
            if p.get(K(":db/isComponent")) and not self.ref(a):
                raise DatalogError(f"Bad attribute specification for {pr_str(a)}: {{:db/isComponent true}} should also have {{:db/valueType :db.type/ref}}")
            if K(":db/isComponent") in p and not isinstance(p[K(":db/isComponent")], bool):
                raise DatalogError(f"Bad attribute specification for {pr_str({a: {K(':db/isComponent'): p[K(':db/isComponent')]}})}, expected one of #{{true false}}")
            if K(":db/tupleAttrs") in p:
                attrs = p[K(":db/tupleAttrs")]
                if self.many(a):
                    raise DatalogError(f"{pr_str(a)} has :db/tupleAttrs, must be :db.cardinality/one")
                if not isinstance(attrs, list | tuple) or not attrs:
                    raise DatalogError(f"{pr_str(a)} :db/tupleAttrs must be a sequential collection, got: {pr_str(attrs)}" if not isinstance(attrs, list | tuple) else f"{pr_str(a)} :db/tupleAttrs can’t be empty")
                for s in attrs:
                    if K(":db/tupleAttrs") in self.spec.get(s, {}):
                        raise DatalogError(f"{pr_str(a)} :db/tupleAttrs can’t depend on another tuple attribute: {pr_str(s)}")
                    if self.many(s):
                        raise DatalogError(f"{pr_str(a)} :db/tupleAttrs can’t depend on :db.cardinality/many attribute: {pr_str(s)}")

    @staticmethod
    def _one_of(a: Any, key: Keyword, p: dict, allowed: tuple) -> None:
        if key in p and p[key] not in allowed:
            raise DatalogError(f"Bad attribute specification for {pr_str({a: {key: p[key]}})}, expected one of #{{{' '.join(map(pr_str, allowed))}}}")

    def _is(self, a: Any, key: str, value: Any) -> bool:
        return self.spec.get(a, {}).get(K(key)) == value

    def many(self, a: Any) -> bool:
        return self._is(a, ":db/cardinality", K(":db.cardinality/many"))

    def ref(self, a: Any) -> bool:
        return self._is(a, ":db/valueType", K(":db.type/ref"))

    def component(self, a: Any) -> bool:
        return self._is(a, ":db/isComponent", True)

    def identity(self, a: Any) -> bool:
        return a == IDENT or self._is(a, ":db/unique", K(":db.unique/identity"))

    def unique(self, a: Any) -> bool:
        return self.identity(a) or self._is(a, ":db/unique", K(":db.unique/value"))

    def tuple_attrs(self, a: Any) -> list | None:
        found = self.spec.get(a, {}).get(K(":db/tupleAttrs"))
        return list(found) if found else None

    def tuple_types(self, a: Any) -> list | None:
        found = self.spec.get(a, {}).get(K(":db/tupleTypes"))
        return list(found) if found else None

    def tuple_(self, a: Any) -> bool:
        p = self.spec.get(a, {})
        return any(K(k) in p for k in (":db/tupleAttrs", ":db/tupleTypes", ":db/tupleType")) or self._is(a, ":db/valueType", K(":db.type/tuple"))

    def indexed(self, a: Any) -> bool:
        return self._is(a, ":db/index", True) or self.unique(a) or self.ref(a) or bool(self.tuple_attrs(a))

    def merged(self, more: dict) -> Schema:
        return Schema({**self.spec, **more})

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self.spec == other.spec

    def __hash__(self) -> int:
        return hash(pr_str(self.spec))


def _kw(value: Any) -> Any:
    if isinstance(value, str) and not isinstance(value, Keyword) and value.startswith(":"):
        return Keyword(value)
    if isinstance(value, list | tuple):
        return [_kw(v) for v in value]
    return value


def reverse(a: Any) -> Any | None:
    """``:ns/_x`` to ``:ns/x``; None where the attribute is not a reverse one."""
    kind = Keyword if isinstance(a, Keyword) else str
    ns, _, name = str(a).lstrip(":").rpartition("/")
    if not name.startswith("_"):
        return None
    return kind(f"{':' if kind is Keyword else ''}{ns + '/' if ns else ''}{name[1:]}")

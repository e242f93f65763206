"""Transactions: small ones are interpreted item by item over the entities they touch, large ones are set-oriented.

``with_`` takes a list of items (vectors, maps, datoms) in order, each seeing what those before it did; only touched
entities are looked up, by key. ``bulk`` takes a DataFrame of facts that apply together: upserts, new ids, replaced
values and uniqueness are joins and aggregations, and the change feed is a DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.edn import Keyword, Symbol, frozen, pr_str, read_string
from loomlog.errors import DatalogError
from loomlog.sources.db import TX0, Datom, Db, Entity
from loomlog.sources.schema import reverse
from loomlog.sources.shared import written

K = Keyword
ID = K(":db/id")
CURRENT = (K(":db/current-tx"), ":db/current-tx", "datomic.tx")


@dataclass
class TxReport:
    db_before: Db
    db_after: Db
    tx_data: list[Datom] = field(default_factory=list)
    tempids: dict[Any, int] = field(default_factory=dict)
    tx_meta: Any = None


class _Retry(Exception):
    def __init__(self, tempid: Any, eid: int) -> None:
        self.tempid, self.eid = tempid, eid


def is_tempid(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x < 0 or isinstance(x, str) and not isinstance(x, Keyword) and x not in CURRENT


class _Auto(str):
    """A tempid that the caller didn't write."""


class Transaction:
    """One run over a database; the database itself is not changed."""

    def __init__(self, db: Db, items: Iterable, known: dict[Any, int]) -> None:
        self.before, self.db = db, db
        self.schema, self.tx = db.schema, db.max_tx + 1
        self.facts, self.gone = dict(db.facts), dict(db.gone)
        self.touched: set[int] = set()
        self.max_eid = db.max_eid
        self.tempids: dict[Any, int] = dict(known)
        self.known = known
        self.used: set = set()
        self.valued: set = set()
        self.out: list[Datom] = []
        self.autos = 0
        self.queue: dict[int, dict[Any, set]] = {}
        self.items = list(items)

    # -- state

    def now(self) -> Db:
        return self.before.with_facts(self.facts, self.gone, max_eid=self.max_eid)

    def values(self, e: int, a: Any) -> dict[Any, Any]:
        """Current values of an attribute, by frozen form."""
        own = {k: v for k, (v, _) in self.facts.get(e, {}).get(a, {}).items()}
        if self.before.home(a):
            for v, _ in self.now().facts_of(e).get(a, ()):
                own.setdefault(frozen(v), v)
        return own

    def having(self, a: Any, v: Any) -> list[int]:
        return self.now().having(a, v)

    def put(self, e: int, a: Any, v: Any, added: bool) -> None:
        if added and self.schema.unique(a):
            taken = [x for x in self.having(a, v) if x != e]
            if taken:
                raise DatalogError(f"Cannot add {pr_str_datom(e, a, v, self.tx)} because of unique constraint: ({pr_str_datom(taken[0], a, v, self.tx)})")
        if e not in self.touched:
            self.facts[e] = {x: dict(own) for x, own in self.facts.get(e, {}).items()}
            self.touched.add(e)
        own = self.facts.setdefault(e, {}).setdefault(a, {})
        k = frozen(v)
        if added:
            own[k] = (v, self.tx)
            if (e, k) in self.gone.get(a, ()) and self.before.home(a):
                self.gone[a] = self.gone[a] - {(e, k)}
                own.pop(k)
        elif k in own:
            del own[k]
        elif self.before.home(a):
            self.gone[a] = self.gone.get(a, frozenset()) | {(e, k)}
        if not own:
            self.facts[e].pop(a, None)
        if not self.facts[e]:
            self.facts.pop(e)
        self.out.append(Datom(e, a, v, self.tx, added))
        for composite in self.schema.tuples.get(a, ()):
            self.queue.setdefault(e, {}).setdefault(composite, set())

    # -- ids

    def eid(self, ref: Any) -> int:
        if isinstance(ref, str) and ref in CURRENT:
            return self.tx
        if is_tempid(ref):
            return self.allocated(ref)
        if isinstance(ref, int) and not isinstance(ref, bool):
            if ref < TX0 or ref >= 1 << 40:
                self.max_eid = max(self.max_eid, ref)
            return ref
        return self.now().entid_strict(ref)

    def allocated(self, tempid: Any) -> int:
        if tempid not in self.tempids:
            self.max_eid += 1
            self.tempids[tempid] = self.max_eid
        self.used.add(tempid)
        return self.tempids[tempid]

    def value(self, a: Any, v: Any) -> Any:
        """A value with references resolved."""
        if isinstance(v, Entity):
            return v.eid
        if self.schema.ref(a):
            if is_tempid(v):
                found = self.allocated(v)
                self.valued.add(v)
                return found
            return self.eid(v)
        types = self.schema.tuple_types(a)
        if self.schema.tuple_(a) and isinstance(v, list | tuple):
            if types:
                if len(types) != len(v):
                    raise DatalogError(f"Bad tuple value {pr_str(list(v))} for {pr_str(a)}: expected {len(types)} elements, got {len(v)}")
                return [self.eid(x) if t == K(":db.type/ref") and x is not None else x for t, x in zip(types, v, strict=True)]
            return list(v)
        return v

    # -- items

    def run(self) -> None:
        for item in self.items:
            self.item(item)
        self.flush()
        unused = [t for t in self.valued if t not in self.used_as_entity()]
        if unused:
            raise DatalogError(f"Tempids used only as value in transaction: ({' '.join(map(pr_str, sorted(unused, key=str)))})")

    def used_as_entity(self) -> set:
        own = {d.e for d in self.out}
        return {t for t, e in self.tempids.items() if e in own or self.before.facts_of(e)}

    def item(self, item: Any) -> None:
        if item is None:
            return
        if isinstance(item, Datom):
            self.put(item.e, item.a, item.v, item.added) if item.added or frozen(item.v) in self.values(item.e, item.a) else None
            return
        if isinstance(item, dict):
            self.entity(item)
            return
        if not isinstance(item, list | tuple) or not item:
            raise DatalogError(f"Bad entity type at {pr_str(item)}, expected map or vector")
        op, *args = item
        name = str(op).lstrip(":") if isinstance(op, str) else op
        if callable(op):
            for x in op(self.now(), *args) or ():
                self.item(x)
        elif name == "db.fn/call":
            for x in args[0](self.now(), *args[1:]) or ():
                self.item(x)
        elif name == "db/add":
            self.add(*args)
        elif name in ("db/retract", "db.fn/retractAttribute"):
            self.retract(*args)
        elif name in ("db/retractEntity", "db.fn/retractEntity"):
            self.retract_entity(args[0])
        elif name in ("db/cas", "db.fn/cas"):
            self.cas(*args)
        else:
            ident = self.now().entid(op) if isinstance(op, Keyword) else None
            function = next(iter(self.values(ident, K(":db/fn")).values()), None) if ident is not None else None
            if ident is None:
                raise DatalogError(f"Can’t find entity for transaction fn {pr_str(op)}")
            if not callable(function):
                raise DatalogError(f"Entity {pr_str(op)} expected to have :db/fn attribute with fn? value")
            for x in function(self.now(), *args) or ():
                self.item(x)

    def checked(self, e: Any, a: Any, v: Any, at: Any) -> None:
        if a is None or not isinstance(a, str):
            raise DatalogError(f"Bad entity attribute {pr_str(a)} at {pr_str(at)}, expected keyword or string")
        if v is None:
            raise DatalogError(f"Cannot store nil as a value at {pr_str(at)}")
        if e is None:
            raise DatalogError(f"Expected number or lookup ref for :db/id, got nil at {pr_str(at)}")

    def add(self, e: Any, a: Any, v: Any, tx: int | None = None) -> None:
        self.checked(e, a, v, [K(":db/add"), e, a, v])
        if back := reverse(a):
            if not self.schema.ref(back):
                raise DatalogError(f"Bad attribute {pr_str(a)}: reverse attribute name requires {{:db/valueType :db.type/ref}} in schema")
            self.add(v, back, e)
            return
        if (own := self.schema.tuple_attrs(a)) is not None:
            current = [next(iter(self.values(self.eid(e), s).values()), None) for s in own]
            if list(v) != current:
                raise DatalogError(f"Can’t modify tuple attrs directly: {pr_str([K(':db/add'), e, a, v])}")
            return
        value = self.value(a, v)
        if is_tempid(e):  # an upsert may say which entity it is
            if self.schema.identity(a) and (found := self.having(a, value)):
                if e in self.tempids and self.tempids[e] != found[0]:
                    if e in self.known:
                        raise DatalogError(f"Conflicting upsert: {pr_str(e)} resolves both to {self.tempids[e]} and {found[0]}")
                    raise _Retry(e, found[0])
                self.tempids[e] = found[0]
                self.used.add(e)
            e = self.allocated(e)
        else:
            e = self.eid(e)
        current = self.values(e, a)
        if frozen(value) in current:
            return
        if not self.schema.many(a):
            for old in list(current.values()):
                self.put(e, a, old, False)
        self.put(e, a, value, True)

    def retract(self, e: Any, a: Any, *v: Any) -> None:
        e = self.now().entid(e) if not (isinstance(e, str) and e in CURRENT) else self.tx
        if e is None:
            return
        if v:
            value = self.value(a, v[0])
            if value is None:
                raise DatalogError(f"Cannot store nil as a value at {pr_str([K(':db/retract'), e, a, None])}")
            if frozen(value) in self.values(e, a):
                self.put(e, a, value, False)
            return
        for value in list(self.values(e, a).values()):
            self.put(e, a, value, False)
            if self.schema.component(a):
                self.retract_entity(value)

    def retract_entity(self, ref: Any) -> None:
        e = self.now().entid(ref)
        if e is None:
            return
        own = self.now().facts_of(e)
        for x, a in self.now().referring(e):
            self.put(x, a, e, False)
        for a, values in own.items():
            for v, _ in values:
                if frozen(v) in self.values(e, a):
                    self.put(e, a, v, False)
        for a, values in own.items():
            if self.schema.component(a):
                for v, _ in values:
                    self.retract_entity(v)

    def cas(self, e: Any, a: Any, old: Any, new: Any) -> None:
        e = self.now().entid_strict(e)
        if self.schema.ref(a):
            old, new = (self.now().entid_strict(x) for x in (old, new))
        self.checked(e, a, new, [K(":db.fn/cas"), e, a, old, new])
        current = self.values(e, a)
        fits = frozen(old) in current if self.schema.many(a) or current else old is None
        if not fits:
            shown = list(current.values())
            raise DatalogError(f":db.fn/cas failed on datom [{e} {pr_str(a)} {pr_str(shown if self.schema.many(a) else shown[0] if shown else None)}], expected {pr_str(old)}")
        self.add(e, a, new)

    def entity(self, item: dict) -> None:
        """A map: its identity by id or upsert, then its attributes, composites last."""
        given = next((v for k, v in item.items() if k in (ID, ":db/id", "db/id")), None)
        facts = {k: v for k, v in item.items() if k not in (ID, ":db/id", "db/id")}
        found: dict[Any, int] = {}
        for a, v in facts.items():
            if self.schema.identity(a) and not reverse(a):
                for x in self.spread(a, v):
                    if isinstance(x, dict) or self.schema.ref(a) and is_tempid(x) and x not in self.tempids:
                        continue
                    value = self.value(a, x) if not isinstance(x, dict) else None
                    if (own := self.having(a, value)):
                        found[a] = own[0]
        for a in self.schema.spec:
            if (own := self.schema.tuple_attrs(a)) and self.schema.identity(a) and all(s in facts for s in own):
                value = [self.value(s, facts[s]) for s in own]
                if hit := self.having(a, value):
                    found[a] = hit[0]
        if len(set(found.values())) > 1:
            raise DatalogError(f"Conflicting upserts: {', '.join(f'{pr_str([a, facts.get(a)])} resolves to {e}' for a, e in found.items())}")
        upserted = next(iter(found.values()), None)
        if given is None:
            self.autos += 1
            given = upserted if upserted is not None else _Auto(f"__auto{self.autos}")
        elif is_tempid(given):
            if upserted is not None:
                if given in self.tempids and self.tempids[given] != upserted:
                    if given in self.known:
                        raise DatalogError(f"Conflicting upsert: {pr_str(given)} resolves both to {self.tempids[given]} and {upserted}")
                    raise _Retry(given, upserted)
                self.tempids[given] = upserted
                self.used.add(given)
        elif upserted is not None and upserted != (e := self.eid(given)):
            a = next(iter(found))
            raise DatalogError(f"Conflicting upsert: {pr_str([a, facts[a]])} resolves to {upserted}, but entity already has :db/id {e}")
        e = self.eid(given)
        for a, v in sorted(facts.items(), key=lambda x: self.schema.tuple_attrs(x[0]) is not None):
            back = reverse(a)
            if back and not self.schema.ref(back):
                raise DatalogError(f"Bad attribute {pr_str(a)}: reverse attribute name requires {{:db/valueType :db.type/ref}} in schema")
            for x in self.spread(back or a, v, bool(back)):
                if isinstance(x, dict) and (back or self.schema.ref(a)):
                    child = dict(x)
                    if not any(k in (ID, ":db/id", "db/id") for k in child):
                        self.autos += 1
                        hit = [h for k, y in child.items() if self.schema.identity(k) and not isinstance(y, dict | list | tuple) for h in self.having(k, y)]
                        child[ID] = hit[0] if hit else _Auto(f"__auto{self.autos}")
                    ref = next(y for k, y in child.items() if k in (ID, ":db/id", "db/id"))
                    self.entity(child)
                    self.add(ref, back, e) if back else self.add(e, a, ref)
                elif back:
                    self.add(x, back, e)
                else:
                    self.add(e, a, x)
        if e not in self.facts and isinstance(given, _Auto):
            self.used.add(given)

    def spread(self, a: Any, v: Any, back: bool = False) -> list:
        """One value or several: a collection is several where the attribute holds many and it is no lookup ref."""
        if isinstance(v, set | frozenset):
            return list(v)
        if not isinstance(v, list | tuple) or not (self.schema.many(a) or back):
            return [v]
        lookup = len(v) == 2 and isinstance(v[0], Keyword) and (self.schema.ref(a) or back) and self.schema.unique(v[0])
        if lookup or self.schema.tuple_(a) and v and not isinstance(v[0], list | tuple):
            return [v]
        return list(v)

    def flush(self) -> None:
        """Composite attributes follow their sources."""
        while self.queue:
            queue, self.queue = self.queue, {}
            for e, own in queue.items():
                for a in own:
                    value = [next(iter(self.values(e, s).values()), None) for s in self.schema.tuple_attrs(a)]
                    for old in list(self.values(e, a).values()):
                        if list(old) != value:
                            self.put(e, a, old, False)
                    if any(x is not None for x in value) and frozen(value) not in self.values(e, a):
                        self.put(e, a, value, True)


def pr_str_datom(e: int, a: Any, v: Any, tx: int) -> str:
    return f"#Datom [{e} {pr_str(a)} {pr_str(v)} {tx} true]"


def with_(db: Db, tx_data: Any, tx_meta: Any = None) -> TxReport:
    """What a transaction makes of a database."""
    if db.is_filtered:
        raise DatalogError("Filtered DB cannot be modified")
    items = read_string(tx_data) if isinstance(tx_data, str) else tx_data
    if items is not None and (isinstance(items, dict) or not hasattr(items, "__iter__")):
        raise DatalogError(f"Bad transaction data {pr_str(items)}, expected sequential collection")
    known: dict[Any, int] = {}
    for _ in range(1000):
        t = Transaction(db, items or [], known)
        try:
            t.run()
            break
        except _Retry as r:
            known = {**known, r.tempid: r.eid}
    else:
        raise DatalogError("Conflicting upserts: the transaction's tempids do not settle")
    after = db.with_facts(t.facts, t.gone, max_eid=max(t.max_eid, db.max_eid), max_tx=t.tx)
    tempids = {k: v for k, v in t.tempids.items() if not isinstance(k, _Auto)} | {K(":db/current-tx"): t.tx}
    return TxReport(db, after, t.out, tempids, tx_meta)


def db_with(db: Db, tx_data: Any) -> Db:
    return with_(db, tx_data).db_after


def resolve_tempid(tempids: dict[Any, int], tempid: Any) -> int | None:
    return tempids.get(tempid)


@dataclass
class BulkReport:
    """``tx_data``: ``e, a, v, tx, added`` of all changes; ``ids``: the entity of every given id."""

    attributes: dict[Any, DataFrame]
    tx_data: DataFrame
    ids: DataFrame


def bulk(db: Db, rows: DataFrame, attributes: dict[Any, str], identity: Any | None = None, key: str | None = None) -> BulkReport:
    """Adds a wide DataFrame of entities, all at once: each column of ``attributes`` (attribute to column; null: no
    fact) is one attribute of one value.

    Entities are found by the unique attribute ``identity`` (a join with its relation) or, where ``key`` names a column
    of entity ids, by that; those that are not found get new ids above the database's greatest. Two rows for one
    identity are one entity and must agree. Facts that are there already change nothing; values that differ give a
    retraction and an addition."""
    tx = db.max_tx + 1
    if identity is not None:
        column = attributes[identity]
        known = db.attr(identity).select(F.col("e").alias("_e"), F.col("v").alias("_v"))
        distinct = rows.select(F.col(column).alias("_id")).where(F.col("_id").isNotNull()).distinct()
        found = written(distinct.join(known, F.col("_id") == F.col("_v"), "left").select("_id", "_e"), "upserts")
        new = numbered(found.where("_e IS NULL").select("_id"), "_id", db.max_eid)
        ids = written(found.where("_e IS NOT NULL").unionByName(new), "ids")
        own = rows.join(ids, rows[column] == F.col("_id")).withColumnRenamed("_e", "e")
    else:
        own, ids = rows.withColumn("e", F.col(key).cast("long")), rows.select(F.col(key).alias("_id"), F.col(key).cast("long").alias("_e"))
    out: dict[Any, DataFrame] = {}
    feed = None
    for a, column in attributes.items():
        current = db.attr(a)
        facts = own.select("e", F.col(column).alias("v")).where(F.col("v").isNotNull()).distinct()
        if db.schema.unique(a):
            facts = facts.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("v")))
            facts = facts.select("e", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"Cannot add {a} because of unique constraint"))).otherwise(F.col("v")).alias("v"))
        single = not db.schema.many(a)
        on = ["e"] if single else ["e", "v"]
        joined = facts.join(current.select("e", F.col("v").alias("_old"), *([F.col("v")] if not single else [])), on, "left")
        changed = joined.where(F.col("_old").isNull() | (F.col("_old") != F.col("v")))
        added = changed.select("e", "v", F.lit(tx).cast("long").alias("tx"), F.lit(True).alias("added"))
        removed = changed.where(F.col("_old").isNotNull()).select("e", F.col("_old").alias("v"), F.lit(tx).cast("long").alias("tx"), F.lit(False).alias("added"))
        changes = written(added.unionByName(removed), "changes")
        kept = current.join(changes.where("NOT added").select("e", "v"), ["e", "v"], "left_anti")
        out[a] = kept.select("e", "v", "tx").unionByName(changes.where("added").select("e", "v", "tx"))
        part = changes.select("e", F.lit(str(a)).alias("a"), F.col("v").cast("string").alias("v"), "tx", "added")
        feed = part if feed is None else feed.unionByName(part)
    return BulkReport(out, feed, ids)


def numbered(values: DataFrame, column: str, start: int) -> DataFrame:
    """Distinct values with numbers from ``start + 1``: a prefix sum over hash slices, so no task orders all."""
    slices = values.withColumn("_slice", F.pmod(F.xxhash64(column), F.lit(4096)))
    sizes = slices.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    bases = sizes.select(F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.row_number().over(W.partitionBy("_slice").orderBy(column))
    return slices.join(bases, F.col("_slice") == F.col("_s")).select(column, (F.lit(start) + F.col("_base") + inside).cast("long").alias("_e"))


__all__ = ["Symbol", "TxReport", "bulk", "db_with", "resolve_tempid", "with_"]

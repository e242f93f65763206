"""Database values: immutable sets of facts (entity, attribute, value, transaction), as relations over Spark.

Facts come from two places. An *entity table* is a DataFrame registered under a namespace: each of its columns is an
attribute, each row an entity, nulls are absent facts, and nothing is unpivoted until something asks for unknown
attributes. *Transacted* facts are an immutable overlay: additions, and retractions of table facts. ``attr(a)`` gives
one attribute's typed relation (e, v, tx), which is what queries compile against, so filters and column pruning reach
the files. ``tagged()`` gives all facts with values as a tagged struct, ordered across types.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.edn import Keyword, Symbol, frozen, pr_str
from loomlog.errors import DatalogError
from loomlog.sources.schema import IDENT, Schema, reverse

E0, TX0, EMAX = 0, 0x20000000, 0x7FFFFFFF
SPAN = 1 << 40  # entity ids of the n-th table are n * SPAN + key
FIELDS = ("t", "l", "d", "s", "b", "ts", "j")


class Datom(NamedTuple):
    e: int
    a: Any
    v: Any
    tx: int = TX0
    added: bool = True


class EntityTable(NamedTuple):
    number: int
    frame: DataFrame
    key: str
    columns: dict[Any, tuple[str, str | None]]  # attribute -> column, namespace it refers to

    def eid(self, offset: int) -> Column:
        return F.col(f"`{self.key}`").cast("long") + F.lit(offset)


class Fact(NamedTuple):
    """What a Column predicate of a filtered database sees."""

    e: Column
    a: Column
    v: Column
    tx: Column


def spark_type(values: Iterable[Any]) -> T.DataType | None:
    """The one native type of some values, or None where they have no common one."""
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return T.StringType()
    if kinds <= {bool}:
        return T.BooleanType()
    if kinds <= {int}:
        return T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    if all(issubclass(k, str) for k in kinds) and (len(kinds) == 1 or Keyword not in kinds and Symbol not in kinds) or kinds <= {uuid.UUID}:
        return T.StringType()
    if kinds <= {dt.datetime}:
        return T.TimestampType()
    if kinds <= {list, tuple}:
        rows = [v for v in values if v is not None]
        if len({len(r) for r in rows}) == 1:
            slots = [spark_type(c) for c in zip(*rows, strict=True)]
            if all(slots):
                return T.StructType([T.StructField(f"_{i}", t) for i, t in enumerate(slots)])
        inner = spark_type([x for r in rows for x in r])
        return T.ArrayType(inner) if inner else None
    return None


def native(value: Any, kind: T.DataType) -> Any:
    """A value as its column holds it."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(native(v, f.dataType) for v, f in zip(value, kind.fields, strict=True))
    if isinstance(kind, T.ArrayType):
        return [native(v, kind.elementType) for v in value]
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.StringType):
        return str(value) if isinstance(value, str | uuid.UUID) else pr_str(value)
    return value


def literal(value: Any) -> Column:
    """A constant of a query as a column."""
    if isinstance(value, list | tuple):
        kind = spark_type([value])
        parts = [literal(v) for v in value]
        return F.struct(*(p.alias(f"_{i}") for i, p in enumerate(parts))) if isinstance(kind, T.StructType) else F.array(*parts)
    if isinstance(value, str | uuid.UUID):
        return F.lit(str(value))
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("long")
    if isinstance(value, set | frozenset):
        return F.array(*map(literal, sorted(value, key=pr_str)))
    return F.lit(value)


def tagged_value(v: Column, kind: T.DataType) -> Column:
    """A typed column as the tagged struct in which values of different types order."""
    which = {T.BooleanType: ("boolean", "b"), T.StringType: ("string", "s"), T.TimestampType: ("time", "ts"), T.TimestampNTZType: ("time", "ts"), T.DateType: ("time", "ts")}
    tag, field = which.get(type(kind), ("number", "d" if isinstance(kind, T.FractionalType) else "l") if isinstance(kind, T.NumericType) else ("other", "j"))
    cast = {"l": "long", "d": "double", "s": "string", "b": "boolean", "ts": "timestamp", "j": "string"}
    value = F.to_json(v) if field == "j" else v
    parts = {f: F.lit(None).cast(cast[f]) for f in FIELDS[1:]} | {field: value.cast(cast[field])}
    if tag == "number":  # numbers of both kinds order together
        parts["d"] = v.cast("double")
        parts["l"] = v.cast("long") if field == "l" else parts["l"]
    return F.struct(F.lit(tag).alias("t"), *(parts[f].alias(f) for f in ("d", "l", "s", "b", "ts", "j")))


class Db:
    """An immutable database value."""

    def __init__(self, schema: Schema | dict | None = None, spark: SparkSession | None = None) -> None:
        self.schema = schema if isinstance(schema, Schema) else Schema(schema)
        self._spark = spark
        self.tables: dict[str, EntityTable] = {}
        self.facts: dict[int, dict[Any, dict[Any, tuple[Any, int]]]] = {}  # e -> a -> frozen v -> (v, tx)
        self.gone: dict[Any, frozenset] = {}  # a -> (e, frozen v) of table facts that are retracted
        self.filters: tuple[Callable, ...] = ()
        self.max_eid, self.max_tx = E0, TX0
        self._index: dict | None = None

    # -- construction

    @property
    def spark(self) -> SparkSession:
        return self._spark or SparkSession.builder.getOrCreate()

    def copy(self, **changes: Any) -> Db:
        new = object.__new__(type(self))
        new.__dict__ = {**self.__dict__, "_index": None, **changes}
        return new

    def with_table(self, namespace: str, frame: DataFrame, key: str, attributes: dict[str, str], refs: dict[str, str] | None = None) -> Db:
        """Registers ``frame``: ``attributes`` maps names in the namespace to columns, ``refs`` names to the namespaces
        that they refer to."""
        number = len(self.tables) + 1
        columns = {Keyword(f"{namespace}/{name}"): (column, (refs or {}).get(name)) for name, column in attributes.items()}
        more = {a: {Keyword(":db/valueType"): Keyword(":db.type/ref")} for a, (_, to) in columns.items() if to}
        table = EntityTable(number, frame, key, columns)
        return self.copy(tables={**self.tables, namespace: table}, schema=self.schema.merged({a: {**self.schema.spec.get(a, {}), **p} for a, p in more.items()}), max_eid=max(self.max_eid, (number + 1) * SPAN))

    def with_facts(self, facts: dict, gone: dict | None = None, **changes: Any) -> Db:
        return self.copy(facts=facts, gone=self.gone if gone is None else gone, **changes)

    # -- attributes

    def home(self, a: Any) -> tuple[EntityTable, str, str | None] | None:
        """The table that has an attribute, its column and what it refers to."""
        for table in self.tables.values():
            if a in table.columns:
                return table, *table.columns[a]
        return None

    def offset(self, namespace: str) -> int:
        return self.tables[namespace].number * SPAN

    def eid(self, namespace: str, key: int) -> int:
        return self.offset(namespace) + key

    def attributes(self) -> list:
        return sorted({a for t in self.tables.values() for a in t.columns} | {a for own in self.facts.values() for a in own}, key=str)

    def local(self, a: Any) -> list[tuple[int, Any, int]]:
        return [(e, v, tx) for e, own in self.facts.items() if a in own for v, tx in own[a].values() if self._passes(Datom(e, a, v, tx))]

    def _passes(self, d: Datom) -> bool:
        return all(f(self.unfiltered, d) for f in self.filters if not getattr(f, "column", False))

    def _column_filters(self, df: DataFrame, a: Column, table: bool) -> DataFrame:
        for f in self.filters:
            if getattr(f, "column", False):
                df = df.where(f(Fact(F.col("e"), a, F.col("v"), F.col("tx"))))
            elif table:
                keep, db = F.udf(lambda e, a, v, tx, f=f: bool(f(None, Datom(e, Keyword(a), v, tx))), "boolean"), None  # noqa: F841
                df = df.where(keep("e", a, "v", "tx"))
        return df

    def value_of(self, table: EntityTable, column: str, to: str | None) -> Column:
        v = F.col(f"`{column}`")
        return v.cast("long") + F.lit(self.offset(to)) if to else v

    def attr(self, a: Any) -> DataFrame:
        """The relation of one attribute: ``e long, v, tx long``."""
        parts, home, local = [], self.home(a), self.local(a)
        kind = None
        if home:
            table, column, to = home
            v = self.value_of(table, column, to)
            df = table.frame.select(table.eid(self.offset_of(table)).alias("e"), v.alias("v"), F.lit(TX0).cast("long").alias("tx")).where(F.col("v").isNotNull())
            kind = df.schema["v"].dataType
            if self.gone.get(a):
                rows = [(e, native(v, kind)) for e, v in self.gone[a]]
                gone = self.spark.createDataFrame(rows, T.StructType([T.StructField("_e", T.LongType()), T.StructField("_v", kind)]))
                df = df.join(gone, (df["e"] == gone["_e"]) & (df["v"] == gone["_v"]), "left_anti")
            parts.append(self._column_filters(df, F.lit(str(a)), True))
        if local or not home:
            own = spark_type([v for _, v, _ in local])
            kind = kind or own or T.StringType()
            rows = [(e, native(v, kind), tx) for e, v, tx in local]
            schema = T.StructType([T.StructField("e", T.LongType(), False), T.StructField("v", kind), T.StructField("tx", T.LongType(), False)])
            parts.append(self._column_filters(self.spark.createDataFrame(rows, schema), F.lit(str(a)), False))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def offset_of(self, table: EntityTable) -> int:
        return table.number * SPAN

    def fused(self, attributes: list, e: int | None = None, equal: dict[int, Any] | None = None) -> DataFrame | None:
        """One scan with a column for each attribute (``e, a0, a1, ...``; null where absent), if one table has them all
        and nothing was transacted over them. Conditions on the entity and on values (by the attribute's place) are put
        to the table's own columns, so that they reach the files."""
        homes = [self.home(a) for a in attributes]
        if not homes or any(h is None for h in homes) or len({id(h[0].frame) for h in homes}) > 1 or self.filters:
            return None
        if any(self.gone.get(a) for a in attributes) or any(a in own for own in self.facts.values() for a in attributes):
            return None
        table = homes[0][0]
        frame = table.frame
        if e is not None:
            frame = frame.where(F.col(f"`{table.key}`") == F.lit(e - self.offset_of(table)))
        for i, v in (equal or {}).items():
            _, column, to = homes[i]
            kind = frame.schema[column].dataType
            if to:
                v = v - self.offset(to) if isinstance(v, int) else None
            fits = v is not None and (isinstance(v, bool) == isinstance(kind, T.BooleanType)) and (isinstance(v, int | float) == isinstance(kind, T.NumericType | T.BooleanType))
            frame = frame.where(F.col(f"`{column}`") == F.lit(str(v) if isinstance(v, str) else v) if fits else F.lit(False))
        return frame.select(table.eid(self.offset_of(table)).alias("e"), *(self.value_of(*h).alias(f"a{i}") for i, h in enumerate(homes)))

    def tagged(self, attributes: list | None = None) -> DataFrame:
        """All facts: ``e, a, v struct, tx``; one scan for each table."""
        wanted, parts = None if attributes is None else set(attributes), []
        for table in self.tables.values():
            own = {a: c for a, c in table.columns.items() if (wanted is None or a in wanted) and not self.gone.get(a)}
            if own:
                each = [F.struct(F.lit(str(a)).alias("a"), F.when(F.col(f"`{c}`").isNotNull(), tagged_value(self.value_of(table, c, to), T.LongType() if to else table.frame.schema[c].dataType)).alias("v")) for a, (c, to) in own.items()]
                df = table.frame.select(table.eid(self.offset_of(table)).alias("e"), F.explode(F.array(*each)).alias("f")).select("e", "f.a", "f.v", F.lit(TX0).cast("long").alias("tx")).where(F.col("v").isNotNull())
                parts.append(self._column_filters(df, F.col("a"), True))
        rest = [a for a in self.attributes() if (wanted is None or a in wanted) and (self.gone.get(a) or any(a in own for own in self.facts.values()))]
        for a in rest:
            covered = self.home(a) and not self.gone.get(a)
            df = self.copy(tables={}).attr(a) if covered else self.attr(a)
            kind = df.schema["v"].dataType
            parts.append(df.select("e", F.lit(str(a)).alias("a"), tagged_value(F.col("v"), kind).alias("v"), "tx"))
        if not parts:
            return self.spark.createDataFrame([], "e long, a string, v struct<t:string,d:double,l:long,s:string,b:boolean,ts:timestamp,j:string>, tx long")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # -- the driver's view of single entities

    def facts_of(self, e: int) -> dict[Any, list[tuple[Any, int]]]:
        """All facts of one entity."""
        out: dict[Any, list] = {a: [x for x in own.values() if self._passes(Datom(e, a, *x))] for a, own in self.facts.get(e, {}).items()}
        for table in (t for t in self.tables.values() if t.number == e // SPAN):
            key = e - self.offset_of(table)
            row = table.frame.where(F.col(f"`{table.key}`") == key).select(*(self.value_of(table, c, to).alias(f"c{i}") for i, (c, to) in enumerate(table.columns.values()))).first()
            for a, v in zip(table.columns, row or (), strict=False):
                if v is not None and (e, frozen(v)) not in self.gone.get(a, ()) and self._passes(Datom(e, a, v)):
                    out.setdefault(a, []).append((v, TX0))
        return {a: sorted(own, key=lambda x: sort_key(x[0])) for a, own in out.items() if own}

    def _by_value(self) -> dict:
        if self._index is None:
            self._index = {}
            for e, own in self.facts.items():
                for a, values in own.items():
                    for v in values:
                        self._index.setdefault((a, v), []).append(e)
        return self._index

    def having(self, a: Any, v: Any) -> list[int]:
        """Entities with an attribute's value."""
        found = [e for e in self._by_value().get((a, frozen(v)), ()) if self._passes(Datom(e, a, v))]
        if home := self.home(a):
            table, column, to = home
            rows = table.frame.where(self.value_of(table, column, to) == literal(v)).select(table.eid(self.offset_of(table)).alias("e")).toLocalIterator()
            gone, known = self.gone.get(a, ()), set(found)
            found += [r["e"] for r in rows if (r["e"], frozen(v)) not in gone and r["e"] not in known]
        return sorted(found)

    def referring(self, e: int) -> list[tuple[int, Any]]:
        """(entity, attribute) of all references to an entity."""
        refs = [a for a in self.attributes() if self.schema.ref(a)]
        return [(x, a) for a in refs for x in self.having(a, e)]

    def entid(self, ref: Any) -> int | None:
        """An entity's id from an id, a lookup ref or an ident."""
        if isinstance(ref, bool) or ref is None:
            if ref is None:
                return None
            raise DatalogError(f"Expected number or lookup ref for entity id, got {pr_str(ref)}")
        if isinstance(ref, int):
            return ref
        if isinstance(ref, Entity):
            return ref.eid
        if isinstance(ref, Keyword):
            return next(iter(self.having(IDENT, ref)), None)
        if isinstance(ref, list | tuple):
            if len(ref) != 2:
                raise DatalogError(f"Lookup ref should contain 2 elements: {pr_str(list(ref))}")
            a, v = ref
            if not self.schema.unique(a) and not self.home(a):
                raise DatalogError(f"Lookup ref attribute should be marked as :db/unique: {pr_str(list(ref))}")
            if v is None:
                return None
            if self.schema.ref(a) and not isinstance(v, int):
                v = self.entid(v)
            found = self.having(a, v)
            if len(found) > 1:
                raise DatalogError(f"Lookup ref attribute should be marked as :db/unique: {pr_str(list(ref))}")
            return found[0] if found else None
        raise DatalogError(f"Expected number or lookup ref for entity id, got {pr_str(ref)}")

    def entid_strict(self, ref: Any) -> int:
        found = self.entid(ref)
        if found is None:
            raise DatalogError(f"Nothing found for entity id {pr_str(list(ref) if isinstance(ref, tuple) else ref)}")
        return found

    # -- views and comparison

    @property
    def unfiltered(self) -> Db:
        return self.copy(filters=()) if self.filters else self

    @property
    def is_filtered(self) -> bool:
        return bool(self.filters)

    def filter(self, predicate: Callable) -> Db:
        """A view: ``predicate(db, datom)``, or one made by ``by_column`` that works on columns."""
        return self.copy(filters=(*self.filters, predicate))

    def with_schema(self, schema: dict) -> Db:
        return self.copy(schema=Schema(schema))

    def count(self) -> int:
        return self.tagged().count()

    def local_datoms(self) -> list[Datom]:
        return sorted((Datom(e, a, v, tx) for e, own in self.facts.items() for a, values in own.items() for v, tx in values.values() if self._passes(Datom(e, a, v, tx))), key=lambda d: (d.e, str(d.a), sort_key(d.v)))

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Db) or self.schema != other.schema:
            return False
        if not self.tables and not other.tables:
            return {(d.e, d.a, frozen(d.v)) for d in self.local_datoms()} == {(d.e, d.a, frozen(d.v)) for d in other.local_datoms()}
        only_a, only_b, _ = diff(self, other)
        return only_a.isEmpty() and only_b.isEmpty()

    def __hash__(self) -> int:
        row = self.tagged().agg(F.sum(F.xxhash64("e", "a", "v").cast("decimal(38,0)"))).first()
        return hash((self.schema, row[0]))


def sort_key(v: Any) -> tuple:
    """A total order over values of any types."""
    if v is None:
        return (0,)
    if isinstance(v, bool):
        return (1, "boolean", v)
    if isinstance(v, int | float):
        return (1, "number", v)
    if isinstance(v, list | tuple):
        return (1, "sequence", len(v), [sort_key(x) for x in v])
    if isinstance(v, str):
        return (1, "string", str(v))
    return (1, type(v).__name__, pr_str(v))


def by_column(f: Callable[[Fact], Column]) -> Callable:
    """Marks a filter predicate that maps a fact's columns to a condition; it is pushed into scans."""
    f.column = True
    return f


def empty_db(schema: dict | None = None, spark: SparkSession | None = None) -> Db:
    return Db(schema, spark)


def init_db(datoms: Iterable[Datom | tuple], schema: dict | None = None, spark: SparkSession | None = None) -> Db:
    """A database of given facts."""
    db, facts = Db(schema, spark), {}
    max_eid, max_tx = E0, TX0
    for d in datoms:
        if not isinstance(d, tuple) or len(d) < 3:
            raise DatalogError(f"init-db expects list of Datoms, got {type(d).__name__}")
        d = Datom(*d)
        facts.setdefault(d.e, {}).setdefault(d.a, {})[frozen(d.v)] = (d.v, d.tx)
        max_tx = max(max_tx, d.tx)
        if d.e < TX0:
            max_eid = max(max_eid, d.e)
        if db.schema.ref(d.a) and d.v < TX0:
            max_eid = max(max_eid, d.v)
    return db.with_facts(facts, max_eid=max_eid, max_tx=max_tx)


def diff(a: Db, b: Db) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts only in a, only in b, and in both; transactions don't count."""
    x, y = (d.tagged().select("e", "a", "v") for d in (a, b))
    return x.subtract(y), y.subtract(x), x.intersect(y)


# -- ordered access

ORDERS = {"eavt": ("e", "a", "v", "tx"), "aevt": ("a", "e", "v", "tx"), "avet": ("a", "v", "e", "tx")}


def _pattern(db: Db, index: str, components: tuple) -> tuple[tuple, dict[str, Any]]:
    index = str(index).lstrip(":")
    if index not in ORDERS:
        raise DatalogError(f"Unknown index: {index}")
    given = dict(zip(ORDERS[index], components, strict=False))
    if given.get("e") is not None:
        given["e"] = db.entid_strict(given["e"])
    if given.get("a") is not None and index == "avet" and not db.schema.indexed(given["a"]) and not db.home(given["a"]):
        raise DatalogError(f"Attribute {pr_str(given['a'])} should be marked as :db/index true")
    if given.get("v") is not None and given.get("a") is not None and db.schema.ref(given["a"]):
        given["v"] = db.entid_strict(given["v"])
    return ORDERS[index], {k: v for k, v in given.items() if v is not None}


def datoms(db: Db, index: str, *components: Any) -> DataFrame:
    """Facts with the given leading components, in the index's order. With an attribute among them, ``v`` has its own
    type, else it is a tagged struct."""
    order, given = _pattern(db, index, components)
    if "a" in given:
        df = db.attr(given["a"]).select("e", F.lit(str(given["a"])).alias("a"), "v", "tx")
        conditions = {"e": lambda x: F.col("e") == x, "v": lambda x: F.col("v") == literal(x), "tx": lambda x: F.col("tx") == x}
    else:
        df = db.tagged()
        conditions = {"e": lambda x: F.col("e") == x, "v": lambda x: F.col("v") == _tagged_literal(x), "tx": lambda x: F.col("tx") == x}
    for k, f in conditions.items():
        if k in given:
            df = df.where(f(given[k]))
    return df.orderBy(*order)


def _tagged_literal(v: Any) -> Column:
    return tagged_value(literal(v), spark_type([v]) or T.StringType())


def _sought(db: Db, index: str, components: tuple, back: bool) -> DataFrame:
    order, given = _pattern(db, index, components)
    keys = [k for k in order if k in given][: len(components)]
    df = db.tagged()
    if keys:
        at = F.struct(*(F.col(k) for k in keys))
        to = F.struct(*(F.lit(str(given[k])).alias(k) if k == "a" else _tagged_literal(given[k]).alias(k) if k == "v" else F.lit(given[k]).cast("long").alias(k) for k in keys))
        df = df.where(at <= to if back else at >= to)
    return df.orderBy(*(F.desc(k) if back else F.asc(k) for k in order))


def seek_datoms(db: Db, index: str, *components: Any) -> DataFrame:
    """Facts from the first that is not before the components, to the index's end."""
    return _sought(db, index, components, False)


def rseek_datoms(db: Db, index: str, *components: Any) -> DataFrame:
    """The same backwards."""
    return _sought(db, index, components, True)


def index_range(db: Db, a: Any, start: Any = None, end: Any = None) -> DataFrame:
    """An attribute's facts with values from start to end, both included, by value."""
    if not db.schema.indexed(a) and not db.home(a):
        raise DatalogError(f"Attribute {pr_str(a)} should be marked as :db/index true")
    df = db.attr(a).select("e", F.lit(str(a)).alias("a"), "v", "tx")
    if start is not None:
        df = df.where(F.col("v") >= literal(start))
    if end is not None:
        df = df.where(F.col("v") <= literal(end))
    return df.orderBy("v", "e")


def find_datom(db: Db, index: str, *components: Any) -> Datom | None:
    row = datoms(db, index, *components).limit(1).first()
    return Datom(row["e"], Keyword(row["a"]) if row["a"].startswith(":") else row["a"], row["v"], row["tx"]) if row else None


# -- entities


class Entity:
    """A read-only map over one entity; references are entities."""

    def __init__(self, db: Db, eid: int) -> None:
        self.db, self.eid, self._all = db, eid, None

    def _facts(self) -> dict[Any, list[tuple[Any, int]]]:
        if self._all is None:
            self._all = self.db.facts_of(self.eid)
        return self._all

    def _value(self, a: Any, v: Any) -> Any:
        return Entity(self.db, v) if self.db.schema.ref(a) else v

    def get(self, a: Any, default: Any = None) -> Any:
        if a == Keyword(":db/id") or a == "db/id":
            return self.eid
        if back := reverse(a):
            found = self.db.having(back, self.eid)
            if not found:
                return default
            own = [Entity(self.db, e) for e in found]
            return own[0] if self.db.schema.component(back) else frozenset(own)
        own = self._facts().get(a)
        if not own:
            return default
        values = [self._value(a, v) for v, _ in own]
        return frozenset(frozen(v) for v in values) if self.db.schema.many(a) else values[0]

    def __getitem__(self, a: Any) -> Any:
        if (found := self.get(a)) is None:
            raise KeyError(a)
        return found

    def __contains__(self, a: Any) -> bool:
        return self.get(a) is not None

    def keys(self) -> list:
        return list(self._facts())

    def __iter__(self):  # noqa: ANN204
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self._facts())

    def items(self) -> list[tuple]:
        return [(a, self.get(a)) for a in self.keys()]

    def touch(self) -> dict:
        """All attributes, with components expanded."""
        out: dict = {Keyword(":db/id"): self.eid}
        for a in self.keys():
            v = self.get(a)
            if self.db.schema.component(a):
                v = [x.touch() for x in sorted(v, key=lambda x: x.eid)] if isinstance(v, frozenset) else v.touch()
            out[a] = v
        return out

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Entity) and self.db is other.db and self.eid == other.eid

    def __hash__(self) -> int:
        return hash(self.eid)

    def __repr__(self) -> str:
        return pr_str({Keyword(":db/id"): self.eid})


def datafy(db: Db, ref: Any) -> dict:
    """An entity's attributes, and the entities that refer to it under reverse names."""
    eid = db.entid_strict(ref)
    out: dict = {Keyword(":db/id"): eid} | {a: [v for v, _ in own] if db.schema.many(a) else own[0][0] for a, own in db.facts_of(eid).items()}
    for e, a in db.referring(eid):
        ns, _, name = str(a)[1:].rpartition("/")
        out.setdefault(Keyword(f"{ns + '/' if ns else ''}_{name}"), []).append(e)
    return out


def empty(db: Db) -> Db:
    """A database without facts, of the same schema."""
    return Db(db.schema, db._spark)


def chunks(frame: DataFrame, size: int = 1000) -> Iterator[list]:
    """The rows of an ordered run, some at a time; only one partition is with the driver at once."""
    own = []
    for row in frame.toLocalIterator():
        own.append(row)
        if len(own) == size:
            yield own
            own = []
    if own:
        yield own


def entity(db: Db, ref: Any) -> Entity | None:
    """The entity of an id, lookup ref or ident; None where a lookup finds nothing or there are no facts."""
    eid = db.entid(ref)
    return None if eid is None or not (db.facts_of(eid) or isinstance(ref, int)) else Entity(db, eid)

"""Database values as data: a JSON-able dict, EDN text, and Parquet with a log of changes.

On disk, a database is a folder: ``base-N`` has a snapshot's facts, ``log`` the changes since, ``meta.json`` the schema
and which snapshot is current. Storing appends to the log until it is long, then writes a new snapshot; ``vacuum``
removes snapshots that nothing names any more.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomlog.edn import Keyword, Symbol, pr_str, read_string
from loomlog.operators.transact import TxReport
from loomlog.sources.db import TX0, Datom, Db, init_db

#: The markers of the serialised form.
KEYWORD, OTHER, INF, NEG_INF, NAN = range(5)


def serializable(db: Db, freeze: Callable[[Any], Any] | None = None) -> dict:
    """A dict that JSON can hold."""
    freeze = freeze or pr_str
    datoms = db.local_datoms()
    attrs = sorted({d.a for d in datoms}, key=str)
    keywords: list[Keyword] = []
    place: dict[Any, int] = {}

    def value(v: Any) -> Any:
        if isinstance(v, Keyword):
            if v not in place:
                place[v] = len(keywords)
                keywords.append(v)
            return [KEYWORD, place[v]]
        if isinstance(v, float) and not math.isfinite(v):
            return [NAN] if math.isnan(v) else [INF if v > 0 else NEG_INF]
        if isinstance(v, bool | int | float) or isinstance(v, str) and not isinstance(v, Symbol):
            return v
        return [OTHER, freeze(v)]

    rows = [[d.e, attrs.index(d.a), value(d.v), d.tx - TX0] for d in datoms]
    order = lambda key: sorted(range(len(datoms)), key=lambda i: key(datoms[i]))
    return {
        "count": len(rows), "tx0": TX0, "max-eid": db.max_eid, "max-tx": db.max_tx, "schema": pr_str(db.schema.spec), "attrs": list(map(pr_str, attrs)), "keywords": list(map(str, keywords)), "eavt": rows,
        "aevt": order(lambda d: (str(d.a), d.e)), "avet": [i for i in order(lambda d: (str(d.a), pr_str(d.v), d.e)) if db.schema.indexed(datoms[i].a)],
    }


def from_serializable(data: dict, thaw: Callable[[Any], Any] | None = None, spark: SparkSession | None = None) -> Db:
    thaw = thaw or read_string
    attrs, keywords = list(map(read_string, data["attrs"])), list(map(Keyword, data["keywords"]))

    def value(v: Any) -> Any:
        if not isinstance(v, list):
            return v
        return {KEYWORD: lambda: keywords[v[1]], OTHER: lambda: thaw(v[1]), INF: lambda: math.inf, NEG_INF: lambda: -math.inf, NAN: lambda: math.nan}[v[0]]()

    db = init_db([Datom(e, attrs[a], value(v), tx + data["tx0"]) for e, a, v, tx in data["eavt"]], read_string(data["schema"]), spark)
    return db.copy(max_eid=data["max-eid"], max_tx=data["max-tx"])


def to_json(db: Db) -> str:
    return json.dumps(serializable(db))


def from_json(text: str, spark: SparkSession | None = None) -> Db:
    return from_serializable(json.loads(text), spark=spark)


def db_string(db: Db) -> str:
    """The database as tagged EDN text."""
    rows = " ".join(f"[{d.e} {pr_str(d.a)} {pr_str(d.v)} {d.tx}]" for d in db.local_datoms())
    return f"#loomlog/DB {{:schema {pr_str(db.schema.spec)}, :datoms [{rows}]}}"


def read_db(text: str, spark: SparkSession | None = None) -> Db:
    def made(form: dict) -> Db:
        return init_db([Datom(*row) for row in form[Keyword(":datoms")]], form.get(Keyword(":schema")), spark)

    return read_string(text, {"loomlog/DB": made, "loomlog/Datom": lambda row: Datom(*row)})


ROWS = "e long, a string, v string, tx long, added boolean"


class Storage:
    """A folder that holds one database."""

    def __init__(self, spark: SparkSession, path: str, log_rows: int = 512) -> None:
        self.spark, self.path, self.log_rows = spark, path.rstrip("/"), log_rows

    def _file(self, name: str) -> Any:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _meta(self) -> dict | None:
        at, fs = self._file("meta.json")
        if not fs.exists(at):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/meta.json").collect()))

    def _put_meta(self, meta: dict) -> None:
        at, fs = self._file("meta.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()

    def _frame(self, datoms: list[Datom]) -> DataFrame:
        return self.spark.createDataFrame([(d.e, pr_str(d.a), pr_str(d.v), d.tx, d.added) for d in datoms], ROWS)

    def store(self, db: Db) -> str:
        """Writes a snapshot and begins a new log; returns its address."""
        address = f"base-{uuid.uuid4().hex}"
        self._frame(db.local_datoms()).write.parquet(f"{self.path}/{address}")
        log = f"log-{uuid.uuid4().hex}"
        self._put_meta({"base": address, "log": log, "schema": pr_str(db.schema.spec), "max-eid": db.max_eid, "max-tx": db.max_tx})
        return address

    def append(self, report: TxReport) -> None:
        """Adds a transaction to the log, or, where the log is long, stores anew."""
        meta = self._meta()
        if meta is None:
            self.store(report.db_after)
            return
        at, fs = self._file(meta["log"])
        if fs.exists(at) and self.spark.read.schema(ROWS).parquet(f"{self.path}/{meta['log']}").count() + len(report.tx_data) > self.log_rows:
            self.store(report.db_after)
            return
        self._frame(report.tx_data).coalesce(1).write.mode("append").parquet(f"{self.path}/{meta['log']}")
        self._put_meta({**meta, "max-eid": report.db_after.max_eid, "max-tx": report.db_after.max_tx})

    def restore(self) -> Db | None:
        """The database of the current snapshot and the log after it."""
        meta = self._meta()
        if meta is None:
            return None
        rows = self.spark.read.schema(ROWS).parquet(f"{self.path}/{meta['base']}").collect()
        at, fs = self._file(meta["log"])
        if fs.exists(at):
            rows += sorted(self.spark.read.schema(ROWS).parquet(f"{self.path}/{meta['log']}").collect(), key=lambda r: (r["tx"], r["added"]))
        facts: dict = {}
        for r in rows:
            k = r["e"], r["a"], r["v"]
            if r["added"]:
                facts[k] = r["tx"]
            else:
                facts.pop(k, None)
        db = init_db([Datom(e, read_string(a), read_string(v), tx) for (e, a, v), tx in facts.items()], read_string(meta["schema"]), self.spark)
        return db.copy(max_eid=meta["max-eid"], max_tx=meta["max-tx"])

    def addresses(self) -> set[str]:
        meta = self._meta()
        return {meta["base"], meta["log"]} if meta else set()

    def vacuum(self) -> int:
        """Deletes what the current state doesn't name; returns how many folders went."""
        at, fs = self._file("")
        if not fs.exists(at):
            return 0
        kept, gone = self.addresses() | {"meta.json", ".meta.json.crc"}, 0
        for s in fs.listStatus(at):
            if s.getPath().getName() not in kept:
                fs.delete(s.getPath(), True)
                gone += 1
        return gone


def squuid(millis: int | None = None) -> uuid.UUID:
    """A random UUID whose first 32 bits are the seconds of its making, so that they sort by time."""
    seconds = (int(time.time() * 1000) if millis is None else millis) // 1000
    return uuid.UUID(int=(seconds & 0xFFFFFFFF) << 96 | uuid.uuid4().int & ((1 << 96) - 1))


def squuid_time_millis(u: uuid.UUID) -> int:
    return (u.int >> 96) * 1000


__all__ = ["Storage", "db_string", "from_json", "from_serializable", "read_db", "serializable", "squuid", "squuid_time_millis", "to_json"]

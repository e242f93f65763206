"""Connections: a current database, serialised transactions, listeners, and streams of facts."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomlog.edn import Keyword
from loomlog.operators.transact import TxReport, with_
from loomlog.sources.db import Datom, Db, init_db
from loomlog.sources.schema import Schema

POOL = ThreadPoolExecutor(max_workers=4, thread_name_prefix="transact")


class Connection:
    """The one mutable thing: which database value is current."""

    def __init__(self, db: Db) -> None:
        self._db, self._lock, self._listeners = db, threading.RLock(), {}

    @property
    def db(self) -> Db:
        return self._db

    def transact(self, tx_data: Any, tx_meta: Any = None) -> TxReport:
        """Applies a transaction, then tells the listeners, on this thread."""
        with self._lock:
            report = with_(self._db, tx_data, tx_meta)
            self._db = report.db_after
            self._tell(report)
        return report

    def transact_async(self, tx_data: Any, tx_meta: Any = None) -> Future:
        return POOL.submit(self.transact, tx_data, tx_meta)

    def _tell(self, report: TxReport) -> None:
        for f in list(self._listeners.values()):
            f(report)

    def listen(self, callback: Callable[[TxReport], None], key: Any = None) -> Any:
        key = key if key is not None else uuid.uuid4().hex
        self._listeners[key] = callback
        return key

    def unlisten(self, key: Any) -> None:
        self._listeners.pop(key, None)

    def reset(self, db: Db, tx_meta: Any = None) -> TxReport:
        """Another database altogether: the report retracts all that was and adds all that is."""
        with self._lock:
            old = [Datom(*d[:4], False) for d in self._db.local_datoms()]
            report = TxReport(self._db, db, [*old, *db.local_datoms()], {}, tx_meta)
            self._db = db
            self._tell(report)
        return report

    def reset_schema(self, schema: dict) -> Schema:
        with self._lock:
            self._db = self._db.with_schema(schema)
            return self._db.schema

    # -- streams

    def sink(self, stream: DataFrame, to_items: Callable[[DataFrame], Iterable]) -> DataStreamWriter:
        """A stream whose micro-batches are transactions; ``to_items`` gives a batch's items, which must be few."""
        return stream.writeStream.foreachBatch(lambda batch, n: self.transact(list(to_items(batch)), {"batch": n}) and None)

    def log_to(self, path: str, spark: SparkSession) -> Any:
        """A listener that appends every report's changes to a Parquet log, which ``changes`` reads as a stream."""
        rows = "e long, a string, v string, tx long, added boolean"

        def append(report: TxReport) -> None:
            if report.tx_data:
                data = [(d.e, str(d.a), str(d.v), d.tx, d.added) for d in report.tx_data]
                spark.createDataFrame(data, rows).coalesce(1).write.mode("append").parquet(path)

        return self.listen(append)


def changes(spark: SparkSession, path: str) -> DataFrame:
    """The change feed as a stream."""
    return spark.readStream.schema("e long, a string, v string, tx long, added boolean").parquet(path)


def latest(log: DataFrame) -> DataFrame:
    """The facts that a change feed leaves: of each (e, a, v), the last change decides. A stream or a table."""
    last = log.groupBy("e", "a", "v").agg(F.max_by("added", F.struct("tx", "added")).alias("added"), F.max("tx").alias("tx"))
    return last.where("added").select("e", "a", "v", "tx")


def windowed(events: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "1 day", by: str | None = None) -> DataFrame:
    """Counts and sums of a stream (or table) of events in tumbling windows, with a watermark for late ones."""
    keys = [F.window(time, width).alias("window"), *([F.col(by)] if by else [])]
    return events.withWatermark(time, late).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def create_conn(schema: dict | None = None, spark: SparkSession | None = None) -> Connection:
    return Connection(Db(schema, spark))


def conn_from_db(db: Db) -> Connection:
    return Connection(db)


def conn_from_datoms(datoms: Iterable, schema: dict | None = None, spark: SparkSession | None = None) -> Connection:
    return Connection(init_db(datoms, schema, spark))


__all__ = ["Connection", "Keyword", "changes", "conn_from_datoms", "conn_from_db", "create_conn", "latest", "windowed"]

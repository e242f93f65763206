"""loomlog: Datalog queries, transactions and pulls over facts and DataFrames, run by Spark."""

from loomlog.edn import Keyword, Symbol, pr_str, read_string
from loomlog.errors import DatalogError
from loomlog.operators.compiler import register
from loomlog.operators.pull import pull, pull_frame, pull_many
from loomlog.operators.query import Result, q
from loomlog.operators.transact import TxReport, bulk, db_with, resolve_tempid, with_
from loomlog.sources.db import Datom, Db, Entity, by_column, chunks, datafy, datoms, diff, empty, empty_db, entity, find_datom, index_range, init_db, rseek_datoms, seek_datoms
from loomlog.sources.storage import Storage, db_string, from_json, from_serializable, read_db, serializable, squuid, squuid_time_millis, to_json
from loomlog.streaming.conn import Connection, conn_from_datoms, conn_from_db, create_conn

__all__ = [
    "Connection", "Datom", "DatalogError", "Db", "Entity", "Keyword", "Result", "Storage", "Symbol", "TxReport", "bulk", "by_column", "chunks", "conn_from_datoms", "conn_from_db", "create_conn", "datafy",
    "datoms", "db_string", "db_with", "diff", "empty", "empty_db", "entity", "find_datom", "from_json", "from_serializable", "index_range", "init_db", "pr_str", "pull", "pull_frame", "pull_many", "q", "read_db",
    "read_string", "register", "resolve_tempid", "rseek_datoms", "seek_datoms", "serializable", "squuid", "squuid_time_millis", "to_json", "with_",
]

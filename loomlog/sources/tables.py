"""The star-schema and corpus tables as entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.sources.db import Db

#: Namespace: table, key column, prefix of its columns, references (attribute name, column, namespace).
TABLES = {
    "region": ("region", "r_regionkey", "r_", {}),
    "nation": ("nation", "n_nationkey", "n_", {"region": ("n_regionkey", "region")}),
    "customer": ("customer", "c_custkey", "c_", {"nation": ("c_nationkey", "nation")}),
    "supplier": ("supplier", "s_suppkey", "s_", {"nation": ("s_nationkey", "nation")}),
    "part": ("part", "p_partkey", "p_", {}),
    "order": ("orders", "o_orderkey", "o_", {"customer": ("o_custkey", "customer")}),
    "line": ("lineitem", "_row", "l_", {"order": ("l_orderkey", "order"), "part": ("l_partkey", "part"), "supplier": ("l_suppkey", "supplier")}),
    "event": ("events", "event_id", "", {}),
    "doc": ("documents", "doc_id", "", {}),
    "label": ("labels", "doc_id", "", {"doc": ("doc_id", "doc")}),
    "label-of": ("labels", "doc_id", "", {}),
    "page": ("pages", "page_id", "", {}),
}


def star(spark: SparkSession, sf_dir: str, *namespaces: str) -> Db:
    """A database over the named tables (and those they refer to are only ids unless named)."""
    db = Db(spark=spark)
    for ns in TABLES if not namespaces else namespaces:
        name, key, prefix, refs = TABLES[ns]
        df: DataFrame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if key == "_row":  # rows have no key of their own: their place in the file, which every scan sees alike
            df = df.withColumn("_row", F.xxhash64(F.col("_metadata.file_path")).bitwiseAND(F.lit(0xFF)) * F.lit(1 << 32) + F.col("_metadata.row_index"))
        attributes = {c.removeprefix(prefix).replace("_", "-"): c for c in df.columns if c != "_row"} | {a: c for a, (c, _) in refs.items()}
        db = db.with_table(ns, df, key, attributes, {a: to for a, (_, to) in refs.items() if to in namespaces or not namespaces})
        if ns == "label-of":  # facts about documents, by the documents' own ids
            db = db.copy(tables={**db.tables, ns: db.tables[ns]._replace(number=db.tables["doc"].number)})
    return db

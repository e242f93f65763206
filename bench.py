"""Times the headline queries over whole tables; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from loomlog import q
from loomlog.plans.catalogue import QUERIES
from loomlog.sources.tables import star

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

#: The shapes of the reference's benchmark: one to four clauses, predicates with a constant and with an input.
SHAPES = {
    "q1": ('[:find ?o :where [?o :order/orderstatus "F"]]', "order"),
    "q2": ('[:find ?o ?p :where [?o :order/orderstatus "F"] [?o :order/totalprice ?p]]', "order"),
    "q3": ('[:find ?o ?p ?t :where [?o :order/orderstatus "F"] [?o :order/totalprice ?p] [?o :order/orderpriority ?t]]', "order"),
    "q4": ('[:find ?o ?n ?p ?t :where [?o :order/orderstatus "F"] [?o :order/customer ?c] [?c :customer/name ?n] [?o :order/totalprice ?p] [?o :order/orderpriority ?t]]', "order customer"),
    "q5_shortcircuit": ('[:find ?o ?p :where [?o :order/orderstatus "none"] [?o :order/totalprice ?p]]', "order"),
    "qpred1": ("[:find ?l ?p :where [?l :line/extendedprice ?p] [(> ?p 50000)]]", "line"),
    "qpred2": ("[:find ?l ?p :in $ ?min :where [?l :line/extendedprice ?p] [(> ?p ?min)]]", "line"),
}
MORE = ("ref_join_5", "not_join", "or_join", "rule_tc", "agg_sum", "agg_median", "pull_nested", "attr_var", "fn_get_else")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {}
    for name, (text, tables) in SHAPES.items():
        inputs = (50_000,) if name == "qpred2" else ()
        runs[name] = lambda text=text, tables=tables, inputs=inputs: q(text, star(spark, SF_DIR, *tables.split()), *inputs).df
    runs |= {name: lambda f=QUERIES[name]: f(spark, SF_DIR) for name in MORE}
    times = {}
    for name, run in runs.items():
        best = float("inf")
        for _ in range(3):  # the first warms up
            start = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 4)
    print(json.dumps({"metric": "datalog_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

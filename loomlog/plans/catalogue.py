"""Queries over the driver's tables, each with the same result in DuckDB's SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.edn import Keyword
from loomlog.operators.pull import pull_frame
from loomlog.operators.query import q
from loomlog.operators.transact import bulk, db_with
from loomlog.sources.db import by_column, datoms, diff, entity, index_range, init_db, rseek_datoms, seek_datoms
from loomlog.sources.shared import shared_folder
from loomlog.sources.storage import from_json, to_json
from loomlog.sources.tables import star
from loomlog.streaming.conn import create_conn, windowed

Query = Callable[[SparkSession, str], DataFrame]
K = Keyword
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Query, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in columns})


def datalog(name: str, text: str, sql: str | None, *inputs: Any, round_: tuple = (), then: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A query whose first input is the database of the namespaces that it names."""
    namespaces = list(dict.fromkeys(re.findall(r":(region|nation|customer|supplier|part|order|line|event|doc|label-of|label|page)/", text)))
    if "label-of" in namespaces and "doc" not in namespaces:
        namespaces.insert(0, "doc")
    namespaces.sort(key=lambda n: n == "label-of")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = q(text, star(spark, sf_dir, *namespaces), *inputs).df
        df = rounded(df, *round_) if round_ else df
        return then(df) if then else df

    add(name, run, sql)


# -- scans, filters, joins

datalog("scan_const_value", '[:find ?name :where [?c :customer/mktsegment "BUILDING"] [?c :customer/name ?name]]', "SELECT DISTINCT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
datalog("scan_exists", "[:find ?c :keys n :where [?c :customer/name _]]", "SELECT count(*) AS n FROM customer", then=lambda df: df.agg(F.count(F.lit(1)).alias("n")))
datalog("star_fusion", "[:find ?k ?s ?t ?p ?d :where [?o :order/orderkey ?k] [?o :order/orderstatus ?s] [?o :order/totalprice ?t] [?o :order/orderpriority ?p] [?o :order/orderdate ?d]]", "SELECT DISTINCT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS t, o_orderpriority AS p, o_orderdate AS d FROM orders")
datalog("pred_lt_gt", "[:find ?name ?b :where [?c :customer/name ?name] [?c :customer/acctbal ?b] [(> ?b 1000)] [(< ?b 5000)]]", "SELECT DISTINCT c_name AS name, c_acctbal AS b FROM customer WHERE c_acctbal > 1000 AND c_acctbal < 5000")
datalog("pred_chain", "[:find ?name ?b :where [?c :customer/name ?name] [?c :customer/acctbal ?b] [(<= 1000 ?b 2000)]]", "SELECT DISTINCT c_name AS name, c_acctbal AS b FROM customer WHERE c_acctbal BETWEEN 1000 AND 2000")
datalog("pred_no_vars", "[:find ?name :where [?c :customer/name ?name] [(> 1 2)]]", "SELECT c_name AS name FROM customer WHERE false")
datalog("theta_join", "[:find ?r ?n :where [?x :region/regionkey ?r] [?y :nation/nationkey ?n] [(< ?r ?n)]]", "SELECT DISTINCT r_regionkey AS r, n_nationkey AS n FROM region JOIN nation ON r_regionkey < n_nationkey")
datalog("ref_join_2", "[:find ?k ?name :where [?o :order/customer ?c] [?o :order/orderkey ?k] [?c :customer/name ?name]]", "SELECT DISTINCT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
datalog(
    "ref_join_5", "[:find ?rn (sum ?p) (count ?l) :keys region revenue n :where [?l :line/order ?o] [?l :line/extendedprice ?p] [?o :order/customer ?c] [?c :customer/nation ?n] [?n :nation/region ?r] [?r :region/name ?rn]]",
    "SELECT r_name AS region, round(sum(p), 2) AS revenue, count(*) AS n FROM (SELECT r_name, l.rowid, l_extendedprice AS p FROM (SELECT *, row_number() OVER () AS rowid FROM lineitem) l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY r_name",
    then=lambda df: df.withColumn("revenue", F.round("revenue", 2)),
)
datalog("value_join", "[:find ?cn ?sn :where [?c :customer/nationkey ?k] [?s :supplier/nationkey ?k] [?c :customer/name ?cn] [?s :supplier/name ?sn] [(> ?k 20)]]", "SELECT DISTINCT c_name AS cn, s_name AS sn FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_nationkey > 20")
datalog("cross_product", "[:find ?r ?n :where [?x :region/name ?r] [?y :nation/name ?n]]", "SELECT DISTINCT r_name AS r, n_name AS n FROM region CROSS JOIN nation")
datalog("self_unify", "[:find ?n :where [?n :nation/nationkey ?k] [?n :nation/regionkey ?k]]", "SELECT 2 * 1099511627776 + n_nationkey AS n FROM nation WHERE n_nationkey = n_regionkey", then=lambda df: df.select((F.col("n") + (1 << 40)).alias("n")))

# -- inputs and sources

datalog("coll_source_join", "[:find ?name ?rank :in $ $seg :where [?c :customer/mktsegment ?s] [$seg ?s ?rank] [?c :customer/name ?name]]", "SELECT DISTINCT c_name AS name, rank FROM customer JOIN (VALUES ('BUILDING', 1::BIGINT), ('MACHINERY', 2::BIGINT)) v(s, rank) ON c_mktsegment = s", [["BUILDING", 1], ["MACHINERY", 2]])
datalog("in_scalar", "[:find ?name :in $ ?seg :where [?c :customer/mktsegment ?seg] [?c :customer/name ?name]]", "SELECT DISTINCT c_name AS name FROM customer WHERE c_mktsegment = 'AUTOMOBILE'", "AUTOMOBILE")
datalog("in_coll", "[:find ?name ?seg :in $ [?seg ...] :where [?c :customer/mktsegment ?seg] [?c :customer/name ?name]]", "SELECT DISTINCT c_name AS name, c_mktsegment AS seg FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')", ["AUTOMOBILE", "BUILDING"])
datalog("in_tuple", "[:find ?name :in $ [?seg ?min] :where [?c :customer/mktsegment ?seg] [?c :customer/acctbal ?b] [(> ?b ?min)] [?c :customer/name ?name]]", "SELECT DISTINCT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 3000", ["BUILDING", 3000])
datalog("in_rel", "[:find ?name ?seg :in $ [[?seg ?min]] :where [?c :customer/mktsegment ?seg] [?c :customer/acctbal ?b] [(> ?b ?min)] [?c :customer/name ?name]]", "SELECT DISTINCT c_name AS name, c_mktsegment AS seg FROM customer JOIN (VALUES ('BUILDING', 3000), ('MACHINERY', 5000)) v(s, m) ON c_mktsegment = s AND c_acctbal > m", [["BUILDING", 3000], ["MACHINERY", 5000]])
datalog("in_nested", "[:find ?k ?x :in $ [[?k [?min ?max]] ...] :where [?p :part/size ?x] [(<= ?min ?x ?max)]]", "SELECT DISTINCT k, p_size AS x FROM part JOIN (VALUES ('small', 1, 10), ('big', 40, 50)) v(k, lo, hi) ON p_size BETWEEN lo AND hi", [["small", [1, 10]], ["big", [40, 50]]])
datalog("lookup_ref", '[:find ?b :where [[:customer/name "Customer#000000001"] :customer/acctbal ?b]]', "SELECT c_acctbal AS b FROM customer WHERE c_name = 'Customer#000000001'")
datalog("attr_var", "[:find ?a ?v :in $ ?key :where [?e :nation/nationkey ?key] [?e ?a ?v] [(not= ?a \":nation/region\")]]", "SELECT ':nation/nationkey' AS a, CAST(n_nationkey AS VARCHAR) AS v FROM nation WHERE n_nationkey = 3 UNION ALL SELECT ':nation/name', n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT ':nation/regionkey', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey = 3", 3)


def frame_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q("[:find ?u (count ?e) (sum ?v) :keys user n total :in $ev :where [$ev ?e _ ?u ?t ?v] [(= ?t \"purchase\")]]", spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")).df.withColumn("total", F.round("total", 2))


add("frame_source", frame_source, "SELECT user_id AS user, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type = 'purchase' GROUP BY user_id")

# -- or, not

datalog("or_simple", '[:find ?k :where [?o :order/orderkey ?k] (or [?o :order/orderstatus "F"] [?o :order/orderstatus "P"])]', "SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'P')")
datalog("or_and", '[:find ?k :where [?o :order/orderkey ?k] (or [?o :order/orderstatus "F"] (and [?o :order/orderstatus "O"] [?o :order/orderpriority "1-URGENT"]))]', "SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')")
datalog("or_join", '[:find ?name :where [?c :customer/name ?name] (or-join [?c] [?c :customer/mktsegment "BUILDING"] (and [?c :customer/acctbal ?b] [(> ?b 9000)]))]', "SELECT DISTINCT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 9000")
datalog("or_join_required", '[:find ?name ?t :where [?c :customer/name ?name] [?c :customer/acctbal ?b] (or-join [[?b] ?t] (and [(> ?b 5000)] [(ground "rich") ?t]) (and [(< ?b 0)] [(ground "debt") ?t]))]', "SELECT DISTINCT c_name AS name, CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE 'debt' END AS t FROM customer WHERE c_acctbal > 5000 OR c_acctbal < 0")
datalog("not_simple", '[:find ?name :where [?c :customer/name ?name] (not [?c :customer/mktsegment "BUILDING"])]', "SELECT DISTINCT c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING'")
datalog("not_join", "[:find ?name :where [?c :customer/name ?name] (not-join [?c] [?o :order/customer ?c] [?o :order/totalprice ?p] [(> ?p 300000)])]", "SELECT DISTINCT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
datalog("not_nested", '[:find ?k :where [?o :order/orderkey ?k] (not [?o :order/orderstatus "F"] (not [?o :order/orderpriority "1-URGENT"]))]', "SELECT DISTINCT o_orderkey AS k FROM orders WHERE NOT (o_orderstatus = 'F' AND NOT o_orderpriority = '1-URGENT')")
datalog("not_or", '[:find ?k :where [?o :order/orderkey ?k] (not (or [?o :order/orderstatus "F"] [?o :order/orderpriority "1-URGENT"]))]', "SELECT DISTINCT o_orderkey AS k FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')")
datalog("anti_attr", "[:find ?id :where [?d :doc/doc-id ?id] (not [?d :label-of/quality _])]", "SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")

# -- rules

NATION_RULES = "[[(reach ?a ?b) [?a ?b]] [(reach ?a ?b) [?a ?c] (reach ?c ?b)]]"
STEP = "SELECT n_nationkey AS a, (n_nationkey * {k} + 1) % 25 AS b FROM nation"
CLOSURE = "WITH RECURSIVE e AS ({step}), r(a, b) AS (SELECT a, b FROM e UNION SELECT e.a, r.b FROM e JOIN r ON e.b = r.a) SELECT a, b FROM r"


def edges(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * k + 1) % 25).alias("b"))


add("rule_tc", lambda s, d: q("[:find ?a ?b :in $ % :where (reach ?a ?b)]", edges(s, d, 2), NATION_RULES).df, CLOSURE.format(step=STEP.format(k=2)))
add("rule_cycle", lambda s, d: q("[:find ?a ?b :in $ % :where (reach ?a ?b)]", edges(s, d, 1), NATION_RULES).df, CLOSURE.format(step=STEP.format(k=1)))
add("rule_symmetric", lambda s, d: q("[:find ?a ?b :in $ % :where (near ?a ?b)]", edges(s, d, 5), "[[(near ?a ?b) [?a ?b] [(< ?b 12)]] [(near ?a ?b) (near ?b ?a)]]").df, f"WITH e AS ({STEP.format(k=5)}) SELECT a, b FROM e WHERE b < 12 UNION SELECT b, a FROM e WHERE b < 12")
add(
    "rule_mutual", lambda s, d: q("[:find ?a ?b :in $ % :where (odd ?a ?b) [(< ?a 6)]]", edges(s, d, 2), "[[(odd ?a ?b) [?a ?b]] [(odd ?a ?b) [?a ?c] (even ?c ?b)] [(even ?a ?b) [?a ?c] (odd ?c ?b)]]").df,
    f"WITH RECURSIVE e AS ({STEP.format(k=2)}), r(a, b, p) AS (SELECT a, b, 1 FROM e UNION SELECT e.a, r.b, 1 - r.p FROM e JOIN r ON e.b = r.a) SELECT DISTINCT a, b FROM r WHERE p = 1 AND a < 6",
)
datalog("rule_inline", "[:find ?name :in $ % :where (rich ?c) [?c :customer/name ?name] [?c :customer/acctbal _]]", "SELECT DISTINCT c_name AS name FROM customer WHERE c_acctbal > 8000", "[[(rich ?c) [?c :customer/acctbal ?b] [(> ?b 8000)]]]")
datalog("rule_branches", "[:find ?name :in $ % :where (good ?c) [?c :customer/name ?name]]", "SELECT DISTINCT c_name AS name FROM customer WHERE c_acctbal > 9000 OR c_mktsegment = 'MACHINERY'", '[[(good ?c) [?c :customer/acctbal ?b] [(> ?b 9000)]] [(good ?c) [?c :customer/mktsegment "MACHINERY"]]]')


def is_even(x: int) -> bool:
    return x % 2 == 0


datalog("rule_function", "[:find ?k :in $ % ?pred :where [?p :part/partkey ?k] (passes ?pred ?k)]", "SELECT p_partkey AS k FROM part WHERE p_partkey % 2 = 0", "[[(passes ?f ?x) [(?f ?x)]]]", is_even)


add(
    "rule_source", lambda s, d: q("[:find ?name :in $ $n % :where ($n asian ?k) [?c :customer/nationkey ?k] [?c :customer/name ?name]]", star(s, d, "customer"), star(s, d, "region", "nation"), '[[(asian ?k) [?n :nation/nationkey ?k] [?n :nation/region ?r] [?r :region/name "ASIA"]]]').df,
    "SELECT DISTINCT c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)

# -- shapes and aggregates

datalog("find_coll", "[:find [?n ...] :where [_ :nation/name ?n]]", "SELECT DISTINCT n_name AS n FROM nation")
datalog("find_scalar", "[:find (max ?b) . :where [_ :customer/acctbal ?b]]", "SELECT max(c_acctbal) AS max_b FROM customer")
datalog("find_tuple", "[:find [(min ?b) (max ?b)] :where [_ :customer/acctbal ?b]]", "SELECT min(c_acctbal) AS min_b, max(c_acctbal) AS max_b FROM customer")
datalog("return_map", "[:find ?n ?b :keys name balance :where [?c :customer/name ?n] [?c :customer/acctbal ?b]]", "SELECT DISTINCT c_name AS name, c_acctbal AS balance FROM customer")
datalog("with_bag", "[:find ?q :with ?l :where [?l :line/quantity ?q]]", "SELECT l_quantity AS q FROM lineitem")
datalog("agg_count", "[:find ?s (count ?o) :where [?o :order/orderstatus ?s]]", "SELECT o_orderstatus AS s, count(*) AS count_o FROM orders GROUP BY 1")
datalog("agg_count_distinct", "[:find ?s (count-distinct ?c) :with ?o :where [?o :order/orderstatus ?s] [?o :order/custkey ?c]]", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS count_distinct_c FROM orders GROUP BY 1")
datalog("agg_sum", "[:find ?s (sum ?p) :with ?o :where [?o :order/orderstatus ?s] [?o :order/totalprice ?p]]", "SELECT o_orderstatus AS s, round(sum(o_totalprice), 2) AS sum_p FROM orders GROUP BY 1", round_=("sum_p",))
datalog("agg_avg", "[:find ?s (avg ?p) :with ?o :where [?o :order/orderstatus ?s] [?o :order/totalprice ?p]]", "SELECT o_orderstatus AS s, round(avg(o_totalprice), 2) AS avg_p FROM orders GROUP BY 1", round_=("avg_p",))
datalog("agg_min_max", "[:find ?s (min ?p) (max ?p) :where [?o :order/orderstatus ?s] [?o :order/totalprice ?p]]", "SELECT o_orderstatus AS s, min(o_totalprice) AS min_p, max(o_totalprice) AS max_p FROM orders GROUP BY 1")
datalog("agg_set_semantics", "[:find (sum ?q) :where [?l :line/quantity ?q]]", "SELECT sum(DISTINCT l_quantity) AS sum_q FROM lineitem")
datalog("agg_median", "[:find ?f (median ?q) :with ?l :where [?l :line/returnflag ?f] [?l :line/quantity ?q]]", "SELECT l_returnflag AS f, median(l_quantity) AS median_q FROM lineitem GROUP BY 1")
datalog("agg_variance", "[:find ?f (variance ?q) (stddev ?q) :with ?l :where [?l :line/returnflag ?f] [?l :line/quantity ?q]]", "SELECT l_returnflag AS f, round(var_pop(l_quantity), 2) AS variance_q, round(stddev_pop(l_quantity), 2) AS stddev_q FROM lineitem GROUP BY 1", round_=("variance_q", "stddev_q"))
joined = lambda c: lambda df: df.withColumn(c, F.array_join(F.col(c).cast("array<string>"), ","))
datalog("agg_min_n", "[:find ?n (min 3 ?k) :where [?c :customer/nationkey ?n] [?c :customer/custkey ?k]]", "SELECT c_nationkey AS n, array_to_string(list_sort(list(DISTINCT c_custkey))[1:3], ',') AS min_k FROM customer GROUP BY 1", then=joined("min_k"))
datalog("agg_max_n", "[:find ?n (max ?amount ?k) :keys n top :in $ ?amount :where [?c :customer/nationkey ?n] [?c :customer/custkey ?k]]", "SELECT c_nationkey AS n, array_to_string(list_sort(list_sort(list(DISTINCT c_custkey), 'DESC')[1:3]), ',') AS top FROM customer GROUP BY 1", 3, then=joined("top"))
datalog("agg_distinct", "[:find ?s (distinct ?p) :where [?o :order/orderstatus ?s] [?o :order/orderpriority ?p]]", "SELECT o_orderstatus AS s, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS distinct_p FROM orders GROUP BY 1", then=joined("distinct_p"))
datalog("agg_empty", "[:find (count ?c) :where [?c :customer/acctbal ?b] [(> ?b 1000000)]]", "SELECT count(*) AS count_c FROM customer WHERE c_acctbal > 1000000 HAVING count(*) > 0")


def spread_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom aggregate: a vectorised function over each group's values."""

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return q("[:find ?s (aggregate ?f ?p) :keys s spread :with ?o :in $ ?f :where [?o :order/orderstatus ?s] [?o :order/totalprice ?p]]", star(spark, sf_dir, "order"), spread).df.withColumn("spread", F.round("spread", 2))


add("agg_custom", spread_of, "SELECT o_orderstatus AS s, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY 1")

# -- functions

datalog("fn_arith", "[:find ?k ?a ?b ?c ?d :where [?p :part/partkey ?k] [?p :part/size ?s] [(+ ?s 10 1) ?a] [(- ?s 3) ?b] [(* ?s 2) ?c] [(/ ?s 4) ?d]]", "SELECT p_partkey AS k, CAST(p_size + 11 AS BIGINT) AS a, CAST(p_size - 3 AS BIGINT) AS b, CAST(p_size * 2 AS BIGINT) AS c, p_size / 4.0::DOUBLE AS d FROM part")
datalog("fn_quot_rem_mod", "[:find ?k ?a ?b ?c :where [?p :part/partkey ?k] [?p :part/size ?s] [(- 25 ?s) ?t] [(quot ?t 4) ?a] [(rem ?t 4) ?b] [(mod ?t 4) ?c]]", "SELECT p_partkey AS k, CAST((25 - p_size) // 4 AS BIGINT) AS a, CAST((25 - p_size) % 4 AS BIGINT) AS b, CAST((((25 - p_size) % 4) + 4) % 4 AS BIGINT) AS c FROM part")
datalog("fn_inc_dec_minmax", "[:find ?k ?a ?b ?c ?d :where [?p :part/partkey ?k] [?p :part/size ?s] [(inc ?s) ?a] [(dec ?s) ?b] [(max ?s 20) ?c] [(min ?s 20) ?d]]", "SELECT p_partkey AS k, p_size + 1 AS a, p_size - 1 AS b, CAST(greatest(p_size, 20) AS BIGINT) AS c, CAST(least(p_size, 20) AS BIGINT) AS d FROM part")
datalog("fn_parity", "[:find ?k :where [?p :part/partkey ?k] [(odd? ?k)]]", "SELECT p_partkey AS k FROM part WHERE p_partkey % 2 = 1")
datalog("fn_sign", "[:find ?name :where [?c :customer/name ?name] [?c :customer/acctbal ?b] [(neg? ?b)]]", "SELECT c_name AS name FROM customer WHERE c_acctbal < 0")
datalog("fn_str", '[:find ?k ?s ?u ?n :where [?p :part/partkey ?k] [?p :part/brand ?b] [?p :part/type ?t] [(str ?b "-" ?t) ?s] [(subs ?b 0 5) ?u] [(count ?b) ?n]]', "SELECT p_partkey AS k, concat(p_brand, '-', p_type) AS s, substr(p_brand, 1, 5) AS u, CAST(length(p_brand) AS BIGINT) AS n FROM part")
datalog("fn_string_preds", '[:find ?n :where [_ :nation/name ?n] [(clojure.string/starts-with? ?n "NATION_1")] [(clojure.string/ends-with? ?n "2")] [(clojure.string/includes? ?n "A")]]', "SELECT n_name AS n FROM nation WHERE starts_with(n_name, 'NATION_1') AND ends_with(n_name, '2') AND contains(n_name, 'A')")
datalog("fn_regex", '[:find ?name ?d :where [?c :customer/name ?name] [(re-pattern "[1-9][0-9]*$") ?p] [(re-find ?p ?name) ?d] [(re-matches #"Customer.*[02468]" ?name)]]', "SELECT c_name AS name, regexp_extract(c_name, '[1-9][0-9]*$') AS d FROM customer WHERE regexp_full_match(c_name, 'Customer.*[02468]') AND regexp_matches(c_name, '[1-9][0-9]*$')")
datalog("fn_re_seq", '[:find ?k ?w :where [?p :part/partkey ?k] [?p :part/name ?n] [(re-seq #"[a-z]+" ?n) [?w ...]]]', "SELECT DISTINCT p_partkey AS k, unnest(regexp_extract_all(p_name, '[a-z]+')) AS w FROM part")
datalog("fn_ground_coll", "[:find ?s ?k :where [(ground [1 2 3]) [?s ...]] [?p :part/size ?s] [?p :part/partkey ?k]]", "SELECT p_size AS s, p_partkey AS k FROM part WHERE p_size IN (1, 2, 3)", then=lambda df: df.withColumn("s", F.col("s").cast("int")))
datalog("fn_range", "[:find ?k ?i :where [?n :nation/nationkey ?k] [(range ?k) [?i ...]]]", "SELECT n_nationkey AS k, unnest(range(n_nationkey)) AS i FROM nation")
datalog("fn_tuple_untuple", "[:find ?n ?k :where [?x :nation/nationkey ?a] [?x :nation/name ?b] [(tuple ?a ?b) ?t] [(untuple ?t) [?k ?n]]]", "SELECT n_name AS n, n_nationkey AS k FROM nation")
datalog("fn_get_else", "[:find ?id ?q :where [?d :doc/doc-id ?id] [(get-else $ ?d :label-of/quality -1) ?q]]", "SELECT d.doc_id AS id, CAST(coalesce(quality, -1) AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
datalog("fn_get_some", "[:find ?id ?a ?v :where [?d :doc/doc-id ?id] [(get-some $ ?d :label-of/toxic :doc/n-chars) [?a ?v]]]", "SELECT d.doc_id AS id, CASE WHEN toxic IS NOT NULL THEN ':label-of/toxic' ELSE ':doc/n-chars' END AS a, CAST(coalesce(toxic, n_chars) AS BIGINT) AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
datalog("fn_missing", "[:find ?id :where [?d :doc/doc-id ?id] [(missing? $ ?d :label-of/quality)]]", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
datalog("fn_missing_reverse", "[:find ?k :where [?c :customer/custkey ?k] [(missing? $ ?c :order/_customer)]]", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
datalog("fn_unify", "[:find ?a ?b :where [?p :part/size ?a] [(* ?a 2) ?b] [?x :part/size ?b]]", "SELECT DISTINCT a.p_size AS a, b.p_size AS b FROM part a JOIN part b ON b.p_size = a.p_size * 2", then=lambda df: df.withColumn("b", F.col("b").cast("int")))
datalog("fn_compare", "[:find ?k ?c :where [?p :part/partkey ?k] [?p :part/size ?s] [(compare ?s 25) ?c]]", "SELECT p_partkey AS k, CAST(CASE WHEN p_size < 25 THEN -1 WHEN p_size > 25 THEN 1 ELSE 0 END AS BIGINT) AS c FROM part")
datalog("fn_logic", "[:find ?k ?x :where [?p :part/partkey ?k] [?p :part/size ?s] [(> ?s 25) ?big] [(even? ?k) ?even] [(and ?big ?even) ?x]]", "SELECT p_partkey AS k, p_size > 25 AND p_partkey % 2 = 0 AS x FROM part")
datalog("fn_keyword", '[:find ?n ?x ?y :where [_ :nation/name ?n] [(keyword "nation" ?n) ?k] [(name ?k) ?x] [(namespace ?k) ?y]]', "SELECT n_name AS n, n_name AS x, 'nation' AS y FROM nation")
datalog("fn_differ", "[:find ?a ?b :where [_ :nation/regionkey ?a] [_ :region/regionkey ?b] [(-differ? ?a ?b)]]", "SELECT DISTINCT n_regionkey AS a, r_regionkey AS b FROM nation CROSS JOIN region WHERE n_regionkey <> r_regionkey")


def shout(n: str) -> str:
    return n.lower() + "!"


def letters(n: str) -> list[str]:
    return sorted(set(n))


add("fn_udf", lambda s, d: q("[:find ?n ?x :in $ ?f :where [_ :nation/name ?n] [(?f ?n) ?x]]", star(s, d, "nation"), shout).df, "SELECT n_name AS n, lower(n_name) || '!' AS x FROM nation")
add("fn_udtf", lambda s, d: q("[:find ?n ?c :in $ ?f :where [_ :region/name ?n] [(?f ?n) [?c ...]]]", star(s, d, "region"), letters).df, "SELECT DISTINCT r_name AS n, unnest(string_split(r_name, '')) AS c FROM region")

# -- ordered access and database values

def local_key(df: DataFrame, span: int = 1 << 40) -> DataFrame:
    return df.withColumn("e", F.col("e") % F.lit(span))


add("idx_datoms", lambda s, d: local_key(datoms(star(s, d, "nation"), ":aevt", K("nation/name"))).select("e", "v"), "SELECT CAST(n_nationkey AS BIGINT) AS e, n_name AS v FROM nation")
add("idx_range", lambda s, d: local_key(index_range(star(s, d, "customer"), K("customer/acctbal"), 100, 900)).select("e", "v"), "SELECT c_custkey AS e, c_acctbal AS v FROM customer WHERE c_acctbal BETWEEN 100 AND 900")
add("idx_topk", lambda s, d: local_key(datoms(star(s, d, "customer"), ":avet", K("customer/acctbal")).orderBy(F.desc("v"), "e").limit(10)).select("e", "v"), "SELECT c_custkey AS e, c_acctbal AS v FROM customer ORDER BY v DESC, e LIMIT 10")
add("idx_seek", lambda s, d: local_key(seek_datoms(star(s, d, "nation"), ":avet", K("nation/name"), "NATION_2").where("a = ':nation/name'")).select("e", F.col("v.s").alias("v")), "SELECT CAST(n_nationkey AS BIGINT) AS e, n_name AS v FROM nation WHERE n_name >= 'NATION_2'")
add("idx_rseek", lambda s, d: local_key(rseek_datoms(star(s, d, "nation"), ":avet", K("nation/name"), "NATION_2").where("a = ':nation/name'")).select("e", F.col("v.s").alias("v")), "SELECT CAST(n_nationkey AS BIGINT) AS e, n_name AS v FROM nation WHERE n_name <= 'NATION_2'")
add("idx_find", lambda s, d: local_key(datoms(star(s, d, "customer"), ":avet", K("customer/acctbal")).limit(1)).select("e", "v"), "SELECT c_custkey AS e, c_acctbal AS v FROM customer ORDER BY v, e LIMIT 1")
add("idx_count", lambda s, d: star(s, d, "region", "nation").tagged().groupBy("a").agg(F.count(F.lit(1)).alias("n")), "SELECT ':region/regionkey' AS a, count(*) AS n FROM region UNION ALL SELECT ':region/name', count(*) FROM region UNION ALL SELECT ':nation/' || x, count(*) FROM nation, (VALUES ('nationkey'), ('name'), ('regionkey'), ('region')) v(x) GROUP BY x")
add("db_filter", lambda s, d: q("[:find ?n :where [?c :customer/name ?n] [?c :customer/acctbal ?b]]", star(s, d, "customer").filter(by_column(lambda f: (f.e % 2) == 0))).df, "SELECT c_name AS n FROM customer WHERE c_custkey % 2 = 0")
add("db_filter_compose", lambda s, d: q("[:find ?n :where [?c :customer/name ?n]]", star(s, d, "customer").filter(by_column(lambda f: (f.e % 2) == 0)).filter(by_column(lambda f: (f.e % 3) == 0))).df, "SELECT c_name AS n FROM customer WHERE (c_custkey + 1099511627776) % 3 = 0 AND c_custkey % 2 = 0")


def two_views(s: SparkSession, d: str) -> tuple:
    db = star(s, d, "customer")
    return db.filter(by_column(lambda f: (f.e % 2) == 0)), db.filter(by_column(lambda f: (f.e % 3) == 0))


def keys_of(df: DataFrame) -> DataFrame:
    return local_key(df.where("a = ':customer/custkey'")).select("e")


add("db_diff_left", lambda s, d: keys_of(diff(*two_views(s, d))[0]), "SELECT c_custkey AS e FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey + 1099511627776) % 3 <> 0")
add("db_diff_both", lambda s, d: keys_of(diff(*two_views(s, d))[2]), "SELECT c_custkey AS e FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey + 1099511627776) % 3 = 0")

# -- transactions over tables


def transacted(items: Callable[[Any], list], text: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        db = star(s, d, "nation", "region")
        db = db.with_schema({**db.schema.spec, K("nation/name"): {K("db/unique"): K("db.unique/identity")}, K("nation/key+name"): {K("db/tupleAttrs"): [K("nation/nationkey"), K("nation/name")]}})
        return q(text, db_with(db, items(db))).df

    return run


NAMES = "[:find ?k ?n :where [?x :nation/nationkey ?k] [?x :nation/name ?n]]"
add("tx_add_replace", transacted(lambda db: [[K("db/add"), db.eid("nation", 3), K("nation/name"), "ICELAND"]], NAMES), "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 3 THEN 'ICELAND' ELSE n_name END AS n FROM nation")
add("tx_retract", transacted(lambda db: [[K("db/retract"), db.eid("nation", 3), K("nation/name")]], NAMES), "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey <> 3")
add("tx_upsert", transacted(lambda db: [{K("nation/name"): "NATION_3", K("nation/regionkey"): 0}], "[:find ?n ?r :where [?x :nation/name ?n] [?x :nation/regionkey ?r]]"), "SELECT n_name AS n, CASE WHEN n_name = 'NATION_3' THEN 0 ELSE n_regionkey END AS r FROM nation")
add("tx_cas", transacted(lambda db: [[K("db/cas"), db.eid("nation", 3), K("nation/regionkey"), 3, 4]], "[:find ?k ?r :where [?x :nation/nationkey ?k] [?x :nation/regionkey ?r]]"), "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 3 THEN 4 ELSE n_regionkey END AS r FROM nation")
add("tx_retract_entity", transacted(lambda db: [[K("db/retractEntity"), db.eid("nation", 3)]], NAMES), "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey <> 3")
add("tx_tuple", transacted(lambda db: [[K("db/add"), db.eid("nation", 3), K("nation/name"), "ICELAND"]], "[:find ?k ?n :where [?x :nation/key+name ?t] [(untuple ?t) [?k ?n]]]"), "SELECT CAST(3 AS BIGINT) AS k, 'ICELAND' AS n")


def bulk_prices(s: SparkSession, d: str) -> DataFrame:
    """Set-oriented: every part gets a new size, changed or not; the changes that this makes."""
    db = star(s, d, "part")
    rows = s.read.parquet(f"{d}/part.parquet").select("p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"), "p_partkey")
    report = bulk(db, rows.withColumn("e", F.col("p_partkey") + F.lit(db.offset("part"))), {K("part/size"): "size"}, key="e")
    return report.tx_data.select((F.col("e") % F.lit(1 << 40)).alias("k"), "v", "added")


add("tx_bulk", bulk_prices, "SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS v, false AS added FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, CAST(p_size + 1 AS VARCHAR), true FROM part WHERE p_partkey % 2 = 0")

# -- pull and entities

add("pull_flat", lambda s, d: pull_frame(star(s, d, "customer"), "[:customer/name :customer/acctbal]").select("pulled.*"), "SELECT c_name AS customer_name, c_acctbal AS customer_acctbal FROM customer")
add("pull_nested", lambda s, d: pull_frame(star(s, d, "region", "nation"), "[:nation/name {:nation/region [:region/name]}]").select("pulled.nation_name", "pulled.nation_region.region_name"), "SELECT n_name AS nation_name, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey")
add("pull_reverse", lambda s, d: pull_frame(star(s, d, "region", "nation"), "[:region/name {:nation/_region [:nation/name]}]").select("pulled.region_name", F.explode(F.col("pulled")["nation__region"]).alias("x")).select("region_name", "x.nation_name"), "SELECT r_name AS region_name, n_name AS nation_name FROM region JOIN nation ON n_regionkey = r_regionkey")
add("pull_limit", lambda s, d: pull_frame(star(s, d, "region", "nation"), "[:region/name {(:nation/_region :limit 2) [:nation/nationkey]}]").select("pulled.region_name", F.explode(F.col("pulled")["nation__region"]).alias("x")).select("region_name", "x.nation_nationkey"), "SELECT r_name AS region_name, n_nationkey AS nation_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) JOIN region ON n_regionkey = r_regionkey WHERE i <= 2")
add("pull_default", lambda s, d: pull_frame(star(s, d, "doc", "label-of"), "[:doc/doc-id (:label-of/quality :default -1 :as :q)]").where("pulled.doc_doc_id IS NOT NULL").select("pulled.doc_doc_id", "pulled.q"), "SELECT d.doc_id AS doc_doc_id, CAST(coalesce(quality, -1) AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
add("pull_wildcard", lambda s, d: pull_frame(star(s, d, "region"), "[*]").select((F.col("pulled.db_id") % F.lit(1 << 40)).alias("id"), "pulled.region_name", "pulled.region_regionkey"), "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS region_name, r_regionkey AS region_regionkey FROM region")
add("pull_in_find", lambda s, d: q('[:find ?k (pull ?o [:order/orderkey {:order/customer [:customer/name]}]) :where [?o :order/orderkey ?k] [?o :order/orderstatus "P"]]', star(s, d, "customer", "order")).df.select("k", "pull_o.order_customer.customer_name"), "SELECT o_orderkey AS k, c_name AS customer_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")


def recursive_pull(s: SparkSession, d: str) -> DataFrame:
    """Nations linked in a chain by a transaction, pulled two steps deep."""
    db = star(s, d, "nation")
    db = db.with_schema({**db.schema.spec, K("nation/next"): {K("db/valueType"): K("db.type/ref")}})
    db = db_with(db, [[K("db/add"), db.eid("nation", i), K("nation/next"), db.eid("nation", i + 1)] for i in range(5)])
    df = pull_frame(db, "[:nation/name {:nation/next 2}]")
    return df.select(F.col("pulled.nation_name").alias("a"), F.col("pulled.nation_next.nation_name").alias("b"), F.col("pulled.nation_next.nation_next.nation_name").alias("c")).where("c IS NOT NULL")


add("pull_recursive", recursive_pull, "SELECT a.n_name AS a, b.n_name AS b, c.n_name AS c FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 JOIN nation c ON c.n_nationkey = b.n_nationkey + 1 WHERE c.n_nationkey <= 5")


def touched(s: SparkSession, d: str) -> DataFrame:
    e = entity(star(s, d, "customer"), [K("customer/name"), "Customer#000000001"])
    return s.createDataFrame([(str(k), str(v)) for k, v in e.touch().items() if k in (K("customer/name"), K("customer/mktsegment"))], "a string, v string")


add("entity_touch", touched, "SELECT ':customer/name' AS a, c_name AS v FROM customer WHERE c_name = 'Customer#000000001' UNION ALL SELECT ':customer/mktsegment', c_mktsegment FROM customer WHERE c_name = 'Customer#000000001'")


def round_trip(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/nation.parquet").collect()
    db = init_db([x for r in rows for x in ((r["n_nationkey"] + 1, K("name"), r["n_name"]), (r["n_nationkey"] + 1, K("region"), r["n_regionkey"]))], spark=s)
    return q("[:find ?n ?r :where [?e :name ?n] [?e :region ?r]]", from_json(to_json(db), s)).df


add("serialize_roundtrip", round_trip, "SELECT n_name AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation")


def listened(s: SparkSession, d: str) -> DataFrame:
    """What a listener hears of a stream of events whose micro-batches are transactions."""
    conn, heard = create_conn({K("type/name"): {K("db/unique"): K("db.unique/identity")}}, s), []
    conn.listen(heard.append)
    events = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    items = lambda batch: [{K("type/name"): r["event_type"], K("type/count"): r["n"]} for r in batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()]
    query = conn.sink(events, items).option("checkpointLocation", f"{shared_folder(s)}/loomlog-stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    return q("[:find ?t ?n :where [?e :type/name ?t] [?e :type/count ?n]]", conn.db).df


add("stream_tx", listened, "SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1")


def hourly(s: SparkSession, d: str) -> DataFrame:
    df = s.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(df, "ts", "value", "1 day", by="event_type").select(F.col("window.start").cast("date").cast("string").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


add("stream_windows", hourly, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")


__all__ = ["QUERIES", "SQL"]

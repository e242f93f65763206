import pytest

from loomlog import DatalogError, Keyword, by_column, datoms, diff, empty_db, entity, index_range, pull, pull_many, q, seek_datoms
from loomlog.sources.db import chunks, datafy, empty
from loomlog.operators.transact import bulk, db_with, with_
from loomlog.sources.storage import Storage, db_string, from_json, read_db, serializable, squuid, squuid_time_millis, to_json
from loomlog.streaming.conn import changes, conn_from_db, latest

K = Keyword
SCHEMA = {
    K("aka"): {K("db/cardinality"): K("db.cardinality/many")}, K("name"): {K("db/unique"): K("db.unique/identity")}, K("email"): {K("db/unique"): K("db.unique/value")},
    K("friend"): {K("db/valueType"): K("db.type/ref")}, K("part"): {K("db/valueType"): K("db.type/ref"), K("db/cardinality"): K("db.cardinality/many"), K("db/isComponent"): True},
    K("a+b"): {K("db/tupleAttrs"): [K("a"), K("b")]}, K("age"): {K("db/index"): True},
}


@pytest.fixture
def db(spark):
    return db_with(empty_db(SCHEMA, spark), '[{:db/id 1 :name "Ivan" :age 15 :aka ["X" "Y"] :friend 2} {:db/id 2 :name "Petr" :age 37}]')


def facts(db):
    return {(d.e, d.a, d.v if not isinstance(d.v, list) else tuple(d.v)) for d in db.local_datoms()}


def test_add_and_retract(db):
    r = with_(db, "[[:db/add 1 :age 16] [:db/add 1 :aka \"Z\"] [:db/add 1 :aka \"X\"] [:db/retract 2 :age 37] [:db/retract 2 :age 99]]")
    assert [(d.e, d.a, d.v, d.added) for d in r.tx_data] == [(1, K("age"), 15, False), (1, K("age"), 16, True), (1, K("aka"), "Z", True), (2, K("age"), 37, False)]
    assert r.db_before == db and r.db_after != db


def test_tempids_and_upsert(db):
    r = with_(db, '[{:db/id -1 :name "Oleg" :friend -2} {:db/id -2 :name "Ivan" :age 20}]')
    assert r.tempids[-1] == 3 and r.tempids[-2] == 1
    assert (3, K("friend"), 1) in facts(r.db_after) and (1, K("age"), 20) in facts(r.db_after)
    assert with_(db, '[[:db/add -1 :age 5] [:db/add -1 :name "Petr"]]').tempids[-1] == 2
    with pytest.raises(DatalogError, match="Conflicting upsert"):
        with_(db, '[{:db/id 2 :name "Ivan"}]')


def test_constraints(db):
    one = db_with(db, '[[:db/add 1 :email "i@"]]')
    with pytest.raises(DatalogError, match="because of unique constraint"):
        with_(one, '[[:db/add 2 :email "i@"]]')
    with pytest.raises(DatalogError, match="Cannot store nil"):
        with_(db, "[[:db/add 1 :age nil]]")
    with pytest.raises(DatalogError, match="failed on datom"):
        with_(db, "[[:db/cas 1 :age 16 17]]")
    with pytest.raises(DatalogError, match="Tempids used only as value"):
        with_(db, "[[:db/add 1 :friend -7]]")
    assert (1, K("age"), 17) in facts(db_with(db, "[[:db/cas 1 :age 15 17]]"))


def test_components_and_nested(db):
    own = db_with(db, '[{:name "Car" :part [{:name "Engine" :part [{:name "Bolt"}]} {:name "Door"}]}]')
    car = own.entid([K("name"), "Car"])
    assert entity(own, car).touch()[K("part")][0][K("part")][0][K("name")] == "Bolt"
    assert facts(db_with(own, [[K("db/retractEntity"), car]])) == facts(db)
    assert (1, K("friend"), 2) not in facts(db_with(own, "[[:db/retractEntity 2]]"))


def test_composite_tuples(db):
    one = db_with(db, "[{:db/id 1 :a 1 :b 2}]")
    assert (1, K("a+b"), (1, 2)) in facts(one)
    assert (1, K("a+b"), (1, None)) in facts(db_with(one, "[[:db/retract 1 :b 2]]"))
    with pytest.raises(DatalogError, match="modify tuple attrs directly"):
        with_(one, "[[:db/add 1 :a+b [3 4]]]")


def test_functions(db):
    grow = lambda d, e: [[K("db/add"), e, K("age"), entity(d, e)[K("age")] + 1]]
    assert (1, K("age"), 16) in facts(db_with(db, [[K("db.fn/call"), grow, 1]]))
    named = db_with(db, [{K("db/ident"): K("grow"), K("db/fn"): grow}])
    assert (2, K("age"), 38) in facts(db_with(named, [[K("grow"), 2]]))
    with pytest.raises(DatalogError, match="find entity for transaction fn"):
        with_(db, "[[:nope 1]]")


def test_pull(db):
    own = db_with(db, '[{:name "Car" :part [{:name "Engine"} {:name "Door"}]} [:db/add 2 :friend 1]]')
    assert pull(own, "[:name {:friend [:name]}]", 1) == {K("name"): "Ivan", K("friend"): {K("name"): "Petr"}}
    assert pull(own, "[:name {:friend ...}]", 1)[K("friend")][K("friend")] == {K("db/id"): 1}
    assert pull(own, "[(:missing :default 7 :as :m) (:aka :limit 1)]", 1) == {K("m"): 7, K("aka"): ["X"]}
    assert pull(own, "[{:_friend [:name]}]", 2) == {K("_friend"): [{K("name"): "Ivan"}]}
    assert pull_many(own, "[:name]", [1, 99, 2]) == [{K("name"): "Ivan"}, None, {K("name"): "Petr"}]
    assert len(pull(own, "[*]", [K("name"), "Car"])[K("part")]) == 2
    assert pull(own, [[K("age"), K("xform"), lambda x: x and x * 2]], 1) == {K("age"): 30}


def test_indexes_and_views(db):
    assert [(r["e"], r["v"]) for r in index_range(db, K("age"), 15, 20).collect()] == [(1, 15)]
    assert [r["e"] for r in datoms(db, ":avet", K("age")).collect()] == [1, 2]
    assert seek_datoms(db, ":eavt", 2).count() == 2
    with pytest.raises(DatalogError, match="should be marked as :db/index"):
        datoms(db, ":avet", K("aka"))
    view = db.filter(lambda _, d: d.a != K("age"))
    assert q("[:find ?a :where [1 :age ?a]]", view).value() == set() and view.is_filtered
    assert q("[:find ?e :where [?e :age]]", db.filter(by_column(lambda f: f.e > 1))).value() == {(2,)}
    with pytest.raises(DatalogError, match="Filtered DB"):
        with_(view, "[[:db/add 1 :age 1]]")
    a, b, both = diff(db, db_with(db, "[[:db/add 1 :age 16]]"))
    assert (a.count(), b.count(), both.count()) == (1, 1, len(db.local_datoms()) - 1)


def test_lookup_refs(db):
    assert q('[:find ?a . :where [[:name "Ivan"] :age ?a]]', db).value() == 15
    assert q("[:find ?e ?a :in $ ?e :where [?e :age ?a]]", db, [K("name"), "Ivan"]).value() == {((K("name"), "Ivan"), 15)}
    assert q("[:find ?e ?a :in $ [?e ...] :where [?e :age ?a]]", db, [[K("name"), "Ivan"], [K("name"), "Petr"]]).value() == {((K("name"), "Ivan"), 15), ((K("name"), "Petr"), 37)}
    assert datafy(db, 2)[K("_friend")] == [1] and empty(db).local_datoms() == [] and [len(c) for c in chunks(datoms(db, ":eavt"), 4)] == [4, 3]
    with pytest.raises(DatalogError, match="Nothing found for entity id"):
        q('[:find ?a :where [[:name "None"] :age ?a]]', db)
    with pytest.raises(DatalogError, match="should be marked as :db/unique"):
        db.entid([K("aka"), "X"])


def test_connection_and_feed(db, spark, tmp_path):
    conn, heard = conn_from_db(db), []
    key = conn.listen(heard.append)
    log = f"file://{tmp_path}/log"
    conn.log_to(log, spark)
    conn.transact('[{:name "Q" :age 1}]')
    conn.transact('[{:name "Q" :age 2}]')
    conn.unlisten(key)
    conn.transact_async('[[:db/add 1 :age 3]]').result()
    assert len(heard) == 2 and conn.db.entid([K("name"), "Q"]) == 3
    stream = changes(spark, log).writeStream.format("memory").queryName("feed").trigger(availableNow=True).start()
    stream.awaitTermination()
    left = {(r["e"], r["a"], r["v"]) for r in latest(spark.table("feed")).collect()}
    assert (3, ":age", "2") in left and (3, ":age", "1") not in left
    assert len(conn.reset(empty_db(spark=spark)).tx_data) == len(facts(db)) + 2 and conn.db.local_datoms() == []


def test_serialised_and_stored(db, spark, tmp_path):
    assert from_json(to_json(db), spark) == db and read_db(db_string(db), spark) == db
    odd = db_with(db, [[K("db/add"), 1, K("x"), float("inf")], [K("db/add"), 1, K("k"), K("some/kw")], [K("db/add"), 1, K("v"), [1, 2]]])
    assert facts(from_json(to_json(odd), spark)) == facts(odd) and serializable(odd)["count"] == len(facts(odd))
    store = Storage(spark, f"file://{tmp_path}/db", log_rows=3)
    store.store(db)
    r = with_(db, "[[:db/add 1 :age 16]]")
    store.append(r)
    assert store.restore() == r.db_after
    later = with_(r.db_after, '[{:name "A" :age 1} {:name "B"}]')
    store.append(later)  # the log is long: a new snapshot
    assert store.restore() == later.db_after and store.vacuum() == 2 and store.restore() == later.db_after
    assert squuid_time_millis(squuid(1_700_000_000_123)) == 1_700_000_000_000


def test_bulk(db, spark):
    rows = spark.createDataFrame([("Ivan", 20), ("Petr", 37), ("Nina", 5)], "n string, a long")
    report = bulk(db, rows, {K("name"): "n", K("age"): "a"}, identity=K("name"))
    assert {(r["_id"], r["_e"]) for r in report.ids.collect()} == {("Ivan", 1), ("Petr", 2), ("Nina", 3)}
    got = {(r["e"], r["a"], r["v"], r["added"]) for r in report.tx_data.collect()}
    assert got == {(1, ":age", "15", False), (1, ":age", "20", True), (3, ":name", "Nina", True), (3, ":age", "5", True)}
    assert {(r["e"], r["v"]) for r in report.attributes[K("age")].collect()} == {(1, 20), (2, 37), (3, 5)}


def test_schema_errors(spark):
    for bad in ({K("x"): {K("db/isComponent"): True}}, {K("x"): {K("db/cardinality"): K("some")}}, {K("t"): {K("db/tupleAttrs"): []}}):
        with pytest.raises(DatalogError):
            empty_db(bad, spark)


def test_more_than_a_thousand_references(spark):
    """Retraction, reverse attributes and pulls without a limit reach every reference to an entity."""
    n = 1200
    own = empty_db({}, spark).with_table("owner", spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), "id", {"name": "name"})
    own = own.with_table("thing", spark.range(n).selectExpr("id", "1L AS owner_id"), "id", {"owner": "owner_id"}, {"owner": "owner"})
    e = own.entid([K("owner/name"), "a"])
    assert len(own.having(K("thing/owner"), e)) == len(entity(own, e).get(K("thing/_owner"))) == n
    assert len(pull(own, "[(:thing/_owner :limit nil)]", e)[K("thing/_owner")]) == n and len(pull(own, "[:thing/_owner]", e)[K("thing/_owner")]) == 1000
    assert db_with(own, [[K("db/retractEntity"), e]]).having(K("thing/owner"), e) == []

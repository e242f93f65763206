import pytest

from loomlog.errors import DatalogError
from loomlog.plans import query as Q


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("[:find ?x]", "Query for unknown vars: [?x]"),
        ("[:find ?x :with ?x :where [?x :a]]", ":find and :with should not use same variables: [?x]"),
        ("[:find ?x :in $ ?y ?y :where [?x :a]]", "distinct"),
        ("[:find ?x :in ?x :where [?x :a]]", "unknown source vars"),
        ("[:find ?x :where (r ?x)]", "Missing rules var '%' in :in"),
        ("[:find ?x . :keys a :where [?x :a]]", "does not work with"),
        ("[:find ?x ?y :keys a :where [?x :a ?y]]", "Count of :keys must match count of :find"),
        ("[:find ?x :where (not)]", "Cannot parse 'not' clause"),
        ("[:find ?x :where []]", "Cannot parse clause"),
    ],
)
def test_messages(text, message):
    with pytest.raises(DatalogError, match=message.replace("[", r"\[").replace("?", r"\?").replace("(", r"\(")):
        Q.parse(text)


def test_map_form_and_default_in():
    a = Q.parse("{:find [?x] :where [[?x :a 1]]}")
    b = Q.parse("[:find ?x :where [?x :a 1]]")
    assert a.where == b.where and a.ins == b.ins and len(b.ins) == 1
    assert Q.parse("[:find ?x :where [(ground 1) ?x]]").ins == ()


def test_find_shapes():
    shape = lambda t: Q.parse(f"[:find {t} :where [?x :a ?y]]").shape
    assert [shape(t) for t in ("?x ?y", "[?x ...]", "?x .", "[?x ?y]")] == ["relation", "collection", "scalar", "tuple"]


def test_rules():
    rules = Q.parse_rules("[[(r ?a ?b) [?a :x ?b]] [(r ?a ?b) [?b :x ?a]]]")
    assert len(rules["r"].branches) == 2
    with pytest.raises(DatalogError, match="Arity mismatch"):
        Q.parse_rules("[[(r ?a ?b) [?a :x ?b]] [(r ?a) [?a :x]]]")
    with pytest.raises(DatalogError, match="distinct"):
        Q.parse_rules("[[(r ?a ?a) [?a :x]]]")

import math

import pytest

from loomlog.edn import EdnError, Keyword, Regex, Seq, Symbol, pr_str, read_string


@pytest.mark.parametrize("text", ["nil", "true", "[1 2.5 -3]", '{:a "b\\nc"}', "(foo ?x :k/w)", '#{1 2}', '#"a+"', "##Inf", '#uuid "6ba7b810-9dad-11d1-80b4-00c04fd430c8"'])
def test_round_trip(text):
    assert pr_str(read_string(pr_str(read_string(text)))) == pr_str(read_string(text))


def test_kinds():
    got = read_string('[:a/b sym (1) #"x" \\a ; comment\n #_ skipped 1/2 ##NaN]')
    assert got[0] == Keyword("a/b") and got[0] != ":a/b" and got[0].namespace == "a" and got[0].name == "b"
    assert isinstance(got[1], Symbol) and isinstance(got[2], Seq) and isinstance(got[3], Regex)
    assert got[4] == "a" and got[5] == 0.5 and math.isnan(got[6])


@pytest.mark.parametrize("text", ["[1", ")", '"a', "{:a}", "#nope 1"])
def test_errors(text):
    with pytest.raises(EdnError):
        read_string(text)

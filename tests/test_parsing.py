import pytest

from streamloom.functions.durations import format_duration, parse_duration
from streamloom.functions.tags import is_subset, parse_tags, print_tags, strip_tags
from streamloom.plans.alarm_grammar import AlarmError, Both, Leaf, parse_alarm
from streamloom.plans.compiler import canonical
from streamloom.plans.expr import Call, ExpressionError, Match, Raw, fill_template, parse, parse_match

CPU = "avg(cpu_util{t1=v1,t2=v2}, 5s)"
L1, L2, L3 = Leaf(CPU, ">", 30.0), Leaf("avg(sum(test))", ">", 16.0), Leaf("sum(test2)", "<", 13.0)


@pytest.mark.parametrize(
    ("text", "tree", "match_by"),
    [
        ("test > 15 times 3", Leaf("test", ">", 15.0, 3), ""),
        (f"{CPU} > 30.0 or avg(sum(test)) > 16.0 and sum(test2) < 13", Both("or", L1, Both("and", L2, L3)), ""),
        (f"({CPU} > 30.0 or avg(sum(test)) > 16.0) and sum(test2) < 13", Both("and", Both("or", L1, L2), L3), ""),
        (
            f"{CPU} > 30.0 or avg(sum(test{{t1=v1}})) > 16.0 and sum(test2) < 13, t1",
            Both("or", L1, Both("and", Leaf("avg(sum(test{t1=v1}))", ">", 16.0), L3)),
            "t1",
        ),
        ("a lte -2.5 || b gte 1e3 && c{x=y} lt 4", Both("or", Leaf("a", "<=", -2.5), Both("and", Leaf("b", ">=", 1000.0), Leaf("c{x=y}", "<", 4.0))), ""),
        ("test>15", Leaf("test", ">", 15.0), ""),
    ],
)
def test_alarm_trees(text, tree, match_by):
    alarm = parse_alarm(text)
    assert (alarm.tree, alarm.match_by) == (tree, match_by)
    assert parse_alarm(str(alarm)).tree == tree


@pytest.mark.parametrize("text", ["", "a >", "a > 1 or", "(a > 1", "a > 1 rubbish", "> 3", "a = 3"])
def test_alarm_errors(text):
    with pytest.raises(AlarmError):
        parse_alarm(text)


def test_match_definition():
    m = parse_match("cpu_util, user_perc by hostname, device in avg($1, $2)")
    assert m == Match((Raw("cpu_util"), Raw("user_perc")), ("hostname", "device"), "avg($1, $2)")
    assert fill_template("avg($1, $2)", ["a", "b"]) == "avg(a, b)"
    assert fill_template("alarm(avg(%s)<2 and avg(%s)>3)", ["a", "b"]) == "alarm(avg(a)<2 and avg(b)>3)"
    for bad in ("a in b", "a by b", "a by b in c by d", "a by , in c"):
        with pytest.raises(ExpressionError):
            parse_match(bad)


def test_nested_calls_and_tags_split_at_top_level():
    tree = parse("max(avg(x{a=1,b=2}, 1h), 1d)")
    assert tree == Call("max", Call("avg", Raw("x", (("a", "1"), ("b", "2"))), ("1h",)), ("1d",))
    for bad in ("avg(x, 5s", "avg x)", "avg(x}, 5s)", "(x, 5s)", ""):
        with pytest.raises(ExpressionError):
            parse(bad)


def test_canonical_text_is_shared():
    assert canonical("avg( x{b=2,a=1} ,60s)") == canonical("avg(x{a=1,b=2}, 1min)") == "avg(x{a=1,b=2}, 1m)"
    assert canonical("alarm(avg(x,60s) > 3.0)") == canonical("alarm(avg(x, 1m)>3)")


def test_durations():
    cases = {"5s": 5, "1h30m": 5400, "1.5h": 5400, "5min": 300, "10sec": 10, "7d": 604800, ".5m": 30}
    for text, sec in cases.items():
        assert parse_duration(text) == sec * 1_000_000_000
        assert parse_duration(format_duration(parse_duration(text))) == parse_duration(text)
    assert parse_duration("3ms4us5ns") == 3_004_005
    for bad in ("", "5", "s", "0s", "5 s", "-1s", "5x"):
        with pytest.raises(ValueError):
            parse_duration(bad)


def test_tags():
    assert parse_tags("m{a,b=2}") == {"b": "2"}
    assert parse_tags("m") == parse_tags("m{}") == {}
    assert print_tags("m", {"b": "2", "a": "1"}) == "m{a=1,b=2}"
    assert strip_tags("m{a=1}") == "m"
    assert strip_tags("{a=1}") == "{a=1}"
    assert is_subset({"t1": "v1"}, {"t1": "v1", "t2": "v2"})
    assert not is_subset({"t1": "v1", "t2": "v2"}, {"t1": "v1"})
    assert is_subset({"k": ""}, {})

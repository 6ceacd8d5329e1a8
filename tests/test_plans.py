"""Patterns, decompositions, labels: driver-side logic."""

import math

import pytest

from chronograft.functions.labels import draws
from chronograft.plans import decompose as d
from chronograft.plans.pattern import Pattern, PatternError, check, check_seed, of, parse

TRIANGLE = of("a:A b:B", "b:B c:C", "c:C a:A")


def test_parse_modes():
    p = parse("   # comment\n\nA B # directed arc\n")
    assert (p.labels, p.arcs) == (("A", "B"), ((0, 1),))
    p = parse("left:A center:B\ncenter:B right:A")
    assert (p.labels, p.arcs) == (("A", "B", "A"), ((0, 1), (1, 2)))
    assert parse("A B EXTRA\n#x\n", "loose").arcs == ((0, 1),)
    assert parse("a:x b:yy 7", "edges").arc_labels == ("7",)
    assert parse("x:A x:A").arcs == ((0, 0),)


@pytest.mark.parametrize(("text", "mode"), [("A B EXTRA", "strict"), ("A", "strict"), ("A F", "strict"), ("x:A x:B", "strict"), ("x:A x:A", "loose"), ("A B\n  \n", "loose"), ("", "strict"), ("a b c d", "edges"), (":A B", "strict")])
def test_parse_rejects(text, mode):
    with pytest.raises(PatternError):
        parse(text, mode)


def test_checks():
    check(TRIANGLE, 2, 2)
    for bad in (lambda: check(TRIANGLE, 1, 2), lambda: check(TRIANGLE, 0), lambda: check(of("a:A b:B", "c:C d:D")), lambda: check(Pattern(("A",), ())), lambda: check_seed("-1"), lambda: check_seed(1 << 32)):
        with pytest.raises(PatternError):
            bad()
    check(Pattern(("A",), ()), single_vertex=True)


def test_depth_first_trees():
    t = d.by_temporal(TRIANGLE, {"A": 1, "B": 2, "C": 4}, dict.fromkeys("ABC", 1.0))
    assert (t.root, t.order, t.non_tree) == (2, [2, 1, 0], [(2, 0)])
    t = d.by_topology(TRIANGLE, {"A": 1, "B": 2, "C": 4})
    assert (t.root, t.scores[0], t.order, t.non_tree) == (0, 0.5, [0, 1, 2], [(2, 0)])
    for t in (d.by_temporal(TRIANGLE, {}, {}), d.by_topology(TRIANGLE, {})):
        assert t.root == 0 and t.connected
    t = d.by_temporal(of("a:A b:B"), {"A": 1, "B": 10}, dict.fromkeys("AB", 1.0))
    assert (t.root, t.parent[0]) == (1, 1)
    recip = d.by_topology(of("x:A y:B", "y:B x:A"), {"A": 1, "B": 1})
    assert recip.non_tree == []


def test_other_trees():
    square = of("a:A b:B", "b:B c:C", "c:C e:D", "e:D a:A")
    ones = dict.fromkeys("ABCD", 1)
    t = d.breadth_first(square, ones, dict.fromkeys("ABCD", 2.0))
    assert (t.root, t.levels) == (0, {0: 0, 1: 1, 3: 1, 2: 2})
    t = d.minimum_spanning(square, ones, {"A": 1.0, "B": 1.0, "C": 9.0, "D": 9.0})
    assert t.removed == [(2, 3)] and t.connected and t.parent == {0: None, 1: 0, 3: 0, 2: 1}
    assert d.start_vertices(square, {"A": 4, "B": 1, "C": 2, "D": 3}) == [1, 2, 3]
    star = of("c:A x:B", "c:A y:B", "c:A z:C")
    assert d.equivalence_classes(star) == [[0], [1, 2], [3]]
    assert d.equivalence_classes(of("x:A y:A", "y:A x:A")) == [[0, 1]]
    assert d.equivalence_classes(of("x:A y:A")) == [[0], [1]]
    tree = d.by_topology(star, dict.fromkeys("ABC", 1))
    assert d.matching_order(tree, {1: 9, 2: 3, 3: 5}) == [0, 2, 3, 1]
    assert (d.combinations(5, 2), d.combinations(2, 5)) == (10.0, 0.0)
    assert math.isinf(d.score_inverse(of("a:A b:B"), ones, dict.fromkeys("AB", 1.0))[1])


def test_label_stream():
    stream = draws(42)
    assert "".join("ABCDE"[next(stream)] for _ in range(9)) == "BDEADDCCA"
    other = draws(43)
    assert [next(other) for _ in range(9)] != [1, 3, 4, 0, 3, 3, 2, 2, 0]


def test_root_by_label():
    pairs = [("A", "B"), ("B", "C"), ("A", "B")]
    assert d.choose_label(pairs, {"A": 4, "B": 4, "C": 3}) == "B"
    assert d.choose_label(pairs, {"A": 4, "B": 8, "C": 4}) == "A"
    assert d.choose_label(pairs, {"A": 4, "B": 8, "C": 4}, {"A": 1.0, "B": 1.0, "C": 2.0}) == "C"
    assert d.choose_label(pairs, {"B": 3, "C": 2}, {"B": 2.0}) == "B"
    with pytest.raises(ValueError, match="no label"):
        d.choose_label(pairs, {})

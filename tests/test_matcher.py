"""Matching fixtures, a brute-force oracle on random graphs, and metamorphic checks."""

from itertools import permutations

import pytest

from chronograft.functions.labels import seeded_labels
from chronograft.operators import candidates, matcher, snapshots, stats, variants
from chronograft.operators.graph import TemporalGraph
from chronograft.plans import decompose, pattern

TRIANGLE = pattern.of("a:A b:B", "b:B c:C", "c:C a:A")


def graph(spark, arcs, labels, prefilter=True):
    """arcs: {(src, dst): [(start, end), ...]}."""
    rows = [(u, v, t) for (u, v), spans in arcs.items() for a, b in spans for t in range(a, b + 1)]
    occ = spark.createDataFrame(rows, "src long, dst long, t int")
    return TemporalGraph.build(occ, spark.createDataFrame(list(labels.items()), "id long, label string"), prefilter)


def rows(df):
    return sorted(map(tuple, df.collect()))


COMMON = ({(10, 20): [(1, 5)], (20, 30): [(2, 6)], (30, 10): [(3, 7)], (40, 50): [(10, 12)], (50, 60): [(11, 13)], (60, 40): [(12, 14)]},
          {10: "A", 20: "B", 30: "C", 40: "A", 50: "B", 60: "C"})


def test_common_run(spark):
    g = graph(spark, *COMMON)
    assert rows(matcher.match(g, TRIANGLE, 3)) == [(10, 20, 30, 3, 5)]
    assert matcher.mappings(matcher.match(g, TRIANGLE, 3)).first()["active_text"] == "[3-5]"
    assert tuple(matcher.count(matcher.match(g, TRIANGLE, 3)).first()) == (1, False)
    assert rows(matcher.match(g, TRIANGLE, 4)) == []


@pytest.mark.parametrize(
    ("arcs", "labels", "p", "k", "prefilter", "want"),
    [
        ({(10, 20): [(1, 3)], (40, 30): [(1, 3)]}, {10: "A", 20: "B", 30: "A", 40: "B"}, ["x:A y:B"], 3, True, [(10, 20, 1, 3)]),
        ({(11, 22): [(1, 4)], (22, 11): [(2, 4)], (33, 44): [(10, 12)], (44, 33): [(12, 14)]}, {11: "A", 22: "B", 33: "A", 44: "B"}, ["x:A y:B", "y:B x:A"], 3, True, [(11, 22, 2, 4)]),
        ({(20, 10): [(1, 4)]}, {10: "A", 20: "B"}, ["x:A y:B"], 3, True, []),
        ({(1, 2): [(1, 4)], (2, 3): [(1, 4)]}, {1: "A", 2: "B", 3: "C"}, ["x:A y:B", "y:B z:C", "z:C x:A"], 3, True, []),
        ({(10, 10): [(1, 3)], (20, 20): [(1, 1), (3, 3)]}, {10: "A", 20: "A"}, ["x:A x:A"], 3, False, [(10, 1, 3)]),
        ({(10, 10): [(1, 3)]}, {10: "A"}, ["x:A y:A"], 3, False, []),
    ],
)
def test_cases(spark, arcs, labels, p, k, prefilter, want):
    assert rows(matcher.match(graph(spark, arcs, labels, prefilter), pattern.of(*p), k)) == want


def _random_rounds():
    state = 0x6D2B79F5

    def nxt():
        nonlocal state
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        return state

    for _ in range(32):
        arcs = {}
        for u in range(6):
            for v in range(6):
                if u != v and (mask := nxt() & 0x3F) and nxt() & 3:
                    arcs[u, v] = {i + 1 for i in range(6) if mask >> i & 1}
        yield arcs


def _brute(arcs, labels, p, k):
    found = 0
    for m in permutations(range(6), p.n):
        if all(labels[x] == y for x, y in zip(m, p.labels, strict=True)):
            common = set(range(1, 7))
            for a, b in p.arcs:
                common &= arcs.get((m[a], m[b]), set())
            found += any(all(t + i in common for i in range(k)) for t in common)
    return found


def test_random_graphs(spark):
    labels = dict(enumerate("ABCABC"))
    want = [0] * 32
    want[7], want[15], want[17], want[27] = 2, 1, 1, 1
    rounds = list(_random_rounds())
    assert [len(r) for r in rounds[:4]] == [26, 20, 25, 21]
    brute = [_brute(r, labels, TRIANGLE, 2) for r in rounds]
    assert brute == want
    # all rounds as one graph with ids apart
    occ = [(100 * i + u, 100 * i + v, t) for i, r in enumerate(rounds) for (u, v), ts in r.items() for t in ts]
    ids = [(100 * i + v, x) for i in range(32) for v, x in labels.items()]
    df, lab = spark.createDataFrame(occ, "src long, dst long, t int"), spark.createDataFrame(ids, "id long, label string")
    g, full = TemporalGraph.build(df, lab), TemporalGraph.build(df, lab, prefilter=False)
    got = [0] * 32
    for m in matcher.mappings(matcher.match(g, TRIANGLE, 2)).collect():
        got[m["q0"] // 100] += 1
    assert got == want
    assert rows(matcher.match(full, TRIANGLE, 2)) == rows(matcher.match(g, TRIANGLE, 2))
    for p, k in ((pattern.of("x:A y:B", "y:B z:C"), 2), (pattern.of("x:A y:A", "y:A z:B"), 2), (TRIANGLE, 1)):
        source = full if k == 1 else g
        n = matcher.count(matcher.match(source, p, k)).first()[0]
        assert n == sum(_brute(r, labels, p, k) for r in rounds)
    counts, life = stats.label_tables(g)
    for d in (decompose.by_temporal(TRIANGLE, counts, life), decompose.by_topology(TRIANGLE, counts)):
        t = candidates.reduced(g, TRIANGLE, d, 2)
        assert rows(matcher.match(g, TRIANGLE, 2, candidates=t.all())) == rows(matcher.match(g, TRIANGLE, 2))


def test_shipped_shape(spark):
    """Three triads: one on 1-4, one on 5-8 and 10-21, one too short."""
    arcs = {(1, 2): [(1, 4)], (1, 3): [(1, 4)], (2, 3): [(1, 4)], (7, 8): [(9, 9)], (7, 9): [(9, 9)], (8, 9): [(9, 9)]}
    arcs |= {a: [(5, 8), (10, 21)] for a in ((4, 5), (4, 6), (5, 6))}
    occ = spark.createDataFrame([(u, v, t) for (u, v), s in arcs.items() for a, b in s for t in range(a, b + 1)], "src long, dst long, t int")
    assert occ.count() == 63
    labels = seeded_labels(snapshots.universe(occ), 42)
    assert "".join(r["label"] for r in labels.orderBy("id").collect()) == "BDEADDCCA"
    g = TemporalGraph.build(occ, labels)
    assert g.arcs().count() == 6
    assert {r["id"]: r["active_duration"] for r in stats.durations(g).collect()} == {1: 4, 2: 4, 3: 4, 4: 16, 5: 16, 6: 16}
    assert matcher.mappings(matcher.match(g, pattern.parse("B D\nD E\nB E"), 3)).first()["active_text"] == "[1-4]"
    p = pattern.of("a:A x:D", "a:A y:D", "x:D y:D")
    shown = lambda k: [r["active_text"] for r in matcher.mappings(matcher.match(g, p, k)).collect()]
    assert (shown(3), shown(5), shown(12), shown(13)) == (["[5-8, 10-21]"], ["[10-21]"], ["[10-21]"], [])


def test_total_duration_and_direction(spark):
    g = graph(spark, {(1, 2): [(1, 1), (3, 3), (5, 5)], (2, 3): [(1, 5)]}, {1: "A", 2: "B", 3: "C"}, False)
    p = pattern.of("x:A y:B", "y:B z:C")
    assert rows(matcher.match(g, p, 3, durability="total")) == [(1, 2, 3, 3)]
    assert rows(matcher.match(g, p, 2)) == []
    occ = spark.createDataFrame([(2, 1, t) for t in (1, 2)], "src long, dst long, t int")
    lab = spark.createDataFrame([(1, "A"), (2, "B")], "id long, label string")
    assert rows(variants.time_sets(matcher.match(variants.either_direction_graph(occ, lab), pattern.of("x:A y:B"), 1), 2)) == [(1, 2, 2)]


def test_cap_and_deadline(spark):
    g = graph(spark, *COMMON)
    found, more = matcher.capped(matcher.match(g, pattern.of("x:A y:B"), 2), 1)
    assert len(found) == 1 and more
    assert matcher.within(spark, 0, lambda: 5) == (5, False)
    assert matcher.within(spark, 30, lambda: spark.range(3).count()) == (3, False)
    slow = lambda: spark.range(10**12).selectExpr("max(sin(id) * cos(id))").collect()
    assert matcher.within(spark, 1, slow)[1]


def test_counter_holds():
    top = (1 << 64) - 1
    assert stats.match_counter([top - 1, 1]) == (top, False)
    assert stats.match_counter([top - 1, 1, 1]) == (top, True)


def test_empty_graph(spark):
    occ = spark.createDataFrame([], "src long, dst long, t int")
    lab = spark.createDataFrame([], "id long, label string")
    g = TemporalGraph.build(occ, lab)
    assert rows(matcher.match(g, TRIANGLE, 2)) == []
    assert matcher.count(matcher.match(g, TRIANGLE, 2)).first()[0] == 0
    d = decompose.by_temporal(TRIANGLE, *stats.label_tables(g))
    assert [r["n_candidates"] for r in candidates.summary(candidates.reduced(g, TRIANGLE, d, 2)).collect()] == [0, 0, 0]


def test_time_sets_count_short_runs_too(spark):
    runs = [(1, 2, 1, 4), (1, 2, 6, 6), (3, 4, 1, 2), (3, 4, 5, 6)]
    found = variants.time_sets(spark.createDataFrame(runs, "q0 int, q1 int, run_start int, run_end int"), 3)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 5)]


def test_format_times(spark):
    from pyspark.sql import functions as F

    from chronograft.functions import intervals as iv

    df = spark.createDataFrame([([3, 1, 2, 2, 7],), ([],), ([5],)], "t array<int>")
    assert [r[0] for r in df.select(iv.format_times(F.col("t"))).collect()] == ["[1-3, 7]", "[]", "[5]"]

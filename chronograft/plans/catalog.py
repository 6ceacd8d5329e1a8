"""Registered queries of the engine and the SQL that states each result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograft.functions import intervals as iv
from chronograft.functions import labels
from chronograft.operators import candidates, matcher, snapshots, static, stats, variants
from chronograft.operators.graph import TemporalGraph
from chronograft.plans import decompose, pattern, sql
from chronograft.sources import sinks, tables, text
from chronograft.storage import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _occ(spark: SparkSession, d: str) -> DataFrame:
    return tables.trade_occurrences(spark, d, "month")


def _graph(spark: SparkSession, d: str, prefilter: bool = True) -> TemporalGraph:
    return tables.trade(spark, d, "month", prefilter)


MONTH, QUARTER = sql.trade("month"), sql.trade("quarter")
KEPT = f"WITH {MONTH}, {sql.KEPT}"

# ---- snapshot merge, prefilter, labels

_register("src_trade_occurrences", f"WITH {MONTH} SELECT src, dst, t, count(*)::BIGINT AS n FROM raw GROUP BY ALL")(
    lambda s, d: _occ(s, d).groupBy("src", "dst", "t").agg(F.count("*").alias("n")))
_register("pre_dedup", f"WITH {MONTH} SELECT * FROM occ")(lambda s, d: snapshots.dedup(_occ(s, d)))
_register("pre_islands", f"WITH {MONTH}, {sql.ALL}, {sql.RUNS} SELECT * FROM runs")(lambda s, d: snapshots.islands(snapshots.dedup(_occ(s, d))))
_register("pre_consecutive_filter", f"{KEPT}, {sql.RUNS} SELECT * FROM runs")(
    lambda s, d: snapshots.consecutive_only(snapshots.islands(snapshots.dedup(_occ(s, d)))))
_register("pre_retain_all", f"""WITH {MONTH}, {sql.ALL}, {sql.RUNS} SELECT src, dst, "start", "end", a.label AS src_label, b.label AS dst_label
  FROM runs JOIN lab a ON a.id = src JOIN lab b ON b.id = dst""")(lambda s, d: _graph(s, d, prefilter=False).runs)
_register("pre_active_count", f"WITH {MONTH} SELECT src, dst, count(*)::BIGINT AS n_active FROM occ GROUP BY src, dst")(
    lambda s, d: snapshots.active_count(snapshots.islands(snapshots.dedup(_occ(s, d)))))
_register("pre_label_universe", f"WITH {MONTH} SELECT DISTINCT unnest([src, dst]) AS id FROM occ")(lambda s, d: snapshots.universe(_occ(s, d)))
_register("pre_label_lookup", f"{KEPT} SELECT DISTINCT id, label FROM lab WHERE id IN (SELECT src FROM kept UNION SELECT dst FROM kept)")(
    lambda s, d: stats.vertices(_graph(s, d)))
_register("pre_edge_lookup", f"{KEPT} SELECT DISTINCT src, dst FROM kept a WHERE EXISTS (FROM kept b WHERE b.src = a.dst AND b.dst = a.src)")(
    lambda s, d: (a := _graph(s, d).arcs().select("src", "dst")).join(a.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi"))
_register("pre_adjacency", f"""{KEPT} SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS near FROM (SELECT DISTINCT src, dst FROM kept) GROUP BY src""")(
    lambda s, d: _graph(s, d).arcs().groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("near")))
_register("pre_compact", f"{KEPT} SELECT id, (dense_rank() OVER (ORDER BY id) - 1)::BIGINT AS compact FROM (SELECT src AS id FROM kept UNION SELECT dst FROM kept)")(
    lambda s, d: _compact(_graph(s, d)))


def _compact(g: TemporalGraph) -> DataFrame:
    return labels.ranked(snapshots.universe(g.arcs())).withColumnRenamed("rank", "compact")


# the first draws of the generator need its first state only: 227 numbers, more than there are nations
_TWISTER = """mt(i, x) AS (SELECT 0::UBIGINT, 42::UBIGINT UNION ALL SELECT i + 1, (1812433253::UBIGINT * xor(x, x >> 30) + i + 1) % 4294967296::UBIGINT FROM mt WHERE i < 623),
m0 AS (SELECT a.i, (a.x & 2147483648::UBIGINT) | (b.x & 2147483647::UBIGINT) AS y, c.x FROM mt a JOIN mt b ON b.i = a.i + 1 JOIN mt c ON c.i = a.i + 397),
m1 AS (SELECT i, xor(xor(x, y >> 1), CASE WHEN y % 2 = 1 THEN 2567483615::UBIGINT ELSE 0::UBIGINT END) AS v FROM m0),
m2 AS (SELECT i, xor(v, v >> 11) AS v FROM m1), m3 AS (SELECT i, xor(v, (v << 7) & 2636928640::UBIGINT) AS v FROM m2),
m4 AS (SELECT i, xor(v, (v << 15) & 4022730752::UBIGINT) AS v FROM m3), m5 AS (SELECT i, xor(v, v >> 18) AS v FROM m4)"""
_register("pre_labels", f"""WITH RECURSIVE {_TWISTER}, {MONTH}, ids AS (SELECT src AS id FROM occ UNION SELECT dst FROM occ),
  r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM ids) SELECT id, chr((65 + (v * 5::UBIGINT >> 32))::INT) AS label FROM r JOIN m5 ON m5.i = r.i""")(
    lambda s, d: labels.seeded_labels(snapshots.universe(_occ(s, d))))

# ---- statistics

_register("agg_counters", f"""{KEPT} SELECT (SELECT count(*) FROM raw)::BIGINT AS n_occurrences, (SELECT count(DISTINCT (src, dst)) FROM raw)::BIGINT AS n_pairs,
  (SELECT count(DISTINCT (src, dst)) FROM kept)::BIGINT AS n_retained, (SELECT count(*) FROM (SELECT src FROM kept UNION SELECT dst FROM kept))::BIGINT AS n_vertices""")(
    lambda s, d: snapshots.counters(o := _occ(s, d), snapshots.consecutive_only(snapshots.islands(snapshots.dedup(o)))))
_register("agg_out_in_degree", f"{KEPT}, {sql.PROFILES} SELECT id, out_deg, in_deg FROM prof")(
    lambda s, d: stats.degrees(_graph(s, d)).select("id", "out_deg", "in_deg"))
_NLF = [f"{x}_{c}" for x in ("out", "in") for c in "ABCDE"]
_register("agg_nlf", f"{KEPT}, {sql.PROFILES} SELECT id, {', '.join(_NLF)} FROM prof")(lambda s, d: stats.degrees(_graph(s, d)).select("id", *_NLF))
_register("agg_vertex_duration", f"{KEPT}, {sql.PROFILES} SELECT id, label, active_duration FROM prof")(lambda s, d: stats.durations(_graph(s, d)))
_register("agg_label_counts", f"{KEPT}, {sql.PROFILES} SELECT label, count(*)::BIGINT AS n FROM prof GROUP BY label")(lambda s, d: stats.label_counts(_graph(s, d)))
_register("agg_label_lifespan", f"{KEPT}, {sql.PROFILES} SELECT label, count(*)::BIGINT AS n, round(avg(active_duration), 6) AS lifespan FROM prof GROUP BY label")(
    lambda s, d: stats.label_lifespans(_graph(s, d)).withColumn("lifespan", F.round("lifespan", 6)))

# ---- decomposition scores, whose inputs are the label statistics

TRIANGLE = pattern.of("x:A y:B", "y:B z:C", "z:C x:A")
_DEGREES = "(VALUES (0, 'A', 2, 1), (1, 'B', 2, 1), (2, 'C', 2, 1)) p(q, label, deg, out_deg)"


def _scores(spark: SparkSession, scores: dict[int, float]) -> DataFrame:
    return spark.createDataFrame([(q, float(x)) for q, x in scores.items()], "q int, score double").withColumn("score", F.round("score", 9))


_LIFE = f"{KEPT}, {sql.PROFILES}, ls AS (SELECT label, count(*) AS n, avg(active_duration) AS life FROM prof GROUP BY label)"
_register("dec_score_temporal", f"{_LIFE} SELECT q, round(deg / (n * life), 9) AS score FROM {_DEGREES} JOIN ls USING (label)")(
    lambda s, d: _scores(s, decompose.score_temporal(TRIANGLE, *stats.label_tables(_graph(s, d)))))
_register("dec_score_topo", f"{_LIFE} SELECT q, round(n / deg, 9) AS score FROM {_DEGREES} JOIN ls USING (label)")(
    lambda s, d: _scores(s, decompose.score_topological(TRIANGLE, stats.label_tables(_graph(s, d))[0])))
_register("dec_score_inverse", f"{_LIFE} SELECT q, round(n * life / out_deg, 9) AS score FROM {_DEGREES} JOIN ls USING (label)")(
    lambda s, d: _scores(s, decompose.score_inverse(TRIANGLE, *stats.label_tables(_graph(s, d)))))


@_register("dec_edge_tsel", f"""{_LIFE}, e AS (SELECT * FROM (VALUES ('A', 'B'), ('B', 'C'), ('A', 'C')) e(a, b))
  SELECT a, b, round((x.life + y.life) / 2, 9) AS weight FROM e JOIN ls x ON x.label = a JOIN ls y ON y.label = b""")
def dec_edge_tsel(spark: SparkSession, d: str) -> DataFrame:
    _, life = stats.label_tables(_graph(spark, d))
    rows = [(a, b, (life[a] + life[b]) / 2) for a, b in (("A", "B"), ("B", "C"), ("A", "C"))]
    return spark.createDataFrame(rows, "a string, b string, weight double").withColumn("weight", F.round("weight", 9))


@_register("topk_start_vertices", f"{_LIFE} SELECT q, label, round(n / 2, 9) AS score FROM {_DEGREES} JOIN ls USING (label) ORDER BY n / 2, q LIMIT 2")
def topk_start_vertices(spark: SparkSession, d: str) -> DataFrame:
    counts, _ = stats.label_tables(_graph(spark, d))
    rows = [(q, TRIANGLE.labels[q], counts[TRIANGLE.labels[q]] / 2) for q in decompose.start_vertices(TRIANGLE, counts, 2)]
    return spark.createDataFrame(rows, "q int, label string, score double")


_BY_TEMP, _BY_TOPO = "deg / (n * life)", "n / deg"


def _tree(spark: SparkSession, t: decompose.Decomposition) -> DataFrame:
    return spark.createDataFrame([(q, t.parent[q], i) for i, q in enumerate(t.order)], "q int, parent int, place int")


def _walk(score: str) -> str:
    """A triangle's depth-first walk visits its vertices by score."""
    return f"""{_LIFE}, w AS (SELECT q, row_number() OVER (ORDER BY {score}, n, q) - 1 AS place FROM {_DEGREES} JOIN ls USING (label))
  SELECT q, lag(q) OVER (ORDER BY place) AS parent, place::INT AS place FROM w"""


_register("dec_tree_temporal", _walk(_BY_TEMP))(lambda s, d: _tree(s, decompose.by_temporal(TRIANGLE, *stats.label_tables(_graph(s, d)))))
_register("dec_tree_topo", _walk(_BY_TOPO))(lambda s, d: _tree(s, decompose.by_topology(TRIANGLE, stats.label_tables(_graph(s, d))[0])))


@_register("dec_bfs_tree", f"""{_LIFE}, w AS (SELECT q, row_number() OVER (ORDER BY n * life / out_deg, q) AS i FROM {_DEGREES} JOIN ls USING (label))
  SELECT q, CASE WHEN i > 1 THEN (SELECT q FROM w WHERE i = 1) END AS parent, (i > 1)::INT AS level FROM w""")
def dec_bfs_tree(spark: SparkSession, d: str) -> DataFrame:
    t = decompose.breadth_first(TRIANGLE, *stats.label_tables(_graph(spark, d)))
    return spark.createDataFrame([(q, t.parent[q], t.levels[q]) for q in t.order], "q int, parent int, level int")


@_register("dec_root_by_label", " UNION ALL ".join(f"SELECT * FROM (SELECT '{x}' AS score, label AS root FROM ({_LIFE} SELECT * FROM {_DEGREES} JOIN ls USING (label)) ORDER BY {f}, n, label LIMIT 1)" for x, f in (("temporal", _BY_TEMP), ("topological", _BY_TOPO))))
def dec_root_by_label(spark: SparkSession, d: str) -> DataFrame:
    counts, lifespans = stats.label_tables(_graph(spark, d))
    pairs = [(TRIANGLE.labels[a], TRIANGLE.labels[b]) for a, b in TRIANGLE.arcs]
    return spark.createDataFrame([("temporal", decompose.choose_label(pairs, counts, lifespans)), ("topological", decompose.choose_label(pairs, counts))], "score string, root string")


# ---- candidates: the triangle's tree is 0 -> 1 -> 2 with the closing arc 2 -> 0

K = 2


def _sparse(spark: SparkSession, d: str) -> TemporalGraph:
    """A graph in which trims find something to remove."""
    return tables.hops(spark, d, 72)


TREE = decompose.by_topology(TRIANGLE, dict.fromkeys("ABCDE", 5))
_CAND = f"""WITH {sql.hops(72)}, {sql.KEPT}, {sql.PROFILES}, {sql.durable(K)},
c0 AS ({sql.vertex(TRIANGLE, 0, K)}), c1 AS ({sql.vertex(TRIANGLE, 1, K)}),
r1 AS (SELECT src AS v_par, dst AS v_cand FROM dur WHERE src IN (FROM c0) AND dst IN (FROM c1)),
n2 AS (SELECT v FROM ({sql.vertex(TRIANGLE, 2, K)}) WHERE EXISTS (FROM dur WHERE src = v AND dst IN (FROM c0))),
r2 AS (SELECT src AS v_par, dst AS v_cand FROM dur WHERE src IN (SELECT v_cand FROM r1) AND dst IN (FROM n2)),
b1 AS (SELECT * FROM r1 WHERE v_cand IN (SELECT v_par FROM r2)),
b0 AS (SELECT v FROM c0 WHERE v IN (SELECT v_par FROM b1)),
t1 AS (SELECT * FROM b1 WHERE v_par IN (FROM b0)),
t2 AS (SELECT * FROM r2 WHERE v_par IN (SELECT v_cand FROM t1))"""


def _rels(t: candidates.CandidateTree, root: int = 0) -> DataFrame:
    out = t.roots.select(F.lit(root).alias("q"), F.lit(-1).cast("long").alias("v_par"), F.col("v").alias("v_cand"))
    for q, r in t.relations.items():
        out = out.union(r.select(F.lit(q), "v_par", "v_cand"))
    return out


_REL_SQL = "SELECT 0 AS q, -1::BIGINT AS v_par, v AS v_cand FROM {} UNION ALL SELECT 1, v_par, v_cand FROM {} UNION ALL SELECT 2, v_par, v_cand FROM {}"
_register("cand_vertex", f"{_CAND} SELECT 0 AS q, v FROM c0 UNION ALL SELECT 1, v FROM c1 UNION ALL SELECT 2, v FROM ({sql.vertex(TRIANGLE, 2, K)})")(
    lambda s, d: _each_vertex(stats.profiles(_sparse(s, d))))


def _each_vertex(profiles: DataFrame) -> DataFrame:
    parts = [candidates.vertex_candidates(profiles, TRIANGLE, q, K).select(F.lit(q).alias("q"), "v") for q in range(3)]
    return parts[0].union(parts[1]).union(parts[2])


_register("cand_root", f"{_CAND} SELECT v FROM c0")(lambda s, d: candidates.vertex_candidates(stats.profiles(_sparse(s, d)), TRIANGLE, TREE.root, K))
_register("cand_arc_durable", f"{_CAND} SELECT src, dst FROM dur")(lambda s, d: _sparse(s, d).durable(K).select("src", "dst").distinct())
_register("cand_expand", f"{_CAND} " + _REL_SQL.format("c0", "r1", "r2"))(lambda s, d: _rels(candidates.build(_sparse(s, d), TRIANGLE, TREE, K)))


@_register("cand_nontree_exists", f"{_CAND} SELECT v FROM n2")
def cand_nontree_exists(spark: SparkSession, d: str) -> DataFrame:
    g = _sparse(spark, d)
    profiles = stats.profiles(g)
    each = lambda q: candidates.vertex_candidates(profiles, TRIANGLE, q, K)
    return candidates.has_closing_arc(TRIANGLE, g.durable(K), 2, 0, each(2), each(0))


_register("trim_bottom_up", f"{_CAND} " + _REL_SQL.format("b0", "b1", "r2"))(
    lambda s, d: _rels(candidates.trim_bottom_up(candidates.build(_sparse(s, d), TRIANGLE, TREE, K))))
_register("trim_top_down", f"{_CAND} " + _REL_SQL.format("b0", "t1", "t2"))(lambda s, d: _rels(candidates.reduced(_sparse(s, d), TRIANGLE, TREE, K)))
_register("cand_unique", f"{_CAND} SELECT DISTINCT v_cand AS v FROM t2")(lambda s, d: candidates.reduced(_sparse(s, d), TRIANGLE, TREE, K).of(2))
_register("agg_cand_summary", f"""{_CAND} SELECT 0 AS q, 0::BIGINT AS n_blocks, (SELECT count(*) FROM b0)::BIGINT AS n_candidates, 0::BIGINT AS n_entries
  UNION ALL SELECT 1, count(DISTINCT v_par), count(DISTINCT v_cand), count(*) FROM t1
  UNION ALL SELECT 2, count(DISTINCT v_par), count(DISTINCT v_cand), count(*) FROM t2""")(
    lambda s, d: candidates.summary(candidates.reduced(_sparse(s, d), TRIANGLE, TREE, K)))
_register("agg_relation_total", f"{_CAND} SELECT ((SELECT count(*) FROM t1) + (SELECT count(*) FROM t2))::BIGINT AS n_entries")(
    lambda s, d: candidates.summary(candidates.reduced(_sparse(s, d), TRIANGLE, TREE, K)).agg(F.sum("n_entries").alias("n_entries")))
_register("limit_sample", f"{_CAND} SELECT DISTINCT v_cand AS v FROM t1 ORDER BY v LIMIT 20")(
    lambda s, d: candidates.sample(candidates.reduced(_sparse(s, d), TRIANGLE, TREE, K), 1))
_register("set_diff_trim", f"{_CAND} SELECT v_par, v_cand FROM r1 EXCEPT SELECT v_par, v_cand FROM t1")(
    lambda s, d: (t := candidates.build(_sparse(s, d), TRIANGLE, TREE, K)).relations[1].join(
        candidates.trim_top_down(candidates.trim_bottom_up(t)).relations[1], ["v_par", "v_cand"], "left_anti"))

RECIPROCAL, INCOMING = pattern.of("x:A y:B", "y:B x:A"), pattern.of("x:A y:B", "z:C y:B")


def _base(p: pattern.Pattern) -> str:
    return f"WITH {sql.hops(72)}, {sql.KEPT}, {sql.PROFILES}, {sql.durable(K)}, " + ", ".join(f"c{q} AS ({sql.vertex(p, q, K)})" for q in range(p.n))


def _grown(p: pattern.Pattern):
    tree = decompose.by_topology(p, dict.fromkeys("ABCDE", 5))
    return lambda s, d: _rels(candidates.build(_sparse(s, d), p, tree, K), tree.root)


_register("cand_expand_reciprocal", f"""{_base(RECIPROCAL)} SELECT 0 AS q, -1::BIGINT AS v_par, v AS v_cand FROM c0
  UNION ALL SELECT 1, src, dst FROM dur WHERE src IN (FROM c0) AND dst IN (FROM c1) AND (dst, src) IN (SELECT (src, dst) FROM dur)""")(_grown(RECIPROCAL))
_register("cand_expand_incoming", f"""{_base(INCOMING)} SELECT 1 AS q, -1::BIGINT AS v_par, v AS v_cand FROM c1
  UNION ALL SELECT 0, dst, src FROM dur WHERE dst IN (FROM c1) AND src IN (FROM c0) UNION ALL SELECT 2, dst, src FROM dur WHERE dst IN (FROM c1) AND src IN (FROM c2)""")(_grown(INCOMING))
_register("bfs_trim", f"""{_CAND}, d2 AS (SELECT * FROM r2 WHERE v_par IN (SELECT v_cand FROM r1)), u1 AS (SELECT * FROM r1 WHERE v_cand IN (SELECT v_par FROM d2)),
  u0 AS (SELECT v FROM c0 WHERE v IN (SELECT v_par FROM u1)) """ + _REL_SQL.format("u0", "u1", "d2"))(
    lambda s, d: _rels(candidates.trim_bottom_up(candidates.trim_top_down(candidates.build(_sparse(s, d), TRIANGLE, TREE, K)))))
_FEW = {0: "out_B < 1 OR in_C < 1", 1: "out_C < 1 OR in_A < 1", 2: "out_A < 1 OR in_B < 1"}
_register("bfs_debug_counters", f"{_CAND} " + " UNION ALL ".join(
    f"SELECT {q} AS q, count(*)::BIGINT AS n_label, count(*) FILTER (out_deg < 1)::BIGINT AS n_out_degree, count(*) FILTER (in_deg < 1)::BIGINT AS n_in_degree, "
    f"count(*) FILTER (active_duration < 25)::BIGINT AS n_duration, count(*) FILTER ({few})::BIGINT AS n_neighbours FROM prof WHERE label = '{'ABC'[q]}'" for q, few in _FEW.items()))(
    lambda s, d: _reasons(stats.profiles(_sparse(s, d))))


def _reasons(profiles: DataFrame) -> DataFrame:
    parts = [candidates.reject_reasons(profiles, TRIANGLE, q, 25) for q in range(3)]
    return parts[0].union(parts[1]).union(parts[2])


# ---- durable matching

PATTERNS = {
    "match_edge": (pattern.of("x:A y:B"), 3),
    "match_path3": (pattern.of("x:A y:B", "y:B z:C"), 4),
    "match_star": (pattern.of("c:A x:B", "c:A y:B", "c:A z:C"), 6),
    "match_triangle": (TRIANGLE, 2),
    "match_square": (pattern.of("x:A y:B", "y:B z:C", "z:C w:D", "w:D x:A"), 5),
    "match_reciprocal": (pattern.of("x:A y:B", "y:B x:A"), 3),
    "match_repeated_label": (pattern.of("x:A y:A", "y:A z:B"), 4),
    "match_incoming_root": (pattern.of("x:A y:B", "z:C y:B"), 5),
}


def _add_match(name: str, p: pattern.Pattern, k: int) -> None:
    _register(name, sql.matches(p, k, QUARTER))(lambda s, d: matcher.match(tables.trade(s, d, "quarter"), p, k))


for _name, (_p, _k) in PATTERNS.items():
    _add_match(_name, _p, _k)

LOOP = pattern.of("x:A x:A", "x:A y:B")
_register("match_selfloop", sql.matches(LOOP, 2, QUARTER, prefilter=False))(lambda s, d: matcher.match(tables.trade(s, d, "quarter", False), LOOP, 2))
_register("match_k1", sql.matches(TRIANGLE, 1, MONTH, prefilter=False))(lambda s, d: matcher.match(_graph(s, d, False), TRIANGLE, 1))
_register("match_no_prefilter", sql.matches(TRIANGLE, 3, MONTH, prefilter=False))(lambda s, d: matcher.match(_graph(s, d, False), TRIANGLE, 3))
HOP = pattern.of("q0:A q1:B", "q1:B q0:A", "q1:B q2:A", "q2:A q0:A")
_register("match_hops", sql.matches(HOP, 2, sql.hops(15)))(lambda s, d: _ordered(tables.hops(s, d, 15), HOP, 2))
HOP_TRIANGLE = pattern.of("x:A y:B", "y:B z:C", "z:C x:A")
_register("match_hops_triangle", sql.matches(HOP_TRIANGLE, 2, sql.hops(15)))(lambda s, d: _ordered(tables.hops(s, d, 15), HOP_TRIANGLE, 2))


def _ordered(g: TemporalGraph, p: pattern.Pattern, k: int) -> DataFrame:
    """Matches with legs ordered by their counted sizes."""
    return matcher.match(g, p, k, matcher.arc_order(p, matcher.leg_sizes(g, k)))


@_register("match_reduced", sql.matches(TRIANGLE, 2, sql.hops(30)))
def match_reduced(spark: SparkSession, d: str) -> DataFrame:
    """Matches with legs reduced to the candidates of the trimmed tree."""
    g = tables.hops(spark, d, 30)
    counts, lifespans = stats.label_tables(g)
    tree = candidates.reduced(g, TRIANGLE, decompose.by_temporal(TRIANGLE, counts, lifespans), 2)
    return matcher.match(g, TRIANGLE, 2, candidates=tree.all())


_register("match_count_only", sql.matches(TRIANGLE, 2, QUARTER, select="SELECT count(DISTINCT (q0, q1, q2))::BIGINT AS n_matches, false AS overflow FROM found"))(
    lambda s, d: matcher.count(matcher.match(tables.trade(s, d, "quarter"), TRIANGLE, 2)).withColumn("n_matches", F.col("n_matches").cast("long")))
_TEXT = "'[' || string_agg(CASE WHEN run_start = run_end THEN run_start::VARCHAR ELSE run_start || '-' || run_end END, ', ' ORDER BY run_start) || ']'"
_register("match_active_string", sql.matches(TRIANGLE, 2, QUARTER, select=f"SELECT q0, q1, q2, {_TEXT} AS active_text FROM found GROUP BY q0, q1, q2"))(
    lambda s, d: matcher.mappings(matcher.match(tables.trade(s, d, "quarter"), TRIANGLE, 2)).select("q0", "q1", "q2", "active_text"))

# ---- static matching

ARCS = "SELECT DISTINCT src, dst FROM occ WHERE src <> dst"


def _static(spark: SparkSession, d: str, p: pattern.Pattern, reduce: bool = False) -> DataFrame:
    return static.match(static.collapse(tables.trade_occurrences(spark, d, "quarter")), tables.nation_labels(spark, d), p, reduce)


def _two_labels(spark: SparkSession, d: str) -> DataFrame:
    one = tables.nation_labels(spark, d)
    return one.union(one.select("id", F.char((F.col("id") % 5 + 65).cast("int")))).distinct()


_TWO = "SELECT id, label FROM lab UNION SELECT id, chr((65 + id % 5)::INT) FROM lab"
PATH3 = pattern.of("x:A y:B", "y:B z:C")
_register("static_collapse", f"WITH {QUARTER} {ARCS}")(lambda s, d: static.collapse(tables.trade_occurrences(s, d, "quarter")))
_register("static_path", sql.static(PATH3, QUARTER))(lambda s, d: _static(s, d, PATH3))
_register("static_triangle", sql.static(TRIANGLE, QUARTER))(lambda s, d: _static(s, d, TRIANGLE, reduce=True))
_register("static_reciprocal", sql.static(PATTERNS["match_reciprocal"][0], QUARTER))(lambda s, d: _static(s, d, PATTERNS["match_reciprocal"][0]))
_register("static_single_vertex", f"WITH {QUARTER} SELECT id AS q0 FROM lab WHERE label = 'B'")(
    lambda s, d: _static(s, d, pattern.Pattern(("B",), ())))
_register("static_multilabel", sql.static(PATH3, QUARTER, labels=_TWO))(
    lambda s, d: static.match(static.collapse(tables.trade_occurrences(s, d, "quarter")), _two_labels(s, d), PATH3))
_register("static_edge_label", sql.static(PATH3, QUARTER, select="SELECT * FROM hit WHERE q0 < q1 AND q1 >= q2"))(
    lambda s, d: static.match(static.collapse(tables.trade_occurrences(s, d, "quarter")).withColumn("label", F.when(F.col("src") < F.col("dst"), "1").otherwise("2")),
                              tables.nation_labels(s, d), pattern.parse("x:A y:B 1\ny:B z:C 2", "edges")))
_register("static_undirected_projection", f"WITH {QUARTER}, a AS ({ARCS}) SELECT src, dst FROM a UNION SELECT dst, src FROM a")(
    lambda s, d: static.undirected(static.collapse(tables.trade_occurrences(s, d, "quarter"))))
_register("static_nlf_filter", f"""WITH {QUARTER}, a AS ({ARCS}), u AS (SELECT src, dst FROM a UNION SELECT dst, src FROM a),
  c AS (SELECT u.src AS id, l.label, count(*) AS n FROM u JOIN lab l ON l.id = u.dst GROUP BY ALL)
  SELECT id AS v FROM lab WHERE label = 'B' AND id IN (SELECT id FROM c WHERE label = 'A') AND id IN (SELECT id FROM c WHERE label = 'C')""")(
    lambda s, d: static.label_filter(static.collapse(tables.trade_occurrences(s, d, "quarter")), tables.nation_labels(s, d), PATH3, 1))


_register("static_ordered", sql.static(PATH3, QUARTER))(lambda s, d: _in_order(static.collapse(tables.trade_occurrences(s, d, "quarter")), tables.nation_labels(s, d)))


def _in_order(arcs: DataFrame, lab: DataFrame) -> DataFrame:
    return static.match(arcs, lab, PATH3, order=static.search_order(PATH3, arcs, lab))


@_register("dec_static_start", f"""WITH {QUARTER}, a AS ({ARCS}), u AS (SELECT src, dst FROM a UNION SELECT dst, src FROM a),
  c AS (SELECT DISTINCT u.src AS id, x.label AS own, y.label AS near FROM u JOIN lab x ON x.id = u.src JOIN lab y ON y.id = u.dst),
  n AS (SELECT q, p.label, (SELECT count(*) FROM lab WHERE lab.label = p.label) AS n_label, deg FROM (VALUES (0, 'A', 1), (1, 'B', 2), (2, 'C', 1)) p(q, label, deg)),
  f AS (SELECT 0 AS q, count(*) AS n_passing FROM c WHERE own = 'A' AND near = 'B' UNION ALL SELECT 2, count(*) FROM c WHERE own = 'C' AND near = 'B'
    UNION ALL SELECT 1, count(*) FROM c WHERE own = 'B' AND near = 'A' AND id IN (SELECT id FROM c WHERE near = 'C'))
  SELECT q, n_label, n_passing, row_number() OVER (ORDER BY n_passing, n_label / deg, q) = 1 AS chosen FROM n JOIN f USING (q)""")
def dec_static_start(spark: SparkSession, d: str) -> DataFrame:
    rows = static.start_vertex(static.collapse(tables.trade_occurrences(spark, d, "quarter")), tables.nation_labels(spark, d), PATH3)
    return spark.createDataFrame([(*r, i == 0) for i, r in enumerate(rows)], "q int, n_label long, n_passing long, chosen boolean")


@_register("static_max_results", sql.static(PATH3, QUARTER, select="SELECT least(count(*), 10)::BIGINT AS n, count(*) > 10 AS truncated, false AS timed_out FROM hit"))
def static_max_results(spark: SparkSession, d: str) -> DataFrame:
    arcs = static.collapse(tables.trade_occurrences(spark, d, "quarter"))
    r = static.run(arcs, tables.nation_labels(spark, d), PATH3, max_results=10)
    return spark.createDataFrame([(r["count"], r["truncated"], r["timed_out"])], "n long, truncated boolean, timed_out boolean")


@_register("static_batch", f"""WITH {QUARTER}, arcs AS ({ARCS}), hit AS (SELECT DISTINCT a.src, a.dst FROM arcs a JOIN lab x ON x.id = a.src JOIN lab y ON y.id = a.dst WHERE x.label = 'A' AND y.label = 'B')
  SELECT 'trade' AS data, 'edge' AS query, count(*)::BIGINT AS n FROM hit UNION ALL SELECT 'trade', 'vertex', count(*) FROM lab WHERE label = 'B'""")
def static_batch(spark: SparkSession, d: str) -> DataFrame:
    graph = ("trade", static.collapse(tables.trade_occurrences(spark, d, "quarter")), tables.nation_labels(spark, d))
    rows = static.batch([graph], [("edge", pattern.of("x:A y:B")), ("vertex", pattern.Pattern(("B",), ()))], time_limit=0)
    return spark.createDataFrame([(r["data"], r["query"], r["count"]) for r in rows], "data string, query string, n long")


# ---- breadth-first variant

_BFS = f"""WITH {QUARTER}, pairs AS (SELECT DISTINCT src, dst FROM occ),
tm AS (SELECT o.src, o.t FROM occ o UNION SELECT o.dst, o.t FROM occ o WHERE (o.dst, o.src) IN (SELECT (src, dst) FROM pairs)),
st AS (SELECT p.src AS id, lab.label, count(*)::BIGINT AS out_deg, (SELECT count(DISTINCT t) FROM tm WHERE tm.src = p.src)::BIGINT AS duration, count(DISTINCT l.label)::BIGINT AS n_near_labels
  FROM pairs p JOIN lab l ON l.id = p.dst JOIN lab ON lab.id = p.src GROUP BY p.src, lab.label)"""
_EITHER = """eo AS (SELECT src, dst, t FROM occ UNION SELECT dst, src, t FROM occ WHERE (dst, src) NOT IN (SELECT (src, dst) FROM occ))"""
_register("bfs_vertex_stats", f"{_BFS} SELECT * FROM st")(lambda s, d: variants.vertex_stats(tables.trade_occurrences(s, d), tables.nation_labels(s, d)))


def _bfs_roots(s: SparkSession, d: str) -> DataFrame:
    return variants.root_filter(variants.vertex_stats(tables.trade_occurrences(s, d), tables.nation_labels(s, d)), TRIANGLE, TREE, 0, 3)


_register("bfs_root_filter", f"{_BFS} SELECT id AS v FROM st WHERE label = 'A' AND out_deg >= 1 AND n_near_labels >= 1 AND duration >= 3")(_bfs_roots)
_register("mini_root_filter", f"{_BFS} SELECT id AS v FROM st WHERE label = 'A'")(
    lambda s, d: variants.root_filter(variants.vertex_stats(tables.trade_occurrences(s, d), tables.nation_labels(s, d)), TRIANGLE, TREE, 0, 3, strict=False))
_register("bfs_child_filter", f"""{_BFS} SELECT src AS v_par, dst AS v_cand FROM pairs WHERE src IN (SELECT id FROM st WHERE label = 'A' AND out_deg >= 1 AND n_near_labels >= 1 AND duration >= 3)
  AND dst IN (SELECT id FROM st WHERE label = 'B' AND out_deg >= 1 AND n_near_labels >= 1 AND duration >= 3)""")(
    lambda s, d: variants.child_filter(o := tables.trade_occurrences(s, d), _bfs_roots(s, d), variants.root_filter(variants.vertex_stats(o, tables.nation_labels(s, d)), TRIANGLE, TREE, 1, 3)))
_register("bfs_match", f"WITH {QUARTER}, {_EITHER}, kept AS (SELECT * FROM eo WHERE src <> dst), {sql.matched(PATH3, 4)} SELECT q0, q1, q2, count(*)::BIGINT AS n_snapshots FROM snap WHERE (q0, q1, q2) IN (SELECT (q0, q1, q2) FROM found) GROUP BY ALL")(
    lambda s, d: variants.time_sets(matcher.match(variants.either_direction_graph(tables.trade_occurrences(s, d), tables.nation_labels(s, d)), PATH3, 1), 4))
_register("bfs_vertex_times", f"WITH {QUARTER} SELECT id, string_agg(t, ',' ORDER BY t) AS times FROM (SELECT src AS id, t FROM occ UNION SELECT dst, t FROM occ) GROUP BY id")(
    lambda s, d: (o := tables.trade_occurrences(s, d)).select(F.col("src").alias("id"), "t").union(o.select("dst", "t")).distinct().groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("times")))

# ---- experimental variants

_SNAP3 = f"{KEPT}, {sql.matched(PATH3, 1)}"
_register("mini_total_duration_match", f"{_SNAP3} SELECT q0, q1, q2, count(*)::BIGINT AS n_snapshots FROM snap GROUP BY ALL HAVING count(*) >= 6")(
    lambda s, d: matcher.match(_graph(s, d), PATH3, 6, durability="total"))
_register("mini_onehop_blocks", f"""{KEPT}, {sql.RUNS}, {sql.durable(3)} SELECT 1 AS q, src AS v_root, count(*)::BIGINT AS n_total FROM dur JOIN lab a ON a.id = src JOIN lab b ON b.id = dst
  WHERE a.label = 'A' AND b.label = 'B' GROUP BY src""")(lambda s, d: variants.one_hop(_graph(s, d), TRIANGLE, 0, 3))
_register("mini_onehop_temporal", f"""{_LIFE}, {sql.durable(3)}, root AS (SELECT q, label FROM {_DEGREES} JOIN ls USING (label) ORDER BY {_BY_TEMP}, n, q LIMIT 1)
  SELECT ((root.q + 1) % 3)::INT AS q, src AS v_root, count(*)::BIGINT AS n_total FROM root JOIN lab a ON a.label = root.label JOIN dur ON src = a.id
  JOIN lab b ON b.id = dst AND b.label = chr((65 + (root.q + 1) % 3)::INT) GROUP BY ALL""")(lambda s, d: _one_hop_temporal(_graph(s, d)))


def _one_hop_temporal(g: TemporalGraph) -> DataFrame:
    return variants.one_hop(g, TRIANGLE, decompose.by_temporal(TRIANGLE, *stats.label_tables(g)).root, 3)


_register("limit_blocks", f"""{KEPT}, {sql.RUNS}, {sql.durable(3)} SELECT 1 AS q, src AS v_root, count(*)::BIGINT AS n_total FROM dur JOIN lab a ON a.id = src JOIN lab b ON b.id = dst
  WHERE a.label = 'A' AND b.label = 'B' GROUP BY src ORDER BY src LIMIT 3""")(lambda s, d: variants.limited_blocks(variants.one_hop(_graph(s, d), TRIANGLE, 0, 3), 3))
_register("mini_tree_edge_cands", f"""{KEPT}, e AS (SELECT DISTINCT src, dst, a.label AS x, b.label AS y FROM kept JOIN lab a ON a.id = src JOIN lab b ON b.id = dst)
  SELECT 0 AS q_parent, 1 AS q_child, count(DISTINCT src)::BIGINT AS n_blocks, count(*)::BIGINT AS n_arcs FROM e WHERE x = 'A' AND y = 'B'
  UNION ALL SELECT 1, 2, count(DISTINCT src), count(*) FROM e WHERE x = 'B' AND y = 'C'""")(lambda s, d: variants.tree_arc_candidates(_graph(s, d), TRIANGLE, TREE))
_UNDIR = MONTH.replace("occ AS (", "occ1 AS (") + ", occ AS (SELECT src, dst, t FROM occ1 UNION SELECT dst, src, t FROM occ1)"
_register("mini_undirected", sql.matches(TRIANGLE, 3, _UNDIR))(
    lambda s, d: matcher.match(variants.undirected_graph(_occ(s, d), tables.nation_labels(s, d)), TRIANGLE, 3))
_register("mini_join_paths", sql.matches(TRIANGLE, 1, MONTH, select="SELECT DISTINCT q0, q1, q2 FROM found"))(lambda s, d: _paths(_graph(s, d)))


def _paths(g: TemporalGraph) -> DataFrame:
    """Two root-to-leaf paths of snapshots, joined on what they share."""
    arcs = snapshots.expand(g.runs)
    leg = lambda a, b, qa, qb: arcs.where((F.col("src_label") == a) & (F.col("dst_label") == b)).select(F.col("src").alias(qa), F.col("dst").alias(qb), "t")
    left = variants.path_join(leg("A", "B", "q0", "q1"), leg("B", "C", "q1", "q2"))
    return variants.path_join(left, leg("C", "A", "q2", "q0")).select("q0", "q1", "q2").distinct()


# ---- dataset tools

_UNIX = "rows AS (SELECT user_id::BIGINT AS src, (event_id % 100)::BIGINT AS dst, floor(epoch(ts))::BIGINT AS t, event_id FROM events), base AS (SELECT t - t % 600 AS b FROM rows ORDER BY event_id LIMIT 1)"
_BUCKET = f"WITH {_UNIX}, bk AS (SELECT src, dst, trunc((t - b) / 600.0)::BIGINT + 1 AS t, event_id FROM rows, base)"
_register("ds_bucket", f"{_BUCKET} SELECT * FROM bk")(lambda s, d: snapshots.bucket(tables.unix_rows(s, d), 10, order="event_id"))
_register("ds_bucket_unique", f"{_BUCKET} SELECT DISTINCT src, dst, t FROM bk")(lambda s, d: snapshots.bucket_unique(tables.unix_rows(s, d), 10, order="event_id"))
_register("ds_timestamp", f"WITH {_UNIX} SELECT src, dst, strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS t, event_id FROM rows")(lambda s, d: snapshots.timestamps(tables.unix_rows(s, d)))
_register("ds_unique_lines", "SELECT event_type AS value, min(event_id) AS line_no FROM events GROUP BY event_type")(
    lambda s, d: snapshots.unique_lines(s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("value"), F.col("event_id").alias("line_no"))))
_register("ds_filter", KEPT.replace("WHERE src <> dst AND", "WHERE") + " SELECT * FROM kept")(lambda s, d: snapshots.filter_consecutive(_occ(s, d)))
_register("ds_history", f"WITH {MONTH} SELECT src, dst, string_agg(t, ',' ORDER BY t) AS times FROM raw GROUP BY src, dst")(lambda s, d: snapshots.history(_occ(s, d)))
_register("ds_count_durable", KEPT.replace("WHERE src <> dst AND", "WHERE") + " SELECT (SELECT count(DISTINCT (src, dst)) FROM occ)::BIGINT AS n_arcs, count(DISTINCT (src, dst))::BIGINT AS n_durable FROM kept")(
    lambda s, d: snapshots.count_durable(snapshots.history(_occ(s, d))))



@_register("ds_filter_counts", f"""WITH ok AS (SELECT DISTINCT user_id % 30 AS src, event_id % 7 AS dst, event_id // 40 AS t FROM events WHERE event_id % 50 <> 0), n AS (SELECT *, lead(t) OVER (PARTITION BY src, dst ORDER BY t) AS n FROM ok)
  SELECT (SELECT count(*) FROM events WHERE event_id % 50 = 0)::BIGINT AS n_invalid, count(DISTINCT (src, dst))::BIGINT AS n_arcs, count(DISTINCT CASE WHEN n = t + 1 THEN (src, dst) END)::BIGINT AS n_kept FROM n""")
def ds_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    """Report of a filter over text lines, some of which are no rows."""
    e, at = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    row = F.concat_ws(" ", F.col("user_id") % 30, at % 7, F.floor(at / 40))
    return snapshots.filter_counts(e.select(F.when(at % 50 == 0, F.concat_ws(" ", F.lit("lost"), at)).otherwise(row).alias("value")))


@_register("src_temporal_strict", f"WITH {MONTH} SELECT * FROM occ")
def src_temporal_strict(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences written as an edge list and read back by the strict grammar."""
    path = new_path(spark, "edges")
    sinks.write_occurrences(snapshots.dedup(_occ(spark, d)), path)
    return text.read_occurrences(spark, path)


@_register("snk_history", KEPT.replace("WHERE src <> dst AND", "WHERE") + " SELECT (SELECT count(DISTINCT (src, dst)) FROM occ)::BIGINT AS n_arcs, count(DISTINCT (src, dst))::BIGINT AS n_durable FROM kept")
def snk_history(spark: SparkSession, d: str) -> DataFrame:
    """Durable arcs counted from a history dump that was written and read back."""
    path = new_path(spark, "history")
    sinks.write_history(_occ(spark, d), path)
    return snapshots.count_durable(text.read_history(spark, path))


@_register("snk_match_lines", sql.matches(TRIANGLE, 2, QUARTER, select=f"SELECT 'q0(A)->' || q0 || ', q1(B)->' || q1 || ', q2(C)->' || q2 || ' | active=' || {_TEXT} AS value FROM found GROUP BY q0, q1, q2"))
def snk_match_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.match_lines(matcher.match(tables.trade(spark, d, "quarter"), TRIANGLE, 2), TRIANGLE)


@_register("snk_native", f"""WITH {QUARTER}, arcs AS ({ARCS}), r AS (SELECT id, dense_rank() OVER (ORDER BY id) - 1 AS v FROM (SELECT src AS id FROM arcs UNION SELECT dst FROM arcs))
  SELECT 't # 0' AS value UNION ALL SELECT (SELECT count(*) FROM r) || ' ' || (SELECT count(*) FROM arcs) || ' 5' UNION ALL SELECT 't # -1'
  UNION ALL SELECT 'v ' || v || ' ' || (ascii(label) - 64) FROM r JOIN lab USING (id)
  UNION ALL SELECT 'e ' || a.v || ' ' || b.v FROM arcs JOIN r a ON a.id = src JOIN r b ON b.id = dst""")
def snk_native(spark: SparkSession, d: str) -> DataFrame:
    arcs = static.collapse(tables.trade_occurrences(spark, d, "quarter"))
    return sinks.native_lines(arcs, tables.nation_labels(spark, d)).select("value")


@_register("src_native_graph", f"""WITH {QUARTER}, arcs AS ({ARCS}), r AS (SELECT id, dense_rank() OVER (ORDER BY id) - 1 AS v FROM (SELECT src AS id FROM arcs UNION SELECT dst FROM arcs))
  SELECT 'v' AS kind, 0::BIGINT AS graph_id, v::BIGINT AS x, (ascii(label) - 64)::BIGINT AS y FROM r JOIN lab USING (id)
  UNION ALL SELECT 'e', 0, a.v, b.v FROM arcs JOIN r a ON a.id = src JOIN r b ON b.id = dst""")
def src_native_graph(spark: SparkSession, d: str) -> DataFrame:
    """A static graph written as text part files and read back with all checks."""
    path = new_path(spark, "native")
    sinks.native_lines(static.collapse(tables.trade_occurrences(spark, d, "quarter")), tables.nation_labels(spark, d)).select("value").write.text(path)
    vertices, arcs = text.read_native(spark, path)
    first = vertices.select(F.lit("v").alias("kind"), "graph_id", F.col("v").alias("x"), F.col("label").cast("long").alias("y"))
    return first.union(arcs.select(F.lit("e"), "graph_id", "src", "dst"))


# ---- scalar functions over arc histories


def _histories(s: SparkSession, d: str) -> DataFrame:
    return snapshots.arc_arrays(snapshots.islands(snapshots.dedup(_occ(s, d))))


_BOTH = f"WITH {MONTH}, {sql.ALL}, mut AS (SELECT a.src, a.dst, a.t FROM occ a JOIN occ b ON b.src = a.dst AND b.dst = a.src AND b.t = a.t)"
_PIECES = 'SELECT src, dst, min(t) AS "start", max(t) AS "end", count(*) AS n FROM (SELECT *, t - row_number() OVER (PARTITION BY src, dst ORDER BY t) AS g FROM mut) GROUP BY src, dst, g'
_SHOWN = "'[' || string_agg(CASE WHEN \"start\" = \"end\" THEN \"start\"::VARCHAR ELSE \"start\" || '-' || \"end\" END, ', ' ORDER BY \"start\") || ']'"


@_register("fn_interval_intersect", f"{_BOTH} SELECT src, dst, {_SHOWN} AS shared FROM ({_PIECES}) WHERE n >= 2 GROUP BY src, dst")
def fn_interval_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two months or more that an arc shares with its reverse."""
    h = _histories(spark, d)
    back = h.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("intervals").alias("other"))
    shared = h.join(back, ["src", "dst"]).select("src", "dst", iv.intersect(F.col("intervals"), F.col("other"), 2).alias("i"))
    return shared.where(F.size("i") > 0).select("src", "dst", iv.format_intervals(F.col("i")).alias("shared"))


_ARC = f"WITH {MONTH}, {sql.ALL}, {sql.RUNS}"
_register("fn_has_min_run", f'{_ARC} SELECT src, dst, max("end" - "start" + 1) >= 3 AS has_run FROM runs GROUP BY src, dst')(
    lambda s, d: _histories(s, d).select("src", "dst", iv.has_run(F.col("intervals"), 3).alias("has_run")))
_register("fn_max_run", f'{_ARC} SELECT src, dst, max("end" - "start" + 1)::BIGINT AS longest FROM runs GROUP BY src, dst')(
    lambda s, d: _histories(s, d).select("src", "dst", iv.max_run(F.col("intervals")).alias("longest")))
_register("fn_union_duration", f"WITH {MONTH} SELECT src AS id, count(DISTINCT t)::BIGINT AS n FROM occ GROUP BY src")(
    lambda s, d: snapshots.islands(snapshots.dedup(_occ(s, d))).groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct("start", "end")).alias("i")).select("id", iv.union_duration(F.col("i")).alias("n")))
_register("fn_format_intervals", f"{_ARC} SELECT src, dst, {_SHOWN} AS shown FROM runs GROUP BY src, dst")(
    lambda s, d: _histories(s, d).select("src", "dst", iv.format_intervals(F.col("intervals")).alias("shown")))
_register("fn_format_times", f"{_ARC} SELECT src, dst, {_SHOWN} AS shown FROM runs GROUP BY src, dst")(
    lambda s, d: _occ(s, d).groupBy("src", "dst").agg(iv.format_times(F.collect_list("t")).alias("shown")))
_register("fn_has_consecutive", f"WITH {MONTH} SELECT src, dst, max(CASE WHEN n = t + 1 THEN 1 ELSE 0 END) = 1 AS consecutive FROM (SELECT *, lead(t) OVER (PARTITION BY src, dst ORDER BY t) AS n FROM occ) GROUP BY src, dst")(
    lambda s, d: _histories(s, d).select("src", "dst", iv.has_run(F.col("intervals"), 2).alias("consecutive")))
_register("fn_label_codec", f"WITH {MONTH} SELECT id, label, ascii(label) - 65 AS code, label AS again FROM lab")(
    lambda s, d: tables.nation_labels(s, d).withColumn("code", iv.label_code(F.col("label"))).withColumn("again", iv.label_of(F.col("code"))))
_register("fn_sorted_intersect", f"WITH {QUARTER}, n AS (SELECT DISTINCT src, dst FROM occ) SELECT a.src AS id, count(*)::BIGINT AS n FROM n a JOIN n b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src")(
    lambda s, d: _mutual(tables.trade_occurrences(s, d)))
_register("set_union_endpoints", f"{KEPT} SELECT DISTINCT unnest([src, dst]) AS id FROM kept")(lambda s, d: snapshots.universe(_graph(s, d).arcs()))
_register("set_intersect_times", f"{_BOTH} SELECT src, dst, count(*)::BIGINT AS n FROM mut GROUP BY src, dst")(
    lambda s, d: (o := snapshots.dedup(_occ(s, d))).join(o.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "t"), ["src", "dst", "t"]).groupBy("src", "dst").agg(F.count("*").alias("n")))


def _mutual(occurrences: DataFrame) -> DataFrame:
    """Neighbours that are both out- and in-neighbours, as an intersection of sorted lists."""
    out = occurrences.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("o"))
    inc = occurrences.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("i"))
    return out.join(inc, "id").select("id", F.size(F.array_intersect("o", "i")).cast("long").alias("n")).where("n > 0")

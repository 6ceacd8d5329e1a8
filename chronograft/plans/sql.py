"""SQL that states the registered results independently: at the level of snapshots, not of runs."""

from __future__ import annotations

from chronograft.plans.pattern import Pattern

_GRAIN = {"month": "year(l_shipdate) * 12 + month(l_shipdate)", "quarter": "year(l_shipdate) * 4 + quarter(l_shipdate)", "year": "year(l_shipdate)"}


def trade(grain: str = "quarter") -> str:
    return f"""raw AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, ({_GRAIN[grain]})::INT AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
occ AS (SELECT DISTINCT src, dst, t FROM raw),
lab AS (SELECT n_nationkey::BIGINT AS id, chr((65 + n_regionkey)::INT) AS label FROM nation)"""


def hops(groups: int = 40) -> str:
    return f"""raw AS (SELECT src, dst, t FROM (SELECT (user_id % {groups})::BIGINT AS src, datediff('day', DATE '1970-01-01', ts::DATE)::INT AS t,
  lead((user_id % {groups})::BIGINT) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL),
occ AS (SELECT DISTINCT src, dst, t FROM raw),
lab AS (SELECT range::BIGINT AS id, chr((65 + range % 5)::INT) AS label FROM range({groups}))"""


KEPT = """kept AS (SELECT src, dst, t FROM occ WHERE src <> dst AND (src, dst) IN (
  SELECT (src, dst) FROM (SELECT src, dst, t, lead(t) OVER (PARTITION BY src, dst ORDER BY t) AS n FROM occ) WHERE n = t + 1))"""
ALL = "kept AS (SELECT src, dst, t FROM occ)"

RUNS = """runs AS (SELECT src, dst, min(t) AS "start", max(t) AS "end" FROM (
  SELECT src, dst, t, t - row_number() OVER (PARTITION BY src, dst ORDER BY t) AS g FROM kept) GROUP BY src, dst, g)"""


def _join(p: Pattern, source: str = "kept", timed: bool = True) -> tuple[str, str]:
    """(columns, FROM ... WHERE ...) of all injective labelled mappings by snapshot."""
    place: dict[int, str] = {}
    source_sql, where = [], []
    for i, (a, b) in enumerate(p.arcs):
        for q, c in ((a, "src"), (b, "dst")):
            if q in place:
                where.append(f"a{i}.{c} = {place[q]}")
            else:
                place[q] = f"a{i}.{c}"
        if timed and i:
            where.append(f"a{i}.t = a0.t")
        source_sql.append(f"{source} a{i}")
    for q, label in enumerate(p.labels):
        source_sql.append(f"lab l{q}")
        where.append(f"l{q}.id = {place[q]} AND l{q}.label = '{label}'")
    where += [f"{place[i]} <> {place[j]}" for i in range(p.n) for j in range(i)]
    columns = ", ".join(f"{place[q]} AS q{q}" for q in range(p.n))
    return columns, f"FROM {', '.join(source_sql)} WHERE {' AND '.join(where)}"


def matched(p: Pattern, k: int) -> str:
    """CTE ``found``: the matches (q0.., run_start, run_end) over the snapshots ``kept``."""
    columns, body = _join(p)
    q = ", ".join(f"q{i}" for i in range(p.n))
    return f"""snap AS (SELECT DISTINCT {columns}, a0.t AS t {body}),
found AS (SELECT {q}, min(t)::INT AS run_start, max(t)::INT AS run_end FROM (
  SELECT *, t - row_number() OVER (PARTITION BY {q} ORDER BY t) AS g FROM snap) GROUP BY {q}, g HAVING count(*) >= {k})"""


def matches(p: Pattern, k: int, graph: str, prefilter: bool = True, select: str = "SELECT * FROM found") -> str:
    return f"WITH {graph}, {KEPT if prefilter else ALL}, {matched(p, k)} {select}"


def static(p: Pattern, graph: str, arcs: str = "SELECT DISTINCT src, dst FROM occ WHERE src <> dst", labels: str | None = None, select: str | None = None) -> str:
    columns, body = _join(p, "arcs", timed=False)
    extra = f", lab2 AS ({labels})" if labels else ""
    body = body.replace("lab l", "lab2 l") if labels else body
    q = f"SELECT DISTINCT {columns} {body}"
    return f"WITH {graph}, arcs AS ({arcs}){extra}, hit AS ({q}) {select or 'SELECT * FROM hit'}"


PROFILES = f"""{RUNS},
arcs AS (SELECT DISTINCT src, dst FROM kept),
near AS (SELECT src AS id, dst AS other, 'out' AS side FROM arcs UNION ALL SELECT dst, src, 'in' FROM arcs),
deg AS (SELECT near.id, count(*) FILTER (side = 'out') AS out_deg, count(*) FILTER (side = 'in') AS in_deg, {", ".join(f"count(*) FILTER (side = '{s}' AND o.label = '{x}') AS {s}_{x}" for s in ("out", "in") for x in "ABCDE")}
  FROM near JOIN lab o ON o.id = near.other GROUP BY near.id),
life AS (SELECT id, count(DISTINCT t) AS active_duration FROM (SELECT src AS id, t FROM kept UNION ALL SELECT dst, t FROM kept) GROUP BY id),
prof AS (SELECT lab.label, deg.*, active_duration FROM deg JOIN life USING (id) JOIN lab USING (id))"""


def durable(k: int) -> str:
    return f'dur AS (SELECT DISTINCT src, dst FROM runs WHERE "end" - "start" + 1 >= {k})'


def vertex(p: Pattern, q: int, k: int) -> str:
    out, inc = p.out(q), p.inc(q)
    tests = [f"label = '{p.labels[q]}'", f"out_deg >= {len(out)}", f"in_deg >= {len(inc)}", f"active_duration >= {k}"]
    tests += [f"{s}_{x} >= {n}" for s, near in (("out", out), ("in", inc)) for x in "ABCDE" if (n := sum(p.labels[b] == x for b in near))]
    return f"SELECT id AS v FROM prof WHERE {' AND '.join(tests)}"

"""Text reports and writers, in the formats that matching tools exchange."""

from __future__ import annotations

import os
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograft.functions.labels import ranked, seeded_labels
from chronograft.operators import candidates, matcher, snapshots, static
from chronograft.plans.pattern import LABELS, Pattern


def write_occurrences(occurrences: DataFrame, path: str) -> None:
    """Edge list ``src dst t`` as text part files."""
    occurrences.select(F.concat_ws(" ", "src", "dst", "t").alias("value")).write.text(path)


def write_history(occurrences: DataFrame, path: str) -> None:
    """History dump ``v1 v2 s1,s2,...`` as text part files."""
    snapshots.history(occurrences).select(F.concat_ws(" ", "src", "dst", "times").alias("value")).write.text(path)


def match_lines(matches: DataFrame, p: Pattern, names: tuple[str, ...] | None = None) -> DataFrame:
    """One line (value) a mapping: ``q0(A)->id, q1(B)->id | active=[1-3, 5]``."""
    shown = [F.concat(F.lit(f"{(names or [f'q{q}' for q in range(p.n)])[q]}({p.labels[q]})->"), F.col(f"q{q}").cast("string")) for q in range(p.n)]
    return matcher.mappings(matches).select(F.concat(F.concat_ws(", ", *shown), F.lit(" | active="), F.col("active_text")).alias("value"))


def write_report(path: str, tree: candidates.CandidateTree, matches: DataFrame, count_only: bool = False, listed: int | None = None) -> dict:
    """Candidate summary, match count, match rows and statistics in one text file.

    The count comes from its own aggregate. Rows are streamed to the driver a partition at a time;
    large results belong into Parquet instead.
    """
    n, over = matcher.count(matches).first()
    rows = candidates.summary(tree).orderBy("q").collect()
    with open(path, "w", encoding="utf-8") as out:
        print("[Candidate Summary]", file=out)
        for r in rows:
            some = [str(x["v"]) for x in candidates.sample(tree, r["q"]).collect()]
            more = ",..." if r["n_candidates"] > len(some) else ""
            print(f"q{r['q']}({tree.p.labels[r['q']]}): blocks={r['n_blocks']} unique={r['n_candidates']} relations={r['n_entries']} sample={','.join(some)}{more}", file=out)
        print(f"\n[Run] mode={'count-only' if count_only else 'full'}\n[Final Matches] Count: {int(n):>20}" + (" (overflow)" if over else ""), file=out)
        if not count_only:
            lines = match_lines(matches, tree.p).orderBy("value")
            for i, r in enumerate((lines.limit(listed) if listed else lines).toLocalIterator(), 1):
                print(f"Match {i}: {r['value']}", file=out)
        print(f"\n[Statistics]\nmatches={int(n)} relations={sum(r['n_entries'] for r in rows)}", file=out)
    return {"count": int(n), "overflow": bool(over)}


def native_lines(arcs: DataFrame, labels: DataFrame, graph_id: int = 0) -> DataFrame:
    """(order, value) lines of a static data graph: dense ids in ascending order of the raw ones."""
    ids = ranked(snapshots.universe(arcs))
    known = ids.join(labels, "id")
    v = known.select(F.lit(1).alias("a"), F.col("rank").alias("b"), F.lit(0).cast("long").alias("c"),
                     F.concat_ws(" ", F.lit("v"), "rank", (F.ascii("label") - 64).cast("string")).alias("value"))
    one = ids.select(F.col("id").alias("src"), F.col("rank").alias("x"))
    two = ids.select(F.col("id").alias("dst"), F.col("rank").alias("y"))
    e = arcs.select("src", "dst").join(one, "src").join(two, "dst").select(
        F.lit(2).alias("a"), F.col("x").alias("b"), F.col("y").alias("c"), F.concat_ws(" ", F.lit("e"), "x", "y").alias("value"))
    head = f"{ids.count()} {arcs.count()} {len(LABELS)}"
    spark = arcs.sparkSession
    frame = spark.createDataFrame([(0, 0, 0, f"t # {graph_id}"), (0, 1, 0, head), (3, 0, 0, "t # -1")], "a int, b long, c long, value string")
    return frame.union(v).union(e).orderBy("a", "b", "c")


def write_native(path: str, lines: DataFrame) -> None:
    with open(path, "w", encoding="utf-8") as out:
        for r in lines.toLocalIterator():
            print(r["value"], file=out)


def convert(occurrences: DataFrame, seed: int = 42) -> DataFrame:
    """Lines of the static graph of an edge list; labels are drawn over all of its raw ids."""
    labels = seeded_labels(snapshots.universe(occurrences), seed)
    return native_lines(static.collapse(occurrences), labels)


def native_query(p: Pattern) -> str:
    """A pattern as a static query graph with arc label 1 and labels 1 to 5."""
    out = ["t # 0", f"{p.n} {len(p.arcs)} {len(LABELS)} 1"]
    out += [f"v {q} {LABELS.index(x) + 1}" for q, x in enumerate(p.labels)]
    out += [f"e {a} {b} 1" for a, b in p.arcs]
    return "\n".join([*out, "t # -1"]) + "\n"


def static_summary(rows: list[dict]) -> list[str]:
    yes = lambda b: "yes" if b else "no"
    return [f"data={r['data']} query={r['query']} Count: {r['count']} time_ms={r.get('ms', 0)} timed_out={yes(r['timed_out'])} truncated={yes(r['truncated'])}" for r in rows]


def peak_rss_mb() -> float:
    """Peak memory of the driver's Python process; executors report theirs as Spark metrics."""
    import resource

    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


class Timings:
    """Wall-clock milliseconds of named phases, written in the order of their first use."""

    def __init__(self):
        self.ms: dict[str, int] = {}

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.ms[name] = self.ms.get(name, 0) + round((time.perf_counter() - began) * 1000)

    def write(self, path: str | os.PathLike) -> None:
        with open(path, "w", encoding="utf-8") as out:
            out.writelines(f"{k}: {v} ms\n" for k, v in self.ms.items())

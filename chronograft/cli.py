"""Command line: ``python -m chronograft.cli COMMAND ...``.

Exit codes: 0 fine, 1 bad arguments, 2 bad input, 3 bad pattern, 4 output, 5 count overflow.
"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from chronograft.functions.labels import seeded_labels
from chronograft.operators import candidates, matcher, snapshots, static, stats
from chronograft.operators.graph import TemporalGraph
from chronograft.plans import decompose, pattern
from chronograft.sources import sinks, text


class _Once(argparse.Action):
    """A flag that may be given once."""

    def __init__(self, *a, **k):
        super().__init__(*a, nargs=0, default=False, **k)

    def __call__(self, parser, space, values, option=None):
        if getattr(space, self.dest):
            parser.error(f"{option} is given twice")
        setattr(space, self.dest, True)


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        self.print_usage(sys.stderr)
        print(f"error: {message}", file=sys.stderr)
        raise SystemExit(1)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="chronograft", allow_abbrev=False)
    sub = p.add_subparsers(dest="command", required=True, parser_class=_Parser)

    def add(name: str, *names: str):
        s = sub.add_parser(name, allow_abbrev=False)
        for n in names:
            s.add_argument(n)
        return s

    for name in ("match", "batch"):
        s = add(name, "data", "pattern")
        s.add_argument("k", type=int)
        s.add_argument("seed", nargs="?", default="42")
        s.add_argument("--count-only", action=_Once)
        s.add_argument("--no-prefilter", action=_Once)
        s.add_argument("--loose", action=_Once)
        s.add_argument("--dry-run", action=_Once)
        s.add_argument("--output", default=None)
    s = add("static", "data", "query")
    s.add_argument("output", nargs="?")
    s.add_argument("--time-limit", type=int, default=600)
    s.add_argument("--max-results", type=int, default=None)
    s = add("convert", "data", "pattern", "data_out", "pattern_out")
    s.add_argument("seed", nargs="?", default="42")
    s = add("bucket", "data", "output")
    s.add_argument("minutes", type=int, nargs="?", default=10)
    s.add_argument("--unique", action=_Once)
    for name in ("filter", "history"):
        add(name, "data", "output")
    add("count-durable", "history")
    return p


def _match(spark: SparkSession, a, data: str) -> int:
    timings = sinks.Timings()
    mode = "loose" if a.loose else "strict"
    p = pattern.parse(Path(a.pattern).read_text(encoding="utf-8"), mode)
    pattern.check(p, a.k, 1 if a.no_prefilter else 2)
    with timings.phase("load"):
        rows = text.read_occurrences(spark, data, mode)
        g = TemporalGraph.build(rows, seeded_labels(snapshots.universe(rows), pattern.check_seed(a.seed)), not a.no_prefilter)
    with timings.phase("decompose"):
        counts, lifespans = stats.label_tables(g)
        d = decompose.by_topology(p, counts) if a.no_prefilter else decompose.by_temporal(p, counts, lifespans)
    with timings.phase("candidates"):
        tree = candidates.reduced(g, p, d, a.k)
    with timings.phase("match"):
        found = matcher.match(g, p, a.k, matcher.arc_order(p, matcher.leg_sizes(g, a.k)), tree.all())
        output = a.output or f"{Path(data).stem}_matches.txt"
        try:
            result = sinks.write_report(output, tree, found, a.count_only)
        except OSError as e:
            print(f"error: {e}", file=sys.stderr)
            return 4
    timings.write(f"{output}.timings")
    print(f"{data}: root q{d.root}({p.labels[d.root]}) Count: {result['count']}")
    return 5 if result["overflow"] else 0


def _options_last(argv: list[str]) -> list[str]:
    """Arguments in order with all options behind them: a seed may stand on either side of a flag."""
    plain, options, rest = [], [], iter(argv)
    for x in rest:
        if not x.startswith("--"):
            plain.append(x)
        else:
            options.append(x)
            if x in ("--output", "--time-limit", "--max-results"):
                options += [y for y in [next(rest, None)] if y is not None]
    return plain + options


def _place(path: str) -> str:
    """A local path made absolute: Spark's own working directory may be another. URIs stay."""
    return path if "://" in path else os.path.abspath(path)


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(_options_last(argv))
    for name in ("data", "output", "history"):
        if getattr(a, name, None):
            setattr(a, name, _place(getattr(a, name)))
    try:
        if a.command == "match":
            return _match(spark, a, a.data)
        if a.command == "batch":
            files = sorted(map(str, Path(a.data).glob("*.txt")))
            if a.dry_run:
                print(*files, sep="\n")
                return 0
            return max((_match(spark, a, f) for f in files), default=2)
        if a.command == "static":
            graphs = text.native_data(spark, Path(a.data).read_text(encoding="utf-8"))
            queries = text.native_patterns(Path(a.query).read_text(encoding="utf-8"))
            rows = static.batch([(str(i), arcs, labels.withColumnRenamed("v", "id")) for i, (labels, arcs) in enumerate(graphs)],
                                [(str(i), q) for i, q in enumerate(queries)], time_limit=a.time_limit, max_results=a.max_results)
            lines = sinks.static_summary(rows)
            print(*lines, sep="\n")
            if a.output:
                Path(a.output).write_text("\n".join(lines) + "\n", encoding="utf-8")
            return 0
        if a.command == "convert":
            rows = text.read_occurrences(spark, a.data, "plain")
            p = pattern.parse(Path(a.pattern).read_text(encoding="utf-8"), "strict", self_loops=False)
            sinks.write_native(a.data_out, sinks.convert(rows, pattern.check_seed(a.seed)))
            Path(a.pattern_out).write_text(sinks.native_query(p), encoding="utf-8")
            return 0
        if a.command == "bucket":
            lines = spark.read.text(a.data)
            from pyspark.sql import functions as F

            grammar = text.GRAMMARS["plain"]
            part = lambda i: F.regexp_extract("value", grammar, i).cast("long")
            rows = lines.where(F.col("value").rlike(grammar)).select(part(1).alias("src"), part(2).alias("dst"), part(3).alias("t"), F.monotonically_increasing_id().alias("line_no"))
            made = (snapshots.bucket_unique if a.unique else snapshots.bucket)(rows, a.minutes, order="line_no")
            sinks.write_occurrences(made, a.output)
            return 0
        if a.command == "filter":
            sinks.write_occurrences(snapshots.filter_consecutive(text.read_occurrences(spark, a.data, "prefix")), a.output)
            return 0
        if a.command == "history":
            sinks.write_history(text.read_occurrences(spark, a.data, "prefix"), a.output)
            return 0
        r = snapshots.count_durable(text.read_history(spark, a.history)).first()
        print(f"arcs={r[0]} durable={r[1]}")
        return 0
    except pattern.PatternError as e:
        print(f"error: {e}", file=sys.stderr)
        return 3
    except (OSError, PySparkException) as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("chronograft").getOrCreate(), sys.argv[1:]))

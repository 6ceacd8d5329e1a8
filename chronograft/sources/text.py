"""Readers of text formats: temporal edge lists, history dumps and static graphs.

Text is split by Spark; a row that breaks its grammar fails the read with its content, or is handed
over on the side where the caller asks for the bad rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronograft.plans.pattern import Pattern, PatternError
from chronograft.storage import keep

OCCURRENCE = "src LONG, dst LONG, t INT"
_INT = r"([+-]?\d+)"
#: Line grammars: three integers, what may follow, and whether lines without a row are fine.
GRAMMARS = {
    "strict": rf"^\s*{_INT}\s+{_INT}\s+{_INT}\s*(#.*)?$",
    "plain": rf"^\s*{_INT}\s+{_INT}\s+{_INT}\s*$",
    "prefix": rf"^\s*{_INT}\s+{_INT}\s+{_INT}(\s.*)?$",
}
_EMPTY = {"strict": r"^\s*(#.*)?$", "plain": r"^\s*$", "prefix": r"^\s*$"}


def _cast(line: Column, grammar: str) -> list[Column]:
    part = lambda i: F.regexp_extract(line, grammar, i)
    return [part(1).cast("long").alias("src"), part(2).cast("long").alias("dst"), part(3).cast("int").alias("t")]


def bad_lines(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Lines that are neither a row nor empty in this grammar, or whose ids are negative."""
    lines = spark.read.text(path)
    odd = ~F.col("value").rlike(GRAMMARS[mode]) & ~F.col("value").rlike(_EMPTY[mode])
    return lines.where(odd | F.col("value").rlike(r"^\s*-\d|^\s*[+-]?\d+\s+-\d"))


def read_occurrences(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Occurrences of an edge list.

    strict: a row a line, comments and blank lines; plain: no comments; prefix: further tokens are
    passed over; loose: integers of the whole file in threes, line ends being white space, an
    incomplete last triple dropped (one task a file).
    """
    if mode == "loose":
        whole = spark.read.text(path, wholetext=True)
        bad = F.col("value").rlike(r"[^\s\d+-]|[+-](?!\d)|\d[+-]")
        checked = F.when(bad, F.raise_error(F.lit("not an integer in the edge list"))).otherwise(F.col("value"))
        numbers = F.regexp_extract_all(checked, F.lit(_INT), F.lit(1))
        triples = whole.select(numbers.alias("v")).select("v", F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.size("v") / 3).cast("int"), F.lit(1)) - 1)).alias("i"))
        at = lambda j: F.get("v", F.col("i") * 3 + j)
        rows = triples.where("size(v) >= 3").select(at(0).cast("long").alias("src"), at(1).cast("long").alias("dst"), at(2).cast("int").alias("t"))
    else:
        lines = spark.read.text(path).where(~F.col("value").rlike(_EMPTY[mode]))
        line = F.when(F.col("value").rlike(GRAMMARS[mode]), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad row: "), F.col("value"))))
        rows = lines.select(line.alias("line")).select(*_cast(F.col("line"), GRAMMARS[mode]))
    return checked_ids(rows)


def checked_ids(rows: DataFrame) -> DataFrame:
    """The rows; evaluating one with a negative vertex id fails. Negative snapshots are fine."""
    bad = (F.col("src") < 0) | (F.col("dst") < 0)
    src = F.when(bad, F.raise_error(F.concat_ws(" ", F.lit("negative vertex id:"), "src", "dst")).cast("long")).otherwise(F.col("src"))
    return rows.withColumn("src", src)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, times) of a history dump ``v1 v2 s1,s2,...``; other lines are passed over.

    Possessive, since Java matches a greedy group of that many repeats by recursion: thousands of
    times overflow the task's stack, which ends the executor.
    """
    grammar = r"^\s*+(\d++)\s++(\d++)\s++(-?\d++(?:,-?\d++)*+)\s*+$"
    lines = spark.read.text(path).where(F.col("value").rlike(grammar))
    part = lambda i: F.regexp_extract("value", grammar, i)
    return lines.select(part(1).cast("long").alias("src"), part(2).cast("long").alias("dst"), F.split(part(3), ",").cast("array<int>").alias("times"))


class NativeFormatError(PatternError):
    """A static graph file that breaks its format."""


def parse_native(text: str, query: bool = False) -> list[dict]:
    """Graphs of a static file: ``t # id``, a header, ``v id label``, ``e from to [label]``, ``t # -1``.

    Each is {id, vertices: [(v, label)], arcs: [(a, b, label)]}. A data vertex may come again with
    another label; a query vertex has one.
    """
    lines = [(n, x.split()) for n, x in enumerate(text.splitlines(), 1) if x.strip()]
    out, at = [], 0

    def fail(n: int, what: str):
        raise NativeFormatError(f"line {n}: {what}")

    def numbers(n: int, tokens: list[str]) -> list[int]:
        if not all(t.lstrip("-").isdigit() for t in tokens):
            fail(n, "not integers")
        return [int(t) for t in tokens]

    while True:
        if at >= len(lines):
            raise NativeFormatError("the closing t # -1 is missing")
        n, tokens = lines[at]
        if len(tokens) != 3 or tokens[:2] != ["t", "#"]:
            fail(n, "a graph has to begin with t # id")
        (graph_id,) = numbers(n, tokens[2:])
        if graph_id == -1:
            if at + 1 < len(lines):
                fail(lines[at + 1][0], "text after the closing t # -1")
            return out
        if graph_id < 0 or at + 1 >= len(lines):
            fail(n, "bad graph id or no header")
        n, tokens = lines[at + 1]
        head = numbers(n, tokens)
        if len(head) != 3 + query or any(x <= 0 for x in head[:1] + head[2:]) or head[1] < 0 or (head[1] == 0 and head[0] > 1 and query):
            fail(n, "bad header")
        n_v, n_e, n_l = head[:3]
        vertices, arcs, at = [], [], at + 2
        named, paired = set(), set()
        while at < len(lines) and lines[at][1][0] in ("v", "e"):
            n, tokens = lines[at]
            rest = numbers(n, tokens[1:])
            if tokens[0] == "v":
                if len(rest) != 2 or not 0 <= rest[0] < n_v or not 1 <= rest[1] <= n_l:
                    fail(n, "vertex or label out of range")
                key = rest[0] if query else tuple(rest)
                if key in named:
                    fail(n, "vertex again")
                named.add(key)
                vertices.append((rest[0], rest[1]))
            else:
                if len(rest) not in (2, 3) or not all(0 <= x < n_v for x in rest[:2]):
                    fail(n, "arc end out of range")
                label = rest[2] if len(rest) == 3 else 1
                if rest[0] == rest[1] or (rest[0], rest[1]) in paired or label < 1 or query and label > head[3]:
                    fail(n, "self-loop, arc again or arc label out of range")
                paired.add((rest[0], rest[1]))
                arcs.append((rest[0], rest[1], label if query else 1))
            at += 1
        if {v for v, _ in vertices} != set(range(n_v)) or len(arcs) != n_e:
            fail(n, "counts differ from the header")
        out.append({"id": graph_id, "vertices": vertices, "arcs": arcs})


def native_patterns(text: str) -> list[Pattern]:
    """Query graphs as patterns whose labels are the numbers as strings."""
    out = []
    for g in parse_native(text, query=True):
        label = dict(g["vertices"])
        p = Pattern(tuple(str(label[v]) for v in range(len(label))), tuple((a, b) for a, b, _ in g["arcs"]), arc_labels=tuple(str(x) for *_, x in g["arcs"]))
        if not p.connected():
            raise NativeFormatError("the query isn't connected")
        out.append(p)
    return out


def native_data(spark: SparkSession, text: str) -> list[tuple[DataFrame, DataFrame]]:
    """(vertex_labels (v, label), arcs (src, dst, label)) of each data graph."""
    out = []
    for g in parse_native(text):
        labels = spark.createDataFrame([(v, str(x)) for v, x in g["vertices"]], "v long, label string")
        out.append((labels, spark.createDataFrame([(a, b, str(x)) for a, b, x in g["arcs"]], "src long, dst long, label string")))
    return out


_LINE = {
    "t": r"^\s*t\s+#\s+(-?\d+)\s*$",
    "h": r"^\s*(\d+)\s+(\d+)\s+(\d+)\s*$",
    "v": r"^\s*v\s+(\d+)\s+(\d+)\s*$",
    "e": r"^\s*e\s+(\d+)\s+(\d+)(?:\s+(\d+))?\s*$",
}


def _native_lines(spark: SparkSession, path: str) -> DataFrame:
    """(graph, pos, kind, x, y, z): lines of static files, ``graph`` counting the markers so far from 1.

    Lines are placed by file, split and row. Markers are counted within a split by a window and over
    the splits by a running sum of one row a split, so no task reads more than a split.
    """
    value, split = F.col("value"), ["file", "block"]
    kind = F.coalesce(*[F.when(value.rlike(g), F.lit(k)) for k, g in _LINE.items()])
    raw = spark.read.text(path).select(value, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    number = lambda i: F.try_element_at(F.regexp_extract_all(value, F.lit(r"(-?\d+)")), F.lit(i)).try_cast("long")
    lines = raw.where(~value.rlike(r"^\s*$")).select(*split, "row", kind.alias("kind"), number(1).alias("x"), number(2).alias("y"), number(3).alias("z"))
    is_marker = F.coalesce((F.col("kind") == "t").cast("int"), F.lit(0))
    seen = keep(lines.withColumn("seen", F.sum(is_marker).over(Window.partitionBy(*split).orderBy("row"))), "native-lines")
    # a row a split
    ends = seen.groupBy(*split).agg(F.max("seen").alias("n"))
    before = F.sum("n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select(*split, F.coalesce(before, F.lit(0)).alias("before"))
    return seen.join(F.broadcast(starts), split).select((F.col("before") + F.col("seen")).alias("graph"), F.struct(*split, "row").alias("pos"), "kind", "x", "y", "z")


def _native_faults(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """(graph, fault): what is wrong with each graph, none if the files are sound."""
    at = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), F.col("pos")))
    count = lambda k: F.count_if(F.col("kind") == k)
    whole = lines.groupBy("graph").agg(
        F.max(F.when(F.col("kind") == "t", F.col("x"))).alias("id"), F.count("*").alias("n"), F.count_if(F.col("kind").isNull()).alias("n_odd"),
        count("h").alias("n_h"), at("h").alias("head"), at("v", "e").alias("body"), count("e").alias("n_arcs"))
    vertices = lines.where("kind = 'v'").groupBy("graph", "x").agg(F.count("*").alias("c")).groupBy("graph").agg(F.count("*").alias("n_named"))
    seen = whole.join(vertices, "graph", "left").join(heads, "graph", "left")
    closing = whole.agg(F.max_by("id", "graph").alias("id"), F.max("graph").alias("graph"))
    last = closing.select("graph", F.when(F.coalesce(F.col("id") != -1, F.lit(True)), F.lit("the closing t # -1 is missing")).alias("fault"))
    fault = (
        F.when(F.col("graph") == 0, "text before the first graph").when(F.col("id") < -1, "bad graph id").when((F.col("id") == -1) & (F.col("n") > 1), "text after the closing t # -1")
        .when(F.col("n_odd") > 0, "a line of no kind")
        .when((F.col("id") >= 0) & ((F.col("n_h") != 1) | (F.col("head") > F.col("body")) | (F.col("n_v") < 1) | (F.col("n_l") < 1)), "bad header")
        .when((F.col("id") >= 0) & ((F.coalesce("n_named", F.lit(0)) != F.col("n_v")) | (F.col("n_arcs") != F.col("n_e"))), "counts differ from the header"))
    again = whole.where("id = -1").select(F.max("graph").alias("m"), F.count("*").alias("c")).where("c > 1").select(F.col("m").alias("graph"), F.lit("t # -1 again").alias("fault"))
    inside = lines.join(heads, "graph")
    odd_v = inside.where("kind = 'v' AND (x NOT BETWEEN 0 AND n_v - 1 OR y NOT BETWEEN 1 AND n_l OR x IS NULL OR y IS NULL)").select("graph", F.lit("vertex or label out of range"))
    odd_e = inside.where("kind = 'e' AND (x NOT BETWEEN 0 AND n_v - 1 OR y NOT BETWEEN 0 AND n_v - 1 OR x = y OR z < 1 OR x IS NULL OR y IS NULL)").select("graph", F.lit("arc end or label out of range, or self-loop"))
    twice = lines.where("kind IN ('v', 'e')").groupBy("graph", "kind", "x", "y").agg(F.count("*").alias("c")).where("c > 1").select("graph", F.lit("vertex or arc again"))
    out = seen.select("graph", fault.alias("fault")).union(last).where("fault IS NOT NULL").union(again)
    return out.union(odd_v).union(odd_e).union(twice)


def read_native(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices (graph_id, v, label), arcs (graph_id, src, dst, label)) of data graphs of any size.

    The format and its checks are those of :func:`parse_native`, made as aggregates over the lines; an
    arc's label is 1 whatever the file says. Files are read in the order of their names.
    """
    lines = keep(_native_lines(spark, path), "native-graphs")
    heads = keep(lines.where("kind = 'h'").select("graph", F.col("x").alias("n_v"), F.col("y").alias("n_e"), F.col("z").alias("n_l")), "native-heads")
    wrong = _native_faults(lines, heads).limit(1).collect()
    if wrong:
        raise NativeFormatError(f"graph {wrong[0][0]}: {wrong[0][1]}")
    if lines.isEmpty():
        raise NativeFormatError("the closing t # -1 is missing")
    ids = lines.where("kind = 't' AND x >= 0").select("graph", F.col("x").alias("graph_id"))
    named = lines.join(ids, "graph")
    vertices = named.where("kind = 'v'").select("graph_id", F.col("x").alias("v"), F.col("y").cast("string").alias("label"))
    return vertices, named.where("kind = 'e'").select("graph_id", F.col("x").alias("src"), F.col("y").alias("dst"), F.lit("1").alias("label"))

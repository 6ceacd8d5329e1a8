"""Text sources, interval functions, dataset tools, static matching, reports and the command line."""

import pytest
from pyspark.sql import functions as F

from chronograft import cli
from chronograft.functions import intervals as iv
from chronograft.functions.labels import seeded_labels
from chronograft.operators import matcher, snapshots, static
from chronograft.operators.graph import TemporalGraph
from chronograft.plans.pattern import Pattern, of, parse
from chronograft.sources import sinks, text


def rows(df):
    return sorted(map(tuple, df.collect()))


def occ(spark, data):
    return spark.createDataFrame(data, "src long, dst long, t int")


def test_edge_lists(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("  # comment\n\n1 2 3 # occurrence\n\t4\t5 -6\n")
    assert rows(text.read_occurrences(spark, str(p))) == [(1, 2, 3), (4, 5, -6)]
    assert text.bad_lines(spark, str(p)).count() == 0
    p.write_text("1 2\n3 4 5 6\n")
    assert text.bad_lines(spark, str(p)).count() == 2
    with pytest.raises(Exception, match="bad row"):
        text.read_occurrences(spark, str(p)).collect()
    assert rows(text.read_occurrences(spark, str(p), "loose")) == [(1, 2, 3), (4, 5, 6)]
    p.write_text("1 2 3 9 9\n")
    assert rows(text.read_occurrences(spark, str(p), "prefix")) == [(1, 2, 3)]
    with pytest.raises(Exception, match="bad row"):
        text.read_occurrences(spark, str(p), "plain").collect()
    p.write_text("-1 2 3\n")
    with pytest.raises(Exception, match="negative vertex"):
        text.read_occurrences(spark, str(p)).collect()
    p.write_text("1 x 3\n")
    with pytest.raises(Exception, match="not an integer"):
        text.read_occurrences(spark, str(p), "loose").collect()


NATIVE = "t # 0\n3 2 3\nv 0 1\nv 1 2\nv 2 3\ne 0 1\ne 1 2\nt # -1\n"
PATH = "t # 0\n3 2 3 1\nv 0 1\nv 1 2\nv 2 3\ne 0 1 1\ne 1 2 1\nt # -1\n"


BAD = ["1 2\n3", NATIVE.replace("t # -1\n", ""), NATIVE.replace("3 2 3", "0 2 3"), NATIVE.replace("v 1 2", "v 0 1"), NATIVE.replace("v 2 3\n", ""),
       NATIVE.replace("v 2 3", "v 2 4"), NATIVE.replace("e 1 2", "e 1 3"), NATIVE.replace("e 1 2", "e 0 1"), NATIVE.replace("e 1 2", "e 1 1"), NATIVE + "x\n"]


@pytest.mark.parametrize("bad", BAD)
def test_native_rejects(bad):
    with pytest.raises(text.NativeFormatError):
        text.parse_native(bad)


def test_native_files(spark, tmp_path):
    f = tmp_path / "g.txt"
    read = lambda: [rows(x) for x in text.read_native(spark, str(f))]
    f.write_text(NATIVE.replace("e 1 2", "e 1 2 9").replace("v 2 3", "v 2 3\n\nv 2 1").replace("t # -1\n", "t # 7\n1 0 4\nv 0 4\nt # -1\n"))
    assert read() == [[(0, 0, "1"), (0, 1, "2"), (0, 2, "1"), (0, 2, "3"), (7, 0, "4")], [(0, 0, 1, "1"), (0, 1, 2, "1")]]
    for bad in ("", NATIVE.replace("t # -1\n", "")):
        f.write_text(bad)
        with pytest.raises(text.NativeFormatError):
            read()
    own = NATIVE.replace("t # -1\n", "")
    changes = {
        1: [], 2: [("v 1 2", "v 1 4")], 3: [("v 2 3", "v 2 3\nv 2 3")], 4: [("v 2 3\n", "")], 5: [("e 1 2", "e 1 3")], 6: [("e 1 2", "e 0 1")], 7: [("e 1 2", "e 1 1")],
        8: [("3 2 3", "0 2 3")], 9: [("3 2 3\n", "")], 10: [("3 2 3\nv 0 1", "v 0 1\n3 2 3")], 11: [("e 1 2", "e 1 2\nf 1 2")], 12: [("e 1 2", "e 1 2 0")],
        13: [("e 1 2", "")], 14: [("t # 0", "t # -2")], 15: [("e 1 2", "e 1 99999999999999999999")]}
    graphs = [own]
    for edits in list(changes.values())[1:]:
        g = own
        for a, b in edits:
            assert a in g
            g = g.replace(a, b)
        graphs.append(g)
    f.write_text("".join(graphs) + "t # -1\nmore\n")
    lines = text._native_lines(spark, str(f)).cache()
    heads = lines.where("kind = 'h'").select("graph", F.col("x").alias("n_v"), F.col("y").alias("n_e"), F.col("z").alias("n_l"))
    assert {r[0] for r in text._native_faults(lines, heads).collect()} == set(range(2, 17))
    lines.unpersist()
    # many splits, so that markers and lines of a graph lie in different tasks
    n = 1000
    f.write_text("".join(f"t # {g}\n{n} {n - 1} 5\n" + "".join(f"v {i} {i % 5 + 1}\n" for i in range(n)) + "".join(f"e {i} {i + 1}\n" for i in range(n - 1)) for g in range(2)) + "t # -1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        vertices, arcs = read()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert vertices == [(g, i, str(i % 5 + 1)) for g in range(2) for i in range(n)]
    assert arcs == [(g, i, i + 1, "1") for g in range(2) for i in range(n - 1)]


def test_filter_counts(spark):
    lines = ["1 2 3", "1 2 4 more", "  ", "", "x", "1 2", "3 4 1", "3 4 3", "5 5 1", "5 5 2", "99999999999999999999 1 1"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert tuple(snapshots.filter_counts(df).first()) == (3, 3, 2)
    assert tuple(snapshots.filter_counts(df.limit(0)).first()) == (0, 0, 0)


def test_labels_of_chunks(spark):
    from itertools import islice

    from chronograft.functions.labels import draws

    want = ["ABCDE"[x] for x in islice(draws(7), 5000)]
    for chunk in (700, 5000, 10_000):
        assert [r[1] for r in rows(seeded_labels(spark.range(5000), 7, chunk=chunk))] == want
    assert rows(seeded_labels(spark.range(0), 7)) == []


def test_start_and_order(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (4, 2), (5, 6)], "src long, dst long")
    lab = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "A"), (5, "A"), (6, "C")], "id long, label string")
    p = of("a:A b:B", "b:B c:C")
    assert static.start_vertex(arcs, lab, p) == [(1, 1, 1), (2, 2, 1), (0, 3, 2)]
    order = static.search_order(p, arcs, lab)
    assert sorted(order) == sorted(p.arcs)
    assert rows(static.match(arcs, lab, p, order=order)) == [(1, 2, 3), (4, 2, 3)] == rows(static.match(arcs, lab, p))


def test_native_query_rejects():
    for bad in (PATH.replace("e 1 2 1", "e 1 2 2"), PATH.replace("v 2 3", "v 1 3"), PATH.replace("e 1 2 1\n", "").replace("3 2 3 1", "3 1 3 1")):
        with pytest.raises(text.NativeFormatError):
            text.native_patterns(bad)


def _static(spark, arcs, labels, p, **limits):
    a = spark.createDataFrame(arcs, "src long, dst long")
    return static.run(a, spark.createDataFrame(labels, "id long, label string"), p, **limits)


def test_static_cases(spark):
    labels = [(0, "1"), (1, "2"), (2, "3")]
    path = text.native_patterns(PATH)[0]
    pos = [(0, 1), (1, 2)]
    assert _static(spark, [(1, 0), (1, 2)], labels, path)["count"] == 0
    assert _static(spark, pos, labels, path)["count"] == 1
    assert _static(spark, pos, labels, path, max_results=1) == {"count": 1, "timed_out": False, "truncated": False}
    pair = Pattern(("1", "2"), ((0, 1),))
    both = Pattern(("1", "2"), ((0, 1), (1, 0)))
    assert _static(spark, pos, labels, pair)["count"] == 1
    assert _static(spark, pos, labels, both)["count"] == 0
    assert _static(spark, [*pos, (1, 0)], labels, both)["count"] == 1
    one = Pattern(("1",), ())
    assert _static(spark, pos, labels, one)["count"] == 1
    assert _static(spark, pos, [(0, "1"), (3, "1")], one, max_results=1) == {"count": 1, "timed_out": False, "truncated": True}
    many = [(0, "1"), (0, "3"), (1, "2"), (2, "3")]
    assert _static(spark, pos, many, path)["count"] == 1
    data = text.native_data(spark, NATIVE)[0]
    assert rows(static.match(data[1], data[0].withColumnRenamed("v", "id"), path)) == [(0, 1, 2)]
    assert rows(static.match(data[1], data[0].withColumnRenamed("v", "id"), path, reduce=True)) == [(0, 1, 2)]


def test_convert(spark):
    o = occ(spark, [(1, 1, 0), (2, 3, 1), (2, 3, 2), (3, 2, 3)])
    assert [r["value"] for r in sinks.convert(o).collect()] == ["t # 0", "2 2 5", "v 0 4", "v 1 5", "e 0 1", "e 1 0", "t # -1"]
    assert sinks.native_query(of("a:A b:B")) == "t # 0\n2 1 5 1\nv 0 1\nv 1 2\ne 0 1 1\nt # -1\n"


def test_intervals(spark):
    df = spark.sql("select array(named_struct('start',1,'end',5), named_struct('start',10,'end',20)) a, array(named_struct('start',3,'end',8), named_struct('start',12,'end',14), named_struct('start',18,'end',22)) b")
    i = iv.intersect(F.col("a"), F.col("b"), 3)
    r = df.select(iv.format_intervals(i), iv.has_run(i, 3), iv.has_run(i, 4), iv.has_run(i, 0), iv.max_run(i)).first()
    assert tuple(r) == ("[3-5, 12-14, 18-20]", True, False, True, 3)
    u = spark.createDataFrame([(1, 3), (4, 4), (3, 6), (10, 11)], "start int, end int")
    assert u.agg(F.collect_list(F.struct("start", "end")).alias("i")).select(iv.union_duration(F.col("i"))).first()[0] == 8
    assert rows(iv.merged(u.withColumn("v", F.lit(1)), ["v"])) == [(1, 1, 6), (1, 10, 11)]
    empty = spark.createDataFrame([([],)], f"i {iv.INTERVALS}")
    assert tuple(empty.select(iv.union_duration(F.col("i")), iv.max_run(F.col("i")), iv.format_intervals(F.col("i"))).first()) == (0, 0, "[]")
    top = 2**31 - 1
    assert rows(snapshots.islands(occ(spark, [(1, 2, top), (1, 2, top - 1), (1, 2, -(2**31))]))) == [(1, 2, -(2**31), -(2**31)), (1, 2, top - 1, top)]


def test_prefilter_and_labels(spark):
    data = [(1000000, 5, 4), (8, 9, 3), (5, 1000000, 2), (8, 9, 1), (5, 1000000, 3)]
    runs = snapshots.consecutive_only(snapshots.islands(snapshots.dedup(occ(spark, data))))
    assert rows(runs) == [(5, 1000000, 2, 3)]
    label = lambda d, seed=42: rows(seeded_labels(snapshots.universe(occ(spark, d)), seed))
    assert label(data) == label(data[::-1]) != label(data, 43)
    assert label(data) == label([*data[:1], (8, 9, 2), *data[2:]])
    more = occ(spark, [*data, (9, 9, 7), (9, 9, 7)])
    all_runs = snapshots.islands(snapshots.dedup(more))
    assert tuple(snapshots.counters(more, all_runs).first()) == (7, 4, 4, 4)
    assert (8, 9, 2) in rows(snapshots.active_count(all_runs))
    assert (9, 9, 1) in rows(snapshots.active_count(all_runs))


def test_dataset_tools(spark):
    unix = spark.createDataFrame([(1, 2, 1000, 0), (1, 2, 1250, 1), (3, 4, 100, 2)], "src long, dst long, t long, line_no long")
    assert [r["t"] for r in snapshots.bucket(unix, 10, order="line_no").orderBy("line_no").collect()] == [1, 2, 1]
    assert snapshots.bucket_unique(unix, 10, order="line_no").count() == 3
    assert snapshots.timestamps(unix).orderBy("line_no").first()["t"] == "1970-01-01 00:16:40"
    o = occ(spark, [(1, 1, 1), (1, 1, 2), (2, 3, 1), (2, 3, 3), (2, 3, 3)])
    assert rows(snapshots.filter_consecutive(o)) == [(1, 1, 1), (1, 1, 2)]
    assert rows(snapshots.history(o)) == [(1, 1, "1,2"), (2, 3, "1,3,3")]
    assert tuple(snapshots.count_durable(snapshots.history(o)).first()) == (2, 1)
    lines = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "line_no long, value string")
    assert [r["value"] for r in snapshots.unique_lines(lines).orderBy("line_no").collect()] == ["b", "a"]


def test_long_histories(spark, tmp_path):
    at = F.col("id") % 5000
    many = spark.range(50_000).select(F.lit(1).cast("long").alias("src"), F.when(F.col("id") < 25_000, 2).otherwise(3).cast("long").alias("dst"), "id")
    many = many.select("src", "dst", F.when(F.col("dst") == 2, at * 2).otherwise(at - 9).cast("int").alias("t"))
    sinks.write_history(many, str(tmp_path / "h"))
    back = text.read_history(spark, str(tmp_path / "h"))
    want = {2: sorted(x * 2 for x in range(5000) for _ in range(5)), 3: sorted(x - 9 for x in range(5000) for _ in range(5))}
    assert {(r["src"], r["dst"]): r["times"] for r in back.collect()} == {(1, d): t for d, t in want.items()}
    assert tuple(snapshots.count_durable(back).first()) == (2, 1)
    odd = tmp_path / "odd"
    odd.write_text(f"1 2 {'5,' * 20_000}\n1 2 {'5,' * 20_000}x\n \t3\t4  -1,0 \n5 6 1,,2\n7 8\n\n7 8 {'5,' * 20_000}6\n")
    back = text.read_history(spark, str(odd))
    assert [(r["src"], r["dst"], r["times"]) for r in back.orderBy("src").collect()] == [(3, 4, [-1, 0]), (7, 8, [5] * 20_000 + [6])]
    assert tuple(snapshots.count_durable(back).first()) == (2, 2)


def test_report_lines(spark):
    g = TemporalGraph.build(occ(spark, [(1, 2, 1), (1, 2, 2), (1, 2, 5), (1, 2, 6)]), spark.createDataFrame([(1, "A"), (2, "B")], "id long, label string"))
    p = of("x:A y:B")
    assert sinks.match_lines(matcher.match(g, p, 2), p).first()["value"] == "q0(A)->1, q1(B)->2 | active=[1-2, 5-6]"


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    data, pat = tmp_path / "d.txt", tmp_path / "p.txt"
    data.write_text("10 20 1\n10 20 2\n")
    labels = {r["id"]: r["label"] for r in seeded_labels(snapshots.universe(text.read_occurrences(spark, str(data)))).collect()}
    pat.write_text(f"x:{labels[10]} y:{labels[20]}\n")
    for args in ([], ["--count-only"], ["42", "--count-only"], ["--count-only", "42"]):
        assert cli.run(spark, ["match", str(data), str(pat), "2", *args, "--output", "o.txt"]) == 0
        assert "Count: 1" in capsys.readouterr().out
    report = (tmp_path / "o.txt").read_text()
    assert "[Final Matches] Count:                    1" in report and "Match 1" not in report
    for bad in (["--count-only", "--count-only"], ["--other"], ["--count-only=true"], ["1", "2"]):
        with pytest.raises(SystemExit) as e:
            cli.run(spark, ["match", str(data), str(pat), "2", *bad])
        assert e.value.code == 1
    assert cli.run(spark, ["match", str(data), str(pat), "1"]) == 3
    assert cli.run(spark, ["match", str(tmp_path / "none"), str(pat), "2"]) == 2
    assert cli.run(spark, ["convert", str(data), str(pat), "d.static", "p.static"]) == 0
    capsys.readouterr()
    assert cli.run(spark, ["static", "d.static", "p.static"]) == 0
    assert "Count: 1 " in capsys.readouterr().out
    assert cli.run(spark, ["filter", str(data), "f"]) == 0 and cli.run(spark, ["history", str(data), "h"]) == 0
    assert rows(text.read_occurrences(spark, str(tmp_path / "f"))) == [(10, 20, 1), (10, 20, 2)]
    capsys.readouterr()
    assert cli.run(spark, ["count-durable", "h"]) == 0 and "arcs=1 durable=1" in capsys.readouterr().out
    assert cli.run(spark, ["bucket", str(data), "b", "10", "--unique"]) == 0
    assert rows(text.read_occurrences(spark, str(tmp_path / "b"))) == [(10, 20, 1)]
    assert parse(pat.read_text()).n == 2

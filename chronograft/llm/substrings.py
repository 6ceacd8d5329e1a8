"""Removal of byte strings that also start elsewhere, by suffix arrays over shards.

Strings of ``WINDOW`` (200) bytes are judged on the input: every byte that lies in one which starts at two or
more places, in the same text or another, is removed; no string crosses texts.

1. Equal texts are one item. A text that occurs twice is repeated throughout.
2. Anchors (see ``anchors``) cut each text into runs of windows. A run whose anchor is found at one
   place in the corpus holds no repeated window and leaves. This is exact and most of the corpus.
3. The other runs' bytes, segments, are grouped by anchor, equal segments being one with a count. Windows
   of different groups differ, so a shard holds whole groups.
4. A shard's segments are joined to texts of some MB, and their suffix arrays are made by induced
   sorting. The permuted common prefixes with the neighbours in suffix order tell each window that
   starts twice.
5. A group above ``GROUP_BYTES`` isn't brought together. Its windows are grouped anew by their two least hashes, then by
   four, eight and so on until all groups fit; by all hashes only equal windows are in a group, which are one
   segment with a count. So groups are bounded and suffix arrays remain the method.
6. A run of one byte is cut to twice the window before sorting: what is left out equals what is kept.
7. Marked windows go back to their texts, whose remaining bytes are joined.

Defined cases: null text is empty; texts under 200 bytes keep everything; a repeated row repeats
its text; null ids are kept; texts are cut into overlapping pieces of ``PIECE`` windows before hashing, so that a very
long one takes bounded memory beside itself; an empty table gives none. Only the id and the text are read, so other columns
may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograft.llm.anchors import WINDOW, refined, runs
from chronograft.llm.suffix import common_prefixes, suffix_array
from chronograft.llm.text import meet
from chronograft.storage import keep

#: Bytes of an anchor's segments beyond which they aren't brought into one task.
GROUP_BYTES = 8 << 20
#: Bytes of segments that one suffix array covers, whole groups together.
ARRAY_BYTES = 2 << 20
#: Windows of a piece of a text.
PIECE = 1 << 20


def _runs_of(texts: list[bytes]) -> list[tuple[np.ndarray, ...]]:
    """Runs of each text, long ones by pieces that overlap by a window less a byte."""
    cuts = [range(0, max(1, len(t) - WINDOW + 1), PIECE) for t in texts]
    found = iter(runs([t if len(c) == 1 else t[a : a + PIECE + WINDOW - 1] for t, c in zip(texts, cuts, strict=True) for a in c]))
    out = []
    for c in cuts:
        each = [(r[0], r[1] + a, r[2], r[3]) for a, r in zip(c, found, strict=False)]
        out.append(each[0] if len(each) == 1 else tuple(np.concatenate(x) for x in zip(*each, strict=True)))
    return out


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("places", pa.int32())]))
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            texts = [t or b"" for t in part.column(0).to_pylist()]
            found = _runs_of(texts)
            cuts = np.concatenate(([0], np.cumsum([len(r[0]) for r in found]))).astype(np.int32)
            cat = [np.concatenate([r[k] for r in found]) if found else np.zeros(0, np.int64) for k in range(4)]
            values = pa.StructArray.from_arrays([pa.array(cat[0], pa.int64()), *[pa.array(c, pa.int32()) for c in cat[1:]]], ["anchor", "first", "n", "places"])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array([len(t) for t in texts], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(cuts), values).cast(kind)],
                names=[*part.schema.names[1:], "n_bytes", "runs"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, text, segments) to one row a segment: anchor, digest of the bytes, place, bytes."""
    import xxhash

    for b in batches:
        for did, text, segments in zip(*(b.column(c).to_pylist() for c in ("did", "text", "segments")), strict=True):
            cut = [text[s["first"] : s["first"] + s["n"] + WINDOW - 1] for s in segments]
            yield pa.RecordBatch.from_arrays(
                [pa.array([did] * len(cut), pa.int64()), pa.array([s["anchor"] for s in segments], pa.int64()),
                 pa.array([xxhash.xxh3_64_intdigest(c) - (1 << 63) for c in cut], pa.int64()),
                 pa.array([s["first"] for s in segments], pa.int32()), pa.array([s["n"] for s in segments], pa.int32()), pa.array(cut, pa.binary())],
                names=["did", "anchor", "seg", "first", "n", "bytes"])


def _ranges(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"a": a, "b": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def _shortened(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """The bytes with every run of one byte cut to two windows, and where each remaining one was (None: nothing cut)."""
    d = np.frombuffer(data, np.uint8)
    edge = np.append(np.flatnonzero(np.append(True, d[1:] != d[:-1])), len(d))
    long = np.flatnonzero(np.diff(edge) > 2 * WINDOW)
    if not len(long):
        return d, None
    left = np.ones(len(d), bool)
    for i in long.tolist():
        left[edge[i] + WINDOW : edge[i + 1] - WINDOW] = False
    at = np.flatnonzero(left)
    return d[at], at


def repeated_windows(segments: list[bytes]) -> list[np.ndarray]:
    """For each segment, whether each of its windows starts at another place of the segments too."""
    cut = [_shortened(s) for s in segments]
    total = sum(len(d) for d, _ in cut) + len(cut)
    t = np.empty(total, np.uint16)
    starts, at = [], 0
    for d, _ in cut:
        starts.append(at)
        t[at : at + len(d)] = d
        t[at : at + len(d)] += 2
        t[at + len(d)] = 1
        at += len(d) + 1
    t[-1] = 0
    sa = suffix_array(t, 258)
    common = common_prefixes(t, sa)
    after = np.zeros(total, np.int64)
    after[sa[:-1]] = common[sa[1:]]
    twice = np.maximum(common, after) >= WINDOW
    out = []
    for a, s, (d, kept) in zip(starts, segments, cut, strict=True):
        some = twice[a : a + len(d) - WINDOW + 1]
        if kept is not None:  # windows left out are of one byte, and so repeated
            every = np.ones(len(s) - WINDOW + 1, bool)
            every[kept[: len(some)]] = some
            some = every
        out.append(some)
    return out


_MARKS = "anchor long, seg long, n int, ranges array<struct<a:int,b:int>>"
_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in anchor order: whole groups are gathered until they fill a suffix array."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def done(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        marks = repeated_windows([r[3] for r in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()),
             pa.array([_ranges(m) for m in marks], _RANGES)], names=["anchor", "seg", "n", "ranges"])

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "seg", "n", "bytes")), strict=True):
            if size >= ARRAY_BYTES and row[0] != held[-1][0]:
                yield done(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield done(held)


def _finer(level: int):
    """Rows (anchor, seg, n, off, bytes) of a hot group to rows of its refined groups, and where these lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for anchor, seg, n, off, data in zip(*(b.column(c).to_pylist() for c in ("anchor", "seg", "n", "off", "bytes")), strict=True):
                first, count, key = refined(data, level)
                cut = [data[a : a + c + WINDOW - 1] for a, c in zip(first.tolist(), count.tolist(), strict=True)]
                k = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * k, pa.int64()), pa.array([seg] * k, pa.int64()), pa.array([n] * k, pa.int32()), pa.array(first + off, pa.int32()),
                     pa.array(key, pa.int64()), pa.array([xxhash.xxh3_64_intdigest(c) - (1 << 63) for c in cut], pa.int64()),
                     pa.array(count, pa.int32()), pa.array(cut, pa.binary())],
                    names=["anchor", "seg", "n", "off", "fine", "part", "m", "bytes"])

    return run


def _marks_of_hot(hot: DataFrame, group_bytes: int, rows: int) -> DataFrame | None:
    """Marks (anchor, seg, n, ranges) of the windows of groups that are too large, refined until they aren't.

    ``hot`` has (anchor, seg, n, bytes), one row a distinct segment.
    """
    now, out, level = hot.withColumn("off", F.lit(0)), None, 1
    while rows:
        parts = keep(now.mapInArrow(_finer(level), "anchor long, seg long, n int, off int, fine long, part long, m int, bytes binary"), "finer")
        kinds = parts.groupBy("fine", "part", "m").agg(F.count("*").alias("times"), F.first("bytes").alias("bytes"))
        kinds = keep(kinds, "finer-kinds")
        groups = keep(kinds.groupBy("fine").agg(F.sum(F.octet_length("bytes")).cast("long").alias("size"), F.count("*").alias("n")), "finer-groups")
        sized = keep(meet(kinds, groups, "fine", kinds.count()), "finer-sized")
        whole = F.array(F.struct(F.lit(0).alias("a"), F.col("m").alias("b")))
        again = sized.where("times > 1").select("fine", "part", "m", whole.alias("ranges"))
        last = level + 1 >= WINDOW  # no more hashes than a window has
        small = sized.where((F.col("size") <= group_bytes) | F.lit(last)).repartition("fine").sortWithinPartitions("fine")
        small = small.select(F.col("fine").alias("anchor"), F.col("part").alias("seg"), F.col("m").alias("n"), "bytes").mapInArrow(_sorted_shard, _MARKS)
        found = again.union(small.where(F.size("ranges") > 0)).toDF("fine", "part", "m", "ranges")
        places = parts.select("anchor", "seg", "n", "off", "fine", "part", "m")
        moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("off")).alias("a"), (r["b"] + F.col("off")).alias("b")))
        marks = keep(places.join(found, ["fine", "part", "m"]).select("anchor", "seg", "n", moved.alias("ranges")), "finer-marks")
        out = marks if out is None else out.union(marks)
        # kinds that are there several times are marked, but the others have to meet them
        over = sized.where(F.col("size") > group_bytes)
        rows = 0 if last else over.where("times = 1").count()
        if rows:
            now = keep(parts.join(over.select("fine", "part", "m"), ["fine", "part", "m"], "left_semi").select("anchor", "seg", "n", "off", "bytes"), "finer-left")
        level = 2 * level + 1
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, spans, left = [], [], []
        for text, ranges in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
            gone, n, parts, at = 0, 0, [], 0
            for r in sorted(ranges, key=lambda r: r["a"]):
                if r["a"] > at or not n:  # a new maximal run; touching runs are one
                    parts.append(text[at : r["a"]])
                    n += 1
                    gone += r["b"] - r["a"]
                    at = r["b"]
                elif r["b"] > at:
                    gone += r["b"] - at
                    at = r["b"]
            parts.append(text[at:])
            removed.append(gone)
            spans.append(n)
            left.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays(
            [b.column("h"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary())],
            names=["of", "n_removed", "n_spans", "kept"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of each input row.

    kept is the remaining bytes as binary or, with ``digest``, their SHA-256 as hex. The latter moves no whole
    text of a document in which nothing repeats.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("h", F.unhex(F.md5("text")))
    kind = rows.schema["id"].dataType.simpleString()
    scan = rows.select("text", "id", "h", F.sha2("text", 256).alias("whole"))
    found = scan.mapInArrow(_find_runs, f"id {kind}, h binary, whole string, n_bytes long, runs array<struct<anchor:long,first:int,n:int,places:int>>")
    found = keep(found, "runs")

    texts = found.groupBy("h").agg(F.count("*").alias("copies"), F.first("runs").alias("runs"))
    each = texts.select("h", F.explode("runs").alias("r")).select("h", "r.*")
    shared = each.groupBy("anchor").agg(F.sum("places").alias("p"), F.count("*").alias("n")).where("p > 1")
    total = found.agg(F.sum(F.size("runs"))).first()[0] or 0
    shared = shared.select("anchor", F.col("n").alias("n_rows"))
    left = meet(each.withColumnRenamed("n", "windows"), shared.withColumnRenamed("n_rows", "n"), "anchor", total)
    left = left.select("h", "anchor", "first", F.col("windows").alias("n")).groupBy("h").agg(F.collect_list(F.struct("anchor", "first", "n")).alias("segments"))
    # one row of each text that still has segments; only these texts move
    one = rows.join(left.withColumnRenamed("h", "of"), F.col("h") == F.col("of")).groupBy("h").agg(
        F.first("text").alias("text"), F.first("segments").alias("segments"))
    whole = keep(one.select(F.monotonically_increasing_id().alias("did"), "h", "text", "segments"), "repeating")

    cut = whole.select("did", "text", "segments").mapInArrow(_cut, "did long, anchor long, seg long, first int, n int, bytes binary")
    places = keep(cut.drop("bytes"), "segments")
    counted = places.groupBy("anchor", "seg", "n").agg(F.count("*").alias("times"), F.min(F.struct("did", "first")).alias("at"))
    groups = counted.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + (WINDOW - 1)).alias("size"))
    again = counted.where("times > 1").select("anchor", "seg", "n", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("ranges"))
    # an anchor with one kind of segment needs sorting only where the segment is there once: it may repeat within
    sort = counted.join(groups, "anchor").where("kinds > 1 or times = 1").select("anchor", "seg", "n", "size", F.col("at.did").alias("did"), F.col("at.first").alias("first"))
    wanted = sort.groupBy("did").agg(F.collect_list(F.struct("anchor", "first", "n")).alias("segments"))
    source = whole.select("did", "text").join(wanted, "did").mapInArrow(_cut, "did long, anchor long, seg long, first int, n int, bytes binary")
    sized = source.join(groups.withColumnRenamed("anchor", "g").select("g", "size"), F.col("anchor") == F.col("g")).select("anchor", "seg", "n", "bytes", "size")
    cold = sized.where(F.col("size") <= group_bytes).repartition("anchor").sortWithinPartitions("anchor")
    marks = cold.select("anchor", "seg", "n", "bytes").mapInArrow(_sorted_shard, _MARKS)

    marked = again.union(marks.where(F.size("ranges") > 0))
    n_hot = groups.where(F.col("size") > group_bytes).count()
    if n_hot:
        marked = marked.union(_marks_of_hot(sized.where(F.col("size") > group_bytes).select("anchor", "seg", "n", "bytes"), group_bytes, n_hot))
    marked = marked.select("anchor", "seg", "n", F.explode("ranges").alias("r")).select("anchor", "seg", "n", "r.a", "r.b")
    spans = places.join(marked, ["anchor", "seg", "n"]).select(
        "did", F.struct((F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b") + (WINDOW - 1)).alias("b")).alias("r"))
    by_text = spans.groupBy("did").agg(F.collect_list("r").alias("ranges"))
    done = whole.select("did", "h", "text").join(by_text, "did").select("h", "text", "ranges").mapInArrow(
        _kept, "of binary, n_removed long, n_spans long, kept binary")

    if digest:
        done = done.select("of", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept"))
        ids, rest, nothing = found.select("id", "h", "n_bytes", "whole"), F.col("whole"), F.sha2(F.lit(b""), 256)
    else:
        ids, rest, nothing = rows.withColumn("n_bytes", F.length("text").cast("long")), F.col("text"), F.lit(b"")
    many = texts.where("copies > 1").select(F.col("h").alias("many"))
    out = ids.join(done, F.col("h") == F.col("of"), "left").join(many, F.col("h") == F.col("many"), "left")
    all_gone = F.col("many").isNotNull() & (F.col("n_bytes") >= WINDOW)
    return out.select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, nothing).when(F.col("of").isNotNull(), F.col("kept")).otherwise(rest).alias("kept"))

"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is the set of its windows of ``window`` consecutive words (a shorter item is one
window). A window can only occur where all of its words do, so its necessary prefix is one token:
the word of it that the fewest documents hold. Windows are indexed by that rarest word. A document
meets the index only at words that are some window's prefix; there the word's offset in the window
gives the one place where the window could lie (positional bound), which has to fit the document
(length bound), and the words of that place are then compared exactly.

Rarity is counted over all documents. The windows are joined in blocks of at most ``BLOCK`` bytes, whose size is counted
before they are broadcast; long items are cut into overlapping parts, so no item makes a block larger. A benchmark
of several blocks is joined a block at a time, each in a job of its own that writes only the documents it hits, told by
128 bits of their text; these are then put together and met by the documents. Neither the words of a document nor pairs
are shuffled.

Defined cases: null and empty texts have no words and no hits; a benchmark row without id or text
is passed over; items of the same id are one item; an item shorter than a window is one window, its own length; of words
that are equally rare the first of a window is its prefix; repeated documents are judged each on its own; texts of any
length are read whole; an empty benchmark hits nothing, an empty table gives an empty one. Input columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograft.llm.text import LOWER, UPPER, packed, unpacked
from chronograft.storage import keep

WINDOW = 8
MIN_ITEMS = 2
#: Bytes of the words of a block's windows, and windows of a part of an item.
BLOCK, PART = 16 << 20, 10_000

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _GAP, -1), lambda w: w != "")


def split_words(text: str | None) -> list[bytes]:
    """The words of a text: runs of ASCII letters, digits and non-ASCII characters, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Block:
    """Windows of some items: ``at`` has each prefix word's (offset, length) pairs, ``of`` the items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], rarity: dict[bytes, int], window: int):
        at: dict[bytes, set[tuple[int, int]]] = {}
        of: dict[bytes, set[str]] = {}
        for item, w in items:
            size = min(window, len(w))
            for s in range(len(w) - size + 1 if size else 0):
                part = w[s : s + size]
                ranks = [rarity.get(x, 0) for x in part]
                offset = ranks.index(min(ranks))
                if ranks[offset]:  # a word that no document holds settles its window
                    at.setdefault(part[offset], set()).add((offset, size))
                    of.setdefault(b" ".join(part), set()).add(item)
        self.at = {k: tuple(v) for k, v in at.items()}
        self.of = {k: tuple(v) for k, v in of.items()}

    def hits(self, w: list[bytes], mark: bytearray, found: set[str], full: set[str], window: int) -> None:
        """Marks the words inside occurrences and adds the items that occur, to ``full`` those by a whole window."""
        at, of, n = self.at, self.of, len(w)
        if at.keys().isdisjoint(w):
            return
        for i in [i for i, x in enumerate(w) if x in at]:
            for offset, size in at[w[i]]:
                start = i - offset
                if 0 <= start <= n - size and (items := of.get(b" ".join(w[start : start + size]))):
                    mark[start : start + size] = b"\1" * size
                    found.update(items)
                    if size == window:
                        full.update(items)


def _blocks(docs: DataFrame, bench: DataFrame, window: int, text_col: str, item_col: str, item_text: str) -> list[Callable[[], Broadcast]]:
    """What makes the broadcast of each block, one or more. The driver holds one block's windows at a time."""
    spark = docs.sparkSession
    items = bench.select(F.col(f"`{item_col}`").cast("string").alias("item"), _words(F.col(f"`{item_text}`")).alias("w"))
    items = items.where("item is not null and size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(PART))
    items = items.select("item", "w", F.explode(starts).alias("s")).select("item", "s", F.slice("w", F.col("s") + 1, F.lit(PART + window - 1)).alias("w"))
    items = keep(items.withColumn("size", window * F.octet_length(F.array_join("w", " ")).cast("long")), "items")
    count = max(1, -(-(items.agg(F.sum("size")).first()[0] or 0) // BLOCK))
    vocabulary = keep(items.select(F.explode("w").alias("word")).distinct(), "vocabulary")
    held = docs.select(F.explode(F.array_distinct(_words(F.col(f"`{text_col}`")))).alias("word"))
    rarity = keep(held.join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n")), "rarity")

    def made(b: int) -> Broadcast:
        part = items.where(F.pmod(F.xxhash64("item", "s"), F.lit(count)) == b).select("item", "w")
        rows = [(r[0], [x.encode() for x in r[1]]) for r in part.collect()]
        known = rarity if count == 1 else rarity.join(part.select(F.explode("w").alias("word")), "word", "left_semi")
        return spark.sparkContext.broadcast(Block(rows, {r[0].encode(): r[1] for r in known.collect()}, window))

    return [partial(made, b) for b in range(count)]


def _scan(block: Broadcast, window: int, text_at: str | None, hits_only: bool):
    """Rows (text, row) to (row, n_words, n_hit, items, n_full, ranges), of all documents or of those hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block.value
        for batch in batches:
            first = batch.column(0)
            texts = first if text_at is None else first.field(text_at)
            split = [split_words(t) for t in texts.to_pylist()]
            marks, found, full = [bytearray(len(w)) for w in split], [set() for _ in split], [set() for _ in split]
            for w, mark, items, whole in zip(split, marks, found, full, strict=True):
                index.hits(w, mark, items, whole, window)
            told = [pa.array([len(w) for w in split], pa.int64()), pa.array([m.count(1) for m in marks], pa.int64()),
                    pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array([sorted(x) for x in full], pa.list_(pa.string()))]
            if hits_only:
                told.append(pa.array([bytes(m) for m in marks], pa.binary()))
            out = pa.RecordBatch.from_arrays([first if text_at else batch.column(1), *told], names=["row", "n_words", "n_hit", "items", "full", *(["marks"] if hits_only else [])])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_())) if hits_only else out

    return run


_TOLD = "n_words long, n_hit long, items array<string>, full array<string>"


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Several blocks' marks of a text to the number of words any of them hit."""
    for b in batches:
        n = []
        for marks in b.column("marks").to_pylist():
            any_ = np.zeros(max(map(len, marks), default=0), np.uint8)
            for m in marks:
                any_ |= np.frombuffer(m, np.uint8)
            n.append(int(any_.sum()))
        yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(n, pa.int64()), b.column("items"), b.column("full")], names=["h", "n_hit", "items", "full"])


def _hits(docs: DataFrame, blocks: list[Callable[[], Broadcast]], window: int, text_col: str) -> DataFrame:
    """(h, n_hit, items, full) of each text that a block hits, equal texts being one; a job a block."""
    found = None
    for make in blocks:
        block = make()
        rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), _digest(text_col).alias("row"))
        each = keep(rows.mapInArrow(_scan(block, window, None, True), f"row binary, {_TOLD}, marks binary").dropDuplicates(["row"]), "hits")
        block.unpersist()
        found = each if found is None else found.union(each)
    put = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    grouped = found.groupBy(F.col("row").alias("h")).agg(F.collect_list("marks").alias("marks"), put("items"), put("full"))
    return grouped.mapInArrow(_merged, "h binary, n_hit long, items array<string>, full array<string>")


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items, full) of each document.

    items: the ids with occurring windows, sorted; full: those of which a window of ``window`` words occurs.
    """
    blocks = _blocks(docs, bench, window, text_col, item_col, item_text)
    narrow = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("row"))
    if len(blocks) == 1:
        kind = narrow.schema["row"].dataType.simpleString()
        return narrow.mapInArrow(_scan(blocks[0](), window, None, False), f"row {kind}, {_TOLD}").withColumnRenamed("row", id_col)
    found = keep(_hits(docs, blocks, window, text_col).withColumnRenamed("h", "of"), "hits-merged")
    none = F.array().cast("array<string>")
    rows = narrow.select("row", _digest("text").alias("h"), F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(found, F.col("h") == F.col("of"), "left")
    return out.select(F.col("row").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", none).alias("items"), F.coalesce("full", none).alias("full"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The input rows, with all their columns, without those in which ``min_items`` items occur.

    With ``min_items`` 1 an item shorter than a window counts only beside another, so that a benchmark row of a word or
    two doesn't take every document that holds these.
    """
    blocks = _blocks(docs, bench, window, text_col, item_col, item_text)
    gone = (F.size("items") >= max(2, min_items)) | (F.size("full") >= min_items)
    if len(blocks) == 1:
        rows = packed(docs).withColumnRenamed("doc", "row")
        kind = rows.schema["row"].dataType.simpleString()
        judged = rows.mapInArrow(_scan(blocks[0](), window, text_col, False), f"row {kind}, {_TOLD}")
        return unpacked(judged.where(~gone).withColumnRenamed("row", "doc"), docs.schema)
    found = keep(_hits(docs, blocks, window, text_col).where(gone).select(F.col("h").alias("of")), "hits-merged")
    rows = packed(docs, _digest(text_col).alias("h"))
    return unpacked(rows.join(found, F.col("h") == F.col("of"), "left_anti"), docs.schema)


def read_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")

"""SimHash near-dedup: fingerprints linked at a small Hamming distance, found by pivot tables.

A text's fingerprint has a bit set where more than half of its shingle hashes have it. Two
fingerprints are linked at ``max_bits`` (3) or fewer differing bits, and a group is what links
join. How links are found:

1. Equal fingerprints are one item from here on, so copies cost nothing.
2. Buckets. The 64 bits are cut into six blocks; two linked items differ in at most three blocks,
   so they agree in the other three. Each of the 20 choices of three blocks is one equi-key of
   about 32 bits, and linked items share at least one key. None is lost.
3. A bucket of more than ``BUCKET`` items is refined instead of being gathered: its free bits are
   cut into six blocks again, by the same argument, and once more if that isn't enough. About 16 and then 8 bits are
   left free, and since items differ, a bucket then has a few hundred items at most, however dense they lie.
4. Pivot tables. Inside a bucket, Hamming distances to 32 reference fingerprints are computed once an item.
   By the triangle inequality a linked pair's distances to any reference differ by at most
   ``max_bits``; pairs whose maximum coordinate difference is larger are discarded, and the
   survivors are verified on the fingerprints. Only links to a spanning forest leave the bucket.
5. Components are found by star rounds over the links.

The references alone discard a random pair with probability about 0.54 each. They have no key that
an equi-join could use, which is why step 2 comes first: it keeps the pairs to be discarded few.

Defined cases: a text without words (null, empty, blank) has fingerprint 0, which links like any
other; fewer words than a shingle make one shingle; repeated rows are copies; a null id is kept and
never chosen as the component id unless its group has no other; an exact half of a bit's hashes leaves it unset; a
text of any length is read whole, its hashes counted in parts; an empty table gives an empty one. Only the id and the
text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograft.llm.components import components
from chronograft.llm.text import meet
from chronograft.storage import keep

SHINGLE, SEED, MAX_BITS = 3, 42, 3
BUCKET = 2048
N_PIVOTS = 32

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles in order, u64."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    buf = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(buf, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1)
    lo = np.concatenate(([0], ends[: n - shingle])).tolist()
    hi = (ends[shingle - 1 :] - 1).tolist()
    return np.array([digest(buf[a:b], SEED) for a, b in zip(lo, hi, strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    hashes = shingle_hashes(text, shingle)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t) for t in b.column(0).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(prints)], names=[*b.schema.names[1:], "fp"])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text hash h, fp) of each input row; fp holds the 64 bits as a signed long."""
    text = F.col(f"`{text_col}`")
    narrow = docs.select(text.cast("string").alias("t"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(_fingerprints, f"id {kind}, h long, fp long")


def _signed(bits: list[int]) -> int:
    """The mask of these bit positions as a signed 64-bit number."""
    return int(np.array([sum(1 << b for b in bits)], dtype=np.uint64).view(np.int64)[0])


def choices(free: list[int]) -> list[tuple[list[int], list[int]]]:
    """(bits that must agree, bits still free) for each choice of three of six blocks of ``free``."""
    blocks = [[int(b) for b in x] for x in np.array_split(np.array(free), 6)]
    out = []
    for chosen in combinations(range(6), 3):
        out.append(([b for i in chosen for b in blocks[i]], [b for i in range(6) if i not in chosen for b in blocks[i]]))
    return out


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: a fixed sequence of mixed counters."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def forest(items: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(item, least item of its group) for the items, distinct uint64, that a link joins to another.

    All pairs within ``max_bits`` are found: rows of the pivot table are compared by their maximum
    coordinate difference, the surviving pairs by the fingerprints themselves.
    """
    items = np.sort(items)
    n = len(items)
    if n == 2:
        near = np.bitwise_count(items[:1] ^ items[1:]) <= max_bits
        return items[1:][near], items[:1][near]
    table = np.bitwise_count(items[:, None] ^ pivots()[None, :]).astype(np.int8)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n - 1):
        left = np.arange(i + 1, n)
        for c in range(0, table.shape[1], 8):  # the longer a pair survives, the more coordinates it sees
            left = left[np.abs(table[left, c : c + 8] - table[i, c : c + 8]).max(axis=1) <= max_bits]
            if not len(left):
                break
        left = left[np.bitwise_count(items[left] ^ items[i]) <= max_bits]
        for j in left.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    least = np.array([find(i) for i in range(n)])
    moved = least != np.arange(n)
    return items[moved], items[least[moved]]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        us, vs = [], []
        column = b.column(0)
        values, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            u, v = forest(values[lo:hi])
            us.append(u)
            vs.append(v)
        u, v = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (us, vs))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _members(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets (t, key) of two or more with ``n``, the size of their bucket; and the stored sizes."""
    sizes = keep(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    return keyed.join(sizes, ["t", "key"]), sizes


def _keyed(items: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for t, mask in masks])
    return items.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")


def _refinements() -> list[list[tuple[int, int, int]]]:
    """For each level of refinement, (bucket kind, finer kind, mask of the bits that agree), constants."""
    kinds = [(t, agreed, free) for t, (agreed, free) in enumerate(choices(list(range(64))))]
    out = []
    for _ in range(2):
        start = kinds[-1][0] + 1
        finer = [(t, start + 20 * i + c, agreed + more, left) for i, (t, agreed, free) in enumerate(kinds) for c, (more, left) in enumerate(choices(free))]
        out.append([(t, t2, _signed(bits)) for t, t2, bits, _ in finer])
        kinds = [(t2, bits, left) for _, t2, bits, left in finer]
    return out


def links(items: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): a spanning forest of every bucket's links between the distinct fingerprints ``fp``."""
    spark = items.sparkSession
    members, sizes = _members(_keyed(items, [(t, _signed(agreed)) for t, (agreed, _) in enumerate(choices(list(range(64))))]))
    buckets = members.where(F.col("n") <= bucket).select("t", "key", "fp")
    for level in _refinements():
        if sizes.where(F.col("n") > bucket).isEmpty():
            break
        # 400 and 8,000 rows
        finer = F.broadcast(spark.createDataFrame(level, "t int, t2 int, mask long"))
        hot = keep(members.where(F.col("n") > bucket).select("t", "fp"), "hot-buckets").join(finer, "t")
        members, sizes = _members(hot.select(F.col("t2").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"))
        last = level[0][1] > 400
        buckets = buckets.union((members if last else members.where(F.col("n") <= bucket)).select("t", "key", "fp"))
    return buckets.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_linked, "u long, v long")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with id, h and fp; fp with its group's first row ``chosen`` by id, then text hash)."""
    prints = keep(with_fingerprints(docs, id_col, text_col), "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "h"))
    items = keep(prints.groupBy("fp").agg(first.alias("chosen"), F.count("*").alias("n")), "prints-distinct")
    joined = components(links(items.select("fp")))
    roots = items.join(joined, items["fp"] == joined["node"], "left").select("fp", "n", "chosen", F.coalesce("root", "fp").alias("root"))
    groups = roots.groupBy("root").agg(F.min("chosen").alias("chosen"))
    return prints, roots.select("fp", "n", "root").join(groups, "root").select("fp", "n", "chosen")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of each input row."""
    prints, groups = _grouped(docs, id_col, text_col)
    # empty texts and copies all have one fingerprint
    out = meet(prints, keep(groups, "groups"), "fp", prints.count())
    return out.select(F.col("id").alias(id_col), "fp", F.col("chosen.id").alias("component_id"))

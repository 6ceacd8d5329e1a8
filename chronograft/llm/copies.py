"""Near copies by SimHash and pivot distance tables, verified on word shingles.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of ``SIMILARITY`` (0.8) or more, or if
of either text such a share of the words lies in shingles that the other holds too. A changed word takes five shingles
away but one word, so the latter finds copies of which one word in twelve was changed, whose sets have a Jaccard
similarity of 0.45 only. A shingle counts where it is first in its text, so repeating a phrase makes no copies.

1. Equal texts are one, told by 128 bits. A text has a 256-bit SimHash in which each distinct shingle votes once, so a
   phrase that it repeats counts for no more than another, and the ``KEYS`` least hashes of its shingles.
2. Texts that share a least hash form a bucket. Two texts share a given one with a probability of their Jaccard
   similarity; at 0.45 a pair has none of twelve in common in 8 cases of 10,000.
3. Inside a bucket, Hamming distances to reference fingerprints, members far from each other, make a pivot table. Pairs whose
   distances to any reference differ by more than ``MAX_BITS`` are discarded, the others compared by their bits.
   At the least similarity some 75 of 256 bits differ (sd 7), between unrelated texts 128 (sd 8).
4. What is left is verified on the whole sequences of shingles, in large buckets only pairs that share more than the
   passages which many of its texts share. Pairs that are linked already aren't, so a bucket of n copies costs about n
   comparisons. Only a spanning forest leaves a bucket; components come from star rounds.

A bucket above ``BUCKET`` members is cut into chunks, each pair of which is a task's work, so none is gathered and no pair
is lost. ``exact`` takes every shingle as a key and any number of bits, and so finds all links for certain.

Defined cases: texts without words, null ones too, are copies of each other; fewer words than a shingle make one
shingle; repeated rows are copies, and rows equal in id and text are
interchangeable; rows without an id come last in their group, ties in id go by the text's digest; texts of any length are
read whole; an empty table gives an empty one. Input columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronograft.llm.components import components
from chronograft.llm.simhash import pivots, shingle_hashes
from chronograft.llm.text import SPACES, meet, packed, unpacked
from chronograft.storage import keep

SHINGLE, KEYS, MAX_BITS, SIMILARITY = 5, 12, 100, 0.8
#: Members of a chunk whose bits are compared, and shingles of a chunk whose texts are.
BUCKET, SHINGLES = 2048, 1 << 21
REFERENCES = 16
#: Texts of a bucket that a shingle has to be in to be common there; what a text weighs beside its shingles.
COMMON, TEXT = 64, 500


def _spread(h: np.ndarray, n: int) -> np.ndarray:
    """``n`` further hashes of each hash, one a row."""
    with np.errstate(over="ignore"):
        z = h[None, :] + pivots(n)[:, None]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def wide_fingerprint(text: str | None, n_keys: int = KEYS) -> tuple[np.ndarray, np.ndarray, int]:
    """(256 bits as four words, the least hashes, number of shingles) of a text; without words no keys."""
    hashes = shingle_hashes(text, SHINGLE)
    n = len(hashes)
    hashes = np.unique(hashes)
    if not n:
        return np.zeros(4, np.uint64), hashes, 0
    total, least = np.zeros(256, np.int64), np.full(n_keys, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        some = _spread(hashes[at : at + 4096], 4 + n_keys)
        bits = np.unpackbits(np.ascontiguousarray(some[:4].T).view(np.uint8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int32)
        least = np.minimum(least, some[4:].min(1))
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8"), least, n


def _prints(exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            wide = [wide_fingerprint(t) for t in texts]
            keys = [np.unique(shingle_hashes(t, SHINGLE)) for t in texts] if exact else [w[1] for w in wide]
            lists = [pa.array([x.view(np.int64) for x in xs], pa.list_(pa.int64())) for xs in ([w[0] for w in wide], keys)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *lists, pa.array([w[2] for w in wide], pa.int64())], names=[*b.schema.names[1:], "bits", "keys", "n_shingles"])

    return run


def distances(bits: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Hamming distances of each of ``bits`` to each of ``to``, rows of four words."""
    return np.bitwise_count(bits[:, None, :] ^ to[None, :, :]).sum(2, dtype=np.int16)


def references(bits: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """Up to ``n`` of the fingerprints, each the farthest from those before it."""
    chosen = [0]
    least = distances(bits, bits[:1])[:, 0]
    while len(chosen) < n and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, distances(bits, bits[chosen[-1:]])[:, 0])
    return bits[chosen]


def near_pairs(bits: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with i < j of all pairs within ``max_bits``, in order of i, some rows at a time."""
    n = len(bits)
    table = distances(bits, references(bits)) if n > 4 else None
    step = max(1, (1 << 19) // n)
    for lo in range(0, n - 1, step):
        rows = np.arange(lo, min(n - 1, lo + step))
        left = np.arange(n)[None, :] > rows[:, None]
        if table is not None:
            for c in range(table.shape[1]):  # by maximum coordinate difference
                left &= np.abs(table[rows, c][:, None] - table[None, :, c]) <= max_bits
        i, j = np.nonzero(left)
        i += lo
        near = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int16) <= max_bits
        yield i[near], j[near]


def candidates(bits: np.ndarray, keys: np.ndarray, t: int, max_bits: int) -> np.ndarray:
    """Which members of a bucket of key ``t`` are within ``max_bits`` of another that shares no earlier key with them."""
    out = np.zeros(len(bits), bool)
    for i, j in near_pairs(bits, max_bits):
        fresh = np.ones(len(i), bool)
        for k in range(t):
            fresh &= keys[i, k] != keys[j, k]
        out[i[fresh]] = True
        out[j[fresh]] = True
    return out


def _covered(held: np.ndarray) -> int:
    """Words that lie in one of a text's shingles of which ``held`` is true."""
    n = len(held) + SHINGLE - 1
    wide = np.zeros(n + SHINGLE - 1, bool)
    wide[SHINGLE - 1 : n] = held
    out = wide[:n].copy()
    for k in range(1, SHINGLE):
        out |= wide[k : n + k]
    return int(out.sum())


class Shingled:
    """The texts of a bucket as numbers of their shingles, in order, and where each shingle is first in its text."""

    def __init__(self, hashes: list[np.ndarray]):
        values, places = np.unique(np.concatenate(hashes), return_inverse=True)
        self.places = np.split(places, np.cumsum([len(x) for x in hashes])[:-1])
        self.held = np.zeros(len(values), bool)
        self.first = []
        for p in self.places:
            first = np.zeros(len(p), bool)
            first[np.unique(p, return_index=True)[1]] = True
            self.first.append(first)
        self.words = [_covered(f) for f in self.first]

    def plausible(self, similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
        """What leaves, of some texts, those that can be like text i. No one that is gets lost.

        Shingles of over ``COMMON`` texts tell little. A text that they alone make not alike to anything has to share
        another shingle with a text like it, which an index of the other shingles finds; the remaining texts are
        compared with each other.
        """
        n = len(self.places)
        mine = [p[f] for p, f in zip(self.places, self.first, strict=True)]
        values, of = np.concatenate(mine), np.repeat(np.arange(n), [len(x) for x in mine])
        counts = np.bincount(values, minlength=len(self.held))
        common = counts > COMMON
        full = np.zeros(n, bool)
        for i, (p, f) in enumerate(zip(self.places, self.first, strict=True)):
            some = common[p] & f
            full[i] = some.sum() >= similarity * f.sum() - 1e-9 or _covered(some) >= similarity * self.words[i] - 1e-9
        holders = of[np.argsort(values, kind="stable")]
        ends = np.cumsum(counts)
        marked = np.zeros(n, bool)

        def run(i: int, near: np.ndarray) -> np.ndarray:
            rare = [holders[ends[v] - counts[v] : ends[v]] for v in mine[i][~common[mine[i]] & (counts[mine[i]] > 1)].tolist()]
            some = np.concatenate(rare) if rare else np.zeros(0, np.int64)
            marked[some] = True
            left = near[marked[near] | (full[i] & full[near])]
            marked[some] = False
            return left

        return run

    def alike(self, i: int, j: int, similarity: float) -> bool:
        self.held[self.places[j]] = True
        mine = self.held[self.places[i]] & self.first[i]
        self.held[self.places[j]] = False
        both = int(mine.sum())
        if both >= similarity * (int(self.first[i].sum()) + int(self.first[j].sum()) - both) - 1e-9:
            return True
        if not both or _covered(mine) < similarity * self.words[i] - 1e-9:
            return False
        self.held[self.places[i]] = True
        other = self.held[self.places[j]] & self.first[j]
        self.held[self.places[i]] = False
        return _covered(other) >= similarity * self.words[j] - 1e-9


def forest(nodes: np.ndarray, bits: np.ndarray, hashes: list[np.ndarray], max_bits: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(node, first node of its group) for the nodes that a link joins to another."""
    order = np.argsort(nodes, kind="stable")
    nodes, bits = nodes[order], bits[order]
    texts = Shingled([hashes[i] for i in order.tolist()])
    root = np.arange(len(nodes))
    left = texts.plausible(similarity) if len(nodes) > COMMON else None
    for us, vs in near_pairs(bits, max_bits):
        cuts = np.flatnonzero(np.diff(us)) + 1
        for i, near in zip(us[np.concatenate(([0], cuts))].tolist() if len(us) else (), np.split(vs, cuts), strict=False):
            if left and len(near := near[root[near] != root[i]]) > 4:
                near = left(i, near)
            while len(near := near[root[near] != root[i]]):
                j, near = int(near[0]), near[1:]
                if texts.alike(i, j, similarity):
                    a, b = sorted((root[i], root[j]))
                    root[root == b] = a
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _rows_of(column: pa.Array) -> np.ndarray:
    """An array column's values, u64, as a matrix; rows are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return flat.reshape(len(column), -1)


def _candidates(max_bits: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts, keys, nodes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t, key, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                values = members.values
                some = np.ones(len(values), bool) if exact else candidates(_rows_of(values.field("bits")), _rows_of(values.field("keys")), t, max_bits)
                nodes.append(values.field("node").to_numpy(zero_copy_only=False)[some])
                ts.append(np.full(len(nodes[-1]), t, np.int32))
                keys.append(np.full(len(nodes[-1]), key, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ts, keys, nodes)], names=["t", "key", "node"])

    return run


def _linked(max_bits: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for members in b.column(0):
                values = members.values
                nodes = values.field("node").to_numpy(zero_copy_only=False)
                hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in values.field("shingles")]
                u, v = forest(nodes, _rows_of(values.field("bits")), hashes, max_bits, similarity)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([shingle_hashes(t, SHINGLE).tobytes() for t in b.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), found], names=["node", "shingles"])


def _chunked(members: DataFrame, weight: Column, most: int) -> DataFrame:
    """``members`` of keys of two members or more, with the number of ``chunks`` of a weight of ``most`` that each is cut into."""
    sizes = members.groupBy("t", "key").agg(F.count("*").alias("n"), F.ceil(F.sum(weight) / most).cast("int").alias("chunks")).where("n > 1")
    of = F.struct("t", "key").alias("of")
    return meet(members.select(of, *[c for c in members.columns if c not in ("t", "key")]), sizes.select(of, "n", "chunks"), "of", members.count())


def _compared(members: DataFrame, *carried: str) -> DataFrame:
    """(t, key, m): these columns of the members of each key, a row for each pair of its chunks, which is a task's work."""
    mine = F.pmod(F.xxhash64("node", "of"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    dealt = members.select("of", *carried, F.explode(pairs).alias("c"))
    grouped = dealt.groupBy("of", "c").agg(F.collect_list(F.struct(*carried)).alias("m")).where(F.size("m") > 1)
    return grouped.select(F.col("of.t").alias("t"), F.col("of.key").alias("key"), "m")


def links(texts: DataFrame, rows: DataFrame, similarity: float = SIMILARITY, max_bits: int = MAX_BITS, bucket: int = BUCKET, exact: bool = False) -> DataFrame:
    """(u, v) over stored ``texts`` (node, h, bits, keys, n_shingles): forests of the links among texts that share a key.

    ``rows`` (h, t) has the texts themselves.
    """
    prints = texts.select("node", "bits", "keys")
    if exact:
        max_bits = 256
        prints = prints.withColumn("keys", F.array().cast("array<long>"))
        keyed = texts.select("node", F.lit(0).alias("t"), F.explode("keys").alias("key"))
    else:
        keyed = texts.select("node", F.posexplode("keys").alias("t", "key"))
    shared = keep(_chunked(keep(keyed, "keys"), F.lit(1), bucket), "shared")
    found = _compared(shared.join(prints, "node"), "node", "bits", "keys").mapInArrow(_candidates(max_bits, exact), "t int, key long, node long")
    found = keep(found.distinct().join(texts.select("node", "h", "bits", "n_shingles"), "node"), "candidates")
    some = found.select("node", "h").distinct()
    wanted = rows.groupBy("h").agg(F.first("t").alias("t")).join(some, "h").select("node", "t")
    sequences = keep(wanted.mapInArrow(_sequences, "node long, shingles binary"), "sequences")
    members = _chunked(found.drop("h"), F.col("n_shingles") + TEXT, SHINGLES).join(sequences, "node")
    return _compared(members, "node", "bits", "shingles").select("m").mapInArrow(_linked(max_bits, similarity), "u long, v long")


def keep_one_each(docs: DataFrame, similarity: float = SIMILARITY, exact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, with all columns, of which one row of each group of near copies stays: the one with the least id."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.when(F.btrim(text, F.lit(SPACES)) != "", text).otherwise(F.lit(""))))
    narrow = docs.select(text.alias("t"), F.col(f"`{id_col}`").alias("id"), digest.alias("h"))
    kind = narrow.schema["id"].dataType.simpleString()
    prints = narrow.mapInArrow(_prints(exact), f"id {kind}, h binary, bits array<long>, keys array<long>, n_shingles long")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "h"))
    texts = prints.groupBy("h").agg(*[F.first(c).alias(c) for c in ("bits", "keys", "n_shingles")], first.alias("chosen"))
    # written, so that a text's number stays what it is
    texts = keep(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    joined = components(links(texts, narrow.select("h", "t"), similarity, exact=exact)).withColumnRenamed("node", "of")
    roots = texts.select("node", "chosen").join(joined, F.col("node") == F.col("of"), "left").select("chosen", F.coalesce("root", "node").alias("root"))
    stay = roots.groupBy("root").agg(F.min("chosen").alias("chosen")).select(F.col("chosen.id").alias("stays"), F.col("chosen.h").alias("stays_h"))
    rows = packed(docs, F.col(f"`{id_col}`").alias("id"), digest.alias("h"))
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("stays")) & (F.col("h") == F.col("stays_h")), "left_semi")
    return unpacked(kept.groupBy("id", "h").agg(F.first("doc").alias("doc")), docs.schema)

"""Seeded vertex labels: uniform A..E drawn in ascending order of all ids of the raw input.

The stream is MT19937 seeded by its standard initialisation, the draw a multiply-shift with
rejection, as common C++ libraries do it. The driver only steps the generator, a vectorised pass that
leaves one state a chunk; tasks draw the labels of their chunks from those states, and labels meet the
ids by rank. Ranks come from a range partitioning, not from one task.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronograft.storage import keep

LABELS = "ABCDE"


def generator(seed: int) -> random.Random:
    """The standard library's Mersenne twister put into the state of ``init_genrand(seed)``."""
    state = [seed & 0xFFFFFFFF]
    for i in range(1, 624):
        state.append((1812433253 * (state[-1] ^ (state[-1] >> 30)) + i) & 0xFFFFFFFF)
    out = random.Random()
    out.setstate((3, (*state, 624), None))
    return out


def draws(seed: int, n: int = 5) -> Iterator[int]:
    """Uniform numbers below ``n``."""
    rng = generator(seed)
    floor = (1 << 32) % n
    while True:
        wide = rng.getrandbits(32) * n
        if wide & 0xFFFFFFFF >= floor:
            yield wide >> 32


def ranked(ids: DataFrame, column: str = "id") -> DataFrame:
    """Distinct ids with their rank from 0, in ascending order."""
    # partitions of a sort are ranges in order; an id's place is its partition and its row within
    placed = keep(ids.select(column).distinct().sort(column).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    # a row a partition of the sort
    return placed.join(F.broadcast(starts), part == F.col("_part")).select(column, (F.col("_start") + row).alias("rank"))


def _raw(state: bytes) -> np.random.MT19937:
    """The generator in a state of 624 words and a position."""
    words = np.frombuffer(state, np.uint32)
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": words[:624].copy(), "pos": int(words[624])}}
    return out


def _accepted(rng: np.random.MT19937, chunk: int, n: int) -> np.ndarray:
    """The draws that ``chunk`` steps of the generator give; rejected steps give none."""
    wide = rng.random_raw(chunk) * np.uint64(n)
    return (wide >> np.uint64(32))[(wide & np.uint64(0xFFFFFFFF)) >= (1 << 32) % n]


def chunk_states(seed: int, total: int, chunk: int, n: int = len(LABELS)) -> Iterator[tuple[int, bytes]]:
    """(rank of its first draw, state) of each chunk of steps until ``total`` draws are covered."""
    rng = _raw(np.array(generator(seed).getstate()[1], np.uint32).tobytes())
    first = 0
    while first < total:
        now = rng.state["state"]
        yield first, np.append(now["key"], np.uint32(now["pos"])).astype(np.uint32).tobytes()
        first += len(_accepted(rng, chunk, n))


def seeded_labels(ids: DataFrame, seed: int = 42, column: str = "id", chunk: int = 1_000_000) -> DataFrame:
    """(id, label) for each distinct id. The driver holds 2.5 KB a chunk."""
    spark = ids.sparkSession
    order = ranked(ids, column)
    total = order.count()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(list(LABELS))
        for b in batches:
            for first, state in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                drawn = names[_accepted(_raw(state), chunk, len(LABELS)).astype(np.int64)]
                ranks = np.arange(first, first + len(drawn))
                for at in range(0, len(drawn), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(ranks[at : at + 65536]), pa.array(drawn[at : at + 65536])], names=["rank", "label"])

    states = list(chunk_states(seed, total, chunk))
    table = spark.createDataFrame(states, "first long, state binary").repartition(max(1, len(states)), "first")
    return order.join(table.mapInArrow(draw, "rank long, label string"), "rank").select(column, "label")

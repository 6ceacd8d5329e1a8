"""Secret scans separated by corpus-wide ownership.

A scan finds candidate spans in each whole text. The base kinds (assign, access, hex) are always
reported. The further kinds (vendor keys, opaque strings) are many, and most are examples that everyone copies,
so they are added only where the corpus says that they are somebody's own: candidate values are
hashed and counted by distinct repositories and owners, and a value that at most ``max_owners`` owners
and ``max_repos`` repositories hold is live-looking. The same counts class every base span.

Counts are distinct aggregates with map-side partials, so a value that a third of all documents
copies reaches its task as a few partial rows; its spans get the counts by broadcast, those of other values by a join.
Texts are read once; only spans are shuffled.

Defined cases: null and empty texts have no spans; a null owner or repository counts as one of its
own; repeated rows are reported each and count once for their owner; spans that tie in start are ordered by kind, then
end; an empty table gives none. A text is searched whole, however long, in time in proportion to it. Only the
four named columns are read, so others may have any names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograft.llm.text import meet
from chronograft.storage import keep

KINDS = ("assign", "access", "hex", "vendor", "opaque")
N_BASE = 3
MAX_OWNERS, MAX_REPOS = 1, 2

_FLAGS = re.ASCII
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", _FLAGS)
_HEX = re.compile(r"[0-9a-f]{24,}", _FLAGS)
_VENDOR = re.compile(r"(?:gh[opsu]_|glpat-|xox[abp]-|sk_live_|sk-|AIza|eyJ)[A-Za-z0-9_.-]{16,}", _FLAGS)
_OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}", _FLAGS)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _random_looking(s: str) -> bool:
    """Mixed cases and digits at 3.5 bits a character or more."""
    return any(c.isdigit() for c in s) and any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s) and _entropy(s) >= 3.5


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of a text, by start and kind; offsets count code points."""
    if not text:
        return []
    found = [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _ in found)
    more = [(3, m.start(), m.end(), m[0]) for m in _VENDOR.finditer(text)]
    more += [(4, m.start(), m.end(), m[0]) for m in _OPAQUE.finditer(text) if _random_looking(m[0])]
    if base and more:  # what a base span covers is reported by it
        top, reach = [], -1
        for s, e in base:
            reach = max(reach, e)
            top.append((s, reach))
        starts = [s for s, _ in top]
        from bisect import bisect_right

        more = [x for x in more if (i := bisect_right(starts, x[1])) == 0 or top[i - 1][1] < x[2]]
    return sorted(found + more, key=lambda x: (x[1], x[0], x[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    kind = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("h", pa.int64())]))
    for b in batches:
        found = [
            [{"kind": k, "s": s, "e": e, "h": xxhash.xxh64_intdigest(v.encode()) - (1 << 63)} for k, s, e, v in candidates(t)]
            for t in b.column(0).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, kind)], names=[*b.schema.names[1:], "found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "repo", owner_col: str = "owner",
         max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(id, spans) of each input row.

    spans: array of (s, kind, e, n_owners, n_repos, live) by start and kind, holding the base spans
    and, of the further kinds, those that are live-looking.
    """
    narrow = docs.select(
        F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.concat(F.lit("+"), F.col(f"`{repo_col}`").cast("string")), F.lit("-")).alias("repo"),
        F.coalesce(F.concat(F.lit("+"), F.col(f"`{owner_col}`").cast("string")), F.lit("-")).alias("owner"),
        F.monotonically_increasing_id().alias("rid"))
    kind = narrow.schema["id"].dataType.simpleString()
    read = keep(narrow.mapInArrow(_scan, f"id {kind}, repo string, owner string, rid long, found array<struct<kind:int,s:int,e:int,h:long>>"), "secrets")
    each = read.where(F.size("found") > 0).select("rid", "repo", "owner", F.explode("found").alias("x"))
    each = each.select("rid", "repo", "owner", "x.kind", "x.s", "x.e", "x.h")
    held = each.groupBy("h").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repo").alias("n_repos"), F.count("*").alias("n"))
    held = keep(held, "secret-owners")
    total = held.agg(F.sum("n")).first()[0] or 0
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    classed = meet(each.select("rid", "kind", "s", "e", "h"), held, "h", total).withColumn("live", live)
    told = classed.where((F.col("kind") < N_BASE) | F.col("live")).groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("s", "kind", "e", "n_owners", "n_repos", "live"))).alias("spans"))
    out = read.select("id", "rid").join(told.withColumnRenamed("rid", "of"), F.col("rid") == F.col("of"), "left")
    none = F.array().cast("array<struct<s:int,kind:int,e:int,n_owners:bigint,n_repos:bigint,live:boolean>>")
    return out.select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))

"""Quality rules kept as a ledger: one bit for each failed rule beside the measurements.

Every rule is evaluated once a document. A policy is a named set of rules with a version, so a
changed policy re-reads the ledger and no text. Ablations are bitwise aggregates of the ledger.

Defined cases: a null, empty or blank text has no words and fails ``few_words``; repeated rows
and rows with a null id are judged each on its own; an empty table gives an empty ledger; input
columns of any name are left alone, since the ledger only takes the id and the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronograft.llm.text import SPACES, let, packed, unpacked, words

SYMBOLS = "#*$%&|<>"

#: Rule -> its bit. Bits are never reused, so ledgers of different ages stay comparable.
BITS = {
    "few_words": 0,
    "repeated_words": 1,
    "symbols": 2,
    "duplicate_lines": 3,
    "word_length": 4,
    "shouting": 5,
}

#: Policy version -> the rules that reject a document.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "shouting"),
}


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, each word once.

    Windows are compared by their 64-bit hashes; within one text a collision is out of reach.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        repeated = let(
            placed,
            lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
        return F.aggregate(
            F.sort_array(F.transform(repeated, lambda x: x["p"])),
            start,
            lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")),
            lambda a: a["n"],
        )

    def counted(v: Column) -> Column:
        n = F.size(v) - 2
        windows = F.arrays_zip(F.slice(v, 1, n), F.slice(v, 2, n), F.slice(v, 3, n))
        hashes = F.transform(windows, lambda x: F.xxhash64(x))
        some = let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
        )
        return F.when(F.size(v) < 3, F.lit(0)).otherwise(some)

    return let(w, counted).cast("long")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _measures(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_bangs"),
        _dup_lines(t).alias("n_dup_lines"),
        F.size(F.split(t, "\n", -1)).cast("long").alias("n_lines"),
    ]


def _rules() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "duplicate_lines": 5 * F.col("n_dup_lines") > 2 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
        "shouting": 2 * F.col("n_bangs") > n,
    }


def _judged(df: DataFrame) -> DataFrame:
    """Adds measurements and the failure bits to a frame with columns ``doc`` and ``text``."""
    measured = df.select(
        "doc",
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))).alias("_w"),
        *_measures(F.col("text")),
    ).select("doc", F.col("_w.n").alias("n_words"), F.col("_w.r").alias("n_repeat_words"), "word_chars", "n_symbols", "n_bangs", "n_dup_lines", "n_lines")
    bits = sum((F.when(c, F.lit(1 << BITS[k])).otherwise(F.lit(0)) for k, c in _rules().items()), F.lit(0))
    return measured.withColumn("failed", bits.cast("long"))


def policy_mask(version: int) -> int:
    return sum(1 << BITS[r] for r in POLICIES[version])


def passes(failed: Column, version: int) -> Column:
    """Whether a document with these failure bits satisfies the policy."""
    return failed.bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id, all measurements and the failure bits."""
    one = docs.select(F.struct(F.col(f"`{id_col}`").alias("id")).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    judged = _judged(one)
    return judged.select(F.col("doc.id").alias(id_col), *judged.columns[1:])


def keep_passing(docs: DataFrame, version: int, text_col: str = "text") -> DataFrame:
    """The input rows, with all their columns, that satisfy the policy."""
    judged = _judged(packed(docs, F.col(f"`{text_col}`").alias("text")))
    return unpacked(judged.where(passes(F.col("failed"), version)), docs.schema)


def ablations(led: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: documents it fails, those it alone rejects, and the rest rejected.

    The ledger is first counted by its masked bits, at most two to the number of rules rows.
    """
    mask = F.lit(policy_mask(version)).cast("long")
    counts = led.groupBy(F.col("failed").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in POLICIES[version]])).alias("x")
    each = counts.select("bits", "n", rules).select("bits", "n", "x.rule", "x.bit")
    hit, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(total(hit)("n_failed"), total(alone)("n_alone"), total(left)("n_rejected_without"))

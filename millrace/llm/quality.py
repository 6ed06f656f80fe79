"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document. The ledger keeps the measurements and one
bit per failed rule; a policy is a version number and the set of rules it enforces, so
verdicts of any policy, and what each rule costs, are bit operations on the ledger
and never read a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .words import SPACES, byte_table, grams, pieces, words

_TABLE = byte_table(SPACES, lower=False)
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rules in the order of their bits: a rule's name and when a document fails it.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_words": "n_words > 1000000",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version and the rules that it enforces."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(rule) for rule in self.rules)


#: The policies in force so far, oldest first.
POLICIES = (Policy(1, BASE), Policy(2, tuple(RULES)))


@F.arrow_udf(StructType([StructField("n_words", LongType()), StructField("n_repeat_words", LongType())]))
def _word_counts(texts: pa.Array) -> pa.Array:
    n_words = np.zeros(len(texts), np.int64)
    n_repeat = np.zeros(len(texts), np.int64)
    for piece in pieces(texts):
        found = words(piece, _TABLE)
        rows = len(piece.offsets) - 1
        part = slice(piece.first, piece.first + rows)
        n_words[part] = np.bincount(found.row, minlength=rows)
        at, hashes = grams(found, 3)
        # Windows of the piece in order of row and hash: equal neighbours are found twice or more.
        order = np.lexsort((hashes, found.row[at]))
        same = (np.diff(hashes[order]) == 0) & (np.diff(found.row[at][order]) == 0)
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        hit = np.zeros(len(found.row) + 2, bool)
        for k in range(3):
            hit[at[order[again]] + k] = True
        n_repeat[part] = np.bincount(found.row[hit[: len(found.row)]], minlength=rows)
    return pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_repeat)], ["n_words", "n_repeat_words"])


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def ledger(df: DataFrame, *, text: str | Column = "text") -> DataFrame:
    """Add the measurements and ``failed``, a bit per rule of ``RULES`` that the text fails.

    Words are runs of anything but ASCII white space. A null text measures as an empty
    one: no words, so it fails ``few_words``. Every row is judged by itself and in place
    (no shuffle), repeated rows alike; columns with the names of measurements are replaced.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, _BLANKS, "")) > 0)
    measured = df.withColumns(
        {
            "_counts": _word_counts(text),
            "word_chars": _without(text, _BLANKS).cast("bigint"),
            "n_symbols": (F.length(text) - _without(text, SYMBOLS)).cast("bigint"),
            "_lines": lines,
        }
    )
    measured = measured.withColumns(
        {
            "n_words": F.col("_counts.n_words"),
            "n_repeat_words": F.col("_counts.n_repeat_words"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        }
    ).drop("_counts", "_lines")
    bits = [F.when(F.expr(test), F.lit(1 << bit)).otherwise(0) for bit, test in enumerate(RULES.values())]
    return measured.withColumn("failed", sum(bits[1:], bits[0]).cast("bigint"))


def verdict(policy: Policy, failed: str | Column = "failed") -> Column:
    """Whether the policy keeps a document of the ledger."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(policy.mask)) == 0


def ablations(judged: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents failing it, and those that only it rejects.

    Documents are first counted by their enforced failure bits, at most one row per
    combination of rules, so a bit's effect is read from that small table.
    """
    bits = F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")
    combinations = judged.groupBy(bits).count()
    rules = [F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("bigint").alias("bit")) for r in policy.rules]
    each = combinations.select("bits", "count", F.explode(F.array(*rules)).alias("r")).select("bits", "count", "r.*")
    return each.groupBy("rule").agg(
        F.lit(policy.version).alias("version"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)).alias("only_by_it"),
    )

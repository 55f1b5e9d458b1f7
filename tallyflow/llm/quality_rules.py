"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks applied afterwards.

The ledger has one row per document: its measurements and ``failed``, one bit per rule that it fails.  A policy is
a named set of rules; applying it, comparing two versions or asking what a rule alone costs are bitwise operations on
the ledger and never read a text again.

Defined cases: a null text is an empty one (no words, so it fails ``few_words``); a null id, repeated rows and ties are
kept as rows of their own; an empty table gives an empty ledger; other columns of the input, whatever their names, are
not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import SPACE, fresh

#: Words of a window whose repetition counts.
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A document fails if the SQL condition over the measurements holds."""

    name: str
    fails_if: str


#: In the order of their bits.  New rules go to the end, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > 2 * n_words"),
    Rule("shouting", "2 * n_upper > word_chars"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
)

BASE = ("few_words", "repeated_words")

#: Versioned policies: a document is rejected if it fails any of these rules.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols"),
    "v2": (*BASE, "symbols", "shouting", "repeated_lines", "word_length"),
}

DEFAULT_POLICY = "v2"


def mask(rules: tuple[str, ...]) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(name) for name in rules)


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns and a struct ``m`` of measurements (all long), in one pass without a shuffle."""
    text_, words, lines, windows, pairs, m = fresh(docs, "text_", "words_", "lines_", "windows_", "pairs_", "m")
    c = F.col
    df = docs.select(*keep, F.coalesce(c(text), F.lit("")).alias(text_))
    df = df.select(
        *keep,
        text_,
        F.array_remove(F.split(text_, SPACE), "").alias(words),
        F.filter(F.split(text_, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != "").alias(lines),
    )
    # A window is known by a 64-bit hash of its words; windows are only compared within one text.
    hashed = F.transform(c(words), lambda _, i: F.xxhash64(F.slice(c(words), i + 1, F.lit(WINDOW))))
    df = df.withColumn(
        windows, F.when(F.size(words) > WINDOW, F.slice(hashed, F.lit(1), F.size(words) - (WINDOW - 1)))
    )
    repeated = F.size(F.array_distinct(c(windows))) < F.size(windows)
    sorted_ = F.array_sort(F.transform(c(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(pairs, F.when(repeated, sorted_))

    def met(p: Column, k: Column) -> Column:
        same = lambda other: F.coalesce(F.get(c(pairs), other)["h"] == p["h"], F.lit(False))
        return same(k - 1) | same(k + 1)

    starts = F.array_sort(F.transform(F.filter(c(pairs), met), lambda p: p["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    n = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(c(words), "")),
        "n_symbols": F.regexp_count(text_, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(c(lines))),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size(lines),
        "n_upper": F.regexp_count(text_, F.lit("[A-Z]")),
    }
    return df.select(*keep, F.struct(*[n[k].cast("long").alias(k) for k in MEASURES]).alias(m))


def bits(m: str) -> Column:
    """One bit for each rule that the measurements in this struct column fail."""
    total = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        condition = re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"`{m}`.\1", rule.fails_if)
        total = total + F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return total


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc id, the measurements, ``failed`` (bit per rule)."""
    df = measured(docs.select(id_col, text), text, (id_col,))
    return df.select(id_col, "m.*", bits("m").alias("failed"))


def rejected(failed: Column, policy: str = DEFAULT_POLICY) -> Column:
    return failed.bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def sole_rule(failed: Column, policy: str = DEFAULT_POLICY) -> Column:
    """The one rule bit to whose removal from the policy a document owes its acceptance, else 0."""
    hit = failed.bitwiseAND(F.lit(mask(POLICIES[policy])))
    return F.when(F.bit_count(hit) == 1, hit).otherwise(F.lit(0).cast("long"))


def ablation(entries: DataFrame, policy: str = DEFAULT_POLICY, failed: str = "failed") -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that stay without it.

    The ledger shrinks to one count per distinct mask (at most 2 to the number of rules) before anything else happens.
    """
    chosen = mask(POLICIES[policy])
    masks = entries.groupBy(F.col(failed).bitwiseAND(F.lit(chosen)).alias("hit")).agg(F.count("*").alias("n"))
    rules = [(r.name, 1 << k) for k, r in enumerate(RULES) if chosen >> k & 1]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in rules]))
    flat = masks.select("hit", "n", each.alias("r")).select("hit", "n", "r.*")
    has = F.col("hit").bitwiseAND(F.col("bit")) != 0
    others = F.col("hit").bitwiseAND(F.bitwise_not(F.col("bit")))
    return flat.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(has & (others == 0), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(others == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def accepted(docs: DataFrame, policy: str = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with the columns they came with."""
    m, one = fresh(docs, "m", "one")
    own = [f"`{c}`" for c in docs.columns]
    df = measured(docs, text, tuple(own))
    # A filter would be pushed below the projections and evaluate every measurement anew wherever it is mentioned, even
    # once per word; exploding an array that is empty for rejected rows stays above them.
    keep = F.when(rejected(bits(m), policy), F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return df.select(*own, F.explode(keep).alias(one)).select(*own)

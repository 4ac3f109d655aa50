"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per text. The ledger keeps its measurements and
one bit per failed rule; a policy is a mask over those bits, so any policy, and
any policy without one of its rules, is an AND on the ledger and reads no text.

Cases: a null text has no words; repeated rows give repeated ledger rows; an
empty table gives an empty ledger; nothing depends on ids, which may be null.
Repeated windows are found by 64-bit hashes of three words compared within one
text only; a false match has a chance of about n^2 / 2^65 for n words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from paneltide.llm.common import blank_words, wrap


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def rules() -> list[Rule]:
    """The rules in bit order, over the columns of ``measure``."""
    c = F.col
    return [
        Rule("few_words", c("n_words") < 50),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        Rule("symbols", 5 * c("n_symbols") > c("n_words")),
        Rule("short_words", c("word_chars") < 2 * c("n_words")),
        Rule("long_words", c("word_chars") > 20 * c("n_words")),
        Rule("repeated_lines", (c("n_dup_lines") >= 5) & (2 * c("n_dup_lines") > c("n_lines"))),
    ]


# Policies by version: the rules that reject
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols"),
    "v2": (*BASE, "symbols", "short_words", "long_words", "repeated_lines"),
}
CURRENT = "v2"


def mask(names) -> int:
    order = [r.name for r in rules()]
    return sum(1 << order.index(n) for n in names)


def measure(docs: DataFrame) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) per input row."""
    blank = " \t\n\x0b\f\r"
    split = wrap(docs).select(
        "row",
        blank_words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(blank)) != "").alias("lines"),
        F.length(F.translate("text", blank, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    counted = split.select(
        "row",
        "word_chars",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.slice(
            F.transform(
                "words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
            ),
            F.lit(1),
            F.greatest(F.size("words") - 2, F.lit(0)),
        ).alias("windows"),
    )
    # windows in hash order with their place; a text without any repetition skips the sort
    order = counted.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = order.withColumn(
        "at",
        F.sort_array(
            F.transform(
                F.filter(
                    "ordered",
                    lambda x, k: (F.get("ordered", k - 1)["h"] == x["h"]) | (F.get("ordered", k + 1)["h"] == x["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    )
    # each repeated window adds the words that the one before it does not hold
    gained = F.transform("at", lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get("at", k - 1), p - 3)))
    return same.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.coalesce(F.aggregate(gained, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """``measure`` with ``fail_bits``: bit k is set if rule k fails."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs).withColumn("fail_bits", bits)


def passes(policy: str = CURRENT) -> Column:
    """True for the ledger rows that a policy keeps."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, n_failed, n_only): texts a rule of the policy fails, and those only it fails.

    The ledger is reduced to one row per pattern of bits, at most 2^rules, first.
    """
    whole = mask(POLICIES[policy])
    patterns = (
        book.select(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits"))
        .groupBy("bits")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = [r.name for r in rules()]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit")) for n in POLICIES[policy]]))
    has = F.col("r.bit").bitwiseAND(F.col("bits")) != 0
    return (
        patterns.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The input rows that a policy keeps, unchanged.

    The number of texts is observed between ledger and filter. That also holds the
    filter above the ledger: pushed into the measurements, it would repeat them all.
    """
    book = ledger(docs).observe("quality_ledger", F.count(F.lit(1)).alias("texts"))
    return book.where(passes(policy)).select("row.*")

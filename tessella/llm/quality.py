"""Quality rules as a ledger: every rule is evaluated once, policies read bits.

``ledger`` keeps each document's measurements and one bit for each rule that it fails.  A policy is a
versioned set of rules; ``judged`` applies one with a bitwise test, and ``ablations`` compares any
number of policies and their rules from the counts of distinct bit masks, without looking at a text
again.  All of it is DataFrame functions, row by row: nothing is shuffled.

Repeated three-word windows are found within the row: window hashes (64 bits) are compared as a set
first, and only where some repeat are (hash, position) pairs sorted and equal neighbours marked.

Defined results: a null text has no words; repeated rows are judged row by row; an empty table gives
no rows; columns of the input beside doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, words

#: The signs that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Bit of each rule, in order: whether measurements fail it.
RULES = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "repeated_lines": lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"],
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
}
BASE = ("few_words", "repeated_words")
#: Versions of the policy: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(RULES)}


def bits(rules: tuple[str, ...]) -> int:
    return sum(1 << k for k, name in enumerate(RULES) if name in rules)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; a window begins at each word but the last two."""

    def of(hs: Column) -> Column:
        def marked(s: Column) -> Column:
            at = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (F.get(s, i - 2)["h"] == s[i - 1]["h"]) | (F.get(s, i)["h"] == s[i - 1]["h"]))
            return F.array_sort(F.transform(at, lambda i: s[i - 1]["i"]))

        def covered(p: Column) -> Column:
            # each window brings 3 words, less what the next one starts within
            gaps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda n, g: n + g)

        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(_let(pairs, marked), covered)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(of(hashes))


def entry(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, and failures, with bit k set where rule k fails.

    Every intermediate is bound as a lambda variable: wherever the optimizer moves this expression, it is evaluated once.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of_words(ws: Column) -> Column:
        n = F.size(ws)
        windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(n.cast("long").alias("n_words"), _let(windows, _repeated).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)
        return F.struct(n.cast("long").alias("n_lines"), (n - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    def judge(m: Column) -> Column:
        values = {"n_words": m["w"]["n_words"], "word_chars": m["word_chars"], "n_symbols": m["n_symbols"], "n_lines": m["l"]["n_lines"], "n_dup_lines": m["l"]["n_dup_lines"], "n_repeat_words": m["w"]["n_repeat_words"]}
        failed = F.lit(0).cast("long")
        for k, rule in enumerate(RULES.values()):
            failed = failed.bitwiseOR(F.when(rule(values), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        return F.struct(*(v.alias(n) for n, v in values.items()), failed.alias("failures"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = F.struct(
        _let(F.transform(words(text), lambda w: F.xxhash64(w)), of_words).alias("w"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, of_lines).alias("l"),
    )
    return _let(measured, judge)


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, measurements and failures."""
    return docs.select(*keep, entry(F.col("text")).alias("__e")).select(*keep, "__e.*")


def judged(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    failed = F.col("failures")
    return entries.withColumn("base_failed", failed.bitwiseAND(F.lit(bits(BASE))) != 0).withColumn("kept", failed.bitwiseAND(F.lit(bits(POLICIES[policy]))) == 0)


def ablations(entries: DataFrame) -> DataFrame:
    """(policy, rule, kept, kept_without): documents a policy keeps, and keeps without one of its rules."""
    counts = entries.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(bits(rules)).alias("mask"), F.lit(bits(rules) & ~bits((r,))).alias("without")) for p, rules in POLICIES.items() for r in rules))
    passes = lambda mask: F.when(F.col("failures").bitwiseAND(F.col(mask)) == 0, F.col("n")).otherwise(F.lit(0))
    return counts.select("failures", "n", F.inline(cases)).groupBy("policy", "rule").agg(F.sum(passes("mask")).alias("kept"), F.sum(passes("without")).alias("kept_without"))


def filtered(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that a policy keeps."""
    return docs.filter(entry(F.col("text"))["failures"].bitwiseAND(F.lit(bits(POLICIES[policy]))) == 0)

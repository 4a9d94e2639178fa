"""Quality rules by weak supervision.

Every rule looks at a few counts of a text and votes good (+1), votes bad (-1) or abstains (0). The
rules' accuracies are not given: expectation-maximisation estimates, without labels, how often each
rule says what in good and in bad documents. A document's posterior probability of being good then
decides, in place of a filter that every rule must pass.

The votes of ``m`` rules form at most ``3**m`` patterns, so the estimate runs on a table of pattern
counts over all documents whose size does not depend on the corpus. Everything up to that table and
after it is DataFrame expressions.

Cases: a null text is an empty one; a text with no words fails the base rules; repeated rows each
count and each get a row; an empty table gives an empty result; other columns pass through
``filter_quality`` untouched (working columns carry a reserved ``__q_`` prefix).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexagrove.llm.common import WHITE, sets_aside, text_or_empty, words_of, written

P = "__q_"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are SQL conditions over the count columns; bad wins if both hold."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0)


#: Ratios are written as products, so that a text without words never divides by zero.
RULES = (
    Rule("length", "__q_n_words < 50", "__q_n_words >= 100"),
    Rule("symbols", "__q_n_symbols > 0.3 * __q_n_words", "false"),
    Rule("line copies", "__q_n_dup_lines > 0.4 * __q_n_lines", "false"),
    Rule("repeats", "__q_n_repeat_words > 0.4 * __q_n_words", "false"),
    Rule("word size", "__q_word_chars < 2 * __q_n_words OR __q_word_chars > 15 * __q_n_words", "__q_word_chars BETWEEN 3 * __q_n_words AND 9 * __q_n_words"),
    Rule("capitals", "__q_n_capitals > 0.4 * __q_word_chars", "false"),
    Rule("shouting", "__q_n_shouts > 0.3 * __q_n_words", "false"),
    Rule("lines", "__q_n_words < 2 * __q_n_lines", "__q_n_words >= 5 * __q_n_lines"),
)


def without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the count columns (prefixed ``__q_``) to ``docs``; no shuffle, no Python."""
    docs = docs.withColumn(P + "text", text_or_empty(text))
    docs = docs.withColumn(P + "words", words_of(F.col(P + "text")))
    docs = docs.withColumn(P + "lines", F.filter(F.split(F.col(P + "text"), "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != ""))
    docs = docs.withColumn(P + "n_words", F.size(P + "words").cast("long"))
    # One hash for each window of three words; two unlike windows of one text agree with chance 2**-64.
    docs = docs.withColumn(P + "tri", F.expr("CASE WHEN __q_n_words >= 3 THEN transform(sequence(0, int(__q_n_words) - 3), i -> xxhash64(__q_words[i], __q_words[i + 1], __q_words[i + 2])) ELSE array() END"))
    docs = docs.withColumns(
        {
            P + "word_chars": without(F.col(P + "text"), WHITE).cast("long"),
            P + "n_symbols": (F.char_length(P + "text") - without(F.col(P + "text"), SYMBOLS)).cast("long"),
            P + "n_capitals": (F.char_length(P + "text") - without(F.col(P + "text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long"),
            P + "n_shouts": (F.char_length(P + "text") - without(F.col(P + "text"), "!")).cast("long"),
            P + "n_lines": F.size(P + "lines").cast("long"),
            P + "n_dup_lines": (F.size(P + "lines") - F.size(F.array_distinct(P + "lines"))).cast("long"),
            # Only texts in which a window comes back are sorted.
            P + "sorted": F.expr("CASE WHEN size(array_distinct(__q_tri)) < size(__q_tri) THEN array_sort(transform(__q_tri, (h, i) -> struct(h AS h, i AS i))) END"),
        }
    )
    docs = docs.withColumn(P + "same", F.expr("zip_with(__q_sorted, slice(__q_sorted, 2, size(__q_sorted)), (a, b) -> coalesce(a.h = b.h, false))"))
    docs = docs.withColumn(P + "twice", F.expr("zip_with(__q_same, concat(array(false), __q_same), (next, before) -> coalesce(next, false) OR coalesce(before, false))"))
    docs = docs.withColumn(P + "at", F.expr("array_sort(filter(zip_with(__q_sorted, __q_twice, (s, t) -> if(t, s.i, null)), i -> i IS NOT NULL))"))
    covered = "aggregate(__q_at, struct(-9 AS last, 0 AS n), (acc, i) -> struct(i AS last, acc.n + least(3, i - acc.last) AS n), acc -> acc.n)"
    docs = docs.withColumn(P + "n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long"))
    return docs.drop(*(P + c for c in ("text", "words", "lines", "tri", "sorted", "same", "twice", "at")))


def base_failed() -> Column:
    """Under 50 words, or more than half of the words in windows that come back."""
    return (F.col(P + "n_words") < 50) | (100 * F.col(P + "n_repeat_words") > 50 * F.col(P + "n_words"))


#: Chances of each vote that the estimate starts from and is drawn towards: a rule that speaks of
#: something wrong is seldom mistaken, one that sees nothing wrong says little. (Good, bad documents.)
START = ({-1: 0.01, 0: 0.49, 1: 0.5}, {-1: 0.3, 0: 0.4, 1: 0.3})
START_GOOD = 0.7


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 100, pull: float = 0.5) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the log odds of the class prior and, for each rule and vote, the log ratio of its chances
    among good and bad documents. The start counts as ``pull`` times the documents of a class: two
    unlabelled classes alone would follow whichever rules agree most, not quality. A bad vote's ratio
    is at most 0, a good vote's at least 0.
    """
    votes = (-1, 0, 1)
    chance = [START] * n_rules
    good = START_GOOD
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        mass = [[dict.fromkeys(votes, 0.0) for _ in range(2)] for _ in range(n_rules)]
        weight = 0.0
        for pattern, n in patterns:
            odds = math.log(good / (1 - good)) + sum(math.log(chance[j][0][v] / chance[j][1][v]) for j, v in enumerate(pattern))
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
            weight += n * p
            for j, v in enumerate(pattern):
                mass[j][0][v] += n * p
                mass[j][1][v] += n * (1 - p)
        drawn = (weight + 1, total - weight + 1)
        last, good = good, (weight + pull * total * START_GOOD) / (total * (1 + pull))
        chance = [tuple({v: (pair[c][v] + pull * drawn[c] * START[c][v]) / (sum(pair[c].values()) + pull * drawn[c]) for v in votes} for c in range(2)) for pair in mass]
        if abs(last - good) < 1e-9:
            break
    ratios = [{v: math.log(g[v] / b[v]) for v in votes} for g, b in chance]
    return math.log(good / (1 - good)), [{-1: min(0.0, r[-1]), 0: r[0], 1: max(0.0, r[1])} for r in ratios]


@sets_aside
def score_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the counts, ``__q_posterior`` (chance of being good), ``__q_base_failed`` and ``__q_kept``.

    The counts are the costly part, so texts are read once: the rows that go on, with the columns
    named in ``keep`` (all by default), are written with their counts, and estimate and verdict read those.
    """
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    counts = [P + c for c in (*COUNTS, "n_capitals", "n_shouts", "n_lines")]
    counted = with_counts(docs, text).select(*kept, *counts)
    # A null column of no type can't be written; it stays null as a text.
    counted = written(counted.select(*(F.col(f"`{c}`").cast("string").alias(c) if kind == "void" else F.col(f"`{c}`") for c, kind in counted.dtypes)))
    names = [f"{P}vote{j}" for j in range(len(rules))]
    voted = counted.select(*(r.vote().alias(n) for r, n in zip(rules, names)), base_failed().alias("__q_out"))
    # Documents that fail the base rules leave before the verdict, so they do not shape it.
    table = voted.where(~F.col("__q_out")).groupBy(*names).count().collect()
    prior, ratios = estimate([(tuple(row[n] for n in names), row["count"]) for row in table], len(rules))
    odds = F.lit(prior)
    for rule, ratio in zip(rules, ratios):
        odds = odds + F.when(rule.vote() == -1, F.lit(ratio[-1])).when(rule.vote() == 1, F.lit(ratio[1])).otherwise(F.lit(ratio[0]))
    scored = counted.withColumn(P + "posterior", 1 / (1 + F.exp(-odds))).withColumn(P + "base_failed", base_failed())
    return scored.withColumn(P + "kept", ~F.col(P + "base_failed") & (F.col(P + "posterior") >= threshold))


def filter_quality(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    kept = score_quality(docs, text, **options).where(F.col(P + "kept"))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))

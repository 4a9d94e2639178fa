"""A quality classifier: a sparse ensemble of rules.

Statistics of a text (ratios of counts, all DataFrame expressions) go through a few shallow trees; each
path from a root to a node is a conjunctive rule over the statistics. A logistic regression with a
lasso penalty weighs the rules, and most weights become zero. The rest is compiled to one Spark
column: a sum of weighted conditions through the logistic function. Scoring is therefore plain
expressions over each whole text, with no Python and no shuffle.

The model is fitted on at most ``max_rows`` labelled rows, those with the smallest hashes of the id.

Cases: null and empty texts have all statistics 0 and are scored like any other; without labels of
both kinds the score is the labels' mean (0.5 without any); labels of unknown documents and null labels
are skipped; a document with several labels uses each; other columns pass through.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexagrove.llm.common import WHITE, sets_aside, settle, text_or_empty, words_of

P = "__r_"
#: Name of each statistic and its SQL over counts of the text.
STATISTICS = {
    "words": "n_words",
    "word_size": "n_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "pipes": "n_pipes / greatest(n_words, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(n_chars, 1)",
    "digits": "n_digits / greatest(n_chars, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "line_copies": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "distinct_pairs": "n_distinct_pairs / greatest(n_words, 1)",
}


def fewer(column: Column, characters: str) -> Column:
    """How many of ``characters`` a text holds."""
    return F.char_length(column) - F.char_length(F.translate(column, characters, ""))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one array column ``__r_x`` of the statistics in the order of ``STATISTICS``."""
    out = docs.withColumn(P + "t", text_or_empty(text))
    t = F.col(P + "t")
    out = out.withColumn(P + "words", words_of(t)).withColumn(P + "lines", F.filter(F.split(t, "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != ""))
    out = out.withColumn(P + "pairs", F.expr("transform(slice(__r_words, 2, greatest(size(__r_words), 1)), (w, i) -> xxhash64(__r_words[i], w))"))
    counts = {
        "n_words": F.size(P + "words"), "n_lines": F.size(P + "lines"), "n_chars": F.char_length(F.translate(t, WHITE, "")), "n_symbols": fewer(t, "#*$%&<>"), "n_pipes": fewer(t, "|"),
        "n_shouts": fewer(t, "!"), "n_capitals": fewer(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_digits": fewer(t, "0123456789"), "n_stops": fewer(t, "."),
        "n_dup_lines": F.size(P + "lines") - F.size(F.array_distinct(P + "lines")), "n_distinct": F.size(F.array_distinct(P + "words")), "n_distinct_pairs": F.size(F.array_distinct(P + "pairs")),
    }
    out = out.withColumns({P + k: v for k, v in counts.items()})
    statistics = [F.expr(re.sub(r"\bn_", P + "n_", sql)).cast("double") for sql in STATISTICS.values()]
    out = out.withColumn(P + "x", F.array(*statistics))
    return out.drop(*(P + c for c in ("t", "words", "lines", "pairs", *counts)))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic's index, is an upper bound, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def column(self) -> Column:
        x = F.col(P + "x")
        out = F.lit(True)
        for k, upper, at in self.terms:
            out = out & ((x[k] <= at) if upper else (x[k] > at))
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        odds = F.lit(self.intercept)
        for rule, weight in self.weights:
            odds = odds + F.when(rule.column(), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def tree_paths(trees: str) -> list[Rule]:
    """Rules from the printed form of a tree ensemble: every path from a root to a node below it."""
    rules: dict[Rule, None] = {}
    path: list[tuple[int, bool, float]] = []
    for line in trees.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, int(found[2]), found[3] == "<=", float(found[4])))
        # A bound that a deeper one on the same side makes needless goes.
        tight: dict[tuple[int, bool], float] = {}
        for _, k, upper, at in path:
            tight[k, upper] = min(tight.get((k, upper), at), at) if upper else max(tight.get((k, upper), at), at)
        rules[Rule(tuple((k, upper, at) for (k, upper), at in sorted(tight.items())))] = None
    return list(rules)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", max_rows: int = 20_000, trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 5) -> RuleEnsemble:
    """Learn from ``labels`` (``key``, ``label``); the texts come from ``docs``."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__id"), F.col(label).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "__id"), "__id", "label").limit(max_rows)
    # At most max_rows short rows: a bounded side.
    texts = docs.select(F.col(key).alias("__id"), F.col(text).alias("text")).join(F.broadcast(chosen), "__id")
    rows = settle(with_statistics(texts).select("label", F.col(P + "x")))
    kinds = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n, good = sum(kinds.values()), sum(v for k, v in kinds.items() if k > 0.5)
    if not n or good in (0, n):
        mean = (good + 1) / (n + 2) if n else 0.5
        return RuleEnsemble(math.log(mean / (1 - mean)), ())
    train = rows.withColumn("features", array_to_vector(P + "x")).coalesce(1).cache()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", seed=seed, minInstancesPerNode=max(1, min(10, n // 50))).fit(train)
    rules = tree_paths(forest.toDebugString)
    if not rules:
        return RuleEnsemble(0.0, ())
    cases = train.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features")).cache()
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False, aggregationDepth=2).fit(cases)
    train.unpersist(), cases.unpersist()
    return RuleEnsemble(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-6))


@sets_aside
def score(docs: DataFrame, model: RuleEnsemble, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    out = with_statistics(docs, text).withColumn("score", model.score())
    return out.select(*keep, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

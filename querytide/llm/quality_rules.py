"""Quality rules learned as a decision list.

Sequential covering: a rule that finds rejected documents is grown on one part of the labelled
statistics, condition by condition, and pruned on the other; the documents it covers are taken
out and the next rule is learned from the rest. The list becomes one conditional expression of
Spark, so applying it costs no more than the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.llm.common import fresh, prepare
from querytide.llm.text_stats import COUNTS, FEATURES, counts_of, feature, labelled_features

#: (feature, above, threshold): the feature is over the threshold if `above`, else at most it.
Condition = tuple[str, bool, float]
Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleParams:
    #: Labelled documents learned from, at most.
    sample: int = 20_000
    #: Share of a rule's documents that must be labelled as bad, and how many it must cover.
    precision: float = 0.97
    coverage: int = 8
    most_conditions: int = 4
    most_rules: int = 24


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    held = np.ones(len(x), bool)
    for name, above, threshold in rule:
        values = x[:, FEATURES.index(name)]
        held &= values > threshold if above else values <= threshold
    return held


def _grow(x: np.ndarray, bad: np.ndarray, first: str, params: RuleParams) -> Rule:
    """Add the condition of the greatest information gain until only bad documents are left.

    The first condition is on the feature `first`.
    """
    rule: list[Condition] = []
    held = np.ones(len(x), bool)
    while len(rule) < params.most_conditions and bad[held].any() and not bad[held].all():
        before = np.log2(bad[held].mean())
        best, best_gain = None, 1e-6
        for k, name in enumerate(FEATURES):
            if not rule and name != first:
                continue
            values = x[held, k]
            for threshold in np.unique(np.quantile(values, np.linspace(0, 1, 65))):
                for above in (True, False):
                    inside = values > threshold if above else values <= threshold
                    hits = int(bad[held][inside].sum())
                    if hits:
                        gain = hits * (np.log2(hits / inside.sum()) - before)
                        if gain > best_gain:
                            best, best_gain = (name, above, float(threshold)), gain
        if best is None:
            break
        rule.append(best)
        held &= _holds(x, (best,))
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The prefix of the rule that does best on documents it was not grown on."""

    def worth(prefix: Rule) -> float:
        held = _holds(x, prefix)
        return (2 * bad[held].mean() - 1, int(held.sum())) if held.any() else (-1.0, 0)

    prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
    return max(prefixes, key=worth) if prefixes else rule


def _tighten(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Move each threshold half-way to where the bad documents it covers begin, for a margin."""
    covered = x[_holds(x, rule) & bad]
    moved = []
    for name, above, threshold in rule:
        edge = np.quantile(covered[:, FEATURES.index(name)], 0.02 if above else 0.98)
        moved.append((name, above, float((threshold + edge) / 2)))
    return tuple(moved)


def learn(x: np.ndarray, bad: np.ndarray, params: RuleParams = RuleParams()) -> list[Rule]:
    """Rules in order; none if there are no bad documents, or none that a precise rule covers.

    A rule is grown from each feature, and the one that covers most is taken.
    """
    rules: list[Rule] = []
    part = np.arange(len(x)) % 3 == 2
    while len(rules) < params.most_rules and bad.any() and not bad.all():
        found = []
        for first in FEATURES:
            rule = _prune(_grow(x[~part], bad[~part], first, params), x[part], bad[part])
            if rule and (_holds(x, rule) & bad).any():
                rule = _tighten(rule, x, bad)
                held = _holds(x, rule)
                if held.sum() >= params.coverage and bad[held].mean() >= params.precision:
                    found.append((int(bad[held].sum()), rule))
        if not found:
            break
        rule = max(found, key=lambda f: f[0])[1]
        held = _holds(x, rule)
        rules.append(rule)
        x, bad, part = x[~held], bad[~held], part[~held]
    return rules


def verdict(rules: list[Rule], counts: str = "counts") -> Column:
    """True unless a rule holds: the rules as conditions over the struct of counts, in order."""
    answer = F.lit(True)
    for rule in reversed(rules):
        held = F.lit(True)
        for name, above, threshold in rule:
            value = feature(name, counts)
            held = held & (value > F.lit(threshold) if above else value <= F.lit(threshold))
        answer = F.when(held, F.lit(False)).otherwise(answer)
    return answer


def base_failed(counts: str = "counts") -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (F.col(f"{counts}.n_words") < 50) | (
        100 * F.col(f"{counts}.n_repeat_words") > 50 * F.col(f"{counts}.n_words")
    )


def learn_rules(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> list[Rule]:
    """Rules from the labelled documents (`quality` 0 is bad); an empty list without labels."""
    x, label = labelled_features(docs, labels, "quality", params.sample)
    return learn(x, label == 0, params)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """`doc_id`, the counts, `base_failed` and `kept` of every row.

    A null or empty text has counts of zero and fails the base check. Rows are judged one by
    one, so repeated rows and null doc_ids stay as they are; other columns are not read. An empty
    table gives an empty table.
    """
    prepare(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), counts_of(F.col("text")).alias("counts"))
    failed = base_failed()
    return counted.select(
        "doc_id", *[F.col(f"counts.{c}") for c in COUNTS], failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept")
    )


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of `docs` that pass, with all their columns; rules as in `judge`."""
    prepare(docs.sparkSession)
    counted = fresh(docs, "counts")
    passed = docs.withColumn(counted, counts_of(F.col("text"))).filter(~base_failed(counted) & verdict(rules, counted))
    return passed.drop(counted)

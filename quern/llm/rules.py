"""Quality rules learnt as a decision list.

Sequential covering: while bad labelled documents are left, a rule is grown,
threshold by threshold, to cover bad ones without good ones (best gain in
information over what it covers so far), then pruned on the rows kept for
pruning by dropping its last thresholds while that raises its precision. A rule
that doesn't reach the wanted precision ends the list. The list is emitted as
Spark conditional expressions, first match first.

Rules are learnt from at most ``max_rows`` labelled documents (chosen by the
hash of their ids, so that the sample doesn't depend on partitions); the
statistics and verdicts cover every document. Null and empty texts have no
words and fail the base rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import _io, stats

#: Labelled rows that a list is learnt from at most.
MAX_ROWS = 20_000

#: Ratios that thresholds are put on: name -> (numerator, denominator), of the statistics.
RATIOS = {
    "symbol_share": ("n_symbols", "word_chars"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "shout_share": ("n_shout_words", "n_words"),
    "mark_share": ("n_marks", "word_chars"),
    "stops_a_word": ("n_stops", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "word_length": ("word_chars", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Test, ...]


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)) for k, (a, b) in RATIOS.items()})


def _holds(test: Test, x: dict[str, np.ndarray]) -> np.ndarray:
    return x[test.feature] > test.threshold if test.above else x[test.feature] <= test.threshold


def _best(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int) -> tuple[float, Test] | None:
    """The test of highest gain on the rows given: bad ones kept times the rise in their log share."""
    n, p = len(bad), int(bad.sum())
    base, best = np.log2(p / n), None
    for feature in sorted(x):
        values = x[feature]
        order = np.argsort(values, kind="stable")
        ranked, hits = values[order], np.concatenate([[0], np.cumsum(bad[order])])
        at = np.flatnonzero(ranked[1:] > ranked[:-1]) + 1
        if not len(at):
            continue
        if len(at) > cuts:
            at = at[np.linspace(0, len(at) - 1, cuts).astype(int)]
        for above in (False, True):
            size = n - at if above else at
            good = (p - hits[at] if above else hits[at]).astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(good > 0, good * (np.log2(good / size) - base), -np.inf)
            i = int(np.argmax(gain))
            if best is None or gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), Test(feature, above, float((ranked[at[i]] + ranked[at[i] - 1]) / 2)))
    return best


def _score(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    hit = np.ones(len(bad), bool)
    for test in rule:
        hit &= _holds(test, x)
    return (float(bad[hit].sum()) + 0.5) / (hit.sum() + 1.0), int(hit.sum())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, support: int = 5, max_rules: int = 12, max_tests: int = 4, cuts: int = 256, seed: int = 7) -> list[Rule]:
    """Rules that find bad rows; empty where there are too few of either kind."""
    prune = np.random.default_rng(seed).random(len(bad)) < 1 / 3
    grow, rules = ~prune, []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        rows = left & grow
        if bad[rows].sum() < support or bad[rows].all():
            break
        rule: Rule = ()
        covered = rows.copy()
        while len(rule) < max_tests and not bad[covered].all():
            found = _best({k: v[covered] for k, v in x.items()}, bad[covered], cuts)
            if found is None or found[0] <= 1e-6:
                break
            rule += (found[1],)
            covered &= _holds(found[1], x)
        if not rule:
            break
        check = left & prune
        held = {k: v[check] for k, v in x.items()}
        rule = max((rule[:i] for i in range(len(rule), 0, -1)), key=lambda r: (_score(r, held, bad[check])[0], len(r)))
        worth, _ = _score(rule, {k: v[left] for k, v in x.items()}, bad[left])
        hit = left.copy()
        for test in rule:
            hit &= _holds(test, x)
        if worth < precision or hit.sum() < support:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """1-based number of the first rule that a row meets, null where none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        condition = rule[0].column()
        for test in rule[1:]:
            condition &= test.column()
        out = F.when(condition, F.lit(i)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(measured: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **options) -> list[Rule]:
    """Rules from documents with a quality label; labels of null and unknown documents don't count."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_quality")).dropna().groupBy("doc_id").agg(F.min("_quality").alias("_quality"))
    known = _io.sampled(known, max_rows)
    rows = with_ratios(measured.join(known, "doc_id").where(~base_failed())).select("_quality", *RATIOS).limit(max_rows).toPandas()
    rows = rows.sort_values(["_quality", *RATIOS], kind="stable")  # rows come in any order
    return learn({k: rows[k].to_numpy() for k in RATIOS}, (rows["_quality"] == 0).to_numpy(), **options)


def judged(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """measured with base_failed, rule (the first that is met) and kept."""
    out = with_ratios(measured).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*RATIOS)


def good_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that pass the base rule and all rules learnt from labels, in one pass over the texts.

    Only the sample's documents, max_rows ids at most, are measured for learning.
    """
    ids = _io.checkpoint(_io.sampled(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").dropna().select("doc_id").distinct(), max_rows))
    known = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")
    rules = fit(stats.measured(known), labels.join(F.broadcast(ids.withColumnRenamed("doc_id", "_id")), F.col("doc_id").cast("long") == F.col("_id")).drop("_id"), max_rows)
    judged_rows = with_ratios(stats.attached(docs, text))
    return _io.unpacked(judged_rows.where(~base_failed() & verdict(rules).isNull()))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    measured = _io.checkpoint(stats.measured(_io.table(spark, sf_dir, "documents")))
    rules = fit(measured, _io.table(spark, sf_dir, "labels"))
    return judged(measured, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")

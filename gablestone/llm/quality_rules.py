"""Learned decision lists over text statistics.

Sequential covering: each rule is a conjunction of thresholds, grown on two thirds of the
labelled rows by information gain and pruned on the other third; the rows that it covers
are set aside and the next rule is grown on the rest. The list is emitted as one ordered
Spark conditional expression, so applying it needs no Python.

Defined results: a null or empty text has zero words and is rejected by the base rules;
rows with null labels are not learned from, and a doc_id with both labels counts under each;
without labels of both kinds the list is empty and keeps whatever passes the base rules; of
equal gains the first statistic and the lowest threshold is taken; other columns pass through
untouched, and as results stand behind a prefix that no column has, names can't clash;
repeated rows are judged one by one; very long texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gablestone.llm.common import bounded_batches, first_by_hash, free_prefix, read
from gablestone.llm.textstats import ratio, text_stats

#: Labelled rows that are learned from, at most; chosen by a hash of doc_id.
MAX_TRAINING_ROWS = 20_000
STATS = "_stats"


def features(stats: str = STATS) -> dict[str, Column]:
    """Interpretable statistics that conditions may test."""
    c = lambda name: F.col(f"{stats}.{name}")
    return {
        "n_words": c("n_words").cast("double"),
        "mean_word_chars": ratio(c("word_chars"), c("n_words")),
        "symbols_per_word": ratio(c("n_symbols"), c("n_words")),
        "dup_line_share": ratio(c("n_dup_lines"), c("n_lines")),
        "repeat_share": ratio(c("n_repeat_words"), c("n_words")),
        "upper_share": ratio(c("n_upper"), c("n_upper") + c("n_lower")),
        "digit_share": ratio(c("n_digits"), c("word_chars")),
        "mark_share": ratio(c("n_marks"), c("word_chars")),
        "distinct_share": ratio(c("n_distinct_words"), c("n_words")),
        "capital_share": ratio(c("n_capital_words"), c("n_words")),
        "ends_per_word": ratio(c("n_ends"), c("n_words")),
    }


def base_failed(stats: str = STATS) -> Column:
    """Too short, or more than half of the words repeat."""
    c = lambda name: F.col(f"{stats}.{name}")
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


@dataclass(frozen=True)
class Rule:
    """All of (feature, ``>=`` or ``<=``, threshold) hold; its counts on the pruning rows."""

    tests: tuple[tuple[str, str, float], ...]
    covered: int = 0
    right: int = 0

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, cut in self.tests:
            out = out & (values[name] >= cut if op == ">=" else values[name] <= cut)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {cut:.6g}" for n, op, cut in self.tests)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def first_rule(self, values: dict[str, Column] | None = None) -> Column:
        """Number of the first rule that holds, from 1; null if none does."""
        values = values or features()
        out = None
        for i, rule in enumerate(self.rules, 1):
            hit = rule.column(values)
            out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
        return F.lit(None).cast("int") if out is None else out


def _mask(x: np.ndarray, names: list[str], tests) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, cut in tests:
        v = x[:, names.index(name)]
        out &= v >= cut if op == ">=" else v <= cut
    return out


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], cuts: list[np.ndarray], most: int):
    """Add the condition of the largest information gain until no bad row is covered."""
    tests, live = [], np.ones(len(x), bool)
    while len(tests) < most and (~y[live]).any():
        p0, n0 = int(y[live].sum()), int(live.sum())
        best, found = 1e-9, None
        for j, name in enumerate(names):
            v, t = x[live, j], y[live]
            for op in (">=", "<="):
                for cut in cuts[j]:
                    m = v >= cut if op == ">=" else v <= cut
                    p, n = int(t[m].sum()), int(m.sum())
                    if p and n < n0 and (gain := p * (np.log2(p / n) - np.log2(p0 / n0))) > best:
                        best, found = gain, (name, op, float(cut))
        if found is None:
            break
        tests.append(found)
        live &= _mask(x, names, [found])
    return tests


def _prune(tests, x: np.ndarray, y: np.ndarray, names: list[str]):
    """Drop final conditions while that doesn't lower (right - wrong) / covered."""
    worth = lambda ts: (2 * int(y[m].sum()) - int(m.sum())) / max(1, int(m.sum())) if (m := _mask(x, names, ts)).any() else -1.0
    while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
        tests = tests[:-1]
    return tests


def learn(x: np.ndarray, y: np.ndarray, names: list[str], min_precision: float = 0.9, max_rules: int = 16, max_tests: int = 4, min_covered: int = 5, n_cuts: int = 64) -> DecisionList:
    """Rules for y (true: to be rejected), most gainful first. Order of the rows decides the split."""
    rules: list[Rule] = []
    part = np.arange(len(y)) % 3
    grow, prune = part < 2, part == 2
    left, open_ = np.ones(len(y), bool), np.ones(len(y), bool)
    while len(rules) < max_rules and y[left & open_ & grow].any() and y[left & open_ & prune].any():
        xs, ys = x[left & open_ & grow], y[left & open_ & grow]
        cuts = [np.unique(np.quantile(xs[:, j], np.linspace(0, 1, n_cuts), method="nearest")) for j in range(len(names))]
        tests = _prune(_grow(xs, ys, names, cuts, max_tests), x[left & open_ & prune], y[left & open_ & prune], names)
        m = _mask(x, names, tests) & left
        if not tests or not (m & open_).any():
            break
        covered, right = int((m & prune).sum()), int((m & prune & y).sum())
        if covered < min_covered or right < min_precision * covered or int((m & y).sum()) < min_precision * int(m.sum()):
            open_ &= ~m  # not precise enough: the next rule is grown on what it doesn't cover
            continue
        rules.append(Rule(tuple(tests), covered, right))
        left &= ~m
    return DecisionList(rules)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> DecisionList:
    """Learn from at most ``max_rows`` labelled rows (label 0: to be rejected).

    The rows are those of the smallest hash of their key, so the bound on what is broadcast
    and on what reaches the driver is that parameter, whatever the size of the corpus.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("_k"), F.col(label).alias("_y"))
    picked = first_by_hash(known, "_k", max_rows)
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(picked), "_k").withColumn(STATS, text_stats("_t"))
    values = features()
    got = rows.where(~base_failed()).select("_k", "_y", *[v.alias(k) for k, v in values.items()]).orderBy(F.xxhash64(F.lit(3), "_k"), "_k").limit(max_rows).toArrow()
    x = np.array([got[k].to_numpy() for k in values]).T.reshape(-1, len(values))
    return learn(x, got["_y"].to_numpy() == 0, list(values))


def judge(docs: DataFrame, rules: DecisionList, text: str = "text", p: str = "_") -> DataFrame:
    """docs with stats, base_failed, rule (first rule that rejects, or null) and kept, each behind the prefix ``p``."""
    bounded_batches(docs.sparkSession)
    stats = f"{p}stats"
    out = docs.withColumn(stats, text_stats(F.col(text)))
    out = out.withColumn(f"{p}base_failed", base_failed(stats)).withColumn(f"{p}rule", rules.first_rule(features(stats)))
    return out.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & F.col(f"{p}rule").isNull())


def filter_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base rules nor the learned list reject."""
    rules = fit(docs, read(spark, sf_dir, "labels"))
    p = free_prefix(docs)
    return judge(docs, rules, p=p).where(F.col(f"{p}kept")).select(*docs.columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, fit(docs, read(spark, sf_dir, "labels")))
    c = lambda name: F.col(f"{STATS}.{name}").alias(name)
    return out.select("doc_id", c("n_words"), c("word_chars"), c("n_symbols"), c("n_dup_lines"), c("n_repeat_words"), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_rule").alias("rule"))

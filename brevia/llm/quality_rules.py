"""Quality rules as weak supervision.

Each rule looks at a text's statistics and votes (for good or for bad, as is its nature) or abstains.
Nobody says how good a rule is: expectation-maximisation estimates every rule's accuracy and the share
of good documents from how the rules agree over the whole corpus. The posterior probability of good
quality, not "all rules must pass", decides.

What EM needs of the corpus is the count of each vote pattern: at most 2 ** len(RULES) rows, whatever
the size of the corpus. The votes are a function of the text alone, so applying the model is a
second scan rather than a stored and joined table.

Null or empty texts have no word: all counts are 0 and the base rules fail. Ties and repeated rows are
independent rows with equal verdicts. An empty table gives the model that EM starts from.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.llm.shared import cut, map_arrow, tables
from brevia.llm.textkit import column_stats

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: (rule, vote, numerator, denominator, from, below): the rule votes where numerator / denominator lies in
#: [from, below), and abstains elsewhere and where the denominator is 0.
RULES = (
    ("stop_words_present", 1, "n_stop", "n_words", 0.1, 2),
    ("mostly_letters", 1, "n_letters", "n_chars", 0.75, 2),
    ("lines_end_sentences", 1, "n_final_lines", "n_lines", 0.9, 2),
    ("stop_words_absent", -1, "n_stop", "n_words", 0, 0.05),
    ("few_letters", -1, "n_letters", "n_chars", 0, 0.6),
    ("many_symbols", -1, "n_symbols", "n_words", 0.1, np.inf),
    ("shouting", -1, "n_upper", "n_letters", 0.3, 2),
    ("exclaiming", -1, "n_loud", "n_words", 0.1, np.inf),
    ("repeating", -1, "n_repeat_words", "n_words", 0.3, 2),
    ("same_lines", -1, "n_dup_lines", "n_lines", 0.4, 2),
    ("open_lines", -1, "n_final_lines", "n_lines", 0, 0.2),
    ("odd_word_length", -1, "word_chars", "n_words", 12, np.inf),
)
VOTE = np.array([rule[1] for rule in RULES])

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """n x rules: whether each rule votes."""
    out = np.zeros((len(stats["n_words"]), len(RULES)), bool)
    for k, (_, _, top, bottom, low, high) in enumerate(RULES):
        share = stats[top] / np.maximum(stats[bottom], 1)
        out[:, k] = (stats[bottom] > 0) & (share >= low) & (share < high)
    return out


def pattern(found: np.ndarray) -> np.ndarray:
    """One integer for each row of votes."""
    return found.astype(np.int64) @ (1 << np.arange(len(RULES), dtype=np.int64))


def unpack(code: np.ndarray) -> np.ndarray:
    return (code[:, None] >> np.arange(len(RULES), dtype=np.int64) & 1).astype(bool)


@dataclass(frozen=True)
class LabelModel:
    """The class balance, and how often each rule that votes is right.

    The balance is a parameter and stays even: were it estimated too, a corpus of mostly good documents
    would drive it to 1 and outvote every detector of a rare fault.
    """

    prior: float = 0.5
    accuracy: np.ndarray = field(default_factory=lambda: np.full(len(RULES), 0.85))

    def posterior(self, found: np.ndarray) -> np.ndarray:
        """P(good | votes). Whether a rule votes at all is taken to be the same in both classes."""
        weight = VOTE * np.log(self.accuracy / (1 - self.accuracy))
        return 1 / (1 + np.exp(-np.clip(math.log(self.prior / (1 - self.prior)) + found @ weight, -500, 500)))


def fit_counts(codes: np.ndarray, n: np.ndarray, rounds: int = 200, tolerance: float = 1e-9, pseudo: float = 1.0) -> LabelModel:
    """EM over the counts of vote patterns, ordered by pattern so that sums don't depend on Spark's order.

    Pseudo counts keep all probabilities inside (0, 1); an accuracy is never under one half, as a rule
    that says the opposite of what its name claims is no evidence.
    """
    order = np.argsort(codes)
    found, n = unpack(codes[order]), n[order].astype(float)
    model = LabelModel()
    if not n.sum():
        return model
    fired = n @ found
    for _ in range(rounds):
        good = model.posterior(found)
        right = np.where(VOTE > 0, (n * good) @ found, (n * (1 - good)) @ found)
        accuracy = np.maximum((right + 0.85 * pseudo) / (fired + pseudo), 0.5)
        moved = np.abs(accuracy - model.accuracy).max()
        model = LabelModel(model.prior, accuracy)
        if moved < tolerance:
            break
    return model


def fit_codes(coded: DataFrame, code: str = "code") -> LabelModel:
    """The model of a table of vote patterns; at most 2 ** len(RULES) counts reach the driver."""
    rows = coded.groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit_counts(np.array([r.code for r in rows], np.int64), np.array([r.n for r in rows], np.int64))


def _failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the base counts, base_failed, code: the vote pattern) of every row; other columns are left out."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            stats = column_stats(batch.column(1))
            columns = [batch.column(0), *(pa.array(stats[c]) for c in BASE), pa.array(_failed(stats)), pa.array(pattern(votes(stats)))]
            return pa.RecordBatch.from_arrays(columns, [key, *BASE, "base_failed", "code"])

        return step

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, code long"
    return map_arrow(docs.select(F.col(key), F.col(text).cast("string").alias("text")), schema, make)


FAILED = 1 << len(RULES)


def verdict_column(text: Column) -> Column:
    """The vote pattern of a text, with FAILED set where the base rules fail, as a column: filters on it
    keep all other columns in the JVM. It is marked as nondeterministic so that Catalyst evaluates it once."""

    @F.arrow_udf("long")
    def code(column: pa.Array) -> pa.Array:
        stats = column_stats(column)
        return pa.array(pattern(votes(stats)) + FAILED * _failed(stats))

    return code.asNondeterministic()(text)


def posterior_column(code: Column, model: LabelModel) -> Column:
    """LabelModel.posterior of a vote pattern, in the JVM."""
    logit = F.lit(math.log(model.prior / (1 - model.prior)))
    for k, (vote, accuracy) in enumerate(zip(VOTE, model.accuracy, strict=True)):
        logit = logit + F.when(code.bitwiseAND(1 << k) != 0, float(vote * math.log(accuracy / (1 - accuracy)))).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, the base counts, base_failed, quality, kept) for every row of docs, under the model fitted to them.

    The statistics, a few numbers a row, are kept in the shared folder between the fit and the verdict.
    """
    measured = cut(measure(docs, key, text))
    model = fit_codes(measured)
    judged = measured.withColumn("quality", posterior_column(F.col("code"), model))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)).drop("code")


def filter_documents(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that pass the base rules and the model fitted to docs.

    The verdict follows from the text, so a second scan takes the place of a join over all texts.
    """
    verdict, seen = "__brevia_verdict", F.col("__brevia_verdict")
    coded = docs.withColumn(verdict, verdict_column(F.col(text).cast("string")))
    model = fit_codes(coded.select(seen.bitwiseAND(FAILED - 1).alias("code")))
    return coded.filter((seen < FAILED) & (posterior_column(seen, model) >= least)).drop(verdict)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score(tables(spark, sf_dir, "documents"))

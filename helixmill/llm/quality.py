"""Quality rules whose cut-offs are chosen under a proven bound on false rejections.

Features of every text are computed in one narrow pass. Labelled documents then calibrate, for each stratum, how far the
cut-offs of all rules may be tightened: one sequence of steps, each of which tightens one rule, goes from no rule on, and
after each step the exact binomial tail must show that the rules together reject less than ``alpha`` of the good
documents. The sequence is drawn up from the bad documents alone, so it is fixed for the good ones, and going on only
while tests succeed keeps the error of a stratum at its level (fixed-sequence testing). Levels start at ``delta / strata``
(Bonferroni), and a stratum whose whole sequence is proved passes its level on to the others in equal parts, until none
ends any more: what is left of ``delta`` is shared by those with steps still to prove (a Holm procedure over sequences). So with probability ``1 - delta`` no stratum loses more than the share ``alpha`` of its good documents to the rules. Bad
labels choose the steps and good labels prove them, so what proves a cut-off has had no part in its choice.

A stratum of fewer than ``least_good(strata)`` good documents can't pass any test by itself. All such strata are one
pool: it is calibrated like a stratum, and the bound holds for the pool as a whole, not for each member.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import reachable, small, stored

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LONG = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: rule -> (numerator, denominator, cut-offs from lenient to strict); a document is rejected if the ratio is above.
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "repeats": ("n_repeat_words", "n_words", (0.19, 0.17, 0.15, 0.12, 0.1, 0.07, 0.05)),
    "word_length": ("word_chars", "n_words", (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0)),
}


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Number of words inside windows that occur at least twice, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if n > LONG:  # the same in arrays, which take a tenth of the memory: ranks of runs of 1, 2, 4, ... words
        number: dict[bytes, int] = {}
        rank = one = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        for k in range(1, width):
            rank = np.unique(rank[:-1] * (len(number) + 1) + one[k:], return_inverse=True)[1]
        again = np.bincount(rank)[rank] > 1
    else:
        grams = list(zip(*(words[k:] for k in range(width)), strict=False))
        if len(set(grams)) == n:
            return 0
        count = Counter(grams)
        again = np.fromiter((count[g] > 1 for g in grams), bool, n)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text; a null text has none of anything."""
    if text is None:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(raw.count(c) for c in SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, and COUNTS of its column text. One narrow pass; any number of columns is carried."""
    reachable(docs.sparkSession)
    at = docs.select(*keep, F.col("text").alias("_text"))
    schema = at.drop("_text").withColumns({c: F.lit(0).cast("long") for c in COUNTS}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([counts(x.as_py()) for x in batch.column("_text")], np.int64).reshape(-1, len(COUNTS))
            held = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(c) for c in rows.T)], names=[*keep, *COUNTS])

    return at.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratio(rule: str) -> Column:
    over, under, _ = RULES[rule]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, summed exactly in log space."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    ways = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i])
    logs = ways + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def least_good(strata: int, alpha: float = 0.01, delta: float = 0.05) -> int:
    """Good labelled documents that a stratum needs for a verdict, if the rules reject none of them."""
    return math.ceil(math.log(delta / strata) / math.log1p(-alpha))


def sequence(first: dict[str, np.ndarray], bad: np.ndarray) -> Iterator[tuple[str, int]]:
    """Steps (rule, step): the next that rejects more bad documents, of the rule that could yet reject most of those left.

    ``first`` holds for each rule the first step that rejects the documents of a cell, ``bad`` how many of them are bad.
    """
    left = bad.astype(np.int64).copy()
    while True:
        best = None
        for rule, f in first.items():
            ahead = (left > 0) & (f < len(RULES[rule][2]))
            if ahead.any():
                step = int(f[ahead].min())
                key = int(left[ahead].sum()), -step / len(RULES[rule][2])  # of equal counts, the more lenient
                if best is None or key > best[0]:
                    best = key, rule, step
        if best is None:
            return
        _, rule, step = best
        left[first[rule] <= step] = 0
        yield rule, step


def steps(cells: pd.DataFrame, alpha: float, delta: float) -> pd.DataFrame:
    """Of the cells of a stratum or the pool (a first step for each rule, good, bad): a row for each step of its sequence.

    needed is the level at which the step and all before it are proved; steps that even delta doesn't prove are left out.
    The row without a rule has the level at which the sequence ends. good_out and bad_out are those of the rule alone; a
    document may be rejected by several.
    """
    first, good, bad = {r: cells[r].to_numpy() for r in RULES}, cells["good"].to_numpy(), cells["bad"].to_numpy()
    n, needed, out, rows = int(good.sum()), 0.0, np.zeros(len(cells), bool), []
    for rule, step in sequence(first, bad):
        out = out | (first[rule] <= step)
        needed = max(needed, binomial_tail(int(good[out].sum()), n, alpha))
        if needed > delta:
            break
        rule_out = first[rule] <= step
        rows.append((rule, RULES[rule][2][step], n, int(good[rule_out].sum()), int(bad[rule_out].sum()), needed))
    rows.append((None, None, n, 0, 0, needed))
    out = pd.DataFrame(rows, columns=["rule", "cutoff", "good", "good_out", "bad_out", "needed"])
    return out.assign(pooled=cells["pooled"].iloc[0], alone=cells["alone"].iloc[0])


def passed_on(needed: list[float], delta: float = 0.05) -> float:
    """The level of each sequence that is not at its end, once those at their ends have passed theirs on."""
    left = len(needed)
    for level in sorted(needed):
        if level > delta / left:
            break
        left -= 1
        if not left:
            break
    return delta / max(1, left)


def calibrate(features: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """features: doc_id, stratum and COUNTS; labels: doc_id, quality (1 good, 0 bad). Returns stratum, rule, cutoff, pooled, ...

    Null labels and null ids are left out; a document labelled more than once counts as bad if any label says so.
    A null stratum is a stratum of its own; one without labels has no verdict. Without labels the result is empty: no
    rule may reject anything. Strata that share the pool's cut-offs have a row each, with the pool's counts; where pooled is
    true and several strata are, none of them has a bound of its own.
    """
    reachable(features.sparkSession)
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    held = features.where(~base_failed()).join(marks, "doc_id")
    first = {
        rule: sum((F.when(ratio(rule) > F.lit(cut), 0).otherwise(1) for cut in cuts), F.lit(0)).cast("long").alias(rule)
        for rule, (_, _, cuts) in RULES.items()
    }  # cut-offs fall, so those that don't reject a document come before those that do
    cells = stored(
        held.select("stratum", "_good", *first.values())
        .groupBy("stratum", *RULES)  # 8712 rows a stratum at most
        .agg(F.count_if(F.col("_good") > 0).alias("good"), F.count_if(F.col("_good") <= 0).alias("bad"))
    )
    strata = cells.groupBy("stratum").agg(F.sum("good").alias("_n"))
    need = least_good(max(1, strata.count()), alpha, delta)
    strata = strata.select(F.col("stratum").alias("_member"), (F.col("_n") < need).alias("pooled"), F.when(F.col("_n") >= need, F.col("stratum")).alias("alone"))
    strata = small(strata)
    groups = cells.join(strata, F.col("stratum").eqNullSafe(F.col("_member"))).groupBy("pooled", "alone", *RULES)
    schema = "rule string, cutoff double, good long, good_out long, bad_out long, needed double, pooled boolean, alone string"
    groups = groups.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).groupBy("pooled", "alone")
    tried = stored(groups.applyInPandas(lambda x: steps(x, alpha, delta), schema))  # 35 rows a stratum at most
    level = passed_on(tried.where("rule IS NULL").agg(F.collect_list("needed")).first()[0], delta)  # a number a stratum
    cuts = tried.where(F.col("rule").isNotNull() & (F.col("needed") <= level)).groupBy(F.col("pooled").alias("_p"), F.col("alone").alias("_a"), "rule")
    cuts = cuts.agg(F.min("cutoff").alias("cutoff"), *(F.max(c).alias(c) for c in ("good", "good_out", "bad_out")))
    same = (F.col("_p") == F.col("pooled")) & F.col("_a").eqNullSafe(F.col("alone"))
    return cuts.join(strata, same).select(F.col("_member").alias("stratum"), "rule", "cutoff", "pooled", "good", "good_out", "bad_out")


def judged(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """features with base_failed and kept. cutoffs are pivoted to a row for each stratum, joined with its size checked."""
    wide = cutoffs.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_max_{r}") for r in RULES))
    wide = small(wide.withColumnRenamed("stratum", "_stratum"))
    out = features.join(wide, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    bad = base_failed()
    for rule in RULES:
        bad = bad | F.coalesce(ratio(rule) > F.col(f"_max_{rule}"), F.lit(False))
    return out.withColumns({"base_failed": base_failed(), "kept": ~bad}).drop("_stratum", *(f"_max_{r}" for r in RULES))

"""Quality rules and robust multivariate outliers.

Base rules count words, symbols, repeated lines and repeated windows of words in whole texts. What passes them becomes
a vector of transformed statistics (word length, symbols, repeated lines, repeated words), and for each language and
source a minimum-covariance-determinant estimate of mean and covariance is made from all its documents: from several
starts (``STARTS``), concentration steps take the part ``KEPT_SHARE`` of nearest documents and estimate again from these.
After ``FIRST_STEPS`` the ``BEST_STARTS`` of least determinant go on until it stops falling (or ``MOST_STEPS`` have been
made), and the estimate of least determinant is taken. A document
further than a far quantile of the chi-square distribution (squared Mahalanobis distance) is rejected.

All steps are sums by group, with a partial sum before the shuffle, so a hot source is no one's task. A step reads the rows
once: the sums of each bin of a histogram of distances, of bounded size, are added up from the nearest bin to the share. Groups with fewer than ``LEAST`` documents take the estimate of their
language, and if that is small too of all documents. Each statistic has a least spread (``FLOOR``): where all documents
agree, a slight difference is no outlier.

Defined cases: a null or blank text has no words and fails the base rules; null language and null source are values of
their own; repeated rows count and are returned as often as they stand there; an empty table gives no rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import ship, table, written
from folio.llm.textbytes import Texts, mixed, runs_of
from folio.llm.tokens import drop_encoders, in_portions

SYMBOLS = b"#*$%&|<>"
REPEAT_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
KEPT_SHARE = 0.55
#: Each start: the quantiles whose middle is its centre and whose distance is its spread, for all statistics.
STARTS = ((0.25, 0.5, 0.75), (0.4, 0.5, 0.6), (0.05, 0.25, 0.45), (0.55, 0.75, 0.95))
#: The part of a normal distribution that the last estimate is made from.
CLOSE = 0.975
#: A determinant that falls by a smaller part has stopped.
STOPPED = 1e-4
#: After so many steps of all starts those of the least determinants go on, until they stop or for so many steps in all.
FIRST_STEPS = 2
BEST_STARTS = 2
MOST_STEPS = 60
LEAST = 60
#: Chance that a document of a normal distribution is further than the limit.
FAR = 1e-3
DIMS = 4
#: Least standard deviation of: mean word length (its unit is below), roots of symbols a letter, of repeated lines a line,
#: of repeated words a word. Most groups have none of the last three in most documents, so theirs is the only spread.
FLOOR = (0.05, 0.03, 0.12, 0.12)
#: Least covariance: a repeated line repeats its words too.
LEAST_COVARIANCE = np.diag(np.square(FLOOR))
LEAST_COVARIANCE[2, 3] = LEAST_COVARIANCE[3, 2] = 0.6 * FLOOR[2] * FLOOR[3]
#: Lines that are added to a document's, so that one repeated line of a few is no habit.
PRIOR_LINES = 2
#: The logarithm of a document's mean word length varies as the root of 1 / its words + 1 / so many.
LONG_WORDS = 2000

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def base_statistics(texts: list[str]) -> pd.DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word) of whole texts."""
    parts = [_statistics(run) for _, run in in_portions(texts)]
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})


def _statistics(run: list[str]) -> pd.DataFrame:
    t = Texts(run)
    n = len(run)
    inside = np.zeros(len(t.bytes) + 1, np.int8)
    np.add.at(inside, t.begin, 1)
    np.add.at(inside, t.end, -1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8) > 0
    sums = t.sums()
    # lines: all but those without a word
    ends = np.flatnonzero(t.bytes == 10)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    has_word = np.searchsorted(t.begin, begins) < np.searchsorted(t.begin, ends)
    begins, ends = begins[has_word], ends[has_word]
    line_text = np.searchsorted(t.edge, begins, "right") - 1
    lines = np.bincount(line_text, minlength=n)
    of_text = mixed(line_text.astype(np.uint64) + np.uint64(1))
    different = np.unique(np.stack([t.span_hashes(begins, ends, sums) + of_text, line_text.astype(np.uint64)], 1), axis=0) if len(begins) else np.zeros((0, 2), np.uint64)
    dup_lines = lines - np.bincount(different[:, 1].astype(np.int64), minlength=n)
    # words in a window that its text has twice
    windows = runs_of(t.span_hashes(t.begin, t.end, sums), REPEAT_WORDS)
    first = t.text[: len(windows)]
    whole = first == t.text[REPEAT_WORDS - 1 :] if len(windows) else np.zeros(0, bool)
    keys = windows[whole] + mixed(first[whole].astype(np.uint64) + np.uint64(1))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    marks = np.zeros(len(t.begin) + 1, np.int64)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = np.flatnonzero(whole)[twice[at] == keys]
        np.add.at(marks, hit, 1)
        np.add.at(marks, hit + REPEAT_WORDS, -1)
    repeated = np.bincount(t.text[np.cumsum(marks)[:-1] > 0], minlength=n)
    letters = in_word & ((t.bytes & 0xC0) != 0x80)
    return pd.DataFrame({"n_words": t.n_words, "word_chars": t.total(letters), "n_symbols": t.total(_IS_SYMBOL[t.bytes]), "n_dup_lines": dup_lines, "n_repeat_words": repeated, "n_lines": lines})


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of each row."""
    ship(docs.sparkSession)

    def run(frames):
        drop_encoders()
        for f in frames:
            yield pd.concat([pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "lang": f["lang"], "source": f["source"]}), base_statistics(list(f["text"]))], axis=1)

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    return docs.select("doc_id", "lang", "source", "text").mapInPandas(run, f"doc_id long, lang string, source string, {counts}")


def chi_square(x: float, degrees: int) -> float:
    """The distribution's value at x, for an even number of degrees."""
    term, total = 1.0, 1.0
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


def consistency(share: float, degrees: int) -> float:
    """What the covariance of the nearest share is multiplied with, to be that of all of a normal distribution."""
    return share / chi_square(chi_square_quantile(share, degrees), degrees + 2)


def vectors(passed: DataFrame, least: int = LEAST) -> DataFrame:
    """The transformed statistics x0 to x3, of rows that passed the base rules."""
    length = F.log(F.col("word_chars") / F.col("n_words"))
    of_lang = passed.groupBy("lang").agg(F.percentile_approx(length, 0.5, 1000).alias("_of_lang")).withColumnRenamed("lang", "_l")
    middle = passed.groupBy("lang", "source").agg(F.percentile_approx(length, 0.5, 1000).alias("_middle"), F.count("*").alias("_n"))
    middle = middle.join(of_lang, middle["lang"].eqNullSafe(of_lang["_l"])).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.when(F.col("_n") >= least, F.col("_middle")).otherwise(F.col("_of_lang")).alias("_middle"))
    df = passed.join(middle, passed["lang"].eqNullSafe(middle["_lang"]) & passed["source"].eqNullSafe(middle["_source"])).drop("_lang", "_source")
    return df.select(
        *[c for c in passed.columns],
        ((length - F.col("_middle")) / F.sqrt(1 / F.col("n_words") + 1 / LONG_WORDS)).alias("x0"),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("x1"),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + PRIOR_LINES)).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / F.greatest("n_words", F.lit(1))).alias("x3"),
    )


def estimate(sums: DataFrame, scale: float) -> DataFrame:
    """Mean and inverse covariance of each group from its sums (level, lang, source, start, n, s0.., p00..), and the logarithm of the determinant."""

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                mean = np.array([getattr(r, f"s{i}") for i in range(DIMS)]) / r.n
                second = np.array([[getattr(r, f"p{min(i, j)}{max(i, j)}") for j in range(DIMS)] for i in range(DIMS)]) / r.n
                cov = (second - np.outer(mean, mean)) * scale + LEAST_COVARIANCE
                out.append((r.level, r.lang, r.source, r.start, int(r.n), mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(out, columns=["level", "lang", "source", "start", "n", "mean", "inverse", "det"])

    return sums.mapInPandas(run, "level int, lang string, source string, start int, n long, mean array<double>, inverse array<double>, det double")


#: The sums that an estimate is made from; sums of parts add up to those of the whole.
MOMENTS = ("n", *[f"s{i}" for i in range(DIMS)], *[f"p{i}{j}" for i in range(DIMS) for j in range(i, DIMS)])


def moments() -> list[Column]:
    sums = {f"s{i}": f"x{i}" for i in range(DIMS)} | {f"p{i}{j}": f"x{i} * x{j}" for i in range(DIMS) for j in range(i, DIMS)}
    return [F.count("*").alias("n"), *[F.expr(f"sum({x})").alias(name) for name, x in sums.items()]]


def distance() -> Column:
    """The squared Mahalanobis distance of x0.. from a row's mean by its inverse."""
    return F.expr(" + ".join(f"(x{i} - mean[{i}]) * (x{j} - mean[{j}]) * inverse[{i * DIMS + j}]" for i in range(DIMS) for j in range(DIMS)))


def near(df: DataFrame, estimates: DataFrame) -> DataFrame:
    e = estimates.select(F.col("level").alias("_level"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "start", "mean", "inverse")
    joined = df.join(e, (df["level"] == e["_level"]) & df["lang"].eqNullSafe(e["_lang"]) & df["source"].eqNullSafe(e["_source"]))
    return joined.withColumn("distance", distance()).drop("_level", "_lang", "_source", "mean", "inverse")


def same_group(a: DataFrame, b: DataFrame) -> Column:
    """a's keys with those of b that have a line before their names."""
    return (a["level"] == b["_level"]) & a["lang"].eqNullSafe(b["_lang"]) & a["source"].eqNullSafe(b["_source"]) & (a["start"] == b["_start"])


def robust_estimates(df: DataFrame, share: float = KEPT_SHARE) -> DataFrame:
    """The estimates of rows (level, lang, source, x0..): concentration steps over all rows, of all starts at once."""
    group = ["level", "lang", "source"]
    keys = [*group, "start"]
    quantiles = sorted({q for start in STARTS for q in start})
    mid = df.groupBy(*group).agg(*[F.percentile_approx(f"x{i}", quantiles, 1000).alias(f"q{i}") for i in range(DIMS)], F.count("*").alias("n"))
    at = lambda i, q: F.col(f"q{i}")[quantiles.index(q)]
    normal = NormalDist().inv_cdf

    def start(k: int) -> Column:
        low, middle, high = STARTS[k]
        spread = lambda i: (at(i, high) - at(i, low)) / (normal(high) - normal(low))
        inverse = [1 / (F.pow(spread(i), 2) + FLOOR[i] ** 2) if i == j else F.lit(0.0) for i in range(DIMS) for j in range(DIMS)]
        return F.struct(F.lit(k).alias("start"), F.array(*[at(i, middle) for i in range(DIMS)]).alias("mean"), F.array(*inverse).alias("inverse"))

    starts = mid.select(*group, "n", F.explode(F.array(*[start(k) for k in range(len(STARTS))])).alias("s")).select(*group, "s.start", "n", "s.mean", "s.inverse", F.lit(float("inf")).alias("det"))
    moving = written(starts, "estimates")
    scale = consistency(share, DIMS)
    by_det = W.partitionBy(*group).orderBy("det", "start")
    w = W.partitionBy(*keys)
    stopped = []
    for nth in range(1, MOST_STEPS + 1):
        # one pass over the rows: the sums of each bin of distances, of which the nearest bins are added up
        binned = near(df, moving).withColumn("bin", F.floor(F.log1p(F.col("distance")) * 100).cast("int")).groupBy(*keys, "bin").agg(*moments())
        before_it, all_of = F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.sum("n").over(w)
        nearest = binned.withColumn("_before", F.coalesce(before_it, F.lit(0))).withColumn("_all", all_of).where(F.col("_before") < share * F.col("_all"))
        new = estimate(nearest.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in MOMENTS]), scale)
        before = moving.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("det").alias("_det"), F.col("mean").alias("_mean"), F.col("inverse").alias("_inverse"))
        fell = F.col("det") < F.col("_det") - STOPPED
        less = F.col("det") < F.col("_det")
        step = new.join(before, same_group(new, before)).select(*keys, "n", F.when(less, F.col("mean")).otherwise(F.col("_mean")).alias("mean"), F.when(less, F.col("inverse")).otherwise(F.col("_inverse")).alias("inverse"), F.least("det", "_det").alias("det"), (fell & F.lit(nth < MOST_STEPS)).alias("_fell"))
        if nth == FIRST_STEPS:
            step = step.withColumn("_nth", F.row_number().over(by_det)).where(F.col("_nth") <= BEST_STARTS).drop("_nth")
        step = written(step, "estimates")
        moving = step.where("_fell").drop("_fell")
        if nth < FIRST_STEPS:
            # all starts go on to where the best are chosen
            moving = step.drop("_fell")
            continue
        stopped.append(step.where(~F.col("_fell")).drop("_fell"))
        if moving.isEmpty():
            break
    every = stopped[0]
    for s in stopped[1:]:
        every = every.unionByName(s)
    best = written(every.withColumn("_nth", F.row_number().over(by_det)).where("_nth = 1").drop("_nth"), "estimates")
    # the usual last step: once more from all rows that are not far
    close = near(df, best).where(F.col("distance") <= chi_square_quantile(CLOSE, DIMS))
    return written(estimate(close.groupBy(*keys).agg(*moments()), consistency(CLOSE, DIMS)), "estimates")


def judged(statistics: DataFrame, far: float = FAR, least: int = LEAST) -> DataFrame:
    """The rows of ``with_statistics`` with base_failed, distance (null where base rules failed) and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = statistics.withColumn("base_failed", failed)
    passed = vectors(rows.where(~F.col("base_failed")), least)
    sizes = passed.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = W.partitionBy("lang")
    sizes = sizes.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.when(F.col("n") >= least, 0).when(F.sum("n").over(by_lang) >= least, 1).otherwise(2).alias("level"))
    passed = passed.join(sizes, passed["lang"].eqNullSafe(sizes["_lang"]) & passed["source"].eqNullSafe(sizes["_source"])).drop("_lang", "_source")
    passed = written(passed, "vectors")
    # a small group is judged by the estimate of its language or of all, and these are made from all their documents
    levels = passed.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level"), "lang", "source", "x0", "x1", "x2", "x3")
    needed = {r["level"] for r in passed.select("level").distinct().collect()}
    scope = lambda df: df.withColumn("source", F.when(F.col("level") == 0, F.col("source"))).withColumn("lang", F.when(F.col("level") < 2, F.col("lang")))
    estimates = robust_estimates(scope(levels.where(F.col("level").isin(list(needed)))))
    mine = near(scope(passed.withColumn("_l", F.col("lang")).withColumn("_s", F.col("source"))), estimates)
    limit = chi_square_quantile(1 - far, DIMS)
    columns = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    mine = mine.withColumn("lang", F.col("_l")).withColumn("source", F.col("_s")).select(*columns, "distance", (F.col("distance") <= limit).alias("kept"))
    out = rows.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return mine.unionByName(out)


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    statistics = written(with_statistics(table(spark, folder, "documents")), "statistics")
    return judged(statistics).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
